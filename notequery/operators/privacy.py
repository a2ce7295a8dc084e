"""Credentials in text: rules, detection, redaction and the gate before any request leaves."""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notequery.functions.text import entropy, looks_random, placeholder
from notequery.operators.rules import RULES

RULE = "rule string, ord int, pattern string, confidence string, min_entropy double, keywords array<string>"
_OPEN, _CLOSE = "\u0001", "\u0002"


OWN = RULES


def _plain(text: Column) -> Column:
    """A text without the characters that mark matches."""
    marked = F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE))
    return F.when(marked, F.translate(text, _OPEN + _CLOSE, "  ")).otherwise(text)


class BrokenRules(ValueError):
    """A rule set that can't be used; nothing may be sent."""


def java_pattern(pattern: str) -> str:
    """A pattern of the RE2 kind as Spark reads it: named groups, POSIX classes and $ as the end of the text."""
    out = pattern.replace("(?P<", "(?<")
    for name in ("alnum", "alpha", "digit", "upper", "lower", "space", "punct"):
        out = out.replace(f"[:{name}:]", rf"\p{{{name.capitalize()}}}")
    return out[:-1] + r"\z" if out.endswith("$") and not out.endswith(r"\$") else out


def load(spark: SparkSession, rules: list[dict] | None = None, disabled: list[str] | None = None, path: str | None = None) -> DataFrame:
    """The rule table: own rules, or those given, and those of a JSON-lines file; without the disabled ones.

    Every pattern is tried once before any text is read: a rule that can't be compiled or a set without rules
    raises ``BrokenRules``, so that nothing goes unscanned.
    """
    rows = list(OWN if rules is None else rules)
    if path:
        rows += [json.loads(r["value"]) for r in spark.read.text(path).collect() if r["value"].strip()]
    rows = [r for r in rows if r["rule"] not in set(disabled or [])]
    if not rows:
        raise BrokenRules("no rules")
    tries = spark.createDataFrame([(java_pattern(r["pattern"]),) for r in rows], "p string").select(F.max(F.regexp_like(F.lit("x"), F.col("p"))))
    try:
        tries.collect()
    except Exception as e:
        raise BrokenRules(str(e)) from e
    table = [(r["rule"], i, java_pattern(r["pattern"]), r["confidence"], float(r["min_entropy"]), [k.lower() for k in r["keywords"]]) for i, r in enumerate(rows)]
    return spark.createDataFrame(table, RULE)


def names(rules: DataFrame) -> DataFrame:
    return rules.select("rule").orderBy("rule")


def called(rules: list[dict]):
    """Of each text the places in the table of the rules that it calls for: those of which it contains a keyword, in any case, and those without keywords.

    One automaton finds all keywords in one pass; patterns of many alternatives took Java ten times as long.
    """
    own: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        for k in r["keywords"]:
            own.setdefault(k, []).append(i)
    always = [i for i, r in enumerate(rules) if not r["keywords"]]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = ahocorasick.Automaton()
        for k in own:
            words.add_word(k, k)
        words.make_automaton()
        for batch in batches:
            # One text of a batch at a time is a string of Python's.
            met = ({k for _, k in words.iter(text.as_py().lower())} if own and text.is_valid and len(text.as_buffer()) else () for text in batch)
            yield pa.array([sorted({i for k in found for i in own[k]}.union(always)) for found in met], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")


def matches(docs: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rule, ord, start, end, match) of every credential, in characters from 0.

    A text's keywords say what rules it meets.  Rows then lie by rule within their task, so that each pattern is
    compiled once there and runs over its own rows only.  The rule table is a parameter of the driver's.  Matches are
    set between two characters that no text keeps, which gives their places without leaving Spark's own functions.
    """
    table = [r.asDict() for r in rules.orderBy("ord").collect()]
    fields = ("rule", "ord", "pattern", "confidence", "min_entropy")
    shapes = F.array(*[F.struct(*[F.lit(r[f]).alias(f) for f in fields]) for r in table])
    rows = docs.select(key, _plain(F.col(text)).alias("_t")).filter("_t is not null")
    rows = rows.select(key, "_t", F.explode(called(table)("_t")).alias("_o")).sortWithinPartitions("_o")
    rows = rows.select(key, "_t", F.get(shapes, F.col("_o")).alias("_r")).select(key, "_t", *[f"_r.{f}" for f in fields])
    parts = F.split(F.regexp_replace("_t", F.col("pattern"), F.lit(f"{_OPEN}$0{_CLOSE}")), f"[{_OPEN}{_CLOSE}]")
    rows = rows.select(key, "rule", "ord", "confidence", "min_entropy", parts.alias("_parts"))
    lengths = F.transform("_parts", lambda p: F.char_length(p))
    # The outer form, and no filter before it, since Spark would move one below the sort, where patterns alternate.
    rows = rows.select("*", F.posexplode_outer("_parts").alias("_i", "match"), lengths.alias("_n")).filter("_i % 2 = 1")
    rows = rows.withColumn("start", F.aggregate(F.slice("_n", F.lit(1), F.col("_i")), F.lit(0), lambda s, n: s + n)).withColumn("end", F.col("start") + F.char_length("match"))
    sure = (
        F.when(F.col("confidence") == "entropy", entropy(F.col("match")) >= F.col("min_entropy"))
        .when(F.col("confidence") == "random", looks_random(F.regexp_extract(F.col("match"), r"[:=]\s*[\"']?([^\s\"',;]{8,})", 1)))
        .otherwise(True)
    )
    return rows.filter(sure & ~placeholder(F.col("match"))).select(key, "rule", "ord", "start", "end", "match")


def merge(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, rule, start, end): spans that overlap as one, named by the first; spans that touch stay apart."""
    order = Window.partitionBy(key).orderBy("start", F.desc("end"), "ord")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = found.withColumn("_new", (F.col("start") >= F.coalesce(reach, F.lit(0))).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min_by("rule", F.struct("start", -F.col("end"), "ord"))
    return rows.groupBy(key, "_island").agg(first.alias("rule"), F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def _merged(spans: Column) -> Column:
    """``merge`` within a row: of (start, minus end, ord, rule) in order, (start, end, rule) of what overlaps as one."""
    kind = "array<struct<start: int, end: int, rule: string>>"

    def add(state: Column, x: Column) -> Column:
        last, end = F.element_at(state, -1), -x["back"]
        one = lambda a, b, r: F.array(F.struct(a.alias("start"), b.alias("end"), r.alias("rule")))
        joined = F.concat(F.slice(state, 1, F.size(state) - 1), one(last["start"], F.greatest(last["end"], end), last["rule"]))
        return F.when((F.size(state) > 0) & (x["start"] < last["end"]), joined).otherwise(F.concat(state, one(x["start"], end, x["rule"])))

    return F.aggregate(spans, F.array().cast(kind), add)


def redact(docs: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows with ``redacted`` ([redacted: rule] in place of each span), ``counts`` (rule, n) and ``first_rule`` in table order.

    Texts are searched once; a document's own spans meet in one row, and documents with the same key share them.
    """
    found = matches(docs, rules, key, text).groupBy(key).agg(
        F.array_sort(F.collect_set(F.struct("start", (-F.col("end")).alias("back"), "ord", "rule"))).alias("_found"), F.min_by("rule", "ord").alias("first_rule")
    )
    rows = docs.join(found, key, "left").withColumn("_spans", _merged(F.col("_found"))).drop("_found")
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    clean = _plain(F.col(text))

    def step(s: Column, x: Column) -> Column:
        before = F.substring(clean, s["at"] + 1, x["start"] - s["at"])
        return F.struct(F.concat(s["out"], before, F.lit("[redacted: "), x["rule"], F.lit("]")).alias("out"), x["end"].alias("at"))

    done = F.aggregate("_spans", state, step)
    whole = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(F.concat(done["out"], F.substring(clean, done["at"] + 1, F.char_length(clean))))
    kinds = F.array_sort(F.array_distinct(F.transform("_spans", lambda s: s["rule"])))
    counts = F.transform(kinds, lambda r: F.struct(r.alias("rule"), F.size(F.filter("_spans", lambda s: s["rule"] == r)).alias("n")))
    return rows.withColumn("redacted", whole).withColumn("counts", counts).drop("_spans")


def gate(requests: DataFrame, rules: DataFrame, refused_sources: Column, mode: str = "redact", granularity: str = "message") -> tuple[DataFrame, DataFrame]:
    """Requests that may leave, with ``counts`` and ``withheld``; and those refused, with the reason.

    In every mode a request with a source for which ``refused_sources`` (of a column ``source``) holds is refused.
    'redact' replaces credentials, 'block' takes out whole messages that hold any, or with granularity 'excerpt' only
    their excerpts that do, 'off' leaves messages alone; a broken rule set never gets here, since ``load`` raises.
    """
    if mode not in ("redact", "block", "off") or granularity not in ("message", "excerpt"):
        raise ValueError(f"unknown mode: {mode}, {granularity}")
    bad = requests.select("request_id", F.explode("sources").alias("source")).filter(refused_sources).groupBy("request_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    refused = bad.select("request_id", F.lit("excluded source").alias("reason"), "sources")
    free = requests.join(bad.select("request_id"), "request_id", "left_anti")
    if mode == "off":
        return free.withColumn("counts", F.array().cast("array<struct<rule: string, n: int>>")).withColumn("withheld", F.array().cast("array<string>")), refused
    each = free.select("request_id", F.posexplode("messages").alias("i", "m"))
    parts = F.split("m.content", r"(?m)(?=^=== EXCERPT )") if mode == "block" and granularity == "excerpt" else F.array("m.content")
    each = each.select("request_id", "i", "m.role", F.posexplode(parts).alias("j", "text")).withColumn("_id", F.concat_ws("/", "request_id", "i", "j"))
    seen = redact(each, rules, "_id")
    hit = F.col("first_rule").isNotNull()
    shown = F.struct("j", F.col("redacted" if mode == "redact" else "text").alias("text"))
    messages = seen.groupBy("request_id", "i", "role").agg(
        F.array_sort(F.collect_list(shown if mode == "redact" else F.when(~hit, shown))).alias("_p"),
        F.flatten(F.collect_list("counts")).alias("_c"),
        F.array_sort(F.collect_list(F.when(hit & F.lit(mode == "block"), F.concat_ws(": ", "role", "first_rule")))).alias("_w"),
    )
    whole = F.struct("i", F.struct("role", F.array_join(F.transform("_p", lambda p: p["text"]), "").alias("content")).alias("m"))
    rows = messages.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.when(F.size("_p") > 0, whole))).alias("_m"), F.flatten(F.collect_list("_c")).alias("_c"), F.array_sort(F.flatten(F.collect_list("_w"))).alias("withheld")
    )
    kinds = F.array_sort(F.array_distinct(F.transform("_c", lambda c: c["rule"])))
    total = F.transform(kinds, lambda r: F.struct(r.alias("rule"), F.aggregate(F.filter("_c", lambda c: c["rule"] == r), F.lit(0), lambda s, c: s + c["n"]).alias("n")))
    out = free.drop("messages").join(rows, "request_id").withColumn("messages", F.transform("_m", lambda x: x["m"])).withColumn("counts", total)
    return out.drop("_m", "_c"), refused


def scrub(text: Column) -> Column:
    """Log text with what follows sk-, Bearer and api_key= starred out, up to the next separator."""
    return F.regexp_replace(text, r"(sk-|Bearer |api_key=)[^\s\",}]*", "$1***")


def anonymise(text: Column, root: str, home: str) -> Column:
    """A report without credentials and without the notes folder and home folder, the longer path first, whatever separators or case."""
    out = scrub(text)
    for path, name in sorted(((root, "<notes>"), (home, "<user>")), key=lambda p: -len(p[0])):
        steps = [s for s in path.replace("\\", "/").split("/")]
        escaped = ["".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in s) for s in steps]
        out = F.regexp_replace(out, "(?i)" + r"[\\/]+".join(escaped), name)
    return out
