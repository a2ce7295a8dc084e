"""Full-text retrieval: tables of queries against an index, ranked by BM25."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notequery.functions.text import snippet, words
from notequery.operators.exclusions import excluded
from notequery.operators.index import KEYS, Index, stems
from notequery.operators.query import clauses, question_terms
from notequery.sources.tables import stored

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: How much a word counts by where it stands.
WEIGHTS = {"heading_path": 2.0, "text": 1.0, "title": 10.0, "body": 1.0}
#: What a note found by its title and body alone gains over passages.
NOTE_BIAS, MOST_FETCHED = -1.0, 500
#: Parts in which a query's matches are ranked before they meet.
PARTS = 64
#: Up to so many words or prefixes of a batch are looked up by filters that skip files; more are joined.
LOOKED_UP = 200
QUERY = "qid long, text string, match_mode string, folder string, modified_after timestamp, limit int, per_note_cap int, apply_exclusions boolean"
Retriever = Callable[[DataFrame, Index], DataFrame]


def in_folder(folder: Column, scope: Column) -> Column:
    """Whether a folder is the scope or lies under it; a null scope holds all."""
    return scope.isNull() | (folder == scope) | F.startswith(folder, F.concat(scope, F.lit("/")))


def _looked_up(rows: DataFrame, column: str, wanted: DataFrame, prefix: bool = False) -> DataFrame:
    """Rows whose column is one of the wanted terms, or starts with one; all rows where there are more than ``LOOKED_UP``.

    The filter only spares reading what a join afterwards leaves out.
    """
    some = [r[0] for r in wanted.select("term").distinct().limit(LOOKED_UP + 1).collect()]
    if not some or len(some) > LOOKED_UP:
        return rows if some else rows.limit(0)
    return rows.filter(reduce(or_, [F.startswith(F.col(column), F.lit(t)) if prefix else F.col(column) == t for t in some]))


def opened(prefixes: DataFrame, index: Index) -> DataFrame:
    """``prefixes`` with, in place of ``term``, every word of the vocabulary that starts with it: words meet prefixes by each of their beginnings."""
    words_ = _looked_up(index.vocabulary().withColumnRenamed("term", "word"), "word", prefixes, prefix=True)
    most = F.lit(prefixes.agg(F.max(F.char_length("term"))).first()[0] or 0)
    starts = F.transform(F.sequence(F.lit(1), F.least(F.char_length("word"), most)), lambda i: F.substring(F.col("word"), F.lit(1), i))
    begun = words_.select("word", F.explode(starts).alias("start"))
    return prefixes.join(begun, F.col("term") == F.col("start")).drop("term", "start").withColumnRenamed("word", "term")


def matches(terms: DataFrame, index: Index) -> DataFrame:
    """(qid, clause, level, path, ordinal, tf) of every clause in every document.

    A clause of several tokens matches where they follow each other within one column, which the positions of a
    document's words tell within its row and which are only read for such clauses; the last token of a prefix clause stands for every word that starts with it.
    """
    tokens = terms.select("qid", "clause", "prefix", F.size("tokens").alias("m"), F.posexplode("tokens").alias("i", "term"))
    last = F.col("prefix") & (F.col("i") == F.col("m") - 1)
    if index.stemming:
        known = stems(tokens.select("term").distinct())
        tokens = tokens.join(known, "term").withColumn("term", F.when(last, F.col("term")).otherwise(F.col("stem"))).drop("stem")
    tokens = stored(tokens, "clauses")
    every, open_ = tokens.filter(~last).drop("prefix"), tokens.filter(last).drop("prefix")
    if open_.limit(1).count():
        every = stored(every.unionByName(opened(open_, index)), "clause-terms")
    weight = F.create_map(*[F.lit(v) for pair in WEIGHTS.items() for v in pair])[F.col("col")]
    found = every.join(_looked_up(index.postings, "term", every), "term")
    doc = ["qid", "clause", *KEYS]
    single = found.filter("m = 1").groupBy(*doc).agg(F.sum(F.col("n") * weight).alias("tf"))
    if not every.filter("m > 1").limit(1).count():
        return single
    placed = found.filter("m > 1").groupBy(*doc, "col", "m").agg(F.collect_list(F.struct("i", "positions")).alias("at"), F.countDistinct("i").alias("k")).filter("k = m")
    starts = lambda i: F.flatten(F.transform(F.filter("at", lambda x: x["i"] == i), lambda x: F.transform(x["positions"], lambda p: p - i)))
    both = F.aggregate(F.sequence(F.lit(1), F.col("m") - 1), F.array_distinct(starts(F.lit(0))), lambda s, i: F.array_intersect(s, starts(i)))
    whole = placed.withColumn("k", F.size(both)).filter("k > 0")
    return single.unionByName(whole.groupBy(*doc).agg(F.sum(F.col("k") * weight).alias("tf")))


def score(hits: DataFrame, terms: DataFrame, index: Index) -> DataFrame:
    """(qid, level, path, ordinal, rank) of documents that satisfy a query; the best rank is the least.

    Rank is minus the BM25 score of the positive clauses.  Mode 'all' wants each of them, 'any' one; a document with
    a negated clause is out.
    """
    size = index.doc_stats.groupBy("level").agg(F.count("*").alias("n_docs"), F.avg("n_tokens").alias("average"))
    wanted = terms.filter(~F.col("negated"))
    positive = hits.join(wanted.select("qid", "clause"), ["qid", "clause"])
    # Small tables are stored, so that Spark knows their sizes and doesn't move the matches to join them.
    df = stored(positive.groupBy("qid", "clause", "level").agg(F.count("*").alias("df")), "frequencies")
    rows = positive.join(df, ["qid", "clause", "level"]).join(F.broadcast(size), "level").join(index.doc_stats, KEYS)
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_tokens") / F.col("average")))
    scored = rows.groupBy("qid", *KEYS).agg(F.round(-F.sum(part), 6).alias("rank"), F.count("*").alias("n"))
    need = stored(wanted.groupBy("qid", "match_mode").agg(F.countDistinct("clause").alias("need")), "needed")
    scored = scored.join(need, "qid").filter((F.col("match_mode") == "any") | (F.col("n") == F.col("need")))
    if not terms.filter("negated").limit(1).count():
        return scored.select("qid", *KEYS, "rank")
    banned = hits.join(terms.filter("negated").select("qid", "clause"), ["qid", "clause"]).select("qid", *KEYS).distinct()
    return scored.join(banned, ["qid", *KEYS], "left_anti").select("qid", *KEYS, "rank")


def retrieve(queries: DataFrame, index: Index, rules: list[str] | None = None) -> DataFrame:
    """(qid, path, title, folder, heading_path, line_start, line_end, text, score, rank) of the best passages of each query.

    Notes whose title and body match though none of their passages does come with their first passage.  Excluded
    notes go before any ranking where the query asks for it.  Per index the best max(limit, min(limit * cap * 2,
    500)) rows are fetched, normalised to 0..1, capped for each note and cut at the limit.
    """
    terms = clauses(queries).join(queries.select("qid", "match_mode"), "qid")
    notes = index.notes.select("path", "title", "folder", "modified", "ai_excluded")
    hits = stored(matches(terms, index), "hits")
    allowed = queries.select("qid", F.col("folder").alias("scope"), "modified_after", "limit", "per_note_cap", "apply_exclusions")
    scored = score(hits, terms, index).join(notes, "path").join(allowed, "qid")
    scored = scored.filter(in_folder(F.col("folder"), F.col("scope")))
    scored = scored.filter(F.col("modified_after").isNull() | (F.col("modified") >= F.col("modified_after")))
    scored = scored.filter(~F.col("apply_exclusions") | ~(F.col("ai_excluded") | excluded(F.col("path"), rules or [])))
    fetch = F.greatest(F.col("limit"), F.least(F.col("limit") * F.col("per_note_cap") * 2, F.lit(MOST_FETCHED)))
    # A frequent word's matches are cut within parts of each query first, against the greatest number that any query fetches.
    most = queries.agg(F.max(F.greatest(F.col("limit"), F.least(F.col("limit") * F.col("per_note_cap") * 2, F.lit(MOST_FETCHED))))).first()[0] or 0
    part = F.row_number().over(Window.partitionBy("qid", "level", "_part").orderBy("rank", "path", "ordinal"))
    scored = scored.withColumn("_part", F.pmod(F.xxhash64("path"), F.lit(PARTS))).withColumn("_n", part).filter(F.col("_n") <= most).drop("_part", "_n")
    best = F.row_number().over(Window.partitionBy("qid", "level").orderBy("rank", "path", "ordinal"))
    fetched = stored(scored.withColumn("_n", best).filter(F.col("_n") <= fetch), "fetched")
    inside = fetched.filter("level = 'passage'")
    outside = fetched.filter("level = 'note'").join(inside.select("qid", "path").distinct(), ["qid", "path"], "left_anti")
    outside = outside.withColumn("ordinal", F.lit(0)).withColumn("rank", F.col("rank") + NOTE_BIAS)
    rows = inside.unionByName(outside)
    all_ = Window.partitionBy("qid")
    span = F.max("rank").over(all_) - F.min("rank").over(all_)
    rows = rows.withColumn("score", F.when(span < 1e-9, 1.0).otherwise((F.max("rank").over(all_) - F.col("rank")) / span))
    order = ["rank", "path", "ordinal"]
    rows = rows.withColumn("_c", F.row_number().over(Window.partitionBy("qid", "path").orderBy(*order))).filter(F.col("_c") <= F.col("per_note_cap"))
    rows = rows.withColumn("_r", F.row_number().over(all_.orderBy(*order))).filter(F.col("_r") <= F.col("limit"))
    found = rows.join(index.passages, ["path", "ordinal"], "left")
    return found.select(
        "qid", "path", "title", "folder",
        F.coalesce("heading_path", F.lit("")).alias("heading_path"),
        F.coalesce("line_start", F.lit(1)).alias("line_start"),
        F.coalesce("line_end", F.lit(1)).alias("line_end"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.round("score", 6).alias("score"),
        F.col("_r").alias("rank"),
    )


def withheld(queries: DataFrame, index: Index, rules: list[str] | None = None) -> DataFrame:
    """(qid, withheld): distinct notes that a query matches in either index and that exclusions keep back."""
    terms = clauses(queries).join(queries.select("qid", "match_mode"), "qid")
    found = score(stored(matches(terms, index), "hits"), terms, index).select("qid", "path").distinct()
    notes = index.notes.select("path", "folder", "modified", "ai_excluded")
    rows = found.join(notes, "path").join(queries.select("qid", F.col("folder").alias("scope"), "modified_after"), "qid")
    rows = rows.filter(in_folder(F.col("folder"), F.col("scope")) & (F.col("modified_after").isNull() | (F.col("modified") >= F.col("modified_after"))))
    kept = rows.filter(F.col("ai_excluded") | excluded(F.col("path"), rules or [])).groupBy("qid").agg(F.countDistinct("path").alias("withheld"))
    return queries.select("qid").join(kept, "qid", "left").select("qid", F.coalesce("withheld", F.lit(0)).alias("withheld"))


def search(queries: DataFrame, index: Index, limit: int = 50) -> DataFrame:
    """Keyword search of (qid, text): every word, one passage a note, with a snippet and the note's time."""
    full = queries.select(
        "qid", "text", F.lit("all").alias("match_mode"), F.lit(None).cast("string").alias("folder"), F.lit(None).cast("timestamp").alias("modified_after"),
        F.lit(limit).alias("limit"), F.lit(1).alias("per_note_cap"), F.lit(False).alias("apply_exclusions"),
    )
    hits = retrieve(full, index).withColumnRenamed("text", "passage")
    terms = words(F.regexp_replace("text", r'-"[^"]*"?|-\S+', " "))
    rows = hits.join(queries.select("qid", terms.alias("terms")), "qid").join(index.notes.select("path", "modified"), "path", "left")
    return rows.withColumn("snippet", snippet(F.col("passage"), F.col("terms"))).drop("passage", "terms")


def ask(questions: DataFrame, index: Index, rules: list[str] | None = None, limit: int = 12, cap: int = 3) -> DataFrame:
    """Passages for (qid, question): any term, at most ``cap`` a note, excluded notes left out."""
    full = questions.select(
        "qid", F.array_join(question_terms(F.col("question")), " ").alias("text"), F.lit("any").alias("match_mode"), F.lit(None).cast("string").alias("folder"),
        F.lit(None).cast("timestamp").alias("modified_after"), F.lit(limit).alias("limit"), F.lit(cap).alias("per_note_cap"), F.lit(True).alias("apply_exclusions"),
    )
    return retrieve(full, index, rules)
