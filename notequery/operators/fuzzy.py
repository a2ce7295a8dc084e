"""Quick open: fuzzy ranking of notes by title and path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Points: a run of letters, the first letter, the start of a word, shortness at most, titles, paths, and recent notes.
RUN, START, WORD, SHORT, TITLE, PATH, RECENT, STEP = 12, 40, 25, 60, 1000, 300, 400, 20


def fuzzy(query: Column, text: Column) -> Column:
    """Points of a greedy subsequence match in any case; null where the letters don't follow each other in the text."""
    low = F.lower(text)
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("run"), F.lit(0).alias("points"), F.lit(True).alias("ok"))

    def step(s: Column, c: Column) -> Column:
        at = F.position(c, low, s["at"] + 1)
        run = F.when((at == s["at"] + 1) & (s["at"] > 0), s["run"] + 1).otherwise(1)
        before = F.substring(low, at - 1, F.lit(1))
        bonus = F.when(at == 1, START).when(F.regexp_like(before, F.lit(r"^[ /_-]$")), WORD).otherwise(0)
        return F.struct(at.alias("at"), run.alias("run"), (s["points"] + (run - 1) * RUN + bonus).alias("points"), (s["ok"] & (at > 0)).alias("ok"))

    chars = F.filter(F.split(F.lower(query), ""), lambda c: c != "")
    found = F.aggregate(chars, state, step)
    return F.when(found["ok"], found["points"] + F.greatest(F.lit(0), SHORT - F.char_length(text)))


def _letters(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), ""), lambda c: c != "")


def _rarest(queries: DataFrame, notes: DataFrame) -> DataFrame:
    """``queries`` that are not empty with ``pair``, the two letters of a query that fewest notes hold, in the order they are typed."""
    held = notes.select(F.explode(F.array_distinct(_letters(F.concat_ws(" ", "title", "path")))).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    typed = queries.filter("query <> ''").select("qid", F.posexplode(_letters(F.col("query"))).alias("i", "c")).join(held, "c", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "i", "c")))
    two = F.array_sort(F.transform(F.slice(order, 1, 2), lambda x: F.struct(x["i"], x["c"])))
    pairs = typed.groupBy("qid").agg(F.concat(F.get(two, F.lit(0))["c"], F.element_at(two, -1)["c"]).alias("pair"))
    return queries.join(pairs, "qid")


def quick_open(queries: DataFrame, notes: DataFrame, recent: DataFrame, limit: int = 50) -> DataFrame:
    """(qid, path, points, rank): the best notes of each query, ties by title; a title that matches beats any path.

    ``recent`` is (path, position) with the last opened at 0.  An empty query lists the recent notes.  Other queries
    (qid, query) meet only notes in whose title or path their two rarest letters stand in order, by an equi-join; the
    pairs of letters that queries want are bounded by the alphabet, whatever the queries.
    """
    known = notes.select("path", "title").join(recent, "path", "left")
    typed = queries.withColumn("query", F.trim("query"))
    wanted = _rarest(typed, notes)
    pairs = F.array(*[F.lit(r["pair"]) for r in wanted.select("pair").distinct().orderBy("pair").collect()]).cast("array<string>")

    def holds(text: str, pair: Column) -> Column:
        a, b = F.substring(pair, 1, 1), F.substring(pair, -1, 1)
        first, last = F.instr(F.col(text), a), F.char_length(text) + 1 - F.instr(F.reverse(text), b)
        return (first > 0) & (F.instr(F.reverse(text), b) > 0) & ((a == b) | (first < last))

    low = known.withColumns({"_t": F.lower("title"), "_p": F.lower("path")})
    met = low.withColumn("pair", F.explode(F.filter(pairs, lambda x: holds("_t", x) | holds("_p", x)))).drop("_t", "_p").join(wanted, "pair").drop("pair")
    rows = met.unionByName(known.filter("position is not null").join(typed.filter("query = ''"), F.lit(True)))
    bonus = F.when(F.col("position").isNotNull(), F.greatest(F.lit(0), RECENT - STEP * F.col("position"))).otherwise(0)
    title = fuzzy(F.col("query"), F.col("title")) + TITLE
    path = fuzzy(F.col("query"), F.col("path")) + PATH
    points = F.when(F.col("query") == "", bonus).otherwise(F.coalesce(title, path) + bonus)
    rows = rows.withColumn("points", points).filter("points is not null")
    order = Window.partitionBy("qid").orderBy(F.desc("points"), "title", "path")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("qid", "path", "points", "rank")
