"""Whether answers rest on what they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What an answer says that declines, and the characters such an answer has at most.
REFUSALS = [
    "could not find", "couldn't find", "cannot find", "can't find", "do not contain", "don't contain", "does not contain", "doesn't contain",
    "no information", "not in your notes", "nothing in your notes",
]
LONGEST_REFUSAL = 400


def outside_code(text: Column) -> Column:
    """Text without fenced and inline code; an open fence takes the rest."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?(?:```|\z)", "\u0001"), r"`[^`\n]*`", "\u0001")


def markers(text: Column) -> Column:
    """Numbers cited as [n] or [n, m], once each, in order of their first mention."""
    found = F.regexp_extract_all(outside_code(text), F.lit(r"\[([ \t]*\d{1,9}[ \t]*(?:,[ \t]*(?:\d{1,9}[ \t]*)?)*)\]"), 1)
    numbers = F.flatten(F.transform(found, lambda x: F.filter(F.split(x, ","), lambda p: F.trim(p) != "")))
    return F.array_distinct(F.transform(numbers, lambda p: F.trim(p).cast("int")))


def declines(text: Column) -> Column:
    """Whether an answer says that it found nothing."""
    low = F.lower(F.trim(text))
    said = F.lit(False)
    for phrase in REFUSALS:
        said = said | F.contains(low, F.lit(phrase))
    return (low != "") & (F.char_length(low) <= LONGEST_REFUSAL) & said


def check(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """(request_id, used, unmatched, unused, uncited, declined) of answers (request_id, text) and citations (request_id, number)."""
    sent = citations.groupBy("request_id").agg(F.array_sort(F.collect_set("number")).alias("sent"))
    rows = answers.withColumn("cited", markers(F.col("text"))).join(sent, "request_id", "left")
    sent_ = F.coalesce("sent", F.array().cast("array<int>"))
    used = F.filter("cited", lambda n: F.array_contains(sent_, n))
    return rows.select(
        "request_id",
        used.alias("used"),
        F.array_except("cited", sent_).alias("unmatched"),
        F.array_except(sent_, F.col("cited")).alias("unused"),
        (F.size(used) == 0).alias("uncited"),
        ((F.size(used) == 0) & declines(F.col("text"))).alias("declined"),
    )


def sources(checked: DataFrame, citations: DataFrame) -> DataFrame:
    """(request_id, path, number): cited notes once, with the citation used first."""
    used = checked.select("request_id", F.posexplode("used").alias("_order", "number")).join(citations, ["request_id", "number"])
    first = F.row_number().over(Window.partitionBy("request_id", "path").orderBy("_order"))
    return used.withColumn("_n", first).filter("_n = 1").select("request_id", "path", "number")


def also_searched(checked: DataFrame, citations: DataFrame) -> DataFrame:
    """(request_id, path, number): notes that were sent and not cited, with their first citation."""
    rest = citations.join(sources(checked, citations).select("request_id", "path"), ["request_id", "path"], "left_anti")
    first = F.row_number().over(Window.partitionBy("request_id", "path").orderBy("number"))
    return rest.withColumn("_n", first).filter("_n = 1").select("request_id", "path", "number")
