"""Answer contexts: excerpts within a token budget, citations and the requests they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notequery.functions.text import tokens

#: Tokens that framing adds to an excerpt.
FRAMING = 8
#: The place in a prompt that excerpts take.
SLOT = "{{EXCERPTS}}"
PROMPT = f"Answer from the numbered excerpts alone and cite them as [1], [2]. Say so if they don't hold the answer.\n\n{SLOT}\n"
NO_ANSWER = "Nothing in the notes matches this question."


def cap_per_note(excerpts: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` excerpts of each note of a question, in order of rank; 0 keeps all."""
    if cap == 0:
        return excerpts
    order = F.row_number().over(Window.partitionBy("qid", "path").orderBy("rank"))
    return excerpts.withColumn("_n", order).filter(F.col("_n") <= cap).drop("_n")


def render(number: Column) -> Column:
    """An excerpt as the model reads it: a numbered header with what is known of its place, then its text."""
    line = lambda name, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name}: "), value, F.lit("\n"))).otherwise("")
    return F.concat(
        F.lit("=== EXCERPT "), number.cast("string"), F.lit(" ===\n"), F.lit("Note: "), F.col("title"), F.lit("\n"),
        line("Folder", F.col("folder")), line("Section", F.col("heading_path")), line("Modified", F.date_format("modified", "yyyy-MM-dd")),
        F.lit("\n"), F.trim("text"), F.lit("\n\n"),
    )


def budget(excerpts: DataFrame, limit: int) -> DataFrame:
    """Excerpts with ``number``, ``block``, ``cost``, ``kept`` and ``oversized``.

    The leading excerpts whose costs add up to the limit are kept, whole; if the first alone exceeds it, it is kept
    alone and marked.
    """
    order = Window.partitionBy("qid").orderBy("rank")
    rows = excerpts.withColumn("number", F.row_number().over(order))
    rows = rows.withColumn("block", render(F.col("number"))).withColumn("cost", tokens(F.col("block")) + FRAMING)
    upto = F.sum("cost").over(order)
    first = F.first("cost").over(order) > limit
    return rows.withColumn("kept", (F.col("number") == 1) | (~first & (upto <= limit))).withColumn("oversized", first & (F.col("number") == 1))


def contexts(excerpts: DataFrame, limit: int) -> DataFrame:
    """(qid, block, citations, dropped, tokens, oversized): one row for each question that has excerpts.

    Each excerpt costs its framing and a token at least, so only as many of the first ones as fit the limit at that
    price are brought together by question; of the others only the number is taken.
    """
    most = max(limit // (FRAMING + 1), 1)
    order = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    rows = budget(excerpts.withColumn("_n", order).filter(F.col("_n") <= most).drop("_n"), limit)
    cite = F.struct("number", "path", "title", "folder", "heading_path", "line_start", "line_end", "text")
    kept = F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("number", "block"))))
    found = rows.groupBy("qid").agg(
        F.array_join(F.transform(kept, lambda x: x["block"]), "").alias("block"),
        F.array_sort(F.collect_list(F.when(F.col("kept"), cite))).alias("citations"),
        F.count_if(F.col("kept")).alias("_kept"),
        F.sum(F.when(F.col("kept"), F.col("cost"))).alias("tokens"),
        F.max("oversized").alias("oversized"),
    )
    every = excerpts.groupBy(F.col("qid").alias("_q")).agg(F.count("*").alias("_n"))
    return found.join(every, F.col("qid").eqNullSafe(F.col("_q"))).select("qid", "block", "citations", (F.col("_n") - F.col("_kept")).alias("dropped"), "tokens", "oversized")


def requests(questions: DataFrame, found: DataFrame, model: str, prompt: str = PROMPT) -> tuple[DataFrame, DataFrame]:
    """Requests (request_id, model, messages, sources) for questions with a context, and answers (qid, text) for the others."""
    role = lambda name, text: F.struct(F.lit(name).alias("role"), text.alias("content"))
    system = F.replace(F.lit(prompt), F.lit(SLOT), F.col("block"))
    ready = questions.join(found, "qid").select(
        F.col("qid").alias("request_id"),
        F.lit(model).alias("model"),
        F.array(role("system", system), role("user", F.col("question"))).alias("messages"),
        F.array_sort(F.array_distinct(F.transform("citations", lambda c: c["path"]))).alias("sources"),
    )
    return ready, questions.join(found.select("qid"), "qid", "left_anti").select("qid", F.lit(NO_ANSWER).alias("text"))
