"""Completions that arrive as chunks of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")
_FRAME = "struct<model: string, choices: array<struct<delta: struct<content: string>>>, usage: struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint>>"


def read(frames: DataFrame) -> DataFrame:
    """(request_id, i, kind, text, model, prompt_tokens, completion_tokens, total_tokens) of frames (request_id, i, frame).

    Kind is data, done, bad for what can't be read, or empty for comments and blank frames.  Tables and streams alike.
    """
    lines = F.filter(F.split("frame", r"\r?\n"), lambda x: F.startswith(x, F.lit("data:")))
    data = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^data: ?", "")), "\n")
    rows = frames.select("request_id", "i", data.alias("data"))
    sent = ~F.col("data").isin("", "[DONE]")
    good = F.when(sent, F.try_parse_json("data")).isNotNull()
    kind = F.when(F.col("data") == "", "empty").when(F.col("data") == "[DONE]", "done").when(good, "data").otherwise("bad")
    rows = rows.select("request_id", "i", kind.alias("kind"), F.from_json("data", _FRAME).alias("f"))
    text = F.array_join(F.transform(F.coalesce(F.col("f.choices"), F.array()), lambda c: F.coalesce(c["delta"]["content"], F.lit(""))), "")
    own = lambda c: F.when(F.col("kind") == "data", c)
    return rows.select("request_id", "i", "kind", own(text).alias("text"), own(F.col("f.model")).alias("model"), *[own(F.col(f"f.usage.{c}")).alias(c) for c in USAGE])


def answers(read_: DataFrame) -> DataFrame:
    """(request_id, text, model, prompt_tokens, completion_tokens, total_tokens, finished, bad_frames) of frames as ``read`` has them; the last model and usage hold."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("i"))).alias(c)
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "data", F.struct("i", F.col("text").alias("t"))))), lambda x: x["t"])
    return read_.groupBy("request_id").agg(F.array_join(ordered, "").alias("text"), *map(last, ("model", *USAGE)), F.max(F.col("kind") == "done").alias("finished"), F.count_if(F.col("kind") == "bad").alias("bad_frames"))


def reassemble(chunks: DataFrame) -> DataFrame:
    """The answers of a log (request_id, seq, chunk), as ``answers`` has them.

    Frames end at blank lines, whatever the cuts between chunks; comments don't count, [DONE] finishes, and a frame that
    can't be read is counted.  A request's chunks are one answer, so they meet.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"])
    whole = chunks.groupBy("request_id").agg(F.array_join(parts, "").alias("log"))
    return answers(read(whole.select("request_id", F.posexplode(F.split("log", r"\r?\n\r?\n")).alias("i", "frame"))))
