"""Stateful streams: replayed in batches of any cut they give what the operators over tables give."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from notequery.streaming import changes, completions, stateful

START = dt.datetime(2025, 1, 1)
LATER = START + dt.timedelta(days=1)


@pytest.fixture(autouse=True)
def rocks(spark):
    name, value = stateful.PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    yield
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def replay(spark, batches, schema, transform, folder):
    """What a stream of the batches gives, each batch a file."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k:03}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    query = transform(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").start()
    query.processAllAvailable()
    query.stop()
    return spark.read.parquet(f"{folder}/out")


def test_debounced_stream_equals_the_table(spark, tmp_path):
    rng = random.Random(3)
    events, at = [], dict.fromkeys("abc", 0)
    for _ in range(60):
        path = rng.choice("abc")
        at[path] += rng.choice([1, 120, 499, 500, 501, 900, 5000])
        events.append((path, rng.random() < 0.4, START + dt.timedelta(milliseconds=at[path])))
    shuffled = sorted(events, key=lambda e: e[2] + dt.timedelta(milliseconds=rng.randint(0, 3000)))
    batches = [shuffled[i : i + 15] for i in range(0, 60, 15)] + [[("end", False, LATER)]]
    schema = "path string, removed boolean, ts timestamp"
    got = replay(spark, batches, schema, lambda s: stateful.debounce(s, late="1 hour"), str(tmp_path))
    want = changes.debounce(spark.createDataFrame(events, schema))
    plain = lambda df: sorted((r["path"], r["removed"], r["ts"]) for r in df.collect())
    assert plain(got) == plain(want) and len(plain(got)) > 10


def test_frames_arrive_as_chunks_do(spark, tmp_path):
    log = 'data: {"model":"m1","choices":[{"delta":{"content":"Hé"}}]}\r\n\r\n: ping\n\ndata: {oops\n\ndata: {"choices":[{"delta":{"content":"llo"}}],\ndata:  "model":"m2"}\n\n\ndata:{"usage":{"prompt_tokens":7,"completion_tokens":2,"total_tokens":9}}\n\ndata: [DONE]'
    cuts = [(k, [log[:k], log[k:]]) for k in range(0, len(log) + 1, 3)] + [(1000, list(log))]
    rng, rows = random.Random(4), []
    for request, parts in cuts:
        rows += [(request, seq, part, START) for seq, part in enumerate(parts)]
    rng.shuffle(rows)
    third = len(rows) // 2
    schema = "request_id int, seq int, chunk string, ts timestamp"
    batches = [rows[:third], rows[third:], [(-1, 0, "data: x\n\n", LATER)]]
    got = replay(spark, batches, schema, stateful.frames, str(tmp_path)).filter("request_id >= 0")
    plain = lambda df: {r["request_id"]: tuple(r)[1:] for r in df.collect()}
    found = plain(completions.answers(got))
    assert found == plain(completions.reassemble(spark.createDataFrame(rows, schema)))
    assert set(found.values()) == {("Héllo", "m2", 7, 2, 9, True, 1)} and len(found) == len(cuts)
    assert got.filter(F.col("kind") == "data").count() == 3 * len(cuts)
