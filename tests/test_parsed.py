"""Queries that look up no words read the notes and build no index; what they share grows with its input."""

from pyspark.sql import functions as F

from notequery.operators import context, index, segments
from notequery.plans import _tables, library, search
from notequery.sources import tables

SMALL = "/root/testdata/sf0.001"
LONG = "a text of more than forty characters that makes a passage"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_the_same_however_many_words_are_sorted_at_a_time(spark, monkeypatch):
    raw = spark.createDataFrame([(f"{i % 7}{i}.md", f"# Zebra {i}\n{LONG} straße w{i % 3} zebra w{i % 3}", None) for i in range(30)] + [("empty.md", None, None)], "path string, content string, modified timestamp")
    rows = lambda: sorted(map(str, index.build(raw).postings.collect()))
    whole = rows()
    monkeypatch.setattr(index, "WORDS", 8)
    monkeypatch.setattr(index, "ROWS", 3)
    assert rows() == whole and len(set(whole)) == len(whole) > 400


def test_no_posting_carries_the_words_of_its_document(spark):
    raw = spark.createDataFrame([("a.md", LONG, None)], "path string, content string, modified timestamp")
    assert plan(index.build(raw).postings).lstrip("*(1) ").startswith("MapInArrow")


def unbuilt(spark, monkeypatch, query):
    for kept in ("_built", "_read"):
        monkeypatch.setattr(_tables, kept, {})
    rows = sorted(map(str, query(spark, SMALL).collect()))
    assert not _tables._built
    _tables.indexed(spark, SMALL)
    assert rows == sorted(map(str, query(spark, SMALL).collect())) and rows


def test_texts_need_no_index(spark, monkeypatch):
    unbuilt(spark, monkeypatch, search.note_texts)


def test_passages_need_no_index(spark, monkeypatch):
    unbuilt(spark, monkeypatch, search.passage_rows)


def test_statistics_need_no_index_and_no_postings(spark, monkeypatch):
    unbuilt(spark, monkeypatch, search.statistics)
    assert "MapInArrow" not in plan(index.build(_tables.raw_notes(spark, SMALL)).doc_stats)


def test_posting_counts_need_no_stored_index(spark, monkeypatch):
    unbuilt(spark, monkeypatch, search.posting_rows)


def test_contexts_need_no_index(spark, monkeypatch):
    unbuilt(spark, monkeypatch, library.contexts)


def test_upkeep_copies_no_index_and_leaves_the_one_that_others_read(spark):
    before = sorted(map(str, _tables.indexed(spark, SMALL).passages.collect()))
    folder, first = _tables.index_folder(spark, SMALL), sorted(map(str, search.upkeep(spark, SMALL).collect()))
    assert not [n for n in tables.names(spark, tables.shared_dir(spark)) if n.startswith("kept-index")]
    assert segments.snapshot(spark, folder)["version"] > 1 and sorted(map(str, _tables.indexed(spark, SMALL).passages.collect())) == before
    assert sorted(map(str, search.upkeep(spark, SMALL).collect())) == first != before


def test_contexts_bring_together_only_what_may_fit(spark):
    rows = [(q, f"n{i:04}.md", "T", "f", "", 1, 2, LONG, None, i) for q in ("q", None) for i in range(500)] + [("big", "b.md", "T", "f", "", 1, 2, LONG * 50, None, 1)]
    excerpts = spark.createDataFrame(rows, "qid string, path string, title string, folder string, heading_path string, line_start int, line_end int, text string, modified timestamp, rank int")
    made = context.contexts(excerpts, 300)
    assert "WindowGroupLimit" in plan(made)
    every = context.budget(excerpts, 300).groupBy("qid").agg(F.count_if("kept").alias("k"), F.count_if(~F.col("kept")).alias("d"), F.sum(F.when(F.col("kept"), F.col("cost"))).alias("t"), F.max("oversized").alias("o"))
    assert sorted(map(str, made.select("qid", F.size("citations"), "dropped", "tokens", "oversized").toDF(*every.columns).collect())) == sorted(map(str, every.collect()))
