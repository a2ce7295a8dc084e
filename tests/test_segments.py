"""The stored index: deletes that take effect, versions that readers keep, merges, and writes of the size of a change."""

import pytest
from pyspark.sql import functions as F

from notequery.operators import index, maintain, retrieve, segments
from notequery.streaming import changes

LONG = "a text of more than forty characters that makes a passage"
RAW = "path string, content string, modified timestamp"


def raw(spark, rows):
    return spark.createDataFrame([(p, c, None) for p, c in rows], RAW)


def found(spark, folder, text, version=None):
    ask = spark.createDataFrame([(1, text)], "qid long, text string")
    return sorted(r["path"] for r in retrieve.search(ask, segments.load(spark, folder, version)).collect())


def paths(spark, *names):
    return spark.createDataFrame([(p,) for p in names], "path string")


def same(got, want):
    for name in index.TABLES:
        a, b = getattr(got, name), getattr(want, name)
        assert sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect())), name


def test_the_only_note_can_be_deleted(spark, tmp_path):
    folder = str(tmp_path)
    segments.rebuild(raw(spark, [("a.md", f"# Plan\n{LONG} zebra")]), folder)
    assert found(spark, folder, "zebra") == ["a.md"]
    segments.update(spark, folder, paths(spark, "a.md"), index.parse_notes(raw(spark, [("x", "")]).limit(0)))
    assert found(spark, folder, "zebra") == [] and found(spark, folder, "ze*") == [] and found(spark, folder, "plan") == []
    now = segments.load(spark, folder)
    assert [getattr(now, t).count() for t in index.TABLES] == [0, 0, 0, 0]
    assert found(spark, folder, "zebra", version=1) == ["a.md"]


def test_updates_equal_a_new_index(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    held = {f"f/{i}.md": f"# N{i}\n{LONG} word{i}" for i in range(12)}
    segments.rebuild(raw(spark, held.items()), folder)
    reader = segments.load(spark, folder)
    before = sorted(map(str, reader.postings.collect()))
    steps = [({"f/1.md": "# New\n" + LONG}, ["f/2.md"]), ({"g/x.md": LONG + " fresh"}, []), ({}, ["f/1.md", "nowhere.md"]), ({"f/2.md": LONG + " back"}, []), ({"f/3.md": LONG + " once more"}, ["f/4.md"])]
    for put, gone in steps:
        held = {p: c for p, c in held.items() if p not in gone} | put
        new = index.parse_notes(raw(spark, list(put.items()) or [("x", "")]).limit(len(put)))
        segments.update(spark, folder, paths(spark, *gone) if gone else paths(spark, "x").limit(0), new)
        same(segments.load(spark, folder), index.build(raw(spark, held.items())))
    assert sorted(map(str, reader.postings.collect())) == before
    kinds = [(r["kind"], r["segments"]) for r in segments.history(spark, folder).orderBy("version").collect()]
    assert kinds[0] == ("rebuild", 1) and "merge" in dict(kinds) and max(n for _, n in kinds) <= segments.MANY + 1
    segments.merge(spark, folder)
    same(segments.load(spark, folder), index.build(raw(spark, held.items())))
    assert len(segments.snapshot(spark, folder)["segments"]) == 1
    assert segments.vacuum(spark, folder, keep=1) >= 2
    same(segments.load(spark, folder), index.build(raw(spark, held.items())))


def test_an_update_writes_what_changed(spark, tmp_path):
    folder = str(tmp_path)
    segments.rebuild(raw(spark, [(f"f/{i}.md", f"# N{i}\n" + " ".join(f"w{i}x{j} {LONG}" for j in range(40))) for i in range(200)]), folder)
    size = lambda: {str(p): p.stat().st_size for p in tmp_path.rglob("*.parquet")}
    old = size()
    segments.update(spark, folder, paths(spark, "f/7.md"), index.parse_notes(raw(spark, [("f/8.md", LONG)])))
    new = size()
    assert all(new[p] == n for p, n in old.items())
    assert sum(n for p, n in new.items() if p not in old) < 0.25 * sum(old.values())
    assert segments.update(spark, folder, paths(spark, "x").limit(0), index.parse_notes(raw(spark, [("x", "")]).limit(0))) == 2


def test_two_writers_cannot_write_one_version(spark, tmp_path):
    folder = str(tmp_path)
    segments.rebuild(raw(spark, [("a.md", LONG)]), folder)
    before = segments.snapshot(spark, folder)
    segments._publish(spark, folder, before, before["segments"], "update", False, 0)
    with pytest.raises(segments.Conflict):
        segments._publish(spark, folder, before, [], "update", False, 0)
    assert len(segments.snapshot(spark, folder)["segments"]) == 1 and not [p for p in (tmp_path / "snapshots").iterdir() if "crc" not in p.name and not p.name.endswith(".json")]


def test_due_merges_small_segments_and_leaves_large_ones():
    one = lambda n, dead=0: {"notes": n, "tombstones": dead}
    assert segments.due([one(1000)]) == 0 and segments.due([one(1000), one(5), one(5), one(5)]) == 0
    assert segments.due([one(1000), one(5), one(5), one(5), one(5)]) == 4
    assert segments.due([one(100), one(0, 80)]) == 2
    sizes = [one(100_000)]
    for _ in range(300):
        sizes.append(one(10, 10))
        run = segments.due(sizes)
        if run:
            sizes = [*sizes[:-run], one(sum(s["notes"] for s in sizes[-run:]), sum(s["tombstones"] for s in sizes[-run:]))]
    assert len(sizes) < 12


def test_a_stream_of_changes_deletes(spark, tmp_path):
    folder, feed = str(tmp_path / "index"), str(tmp_path / "feed")
    segments.rebuild(raw(spark, [("a.md", f"{LONG} zebra"), ("b.md", f"{LONG} lion")]), folder)
    rows = spark.createDataFrame([("a.md", True, "2025-01-01"), ("b.md", False, "2025-01-01"), ("b.md", False, "2025-01-02")], "path string, removed boolean, ts string")
    rows.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(feed)
    stream = spark.readStream.schema("path string, removed boolean, ts timestamp").parquet(feed)
    query = changes.follow(stream, folder, lambda: index.parse_notes(raw(spark, [("b.md", f"{LONG} tiger")])), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    assert found(spark, folder, "zebra") == [] and found(spark, folder, "lion") == [] and found(spark, folder, "tiger") == ["b.md"]


def test_more_words_than_are_looked_up_one_by_one(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    segments.rebuild(raw(spark, [(f"{i}.md", f"{LONG} part{i} of the whole {i} of the") for i in range(8)]), folder)
    want = {q: found(spark, folder, q) for q in ("par*", '"of the"', '"of the whole"', "the-who*", '"the of"', "part3 -whole", "part3")}
    assert len(want["par*"]) == 8 == len(want['"of the whole"']) == len(want["the-who*"])
    assert want["part3"] == ["3.md"] and want['"the of"'] == []
    monkeypatch.setattr(retrieve, "LOOKED_UP", 0)
    assert {q: found(spark, folder, q) for q in want} == want


def test_renames_and_removals_of_frames(spark):
    held = index.build(raw(spark, [("a.md", LONG), ("b.md", f"{LONG} lion")]))
    moved = maintain.rename(held, spark.createDataFrame([("a.md", "c.md")], "path string, new_path string"), index.parse_notes(raw(spark, [("c.md", LONG)])))
    same(moved, index.build(raw(spark, [("c.md", LONG), ("b.md", f"{LONG} lion")])))
