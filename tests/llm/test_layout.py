import random

import pytest
from pyspark.sql import functions as F

from notequery.llm import mix, ring, warc


def place(shards, total, n, vnodes=64):
    """Rows one by one: each takes its arc's shard or goes on clockwise to the next with room."""
    counts = {}
    rng = random.Random(total)
    for _ in range(total):
        p = rng.randrange(ring.BINS)
        counts[p] = counts.get(p, 0) + 1
    return counts


@pytest.mark.parametrize(("total", "n", "slack"), [(0, 4, 0.0), (1, 4, 0.0), (1003, 16, 0.0), (5000, 7, 0.1)])
def test_ring_fills_every_shard_to_its_bound(total, n, slack):
    counts = place(n, total, n)
    spans = ring.fill(counts, n, 64, slack)
    size = [0] * n
    seen = {}
    for point, shard, first, last, slot in sorted(spans, key=lambda s: (s[1], s[4])):
        assert slot == size[shard]
        size[shard] += last - first
        seen.setdefault(point, []).append((first, last))
    assert sum(size) == total and all(a <= b for a, b in zip(size, ring.bounds(total, n, slack), strict=True))
    for point, parts in seen.items():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] == counts[point] and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    if not slack and total:
        assert max(size) - min(size) <= 1


def test_ring_moves_little_when_it_grows():
    counts = place(10, 20000, 10)
    owner = lambda n: {(p, r): s for p, s, a, b, _ in ring.fill(counts, n, 64, 0.25) for r in range(a, b)}
    old, new = owner(10), owner(11)
    assert sum(old[k] != new[k] for k in old) < 0.35 * len(old)


def test_ring_on_rows(spark, odd, empty):
    docs = spark.range(1000).withColumnRenamed("id", "doc_id")
    rows = ring.assign(docs, [F.col("doc_id")], 16).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {len(v) for v in by.values()} == {62, 63}
    assert sorted((r["doc_id"], r["shard"]) for r in rows) == sorted((r["doc_id"], r["shard"]) for r in ring.assign(docs.repartition(7), [F.col("doc_id")], 16).collect())
    assert ring.assign(odd, [F.col("doc_id"), F.col("text")], 3).count() == odd.count()
    assert ring.assign(empty, [F.col("doc_id")], 3).count() == 0
    with pytest.raises(ValueError):
        ring.assign(odd, [F.col("doc_id")], 0)


def water(sizes, weights, share, cap):
    """Targets by sharing anew what is cut off until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= full
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets_and_draws(spark, seed):
    rng = random.Random(seed)
    names = rng.sample(["a", "b", "B", "é", "zz", "c", None], k=rng.randint(1, 7))
    rows = [(i, rng.choice(names), rng.randint(0, 50)) for i in range(400)]
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = water(sizes, [3, 1, 2], 1.5, 2.0)
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    draw = lambda d: mix.draw(d, "source", F.col("n"), [F.col("doc_id"), F.col("n")], [3, 1, 2], 1.5, 2.0).collect()
    found = draw(df)
    taken = {}
    for r in found:
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] <= 2 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 25 for s in sizes)
    key = lambda rows_: sorted((r["doc_id"], r["taken"]) for r in rows_)
    assert key(found) == key(draw(df.repartition(5)))


def test_draws_odd(odd, empty):
    size = F.coalesce(F.length("text"), F.lit(0))
    rows = mix.draw(odd, "source", size, [F.col("doc_id"), size], [3, 1, 2], 1.5, 2.0).collect()
    assert len(rows) == odd.count() and all(r["taken"] == 0 for r in rows if not r["text"])
    assert mix.draw(empty, "source", size, [F.col("doc_id"), size], [3, 1, 2], 1.5, 2.0).count() == 0


def test_long_documents_are_likelier(spark):
    rows = [(i, "s", 10 if i % 2 else 1000) for i in range(4000)]
    found = mix.draw(spark.createDataFrame(rows, "doc_id long, source string, n long"), "source", F.col("n"), [F.col("doc_id")], [1], 0.5, 2.0).collect()
    share = lambda n: sum(r["copies"] for r in found if r["size"] == n) / 2000
    assert share(1000) > share(10) + 0.05


def test_archives_round_trip(spark):
    rng = random.Random(8)
    pages = [(i, f"http://h/{i}", "".join(rng.choices("ab é\r\n", k=rng.randint(0, 3000)))) for i in range(300)]
    pages += [(900, "http://h/900", pages[5][2] + "y" * 1000), (901, None, pages[5][2] + "y" * 1000), (902, "u", None), (903, "u", "")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    from notequery.llm import _store

    index = warc.write(warc.records(frame, F.col("page_id"), F.col("url"), F.col("html")), _store.fresh(spark, "warc"))
    found = {r["record_id"]: r for r in warc.read(spark, index).collect()}
    assert len(found) == len(pages) and index.count() == len(pages)
    for i, url, html in pages:
        r = found[f"urn:page:{i}"]
        body = (html or "").encode()
        assert r["payload_bytes"] == len(body) and r["target_uri"] == (url or "")
        if i == 900:
            assert (r["record_type"], r["refers_to"]) == ("revisit", "urn:page:901")
        else:
            assert r["record_type"] == "response" and bytes(r["payload"]) == body
    some = index.filter(F.col("record_id").isin("urn:page:7", "urn:page:901"))
    assert {r["record_id"]: bytes(r["payload"]) for r in warc.fetch(some).collect()} == {k: bytes(found[k]["payload"]) for k in ("urn:page:7", "urn:page:901")}


def test_targets_with_line_ends_stay_in_their_header(spark):
    from notequery.llm import _store

    urls = ["http://a/\r\nWARC-Type: forged", "http://a/\n\nrest", "\r\n\r\n", " lead", "trail ", "tab\there", "100%25 %0A", "%", "http://é/日本\u2028x", "x: y", "", None, "\x00\x7f\x85", "u" * 100_000]
    pages = [(i, u, f"{i} " + "z" * (2000 if i % 2 else 10)) for i, u in enumerate(urls)] + [(50, "odd\r\nlast", "1 " + "z" * 2000), (51, None, None), (52, "big", "é\r\n\r\n" * 300_000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    index = warc.write(warc.records(frame, F.concat("page_id", F.lit("\r\nX: "), "page_id"), F.col("url"), F.col("html")), _store.fresh(spark, "warc"))
    for out in (warc.read(spark, index), warc.fetch(index)):
        found = {r["record_id"]: r for r in out.collect()}
        assert len(found) == len(pages)
        for i, url, html in pages:
            r = found[f"urn:page:{i}\r\nX: {i}"]
            assert r["target_uri"] == (url or "") and r["payload_bytes"] == len((html or "").encode())
            assert (r["record_type"], r["refers_to"]) == (("revisit", "urn:page:50\r\nX: 50") if i == 1 else ("response", None))
            assert i == 1 or bytes(r["payload"]) == (html or "").encode()


def test_archives_odd(spark):
    rows = [(None, None, None), (None, "u", "z" * 1200), (1, "u", "z" * 1200), (1, "u", "z" * 1200)]
    out = warc.records(spark.createDataFrame(rows, "page_id long, url string, html string"), F.col("page_id"), F.col("url"), F.col("html")).collect()
    assert sorted(r["record_type"] for r in out) == ["response", "response", "response", "revisit"]
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    from notequery.llm import _store

    index = warc.write(warc.records(empty, F.col("page_id"), F.col("url"), F.col("html")), _store.fresh(spark, "warc"))
    assert warc.read(spark, index).count() == 0
