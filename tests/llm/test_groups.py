"""Groups of texts, vectors and words against plain loops: SimHash classes, centroids and spelling variants."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from notequery.llm import lloyd, queries, simhash, spelling

FOLDER = "/root/testdata/sf0.001"


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [words] if 0 < len(words) < size else [words[i : i + size] for i in range(len(words) - size + 1)]
    own = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))


def plain_classes(items, linked):
    """Least key of each item's component; items are (key, value)."""
    least = list(range(len(items)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i][1], items[j][1]):
                a, b = root(i), root(j)
                least[max(a, b)] = min(a, b)
    keys = {}
    for i, (k, _) in enumerate(items):
        keys.setdefault(root(i), []).append(k)
    return [min((k for k in keys[root(i)] if k is not None), default=None) for i in range(len(items))]


def check_simhash(docs, found):
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    classes = plain_classes(prints, lambda x, y: (x ^ y).bit_count() <= 2)
    assert rows(found, "doc_id", "fingerprint", "component_id") == sorted(((k, f"{p:016x}", c) for (k, p), c in zip(prints, classes, strict=True)), key=str)


def test_simhash_over_documents(spark):
    check_simhash(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text"), queries.QUERIES["op11_simhash_anchors"](spark, FOLDER))


def test_simhash_takes_odd_rows(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 50)
    check_simhash(odd, simhash.cluster(odd))
    named = odd.withColumn("fingerprint", F.lit(1)).withColumn("component_id", F.lit(2)).withColumn("node", F.lit(3)).withColumn("a.b", F.lit(4))
    out = simhash.cluster(named)
    assert out.columns == [c for c in named.columns if c not in ("text", "fingerprint", "component_id")] + ["fingerprint", "component_id"]
    check_simhash(odd, out)
    assert simhash.cluster(empty).count() == 0


def test_anchors_bring_all_near_words_together():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    at, found = simhash.anchors(words)
    assert np.bitwise_count(words[at] ^ found).max() == 2 and np.bincount(at).max() == 33
    own = [set(found[at == i].tolist()) for i in range(len(words))]
    for i, w in enumerate(words[:40].tolist()):
        for flips in [(rng.integers(64),) for _ in range(5)] + [tuple(rng.choice(64, 2, replace=False)) for _ in range(20)]:
            other = np.array([w ^ sum(1 << int(f) for f in flips)], dtype=np.uint64)
            assert own[i] & set(simhash.anchors(other)[1].tolist())


def test_chains_of_fingerprints_are_one_component(spark):
    rng, base = random.Random(1), random.Random(2).getrandbits(64)
    chain = [base]
    for _ in range(60):
        chain.append(chain[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    some = chain + [rng.getrandbits(64) for _ in range(60)] + [base ^ (1 << i) for i in range(64)]
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in some], "fp long").distinct()
    edges = [(np.int64(r["a"]).view(np.uint64), np.int64(r["b"]).view(np.uint64)) for r in simhash.links(df).collect()]
    assert all(int(a ^ b).bit_count() <= 64 for a, b in edges)
    joined = {x: x for x in some}

    def root(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for a, b in edges:
        joined[root(int(a))] = root(int(b))
    want = plain_classes(list(enumerate(some)), lambda x, y: (x ^ y).bit_count() <= 2)
    groups = {}
    for x, c in zip(some, want, strict=True):
        groups.setdefault(c, set()).add(root(x))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def plain_lloyd(items, k, rounds):
    """Clusters and distances of (key, vector) by plain loops."""
    kept = [(key, [math.floor(256 * x) for x in v]) for key, v in items if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for i in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == i]
            if mine:
                centres[i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [near(v) for _, v in kept]
    sums = Counter()
    for d, c in last:
        sums[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(key, c, d, sums[c], sum(sums.values()), digest[c]) for (key, _), (d, c) in zip(kept, last, strict=True)]


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def test_centroids_equal_plain_loops_and_sql(spark):
    found = rows(queries.QUERIES["op12_dimension_sharded_lloyd"](spark, FOLDER), *COLUMNS)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    assert found == sorted(db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.CENTROIDS_SQL})").fetchall(), key=str)
    items = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    assert found == sorted(plain_lloyd(items, 40, 5), key=str)


@pytest.mark.parametrize(("width", "cut"), [(16, 1024), (5, 3), (64, 7)])
def test_centroids_take_odd_vectors(spark, width, cut):
    rng = random.Random(4)
    some = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(30)]
    items = [(i, v) for i, v in enumerate(some)] + [(3, some[3]), (3, some[4]), (None, some[5])]
    items += [(100, None), (101, []), (102, some[0][:63]), (103, [*some[0][:63], None]), (104, [*some[0][:63], math.nan]), (105, [*some[0][:63], math.inf]), (106, [0.0] * 64), (107, [-1e3] * 64)]
    df = spark.createDataFrame([(k, v, 9, 8, 7) for k, v in items], "vec_id long, embedding array<double>, cluster int, slice int, `a.b` int")
    out = lloyd.cluster(df, k=5, rounds=3, width=width, slice_rows=cut)
    assert out.columns == ["vec_id", "embedding", "slice", "a.b", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert rows(out, *COLUMNS) == sorted(plain_lloyd(items, 5, 3), key=str)
    assert rows(lloyd.cluster(df.limit(0)), *COLUMNS) == []
    few = df.filter("vec_id < 3")
    assert rows(lloyd.cluster(few, k=5, rounds=2), *COLUMNS) == sorted(plain_lloyd([i for i in items if i[0] is not None and i[0] < 3], 5, 2), key=str)
    far = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)], "vec_id long, embedding array<double>")
    assert sorted(r["distance"] for r in lloyd.cluster(far).collect()) == [0, 0]


def plain_words(docs, drop=31):
    total = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if key is None else key}:{word}".encode())
            if drop and h % drop == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def plain_variants(words):
    def edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    near = {w: [v for n in (len(w) - 1, len(w), len(w) + 1) for v in by.get(n, []) if edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


SPELLED = ("word", "form", "root", "n", "n_near", "form_n")


def test_spellings_over_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert rows(queries.QUERIES["op13_spelling_variants"](spark, FOLDER), *SPELLED) == plain_variants(plain_words(docs))


@pytest.mark.parametrize("part", [2048, 4])
def test_spellings_by_parts(spark, part, monkeypatch):
    rng = random.Random(6)
    base = ["aaaaaaa", "abcdefg", "abcdefgh", "Àbcdefg", "straße÷", "zzzzzzzzzz", "two-words here", "x" * 3000]
    words = {}
    for w in base:
        words[w.lower() if w.isascii() else w] = 5000
        for _ in range(25):
            i = rng.randrange(len(w) + 1)
            for v in (w[:i] + rng.choice("abcxéÿ") + w[i:], w[:i] + w[i + 1 :], w[: max(0, i - 1)] + rng.choice("abcxÀ") + w[i:]):
                if len(v) >= 7:
                    words[v] = words.get(v, rng.choice([2, 3, 40, 500]))
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows(spelling.variants(df, part=part), *SPELLED) == plain_variants(words)


def test_spellings_take_odd_rows(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 40)
    more = odd.unionByName(spark.createDataFrame([(50, "Receive the recieve RECEIVE receiveÉ " * 40, "x", None, 3, 1, "y")], odd.schema)).withColumn("word", F.lit(1)).withColumn("n", F.lit(2))
    items = [(r["doc_id"], r["text"]) for r in more.collect()]
    for drop in (31, None):
        assert rows(spelling.vocabulary(more, drop=drop), "word", "n") == sorted(plain_words(items, drop).items(), key=str)
    assert rows(spelling.variants(spelling.vocabulary(more)), *SPELLED) == plain_variants(plain_words(items, None))
    assert spelling.variants(spelling.vocabulary(empty)).count() == 0
