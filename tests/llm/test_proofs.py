"""Operators that SQL can't express against plain loops: the ring, mixtures, fingerprints, the chain; and inputs out of the ordinary."""

import hashlib
import itertools
import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from notequery.llm import _text as t
from notequery.llm import components, decontaminate, imatch, language, minhash, mix, phrases, ring, simhash, suffixes, toxicity


def row_by_row(keys, n, vnodes=64):
    """Each row, in order of its bin and digest, goes to its arc's shard or, if that is full, clockwise to the next with room."""
    arcs = {}
    for shard, v in itertools.product(range(n), range(vnodes)):
        arcs.setdefault(int(hashlib.md5(f"shard-{shard}-vnode-{v}".encode()).hexdigest()[:4], 16), shard)
    starts = sorted(arcs)
    digests = sorted(hashlib.md5(k.encode()).hexdigest() for k in keys)
    room = [len(keys) // n + (s < len(keys) % n) for s in range(n)]
    placed, late = {}, []
    for d in digests:  # rows that find room at home settle first
        home = max((i for i, p in enumerate(starts) if p <= int(d[:4], 16)), default=len(starts) - 1)
        if room[arcs[starts[home]]]:
            room[arcs[starts[home]]] -= 1
            placed[d] = arcs[starts[home]]
        else:
            late.append((d, home))
    for d, home in late:
        while not room[arcs[starts[home]]]:
            home = (home + 1) % len(starts)
        room[arcs[starts[home]]] -= 1
        placed[d] = arcs[starts[home]]
    return placed


def test_ring_equals_row_by_row(spark):
    keys = [str(i * i) for i in range(1500)]
    for n in (1, 7, 16):
        want = row_by_row(keys, n)
        rows = ring.assign(spark.createDataFrame([(k,) for k in keys], "k string"), [F.col("k")], n).collect()
        assert {r["k"]: r["shard"] for r in rows} == {k: want[hashlib.md5(k.encode()).hexdigest()] for k in keys}


def test_ring_moves_few_rows_without_slack():
    """At the slack in use, none, a new shard moves the rows that it takes and those that the new bounds push on."""
    keys = [str(i) for i in range(20_000)]
    old, new = row_by_row(keys, 16), row_by_row(keys, 17)
    moved = sum(old[d] != new[d] for d in old) / len(keys)
    assert 1 / 17 <= moved < 0.35  # dealing by hash modulo shards would move 16 / 17


def test_mixtures_equal_plain_em():
    rng = random.Random(1)
    counts = np.array([[rng.random() ** 3 * 50 for _ in range(3)] for _ in range(language.BUCKETS)])
    model = language.Model(["a", "b", "c"], counts)
    p = [[(counts[i, k] + 0.5) / (counts[:, k].sum() + 0.5 * language.BUCKETS) for k in range(3)] for i in range(language.BUCKETS)]
    for mix in ([1, 0, 0], [0.7, 0.3, 0], [0.4, 0.3, 0.3]):
        column = [sum(mix[k] * p[i][k] for k in range(3)) for i in range(language.BUCKETS)]
        seen = rng.choices(range(language.BUCKETS), weights=column, k=3000)
        c = {i: seen.count(i) for i in set(seen)}

        def em(langs, share):
            for _ in range(12):
                new = {k: sum(n * share[k] * p[i][k] / sum(share[j] * p[i][j] for j in langs) for i, n in c.items()) / len(seen) for k in langs}
                done, share = max(abs(new[k] - share[k]) for k in langs) < 1e-4, new
                if done:
                    break
            return share, sum(n * math.log(sum(share[k] * p[i][k] for k in langs)) for i, n in c.items())

        langs = [0, 1, 2]
        share, fit = em(langs, dict.fromkeys(langs, 1 / 3))
        while len(langs) > 1:
            less = [k for k in langs if k != min(langs, key=lambda k: share[k])]
            total = sum(share[k] for k in less)
            smaller, worse = em(less, {k: share[k] / total for k in less})
            if worse + 0.5 * math.log(len(seen) + 1) < fit:
                break
            langs, share, fit = less, smaller, worse
        chosen, found, evidence = model.mixture(np.bincount(seen, minlength=language.BUCKETS))
        assert dict(zip(chosen.tolist(), found, strict=True)).keys() == share.keys()
        assert all(abs(found[i] - share[k]) < 1e-3 for i, k in enumerate(chosen.tolist()))
        assert abs(evidence - fit - len(seen) * math.log(language.BUCKETS)) < 1e-2 * len(seen)


def test_noise_has_no_evidence():
    rng = np.random.default_rng(2)
    text = np.frombuffer(("the cat sat on the mat and looked at the moon " * 200).encode(), np.uint8)
    model = language.Model(["x"], np.bincount(language._buckets(text), minlength=language.BUCKETS)[:, None])
    noise = rng.integers(97, 123, 3000).astype(np.uint8)
    assert model.mixture(np.bincount(language._buckets(text), minlength=language.BUCKETS))[2] > 1000
    assert model.mixture(np.bincount(language._buckets(noise), minlength=language.BUCKETS))[2] < -10


def test_fingerprints_equal_hashes_of_sorted_terms():
    rng = random.Random(5)
    vocabulary = [f"t{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=k)) for k in (0, 3, 40, 200)] + ["T1 t1, t2"]
    word = lambda w: int(t.span(t.prefix(np.frombuffer(w.encode(), np.uint8)), np.array([0]), np.array([len(w)]))[0])
    one = lambda x: int(t.mix(np.array([x & (2**64 - 1)], dtype=np.uint64))[0])
    known = np.sort(np.array([word(w) for w in vocabulary[:150]], dtype=np.uint64))
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    found = imatch.fingerprints(data, np.concatenate(([0], np.cumsum([len(x) for x in texts]))), known)
    for row, text in enumerate(texts):
        own = sorted({word(w) for w in text.lower().replace(",", " ").split()})
        inside = [x for x in own if x in set(known.tolist())]
        terms = own if len(inside) < imatch.FEWEST else inside
        for i, j in itertools.product(range(imatch.SCALES), range(imatch.SUBSETS)):
            lots = [one(x + (j + 1) * 0x9E3779B97F4A7C15) for x in terms]
            kept = [one(x) for x in lots if x < 1 << (63 - 2 * i)]
            assert found[row, i * imatch.SUBSETS + j] == ((one(sum(kept)) >> 40) | 1 if kept else 0)
    same = imatch.likeness(found, found)
    assert (same == 1).all()


def test_chain_equals_enumeration():
    rng = np.random.default_rng(3)
    sizes, moves = [1, 5, 2, 9, 7], np.array([[0.5, -0.4], [-0.3, 0.8]])
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    emission = rng.normal(0, 2, bounds[-1])
    p, forward, ahead = toxicity.chain(emission, toxicity.begins(bounds), moves)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        n = b - a
        weight = {y: math.exp(sum(emission[a + i] * y[i] for i in range(n)) + sum(moves[y[i - 1], y[i]] for i in range(1, n))) for y in itertools.product((0, 1), repeat=int(n))}
        for i in range(n):
            assert abs(p[a + i] - sum(w for y, w in weight.items() if y[i]) / sum(weight.values())) < 1e-9


def test_chain_is_the_same_however_it_is_swept(monkeypatch):
    rng = np.random.default_rng(4)
    bounds = np.array([0, 3, 3, 700, 701, 1500])
    emission, moves = rng.normal(-1, 3, 1500), np.array([[0.5, -0.4], [-0.3, 0.8]])
    want = toxicity.chain(emission, toxicity.begins(bounds), moves)
    for width in (1, 7, 4096):
        monkeypatch.setattr(toxicity, "SWEEP", width)
        for a, b in zip(want, toxicity.chain(emission, toxicity.begins(bounds), moves), strict=True):
            assert np.allclose(a, b)


def test_components_equal_union_find(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1080)] + [(2000 + i, 1999) for i in range(200)] + [(5, 5)]
    least = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert found == {x: m for x, m in least.items() if x != m}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rare_shingles_find_what_the_buckets_head_misses(spark):
    """Pairs that share boilerplate with many others, and are linked with one another alone."""
    rng = random.Random(7)
    shared = [f"s{i}" for i in range(60)]
    texts = []
    for i in range(40):
        own = [f"o{i}x{j}" for j in range(40)]
        texts += [" ".join(shared + own), " ".join(shared + own[:-1] + ["last"])]
    rng.shuffle(texts)
    rows = minhash.cluster(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=8).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["component_id"], []).append(texts[r["doc_id"]].split()[60])
    assert len(groups) == 40 and all(len(v) == 2 and v[0] == v[1] for v in groups.values())


def test_texts_longer_than_a_slice(spark):
    rng = random.Random(8)
    long = " ".join(f"{rng.randrange(10**9):x}" for _ in range(90_000))  # more than one slice
    part = " ".join(long.split()[70_000:70_060])
    assert len(long) > t.SLICE
    docs = spark.createDataFrame([(1, long), (2, "before " + part + " after"), (3, long + " end"), (4, None)], "doc_id long, text string")
    found = {r["doc_id"]: r["n_removed"] for r in phrases.remove(docs).collect()}
    assert found == {1: 90_000, 2: 60, 3: 90_000, 4: 0}
    found = {r["doc_id"]: r["n_removed"] for r in suffixes.remove(docs).collect()}
    # One space on either side, and before the end, belongs to a repeat too.
    assert found == {1: len(long), 2: len(part) + 2, 3: len(long), 4: 0}
    assert {r["doc_id"]: r["component_id"] for r in minhash.cluster(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
    items = spark.createDataFrame([(9, part)], "item_id long, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.report(docs, items).collect()} == {1: 60, 2: 60, 3: 60, 4: 0}


def test_names_that_clash(spark):
    names = ["score", "lang_pred", "n_words", "component_id", "fingerprint", "_text", "_hits", "_rid", "_spans", "languages", "evidence", "contaminated"]
    docs = spark.createDataFrame([(i, f"some words {i} of a text", *["own"] * len(names)) for i in range(4)], ["doc_id", "text", *names])
    model = language.fit(docs.withColumn("lang", F.lit("en")), "text", "lang")
    items = spark.createDataFrame([(1, "words 2")], "item_id long, text string")
    for frame, replaced in (
        (language.identify(docs, model), {"score", "lang_pred", "languages", "evidence"}),
        (decontaminate.find(docs, items), {"_hits"}),
        (decontaminate.report(docs, items), {"n_words", "contaminated"}),
        (minhash.cluster(docs), {"component_id"}),
        (minhash.representatives(docs), set()),
        (phrases.occurrences(docs), {"_spans"}),
        (suffixes.occurrences(docs), {"_spans"}),
        (imatch.add_fingerprints(docs, imatch.lexicon(docs)), {"fingerprint"}),
        (toxicity.score(docs, toxicity.fit(docs, docs.select("doc_id", F.lit(1).alias("toxic")))), {"score"}),
    ):
        rows = frame.collect()
        assert len(rows) == 4 and len(frame.columns) == len(set(frame.columns))
        assert all(r[c] == "own" for r in rows for c in names if c not in replaced)


def test_more_names_that_clash(spark):
    names = ["taken", "size", "slot", "kept", "predicted", "spans", "n_shingles", "shard", "copies", "target", "source_size", "n_bytes", "n_removed", "n_spans", "node", "own", "a.b"]
    docs = spark.createDataFrame([(i, f"some words {i} of a text", "s", *["own"] * len(names)) for i in range(4)], ["doc_id", "text", "source", *names])
    words = F.regexp_count("text", F.lit(r"\S+"))
    for frame, replaced in (
        (minhash.cluster(docs), {"n_shingles", "kept"}),
        (minhash.representatives(docs), set()),
        (simhash.cluster(docs), set()),
        (phrases.occurrences(docs), set()),
        (suffixes.occurrences(docs), set()),
        (ring.assign(docs, [F.col("doc_id")], 4), {"shard", "slot"}),
        (mix.draw(docs, "source", words, [F.col("doc_id")], [1], 1.0, 2.0), {"size", "source_size", "target", "copies", "taken"}),
        (toxicity.score(docs, toxicity.fit(docs, docs.select("doc_id", F.lit(1).alias("toxic")))), {"predicted", "spans"}),
    ):
        assert {*names} - replaced <= {*frame.columns}, frame.columns
        rows = frame.collect()
        assert len(rows) == 4 and len(frame.columns) == len(set(frame.columns))
        assert all(r[c] == "own" for r in rows for c in names if c not in replaced)


def test_slices_of_bytes():
    column = pa.array([b"ab", b"", b"cde"], pa.binary())
    (low, high, data, offsets), = t.slices(column)
    assert (low, high, data.tobytes(), offsets.tolist()) == (0, 3, b"abcde", [0, 2, 2, 5])
