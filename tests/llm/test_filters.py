import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from notequery.llm import decontaminate, imatch, language, minhash, toxicity

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu"]


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        low = c.lower() if "A" <= c <= "Z" else c
        if low.isascii() and not low.isalnum():
            out += [word] if word else []
            word = ""
        else:
            word += low
    return out


@pytest.mark.parametrize("most", [3, 500_000])
def test_decontamination_equals_brute_force(spark, most):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices(WORDS, k=n))) for i, n in enumerate([3, 6, 9, 12, 5, 0])] + [(7, None), (8, "Étude-x, y!")]
    docs = []
    for i in range(60):
        text = rng.choices(WORDS, k=rng.randint(0, 40))
        if i % 3 == 0:
            text[5:5] = items[i % 5][1].upper().split()
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text)))
    docs += [(60, None), (61, ""), (62, "an étude x Y")]
    n = 5
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.report(*frames, n=n).collect()}
    hits = {r["doc_id"]: r["_hits"] for r in decontaminate.find(*frames, n=n, most=most, hashes=9).collect()}
    for i, text in docs:
        own, gone, ids = words(text), set(), set()
        for item, t in items:
            w = words(t)
            size = min(n, len(w))
            for a in range(len(w) - size + 1 if size else 0):
                for b in range(len(own) - size + 1):
                    if own[b : b + size] == w[a : a + size]:
                        gone.update(range(b, b + size))
                        ids.add(str(item))
        assert (found[i]["n_words"], found[i]["n_hit"], found[i]["n_items"]) == (len(own), len(gone), len(ids))
        assert {h["item"] for h in hits[i] or ()} == ids


def test_decontamination_odd(spark, odd, empty):
    items = spark.createDataFrame([(1, "the the"), (None, "a")], "item_id long, text string")
    rows = decontaminate.report(odd, items).collect()
    assert len(rows) == odd.count() and sum(r["contaminated"] for r in rows) >= 5
    assert decontaminate.report(empty, items).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.report(odd, items.limit(0)).collect())
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(decontaminate.report(odd, items, most=0)) == plain(decontaminate.report(odd, items))
    clashing = odd.withColumns({c: F.lit(1) for c in ("n_words", "_hits", "_words", "start", "length", "hash", "words", "_a", "item")})
    assert plain(decontaminate.report(clashing, items, most=0).select("doc_id", "n_words", "n_hit", "kept")) == plain(decontaminate.report(odd, items).select("doc_id", "n_words", "n_hit", "kept"))


@pytest.mark.parametrize("block", [4, 1500])
def test_components_equal_brute_force(spark, block):
    rng = random.Random(9)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randint(0, 900)}" for _ in range(120)]
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = f"n{rng.randint(0, 9999)}"
            texts.append(" ".join(own))
    texts += [None, "", "one two", "ONE two", "one  two three four", texts[0], "a b c d e f"]
    sets = []
    for text in texts:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    found = {r["doc_id"]: r for r in minhash.cluster(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=block).collect()}
    for i in range(len(texts)):
        assert found[i]["n_shingles"] == len(sets[i])
        assert found[i]["component_id"] == group[i]
        assert found[i]["kept"] == (group[i] == i)


def test_components_odd(odd, empty):
    rows = minhash.cluster(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["kept"] for r in rows if r["doc_id"] in (0, 1, 2))
    assert minhash.cluster(empty).count() == 0


def test_signatures_tell_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 62, 2000).astype(np.uint64))
    b = np.concatenate((a[:1000], np.unique(rng.integers(0, 1 << 62, 1000).astype(np.uint64))))
    codes = minhash.bands([a, np.sort(b)], 1, 256)
    assert abs((codes[0] == codes[1]).mean() - 1 / 3) < 0.1


def test_languages(spark, odd, empty):
    rng = random.Random(2)
    make = lambda letters, n: " ".join("".join(rng.choices(letters, k=5)) for _ in range(n))
    rows = [(make("abcd", 50), "x") for _ in range(30)] + [(make("wxyz", 50), "y") for _ in range(30)] + [(None, "x"), (make("abcd", 9), None)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    docs = [(1, make("abcd", 40)), (2, make("wxyz", 40)), (3, make("abcd", 60) + " " + make("wxyz", 30)), (4, "123 !"), (5, None)]
    found = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    assert [found[i]["lang_pred"] for i in range(1, 6)] == ["x", "y", "x", "und", "und"]
    assert 0.55 < found[3]["score"] < 0.8 and len(found[3]["languages"]) == 2 and len(found[1]["languages"]) == 1
    assert language.identify(odd, model).count() == odd.count()
    assert language.identify(empty, model).count() == 0
    nothing = language.fit(spark.createDataFrame([], "text string, lang string"), "text", "lang")
    assert {r["lang_pred"] for r in language.identify(odd, nothing).collect()} == {"und"}


def test_toxic_spans(spark, odd, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        text = rng.choices(WORDS, k=40)
        bad = i % 4 == 0
        if bad:
            text[rng.randrange(40)] = rng.choice(["vile", "nasty"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs.filter("doc_id < 200"), marks)
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(200, 300)]
    assert np.mean([found[i]["predicted"] == int(i % 4 == 0) for i in held]) > 0.95
    text, span = rows[204][1].encode(), found[204]["spans"][0]
    assert text[span["start"] : span["end"]] in (b"vile", b"nasty")
    scores = toxicity.score(odd, model).collect()
    assert len(scores) == odd.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert toxicity.score(empty, model).count() == 0
    assert all(r["predicted"] == 0 for r in toxicity.score(odd, toxicity.fit(docs, marks.limit(0))).collect())


def test_fingerprints(spark, odd, empty):
    rng = random.Random(6)
    vocabulary = [f"t{i}" for i in range(800)]
    rows = [(i * 3, " ".join(rng.choices(vocabulary, k=rng.randint(1, 200)))) for i in range(150)] + [(1000, None), (1001, ""), (1002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    known = imatch.lexicon(docs, high=0.5)
    found = {r["doc_id"]: r for r in imatch.against_edits(docs, known).collect()}
    order = sorted(rows)
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        assert found[i]["n_chars"] == len(text)
        assert found[i]["edited"] == text[: len(text) - half] + after[:half]
    long = [found[i] for i, x in rows if x and len(x) > 200]
    assert np.mean([r["near_edited"] for r in long]) > 2 * np.mean([r["near_next"] for r in long])
    same = {r["doc_id"]: r["fingerprint"] for r in imatch.add_fingerprints(docs, known).collect()}
    assert same == {i: r["fingerprint"] for i, r in found.items()}
    assert same[1001] == same[1002]
    assert imatch.against_edits(odd.select("doc_id", "text"), known).count() == odd.count()
    assert imatch.against_edits(empty.select("doc_id", "text"), imatch.lexicon(empty)).count() == 0


def test_held_out_is_a_fifth(spark):
    share = spark.range(5000).select(language.held_out(F.col("id")).cast("int").alias("h")).agg(F.avg("h")).first()[0]
    assert 0.17 < share < 0.23
