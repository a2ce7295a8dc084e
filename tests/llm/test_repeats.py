import random
from collections import Counter

import numpy as np
import pytest

from notequery.llm import _repeats, phrases, suffixes


def covered(units, length, counts):
    gone = [False] * len(units)
    for i in range(len(units) - length + 1):
        if counts[tuple(units[i : i + length])] > 1:
            gone[i : i + length] = [True] * length
    return gone


def brute(texts, length, split):
    units = [split(t or "") for t in texts]
    counts = Counter(tuple(u[i : i + length]) for u in units for i in range(len(u) - length + 1))
    return [[x for x, gone in zip(u, covered(u, length, counts), strict=True) if not gone] for u in units], [sum(covered(u, length, counts)) for u in units]


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcé", k=rng.randint(1, 5))) for _ in range(60)]
    passage = rng.choices(vocabulary, k=90)
    texts = []
    for _ in range(40):
        words = rng.choices(vocabulary, k=rng.randint(0, 120))
        if rng.random() < 0.5:
            a = rng.randint(0, 50)
            words[len(words) // 2 : len(words) // 2] = passage[a : a + rng.randint(10, 40)]
        texts.append(rng.choice([" ", "\n"]).join(words))
    return [*texts, *texts[:3], "ab " * 200, "ba " * 90, None, "", "short"]


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_equal_brute_force(spark, seed):
    texts = corpus(seed)
    kept, removed = brute(texts, 12, lambda t: t.encode().split())
    found = {r["doc_id"]: r for r in phrases.remove(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=12).collect()}
    for i in range(len(texts)):
        assert found[i]["n_removed"] == removed[i]
        assert found[i]["kept"].encode() == b" ".join(kept[i])


@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes_equal_brute_force(spark, seed):
    texts = corpus(seed)
    kept, removed = brute(texts, 60, lambda t: list(t.encode()))
    found = {r["doc_id"]: r for r in suffixes.remove(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=60).collect()}
    for i in range(len(texts)):
        assert found[i]["n_removed"] == removed[i]
        assert bytes(found[i]["kept"]) == bytes(kept[i])


@pytest.mark.parametrize("block", [300, 1000, 1 << 21])
def test_blocks_merge_to_the_same_spans(block):
    rng = random.Random(block)
    base = bytes(rng.choices(b"ab c", k=400))
    bodies = [base[a : a + 60] for a in (rng.randint(0, 340) for _ in range(30))] + [bytes(rng.choices(b"abcd", k=50)) for _ in range(10)]
    bodies = list(dict.fromkeys(bodies))
    windows = np.array([len(b) - 19 for b in bodies])
    copies = np.ones(len(bodies), dtype=np.int64)
    counts = Counter(b[i : i + 20] for b in bodies for i in range(len(b) - 19))
    found = suffixes.judge(20, block)(bodies, copies, windows)
    for body, spans in zip(bodies, found, strict=True):
        gone = [False] * len(body)
        for a, b in spans:
            gone[a:b] = [True] * (b - a)
        want = [False] * len(body)
        for i in range(len(body) - 19):
            if counts[body[i : i + 20]] > 1:
                want[i : i + 20] = [True] * 20
        assert gone == want


def test_suffix_array_sorts_and_measures():
    rng = random.Random(3)
    data = np.frombuffer(bytes(rng.choices(b"aab", k=3000)), dtype=np.uint8)
    eight = suffixes.heads(data, 200)
    order, known, tied = suffixes.suffix_array(data, 64, eight)
    shared = suffixes.common_prefixes(order, known, tied, eight, 64)
    raw = data.tobytes()
    for k in range(1, len(order)):
        a, b = raw[order[k - 1] :][:64], raw[order[k] :][:64]
        assert a <= b
        n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert (shared[k] >= 64) == (n >= 64) or len(raw) - order[k] < 64 or len(raw) - order[k - 1] < 64


@pytest.mark.parametrize("remove", [phrases.remove, suffixes.remove])
def test_odd_rows(odd, empty, remove):
    rows = remove(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] in (0, 1, 2))
    assert remove(empty).count() == 0


@pytest.mark.parametrize("by_words", [True, False])
def test_a_phrase_in_many_contexts_exceeds_no_shard(spark, by_words):
    rng = random.Random(7)
    make = lambda n: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))
    phrase, tails = make(9), [make(12) for _ in range(40)]
    texts = [f"{make(12)} {phrase} {rng.choice(tails) if i % 3 == 0 else make(12)}" for i in range(300)] + [f"{make(3)} {phrase}"] * 2
    length, k, most, method = (12, 6, 400, phrases) if by_words else (60, 24, 3000, suffixes)
    inner = method.judge(length)

    def judge(bodies, copies, windows):
        held = sum(len(b.split()) if by_words else len(b) for b in bodies)
        if held > 4 * most:
            raise ValueError(f"{held} units in a shard of {most}")
        return inner(bodies, copies, windows)

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["_spans"] for r in _repeats.find(docs, "doc_id", "text", by_words, length, k, most, judge).collect()}
    units = [t.encode().split() if by_words else list(t.encode()) for t in texts]
    counts = Counter(tuple(u[i : i + length]) for u in units for i in range(len(u) - length + 1))
    assert sum(map(bool, found.values())) > 80
    for i, own in enumerate(units):
        gone = [False] * len(own)
        for s in found[i] or ():
            gone[s["start"] : s["end"]] = [True] * (s["end"] - s["start"])
        assert gone == covered(own, length, counts)
