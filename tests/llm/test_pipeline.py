import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, kept string"


def texts(seed, n, words=40):
    rng = random.Random(seed)
    return [" ".join(rng.choices([f"w{i}" for i in range(500)], k=words)) for _ in range(n)]


def test_near_dedup_keeps_one_row_of_each_class(spark):
    a, b, c, d, e, f, g = texts(1, 7)
    near = a.rsplit(" ", 1)[0] + " other"
    rows = [(None, a), (None, near), (None, b), (None, c), (5, d), (5, e), (9, d), (5, d), (5, d), (2, near), (6, f), (7, f), (None, f), (None, g), (None, g), (8, ""), (8, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", "own") for i, t in rows], SCHEMA)
    found = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    # Each class once, by its least key; unrelated rows of one doc_id or of none all stay.
    want = [(2, near), (None, b), (None, c), (5, d), (5, e), (6, f), (None, g), (8, ""), (8, None), (None, None)]
    assert sorted([(r["doc_id"], r["text"]) for r in found], key=repr) == sorted(want, key=repr)
    assert {r["kept"] for r in found} == {"own"}


def test_near_dedup_of_one_doc_id_with_linked_texts(spark):
    (a,) = texts(2, 1)
    rows = [(1, a), (1, a.rsplit(" ", 1)[0] + " other"), (4, a)]
    found = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert len(found) == 1 and found[0]["doc_id"] == 1


@pytest.mark.parametrize("lang", [None, "en"])
def test_language_stage_drops_only_texts_without_a_letter(spark, lang):
    rows = [(1, "some words", lang, "s", "own"), (None, "é", lang, None, "own"), (3, "12 34 !", lang, "s", "own"), (4, "", lang, "s", "own"), (5, None, lang, "s", "own")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = corpus_pipeline.identify_language(spark, docs, "").collect()
    assert sorted(r["text"] for r in found) == ["some words", "é"]
    assert found[0].__fields__ == docs.columns


def test_other_stages_equal_brute_force(spark, tmp_path):
    own = texts(3, 60)
    own[7] += " " + " ".join(f"b{i}" for i in range(10))
    own[8] += " " + " ".join(f"b{i}" for i in range(9))
    spark.createDataFrame([(1, "x " + " ".join(f"b{i}" for i in range(12)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    item = ("x " + " ".join(f"b{i}" for i in range(12))).split()
    runs = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}
    rows = [(i % 50 if i % 9 else None, t, None, "abc"[i % 3], "own") for i, t in enumerate(own)]
    docs = spark.createDataFrame(rows, SCHEMA)
    clean = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    want = [t for t in own if not any(tuple(t.split()[i : i + 10]) in runs for i in range(len(t.split()) - 9))]
    assert len(want) == 59 and sorted(r["text"] for r in clean.collect()) == sorted(want)
    mixed = [r["text"] for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]
    assert set(mixed) <= set(own) and max(map(mixed.count, mixed)) <= 2
    shards = [r["shard"] for r in corpus_pipeline.assign_shards(spark, docs.drop("shard"), "").collect()]
    sizes = [shards.count(k) for k in range(corpus_pipeline.N_SHARDS)]
    assert len(shards) == 60 and max(sizes) - min(sizes) <= 1
