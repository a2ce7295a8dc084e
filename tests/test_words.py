"""Words and stems against SQLite's full-text tokenizer, which is where the index's words come from."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from notequery.functions import text as x
from notequery.operators import index

ODD = [
    "École école ECOLE ḾĄĘ ø Ł İstanbul ß Ελλάδα Й straße 12½ a_b co-op ponies ﬁne ²x ǖ ệ private Ångström naı̈ve ΟΔΟΣ",
    "é ́start end́ mid́dle á̂b 日本語 tiếng Việt tiếng Việt ẞ ſ",
    "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli "
    "differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference "
    "airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll geologies apology possibly",
    "", " - ", "x" * 70 + "ing", "ab1s 2ing abcing yyed éed üing ßßing",
]


def sqlite_terms(texts, kind):
    con = sqlite3.connect(":memory:")
    con.execute(f"CREATE VIRTUAL TABLE t USING fts5(x, tokenize='{kind} remove_diacritics 2')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    con.executemany("INSERT INTO t (rowid, x) VALUES (?, ?)", list(enumerate(texts, 1)))
    return [(d - 1, o, t) for t, d, o in con.execute("SELECT term, doc, offset FROM v ORDER BY doc, offset")]


@pytest.fixture(scope="module")
def texts(spark):
    found = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r["text"]]
    return ODD + [t.replace("\0", " ") for t in found]


def test_words_are_those_of_the_tokenizer(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.posexplode(x.words(F.col("t"))).alias("pos", "term"))
    got = sorted((r["i"], r["pos"], r["term"]) for r in df.collect())
    want = sqlite_terms(texts, "unicode61")
    assert len(want) > 5000
    assert [(a, b) for a, b in zip(got, want, strict=False) if a != b][:5] == [] and len(got) == len(want)


def test_stems_are_those_of_the_tokenizer(texts):
    plain, stemmed = sqlite_terms(texts, "unicode61"), sqlite_terms(texts, "porter unicode61")
    pairs = {(a[2], b[2]) for a, b in zip(plain, stemmed, strict=True)}
    assert {(a, index.stem(a), b) for a, b in pairs if index.stem(a) != b} == set()


def test_spellings_of_a_word_are_one(spark):
    rows = spark.createDataFrame([("café",), ("café",), ("CAFÉ",), ("cafe",)], "t string")
    assert {tuple(r["w"]) for r in rows.select(x.words(F.col("t")).alias("w")).collect()} == {("cafe",)}
