"""A corpus pipeline: documents in, mixed and sharded training documents out.

Stages run in order, each on all rows that the one before it kept.  A stage's result is written as a table in the
folder that all executors share and read again, so that lost executors cost one stage.  Rows with null or empty
texts leave at the first stage; a table without rows passes through; columns beside those of documents are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notequery.llm import _store, decontaminate, language, minhash, mix, ring

N_SHARDS = 16
#: Nats by which noise must explain a text better for it to go.
NOISE = 10.0
WORD = r"[^\x20\x09-\x0D]+"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are in no language.

    These are documents without a letter or without text, and those that uniform noise explains better, by a factor
    of e ** NOISE at least, than any mixture of the languages that the corpus names.  Where no row has a lang nothing
    can be learned, and all documents with a letter stay.
    """
    found = language.identify(docs, language.fit(docs, "text", "lang"), lettered="_lettered")
    return found.filter(F.col("_lettered") & (F.col("evidence") > -NOISE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row, of the least doc_id, of each group linked by 5-word shingles at a similarity of 0.8.

    Rows of different groups stay even if their doc_id is null or the same, as do texts without a word.
    """
    return minhash.representatives(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten words in a row of a benchmark item, or a whole shorter item."""
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)
    return found.filter("_hits is null").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw one and a half times all words by source weight; a document that is taken twice becomes two rows."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0))
    drawn = mix.draw(docs, "source", size, [F.col("doc_id"), size], weights=[3, 1, 2], share=1.5, cap=2.0)
    own = [F.col(f"`{c}`") for c in docs.columns]
    return drawn.filter("copies > 0").select(*own, F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add shard and slot; shards differ by one row at most."""
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return ring.assign(docs, [F.col("doc_id"), crc], N_SHARDS)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: Language mixtures and signatures are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table.  What a stage made on its way goes once its result is written, and so does what it read."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = _store.fresh(spark, name)
        with _store.scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            _store.remove(spark, before)
        before = path
    return docs
