"""Held-out figures of the learned operators, as the README gives them: python -m notequery.llm.measure FOLDER."""

from __future__ import annotations

import sys
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notequery.llm import queries


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of held-out labelled documents: rows, toxic ones, recall, false alarms and the area under the curve, all on labels that fitting never saw."""
    found = queries.toxic(spark, sf_dir).filter("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic in (0, 1)"), "doc_id")
    scores = found.groupBy("score").agg(F.sum(F.col("toxic")).alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    # Of pairs of a toxic and a clean document, those in the right order; ties count half.
    ranked = scores.withColumn("below", F.expr("sum(n) over (order by score rows between unbounded preceding and 1 preceding)"))
    auc = ranked.agg((F.sum(F.col("p") * (F.coalesce("below", F.lit(0)) + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"))
    rates = found.agg(
        F.count("*").alias("rows"), F.sum("toxic").alias("toxic"), F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("false_alarms")
    )
    return rates.crossJoin(auc)


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of held-out documents with a language: rows and the share predicted right."""
    found = queries.languages(spark, sf_dir).filter("held_out").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("lang is not null")
    return found.agg(F.count("*").alias("rows"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all documents: how often a fingerprint is nearer to its edited text's than to the next document's, and how often it shares nothing with it."""
    found = queries.fingerprints(spark, sf_dir)
    return found.agg(F.count("*").alias("rows"), F.avg((F.col("near_edited") > F.col("near_next")).cast("int")).alias("nearer"), F.avg((F.col("near_edited") == 0).cast("int")).alias("nothing_shared"))


if __name__ == "__main__":
    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    for measure in (toxicity, languages, edits):
        print(measure.__name__, measure(session, sys.argv[1]).first().asDict(), flush=True)
