"""Log files as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_LINE = r"^(20\S*)\s+(TRACE|DEBUG|INFO|WARN|ERROR)\s+(?:([^\s:]+): )?(.*)$"


def parse(lines: DataFrame, line: str = "value") -> DataFrame:
    """All rows with timestamp, level, category and message; a line of another form is all message."""
    part = lambda i: F.regexp_extract(line, _LINE, i)
    fits = F.regexp_like(F.col(line), F.lit(_LINE))
    return lines.select("*", part(1).alias("timestamp"), part(2).alias("level"), part(3).alias("category"), F.when(fits, part(4)).otherwise(F.col(line)).alias("message"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def tail(rows: DataFrame, order: str, chosen: Column, most: int = 200) -> DataFrame:
    """The last rows among those chosen, in order."""
    last = F.row_number().over(Window.orderBy(F.desc(order)))
    kept = rows.filter(chosen).orderBy(F.desc(order)).limit(most)
    return kept.withColumn("_n", last).orderBy(F.desc("_n")).drop("_n")
