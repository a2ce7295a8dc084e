"""Mixing sources to target weights by Pareto order sampling.

Sources share a budget of words by weight, none above a cap, the excess shared anew.  A source whose target is
f times its size gets floor(f) whole copies of every document for certain; the rest of its target is drawn by
Pareto order sampling: documents are ranked by their random odds divided by their inclusion odds, and the
leading ranks whose words add up to the rest are taken.  Longer documents have larger inclusion chances; the
chances are centred so that the expected words equal the rest.  Everything is DataFrame functions; sums are
integers, so reruns agree to the last row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notequery.llm import _store

#: Sources up to which their table, one row each, is broadcast; beyond that Spark shuffles it.
MOST_BROADCAST = 10_000
#: Parts of a unit that centred chances are counted in, and slices of the rank scale.
PARTS, SLICES = 1_000_000, 4096


def targets(sizes: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """Add ``target`` to (source, source_size): weights go round the sources in code point order, null last.

    A source's target is its part of ``share`` times all sizes, at most ``cap`` times its own size; what is cut
    off is shared anew by weight.  That is the common level at which targets min(cap * size, level * weight)
    use up the budget: with sources in order of cap * size / weight, the first whose level no longer reaches its
    cap fixes it.  There is one row a source here, never one a document.
    """
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    df = sizes.withColumn("_weight", weight).withColumn("_cap", F.lit(cap) * F.col("source_size"))
    ratio = F.col("_cap") / F.col("_weight")
    before = everything.orderBy(ratio, F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    df = df.withColumn("_left", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    budget = F.lit(share) * F.sum("source_size").over(everything)
    df = df.withColumn("_level", (budget - F.col("_capped")) / F.col("_left"))
    fixed = F.struct(ratio.alias("r"), F.col("source").isNull().alias("n"), F.col("source").alias("s"), F.col("_level").alias("level"))
    level = F.min(F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), fixed)).over(everything)["level"]
    target = F.least(F.col("_cap"), F.coalesce(level * F.col("_weight"), F.col("_cap")))
    return df.select("source", "source_size", target.alias("target"))


def uniform(place: Column) -> Column:
    """A number strictly between 0 and 1 from an md5 digest in hexadecimal."""
    return (F.conv(F.substring(place, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def draw(df: DataFrame, source: str, size: Column, key: list[Column], weights: list[int], share: float, cap: float, seed: str = "mix") -> DataFrame:
    """``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (size times copies) of every row, after its own columns.

    The frame is written once, so pass no more columns than the result needs.  Rows alike in all ``key`` columns
    should be alike in size: they rank together.  A null source is a source of its own, a null text has size 0
    and is taken 0 words; an empty table stays empty.  Columns of the input with the added names are replaced.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    own = [c for c in df.columns if c not in added]
    place = F.md5(F.concat_ws("\x1f", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("\\N")) for k in key]))
    rows = _store.table(df.select(*[df[f"`{c}`"] for c in own], size.cast("long").alias("size"), df[f"`{source}`"].alias("_source"), place.alias("_place")), "mix-rows")
    sums = rows.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    sums = _store.table(sums, "mix-sources")
    bounded = F.broadcast if sums.count() <= MOST_BROADCAST else lambda frame: frame
    # The tilt towards long documents, in parts: size / (size + mean), and its mean over the source's words.
    mean = F.greatest(F.lit(1), F.expr("source_size div _n"))
    tilt = F.expr(f"(size * {PARTS}L) div (size + _mean)")
    centres = (
        rows.join(bounded(sums.select(F.col("_source").alias("_s"), mean.alias("_mean"))), F.col("_source").eqNullSafe(F.col("_s")))
        .groupBy("_s", "_mean")
        .agg(F.sum((tilt * F.col("size")).cast("decimal(38,0)")).alias("_tilted"), F.sum("size").alias("_words"))
        .select(F.col("_s").alias("_c"), "_mean", F.when(F.col("_words") > 0, F.expr("_tilted div _words")).otherwise(0).cast("long").alias("_centre"))
    )
    plan = targets(sums.select(F.col("_source").alias("source"), "source_size"), weights, share, cap).withColumnRenamed("source", "_s")
    plan = plan.join(centres, F.col("_s").eqNullSafe(F.col("_c"))).drop("_c")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    joined = rows.join(bounded(plan), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    part = F.col("_rest") / F.greatest(F.lit(1), F.col("source_size"))
    chance = part + part * (1 - part) * (tilt - F.col("_centre")) / float(PARTS)
    u = uniform(F.col("_place"))
    joined = joined.withColumn("_rank", F.when(F.col("_rest") > 0, (u / (1 - u)) / (chance / (1 - chance))))
    joined = joined.withColumn("_slice", F.floor(F.col("_rank") / (1 + F.col("_rank")) * SLICES).cast("int"))
    # Words of each slice of a source; only the slice in which the rest is used up is settled row by row.
    slices = joined.groupBy(F.col("_source").alias("_s"), F.col("_slice").alias("_k")).agg(F.sum("size").alias("_words"))
    run = F.sum("_words").over(Window.partitionBy("_s").orderBy("_k"))
    slices = slices.filter("_k is not null").withColumn("_before", run - F.col("_words"))
    joined = joined.join(slices, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_k")), "left")
    inside = F.coalesce((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_words") > F.col("_rest")), F.lit(False))
    settled = joined.filter(~inside).withColumn("_picked", F.coalesce(F.col("_before") < F.col("_rest"), F.lit(False)))
    order = Window.partitionBy("_source").orderBy("_rank", "_place").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_before") + F.sum("size").over(order)
    # The document in which the rest is used up is taken if that comes nearer than leaving it out.
    edge = joined.filter(inside).withColumn("_picked", 2 * (F.col("_rest") - (upto - F.col("size"))) >= F.col("size"))
    out = settled.unionByName(edge).withColumn("copies", F.col("_whole") + F.col("_picked").cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in own], "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
