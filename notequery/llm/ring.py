"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

A row's key hashes to one of ``BINS`` points of a ring; each shard owns ``vnodes`` arcs of it.  A shard takes
no more than its bound; rows that find it full go on clockwise to the next arc whose shard has room.  Only the
row counts of the bins (``BINS`` numbers, whatever the data) reach the driver, where the arcs are filled; rows
then find their shard by their rank within their bin, so no task holds more than one bin and nothing is
collected.  Everything is DataFrame functions.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BINS = 1 << 16


def _point(label: str) -> int:
    return int(hashlib.md5(label.encode()).hexdigest()[:4], 16)


def ring(n_shards: int, vnodes: int) -> tuple[list[int], list[int]]:
    """Arc starts in ring order and the shard that owns each; adding a shard only adds arcs of its own."""
    owner: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            owner.setdefault(_point(f"shard-{shard}-vnode-{v}"), shard)
    at = sorted(owner)
    return at, [owner[p] for p in at]


def bounds(total: int, n_shards: int, slack: float) -> list[int]:
    """The most rows that each shard takes: within one of each other if slack is 0, else (1 + slack) times the mean."""
    if slack > 0:
        return [-int(-(1 + slack) * total // n_shards)] * n_shards
    return [total // n_shards + (shard < total % n_shards) for shard in range(n_shards)]


def fill(counts: dict[int, int], n_shards: int, vnodes: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """(bin, shard, first rank, last rank + 1, first slot) of every stretch of a bin.

    Bins are placed in ring order, each row on the arc it falls in; what finds the arc's shard full moves on
    clockwise until a shard has room.  Bounds add up to at least the total, so each row finds room within a turn.
    """
    at, owner = ring(n_shards, vnodes)
    room = bounds(sum(counts.values()), n_shards, slack)
    slots, out = [0] * n_shards, []
    homes, late = [], []
    for point in sorted(counts):
        home = (bisect.bisect_right(at, point) - 1) % len(at)
        take = min(counts[point], room[owner[home]])
        room[owner[home]] -= take
        homes.append((point, owner[home], 0, take))
        if take < counts[point]:
            late.append((point, home, take))
    for point, home, first in late:
        arc, left = home, counts[point] - first
        while left:
            arc = (arc + 1) % len(at)
            if take := min(left, room[owner[arc]]):
                room[owner[arc]] -= take
                homes.append((point, owner[arc], first, first + take))
                first, left = first + take, left - take
    for point, shard, first, last in homes:
        if last > first:
            out.append((point, shard, first, last, slots[shard]))
            slots[shard] += last - first
    return out


def assign(df: DataFrame, key: list[Column], n_shards: int, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 within the shard) to every row.

    ``key`` are columns whose text forms a row's place on the ring; rows alike in all of them are
    interchangeable, nulls count as a value.  An empty table stays empty.  With ``slack`` 0 the row counts of
    shards differ by one at most.  Columns of the input named ``shard`` or ``slot`` are replaced.
    """
    if n_shards < 1 or vnodes < 1 or slack < 0:
        raise ValueError("n_shards and vnodes must be positive, slack not negative")
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("\\N")) for k in key]))
    own = [c for c in df.columns if c not in ("shard", "slot")]
    placed = df.select(*[df[f"`{c}`"] for c in own], F.conv(F.substring(digest, 1, 4), 16, 10).cast("int").alias("_bin"), digest.alias("_place"))
    counts = {r["_bin"]: r["n"] for r in placed.groupBy("_bin").agg(F.count("*").alias("n")).collect()}
    spans: dict[int, list] = {}
    for point, shard, first, last, slot in fill(counts, n_shards, vnodes, slack):
        spans.setdefault(point, []).append((shard, first, last, slot))
    plan = df.sparkSession.createDataFrame(
        list(spans.items()), "_bin int, _spans array<struct<shard: int, first: long, last: long, slot: long>>"
    )
    rank = F.row_number().over(Window.partitionBy("_bin").orderBy("_place")) - 1
    ranked = placed.withColumn("_rank", rank.cast("long")).join(F.broadcast(plan), "_bin")
    span = F.filter("_spans", lambda s: (s["first"] <= F.col("_rank")) & (F.col("_rank") < s["last"]))[0]
    return ranked.withColumn("_span", span).select(
        *[F.col(f"`{c}`") for c in own],
        F.col("_span.shard").alias("shard"),
        (F.col("_span.slot") + F.col("_rank") - F.col("_span.first")).alias("slot"),
    )
