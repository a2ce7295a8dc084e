"""Centroid clustering: Lloyd's rounds over vectors that are sharded by dimension.

Vectors are cut into slices of rows and blocks of columns.  A block's task computes exact partial distances of its rows
against its block of every centroid and knows nothing of the other columns; the partial distances of a slice are added
by key, which gives each row's nearest centroid; and each block takes the assignments back to its own columns and
makes its own block of the next centroids from exact sums.  Only blocks of centroids, as many numbers as the parameters
say, pass through the driver.  Components are integers, so that no result depends on the order of a sum.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notequery.llm import _store

#: Columns in a block, rows in a slice.
WIDTH, ROWS = 16, 1024
#: Integer components are held to this size, so that a distance over 64 of them fits into 64 bits.
LARGEST = 1 << 27
_EXACT = 1 << 53


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows from centroids; by floating-point products where all sums are exact in them."""
    most = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))) + 1
    kind = np.float64 if 4 * most * most * x.shape[1] < _EXACT else np.int64
    a, b = x.astype(kind), c.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)


def _cut(dims: int, width: int, scale: int, rows: int):
    """Slices of rows by blocks of columns: the integers, and with block -1 the rows' numbers."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                part = batch.slice(low, rows)
                rid = part.column(0).to_numpy()
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rid), dims)
                with np.errstate(over="ignore"):
                    ints = np.clip(np.floor(values * scale), -LARGEST, LARGEST).astype(np.int32)
                blocks = [np.ascontiguousarray(ints[:, at : at + width]).tobytes() for at in range(0, dims, width)]
                key = np.full(len(blocks) + 1, rid[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(range(-1, len(blocks)), pa.int32()), pa.array([rid.tobytes(), *blocks], pa.binary())], names=["slice", "block", "data"]
                )

    return run


def _partial(centroids: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            out = []
            for block, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                c = centroids[block]
                out.append(_distances(np.frombuffer(data, np.int32).reshape(-1, c.shape[1]), c).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["slice", "partial"])

    return run


def _nearest(k: int):
    def run(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in part.column("partial").to_pylist()).reshape(-1, k)
        near = total.argmin(axis=1)  # of ties the first, which has the smaller number
        best = total[np.arange(len(near)), near]
        return pa.Table.from_arrays([part.column("slice").slice(0, 1), pa.array([near.astype(np.int32).tobytes()]), pa.array([best.tobytes()])], names=["slice", "cluster", "distance"])

    return run


def _assign(blocks: DataFrame, centroids: dict[int, np.ndarray]) -> DataFrame:
    """(slice, cluster, distance) of the rows of every slice."""
    partial = blocks.filter("block >= 0").mapInArrow(_partial(centroids), "slice long, partial binary")
    return partial.groupBy("slice").applyInArrow(_nearest(len(centroids[0])), "slice long, cluster binary, distance binary")


def _sums(centroids: dict[int, np.ndarray]):
    """What the rows of a task add to each block's clusters."""

    def run(batches):
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for block, data, near in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                c, near = centroids[block], np.frombuffer(near, np.int32)
                one = total.setdefault(block, [np.zeros(c.shape, dtype=np.int64), np.zeros(len(c), dtype=np.int64)])
                np.add.at(one[0], near, np.frombuffer(data, np.int32).reshape(-1, c.shape[1]).astype(np.int64))
                one[1] += np.bincount(near, minlength=len(c))
        names = sorted(total)
        columns = [pa.array(names, pa.int32()), *(pa.array([total[b][i].tobytes() for b in names], pa.binary()) for i in range(2))]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "sums", "counts"])

    return run


def _means(centroids: dict[int, np.ndarray]):
    """A block's next centroids; one without rows stays as it is."""

    def run(part: pa.Table) -> pa.Table:
        block = part.column("block")[0].as_py()
        old = centroids[block]
        sums = sum(np.frombuffer(x, np.int64) for x in part.column("sums").to_pylist()).reshape(old.shape)
        counts = sum(np.frombuffer(x, np.int64) for x in part.column("counts").to_pylist())
        new = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], old)
        return pa.Table.from_arrays([part.column("block").slice(0, 1), pa.array([new.astype(np.int64).tobytes()])], names=["block", "centroids"])

    return run


def _update(blocks: DataFrame, assigned: DataFrame, centroids: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    joined = blocks.filter("block >= 0").join(assigned.select("slice", "cluster"), "slice").select("block", "data", "cluster")
    means = joined.mapInArrow(_sums(centroids), "block int, sums binary, counts binary").groupBy("block").applyInArrow(_means(centroids), "block int, centroids binary")
    return {r["block"]: np.frombuffer(r["centroids"], np.int64).reshape(centroids[r["block"]].shape) for r in means.collect()}


def _spread(batches):
    for batch in batches:
        rid, near, best = (np.concatenate([np.frombuffer(x, kind) for x in batch.column(i).to_pylist()]) for i, kind in enumerate((np.int64, np.int32, np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(near), pa.array(best)], names=["_rid", "cluster", "distance"])


def cluster(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: str = "2", width: int = WIDTH, slice_rows: int = ROWS
) -> DataFrame:
    """Rows with a usable vector, with cluster, distance, cluster_inertia, inertia and centroid_sha256.

    A vector is usable if it has ``dims`` components, none null, NaN or infinite; each component x counts as
    floor(scale * x), held to ``LARGEST``.  The k vectors with the least SHA-256 of ``seed:key`` start the clusters,
    all of them if there are fewer; a null key comes last, and of equal keys the lesser vector first.  Every row is a
    vector of its own, also a repeated one.  No usable row makes an empty result.  Columns of the input with the added
    names are replaced.  The driver holds k * dims numbers.
    """
    added = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    own = [c for c in rows.columns if c not in added]
    v = F.col(f"`{vector}`").cast("array<double>")
    fit = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.filter(F.coalesce(fit, F.lit(False))).select(
        F.monotonically_increasing_id().alias("_rid"), F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{key}`").cast("string")), 256).alias("_hash"), v.alias("_vector"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row")
    )
    kept = _store.table(kept, "vectors")
    blocks = _store.table(kept.select("_rid", "_vector").mapInArrow(_cut(dims, width, scale, slice_rows), "slice long, block int, data binary"), "vector-blocks")
    first = kept.orderBy(F.col("_hash").asc_nulls_last(), "_vector").limit(k).select("_vector").collect()
    with np.errstate(over="ignore"):
        start = np.clip(np.floor(np.array([r[0] for r in first], dtype=np.float64).reshape(len(first), dims) * scale), -LARGEST, LARGEST).astype(np.int64)
    if not len(start):
        return kept.select("_row.*", *[F.lit(None).cast(kind).alias(c) for c, kind in zip(added, ("int", "long", "long", "long", "string"), strict=True)])
    centroids = {i: start[:, at : at + width] for i, at in enumerate(range(0, dims, width))}
    for _ in range(rounds):
        centroids |= _update(blocks, _assign(blocks, centroids), centroids)
    numbers = blocks.filter("block = -1").select(F.col("slice").alias("_s"), F.col("data").alias("rid"))
    last = _assign(blocks, centroids).join(numbers, F.col("slice") == F.col("_s")).select("rid", "cluster", "distance")
    placed = _store.table(last.mapInArrow(_spread, "_rid long, cluster int, distance long"), "assigned-vectors")
    inertia = {r[0]: r[1] for r in placed.groupBy("cluster").agg(F.sum("distance")).collect()}
    whole = np.concatenate([centroids[i] for i in sorted(centroids)], axis=1)
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in whole.tolist()]
    table = [(c, inertia[c], sum(inertia.values()), digest[c]) for c in sorted(inertia)]
    named = rows.sparkSession.createDataFrame(table, "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = kept.select("_rid", "_row").join(placed, "_rid").join(F.broadcast(named), F.col("cluster") == F.col("_cluster"))
    return out.select("_row.*", *added)
