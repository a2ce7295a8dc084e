"""Connected components of an edge table by union-find within partitions and hops between them.

A round deals edges by their greater node, so that a task sees every way down from its nodes; union-find within
the task hangs all that its edges connect below one least node.  Before the next round every node hops on to the
parent of its parent.  Rounds are written as tables; a few numbers a partition tell when nothing changes.  Before
the first round edges are contracted where they lie, a bounded number at a time.  Edges never become more, no node's
children are gathered in one task, and the hop is a join of two tables, whose hot parents Spark splits.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notequery.llm import _store

#: A node, its parent, whether the node's own task says so, and, in one row a task, what changed and how many rows are not a task's own.
_STAR = "a long, b long, own boolean, changed long, foreign long"
#: Edges that are contracted at a time before the first round.
CHUNK = 1 << 20


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted nodes of some edges, the place of each node's least connected one, and the places of a."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        if (low == high).all():
            return nodes, root, i
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def _contract(batches):
    """A forest of every ``CHUNK`` edges or so of a partition, each node below its least connected one."""
    held, n = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            n += batch.num_rows
        if n and (batch is None or n >= CHUNK):
            nodes, root, _ = _forest(*(np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(2)))
            child = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[root[child]])], names=["a", "b"])
            held, n = [], 0


def _union(batches):
    parts = list(batches)
    if not sum(x.num_rows for x in parts):
        return
    a, b, moved = (np.concatenate([x.column(k).to_numpy(zero_copy_only=False) for x in parts]) for k in range(3))
    nodes, root, at = _forest(a, b)
    child = np.flatnonzero(root != np.arange(len(nodes)))
    mine = np.zeros(len(nodes), dtype=bool)
    mine[at] = True
    own = mine[child]
    counts = [np.zeros(len(child), dtype=np.int64) for _ in range(2)]
    if len(child):
        counts[0][0] = int(moved.sum()) + int((nodes[root[at]] != b).sum())
        counts[1][0] = int((~own).sum())
    columns = [pa.array(nodes[child]), pa.array(nodes[root[child]]), pa.array(own), *map(pa.array, counts)]
    yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "own", "changed", "foreign"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component), the component's least node, of every node of (a, b) that is not itself the least.

    Loops (a = a) and repeated edges don't matter; no edges make an empty table.
    """
    rows = edges.filter("a <> b").select("a", "b").mapInArrow(_contract, "a long, b long").withColumn("moved", F.lit(False))
    foreign = 1
    while True:
        stars = _store.table(rows.repartition("a").mapInArrow(_union, _STAR), "stars")
        row = stars.agg(F.coalesce(F.sum("changed"), F.lit(0)), F.coalesce(F.sum("foreign"), F.lit(0))).first()
        if not row[0] and not row[1] and not foreign:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
        foreign = row[1]
        up = stars.filter("own").select(F.col("a").alias("_c"), F.col("b").alias("_up"))
        rows = stars.join(up, F.col("b") == F.col("_c"), "left").select("a", F.coalesce("_up", "b").alias("b"), F.col("_up").isNotNull().alias("moved"))
