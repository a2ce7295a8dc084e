"""Toxicity by a linear-chain conditional random field.

Documents carry labels, words don't: words that stand in toxic documents far more often than in clean ones are
labelled there, and so are those whose beginnings do; a two-label chain learns from these labelled words.  A word's
features are itself, its first and its last bytes, so that the chain knows such words by their spelling too, and by their company through its
transitions (neighbours as features were tried and made held-out scores worse).  Forward-backward marginals over whole documents add up to a document's score and show the offending offsets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notequery.llm import _store
from notequery.llm import _text as t

#: Labelled documents of each class that fitting looks at, bytes of their texts, feature weights, and words that are swept together.
DOCUMENTS, BYTES, BUCKETS, SWEEP = 3000, 2_000_000, 1 << 18, 64
#: Features of a word: itself, its first 3, 5 and 7 bytes and its last 3.  A word or a beginning of 5 or 7 bytes can be suspect.
FEATURES, SUSPECT = 5, (0, 2, 3)
#: How much likelier, in nats, toxic documents hold what is suspect: at least by so much, and less so many deviations still.
LIFT, DEVIATIONS = 1.2, 1.5
_ROUNDS, _PENALTY, _BIAS = 60, 2e-4, -3.0


def words(data: np.ndarray, offsets: np.ndarray):
    """Features (FEATURES by words), start and end of each word in lower case, and the first word of each row."""
    starts, ends, bounds = t.words(data, offsets, t.ALNUM)
    sums = t.prefix(t.LOWER[data])
    own = t.span(sums, starts, ends)
    kinds = (own, *(t.span(sums, starts, np.minimum(starts + k, ends)) for k in (3, 5, 7)), t.span(sums, np.maximum(ends - 3, starts), ends))
    found = [(t.mix(x ^ np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(46)).astype(np.int32) for k, x in enumerate(kinds)]
    return np.stack(found), starts, ends, bounds


def chain(emission: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals by forward-backward over whole documents that follow each other; ``first`` marks where each begins.

    Returns for each word the chance that it is toxic, the odds of toxic to clean by all words up to it, and those by
    it and all after it.  Words are swept ``SWEEP`` at a time in many places at once: the transition matrices of
    each stretch are multiplied first, and the products carry the messages from stretch to stretch, so that no
    document is cut.  A beginning is a matrix that forgets what was before.
    """
    n, a = len(emission), np.exp(moves)
    rows = -(-n // SWEEP)
    e, new = np.ones((rows, SWEEP)), np.ones((rows, SWEEP), dtype=bool)
    e.ravel()[:n] = np.exp(np.clip(emission, -30, 30))
    new.ravel()[:n] = first
    m = np.zeros((rows, 4))
    m[:, [0, 3]] = 1.0
    for j in range(SWEEP):
        x, s = e[:, j], new[:, j]
        t00, t01 = np.where(s, 1.0, a[0, 0]), np.where(s, 1.0, a[0, 1]) * x
        t10, t11 = np.where(s, 1.0, a[1, 0]), np.where(s, 1.0, a[1, 1]) * x
        m = np.stack((m[:, 0] * t00 + m[:, 1] * t10, m[:, 0] * t01 + m[:, 1] * t11, m[:, 2] * t00 + m[:, 3] * t10, m[:, 2] * t01 + m[:, 3] * t11), axis=1)
        m /= m.max(axis=1, keepdims=True)
    into, out = np.ones(rows), np.ones(rows)  # odds before each stretch, and of what follows it
    odds = 1.0
    for i, (m00, m01, m10, m11) in enumerate(m.tolist()):
        into[i] = odds
        odds = min(max((m01 + odds * m11) / (m00 + odds * m10), 1e-30), 1e30)
    odds = 1.0
    for i in range(rows - 1, -1, -1):
        out[i] = odds
        m00, m01, m10, m11 = m[i].tolist()
        odds = min(max((m10 + odds * m11) / (m00 + odds * m01), 1e-30), 1e30)
    forward, ahead = np.empty_like(e), np.empty_like(e)
    r = into
    for j in range(SWEEP):
        step = np.where(new[:, j], 1.0, (a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0]))
        forward[:, j] = r = np.clip(e[:, j] * step, 1e-30, 1e30)
    b = out
    for j in range(SWEEP - 1, -1, -1):
        ahead[:, j] = g = e[:, j] * b
        b = np.where(new[:, j], 1.0, (a[1, 0] + g * a[1, 1]) / (a[0, 0] + g * a[0, 1]))
    odds = forward * ahead / e
    return tuple(x.ravel()[:n] for x in (odds / (1 + odds), forward, ahead))


def begins(bounds: np.ndarray) -> np.ndarray:
    """Which words begin a row."""
    out = np.zeros(bounds[-1], dtype=bool)
    out[bounds[:-1][np.diff(bounds) > 0]] = True
    return out


class Model:
    """Feature weights, transition weights (from, to) and the weights of the document score."""

    def __init__(self, weights, moves, score):
        self.weights, self.moves, self.score = weights, moves, score

    def emission(self, found: np.ndarray) -> np.ndarray:
        out = np.full(found.shape[1], _BIAS)
        for kind in found:
            out += self.weights[kind]
        return out

    def marginals(self, found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The chance that each word is toxic."""
        return chain(self.emission(found), begins(bounds), self.moves)[0] if found.shape[1] else np.empty(0)


def features(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row: 1, the log-odds of the likeliest word, log(1 + expected toxic words), and their share of all words."""
    n = np.diff(bounds)
    total = np.concatenate(([0.0], np.cumsum(p)))
    total = total[bounds[1:]] - total[bounds[:-1]]
    top = np.zeros(len(n))
    if (n > 0).any():
        top[n > 0] = np.maximum.reduceat(p, bounds[:-1][n > 0])
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(len(n)), np.log(top / (1 - top)), np.log1p(total), 10 * total / np.maximum(n, 20)], axis=1)


def _learn(found: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, share: float) -> Model:
    """Fit on the words of a bounded sample of documents; share is that of toxic ones among all labelled."""
    rows = np.repeat(np.arange(len(toxic)), np.diff(bounds))
    size = [max(1, int((toxic == label).sum())) for label in (0, 1)]
    marked = np.zeros(found.shape[1], dtype=bool)
    for kind in SUSPECT:
        pairs = np.unique(rows * BUCKETS + found[kind])
        known = [np.bincount(pairs[toxic[pairs // BUCKETS] == label] % BUCKETS, minlength=BUCKETS) for label in (0, 1)]
        odds = [np.log((k + 0.5) / (s - k + 0.5)) for k, s in zip(known, size, strict=True)]
        spread = np.sqrt(sum(1 / (k + 0.5) + 1 / (s - k + 0.5) for k, s in zip(known, size, strict=True)))
        suspects = (odds[1] - odds[0] - DEVIATIONS * spread > LIFT) & (known[1] >= max(3, 0.004 * size[1]))
        marked |= suspects[found[kind]]
    y = marked & (toxic[rows] == 1)
    first, n = begins(bounds), max(1, found.shape[1])
    model = Model(np.zeros(BUCKETS), np.zeros((2, 2)), np.zeros(4))
    state = [np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros((2, 2)), np.zeros((2, 2))]
    inner = np.flatnonzero(~first[1:])
    seen = np.bincount(2 * y[inner] + y[inner + 1], minlength=4).reshape(2, 2)
    for step in range(1, _ROUNDS + 1 if n > 1 else 1):
        p, forward, ahead = chain(model.emission(found), first, model.moves)
        slope_w = _PENALTY * model.weights / BUCKETS
        for kind in found:
            slope_w += np.bincount(kind, weights=p - y, minlength=BUCKETS) / n
        a, r, g = np.exp(model.moves), forward[inner], ahead[inner + 1]
        both = np.stack([np.full_like(r, a[0, 0]), a[0, 1] * g, a[1, 0] * r, a[1, 1] * r * g])
        both /= both.sum(axis=0)
        slope_m = (both.sum(axis=1).reshape(2, 2) - seen) / n + _PENALTY * model.moves
        for value, slope, i, rate in ((model.weights, slope_w, 0, 0.15), (model.moves, slope_m, 2, 0.05)):
            state[i] = 0.8 * state[i] + 0.2 * slope
            state[i + 1] = 0.95 * state[i + 1] + 0.05 * slope**2
            value -= rate * (state[i] / (1 - 0.8**step)) / (np.sqrt(state[i + 1] / (1 - 0.95**step)) + 1e-7)
    model.weights = model.weights.astype(np.float32)
    x = features(model.marginals(found, bounds), bounds)
    theta = np.zeros(4)
    for _ in range(25):  # Newton's method for the document score
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (p - toxic) + 1e-2 * len(toxic) / 100 * theta
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * len(toxic) / 100 * np.eye(4)
        theta -= np.linalg.solve(curve, slope)
    rest = size[1] / (size[0] + size[1])
    theta[0] += np.log(max(share, 1e-6) / max(1 - share, 1e-6)) - np.log(rest / (1 - rest))
    model.score = theta
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", documents: int = DOCUMENTS, size: int = BYTES) -> Model:
    """Learn from labels (key, label 0 or 1) joined to docs; rows with nulls don't count.

    Of each class, documents are taken whole in order of the hash of their key, at most ``documents`` of them and
    while their texts fit into ``size`` bytes (the first one always), so what reaches the driver is bounded.  A key
    with several labels counts as toxic if any says so, one with several texts by the one of the least hash.
    Without labelled texts of both classes every document scores 0.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    texts = docs.filter(F.col(text).isNotNull()).select(F.col(f"`{key}`").alias("_k"), F.xxhash64(F.col(f"`{text}`")).alias("_hash"), F.octet_length(F.col(f"`{text}`")).cast("long").alias("_size"))
    known = known.join(texts, F.col("_key") == F.col("_k")).groupBy("_key", "_label").agg(F.min(F.struct("_hash", "_size")).alias("_t"))
    known = _store.table(known.select("_key", "_label", "_t._hash", "_t._size"), "labelled")
    sizes = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    if len(sizes) < 2:
        return Model(np.zeros(BUCKETS, dtype=np.float32), np.zeros((2, 2)), np.array([-30.0, 0, 0, 0]))
    order = [F.xxhash64("_key"), F.col("_key")]
    chosen = known.filter("_label = 1").orderBy(*order).limit(documents).unionByName(known.filter("_label = 0").orderBy(*order).limit(documents))
    each = Window.partitionBy("_label").orderBy(*order)
    chosen = chosen.withColumn("_upto", F.sum("_size").over(each)).withColumn("_n", F.row_number().over(each)).filter((F.col("_upto") <= size) | (F.col("_n") == 1))

    rows = docs.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(chosen.select("_key", "_label", "_hash")), (F.col("_k") == F.col("_key")) & (F.xxhash64("_text") == F.col("_hash")))
    found = rows.select(F.xxhash64("_key").alias("_h"), "_key", "_label", "_text").toArrow().to_pylist()
    # One row a key; the order in which tasks end must not matter.
    once = sorted({r["_key"]: r for r in found}.values(), key=lambda r: (r["_label"], r["_h"], r["_text"]))
    toxic = np.array([r["_label"] for r in once], dtype=np.int64)
    parts, bounds = [np.empty((FEATURES, 0), dtype=np.int32)], [np.zeros(1, dtype=np.int64)]
    for _, _, data, offsets in t.slices(pa.array([r["_text"] for r in once], pa.large_string())):
        own, _, _, rows_ = words(data, offsets)
        parts.append(own)
        bounds.append(rows_[1:] + bounds[-1][-1])
    return _learn(np.concatenate(parts, axis=1), np.concatenate(bounds), toxic, sizes[1] / (sizes[0] + sizes[1]))


def score(docs: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """All rows with ``score`` (0 to 1), ``predicted`` (1 if score >= 0.5) and ``spans``.

    Spans are (start, end) in UTF-8 bytes of neighbouring words that are toxic with a chance of ``limit`` or more.
    Null and empty texts have no words, no spans and the score of a text without any suspicion; equal texts score
    alike; a text of any length is one chain; an empty table stays empty; columns with the added names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ("score", "predicted", "spans")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        own = shared.value
        for batch in batches:
            chance, spans = [], [[] for _ in range(batch.num_rows)]
            for low, _, data, offsets in t.slices(batch.column(batch.num_columns - 1)):
                found, starts, ends, bounds = words(data, offsets)
                p = own.marginals(found, bounds)
                chance.append(1 / (1 + np.exp(-np.clip(features(p, bounds) @ own.score, -30, 30))))
                last = -2
                for i in np.flatnonzero(p >= limit).tolist():
                    row = int(np.searchsorted(bounds, i, side="right")) - 1
                    a, b = int(starts[i] - offsets[row]), int(ends[i] - offsets[row])
                    if last == i - 1 and spans[low + row]:
                        spans[low + row][-1]["end"] = b
                    else:
                        spans[low + row].append({"start": a, "end": b})
                    last = i
            chance = np.concatenate(chance) if chance else np.empty(0)
            columns = [*batch.columns[:-1], pa.array(chance), pa.array((chance >= 0.5).astype(np.int32)), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *added])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    schema = _store.extended(rows.select("_row"), "score double, predicted int, spans array<struct<start: bigint, end: bigint>>")
    return rows.mapInArrow(run, schema).select("_row.*", *added)
