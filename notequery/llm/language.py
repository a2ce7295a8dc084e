"""Language identification by multilingual mixture inference.

A language is a distribution over hashed n-grams of bytes.  A document is a mixture of languages: expectation
maximisation finds the shares that make its n-grams likeliest, and languages leave the set one by one as long as
that raises the likelihood less half of log(n-grams) for each language kept.  How much likelier the chosen mixture
makes a document than uniform noise is the evidence that it is text in any of the languages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notequery.llm import _store
from notequery.llm import _text as t

#: Fitting looks at about this many distinct texts of a language at most; the model is this many 4-byte numbers a language.
TEXTS, BUCKETS = 1500, 8192
UNDETERMINED = "und"
_ROUNDS, _LETTER = 12, regex.compile(r"\p{L}")
_FOLD = np.where(t.ALNUM, t.LOWER, 0x20).astype(np.uint8)
_FOLD[0x30:0x3A] = 0x20


def _buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the three bytes from each place on: letters in lower case, all else as space."""
    x = _FOLD[data].astype(np.uint32)
    if len(x) < 3:
        return np.empty(0, dtype=np.int64)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int64)


def _counts(buckets: np.ndarray, start: int, end: int) -> np.ndarray:
    return np.bincount(buckets[start : max(start, end - 2)], minlength=BUCKETS)


class Model:
    """Languages with their n-gram probabilities (BUCKETS by languages)."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.p = ((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS) if len(languages) else counts).astype(np.float32)

    def mixture(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Languages of the chosen set and their shares, largest first, and the evidence against uniform noise in nats."""
        used = np.flatnonzero(counts)
        chosen = np.arange(len(self.languages))
        if not len(used):
            return chosen[:1], np.full(1, 1.0 / max(1, len(chosen))), 0.0
        c, p = counts[used].astype(np.float64), self.p[used].astype(np.float64)
        n = c.sum()
        share, fit = self._fit(c, p, np.full(len(chosen), 1.0 / len(chosen)))
        price = 0.5 * np.log(n + 1)
        while len(chosen) > 1:
            keep = np.sort(np.argsort(-share, kind="stable")[:-1])
            less, worse = self._fit(c, p[:, keep], share[keep] / max(share[keep].sum(), 1e-12))
            if worse + price < fit:
                break
            chosen, share, p, fit = chosen[keep], less, p[:, keep], worse
        order = np.argsort(-share, kind="stable")
        return chosen[order], share[order], float(fit + n * np.log(BUCKETS))

    @staticmethod
    def _fit(c: np.ndarray, p: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
        n = c.sum()
        if p.shape[1] == 1:
            return np.ones(1), float(c @ np.log(p[:, 0]))
        for _ in range(_ROUNDS):
            new = share * ((c / (p @ share)) @ p) / n
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
        return share, float(c @ np.log(p @ share))


def fit(labelled: DataFrame, text: str, lang: str, texts: int = TEXTS) -> Model:
    """Learn from (text, lang); rows without either don't count.  A language's distinct texts are chosen by their hash.

    About ``texts`` distinct texts of each language are looked at, which is the only thing that doesn't grow with the
    data; every language that stands in ``lang`` is learned.  N-grams are counted by Spark, and the model takes 32 KB
    a language.  A text that repeats counts once; an empty table gives a model without languages.
    """
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.empty((BUCKETS, 0)))
    chances = labelled.sparkSession.createDataFrame([(k, min(1.0, texts / sizes[k])) for k in languages], "lang string, chance double")
    place = F.pmod(F.xxhash64("text"), F.lit(1_000_000_007)) / 1_000_000_007.0
    sample = rows.join(F.broadcast(chances), "lang").filter(place < F.col("chance")).select("text", "lang").dropDuplicates(["lang", "text"])

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            for low, high, data, offsets in t.slices(batch.column(0)):
                found = _buckets(data)
                for i in range(low, high):
                    total.setdefault(names[i], np.zeros(BUCKETS, dtype=np.int64))
                    total[names[i]] += _counts(found, offsets[i - low], offsets[i - low + 1])
        for name, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["lang", "bucket", "n"])

    sums = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((BUCKETS, len(languages)))
    column = {k: i for i, k in enumerate(languages)}
    counts[sums["bucket"].to_numpy(), [column[x] for x in sums["lang"].to_pylist()]] = sums["n"].to_numpy()
    return Model(languages, counts)


def identify(docs: DataFrame, model: Model, text: str = "text", lettered: str | None = None) -> DataFrame:
    """All rows with ``lang_pred``, ``score`` (its share), ``languages``, a list of (lang, share), and ``evidence``.

    ``evidence`` tells by how many nats the mixture makes the whole text likelier than uniform noise does; it is below
    0 for what is no text in any learned language.  ``und`` with score and evidence 0 and no languages if the text is
    null or has no letter, or nothing was learned.  A column named by ``lettered`` tells, whatever was learned,
    whether the text has a letter.  Equal texts get equal results; a text of any length is counted as a whole; an
    empty table stays empty; columns of the input with the added names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ("lang_pred", "score", "languages", "evidence", *([lettered] if lettered else []))
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches):
        own = shared.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            lang, score, mixed, evidence = [], [], [], []
            has = [bool(x and _LETTER.search(x)) for x in column.to_pylist()]
            for low, high, data, offsets in t.slices(column):
                found = _buckets(data)
                for i in range(low, high):
                    if not own.languages or not has[i]:
                        lang.append(UNDETERMINED), score.append(0.0), mixed.append([]), evidence.append(0.0)
                        continue
                    chosen, share, gain = own.mixture(_counts(found, offsets[i - low], offsets[i - low + 1]))
                    lang.append(own.languages[chosen[0]])
                    score.append(min(1.0, float(share[0])))
                    mixed.append([{"lang": own.languages[k], "share": float(s)} for k, s in zip(chosen, share, strict=True)])
                    evidence.append(gain)
            columns = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(mixed, kind), pa.array(evidence, pa.float64()), *([pa.array(has, pa.bool_())] if lettered else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *added])

    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    schema = _store.extended(rows, "lang_pred string, score double, languages array<struct<lang: string, share: double>>, evidence double" + (f", `{lettered}` boolean" if lettered else ""))
    return docs.select(*[F.col(f"`{c}`") for c in rows.columns], F.col(f"`{text}`").alias(_store.unused(docs))).mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: a fifth of all keys; a null key counts as the text ''."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 5 == 0
