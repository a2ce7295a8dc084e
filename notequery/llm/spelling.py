"""Spelling variants of words, by products of letter counts.

A word is the counts of its letters.  The matrix product of two blocks of words gives the squared distances of all
their counts at once: replacing a letter makes 2, putting one in or taking one out 1, so that pairs at more than 2 are
no single edit, and only the rest is compared letter by letter.

Blocks hold words that have equally many letters of each of four kinds (a letter's kind is its code modulo 4), which
settles their length.  An edit moves a word to one of few neighbours: one letter more of a kind, or one of a kind less
and of another more.  Every word goes to its own block and to those neighbours above it, so that each pair meets once.
Large blocks are cut into parts by hash, and so are those that come to visit, so that no task holds more than ``PART``
words of either.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notequery.llm import _store

RUN = "[A-Za-zÀ-ÿ]+"
KINDS = 4
#: Words, and letters of words, in a part of a block; distinct words that a task counts before it passes them on.
PART, LETTERS, HELD = 2048, 1 << 22, 200_000
#: Characters of a text in which words are sought at a time.
PIECE = 1 << 20


def runs(text: str):
    """Counters of the runs of letters of a text, A-Z in lower case, piece by piece; a run is never cut."""
    found, end = re.compile(RUN), re.compile("[^A-Za-zÀ-ÿ]")
    low, at = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), 0
    while at < len(low):
        cut = end.search(low, at + PIECE)
        stop = cut.start() if cut else len(low)
        yield Counter(found.findall(low, at, stop))
        at = stop


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 7, times: int = 2, drop: int | None = None) -> DataFrame:
    """(word, n): runs of letters of ``least`` code points that occur ``times`` times, over all texts.

    With ``drop``, a run loses the code point h % length where drop divides h, the CRC-32 of ``key:run``; a null key
    reads ``null``.  Null and empty texts have no words.
    """

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for one, body in zip(batch.column(0), batch.column(1), strict=True):
                before = zlib.crc32(f"{one.as_py() if one.is_valid else 'null'}:".encode())
                for found in runs(body.as_py() or ""):
                    for word, n in found.items():
                        if len(word) >= least:
                            if drop and not (h := zlib.crc32(word.encode(), before)) % drop:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < least:
                                    continue
                            total[word] += n
                    if len(total) > HELD:
                        yield _counted(total)
                        total.clear()
        yield _counted(total)

    found = docs.select(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def _counted(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])


def _of_kinds(word: Column) -> list[Column]:
    """How many letters of each kind a word has; what is no letter of ``RUN`` is of kind 0."""
    letters = [*range(0x61, 0x7B), *range(0x41, 0x5B), *range(0xC0, 0x100)]
    some = [F.char_length(F.regexp_replace(word, f"[^{''.join(chr(c) for c in letters if c % KINDS == k)}]", "")) for k in range(1, KINDS)]
    return [F.char_length(word) - sum(some[1:], some[0]), *some]


def _name(kinds: list[Column]) -> Column:
    return F.concat_ws(",", *[k.cast("string") for k in kinds])


def _neighbours(kinds: list[Column]) -> Column:
    """The blocks above a word's own that an edit leads to."""
    longer = [[c + 1 if i == k else c for i, c in enumerate(kinds)] for k in range(KINDS)]
    same = [[c - 1 if i == a else c + 1 if i == b else c for i, c in enumerate(kinds)] for a, b in combinations(range(KINDS), 2)]
    return F.array(*[_name(x) for x in longer + same])


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _letters(codes: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """How often each letter of an alphabet stands in each row."""
    place = np.searchsorted(alphabet, codes) + np.arange(len(codes))[:, None] * len(alphabet)
    return np.bincount(place.ravel(), minlength=len(codes) * len(alphabet)).reshape(len(codes), -1)


def near(left: np.ndarray, right: np.ndarray, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs one edit apart among rows of code points, the left ones as long as the right ones or one shorter."""
    alphabet = np.union1d(left, right)
    kind = np.float32 if right.shape[1] < 2000 else np.float64  # products are exact
    a, b = _letters(left, alphabet).astype(kind), _letters(right, alphabet).astype(kind)
    apart = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    close = (apart <= 2) & (apart > 0)
    i, j = np.nonzero(np.triu(close, 1) if own else close)
    kept, step = [], max(1, LETTERS // right.shape[1])
    for at in range(0, len(i), step):
        x, y = left[i[at : at + step]], right[j[at : at + step]]
        if left.shape[1] == right.shape[1]:
            kept.append((x != y).sum(axis=1) == 1)
        else:  # what agrees from the start and from the end covers the shorter one
            front, back = np.cumprod(x == y[:, :-1], axis=1).sum(axis=1), np.cumprod((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            kept.append(front + back >= x.shape[1])
    good = np.concatenate(kept) if kept else np.zeros(0, dtype=bool)
    return i[good], j[good]


def _meet(part: pa.Table) -> pa.Table:
    """(word, n_near, m, best) of the words of one part of a block and of its visitors: m is minus the best one's n."""
    words, counts = part.column("word").to_pylist(), part.column("n").to_pylist()
    home, inner = part.column("home").to_pylist(), part.column("inner")[0].as_py()
    at = [k for k, h in enumerate(home) if h]
    found: dict[int, list] = {}

    def add(a: int, b: int) -> None:
        one = found.setdefault(a, [0, 1, ""])
        one[0] += 1
        if (-counts[b], words[b]) < (one[1], one[2]):
            one[1:] = -counts[b], words[b]

    if at:
        right, length = _codes([words[k] for k in at]), len(words[at[0]])
        others = [[k for k, h in enumerate(home) if not h and len(words[k]) == n] for n in (length, length - 1)]
        for left, own in ((at if inner else [], True), *((x, False) for x in others)):
            if left:
                for i, j in zip(*near(right if own else _codes([words[k] for k in left]), right, own), strict=True):
                    add(left[i], at[j])
                    add(at[j], left[i])
    rows = [(words[k], *v) for k, v in found.items()]
    columns = zip(*rows, strict=True) if rows else [()] * 4
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "m", "best"])


def neighbours(words: DataFrame, part: int = PART) -> DataFrame:
    """(word, n_near, best, best_n) of the words (word, n) that have others one edit away; best is the commonest, of ties the first."""
    kinds = [F.col(f"_k{k}") for k in range(KINDS)]
    rows = words.select("word", "n", *[c.alias(f"_k{k}") for k, c in enumerate(_of_kinds(F.col("word")))])
    rows = _store.table(rows.select("word", "n", F.char_length("word").alias("size"), _name(kinds).alias("block"), _neighbours(kinds).alias("up")), "spelling-words")
    parts = F.greatest(F.ceil(F.count("*") / part), F.ceil(F.sum("size") / LETTERS), F.lit(1)).cast("int")
    blocks = _store.table(rows.groupBy("block").agg(F.count("*").alias("n"), F.sum("size").alias("size"), parts.alias("parts"), F.first("up").alias("up")), "spelling-blocks")
    # Visitors of a block are the words of the blocks below it and, where it is cut, its own.
    coming = blocks.select(F.explode("up").alias("block"), "n", "size").unionByName(blocks.filter("parts > 1").select("block", "n", "size"))
    coming = coming.groupBy("block").agg(F.greatest(F.ceil(F.sum("n") / part), F.ceil(F.sum("size") / LETTERS)).cast("int").alias("slabs"))
    plan = blocks.select("block", "parts").join(coming, "block", "left").select(F.col("block").alias("_b"), "parts", F.coalesce("slabs", F.lit(1)).alias("slabs"))
    plan = _store.table(plan, "spelling-plan")
    deal = lambda what, n: F.pmod(F.xxhash64(F.lit(what), "word"), n).cast("int")
    at_home = rows.join(plan, F.col("block") == F.col("_b")).withColumn("part", deal("part", F.col("parts")))
    home = at_home.select("_b", "part", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)).alias("slab"), "word", "n", F.lit(True).alias("home"))
    inner = at_home.filter("parts > part + 1").select("_b", F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("part"), deal("slab", F.col("slabs")).alias("slab"), "word", "n", F.lit(False).alias("home"))
    below = rows.select("word", "n", F.explode("up").alias("block")).join(plan, F.col("block") == F.col("_b"))
    below = below.select("_b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), deal("slab", F.col("slabs")).alias("slab"), "word", "n", F.lit(False).alias("home"))
    met = home.unionByName(inner).unionByName(below).withColumn("inner", F.col("slab") == 0)
    found = met.groupBy("_b", "part", "slab").applyInArrow(_meet, "word string, n_near long, m long, best string")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("m", "best")).alias("_first"))
    return found.select("word", "n_near", F.col("_first.best").alias("best"), (-F.col("_first.m")).alias("best_n"))


def variants(words: DataFrame, ratio: int = 10, part: int = PART) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of distinct words (word, n).

    A word's form is its commonest neighbour one edit away, of ties the first in code-point order, if that is ``ratio``
    times as common; root follows forms to the last, which is the word itself where it has none.  Since counts grow by
    the ratio at each step, chains are short.  A table without words stays empty; a word of any length is one word.
    """
    words = _store.table(words.select("word", "n"), "vocabulary")
    found = neighbours(words, part).withColumnRenamed("word", "_w")
    rows = words.join(found, F.col("word") == F.col("_w"), "left")
    common = F.col("best_n") >= ratio * F.col("n")
    rows = rows.select("word", "n", F.when(common, F.col("best")).alias("form"), F.when(common, F.col("best_n")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
    rows = _store.table(rows, "spelling-forms")
    up = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        up = _store.table(up, "spelling-roots")
        above = up.select(F.col("word").alias("_w"), F.col("root").alias("_root"))
        further = up.join(above, F.col("root") == F.col("_w"), "left")
        if not further.filter("_root is not null").limit(1).count():
            break
        up = further.select("word", F.coalesce("_root", "root").alias("root"))
    out = rows.join(up.select(F.col("word").alias("_w"), "root"), F.col("word") == F.col("_w"), "left")
    return out.select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))
