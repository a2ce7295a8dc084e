"""Column expressions over text: size in tokens, randomness, excerpts, terms."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of text that stands for a credential.
PLACEHOLDERS = [
    "your_", "your-", "yourtoken", "yourkey", "example", "placeholder", "changeme", "redacted", "insert", "replace", "todo", "xxxx", "....", "<", "${", "{{",
]
_SMALL = "abcdefghijklmnopqrstuvwxyz"
#: Small letters that are, in canonical decomposition, a to z and marks; and what they count as.  A final sigma is a sigma, a long s an s.
_PARTS = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x2000)]
ACCENTED, PLAIN = (
    "".join(x) for x in zip(*[(c, d[0]) for c, d in _PARTS if len(d) > 1 and d[0] in _SMALL and all(map(unicodedata.combining, d[1:]))], ("\u03c2", "\u03c3"), ("\u017f", "s"), strict=True)
)
MARKS, WORD = "[\u0300-\u036f]", r"[^\p{L}\p{N}\p{Co}]+"


def tokens(text: Column) -> Column:
    """Estimated tokens: characters over 3.6, rounded up."""
    return F.ceil(F.char_length(text) / F.lit(3.6)).cast("int")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; 0 for empty text."""

    def of(chars: Column) -> Column:
        shares = F.transform(F.array_sort(F.array_distinct(chars)), lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars))
        return F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))

    # An array of one holds the characters, so that they are not cut anew for each of them.
    return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit("(?s)."), 0)), of), F.lit(0))


def looks_random(value: Column) -> Column:
    """Whether a value is long, mixed and random enough for a generated secret."""
    x = F.regexp_replace(value, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    n = F.char_length(x)
    mixed = (F.regexp_like(x, F.lit("[0-9]")) & F.regexp_like(x, F.lit(r"\p{L}"))) | F.regexp_like(x, F.lit(r"[^\p{L}\p{N}]"))
    return (n >= 12) & mixed & ((entropy(x) > 3.0) | ((n >= 20) & (entropy(x) > 2.5)))


def placeholder(value: Column) -> Column:
    """Whether a matched text only stands for a credential."""
    low = F.lower(value)
    found = F.lit(False)
    for mark in PLACEHOLDERS:
        found = found | F.contains(low, F.lit(mark))
    return found


def snippet(text: Column, terms: Column, width: int = 220) -> Column:
    """`width` characters around the earliest term, a third of them before it; … marks a cut end."""
    places = F.filter(F.transform(terms, lambda x: F.instr(F.lower(text), F.lower(x))), lambda p: p > 0)
    at = F.coalesce(F.array_min(places), F.lit(1))
    start = F.greatest(F.lit(1), at - width // 3)
    before = F.when(start > 1, "…").otherwise("")
    after = F.when(start + width <= F.char_length(text), "…").otherwise("")
    return F.concat(before, F.trim(F.substring(text, start, F.lit(width))), after)


def highlight(text: Column, terms: Column) -> Column:
    """Text with every term of two characters or more in <mark>, longest first, in any case."""
    long = F.filter(terms, lambda x: F.char_length(x) > 1)
    ordered = F.transform(F.array_sort(F.transform(long, lambda x: F.struct((-F.char_length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])
    escaped = F.transform(ordered, lambda x: F.regexp_replace(x, r"([\\.\[\]{}()*+?^$|])", r"\\$1"))
    pattern = F.concat(F.lit("(?i)("), F.array_join(escaped, "|"), F.lit(")"))
    return F.when(F.size(long) > 0, F.regexp_replace(text, pattern, F.lit("<mark>$1</mark>"))).otherwise(text)


def words(text: Column) -> Column:
    """Words in order, in lower case and without marks, however these are spelt: letters, digits and private characters make words."""
    low = F.lower(text)
    folded = F.regexp_replace(F.translate(low, ACCENTED, PLAIN), MARKS, "")
    ascii_ = F.octet_length(text) == F.char_length(text)
    return F.filter(F.split(F.when(ascii_, low).otherwise(folded), WORD), lambda x: x != "")
