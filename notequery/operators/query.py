"""Query texts to clause tables, and questions to terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notequery.functions import text as x

#: Tokens of a query that count.
MOST_TOKENS = 32
#: Openings of a question that say nothing about its subject, longest match first.
FRAMES = [
    "do i have anything written about", "do i have anything about", "what do my notes say about", "what did i say about",
    "what did i write about", "what have i written about", "what did i note about", "where did i write about",
    "where did i mention", "when did i write about", "when did i note", "can you tell me about",
    "can you find anything about", "tell me about", "find me anything about", "find anything about",
    "search my notes for", "look up", "what about", "what is", "what are", "what was", "where is", "where are", "who is", "how do i",
]
#: Words that a question's terms leave out.
STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "if", "of", "to", "in", "on", "at", "by", "for", "with", "about", "into", "from",
    "as", "is", "are", "was", "were", "be", "been", "being", "do", "does", "did", "have", "has", "had", "i", "me", "my",
    "we", "our", "you", "your", "it", "its", "that", "this", "there",
]


def clauses(queries: DataFrame) -> DataFrame:
    """(qid, clause, negated, prefix, tokens) of every (qid, text).

    Words are joined by and; "phrases" are one clause, open quotes run to the end; before a word a leading - negates,
    after it a trailing * asks for a prefix (around a phrase they say nothing), and what holds no letter or digit is
    dropped.  A query of negations only has no clauses.
    """
    found = F.filter(F.regexp_extract_all("text", F.lit(r'"[^"]*"?|[^\s"]+'), 0), lambda t: ~F.regexp_like(t, F.lit(r'^"\s*"?$')))
    rows = queries.select("qid", F.posexplode(F.slice(found, 1, MOST_TOKENS)).alias("clause", "raw"))
    word = ~F.startswith("raw", F.lit('"'))
    rows = rows.select(
        "qid", "clause", (word & F.regexp_like("raw", F.lit("^-."))).alias("negated"), (word & F.regexp_like("raw", F.lit(r"[^-]\*$|-.*.\*$"))).alias("prefix"), x.words(F.translate("raw", '():^"*', "")).alias("tokens")
    ).filter(F.size("tokens") > 0)
    positive = F.max((~F.col("negated")).cast("int")).over(Window.partitionBy("qid"))
    return rows.withColumn("_p", positive).filter("_p = 1").drop("_p")


def question_terms(question: Column, keep_phrases: bool = False) -> Column:
    """The terms of a question: without its frame, stop words and closing punctuation; all words if none is left.

    Quoted phrases count as their words, stop words among them too; with ``keep_phrases`` each is one term in quotes.
    """
    cleaned = F.trim(F.regexp_replace(F.lower(F.trim(question)), r"[?!.,]+$", ""))
    phrases = F.flatten(F.transform(F.regexp_extract_all(cleaned, F.lit(r'"([^"]*)"'), 1), lambda p: F.split(F.trim(p), r"\s+")))
    frames = "|".join(sorted(FRAMES, key=len, reverse=True))
    rest = F.trim(F.regexp_replace(cleaned, rf"^(?:{frames})(?= |$)", ""))

    def tokens(text: Column) -> Column:
        bare = F.transform(F.split(text, r'[\s"]+'), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}\-'.]+|[^\p{L}\p{N}\-'.]+$", ""))
        return F.filter(bare, lambda w: w != "")

    if keep_phrases:
        whole = F.transform(F.regexp_extract_all(rest, F.lit(r'"[^"\s][^"]*"'), 0), lambda p: p)
        loose = F.filter(tokens(F.regexp_replace(rest, r'"[^"]*"?', " ")), lambda w: ~w.isin(STOP_WORDS))
        kept = F.concat(whole, loose)
    else:
        kept = F.filter(tokens(rest), lambda w: ~w.isin(STOP_WORDS) | F.array_contains(phrases, w))
    return F.when(F.size(kept) > 0, kept).otherwise(tokens(cleaned))
