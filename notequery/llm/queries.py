"""The operators applied to the standard tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notequery.llm import _store, decontaminate, imatch, language, lloyd, minhash, mix, phrases, ring, simhash, spelling, suffixes, toxicity, warc

N_SHARDS = 16
WORD = r"[^\x20\x09-\x0D]+"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    docs = _store.table(docs, "ring-rows")
    out = ring.assign(docs, [F.col("doc_id"), F.col("text_crc32")], N_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    index = warc.write(warc.records(pages, F.col("page_id"), F.col("url"), F.col("html")), _store.fresh(spark, "warc"))
    page = lambda c: F.expr(f"cast(nullif(substring({c}, 10), 'null') as long)")
    return warc.read(spark, index).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


ARCHIVE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     q AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
     r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM r
"""


def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    slim = docs.select("doc_id", "source", size.alias("n"))
    out = mix.draw(slim, "source", F.col("n"), [F.col("doc_id"), F.col("n")], weights=[3, 1, 2], share=1.5, cap=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
s1 AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS cap FROM s0),
s2 AS (
  SELECT *, coalesce(sum(cap) OVER before, 0.0::DOUBLE) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0::DOUBLE) AS rest_weight,
         1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget
  FROM s1 WINDOW before AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (budget - capped) / rest_weight AS level, row_number() OVER (ORDER BY cap / weight, source IS NULL, source) AS k FROM s2),
s4 AS (SELECT *, (SELECT arg_min(level, k) FROM s3 WHERE level * weight <= cap) AS fixed FROM s3),
s5 AS (SELECT source, source_size, greatest(1, source_size // n) AS mean, least(cap, coalesce(fixed * weight, cap)) AS target FROM s4),
s6 AS (
  SELECT s5.*, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
         (SELECT CASE WHEN sum(size) > 0 THEN (sum(((size * 1000000) // (size + mean))::HUGEINT * size) // sum(size))::BIGINT ELSE 0 END
          FROM d WHERE d.source IS NOT DISTINCT FROM s5.source) AS centre
  FROM s5),
j AS (
  SELECT doc_id, size, source_size, target, whole, d.source, target - whole * source_size AS rest,
         (target - whole * source_size) / greatest(1, source_size) AS part, ((size * 1000000) // (size + mean) - centre) AS tilt,
         md5(concat_ws(chr(31), 'mix', coalesce(doc_id::VARCHAR, '\N'), size::VARCHAR)) AS place
  FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
k AS (
  SELECT *, (('0x' || substr(place, 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u,
         part + part * (1 - part) * tilt / 1000000.0::DOUBLE AS chance FROM j),
r AS (SELECT *, CASE WHEN rest > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS rank FROM k),
t AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM r)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN rank IS NOT NULL AND before < rest AND 2 * (rest - before) >= size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM t
"""


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.report(docs, _read(spark, sf_dir, "benchmark"), n=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


DECONTAMINATION_SQL = r"""
WITH RECURSIVE fold AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents, fold),
i AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark, fold),
g AS (SELECT item_id, least(10, len(w)) AS n, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0),
gw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS x FROM g),
sizes AS (SELECT DISTINCT n FROM gw),
dw AS (SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT rid, p, dw.n, item_id FROM (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS x FROM dw) dw JOIN gw ON gw.n = dw.n AND gw.x = dw.x),
words AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hit) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""


def repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrases.remove(_read(spark, sf_dir, "documents").select("doc_id", "text"), length=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


PHRASES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT rid, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS x FROM p),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY x) AS n FROM h) WHERE n > 1),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS i FROM r),
k AS (SELECT d.rid, u.i, w[u.i] AS word FROM d, unnest(range(1, len(w) + 1)) u(i)),
j AS (SELECT k.rid, string_agg(word, ' ' ORDER BY k.i) AS kept, count(*) AS n FROM k LEFT JOIN c ON c.rid = k.rid AND c.i = k.i WHERE c.rid IS NULL GROUP BY k.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN j USING (rid)
"""


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove(_read(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SUFFIX_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT rid, doc_id, x, (length(x) // 2)::BIGINT AS n FROM d),
p AS (SELECT rid, unnest(range(0, n - 199)) AS i, x FROM s WHERE n >= 200),
h AS (SELECT rid, i, md5(substr(x, 2 * i + 1, 400)) AS y FROM p),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY y) AS c FROM h) WHERE c > 1),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run FROM (
        SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM r)),
m AS (SELECT rid, run, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY rid, run),
gap AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM m),
kept AS (
  SELECT s.rid, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS k,
         sum(b - a)::BIGINT AS gone, count(*) AS spans
  FROM gap JOIN s USING (rid) GROUP BY s.rid)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM s LEFT JOIN kept USING (rid)
"""

def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language.fit(docs.filter(~language.held_out(F.col("doc_id"))), "text", "lang")
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").filter(~language.held_out(F.col("doc_id")))
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = imatch.against_edits(docs, imatch.lexicon(docs))
    return out.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.cluster(_read(spark, sf_dir, "documents").select("doc_id", "text"), size=5, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT DISTINCT rid, x FROM (
  SELECT rid, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS x FROM (SELECT rid, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
e AS (SELECT a.rid AS a, b.rid AS b FROM g a JOIN g b ON a.x = b.x AND a.rid <> b.rid GROUP BY a.rid, b.rid
      HAVING 100 * count(*) >= 85 * ((SELECT n FROM n WHERE rid = a.rid) + (SELECT n FROM n WHERE rid = b.rid) - count(*))),
reach AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
c AS (SELECT a AS rid, min(doc_id) AS component_id FROM reach JOIN d ON d.rid = reach.b GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)
"""


def simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.cluster(_read(spark, sf_dir, "documents").select("doc_id", "text"), size=3, differ=2)
    return out.select("doc_id", "fingerprint", "component_id")


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lloyd.cluster(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), dims=64, k=40, rounds=5, scale=256, seed="2")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _nearest_sql(rounds: int) -> str:
    """Assignments a0, a1, ... and centroids c1, c2, ..., one round after the other."""
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS (
  SELECT i, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT i, v.x, c, list_sum(list_transform(range(1, 65), lambda j: (v.x[j] - k.x[j]) * (v.x[j] - k.x[j])))::BIGINT AS d FROM v, c{r} k) GROUP BY i, x)""")
        if r < rounds:
            parts.append(f"""
s{r} AS (SELECT c, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) t(j) GROUP BY c, j),
c{r + 1} AS (
  SELECT k.c, coalesce(m.x, k.x) AS x FROM c{r} k LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM s{r} GROUP BY c) m ON m.c = k.c)""")
    return ",".join(parts)


CENTROIDS_SQL = (
    """
WITH v AS (
  SELECT row_number() OVER () AS i, vec_id, embedding, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, embedding) - 1 AS c, x
  FROM (SELECT sha256('2:' || vec_id) AS h, embedding, x FROM v ORDER BY h NULLS LAST, embedding LIMIT 40)),"""
    + _nearest_sql(5)
    + """
SELECT vec_id, a5.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a5.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c5.x, ',')) AS centroid_sha256
FROM a5 JOIN v USING (i) JOIN c5 ON c5.c = a5.c
"""
)


def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(_read(spark, sf_dir, "documents"), least=7, times=2, drop=31)
    return spelling.variants(words, ratio=10).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_repeated_phrases": repeated_phrases,
    "op2_consistent_hash_sharding": sharding,
    "op3_language_mixture": languages,
    "op4_imatch_fingerprints": fingerprints,
    "op5_warc_bundles": archive,
    "op6_circulant_minhash": near_duplicates,
    "op7_pareto_mixing": mixing,
    "op8_toxicity_crf": toxic,
    "op9_benchmark_decontamination": decontamination,
    "op10_suffix_array_dedup": suffix_dedup,
    "op11_simhash_anchors": simhash_duplicates,
    "op12_dimension_sharded_lloyd": centroids,
    "op13_spelling_variants": spellings,
}
ORACLES = {
    "op1_repeated_phrases": PHRASES_SQL,
    "op5_warc_bundles": ARCHIVE_SQL,
    "op6_circulant_minhash": NEAR_SQL,
    "op7_pareto_mixing": MIXING_SQL,
    "op9_benchmark_decontamination": DECONTAMINATION_SQL,
    "op10_suffix_array_dedup": SUFFIX_SQL,
    "op12_dimension_sharded_lloyd": CENTROIDS_SQL,
}
