"""Notes made from the documents table, by one expression in Spark and in DuckDB."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notequery.operators import index, passages, segments
from notequery.sources.tables import fresh, state, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, modified): every document as a note; every fifth line a heading, some with frontmatter, secrets and links."""
    d = table(spark, sf_dir, "documents")
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.when(i % 5 == 4, F.concat(F.lit("## "), x)).otherwise(x))
    head = F.when(F.col("doc_id") % 7 == 0, F.format_string('---\ntitle: "Doc %d"\nai: %s\ncreated: 2024-01-02T03:04:05Z\ntags: [%s, \'%s\']\n---\n', "doc_id", F.when(F.col("doc_id") % 2 == 0, "false").otherwise("true"), "lang", "source")).otherwise("")
    secret = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("\npassword"), F.lit(": "), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 20), F.lit(" end"))).otherwise("")
    link = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n[[Doc "), (F.col("doc_id") + 7).cast("string"), F.lit("]] and [other]("), F.lpad(((F.col("doc_id") * 7) % 1000).cast("string"), 6, "0"), F.lit(".md)"))).otherwise("")
    return d.select(
        F.concat("source", F.lit("/"), "lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(".md")).alias("path"),
        F.concat(head, F.array_join(lines, "\n"), secret, link).alias("content"),
        F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(doc_id as int), 0, 0)").alias("modified"),
    )


RAW = r"""
raw AS (
  SELECT source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 6, '0') || '.md' AS path,
    CASE WHEN doc_id % 7 = 0 THEN '---' || chr(10) || 'title: "Doc ' || doc_id || '"' || chr(10) || 'ai: ' || CASE WHEN doc_id % 2 = 0 THEN 'false' ELSE 'true' END
      || chr(10) || 'created: 2024-01-02T03:04:05Z' || chr(10) || 'tags: [' || lang || ', ''' || source || ''']' || chr(10) || '---' || chr(10) ELSE '' END
    || array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: CASE WHEN i % 5 = 0 THEN '## ' || x ELSE x END), chr(10))
    || CASE WHEN doc_id % 11 = 0 THEN chr(10) || 'password: ' || substr(md5(doc_id::VARCHAR), 1, 20) || ' end' ELSE '' END
    || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '[[Doc ' || (doc_id + 7) || ']] and [other](' || lpad(((doc_id * 7) % 1000)::VARCHAR, 6, '0') || '.md)' ELSE '' END AS content,
    TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 HOUR AS modified
  FROM documents)"""

NOTES = (
    RAW
    + r""",
parsed AS (
  SELECT *, CASE WHEN starts_with(content, '---' || chr(10)) THEN regexp_extract(content, '^---\n(?s:(.*?\n)??)---(?:\n|\z)', 1) END AS frontmatter,
         regexp_replace(content, '^---\n(?s:(.*?\n)??)---(?:\n|\z)', '') AS body FROM raw),
notes AS (
  SELECT path, modified, frontmatter, body, regexp_extract(path, '^(.*)/', 1) AS folder,
    coalesce(nullif(regexp_extract(frontmatter, '(?m)^title: "?([^"\n]*)', 1), ''), nullif(trim(regexp_extract(body, '(?m)^[ \t]*# +(.*\S)[ \t\r]*$', 1)), ''),
             regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1')) AS title,
    CASE WHEN frontmatter IS NULL THEN NULL ELSE TIMESTAMP '2024-01-02 03:04:05' END AS created,
    strlen(content)::BIGINT AS size_bytes, sha256(content) AS content_hash,
    CASE WHEN frontmatter IS NULL THEN []::VARCHAR[] ELSE list_transform(string_split(regexp_extract(frontmatter, '(?m)^tags: \[(.*)\]$', 1), ', '), lambda x: replace(x, '''', '')) END AS tags,
    coalesce(contains(frontmatter, 'ai: false'), false) AS ai_excluded
  FROM parsed)"""
)

CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'),
    '^[ \t]*(?:[-*+][ \t]+(?:\[[ xX]\][ \t]+)?|\d+[.)][ \t]+|>[ \t]?)', ''), '\*\*|__|~~|`+', '', 'g'), '(^|[^\w*])\*([^\s*][^*]*)\*', '\1\2', 'g'),
    '^[ \t]*\|?[ \t]*:?-{{3,}}:?[ \t]*(?:\|[ \t]*:?-{{3,}}:?[ \t]*)*\|?[ \t]*$', '')"""
TABLE = r"CASE WHEN regexp_matches({0}, '^[ \t]*\|.*\|[ \t]*$') THEN replace(" + CLEAN + ", '|', ' ') ELSE " + CLEAN + " END"

PASSAGES = (
    NOTES
    + r""",
ln AS (SELECT path, unnest(string_split(regexp_replace(body, '\n\z', ''), chr(10))) AS t, generate_subscripts(string_split(regexp_replace(body, '\n\z', ''), chr(10)), 1) AS line FROM notes),
fl AS (SELECT *, regexp_matches(t, '^ {0,3}(?:```|~~~)') AS fence FROM ln),
cl AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS coded FROM fl),
hl AS (SELECT *, CASE WHEN NOT fence AND NOT coded AND regexp_matches(t, '^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$')
         THEN length(regexp_extract(t, '^ {0,3}(#{1,6})', 1)) ELSE 0 END AS level,
         regexp_extract(t, '^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$', 2) AS h FROM cl),
pl AS (SELECT path, line, level, CASE WHEN level > 0 THEN """
    + TABLE.format("h")
    + " WHEN fence THEN '' WHEN coded THEN t ELSE "
    + TABLE.format("t")
    + r""" END AS plain, sum((level > 0)::INT) OVER (PARTITION BY path ORDER BY line) AS section FROM hl),
-- Headings of the notes are all of one level or the document's own; the path keeps each heading until one of its level or above follows.
hd AS (SELECT path, section, level, trim(plain) AS h FROM pl WHERE level > 0),
anc AS (
  SELECT s.path, s.section, h.level, arg_max(h.h, h.section) AS h, max(h.section) AS at FROM (SELECT DISTINCT path, section FROM pl) s JOIN hd h ON h.path = s.path AND h.section <= s.section GROUP BY ALL),
hp AS (
  SELECT a.path, a.section, string_agg(a.h, ' > ' ORDER BY a.level) AS heading_path FROM anc a
  WHERE a.h <> '' AND NOT EXISTS (SELECT 1 FROM anc b WHERE b.path = a.path AND b.section = a.section AND b.level < a.level AND b.at > a.at) GROUP BY ALL),
sec AS (
  SELECT path, section, min(line)::INT AS line_start, max(line)::INT AS line_end, trim(regexp_replace(string_agg(plain, ' ' ORDER BY line), '\s+', ' ', 'g')) AS text
  FROM pl WHERE trim(plain) <> '' GROUP BY ALL),
st AS (SELECT *, length(text) < 40 AND row_number() OVER (PARTITION BY path ORDER BY section) > 1 AS stub FROM sec),
cut AS (
  SELECT *, CASE WHEN length(text) <= 1200 THEN [text] ELSE list_filter(list_transform(string_split(list_reduce(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+'), lambda acc, x:
    CASE WHEN length(string_split(acc, chr(1))[-1]) + length(x) <= 1200 THEN acc || x ELSE acc || chr(1) || x END), chr(1)), lambda x: trim(x)), lambda x: x <> '') END AS parts FROM st),
part AS (SELECT path, section, line_start, line_end, stub, unnest(parts) AS text, generate_subscripts(parts, 1) AS part FROM cut),
isl AS (SELECT *, sum((NOT stub)::INT) OVER (PARTITION BY path ORDER BY section, part) AS island FROM part),
passages AS (
  SELECT isl.path, (island - 1)::INT AS ordinal, arg_min(coalesce(heading_path, ''), (isl.section, part)) AS heading_path, min(line_start) AS line_start, max(line_end) AS line_end,
         string_agg(text, ' ' ORDER BY isl.section, part) AS text
  FROM isl LEFT JOIN (SELECT * FROM hp) hp ON hp.path = isl.path AND hp.section = isl.section GROUP BY isl.path, island)"""
)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.parse_notes(raw_notes(spark, sf_dir))


_built: dict[tuple, str] = {}
_read: dict[tuple, DataFrame] = {}


def _key(spark: SparkSession, sf_dir: str, stemming: bool = False) -> tuple:
    return (spark.sparkContext.applicationId, sf_dir, state(spark, f"{sf_dir}/documents.parquet"), stemming)


def index_folder(spark: SparkSession, sf_dir: str, stemming: bool = False) -> str:
    """The stored index over all notes, built once for a session and the files as they are, as its first version."""
    key = _key(spark, sf_dir, stemming)
    if key not in _built:
        folder = fresh(spark, "index")
        segments.rebuild(raw_notes(spark, sf_dir), folder, stemming)
        _built[key] = folder
    return _built[key]


def indexed(spark: SparkSession, sf_dir: str, stemming: bool = False) -> index.Index:
    """The stored index over all notes, as it was built."""
    return segments.load(spark, index_folder(spark, sf_dir, stemming), 1)


def parsed(spark: SparkSession, sf_dir: str, stemming: bool = False) -> index.Index:
    """The index over all notes for queries that look up no words: as frames over the notes with their passages, which alone are stored.

    Notes come without their bodies.  Where the session has stored the index, it is that.
    """
    if _key(spark, sf_dir, stemming) in _built:
        return indexed(spark, sf_dir, stemming)
    key = _key(spark, sf_dir)
    if key not in _read:
        _read[key] = stored(passages.read(notes(spark, sf_dir).drop("frontmatter")), "read-notes")
    return index.of_rows(_read[key].drop("passages"), _read[key], stemming)


raw_sql = partial("WITH {0} {1}".format, RAW)
notes_sql = partial("WITH {0} {1}".format, NOTES)
passages_sql = partial("WITH {0} {1}".format, PASSAGES)
