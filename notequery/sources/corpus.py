"""Folders of Markdown files as frames, and back."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notequery.functions import notes as n

#: Bytes of a file that listings read.
HEAD = 4096
_WANTED = r"(?i)\.(?:md|markdown)$"


def _files(spark: SparkSession, root: str) -> DataFrame:
    """Markdown files under a root, any depth, without those below a name that starts with a dot; paths relative to it.  Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark.createDataFrame([(root.rstrip("/"),)], "root string").select(F.regexp_replace("root", r"^[a-z]+:/*", "/").alias("root")).first()["root"]
    files = files.withColumn("at", F.url_decode(F.regexp_replace("path", r"\+", "%2B")))
    relative = F.substring(F.regexp_replace("at", r"^[a-z]+:/*", "/"), len(base) + 2, 1 << 30)
    return files.withColumn("path", relative).filter(F.regexp_like("path", F.lit(_WANTED)) & ~F.regexp_like("path", F.lit(r"(?:^|/)\.")))


def scan(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Notes (path, content, modified, size_bytes), and files skipped because they are no UTF-8 (path, size_bytes)."""
    files = _files(spark, root)
    good = F.is_valid_utf8(F.col("content").cast("string"))
    rows = files.select("path", F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("modified"), F.col("length").alias("size_bytes"), good.alias("_good"))
    return rows.filter("_good").drop("_good"), rows.filter("not _good").select("path", "size_bytes")


def states(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, size_bytes) from file metadata alone; contents are not read."""
    return _files(spark, root).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size_bytes"))


def _store_of(at: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return (fs.LocalFileSystem(), at.removeprefix("file:").replace("///", "/", 1)) if at.startswith(("file:", "/")) else fs.FileSystem.from_uri(at)


def _read_heads(batches):
    """(path, modified, head) of files (path, modified, at): the first ``HEAD`` bytes of each and no more; an unreadable file has none."""
    for batch in batches:
        out = []
        for at in batch.column(2).to_pylist():
            try:
                store, path = _store_of(at)
                with store.open_input_file(path) as file:
                    out.append(file.read_at(min(HEAD, file.size()), 0))
            except OSError:
                out.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["path", "modified", "head"])


def heads(spark: SparkSession, root: str) -> DataFrame:
    """(path, title, tags, ai_excluded, modified) by the first ``HEAD`` bytes of each file, newest first.

    Spark lists the files without reading them, and tasks read no more than their heads.
    """
    listed = _files(spark, root).select("path", F.col("modificationTime").alias("modified"), "at")
    read = listed.mapInArrow(_read_heads, "path string, modified timestamp, head binary")
    text = F.make_valid_utf8(F.coalesce(F.col("head"), F.lit(b"")).cast("string"))
    block, rest = n.frontmatter(text), n.body(text)
    return read.select("path", n.title(block, rest, F.col("path")).alias("title"), n.tags(block).alias("tags"), n.ai_excluded(block).alias("ai_excluded"), "modified").orderBy(F.desc("modified"), "path")


def import_notes(incoming: DataFrame, notes: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Incoming (name, content) as notes (path, content) of a folder, and those skipped (name, reason).

    Names become slugs; a slug that is taken, by a note or another incoming one, gets the next free suffix from -2
    on, so nothing is overwritten.  Names that are no Markdown file and null contents are skipped.
    """
    fit = F.regexp_like("name", F.lit(_WANTED)) & F.col("content").isNotNull()
    skipped = incoming.filter(~F.coalesce(fit, F.lit(False))).select("name", F.when(F.col("content").isNull(), "unreadable").otherwise("no Markdown").alias("reason"))
    rows = incoming.filter(fit).withColumn("stem", n.slug(n.stem(F.col("name"))))
    taken = notes.filter(n.folder(F.col("path")) == folder).select(F.lower(n.stem(F.col("path"))).alias("taken"))
    suffix = F.regexp_extract("taken", r"^(.*?)(?:-(\d+))?$", 2)
    used = taken.select(F.explode(F.array("taken", F.when(suffix != "", F.regexp_extract("taken", r"^(.*)-\d+$", 1)))).alias("stem"), F.when(suffix != "", suffix.cast("long")).otherwise(1).alias("n"))
    used = used.filter("stem is not null").groupBy("stem").agg(F.max("n").alias("last"))
    order = F.row_number().over(Window.partitionBy("stem").orderBy("name", F.xxhash64("content")))
    rows = rows.withColumn("_k", order).join(used, "stem", "left").withColumn("_n", F.col("_k") + F.coalesce("last", F.lit(0)))
    name = F.concat("stem", F.when(F.col("_n") == 1, "").otherwise(F.concat(F.lit("-"), F.col("_n").cast("string"))), F.lit(".md"))
    return rows.select(F.concat(F.lit(f"{folder}/" if folder else ""), name).alias("path"), "content"), skipped


def export(notes: DataFrame, chosen: DataFrame, target: str) -> None:
    """Write the chosen notes as rows (path, content), in one folder of the target for each folder of notes."""
    picked = notes.join(chosen.select("path").distinct(), "path", "left_semi")
    picked.select("path", "content", n.folder(F.col("path")).alias("folder")).write.partitionBy("folder").mode("overwrite").parquet(target)


def export_files(notes: DataFrame, chosen: DataFrame, target: str) -> int:
    """Write the chosen notes as files under a target that all executors share, each at its own path; returns how many.

    Tasks write the files, a task that runs again the same ones.  A path that leaves the target or that no file can
    have, and a chosen path without a note, raise before anything is written.
    """
    wanted = chosen.select("path").distinct()
    bad = wanted.join(notes.select("path", F.lit(True).alias("there")), "path", "left")
    bad = bad.withColumn("problem", F.coalesce(n.path_problem(F.col("path")), F.when(F.col("there").isNull(), "absent"))).filter("problem is not null").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['path']}: {bad[0]['problem']}")

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = _store_of(f"{target.rstrip('/')}/{path}")
                store.create_dir(at.rpartition("/")[0], recursive=True)
                with store.open_output_stream(at, compression=None) as file:
                    file.write((content or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    picked = notes.join(wanted, "path", "left_semi").select("path", "content")
    return picked.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
