"""Listing a library: the files of a folder tree with their kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaquarry.functions.text import basename, extension, hidden, media_type


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Media below ``root``: root, rel_path, filename, type, size, mtime. Hidden files and folders are passed over.

    Only names and sizes are read: the contents column of the file source is pruned. The driver lists, and the source passes
    empty files over; ``in_tasks.listing_in_tasks`` does neither.
    """
    root = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    # the source returns URIs; what follows the root's own path is the relative one
    own = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath() + "/"
    rel = F.substring(F.col("path"), F.locate(own, F.col("path")) + len(own), F.lit(1 << 20))
    rows = found.select(
        F.lit(root).alias("root"), rel.alias("rel_path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime")
    )
    rows = rows.where(~hidden(F.col("rel_path"))).withColumns({"filename": basename(F.col("rel_path")), "type": media_type(F.col("rel_path"))})
    return rows.where("type is not null").select("root", "rel_path", "filename", "type", "size", "mtime")


def folders(spark: SparkSession, root: str) -> DataFrame:
    """The folders below ``root`` that are not hidden, empty ones too: root, rel_path. Names only are read, by the driver, as for any file source."""
    root = root.rstrip("/")
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found: list[str] = []
    waiting = [(top, "")]
    while waiting:
        at, rel = waiting.pop()
        for entry in store.listStatus(at):
            name = entry.getPath().getName()
            if entry.isDirectory() and not name.startswith("."):
                path = f"{rel}/{name}" if rel else name
                found.append(path)
                waiting.append((entry.getPath(), path))
    return spark.createDataFrame([(root, path) for path in sorted(found)], "root string, rel_path string")


def contents(spark: SparkSession, root: str) -> DataFrame:
    """Content hashes: rel path's URI, size, mtime and sha256 of each file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.sha2("content", 256).alias("sha256"))


def provider_listing(rows: DataFrame) -> DataFrame:
    """A listing from a document provider (path, mime, size, last_modified in ms): kind by extension or mime, newest first.

    Unknown sizes and times are 0; a path that is listed twice counts once.
    """
    once = rows.dropDuplicates(["path"]).withColumn("type", media_type(F.col("path"), F.col("mime"))).where("type is not null")
    clean = once.where(~hidden(F.col("path"))).select(
        F.col("path").alias("rel_path"), "type", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("last_modified", F.lit(0)).alias("last_modified"), extension(F.col("path")).alias("extension")
    )
    return clean.orderBy(F.desc("last_modified"), F.lower("rel_path"))


def provider_folders(rows: DataFrame) -> DataFrame:
    """Folders of a document provider (path), each once, by folded path."""
    return rows.where(~hidden(F.col("path"))).select(F.col("path").alias("rel_path")).distinct().orderBy(F.lower("rel_path"))
