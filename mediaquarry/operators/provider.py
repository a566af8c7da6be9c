"""A document provider's entries as a tree: what can be reached from the root, and under which path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaquarry.functions.text import media_type
from mediaquarry.operators.pointers import followed
from mediaquarry.storage import materialise

DIRECTORY = "vnd.android.document/directory"


def visited_folders(entries: DataFrame, root: str, directory: str = DIRECTORY) -> DataFrame:
    """The folders that can be reached from ``root``, each once: document_id, parent_id, name, level.

    A turn expands the frontier: the folders last found meet their children by parent id, and what was seen before is
    left out by an anti join, so cycles end. A folder that several parents list belongs to one of the fewest levels, of these
    to the parent with the smallest id, and under the smallest name there.
    """
    known = F.col("document_id").isNotNull() & F.col("name").isNotNull() & ~F.startswith(F.col("name"), F.lit("."))
    edges = entries.where(known & (F.col("mime") == directory)).select("document_id", "parent_id", "name").distinct()
    edges = materialise(edges, "provider-folders")
    spark = entries.sparkSession
    seen = spark.range(1).select(F.lit(root).alias("document_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("").alias("name"), F.lit(0).alias("level"))
    frontier, level = seen, 0
    while not frontier.isEmpty():
        level += 1
        children = edges.join(frontier.select(F.col("document_id").alias("parent_id")), "parent_id")
        new = children.groupBy("document_id").agg(F.min(F.struct("parent_id", "name")).alias("p"))
        new = new.join(seen.select("document_id"), "document_id", "left_anti")
        frontier = materialise(new.select("document_id", "p.parent_id", "p.name", F.lit(level).alias("level")), "provider-frontier")
        seen = seen.unionByName(frontier)
    return materialise(seen, "provider-visited")


def folder_paths(visited: DataFrame) -> DataFrame:
    """The path of each visited folder: document_id, rel_path, '' for the root.

    Names are put together by pointer jumping: each turn a path takes in that of the folder where it begins, which doubles
    its length, so a tree of depth d takes log2(d) joins.
    """
    rows = visited.select("document_id", F.col("parent_id").alias("up"), F.col("name").alias("rel_path"))
    deepest = visited.agg(F.max("level")).first()[0] or 0
    for _ in range(max(0, deepest).bit_length()):
        above = rows.select(F.col("document_id").alias("up"), F.col("up").alias("_up"), F.col("rel_path").alias("_path"))
        joined = F.when(F.coalesce("_path", F.lit("")) == "", F.col("rel_path")).otherwise(F.concat("_path", F.lit("/"), "rel_path"))
        rows = materialise(rows.join(above, "up", "left").select("document_id", F.col("_up").alias("up"), joined.alias("rel_path")), "provider-paths")
    return rows.select("document_id", "rel_path")


def traversed(entries: DataFrame, root: str, directory: str = DIRECTORY) -> tuple[DataFrame, DataFrame]:
    """The media and the folders below ``root`` of entries (document_id, parent_id, name, mime, size, last_modified).

    Media: document_id, rel_path, type, size, last_modified, newest first, then by folded path; a size or time that is
    unknown is 0. Folders: rel_path, each once, those among them that lead back to a folder seen before, by folded path. Entries
    without id or name, and those whose name begins with a dot, are passed over, with all below them; so is what hangs
    under no visited folder. An empty table gives empty tables.
    """
    paths = folder_paths(visited_folders(entries, root, directory)).select(F.col("document_id").alias("parent_id"), F.col("rel_path").alias("_folder"))
    known = F.col("document_id").isNotNull() & F.col("name").isNotNull() & ~F.startswith(F.col("name"), F.lit("."))
    met = entries.where(known).join(paths, "parent_id")
    path = F.when(F.col("_folder") == "", F.col("name")).otherwise(F.concat("_folder", F.lit("/"), "name"))
    found = met.withColumn("rel_path", path)
    is_folder = F.coalesce(F.col("mime") == directory, F.lit(False))
    media = found.where(~is_folder).withColumn("type", media_type(F.col("name"), F.col("mime"))).where("type is not null")
    zero = F.lit(0).cast("long")
    media = media.select("document_id", "rel_path", "type", F.coalesce("size", zero).alias("size"), F.coalesce("last_modified", zero).alias("last_modified"))
    folders = found.where(is_folder).select("rel_path").distinct()
    return media.orderBy(F.desc("last_modified"), F.lower("rel_path")), folders.orderBy(F.lower("rel_path"))
