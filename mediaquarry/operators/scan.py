"""Incremental scans: a listing of the disk against the catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaquarry.functions.text import basename, dirname, fold_ascii, fold_unicode, media_type
from mediaquarry.storage import materialise


def scan_diff(listing: DataFrame, media: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Compare a listing (root, rel_path, size, mtime) of ``roots`` with the catalog's media of these roots.

    Returns root, path_key, rel_path, size, mtime, id and status: added, updated (size or time differ),
    restored (was absent), missing (was present) or same. A restored file is not counted as updated. A root
    without files is listed as empty: its media are missing. Files of other roots are not looked at, but a new
    file whose path another root's medium has, or a root that comes before it in ``roots``, is left out.
    """
    own = F.col("root").isin(list(roots))
    disk = listing.where(own).withColumn("path_key", fold_unicode(F.col("rel_path"))).groupBy("root", "path_key").agg(F.max(F.struct("rel_path", "size", "mtime")).alias("d"))
    known = media.where(own).select(
        "root", fold_unicode(F.col("rel_path")).alias("path_key"), "id", F.col("rel_path").alias("old_path"), F.col("size").alias("old_size"),
        F.col("mtime").alias("old_mtime"), "present",
    )
    met = disk.join(known, ["root", "path_key"], "full_outer")
    on_disk, in_catalog = F.col("d").isNotNull(), F.col("id").isNotNull()
    changed = ~F.col("d.size").eqNullSafe(F.col("old_size")) | ~F.col("d.mtime").eqNullSafe(F.col("old_mtime"))
    status = (
        F.when(~in_catalog, "added")
        .when(on_disk & ~F.col("present"), "restored")
        .when(on_disk & changed, "updated")
        .when(~on_disk & F.col("present"), "missing")
        .otherwise("same")
    )
    judged = met.select(
        "root", "path_key", F.coalesce("d.rel_path", "old_path").alias("rel_path"), F.coalesce("d.size", "old_size").alias("size"),
        F.coalesce("d.mtime", "old_mtime").alias("mtime"), "id", status.alias("status"), on_disk.alias("present"),
    )
    new = judged.where("status = 'added'").withColumn("_path", fold_ascii(F.col("rel_path")))
    taken = media.select(fold_ascii(F.col("rel_path")).alias("_path")).distinct()
    order = F.array_position(F.array(*map(F.lit, roots)), F.col("root"))
    turn = F.row_number().over(Window.partitionBy("_path").orderBy(order, "path_key"))
    free = new.join(taken, "_path", "left_anti").withColumn("_turn", turn).where("_turn = 1")
    return judged.where("status <> 'added'").unionByName(free.drop("_path", "_turn"))


def scan_counts(diff: DataFrame) -> DataFrame:
    """added, updated, missing, restored."""
    return diff.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "updated", "missing", "restored")])


def refreshed(diff: DataFrame, media: DataFrame, next_id: int) -> DataFrame:
    """The catalog after a scan: new files get ids from ``next_id`` on in order of their paths, vanished ones are flagged absent.

    Media of roots that were not scanned stay as they are.
    """
    new = diff.where("status = 'added'")
    # ids rise with the paths but leave gaps; the table is written so that they can't change
    numbered = materialise(new.orderBy("root", "path_key").withColumn("id", F.monotonically_increasing_id() + next_id), "new-media")
    added = numbered.select("id", "root", "rel_path", "size", "mtime", "present")
    kept = diff.where("status <> 'added'").select("id", "root", "rel_path", "size", "mtime", "present")
    both = added.unionByName(kept).select(
        "*", basename(F.col("rel_path")).alias("filename"), dirname(F.col("rel_path")).alias("album"), media_type(F.col("rel_path")).alias("type")
    )
    rest = [c for c in media.columns if c not in both.columns]
    scanned = both.join(media.select("id", *rest), "id", "left").select(*media.columns)
    return scanned.unionByName(media.join(kept.select("id"), "id", "left_anti").select(*media.columns))


def library_stats(media: DataFrame) -> DataFrame:
    """files, bytes, and unknown_sizes: present files whose size isn't above 0."""
    here = media.where("present")
    return here.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"), F.count_if(F.coalesce("size", F.lit(0)) <= 0).alias("unknown_sizes"))


def folder_diff(listing: DataFrame, folders: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Folders on disk (root, rel_path) of ``roots`` against known ones: root, rel_path, status (added, restored, missing, same)."""
    own = F.col("root").isin(list(roots))
    disk = listing.where(own).select("root", "rel_path", fold_unicode(F.col("rel_path")).alias("key"), F.lit(True).alias("here")).dropDuplicates(["root", "key"])
    known = folders.where(own).select("root", F.col("rel_path").alias("old"), fold_unicode(F.col("rel_path")).alias("key"), "present")
    met = disk.join(known, ["root", "key"], "full_outer")
    status = (
        F.when(F.col("old").isNull(), "added").when(F.col("here") & ~F.col("present"), "restored").when(F.col("here").isNull() & F.col("present"), "missing").otherwise("same")
    )
    return met.select("root", F.coalesce("old", "rel_path").alias("rel_path"), status.alias("status"))


def after_scan(media: DataFrame, links: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What follows a scan: vanished media are relinked to the files that replace them, then held records are attached.

    Returns media, links and the records that are still held.
    """
    from mediaquarry.operators.sync import attached, relinked

    media, links = relinked(media, links)
    links, pending = attached(links, pending, media)
    return media, links, pending
