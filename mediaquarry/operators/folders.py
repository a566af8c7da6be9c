"""Folder trees: subtree counts by exploded ancestors, children, relocation and the checks before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaquarry.functions.text import LOWER, UPPER, album_parts, album_problem, ancestors, basename, dirname, fold_ascii, fold_unicode, in_folder, join_path

_FOLD = str.maketrans(UPPER, LOWER)


def folder_table(media: DataFrame) -> DataFrame:
    """Every folder that holds media, with all folders above it: root, rel_path."""
    return media.select("root", F.explode(ancestors(F.col("album"))).alias("rel_path")).distinct()


def folder_counts(folders: DataFrame, media: DataFrame) -> DataFrame:
    """Present media in each folder's subtree: root, rel_path, n_media, n_photos, n_videos, depth.

    Media are counted once for each folder above them and met by an equi join, so there is no join by
    prefixes; counting comes before the join.
    """
    held = (
        media.where("present")
        .select("root", F.explode(ancestors(fold_ascii(F.col("album")))).alias("folder_key"), "type")
        .groupBy("root", "folder_key")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("type") == "photo").alias("p"), F.count_if(F.col("type") == "video").alias("v"))
    )
    keyed = folders.withColumn("folder_key", fold_ascii(F.col("rel_path")))
    zero = F.lit(0).cast("long")
    return keyed.join(held, ["root", "folder_key"], "left").select(
        "root",
        "rel_path",
        F.coalesce("n", zero).alias("n_media"),
        F.coalesce("p", zero).alias("n_photos"),
        F.coalesce("v", zero).alias("n_videos"),
        (F.size(F.split("rel_path", "/")) - 1).alias("depth"),
    )


def relocated(media: DataFrame, root: str, old: str, new: str) -> DataFrame:
    """Media after a folder's move from ``old`` to ``new``, with all below it."""
    inside = (F.col("root") == root) & in_folder(F.col("album"), old)
    cut = len(old) + 1
    return media.withColumns(
        {
            "rel_path": F.when(inside, F.concat(F.lit(new), F.substring("rel_path", cut, 1 << 20))).otherwise(F.col("rel_path")),
            "album": F.when(inside, F.concat(F.lit(new), F.substring("album", cut, 1 << 20))).otherwise(F.col("album")),
        }
    )


def relocation_moves(media: DataFrame, root: str, old: str, new: str, at: float) -> DataFrame:
    """The move records of a relocation: one for each present file."""
    inside = media.where((F.col("root") == root) & F.col("present") & in_folder(F.col("album"), old))
    return inside.select(
        F.col("rel_path").alias("from_path"),
        F.concat(F.lit(new), F.substring("rel_path", len(old) + 1, 1 << 20)).alias("to_path"),
        "size",
        F.lit(float(at)).alias("moved_at"),
    )


def listed(folders: DataFrame, media: DataFrame) -> DataFrame:
    """Folders with their counts, by folded path."""
    return folder_counts(folders, media).orderBy("root", fold_ascii(F.col("rel_path")))


def created(folders: DataFrame, wanted: DataFrame) -> DataFrame:
    """Folders that must be added for ``wanted`` (root, path): the path and all above it that aren't there, by stored spelling."""
    clean = wanted.withColumn("rel_path", F.array_join(album_parts(F.col("path")), "/")).where(album_problem(F.col("path")).isNull())
    every = clean.select("root", F.explode(ancestors(F.col("rel_path"))).alias("rel_path"))
    keyed = every.withColumn("key", fold_ascii(F.col("rel_path"))).groupBy("root", "key").agg(F.min("rel_path").alias("rel_path"))
    known = folders.select("root", fold_ascii(F.col("rel_path")).alias("key"))
    return keyed.join(known, ["root", "key"], "left_anti").select("root", "rel_path")


def check_moves(folders: DataFrame, requests: DataFrame) -> DataFrame:
    """Judge folder moves (root, path, to_root, to_parent): adds new_path and problem, null if the move is fine."""
    own, parent = F.col("path"), F.col("to_parent")
    new = join_path(parent, basename(own))
    known = folders.select(F.col("root").alias("_root"), fold_ascii(F.col("rel_path")).alias("_key"), F.lit(True).alias("_taken"))
    parents = folders.select(F.col("root").alias("_proot"), fold_ascii(F.col("rel_path")).alias("_pkey"), F.lit(True).alias("_is"))
    met = (
        requests.withColumn("new_path", new)
        .join(known, (F.col("to_root") == F.col("_root")) & (fold_ascii(F.col("new_path")) == F.col("_key")), "left")
        .join(parents, (F.col("to_root") == F.col("_proot")) & (fold_ascii(parent) == F.col("_pkey")), "left")
    )
    problem = (
        F.when((parent != "") & F.col("_is").isNull(), "the destination does not exist")
        .when(F.col("root") != F.col("to_root"), "not between different libraries")
        .when((parent != "") & in_folder(fold_unicode(parent), fold_unicode(own)), "not into itself or below")
        .when(fold_unicode(F.col("new_path")) == fold_unicode(own), F.lit(None))
        .when(F.col("_taken"), "the name is taken there")
    )
    return met.withColumn("problem", problem).select(*requests.columns, "new_path", "problem")


def move_to_folder(media: DataFrame, wanted: DataFrame, root: str, folder: str) -> DataFrame:
    """Decide the move of each medium in ``wanted`` (id) to a folder: id, rel_path, new_path, outcome.

    Outcomes: moved, already there, or the reason for skipping. Of several that would get one path the
    first by id is moved.
    """
    rows = media.join(wanted.select("id").distinct(), "id", "left_semi")
    new = F.concat(F.lit(folder + "/" if folder else ""), basename(F.col("rel_path")))
    taken = media.select(fold_ascii(F.col("rel_path")).alias("_path"), F.col("id").alias("_other"), F.col("present").alias("_there")).groupBy("_path").agg(
        F.min("_other").alias("_other"), F.max("_there").alias("_there")
    )
    met = rows.withColumn("new_path", new).join(taken, fold_ascii(F.col("new_path")) == F.col("_path"), "left")
    free = F.col("present") & (F.col("root") == root) & (fold_unicode(F.col("album")) != folder.lower())
    firsts = met.where(free).groupBy(fold_ascii(F.col("new_path")).alias("_p")).agg(F.min("id").alias("_first"))
    met = met.join(firsts, fold_ascii(F.col("new_path")) == F.col("_p"), "left")
    outcome = (
        F.when(~F.col("present"), "file is missing")
        .when(F.col("root") != root, "in a different library")
        .when(fold_unicode(F.col("album")) == folder.lower(), "already there")
        .when(F.col("_other").isNotNull() & (F.col("_other") != F.col("id")) & F.col("_there"), "the name is taken there")
        .when(F.col("_other").isNotNull() & (F.col("_other") != F.col("id")), "an older record has that path")
        .when(F.col("_first") != F.col("id"), "the name is taken there")
        .otherwise("moved")
    )
    return met.select("id", "rel_path", "new_path", outcome.alias("outcome"))


def deletable(folders: DataFrame, media: DataFrame) -> DataFrame:
    """Folders with no media, present or not, and no folder in them."""
    used = media.select("root", F.explode(ancestors(fold_ascii(F.col("album")))).alias("key"))
    parents = folders.select("root", fold_ascii(dirname(F.col("rel_path"))).alias("key"))
    return folders.withColumn("key", fold_ascii(F.col("rel_path"))).join(used.unionByName(parents).distinct(), ["root", "key"], "left_anti").drop("key")


def upgraded(media: DataFrame) -> DataFrame:
    """Media of the first schema version, which had no folder column."""
    return media.withColumn("album", dirname(F.col("rel_path")))


def root_problem(roots: list[str], new: str) -> str | None:
    """Why a library root can't be added: it is one, lies in one or holds one."""
    new = new.rstrip("/") or "/"
    for root in roots:
        if new.lower() == root.lower():
            return "already a library"
        if new.lower().startswith(root.lower().rstrip("/") + "/"):
            return f"inside {root}"
        if root.lower().startswith(new.lower().rstrip("/") + "/"):
            return f"contains {root}"
    return None


def root_overlaps(roots: DataFrame) -> DataFrame:
    """Library roots that lie in others, for any number of roots (root): inside, holder (the nearest root that holds it), holders (how many do).

    Each root meets the folders above it by equality, so no root is compared with all others; a root that holds very many is
    one row on its side of the join. Roots are compared with A-Z and all other letters folded, without slashes at their
    ends; roots that fold alike are one, spelled as the smallest. The roots '/' and '' hold all others.
    """
    clean = F.regexp_replace(F.col("root"), "/+$", "")
    folded = roots.select(clean.alias("root"), fold_unicode(clean).alias("key")).groupBy("key").agg(F.min("root").alias("root"))
    parts = F.split("key", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("at")))
    asked = folded.where(F.size(parts) > 1).select(F.col("root").alias("inside"), F.explode(above).alias("up"))
    if_empty = folded.where((F.size(parts) == 1) & (F.col("key") != "")).select(F.col("root").alias("inside"), F.struct(F.lit(0).alias("depth"), F.lit("").alias("at")).alias("up"))
    held = folded.select(F.col("root").alias("holder"), F.col("key").alias("_key"))
    met = asked.unionByName(if_empty).join(held, F.col("up.at") == F.col("_key"))
    return met.groupBy("inside").agg(F.max_by("holder", "up.depth").alias("holder"), F.count(F.lit(1)).alias("holders"))


def without_root(media: DataFrame, root: str) -> DataFrame:
    """Media after a library was removed: its rows are hidden, not deleted."""
    return media.withColumn("present", F.col("present") & (F.col("root") != root))
