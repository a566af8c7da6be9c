"""Tags keyed by library and path, as a mobile store has them.

A record is (library, path, name, updated_at, deleted); paths and names are compared with A-Z folded. Edits
return the whole store afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaquarry.functions.text import LOWER, UPPER, fold_ascii

RECORD = ("library", "path", "name", "updated_at", "deleted")
_FOLD = str.maketrans(UPPER, LOWER)


def newest(*stores: DataFrame) -> DataFrame:
    """The newest record of each (library, path, name); of equally new ones that of the earlier store."""
    ranked = [s.select(*RECORD, F.lit(-i).alias("rank")) for i, s in enumerate(stores)]
    every = ranked[0]
    for more in ranked[1:]:
        every = every.unionByName(more)
    keys = ["library", fold_ascii(F.col("path")).alias("_path"), fold_ascii(F.col("name")).alias("_name")]
    best = F.max_by(F.struct("path", "name", "updated_at", "deleted"), F.struct("updated_at", "rank"))
    return every.groupBy(*keys).agg(best.alias("r")).select("library", "r.*")


def _is(name: str) -> Column:
    return fold_ascii(F.col("name")) == " ".join(name.split()).translate(_FOLD)


def _at(paths: DataFrame) -> DataFrame:
    return paths.select(F.col("library").alias("_library"), fold_ascii(F.col("path")).alias("_path")).distinct()


def _replaced(store: DataFrame, changes: DataFrame) -> DataFrame:
    """The store with the records of ``changes`` in place of its own, whatever their times."""
    keys = changes.select(F.col("library").alias("_library"), fold_ascii(F.col("path")).alias("_path"), fold_ascii(F.col("name")).alias("_name"))
    same = (F.col("library") == F.col("_library")) & (fold_ascii(F.col("path")) == F.col("_path")) & (fold_ascii(F.col("name")) == F.col("_name"))
    return store.join(keys, same, "left_anti").select(*RECORD).unionByName(changes.select(*RECORD))


def add(store: DataFrame, paths: DataFrame, names: Sequence[str], now: float) -> DataFrame:
    """Every name at every path (library, path)."""
    clean = list({n.translate(_FOLD): n for n in reversed([" ".join(n.split()) for n in names]) if n}.values())
    tags = F.explode(F.array(*map(F.lit, clean)) if clean else F.array().cast("array<string>"))
    return _replaced(store, paths.select("library", "path").distinct().select("*", tags.alias("name"), F.lit(float(now)).alias("updated_at"), F.lit(False).alias("deleted")))


def _struck(store: DataFrame, which: Column, now: float) -> DataFrame:
    gone = ~F.col("deleted") & which
    time = F.when(gone, F.lit(float(now))).otherwise(F.col("updated_at"))
    return store.select("library", "path", "name", time.alias("updated_at"), (F.col("deleted") | gone).alias("deleted"))


def remove(store: DataFrame, paths: DataFrame, name: str, now: float) -> DataFrame:
    """Tombstones for the live records of a name at these paths."""
    at = _at(paths).withColumn("_chosen", F.lit(True))
    met = store.join(at, (F.col("library") == F.col("_library")) & (fold_ascii(F.col("path")) == F.col("_path")), "left")
    return _struck(met, _is(name) & F.col("_chosen").isNotNull(), now)


def delete(store: DataFrame, library: str, name: str, now: float) -> DataFrame:
    """Tombstones for all live records of a name in a library."""
    return _struck(store, _is(name) & (F.col("library") == library), now)


def rename(store: DataFrame, library: str, old: str, new: str, now: float) -> DataFrame:
    """Another spelling, or the new name wherever the old one is live. Empty names are errors."""
    old, new = " ".join(old.split()), " ".join(new.split())
    if not old or not new:
        raise ValueError("a tag needs a name")
    own = _is(old) & (F.col("library") == library)
    if old.translate(_FOLD) == new.translate(_FOLD):
        return store.withColumn("name", F.when(own, F.lit(new)).otherwise(F.col("name"))).select(*RECORD)
    held = store.where(own & ~F.col("deleted")).select("library", "path")
    return add(delete(store, library, old, now), held, [new], now)


def moved(store: DataFrame, moves: DataFrame) -> DataFrame:
    """Records re-keyed by ``moves`` (library, from_path, to_path): the newer record stays, the destination's if equally new."""
    way = moves.where(fold_ascii(F.col("from_path")) != fold_ascii(F.col("to_path")))
    way = way.select(F.col("library").alias("_library"), fold_ascii(F.col("from_path")).alias("_from"), F.col("to_path").alias("_to"))
    met = store.join(way, (F.col("library") == F.col("_library")) & (fold_ascii(F.col("path")) == F.col("_from")), "left")
    stayed = met.where("_to is null").select(*RECORD)
    return newest(stayed, met.where("_to is not null").select("library", F.col("_to").alias("path"), "name", "updated_at", "deleted"))


def move_records(media: DataFrame, moves: DataFrame, now: float) -> DataFrame:
    """What a move of known media logs: library, from_path, to_path, size, moved_at."""
    sizes = media.select(F.col("library").alias("_library"), fold_ascii(F.col("rel_path")).alias("_path"), "size")
    changed = moves.where(fold_ascii(F.col("from_path")) != fold_ascii(F.col("to_path")))
    met = changed.join(sizes, (F.col("library") == F.col("_library")) & (fold_ascii(F.col("from_path")) == F.col("_path")))
    return met.select("library", "from_path", "to_path", "size", F.lit(float(now)).alias("moved_at"))


def merge(store: DataFrame, pending: DataFrame, media: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge ``records`` (library, path, name, updated_at, deleted; one each) with both stores.

    A record is taken if it is newer than what either store has; it goes to ``store`` if its file is present,
    else to ``pending``. Returns both stores and one row of counters: accepted, changed (what is visible).
    """
    latest = newest(store, pending).select(
        F.col("library").alias("_library"), fold_ascii(F.col("path")).alias("_path"), fold_ascii(F.col("name")).alias("_name"), F.col("updated_at").alias("_time"), F.col("deleted").alias("_gone")
    )
    same = (F.col("library") == F.col("_library")) & (fold_ascii(F.col("path")) == F.col("_path")) & (fold_ascii(F.col("name")) == F.col("_name"))
    met = records.select(*RECORD).join(latest, same, "left").where("_time is null or updated_at > _time")
    changed = F.coalesce("_gone", F.lit(True)) != F.col("deleted")
    here = _at(media.where("present").withColumn("path", F.col("rel_path"))).select(F.col("_library").alias("_in"), F.col("_path").alias("_on"), F.lit(True).alias("_here"))
    placed = met.join(here, (F.col("library") == F.col("_in")) & (fold_ascii(F.col("path")) == F.col("_on")), "left")
    counters = placed.agg(F.count(F.lit(1)).alias("accepted"), F.count_if(changed).alias("changed"))
    taken = placed.where("_here").select(*RECORD)
    return newest(store, taken), newest(pending, placed.where("_here is null").select(*RECORD)), counters


def by_media(media: DataFrame, store: DataFrame) -> DataFrame:
    """Live tags of present media: id, library, rel_path, name."""
    held = store.where("not deleted").select(F.col("library").alias("_library"), fold_ascii(F.col("path")).alias("_path"), "name")
    met = media.where("present").join(held, (F.col("library") == F.col("_library")) & (fold_ascii(F.col("rel_path")) == F.col("_path")))
    return met.select("id", "library", "rel_path", "name")


def remapped(records: DataFrame, done: DataFrame) -> DataFrame:
    """Records (path, ...) with the paths to which files were moved before: ``done`` has from_path and to_path, the last move counts.

    Paths are compared letter by letter, without folding, unlike elsewhere: the map of moves is one of paths as they are spelled.
    """
    way = done.groupBy(F.col("from_path").alias("_from")).agg(F.max_by("to_path", "seq").alias("_to"))
    met = records.join(way, F.col("path") == F.col("_from"), "left")
    return met.withColumn("path", F.coalesce("_to", "path")).select(*records.columns)
