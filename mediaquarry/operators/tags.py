"""Tags as last-writer-wins registers with tombstones.

A link is (media_id, tag_key, tag, updated_at, deleted): tag_key is the A-Z folded name, deleted links
stay as tombstones. Edits are functions from tables to tables: they return the changed links, and
``apply`` merges these into a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaquarry.functions.text import LOWER, UPPER, fold_ascii

LINK = ("media_id", "tag_key", "tag", "updated_at", "deleted")
_FOLD = str.maketrans(UPPER, LOWER)


def resolve(records: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """The newest record of each (media_id, tag_key); of equally new ones the first by ``order``.

    The spelling is that of the first record of the tag anywhere.
    """
    keyed = records.withColumn("tag_key", fold_ascii(F.col("tag")))
    # the earliest of equally new records: the greatest by time, then by negated order
    rank = F.struct(F.col("updated_at"), *[(-F.col(c).cast("double")).alias(f"o{i}") for i, c in enumerate(order)])
    newest = keyed.groupBy("media_id", "tag_key").agg(F.max_by(F.struct("updated_at", F.coalesce("deleted", F.lit(False)).alias("deleted")), rank).alias("r"))
    spelled = keyed.groupBy("tag_key").agg(F.min_by("tag", F.struct(*order)).alias("tag"))
    return newest.join(spelled, "tag_key").select("media_id", "tag_key", "tag", "r.updated_at", "r.deleted")


def accepted_records(records: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Records in their order, with ``accepted`` (newer than all before it) and ``changed`` (the tag then appears or vanishes)."""
    before = Window.partitionBy("media_id", "tag_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    keyed = records.withColumn("tag_key", fold_ascii(F.col("tag"))).withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    newest = F.max("updated_at").over(before)
    marked = keyed.withColumn("accepted", newest.isNull() | (F.col("updated_at") > newest))
    last = F.last(F.when(F.col("accepted"), F.col("deleted")), ignorenulls=True).over(before)
    return marked.withColumn("changed", F.col("accepted") & (F.coalesce(last, F.lit(True)) != F.col("deleted")))


def apply(links: DataFrame, changes: DataFrame) -> DataFrame:
    """``links`` with ``changes`` merged in: strictly newer ones win, and stored spellings stay."""
    both = links.select(*LINK, F.lit(0).alias("seq")).unionByName(changes.select(*LINK, F.lit(1).alias("seq")))
    return resolve(both).select(*LINK)


def add_tags(links: DataFrame, ids: DataFrame, names: Sequence[str], now: float) -> DataFrame:
    """Live links of every id in ``ids`` (media_id) to every name."""
    clean = list(dict.fromkeys(filter(None, (" ".join(n.split()) for n in names))))
    tags = F.explode(F.array(*map(F.lit, clean)) if clean else F.array().cast("array<string>"))
    new = ids.select("media_id").distinct().select("media_id", tags.alias("tag"))
    return new.select("media_id", fold_ascii(F.col("tag")).alias("tag_key"), "tag", F.lit(float(now)).alias("updated_at"), F.lit(False).alias("deleted"))


def _tombstones(links: DataFrame, which: Column, now: float) -> DataFrame:
    return links.where(~F.col("deleted") & which).select("media_id", "tag_key", "tag", F.lit(float(now)).alias("updated_at"), F.lit(True).alias("deleted"))


def _is(name: str) -> Column:
    return F.col("tag_key") == " ".join(name.split()).translate(_FOLD)


def remove_tag(links: DataFrame, ids: DataFrame, name: str, now: float) -> DataFrame:
    """Tombstones of the live links of these ids to the tag."""
    return _tombstones(links.join(ids.select("media_id").distinct(), "media_id", "left_semi"), _is(name), now)


def delete_tag(links: DataFrame, name: str, now: float) -> DataFrame:
    """Tombstones of all live links to the tag."""
    return _tombstones(links, _is(name), now)


def rename_tag(links: DataFrame, old: str, new: str, now: float) -> DataFrame:
    """The whole table after a rename: another spelling only, or a merge into ``new``. An empty name is an error."""
    old, new = " ".join(old.split()), " ".join(new.split())
    if not new:
        raise ValueError("a tag needs a name")
    if old.translate(_FOLD) == new.translate(_FOLD):
        return links.withColumn("tag", F.when(_is(old), F.lit(new)).otherwise(F.col("tag")))
    held = links.where(~F.col("deleted") & _is(old)).select("media_id")
    return apply(links, add_tags(links, held, [new], now).unionByName(delete_tag(links, old, now)))


def tag_counts(links: DataFrame) -> DataFrame:
    """Live links of each tag, those of absent media too: tag_key, tag, n."""
    return links.where("not deleted").groupBy("tag_key").agg(F.min("tag").alias("tag"), F.count(F.lit(1)).alias("n"))


def present_tag_counts(links: DataFrame, media: DataFrame) -> DataFrame:
    """The same over present media only."""
    return tag_counts(links.join(media.where("present").select(F.col("id").alias("media_id")), "media_id", "left_semi"))


def selection_tag_counts(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Counts within a selection of media."""
    return tag_counts(links.join(ids.select("media_id").distinct(), "media_id", "left_semi"))


def tags_of(links: DataFrame) -> DataFrame:
    """Live tags of each medium, in order of their keys."""
    held = F.sort_array(F.collect_list(F.struct("tag_key", "tag")))
    return links.where("not deleted").groupBy("media_id").agg(F.transform(held, lambda t: t["tag"]).alias("tags"))


def move_tags(links: DataFrame, moved: DataFrame) -> DataFrame:
    """Re-key links by ``moved`` (media_id, to_id): the newer link of both sides stays, the destination's if equally new."""
    went = links.join(moved, "media_id").select(F.col("to_id").alias("media_id"), "tag_key", "tag", "updated_at", "deleted")
    stayed = links.join(moved.select("media_id"), "media_id", "left_anti")
    return apply(stayed, went)
