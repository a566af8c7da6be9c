"""Exact and near duplicates of media: fresh hashes, Hamming similarity join, groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaquarry.functions.text import fold_unicode, hamming
from mediaquarry.operators import near_blocks
from mediaquarry.operators.components import connected_components
from mediaquarry.storage import materialise, table_exists

DEFAULT_DISTANCE, MAX_DISTANCE = 6, 10


def clamped(distance: int) -> int:
    return max(0, min(MAX_DISTANCE, distance))


def fresh(hash_col: str, size_col: str, mtime_col: str) -> Column:
    """The stored hash if it was made of the file as it is now."""
    same = F.col(size_col).eqNullSafe(F.col("size")) & F.col(mtime_col).eqNullSafe(F.col("mtime"))
    return F.when(same, F.col(hash_col))


def exact_candidates(media: DataFrame) -> DataFrame:
    """Present media whose content hash is missing or stale and whose size another present file shares."""
    held = media.where("present and size > 0")
    shared = held.groupBy("size").count().where("count > 1").select("size")
    stale = ~(F.col("sha_size").eqNullSafe(F.col("size")) & F.col("sha_mtime").eqNullSafe(F.col("mtime")))
    return held.where(stale).join(shared, "size", "left_semi")


def signature_candidates(media: DataFrame) -> DataFrame:
    """Present media whose similarity hash is missing or stale."""
    return media.where("present and size > 0").where(~(F.col("sig_size").eqNullSafe(F.col("size")) & F.col("sig_mtime").eqNullSafe(F.col("mtime"))))


def indexed(media: DataFrame, measured: DataFrame) -> DataFrame:
    """Media after similarity hashes were measured (id, phash, duration): files that couldn't be read are stamped too, so they
    are not tried again until they change; a length that couldn't be measured stays as it was."""
    new = measured.select("id", F.col("phash").alias("_phash"), F.col("duration").alias("_duration"), F.lit(True).alias("_tried"))
    met = media.join(new, "id", "left")
    made = {"phash": F.col("_phash"), "sig_size": F.col("size"), "sig_mtime": F.col("mtime"), "duration": F.coalesce("_duration", "duration")}
    return met.select(*[F.when(F.col("_tried"), made[c]).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in media.columns])


def index_run(candidates: DataFrame, measure: Callable[[DataFrame], DataFrame], store: str, batches: int, cancelled: Callable[[], bool] = lambda: False) -> int:
    """Measure candidates in batches, each of which is appended to the table ``store``, until done or cancelled.

    A run that was cancelled or lost goes on where it ended: what the store has is not measured again. Returns the number of
    batches that were written.
    """
    spark = candidates.sparkSession
    done = 0
    for number in range(batches):
        if cancelled():
            break
        batch = candidates.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == number)
        if table_exists(spark, store):
            batch = batch.join(spark.read.parquet(store).select("id"), "id", "left_anti")
        measure(batch).write.mode("append").parquet(store)
        done += 1
    return done


def exact_members(media: DataFrame, by_size: bool = False) -> DataFrame:
    """Present media whose content another one has, a row each: sha256, size, id, n, group_id (the smallest id), first_path."""
    keys = ["sha256", "size"] if by_size else ["sha256"]
    rows = media.where("present and size > 0 and sha256 is not null")
    group = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("group_id"), F.min(fold_unicode(F.col("rel_path"))).alias("first_path"))
    return rows.select("id", "sha256", "size").join(group.where("n > 1"), keys).select("sha256", "size", "id", "n", "group_id", "first_path")


def exact_groups(media: DataFrame, by_size: bool = False) -> DataFrame:
    """Groups of present media with equal content, the largest files first: group_id, sha256, size, n, first_path."""
    keys = ["sha256", "size"] if by_size else ["sha256"]
    rows = media.where("present and size > 0 and sha256 is not null")
    facts = [F.max("size").alias("size")] if not by_size else []
    group = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("group_id"), F.min(fold_unicode(F.col("rel_path"))).alias("first_path"), *facts)
    return group.where("n > 1").select("group_id", "sha256", "size", "n", "first_path").orderBy(F.desc("size"), "first_path")


def exact_stats(media: DataFrame) -> DataFrame:
    """files, unknown_sizes (not above 0) and hashed: files whose content must be read as another has their size."""
    here = media.where("present")
    sizes = here.where("size > 0").groupBy("size").count().where("count > 1")
    one = here.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.coalesce("size", F.lit(0)) <= 0).alias("unknown_sizes"))
    return one.join(sizes.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("hashed")), F.lit(True)).select("files", "unknown_sizes", "hashed")


def near_pairs(hashes: DataFrame, max_distance: int, partition: str | None = "type") -> DataFrame:
    """Pairs a < b of (id, h) rows with at most ``max_distance`` different bits: a, b, distance.

    Blocks of rows are compared as arrays (``near_blocks``): near hashes share their pieces with far more that are not near, so
    keys of pieces would meet about as many candidates, a row each.
    """
    kind = F.col(partition) if partition else F.lit("")
    return near_blocks.all_pairs(hashes.select("id", "h", kind.alias("kind"), F.lit(0.0).alias("length")), clamped(max_distance))


def _edges(max_distance: int) -> list[int]:
    chunks = clamped(max_distance) + 2
    return [round(64 * i / chunks) for i in range(chunks + 1)]


def chunk_keys(folded: DataFrame, max_distance: int) -> DataFrame:
    """Rows (h, kind, ...) once for every two chunks of the hash: adds key, which chunks they are and what is in them."""
    edges = _edges(max_distance)
    chunks = len(edges) - 1

    def piece(h: Column, i: int) -> Column:
        return F.shiftrightunsigned(h, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1).cast("long"))

    h = F.col("h")
    keys = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), piece(h, i).alias("v"), piece(h, j).alias("w")) for i in range(chunks) for j in range(i + 1, chunks)]
    return folded.withColumn("key", F.explode(F.array(*keys)))


def near_links(hashes: DataFrame, max_distance: int) -> DataFrame:
    """Links enough for the groups of ``near_pairs``: files with one hash are linked to the smallest of them only."""
    return near_blocks.group_links(hashes.select("id", "h", F.col("type").alias("kind"), F.lit(0.0).alias("length")), clamped(max_distance))


def video_links(videos: DataFrame, max_distance: int) -> DataFrame:
    """Links enough for the groups of videos (id, h, duration) with near hashes and matching lengths: a, b."""
    return near_blocks.group_links(videos.select("id", "h", F.lit("").alias("kind"), F.col("duration").alias("length")), clamped(max_distance))


def video_pairs(videos: DataFrame, max_distance: int) -> DataFrame:
    """All pairs a < b of videos (id, h, duration) with near hashes and matching lengths: a, b, distance.

    Blocks are cut by length, so those whose lengths can't match don't meet.
    """
    return near_blocks.all_pairs(videos.select("id", "h", F.lit("").alias("kind"), F.col("duration").alias("length")), clamped(max_distance))


def durations_match(a: Column, b: Column) -> Column:
    """Whether two lengths are within a second or 2 % of the longer; unknown ones are not."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(1.0), 0.02 * F.greatest(a, b)) + F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(0.0), F.lit(False))


def with_durations(pairs: DataFrame, media: DataFrame) -> DataFrame:
    """Pairs of videos only where their lengths match; other pairs stay."""
    x = media.select(F.col("id").alias("a"), F.col("type").alias("type_a"), F.col("duration").alias("duration_a"))
    y = media.select(F.col("id").alias("b"), F.col("duration").alias("duration_b"))
    met = pairs.join(x, "a").join(y, "b")
    return met.where((F.col("type_a") != "video") | durations_match(F.col("duration_a"), F.col("duration_b"))).select(*pairs.columns)


def find_members(media: DataFrame, *, exact: bool = True, similar: bool = True, max_distance: int = DEFAULT_DISTANCE) -> DataFrame:
    """Members of groups of duplicates: the media's columns, sha (the fresh content hash) and group_id (smallest id).

    Equal content links files of any type (``exact``); similar hashes link photos with photos and videos with videos
    of matching length (``similar``).
    """
    fresh_hashes = {"sha": fresh("sha256", "sha_size", "sha_mtime"), "h": fresh("phash", "sig_size", "sig_mtime")}
    # the hashes are needed several times, what they are made of is read once
    rows = materialise(media.where("present and size > 0").withColumns(fresh_hashes), "hashed-media")
    links = rows.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    if exact:
        same = rows.where("sha is not null")
        first = same.groupBy("sha").agg(F.min("id").alias("a"))
        links = links.unionByName(same.join(first, "sha").where("id <> a").select("a", F.col("id").alias("b")))
    if similar:
        length = F.when(F.col("type") == "photo", 0.0).otherwise(F.col("duration"))
        files = rows.where("type in ('photo', 'video')").select("id", "h", F.col("type").alias("kind"), length.alias("length"))
        links = links.unionByName(near_blocks.group_links(files, clamped(max_distance)))
    return rows.join(connected_components(links).withColumnRenamed("label", "group_id"), "id")


def members_in_order(members: DataFrame) -> DataFrame:
    """Members with their place in the group: the largest first, then by folded path."""
    order = Window.partitionBy("group_id").orderBy(F.desc("size"), fold_unicode(F.col("rel_path")), "id")
    return members.select("group_id", "id", "rel_path", "size", F.row_number().over(order).alias("place"))


def groups_of(members: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """Facts of groups: group_id, kind, n, sig, top_size, top_path (of the largest member), first_path.

    A group is exact if all members have one fresh content hash. Groups whose members, no more and no fewer, are in
    ``ignored`` (sig) are left out.
    """
    path = fold_unicode(F.col("rel_path"))
    top = F.min(F.struct((-F.col("size")).alias("s"), path.alias("p")))
    groups = members.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n"),
        ((F.count("sha") == F.count(F.lit(1))) & (F.min("sha") == F.max("sha"))).alias("exact"),
        signature(F.col("id")).alias("sig"),
        top.alias("top"),
        F.min(path).alias("first_path"),
    )
    kind = F.when(F.col("exact"), "exact").otherwise("similar")
    facts = groups.select("group_id", kind.alias("kind"), "n", "sig", (-F.col("top.s")).alias("top_size"), F.col("top.p").alias("top_path"), "first_path")
    return facts if ignored is None else facts.join(ignored.select("sig"), "sig", "left_anti")


def find_groups(media: DataFrame, *, ignored: DataFrame | None = None, **options) -> DataFrame:
    """``groups_of`` the members that ``find_members`` finds with these options."""
    return groups_of(find_members(media, **options), ignored)


def signature(ids: Column) -> Column:
    """A group's name in the list of ignored groups, an aggregate: the number of its members and two sums of hashes of their ids."""
    return F.concat_ws("-", F.count(ids), F.hex(F.bit_xor(F.xxhash64(ids))), F.hex(F.bit_xor(F.xxhash64(F.lit(1), ids))))


def group_order() -> list[Column]:
    """Exact groups first, then by the largest member, then by its path."""
    return [F.col("kind").asc(), F.col("top_size").desc(), F.col("top_path").asc()]


def summary(groups: DataFrame) -> DataFrame:
    """groups, files and extra files by kind."""
    return groups.groupBy("kind").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("files"), F.sum(F.col("n") - 1).alias("extra_files"))


def by_first_path() -> list[Column]:
    """The mobile order of groups."""
    return [F.col("first_path").asc()]


def keep_outcomes(media: DataFrame, choices: DataFrame) -> DataFrame:
    """Whether each file of ``choices`` (keep_id, remove_id, kind) goes: keep_id, remove_id, kind, rel_path, outcome.

    Files that the catalog doesn't have, and the kept file itself, are left out. A file stays if the kept one is missing,
    if it is missing itself, and in exact groups if its content is no longer that of the kept one.
    """
    x = media.where("present").select(F.col("id").alias("keep_id"), F.col("sha256").alias("keep_sha"), F.lit(True).alias("kept"))
    y = media.select(F.col("id").alias("remove_id"), "rel_path", F.col("sha256").alias("own_sha"), F.col("present").alias("there"))
    met = choices.where("keep_id <> remove_id").join(y, "remove_id").join(x, "keep_id", "left")
    outcome = (
        F.when(F.col("kept").isNull(), "the file to keep is missing")
        .when(~F.col("there"), "file not found")
        .when((F.col("kind") == "exact") & ~F.col("own_sha").eqNullSafe(F.col("keep_sha")), "its content is no longer that of the kept file")
        .otherwise("removed")
    )
    return met.select("keep_id", "remove_id", "kind", "rel_path", outcome.alias("outcome"))


def kept_one(links: DataFrame, media: DataFrame, choices: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """Tag changes and ids to drop when one file of each group is kept, for those that ``keep_outcomes`` lets go.

    The kept file gets the live tags of those that go.
    """
    fine = keep_outcomes(media, choices).where("outcome = 'removed'")
    live = links.where("not deleted").join(fine.select(F.col("remove_id").alias("media_id"), "keep_id"), "media_id")
    changes = live.select(F.col("keep_id").alias("media_id"), "tag_key", "tag", F.lit(float(now)).alias("updated_at"), F.lit(False).alias("deleted")).dropDuplicates(["media_id", "tag_key"])
    return changes, fine.select(F.col("remove_id").alias("id")).distinct()
