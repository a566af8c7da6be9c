"""Merging tag records of other machines: validation, matching, holding, attaching, relinking, export."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaquarry.functions.text import basename, fold_ascii, fold_unicode, normalize_space, safe_path
from mediaquarry.operators.tags import accepted_records, apply
from mediaquarry.storage import materialise

MOVE_RETENTION_DAYS = 90
_LOG = ("from_path", "to_path", "size", "moved_at")


class Library(NamedTuple):
    """What an import changes: media, links, held records (path, tag, updated_at, deleted) and the log of moves."""

    media: DataFrame
    links: DataFrame
    pending: DataFrame
    log: DataFrame


def flat_records(documents: DataFrame) -> DataFrame:
    """Valid tag records of sync documents (file, doc): path, size, tag, updated_at, deleted, seq.

    A record needs a safe path and at least one valid tag; a tag needs a name and a finite time; a missing
    ``deleted`` is false. seq orders by file name, then place in the file.
    """
    media = documents.select("file", F.posexplode("doc.media").alias("pos", "m"))
    tags = media.where(safe_path(F.col("m.path"))).select("file", "pos", F.col("m.path").alias("path"), F.col("m.size").alias("size"), F.posexplode("m.tags").alias("at", "t"))
    time = F.col("t.updated_at")
    valid = (normalize_space(F.col("t.name")) != "") & time.isNotNull() & ~F.isnan(time) & (F.abs(time) < float("inf"))
    order = F.struct("file", "pos", "at")
    return tags.where(valid).select(
        "path", "size", normalize_space(F.col("t.name")).alias("tag"), time.alias("updated_at"), F.coalesce("t.deleted", F.lit(False)).alias("deleted"), order.alias("seq")
    )


def flat_moves(documents: DataFrame) -> DataFrame:
    """Move records of sync documents in the order of replay: from_path, to_path, size, moved_at, seq."""
    moves = documents.select("file", F.posexplode("doc.moves").alias("pos", "m"))
    return moves.select(
        F.col("m.from").alias("from_path"), F.col("m.to").alias("to_path"), F.col("m.size").alias("size"), F.col("m.at").alias("moved_at"),
        F.struct(F.coalesce("m.at", F.lit(0.0)), "file", "pos").alias("seq"),
    )


def _keyed(records: DataFrame) -> DataFrame:
    """Records with their folded path and file name as columns: a sort would fold a key that is an expression in each comparison."""
    return records.withColumns({"_own_path": fold_ascii(F.col("path")), "_own_name": fold_ascii(basename(F.col("path")))})


def matched(records: DataFrame, media: DataFrame) -> DataFrame:
    """Records with media_id, null where they must be held.

    A record belongs to the medium with its path. If none has it, present or not, it belongs to the only
    present medium with its file name and size; a null size fits any. A path that belongs to an absent
    medium holds the record.
    """
    paths = media.select(fold_ascii(F.col("rel_path")).alias("_path"), F.col("id").alias("_at"), F.col("present").alias("_there"))
    # one row for each name and size, and one for each name alone for records without a size
    named = media.where("present").select(fold_ascii(basename(F.col("rel_path"))).alias("_name"), "size", "id")
    sized = named.groupBy("_name", F.col("size").cast("long").alias("_size")).agg(F.min("id").alias("_only"), F.count(F.lit(1)).alias("_n"))
    loose = named.groupBy("_name").agg(F.min("id").alias("_only"), F.count(F.lit(1)).alias("_n")).select("_name", F.lit(None).cast("long").alias("_size"), "_only", "_n")
    unique = sized.unionByName(loose).where("_n = 1").select("_name", "_size", "_only")
    keyed = _keyed(records)
    met = keyed.join(paths, F.col("_own_path") == F.col("_path"), "left").join(unique, (F.col("_own_name") == F.col("_name")) & F.col("size").eqNullSafe(F.col("_size")), "left")
    found = F.when(F.col("_at").isNotNull(), F.when(F.col("_there"), F.col("_at"))).otherwise(F.col("_only"))
    return met.withColumn("media_id", found).select(*records.columns, "media_id")


def matched_strictly(records: DataFrame, media: DataFrame) -> DataFrame:
    """The mobile rule: the present medium with the path and the size, else the only present one with the name and size."""
    here = media.where("present")
    paths = here.select(fold_ascii(F.col("rel_path")).alias("_path"), F.col("size").alias("_psize"), F.col("id").alias("_at"))
    named = here.groupBy(fold_ascii(basename(F.col("rel_path"))).alias("_name"), F.col("size").alias("_nsize")).agg(F.min("id").alias("_only"), F.count(F.lit(1)).alias("_n"))
    met = _keyed(records).join(paths, (F.col("_own_path") == F.col("_path")) & (F.col("size") == F.col("_psize")), "left").join(
        named.where("_n = 1"), (F.col("_own_name") == F.col("_name")) & (F.col("size") == F.col("_nsize")), "left"
    )
    return met.withColumn("media_id", F.coalesce("_at", "_only")).select(*records.columns, "media_id")


def strict_records(records: DataFrame, longest: int = 1024) -> DataFrame:
    """Records that the mobile reader takes: sizes of 0 or more, tag names up to ``longest`` characters, finite times."""
    time = F.col("updated_at")
    finite = time.isNotNull() & ~F.isnan(time) & (F.abs(time) < float("inf"))
    return records.where((F.coalesce("size", F.lit(0)) >= 0) & (F.length("tag") <= longest) & (normalize_space(F.col("tag")) != "") & finite)


def strict_documents(documents: DataFrame, longest: int = 128) -> DataFrame:
    """Documents that the mobile reader takes: version 1 or more, and a machine id of 1 to ``longest`` characters that is not blank."""
    machine = F.coalesce("doc.machine_id", F.lit(""))
    return documents.where((F.col("doc.version") >= 1) & (F.trim(machine) != "") & (F.length(machine) <= longest))


def import_counts(links: DataFrame, records: DataFrame) -> DataFrame:
    """Counters of an import of matched records that changes nothing: records, held, accepted, changed."""
    all_ = records.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("media_id").isNull()).alias("held"))
    return all_.join(change_count(links, records), F.lit(True)).select("records", "held", "accepted", "changed")


def merged(links: DataFrame, records: DataFrame) -> DataFrame:
    """Links after matched records, in their order: strictly newer ones win, ties keep what is there."""
    return _spelled(_registers(_stored(links), records))


def _stored(links: DataFrame) -> DataFrame:
    """Links as they come before all records: media_id, tag, updated_at, deleted, late."""
    return links.select("media_id", "tag", "updated_at", "deleted", F.lit(0).alias("late"))


def _rekeyed(links: DataFrame, moved: DataFrame) -> DataFrame:
    """``_stored`` links, those of media in ``moved`` (media_id, to_id) under their new id, after what is there: as ``move_tags`` has them."""
    to = moved.select(F.col("media_id").alias("_from"), F.col("to_id").alias("_to"))
    went = F.col("_from").isNotNull()
    met = links.join(to, F.col("media_id") == F.col("_from"), "left")
    return met.select(F.when(went, F.col("_to")).otherwise(F.col("media_id")).alias("media_id"), "tag", "updated_at", "deleted", went.cast("int").alias("late"))


#: What is late as a record of another machine; what was here before is 0 or 1.
_NEW = 2


def _registers(stored: DataFrame, records: DataFrame) -> DataFrame:
    """Each register after matched records, in their order, on top of ``_stored`` links: one row, from one sort of all rows.

    media_id, tag_key, link (its updated_at and deleted), first (late, seq and tag of its first row), and how many records
    were accepted and changed what is visible.
    """
    seq = records.schema["seq"].dataType
    new = records.where("media_id is not null").select("media_id", "tag", "updated_at", "deleted", F.lit(_NEW).alias("late"), "seq")
    marked = accepted_records(stored.withColumn("seq", F.lit(None).cast(seq)).unionByName(new), ("late", "seq"))
    place = F.row_number().over(Window.partitionBy("media_id", "tag_key").orderBy("late", "seq"))
    late = F.col("late") == _NEW
    return marked.withColumn("place", place).groupBy("media_id", "tag_key").agg(
        F.max_by(F.struct("updated_at", "deleted"), F.struct("updated_at", -F.col("place"))).alias("link"),
        F.min(F.struct("late", "seq", "tag")).alias("first"), F.count_if(late & F.col("accepted")).alias("accepted"), F.count_if(late & F.col("changed")).alias("changed"),
    )


def _spelled(registers: DataFrame, name: str | None = None) -> DataFrame:
    """The links of ``_registers``, a tag spelled as where it was first; with ``name`` the spellings are written."""
    spelled = registers.groupBy("tag_key").agg(F.min("first").alias("f")).select("tag_key", "f.tag")
    spelled = materialise(spelled, name) if name else spelled
    return registers.join(spelled, "tag_key").select("media_id", "tag_key", "tag", "link.updated_at", "link.deleted")


def _summed(registers: DataFrame) -> DataFrame:
    """How many records of ``_registers`` were accepted and changed what is visible: changed, accepted."""
    return registers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("changed", "accepted")])


def change_count(links: DataFrame, records: DataFrame) -> DataFrame:
    """How many records change what is visible: changed, accepted."""
    return _summed(_registers(_stored(links), records))


def held(pending: DataFrame, records: DataFrame) -> DataFrame:
    """Pending records (path, tag, updated_at, deleted) after unmatched ones: the newest of each path and tag."""
    new = records.where("media_id is null").select("path", "tag", "updated_at", "deleted", F.lit(1).alias("late"))
    both = pending.select("path", "tag", "updated_at", "deleted", F.lit(0).alias("late")).unionByName(new)
    keys = [fold_ascii(F.col("path")).alias("_p"), fold_ascii(F.col("tag")).alias("_t")]
    newest = F.max_by(F.struct("path", "tag", "updated_at", "deleted"), F.struct("updated_at", -F.col("late")))
    return both.groupBy(*keys).agg(newest.alias("r")).select("r.*")


def _held_registers(pending: DataFrame, records: DataFrame) -> DataFrame:
    """Pending records after unmatched ones, in their order: record (the newest of its path and tag) and how many of the new ones were held."""
    kept = ("path", "tag", "updated_at", "deleted")
    new = records.where("media_id is null").select(*kept, F.lit(1).alias("late"), "seq")
    both = pending.select(*kept, F.lit(0).alias("late"), F.lit(None).cast(records.schema["seq"].dataType).alias("seq")).unionByName(new)
    own = Window.partitionBy("_p", "_t").orderBy("late", "seq")
    newest = F.max("updated_at").over(own.rowsBetween(Window.unboundedPreceding, -1))
    held_ = (F.col("late") == 1) & (F.col("newest").isNull() | (F.col("updated_at") > F.col("newest")))
    marked = both.withColumns({"_p": fold_ascii(F.col("path")), "_t": fold_ascii(F.col("tag"))}).withColumns({"newest": newest, "place": F.row_number().over(own)})
    return marked.groupBy("_p", "_t").agg(F.max_by(F.struct(*kept), F.struct("updated_at", -F.col("place"))).alias("record"), F.count_if(held_).alias("held"))


def attached(links: DataFrame, pending: DataFrame, media: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and pending records after held ones whose file is here now have been merged."""
    paths = media.where("present").select(fold_ascii(F.col("rel_path")).alias("_path"), F.col("id").alias("media_id"))
    own = pending.withColumn("_own", fold_ascii(F.col("path")))
    here = own.join(paths, F.col("_own") == F.col("_path")).select("media_id", fold_ascii(F.col("tag")).alias("tag_key"), "tag", "updated_at", "deleted")
    return apply(links, here), own.join(paths, F.col("_own") == F.col("_path"), "left_anti").drop("_own")


def relinks(media: DataFrame, links: DataFrame) -> DataFrame:
    """Vanished media with tags and the new files that replace them: old_id, new_id.

    Both must be the only one of their side with the root, file name and size.
    """
    key = ["root", "name", "size"]
    rows = media.withColumn("name", fold_unicode(F.col("filename")))
    tagged = links.select(F.col("media_id").alias("id")).distinct()
    gone = rows.where("not present").join(tagged, "id", "left_semi").groupBy(*key).agg(F.min("id").alias("old_id"), F.count(F.lit(1)).alias("n_old"))
    here = rows.where("present").groupBy(*key).agg(F.min("id").alias("new_id"), F.count(F.lit(1)).alias("n_new"))
    return gone.where("n_old = 1").join(here.where("n_new = 1"), key).select("old_id", "new_id")


def relinked(media: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Media and links after relinking: newer links win, the vanished rows go."""
    from mediaquarry.operators.tags import move_tags

    found = relinks(media, links)
    moved = move_tags(links, found.select(F.col("old_id").alias("media_id"), F.col("new_id").alias("to_id")))
    return media.join(found.select(F.col("old_id").alias("id")), "id", "left_anti"), moved


def export(media: DataFrame, links: DataFrame) -> DataFrame:
    """Nested export records of present media with tags: path, size, tags (by name, tombstones too)."""
    tag = F.struct("tag_key", F.col("tag").alias("name"), "updated_at", "deleted")
    met = media.where("present").join(links, F.col("id") == F.col("media_id"))
    nested = met.groupBy("id", F.col("rel_path").alias("path"), "size").agg(F.sort_array(F.collect_list(tag)).alias("tags"))
    return nested.select("path", "size", F.transform("tags", lambda t: F.struct(t["name"].alias("name"), t["updated_at"].alias("updated_at"), t["deleted"].alias("deleted"))).alias("tags"))


def imported(library: Library, records: DataFrame, moves: DataFrame, apply_moves: bool = True) -> tuple[Library, DataFrame]:
    """Other machines' data merged in: all moves by time, then tag records in their order, then relinking, then attaching.

    ``records`` and ``moves`` as ``flat_records`` and ``flat_moves`` return them. Returns the library afterwards and
    one row of counters: moves_applied, moves_skipped, tags_changed, held.
    """
    return imported_with_outcomes(library, records, moves, apply_moves)[:2]


def imported_with_outcomes(library: Library, records: DataFrame, moves: DataFrame, apply_moves: bool = True) -> tuple[Library, DataFrame, DataFrame]:
    """``imported``, and the outcome of each move (key, outcome)."""
    from mediaquarry.operators.moves import replayed, with_albums
    from mediaquarry.operators.scan import after_scan

    media, links, pending, log = library
    outcomes, stored = None, _stored(links)
    if apply_moves:
        outcomes, changes = replayed(media, moves, log)
        outcomes, changes = materialise(outcomes, "move-outcomes"), materialise(changes, "moved-media")
        done = outcomes.where("outcome = 'applied'").select("key")
        log = log.select(*_LOG).unionByName(moves.withColumn("key", F.to_json("seq")).join(done, "key", "left_semi").select(*_LOG))
        stored = _rekeyed(links, changes.where("replaced_by is not null").select(F.col("id").alias("media_id"), F.col("replaced_by").alias("to_id")))
        media = with_albums(media, changes)
    found = materialise(matched(records, media), "matched-records")
    # written in between, so that no later step works the earlier ones out again; links and held records are worked out once, with their counters
    registers, waiting = materialise(_registers(stored, found), "merged-links"), materialise(_held_registers(pending, found), "held-records")
    counters = _counters(outcomes, _summed(registers), waiting.agg(F.coalesce(F.sum("held"), F.lit(0)).alias("held")))
    links, pending = _spelled(registers, "spelled-tags"), waiting.select("record.*")
    media, links, pending = after_scan(media, links, pending)
    if outcomes is None:
        outcomes = moves.select(F.to_json("seq").alias("key"), F.lit("not asked for").alias("outcome"))
    return Library(media, links, pending, log), counters, outcomes


def skipped_moves(moves: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The moves that an import passed over: from_path, to_path, reason."""
    skipped = outcomes.where(F.col("outcome").startswith("skipped: ")).select("key", F.substring("outcome", len("skipped: ") + 1, 1 << 10).alias("reason"))
    return moves.withColumn("key", F.to_json("seq")).join(skipped, "key").select("from_path", "to_path", "reason")


def skip_reasons(outcomes: DataFrame) -> DataFrame:
    """How many moves were passed over for each reason: reason, n."""
    skipped = outcomes.where(F.col("outcome").startswith("skipped: "))
    return skipped.groupBy(F.substring("outcome", len("skipped: ") + 1, 1 << 10).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def dry_run(library: Library, records: DataFrame, moves: DataFrame, apply_moves: bool = True) -> DataFrame:
    """The counters of an import that changes nothing: every move and record is judged against the library as it is."""
    from mediaquarry.operators.moves import checked, judged_alone

    outcomes = judged_alone(library.media, checked(moves, library.log)).select("outcome") if apply_moves else None
    found = matched(records, library.media)
    old = library.links.select(F.col("media_id").alias("_of"), F.col("tag_key").alias("_key"), F.col("updated_at").alias("_time"), F.col("deleted").alias("_gone"))
    keyed = found.where("media_id is not null").withColumn("_own", fold_ascii(F.col("tag")))
    met = keyed.join(old, (F.col("media_id") == F.col("_of")) & (F.col("_own") == F.col("_key")), "left")
    newer = F.col("_time").isNull() | (F.col("updated_at") > F.col("_time"))
    changed = met.agg(F.count_if(newer & (F.coalesce("_gone", F.lit(True)) != F.coalesce("deleted", F.lit(False)))).alias("changed"))
    return _counters(outcomes, changed, found.agg(F.count_if(F.col("media_id").isNull()).alias("held")))


def _counters(outcomes: DataFrame | None, changed: DataFrame, held_: DataFrame) -> DataFrame:
    """One row: moves_applied, moves_skipped, tags_changed, held."""
    one = changed.select(F.col("changed").alias("tags_changed")).join(held_, F.lit(True))
    if outcomes is None:
        return one.select(F.lit(0).cast("long").alias("moves_applied"), F.lit(0).cast("long").alias("moves_skipped"), "tags_changed", "held")
    moved = outcomes.agg(F.count_if(F.col("outcome") == "applied").alias("moves_applied"), F.count_if(F.col("outcome").startswith("skipped")).alias("moves_skipped"))
    return moved.join(one, F.lit(True)).select("moves_applied", "moves_skipped", "tags_changed", "held")


def retained_moves(moves: DataFrame, now: float) -> DataFrame:
    """Move records that aren't older than the retention time."""
    return moves.where(F.col("moved_at") >= now - MOVE_RETENTION_DAYS * 86400)


def unknown_moves(moves: DataFrame, log: DataFrame) -> DataFrame:
    """Moves whose whole record isn't in the log."""
    key = ["from_path", "to_path", "size", "moved_at"]
    return moves.join(log.select(*key), key, "left_anti")


def summary_line(tags: Column, moves: Column, held: Column, skipped: Column, errors: Column) -> Column:
    """An import's counters as text: the first two always, the others where they aren't zero."""

    def part(n: Column, what: str) -> Column:
        return F.when(n != 0, F.concat(n.cast("string"), F.lit(what)))

    first = [F.concat(tags.cast("string"), F.lit(" tag change(s)")), F.concat(moves.cast("string"), F.lit(" file move(s)"))]
    rest = [part(held, " record(s) for files not on this machine"), part(skipped, " move(s) skipped"), part(errors, " file problem(s)")]
    return F.concat_ws(", ", *first, *rest)
