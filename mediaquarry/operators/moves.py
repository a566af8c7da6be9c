"""Replay of move records, in their order, by joins.

What a move does depends on what its two paths hold at its turn, and so on the moves before it that touch these paths. Of each path
the touches are numbered in order. A turn of the replay takes the outcomes of all moves as given; each touch then finds
what its path holds by following where that came from: the touch before it, or the path that a file was moved from, or the catalog. These ways
are followed by doubling, so a file that is moved n times costs log2(n) joins. All moves are then judged anew. The earliest
outcome that was wrong has right ones before it, so each turn puts it right, and outcomes that stay are those of a replay one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaquarry.functions.text import dirname, fold_ascii, safe_path
from mediaquarry.operators.pointers import followed, placed
from mediaquarry.storage import materialise


def _folder(path: str) -> Column:
    return F.lower(dirname(F.col(path)))


def _name(path: str) -> Column:
    return F.substring_index(path, "/", -1)


def checked(moves: DataFrame, log: DataFrame) -> DataFrame:
    """Moves with valid (a well-formed record) and known (its whole record is in the log)."""
    known = log.select(*[F.col(c).alias(f"_{c}") for c in ("from_path", "to_path", "size", "moved_at")], F.lit(True).alias("_known")).distinct()
    same = (F.col("from_path") == F.col("_from_path")) & (F.col("to_path") == F.col("_to_path")) & (F.col("size") == F.col("_size")) & (F.col("moved_at") == F.col("_moved_at"))
    valid = F.coalesce(safe_path(F.col("from_path")) & safe_path(F.col("to_path")) & F.col("size").isNotNull() & F.col("moved_at").isNotNull(), F.lit(False))
    return moves.join(known, same, "left").withColumns({"known": F.coalesce("_known", F.lit(False)), "valid": valid}).select(*moves.columns, "known", "valid")


def _fixed() -> Column:
    """The outcome of a ``checked`` move that doesn't depend on any medium, else null."""
    same_folder, same_name = _folder("from_path") == _folder("to_path"), _name("from_path") == _name("to_path")
    return (
        F.when(~F.col("valid"), "skipped: malformed record")
        .when(same_folder & same_name, "unchanged")
        .when(~same_folder & ~same_name, "skipped: move and rename in one")
        .when(F.col("known"), "known")
    )


def _judged() -> Column:
    """The outcome of a move, given what is at its paths: _source and _there, each a medium (id, size, present) or null."""
    source, there = F.coalesce("_source.present", F.lit(False)), F.coalesce("_there.present", F.lit(False))
    replaced = F.col("_source").isNotNull() & there & (F.col("_there.size") == F.col("size"))
    other_path = fold_ascii(F.col("from_path")) != fold_ascii(F.col("to_path"))
    return (
        F.when(~source & replaced, "relinked")
        .when(~source, "absent")
        .when(~F.col("_source.size").eqNullSafe(F.col("size")), "skipped: a different file")
        .when(other_path & F.col("_there").isNotNull(), "skipped: destination occupied")
        .otherwise("applied")
    )


def _medium() -> Column:
    return F.struct("id", F.col("size").cast("long").alias("size"), "present")


def judged_alone(media: DataFrame, moves: DataFrame) -> DataFrame:
    """``checked`` moves, each against the media as they are: outcome, id (the medium it moves or replaces) and replaced_by."""
    here = media.select(fold_ascii(F.col("rel_path")).alias("_path"), _medium().alias("m"))
    x, y = here.select(F.col("_path").alias("_x"), F.col("m").alias("_source")), here.select(F.col("_path").alias("_y"), F.col("m").alias("_there"))
    # keys are columns: a sort would fold one that is an expression in each comparison
    keyed = moves.withColumns({"_from": fold_ascii(F.col("from_path")), "_to": fold_ascii(F.col("to_path"))})
    met = keyed.join(x, F.col("_from") == F.col("_x"), "left").join(y, F.col("_to") == F.col("_y"), "left")
    return met.select(*moves.columns, F.coalesce(_fixed(), _judged()).alias("outcome"), F.col("_source.id").alias("id"), F.col("_there.id").alias("replaced_by"))


#: What a touch is of its move: where it comes from, where it goes, or both, where a name changes its letters' case only.
_FROM, _TO, _BOTH = 0, 1, 2


def _touches(moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Touches (node, path, prev, prev_move, prev_role, prev_from) and moves with their touches (move, to_node, ...).

    Touches are numbered by path and order; prev is the one before of the same path, null for a path's first. A move
    goes by the number of the touch that it comes from.
    """
    from_key, to_key = fold_ascii(F.col("from_path")), fold_ascii(F.col("to_path"))
    one = F.array(F.struct(from_key.alias("path"), F.lit(_BOTH).alias("role")))
    two = F.array(F.struct(from_key.alias("path"), F.lit(_FROM).alias("role")), F.struct(to_key.alias("path"), F.lit(_TO).alias("role")))
    each = moves.select("key", "seq", F.explode(F.when(from_key == to_key, one).otherwise(two)).alias("t")).select("key", "seq", "t.path", "t.role")
    nodes = materialise(placed(each, ["path", "seq", "key"], "touches-by-path").withColumnRenamed("_pos", "node"), "touches")
    own = nodes.groupBy("key").agg(F.min(F.when(F.col("role") != _TO, F.col("node"))).alias("move"), F.min(F.when(F.col("role") != _FROM, F.col("node"))).alias("to_node"))
    numbered = materialise(moves.join(own, "key"), "touching-moves")
    before = nodes.select((F.col("node") + 1).alias("node"), F.col("path").alias("_path"), F.col("key").alias("_key"), F.col("role").alias("prev_role"))
    met = nodes.select("node", "path").join(before, "node", "left")
    same = F.coalesce(F.col("_path") == F.col("path"), F.lit(False))
    met = met.select("node", "path", F.when(same, F.col("node") - 1).alias("prev"), F.when(same, F.col("_key")).alias("_key"), F.when(same, F.col("prev_role")).alias("prev_role"))
    met = met.join(numbered.select(F.col("key").alias("_key"), F.col("move").alias("prev_move")), "_key", "left").drop("_key")
    return materialise(met, "touches-in-order"), numbered


def judged_together(media: DataFrame, moves: DataFrame) -> DataFrame:
    """``checked`` moves without a fixed outcome that share paths: adds outcome, id and replaced_by, as if replayed one by one."""
    nodes, numbered = _touches(moves)
    here = media.select(fold_ascii(F.col("rel_path")).alias("path"), _medium().alias("m"))
    firsts = nodes.where("prev is null").select("node", "path").join(here, "path")
    start = materialise(firsts.groupBy("node").agg(F.max("m").alias("m")).withColumnRenamed("node", "end"), "media-at-start")
    judged = numbered.select("move", F.lit("applied").alias("outcome"))
    while True:
        given = judged.select(F.col("move").alias("prev_move"), F.col("outcome").alias("_was"))
        met = nodes.join(given, "prev_move", "left")
        left = (F.col("_was").isin("applied", "relinked")) & (F.col("prev_role") == _FROM)  # what was there is gone
        came = (F.col("_was") == "applied") & (F.col("prev_role") == _TO)
        way = F.when(F.col("prev").isNull() | left, F.lit(None)).when(came, F.col("prev_move")).otherwise(F.col("prev"))
        ends = followed(met.select(F.col("node").alias("id"), way.alias("next")))
        # ways that end where a file has left lead to nothing: only a path's first touch has a medium
        held = materialise(ends.join(start, "end").select(F.col("id").alias("node"), "m"), "media-at-touches")
        x = held.select(F.col("node").alias("move"), F.col("m").alias("_source"))
        y = held.select(F.col("node").alias("to_node"), F.col("m").alias("_there"))
        new = numbered.join(x, "move", "left").join(y, "to_node", "left")
        new = materialise(new.select(*numbered.columns, _judged().alias("outcome"), F.col("_source.id").alias("id"), F.col("_there.id").alias("replaced_by")), "judged-moves")
        wrong = new.join(judged.select("move", F.col("outcome").alias("_was")), "move").where("outcome <> _was")
        if wrong.isEmpty():
            return new.select(*moves.columns, "outcome", "id", "replaced_by")
        judged = new.select("move", "outcome")


def replayed(media: DataFrame, moves: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replay moves (from_path, to_path, size, moved_at, seq) in order.

    Returns the outcome of each move (key: its seq as JSON, outcome) and the media that changed (id, rel_path,
    replaced_by). A move whose paths no other move has is judged against the catalog at once; the others are judged
    together. Of media that share a folded path the one with the largest id counts.
    """
    # written, as finding the crowded moves and judging both kinds read them again
    rows = materialise(checked(moves, log).withColumn("key", F.to_json("seq")).withColumn("size", F.col("size").cast("long")), "checked-moves")
    ends = F.array_distinct(F.array(F.xxhash64(fold_ascii(F.col("from_path"))), F.xxhash64(fold_ascii(F.col("to_path")))))
    open_ = rows.where(_fixed().isNull())
    paths = open_.select("key", F.explode(ends).alias("_path"))
    shared = paths.groupBy("_path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_path")
    crowded = materialise(paths.join(shared, "_path", "left_semi").select("key").distinct(), "crowded-moves")

    judged = judged_alone(media, rows.join(crowded, "key", "left_anti"))
    if not crowded.isEmpty():
        judged = judged.unionByName(judged_together(media, rows.join(crowded, "key", "left_semi")))
    judged = materialise(judged.select("key", "seq", "outcome", "id", "from_path", "to_path", "replaced_by"), "replayed-moves")
    moved = F.col("outcome") == "applied"
    last = F.struct(F.when(moved, F.col("to_path")).otherwise(F.col("from_path")).alias("rel_path"), F.when(~moved, F.col("replaced_by")).alias("replaced_by"))
    changes = judged.where("outcome in ('applied', 'relinked')").groupBy("id").agg(F.max_by(last, F.struct("seq", "key")).alias("last"))
    return judged.select("key", "outcome"), changes.select("id", "last.rel_path", "last.replaced_by")


def with_albums(media: DataFrame, changes: DataFrame) -> DataFrame:
    """Media after a replay: new paths and folders; replaced rows go."""
    new = changes.select("id", F.col("rel_path").alias("_new"), "replaced_by")
    met = media.join(new, "id", "left").where("replaced_by is null")
    path = F.coalesce("_new", "rel_path")
    album = F.when(F.col("_new").isNotNull(), dirname(path)).otherwise(F.col("album"))
    return met.withColumns({"album": album, "rel_path": path}).select(*media.columns)
