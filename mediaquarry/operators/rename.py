"""Batch renames: numbered names, plans with their problems, and the catalog after a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaquarry.functions.text import basename, dirname, extension, filename_problem, fold_ascii, fold_unicode, join_path, zero_filled
from mediaquarry.operators.pointers import followed
from mediaquarry.storage import materialise


def numbered_names(chosen: DataFrame, base: str, start: int = 1, digits: int = 1, number: bool = True) -> DataFrame:
    """New names for (id, pos, filename): base, number in the order of pos, and the file's own extension."""
    text = zero_filled(F.col("pos") + F.lit(start), digits) if number else F.lit("")
    return chosen.withColumn("new_name", F.concat(F.lit(base.strip()), text, extension(F.col("filename"))))


def numbered_plan(media: DataFrame, chosen: DataFrame, base: str, start: int = 1, digits: int = 1, number: bool = True) -> DataFrame:
    """``rename_plan`` of numbered names for (id, pos). Several files without numbers are refused as a whole, before any other check."""
    rows = chosen.join(media.select("id", basename(F.col("rel_path")).alias("filename")), "id")
    plan = rename_plan(media, numbered_names(rows, base, start, digits, number).select("id", "pos", "new_name"))
    return plan if number or rows.limit(2).count() < 2 else plan.withColumn("status", F.lit("several files need numbers so that their names differ"))


def rename_plan(media: DataFrame, names: DataFrame) -> DataFrame:
    """Judge renames (id, pos, new_name): id, old_path, new_path, status.

    Status: ok, unchanged, or a problem: the file is missing, the name is bad, two files would get the
    same name (all but the first by pos), the name is taken, or an older record has it. A plan can be
    applied if it has no problem (see ``is_applicable``).
    """
    rows = media.select("id", "rel_path", "root", "present")
    met = names.join(rows, "id", "left").withColumn("new_path", join_path(dirname(F.col("rel_path")), F.col("new_name")))
    bad = filename_problem(F.col("new_name"))
    status = (
        F.when(~F.coalesce("present", F.lit(False)), "file is missing").when(bad.isNotNull(), bad).when(F.col("new_path") == F.col("rel_path"), "unchanged")
    )
    judged = met.withColumn("status", status)
    open_ = F.col("status").isNull()
    # candidates are numbered within their target; the others each have a number of their own
    target = F.when(open_, fold_unicode(F.col("new_path"))).otherwise(F.concat(F.lit("\0"), F.col("id").cast("string")))
    turn = F.row_number().over(Window.partitionBy("target").orderBy("pos"))
    judged = judged.withColumn("target", target).withColumn("turn", turn)
    taken = media.select(fold_ascii(F.col("rel_path")).alias("_path"), F.col("id").alias("_other"), F.col("present").alias("_there"))
    batch = judged.where(open_).select(F.col("id").alias("_mover"))
    taken = taken.join(batch, F.col("_other") == F.col("_mover"), "left").groupBy("_path").agg(
        F.max(F.col("_there") & F.col("_mover").isNull()).alias("_blocked"), F.max(~F.col("_there") & F.col("_mover").isNull()).alias("_older")
    )
    met = judged.join(taken, fold_ascii(F.col("new_path")) == F.col("_path"), "left")
    final = (
        F.when(F.col("status").isNotNull(), F.col("status"))
        .when(F.col("turn") > 1, "two files would get the same name")
        .when(F.col("_blocked"), "the name is taken")
        .when(F.col("_older"), "an older record has that name")
        .otherwise("ok")
    )
    return met.select("id", F.col("rel_path").alias("old_path"), "new_path", final.alias("status"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with n, their place from 1 on by folded path: places within the parts of a range partitioning, after those of the parts before."""
    spread = rows.withColumn("_fold", fold_unicode(F.col("old_path"))).repartitionByRange("_fold", "id").withColumn("_part", F.spark_partition_id())
    held = materialise(spread, "paths-by-range")
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # one row a partition
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = F.broadcast(sizes.select("_part", before.alias("_before")))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_fold", "id"))
    return held.join(firsts, "_part").select("id", "old_path", (own + F.col("_before")).alias("n"))


def prefix_plan(media: DataFrame, chosen: DataFrame, prefix: str) -> DataFrame:
    """The mobile rename of ``chosen`` (id): the prefix, a number in the order of the folded paths from 1 on, and the own extension.

    Returns id, old_path, new_path, status: ok, or why not (the new names collide, or another file has the name). ValueError for
    a prefix that can't be one.
    """
    if not prefix or "/" in prefix or "\\" in prefix or prefix in (".", ".."):
        raise ValueError("a prefix is a part of a file name")
    rows = media.join(chosen.select("id").distinct(), "id", "left_semi").select("id", F.col("rel_path").alias("old_path"))
    numbered = _numbered(rows)
    name = F.concat(F.lit(prefix), F.col("n").cast("string"), extension(F.col("old_path")))
    named = numbered.withColumn("new_path", join_path(dirname(F.col("old_path")), name)).withColumn("_key", fold_unicode(F.col("new_path")))
    others = media.select(fold_unicode(F.col("rel_path")).alias("_key"), F.col("id").alias("_other"))
    met = named.join(others, "_key", "left").withColumn("twins", F.count(F.lit(1)).over(Window.partitionBy("_key")))
    taken = F.col("_other").isNotNull() & (F.col("_key") != fold_unicode(F.col("old_path")))
    status = F.when(F.col("twins") > 1, "the new names collide").when(taken, "another file has the name").otherwise("ok")
    return met.select("id", "old_path", "new_path", status.alias("status"))


def is_applicable(plan: DataFrame) -> DataFrame:
    """n_ok, n_unchanged, n_problems and ok: a plan is applied as a whole or not at all."""
    counts = plan.agg(
        F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "unchanged").alias("n_unchanged"), F.count(F.lit(1)).alias("n")
    )
    return counts.select("n_ok", "n_unchanged", (F.col("n") - F.col("n_ok") - F.col("n_unchanged")).alias("n_problems"), (F.col("n") == F.col("n_ok") + F.col("n_unchanged")).alias("ok"))


def renamed(media: DataFrame, plan: DataFrame) -> DataFrame:
    """Media after an applicable plan."""
    new = plan.where("status = 'ok'").select("id", F.col("new_path").alias("_new"))
    path = F.coalesce("_new", "rel_path")
    return media.join(new, "id", "left").withColumns({"rel_path": path, "filename": basename(path)}).select(*media.columns)


def rename_moves(media: DataFrame, plan: DataFrame, at: float) -> DataFrame:
    """The move records of an applied plan."""
    done = plan.where("status = 'ok'").join(media.select("id", "size"), "id")
    return done.select(F.col("old_path").alias("from_path"), F.col("new_path").alias("to_path"), "size", F.lit(float(at)).alias("moved_at"))


def rename_schedule(plan: DataFrame, aside: str = ".rename-") -> DataFrame:
    """The steps of an applicable plan in an order in which no step meets a name that is still in use.

    step_group, turn, id, kind, from_path, to_path: groups don't touch each other; within one, steps follow by turn. A file
    whose new name is free is a group by itself (single). Where a new name is another file's old one, that file goes
    first: the files of a chain go one after the other from its end (chain). Files in a circle (cycle) begin with one, that
    with the smallest id, that steps aside to a temporary name, ``aside`` and its id, in its folder, and ends with its step to the new one. Groups
    go by the id of their first file. A change of case alone meets its own old name, which is no other file's.
    """
    rows = plan.where("status = 'ok'").select("id", "old_path", "new_path")
    rows = materialise(rows.withColumns({"_old": fold_unicode(F.col("old_path")), "_new": fold_unicode(F.col("new_path"))}), "renames")
    owner = rows.select(F.col("_old").alias("_new"), F.col("id").alias("next"))
    links = rows.join(owner, "_new", "left").select("id", F.when(F.col("next") != F.col("id"), F.col("next")).alias("next"))
    links = materialise(links, "rename-links")
    ways = materialise(followed(links), "rename-ways")
    # a circle is cut where its smallest id begins
    circles = ways.where("end is null").select("id", "low")
    cut = links.join(circles, "id").select("id", F.when(F.col("id") != F.col("low"), F.col("next")).alias("next"))
    rounds = followed(cut).select("id", F.col("end").alias("step_group"), F.col("steps").alias("turn"), F.lit("cycle").alias("kind"))
    lines = ways.where("end is not null").select("id", F.col("end").alias("step_group"), F.col("steps").alias("turn"), F.lit(None).cast("string").alias("kind"))
    # a line's end is its first file; it is a chain if another follows
    longer = lines.where("turn > 0").select("step_group").distinct().withColumn("_longer", F.lit(True))
    lines = lines.join(longer, "step_group", "left").withColumn("kind", F.when(F.col("_longer"), "chain").otherwise("single")).drop("_longer")
    steps = lines.unionByName(rounds).join(rows, "id")
    temporary = join_path(dirname(F.col("old_path")), F.concat(F.lit(aside), F.col("id").cast("string"), extension(F.col("old_path"))))
    heads = (F.col("kind") == "cycle") & (F.col("turn") == 0)
    columns = ("step_group", "turn", "id", "kind", F.col("old_path").alias("from_path"))
    straight = steps.select(*columns, F.when(heads, temporary).otherwise(F.col("new_path")).alias("to_path"))
    lasts = rounds.groupBy("step_group").agg((F.max("turn") + 1).alias("last"))
    back = steps.where(heads).join(lasts, "step_group").select("step_group", F.col("last").alias("turn"), "id", "kind", temporary.alias("from_path"), F.col("new_path").alias("to_path"))
    return straight.unionByName(back)


def rolled_back(schedule: DataFrame, failed: DataFrame) -> DataFrame:
    """The steps that undo what was done of groups with a failed step (step_group, turn): the steps before it, backwards.

    step_group, turn from 0 on, id, from_path, to_path. The failed step itself changed nothing; other groups stay as they are.
    """
    done = schedule.join(failed.groupBy("step_group").agg(F.min("turn").alias("_failed")), "step_group").where(F.col("turn") < F.col("_failed"))
    return done.select("step_group", (F.col("_failed") - 1 - F.col("turn")).alias("turn"), "id", F.col("to_path").alias("from_path"), F.col("from_path").alias("to_path"))
