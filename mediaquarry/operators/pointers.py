"""Numbers in a global order, and links followed to their ends by doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaquarry.storage import materialise


def placed(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds _pos, the place from 0 on in the order of ``keys``, which must tell rows apart.

    Rows are sorted by ranges; a task's rows come after those of the tasks before it. Only the tasks' counts meet in one place.
    """
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    held = materialise(ranged.withColumn("_task", F.shiftright("_at", 33)), name)
    # one row a task
    sizes = held.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    shift = F.sum("_n").over(Window.orderBy("_task")) - F.col("_n") - F.shiftleft("_task", 33)
    return held.join(F.broadcast(sizes.select("_task", shift.alias("_shift"))), "_task").withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift")


def _doubled(rows: DataFrame) -> DataFrame:
    """Rows after each that is open has gone as far again as the row that it has reached."""
    ahead = rows.select(F.col("id").alias("_at"), F.col("at").alias("_next"), F.col("open").alias("_open"), F.col("steps").alias("_steps"), F.col("low").alias("_low"))
    met = rows.where("open").join(ahead, F.col("at") == F.col("_at")).select(
        "id", F.col("_next").alias("at"), F.col("_open").alias("open"), (F.col("steps") + F.col("_steps")).alias("steps"), F.least("low", "_low").alias("low"), "before"
    )
    return met.unionByName(rows.where("not open"))


def followed(links: DataFrame) -> DataFrame:
    """Links (id, next) followed as far as they lead: id, end, steps, low.

    ``next`` is another id of the table or null. end: the last id, and steps how many links lead there; both null in a cycle
    and where the way ends in one. low: the smallest id on the way, so that of a cycle in a cycle. How far a row has gone doubles, and
    doubles again, in each turn, so a chain of n links takes log2(n) joins; the table of each turn is written to the shared folder.
    """
    is_open = F.col("next").isNotNull()
    rows = links.select("id", F.coalesce("next", "id").alias("at"), is_open.alias("open"), is_open.cast("long").alias("steps"), F.col("id").alias("low"), F.col("id").alias("before"))
    rows = materialise(rows, "links")
    left = rows.where("open").count()
    while left:
        rows = materialise(_doubled(_doubled(rows.withColumn("before", F.col("low")))), "links")
        seen = rows.where("open").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("low") < F.col("before")).alias("news")).first()
        # a chain that is still open has shorter ones beside it that have just ended; only cycles are left where neither ends nor smaller ids come up
        if seen["n"] == left and not seen["news"]:
            break
        left = seen["n"]
    return rows.select("id", F.when(~F.col("open"), F.col("at")).alias("end"), F.when(~F.col("open"), F.col("steps")).alias("steps"), "low")
