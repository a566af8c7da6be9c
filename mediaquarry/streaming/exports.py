"""When a machine's document is written: once edits have paused, and at the end for what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUIET = "5 seconds"


def export_sessions(edits: DataFrame, quiet: str = QUIET, keys: tuple[str, ...] = ("machine",), watermark: str | None = None) -> DataFrame:
    """One row for each run of edits (``keys``, at) without a pause of ``quiet``: keys, first_edit, last_edit, edits, export_at.

    Every edit restarts the wait, so an export falls ``quiet`` after a run's last edit; an edit at just that time still belongs to
    the run. On a stream give ``watermark``, how late edits may come: a run's row is emitted once the watermark has
    passed its export. Edits without a time are passed over. Runs are merged within each task before rows meet by key.
    """
    rows = edits.where("at is not null").select(*keys, "at", F.col("at").alias("_at"))
    if watermark is not None:
        rows = rows.withWatermark("at", watermark)
    runs = rows.groupBy(*keys, F.session_window("at", quiet).alias("w")).agg(F.min("_at").alias("first_edit"), F.max("_at").alias("last_edit"), F.count(F.lit(1)).alias("edits"))
    return runs.select(*keys, "first_edit", "last_edit", "edits", F.col("w.end").alias("export_at"))


def flushed(sessions: DataFrame, closed_at) -> DataFrame:
    """Exports of a program that ends at ``closed_at``: what is still waiting then is written at once; adds flushed."""
    late = F.col("export_at") > closed_at
    return sessions.withColumn("flushed", late).withColumn("export_at", F.when(late, closed_at).otherwise(F.col("export_at")))
