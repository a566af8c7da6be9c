"""Tag records as a stream: every batch is merged into a table of links that is kept in buckets.

The merge does not depend on the order of batches, since a register keeps its newest record, and a batch that is
replayed after a failure is known by its number and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaquarry.functions.text import fold_ascii
from mediaquarry.operators.tags import LINK, apply
from mediaquarry.storage import Manifest, materialise

SCHEMA = "media_id long, tag string, updated_at double, deleted boolean, seq long"
_LINKS = "media_id long, tag_key string, updated_at double, deleted boolean"
_NAMES = "tag_key string, tag string"


class LinkTable:
    """Links in buckets by medium, and the spelling of each tag; a merge rewrites the buckets that it touches, and no others.

    The manifest names the folder of each bucket and the folders of spellings. A tag is spelled as in its first record, which
    later batches leave alone. ``buckets`` is fixed when the table is made.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        self.manifest = Manifest(spark, path, {"size": buckets, "buckets": {}, "names": []})

    def _bucket(self, size: int) -> Column:
        return F.pmod(F.xxhash64("media_id"), F.lit(size)).cast("int").alias("bucket")

    def _links(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(_LINKS).parquet(*folders) if folders else self.spark.createDataFrame([], _LINKS)

    def _names(self, state: dict) -> DataFrame:
        return self.spark.read.schema(_NAMES).parquet(*state["names"]) if state["names"] else self.spark.createDataFrame([], _NAMES)

    def read(self) -> DataFrame:
        state = self.manifest.read()
        return self._links(list(state["buckets"].values())).join(self._names(state), "tag_key").select(*LINK)

    def merge(self, batch: DataFrame, batch_id: int, source: str = "") -> bool:
        """Merge records; whether anything was done: a batch that the table has is left out.

        ``source`` names the stream, whose batches are numbered from 0 up. Records without a medium, a tag or a time are passed over.
        """
        state = self.manifest.read()
        if Manifest.done(state, batch_id, source):
            return False
        usable = F.col("media_id").isNotNull() & F.col("tag").isNotNull() & F.col("updated_at").isNotNull()
        rows = batch.where(usable).select(
            "media_id", fold_ascii(F.col("tag")).alias("tag_key"), "tag", "updated_at", F.coalesce("deleted", F.lit(False)).alias("deleted"), "seq", self._bucket(state["size"])
        )
        rows = materialise(rows, "link-batch")
        # at most as many as there are buckets
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())
        if touched:
            names = rows.groupBy("tag_key").agg(F.min_by("tag", "seq").alias("tag")).join(self._names(state).select("tag_key"), "tag_key", "left_anti")
            names.write.parquet(names_at := self.manifest.folder("names"))
            old = self._links([state["buckets"][str(b)] for b in touched if str(b) in state["buckets"]])
            newest = F.max_by(F.struct("updated_at", "deleted"), F.struct("updated_at", -F.col("seq")))
            new = rows.groupBy("media_id", "tag_key").agg(newest.alias("r")).select("media_id", "tag_key", F.col("tag_key").alias("tag"), "r.updated_at", "r.deleted")
            merged = apply(old.withColumn("tag", F.col("tag_key")), new).drop("tag").select("*", self._bucket(state["size"]))
            merged.repartition("bucket").write.partitionBy("bucket").parquet(links_at := self.manifest.folder("links"))
            state = state | {"buckets": state["buckets"] | {str(b): f"{links_at}/bucket={b}" for b in touched}, "names": [*state["names"], names_at]}
        self.manifest.commit(state, batch_id, source)
        return True


def stream_into(spark: SparkSession, source: str, table: LinkTable, checkpoint: str, **trigger):
    """Start merging JSON record files that appear in ``source``; by default all that are there, then stop."""
    records = spark.readStream.schema(SCHEMA).json(source)
    return records.writeStream.foreachBatch(table.merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def retained(moves: DataFrame, days: int = 90) -> DataFrame:
    """A stream of moves (moved_at as timestamp) without repeats, remembered for the retention time."""
    return moves.withWatermark("moved_at", f"{days} days").dropDuplicates(["from_path", "to_path", "size", "moved_at"])
