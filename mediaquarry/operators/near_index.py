"""A stored index of similarity hashes: batches of new files are added, and only what is new is compared.

Chunk keys, of which near hashes share one at least, are stored in parts by key. A batch's hashes that the index lacks are cut into keys, which
are compared with each other and with the stored parts of the same keys. Files hang on a hash's first file, and groups are
kept as redirects: a label, the smallest id of a group, leads to a smaller one once new links join two groups. Nothing that
was stored is written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaquarry.operators.components import connected_components
from mediaquarry.operators.duplicates import DEFAULT_DISTANCE, chunk_keys, clamped
from mediaquarry.operators.near_blocks import links_by_keys
from mediaquarry.operators.pointers import followed
from mediaquarry.storage import Manifest, materialise

_HASHES = "kind string, h long, rep long"
_KEYS = "kind string, h long, key struct<i: int, j: int, v: long, w: long>, part int"
_FILES = "id long, rep long"
_REDIRECTS = "id long, next long"


class HashIndex:
    """Near duplicates of files (id, h, kind) that come in batches. ``max_distance`` and ``parts`` are fixed when the index is made."""

    def __init__(self, spark: SparkSession, path: str, max_distance: int = DEFAULT_DISTANCE, parts: int = 64):
        self.spark = spark
        self.manifest = Manifest(spark, path, {"distance": max_distance, "parts": parts, "hashes": [], "keys": [], "files": [], "redirects": []})

    def _stored(self, state: dict, name: str, schema: str) -> DataFrame:
        # each batch has a folder of its own
        found = self.spark.createDataFrame([], schema)
        for at in state[name]:
            found = found.unionByName(self.spark.read.schema(schema).parquet(at))
        return found

    def add(self, files: DataFrame, batch_id: int, source: str = "") -> bool:
        """Add new files; whether the batch was new. Files without a hash or an id, and ids that the index has, are passed over."""
        state = self.manifest.read()
        if Manifest.done(state, batch_id, source):
            return False
        parts, distance = state["parts"], state["distance"]
        hashes, redirects = self._stored(state, "hashes", _HASHES), self._stored(state, "redirects", _REDIRECTS)
        rows = files.where("id is not null and h is not null").select("id", "h", F.coalesce("kind", F.lit("")).alias("kind"))
        rows = rows.groupBy("id").agg(F.min(F.struct("kind", "h")).alias("x")).select("id", "x.kind", "x.h")
        rows = materialise(rows.join(self._stored(state, "files", _FILES).select("id"), "id", "left_anti"), "index-batch")
        mine = rows.groupBy("kind", "h").agg(F.min("id").alias("first")).join(hashes, ["kind", "h"], "left")
        mine = materialise(mine.select("kind", "h", "first", F.coalesce("rep", "first").alias("rep"), F.col("rep").isNull().alias("fresh")), "index-hashes")
        fresh = mine.where("fresh").select("kind", "h", "rep")

        key = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part")
        cut = materialise(chunk_keys(fresh.select("kind", "h"), distance).select("*", key), "index-keys")
        # parts that no new key falls into are not read
        used = [r["part"] for r in cut.select("part").distinct().collect()]
        stored = self._stored(state, "keys", _KEYS)
        stored = stored.where(F.col("part").isin(used)) if used else stored.where("false")
        keyed = cut.select("kind", "h", "key", F.lit(True).alias("fresh")).unionByName(stored.select("kind", "h", "key", F.lit(False).alias("fresh")))
        pairs = links_by_keys(keyed, clamped(distance))
        every = hashes.unionByName(fresh)
        a, b = (every.select(F.col("kind"), F.col("h").alias(f"h{s}"), F.col("rep").alias(n)) for s, n in (("x", "a"), ("y", "b")))
        links = pairs.join(a, ["kind", "hx"]).join(b, ["kind", "hy"]).select("a", "b")
        # a stored hash that gets a file with a smaller id than its first
        links = links.unionByName(mine.where("first < rep").select(F.col("rep").alias("a"), F.col("first").alias("b")))
        links = materialise(links, "index-links")
        ends = links.select(F.col("a").alias("rep")).union(links.select("b")).distinct()
        now = materialise(self._labels(ends, redirects), "index-labels")
        labelled = links.join(now.select(F.col("rep").alias("a"), F.col("label").alias("la")), "a").join(now.select(F.col("rep").alias("b"), F.col("label").alias("lb")), "b")
        merged = connected_components(labelled.select(F.col("la").alias("a"), F.col("lb").alias("b"))).where("id <> label").select("id", F.col("label").alias("next"))

        new = {}
        for name, table, by in (
            ("hashes", fresh, None), ("keys", cut.repartition("part"), "part"), ("files", rows.join(mine.select("kind", "h", "rep"), ["kind", "h"]).select("id", "rep"), None), ("redirects", merged, None),
        ):
            writer = table.write.partitionBy(by) if by else table.write
            writer.parquet(at := self.manifest.folder(name))
            new[name] = [*state[name], at]
        self.manifest.commit(state | new, batch_id, source)
        return True

    @staticmethod
    def _labels(reps: DataFrame, redirects: DataFrame) -> DataFrame:
        """The label that each rep has now: rep, label. A way has as many redirects as batches, at most."""
        found = reps.select("rep", F.col("rep").alias("label"))
        while True:
            met = found.join(redirects, F.col("label") == F.col("id"), "left")
            found = materialise(met.select("rep", F.coalesce("next", "label").alias("label"), F.col("next").isNotNull().alias("moved")), "index-ways")
            if found.where("moved").isEmpty():
                return found.select("rep", "label")
            found = found.select("rep", "label")

    def groups(self) -> DataFrame:
        """Files in groups of two and more: id, label (the smallest id of the group)."""
        state = self.manifest.read()
        redirects, files = self._stored(state, "redirects", _REDIRECTS), self._stored(state, "files", _FILES)
        roots = redirects.select(F.col("next").alias("id")).distinct().join(redirects.select("id"), "id", "left_anti").select("id", F.lit(None).cast("long").alias("next"))
        ends = followed(redirects.unionByName(roots)).select(F.col("id").alias("rep"), "end")
        labelled = files.join(ends, "rep", "left").select("id", F.coalesce("end", "rep").alias("label"))
        many = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("label")
        return labelled.join(many, "label", "left_semi").select("id", "label")
