"""Exchange documents as a stream of files: each is imported once, and what can't be read is set aside.

A batch of new files is judged, what is wrong goes to a quarantine table, the others are merged into the library. Library,
ledger of files, quarantine and counters are one version, which a manifest names in one step; a batch that is replayed finds its
number there and does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaquarry.operators.sync import Library, flat_moves, flat_records, imported_with_outcomes, skipped_moves, summary_line
from mediaquarry.sources.sync_files import FORMAT, PREFIX, judged_documents
from mediaquarry.storage import Manifest, materialise

_BINARY = "path string, modificationTime timestamp, length long, content binary"
_LEDGER = "file string, length long, modified timestamp, batch long, documents long"
_QUARANTINE = "file string, problem string, batch long"
_SKIPPED = "from_path string, to_path string, reason string, batch long"
_COUNTERS = "batch long, files long, problems long, moves_applied long, moves_skipped long, tags_changed long, held long"


class ImportStore:
    """A library that imports change. ``begin`` puts the first version there."""

    def __init__(self, spark: SparkSession, path: str, own_machine: str | None = None, format_name: str = FORMAT):
        self.spark, self.own_machine, self.format_name = spark, own_machine, format_name
        self.manifest = Manifest(spark, path, {"library": None, "ledger": [], "quarantine": [], "counters": [], "skipped": []})

    def begin(self, library: Library) -> None:
        state = self.manifest.read()
        if state["library"] is None:
            self.manifest.commit(state | {"library": self._written(library)}, -1, "")

    def _written(self, library: Library) -> dict:
        at = {}
        for name, table in library._asdict().items():
            table.write.parquet(at.setdefault(name, self.manifest.folder(name)))
        return at

    def library(self) -> Library:
        return Library(**{name: self.spark.read.parquet(at) for name, at in self.manifest.read()["library"].items()})

    def _table(self, name: str, schema: str) -> DataFrame:
        parts = self.manifest.read()[name]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """The files that were read: file, length, modified, batch, documents (1 if it was imported)."""
        return self._table("ledger", _LEDGER)

    def quarantine(self) -> DataFrame:
        """The files that could not be imported: file, problem, batch."""
        return self._table("quarantine", _QUARANTINE)

    def counters(self) -> DataFrame:
        """One row for each batch: files read, problems, moves applied and skipped, tags changed, records held."""
        return self._table("counters", _COUNTERS)

    def skipped(self) -> DataFrame:
        """The moves that were passed over: from_path, to_path, reason, batch."""
        return self._table("skipped", _SKIPPED)

    def summaries(self) -> DataFrame:
        """The counters of each batch as a line of text: batch, line."""
        return self.counters().select("batch", summary_line(F.col("tags_changed"), F.col("moves_applied"), F.col("held"), F.col("moves_skipped"), F.col("problems")).alias("line"))

    def take(self, files: DataFrame, batch_id: int) -> bool:
        """Import a batch of files (path, modificationTime, length, content); whether it was new. The own machine's document is passed over."""
        state = self.manifest.read()
        if Manifest.done(state, batch_id, ""):
            return False
        judged = judged_documents(files, self.format_name).withColumn("batch", F.lit(batch_id).cast("long"))
        judged = materialise(judged, "import-files")
        good = judged.where("problem is null")
        if self.own_machine is not None:
            good = good.where(F.col("doc.machine_id") != self.own_machine)
        library = Library(**{name: self.spark.read.parquet(at) for name, at in state["library"].items()})
        records, moves = (materialise(flat(good.select("file", "doc")), "import-rows") for flat in (flat_records, flat_moves))
        after, counters, outcomes = imported_with_outcomes(library, records, moves)
        skipped = skipped_moves(moves, outcomes).withColumn("batch", F.lit(batch_id).cast("long"))
        new = {"library": self._written(after)}
        facts = files.select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"))
        done = good.select("file", F.lit(1).cast("long").alias("documents"))
        ledger = facts.join(done, "file", "left").select("file", "length", "modified", F.lit(batch_id).cast("long").alias("batch"), F.coalesce("documents", F.lit(0).cast("long")).alias("documents"))
        read = judged.agg(F.count(F.lit(1)).alias("files"), F.count("problem").alias("problems"))
        row = read.join(counters, F.lit(True)).select(F.lit(batch_id).cast("long").alias("batch"), "files", "problems", "moves_applied", "moves_skipped", "tags_changed", "held")
        for name, table in (("ledger", ledger), ("quarantine", judged.where("problem is not null").select("file", "problem", "batch")), ("counters", row), ("skipped", skipped)):
            table.write.parquet(at := self.manifest.folder(name))
            new[name] = [*state[name], at]
        self.manifest.commit(state | new, batch_id, "")
        return True


def import_stream(store: ImportStore, folder: str, checkpoint: str, prefix: str = PREFIX, files_a_batch: int = 100, **trigger):
    """Start importing documents that appear in ``folder``; by default all that are there, then stop. A file that changes is a new file."""
    files = store.spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", f"{prefix}*.json").option("maxFilesPerTrigger", files_a_batch).load(folder)
    return files.writeStream.foreachBatch(store.take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
