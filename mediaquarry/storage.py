"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def checkpoint_base(spark: SparkSession) -> str:
    """The shared folder of the session; it is made here only where the session names none and has one machine, as in tests."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="mediaquarry-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_base(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: With this setting the shuffle files of a query go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    Once the table is written nothing needs the shuffle files that led to it, so they go at once.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written whole at a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a file aside and then put it in the place of the old one in one step: a reader sees the old file or the new one, whole."""
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    final = fs.Path(path)
    part = fs.Path(final.getParent(), f".{final.getName()}.{uuid.uuid4().hex[:12]}")
    out = part.getFileSystem(conf).create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    option = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    option[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(part.getFileSystem(conf).getUri(), conf).rename(part, final, option)


def replace_keeping_old(spark: SparkSession, path: str, text: str, rename: Callable | None = None) -> None:
    """Like ``replace_file`` for a store that can't rename onto a file: the old file steps aside first, and back if the new one can't take its place.

    A reader may find no file for a moment, never a part of one. After a failure the old file is there again and nothing else is left; if
    the process is lost in between, ``restore_old`` puts it back. ``rename(from, to)`` says whether it worked.
    """
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    final = fs.Path(path)
    store = final.getFileSystem(conf)
    rename = rename or store.rename
    token = uuid.uuid4().hex[:12]
    part, old = (fs.Path(final.getParent(), f".{final.getName()}.{token}.{kind}") for kind in ("tmp", "bak"))
    kept = False
    try:
        out = store.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        if store.exists(final):
            if not rename(final, old):
                raise OSError(f"{path} can't be put aside")
            kept = True
        if not rename(part, final):
            raise OSError(f"the new {path} can't be put in its place")
    except BaseException:
        if kept and not store.exists(final):
            store.rename(old, final)
        store.delete(part, False)
        raise
    if kept:
        store.delete(old, False)


def restore_old(spark: SparkSession, path: str) -> bool:
    """Put back a file that ``replace_keeping_old`` had put aside when its process was lost; whether there was one. The newest counts; what is left over goes."""
    fs, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    final = fs.Path(path)
    store = final.getFileSystem(conf)
    found = store.globStatus(fs.Path(final.getParent(), f".{final.getName()}.*.bak")) or []
    left = sorted(found, key=lambda s: s.getModificationTime())
    back = bool(left) and not store.exists(final) and store.rename(left.pop().getPath(), final)
    for status in [*left, *(store.globStatus(fs.Path(final.getParent(), f".{final.getName()}.*.tmp")) or [])]:
        store.delete(status.getPath(), False)
    return back


class Manifest:
    """The state of a table that changes in batches: a small JSON file that names the folders of the current version.

    A batch first writes new folders, then the manifest, in one step; what a lost attempt has written is never named. The
    manifest has the last batch of each source, so a batch that is replayed is known. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, start: dict):
        self.spark, self.path, self.start = spark, path.rstrip("/"), start

    @property
    def file(self) -> str:
        return f"{self.path}/manifest.json"

    def read(self) -> dict:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.file)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return {"version": 0, "batches": {}} | self.start
        return json.loads(self.spark.read.text(self.file, wholetext=True).first()[0])

    def folder(self, name: str) -> str:
        """A new folder for a batch's rows."""
        return f"{self.path}/{name}-{uuid.uuid4().hex[:12]}"

    @staticmethod
    def done(state: dict, batch: int, source: str) -> bool:
        return batch <= state["batches"].get(source, -1)

    def commit(self, state: dict, batch: int, source: str) -> None:
        new = state | {"version": state["version"] + 1, "batches": state["batches"] | {source: batch}}
        replace_file(self.spark, self.file, json.dumps(new))
