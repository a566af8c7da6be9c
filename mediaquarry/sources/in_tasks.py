"""Reading a library's files and folders in tasks: listings level by level, contents block by block.

Paths are URIs that ``pyarrow.fs`` opens, or local paths.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaquarry.functions.text import basename, media_type
from mediaquarry.storage import materialise

#: Bytes that are read at once.
BLOCK = 1 << 20
#: Files or folders that a task takes before another one is worth its start.
_A_TASK = 64


def opened(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def digest(store, at: str, block: int = BLOCK) -> tuple[str, int]:
    """SHA-256 and size of one file, of which one block is held at a time."""
    found, size = sha256(), 0
    with store.open_input_stream(at, buffer_size=0) as file:
        while data := file.read(block):
            found.update(data)
            size += len(data)
    return found.hexdigest(), size


def content_hashes(candidates: DataFrame, path_col: str = "path", block: int = BLOCK) -> DataFrame:
    """SHA-256 of the files that ``candidates`` name, and of no others: adds sha256, bytes and error.

    A task opens one file at a time and reads it block by block, so a file of any size needs one block of memory. A file that can't be
    read has a null hash and its error; a null path has a null hash and no error. Rows are kept as they are, repeated ones too.
    """
    wanted = candidates.select(F.col(path_col).alias("_path")).where("_path is not null").distinct()
    spread = wanted.repartition(max(1, min(100_000, -(-wanted.count() // _A_TASK))), F.xxhash64("_path"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path in frame["_path"]:
                try:
                    out.append((path, *digest(*opened(path), block), None))
                except OSError as e:
                    out.append((path, None, None, str(e)[:500] or type(e).__name__))
            yield pd.DataFrame(out, columns=["_path", "sha256", "bytes", "error"]).astype({"bytes": "Int64"})

    found = materialise(spread.mapInPandas(read, "_path string, sha256 string, bytes long, error string"), "content-hashes")
    return candidates.join(found, F.col(path_col) == F.col("_path"), "left").drop("_path")


def listing_in_tasks(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Media and folders below ``root``, listed by tasks: (root, rel_path, filename, type, size, mtime) and (root, rel_path, error).

    A turn lists the folders that the turn before it found, dealt out by a hash of their paths. Names that begin with a dot are passed over, with what is below
    them. A link is followed unless it leads to a folder on its own way from the root. A folder that can't be listed has its error; the root itself is the
    folder ''.
    """
    top = root.rstrip("/")

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = opened(top)
        local = isinstance(store, fs.LocalFileSystem)
        for frame in frames:
            out = []
            for rel in frame["rel_path"]:
                at = f"{base}/{rel}" if rel else base
                try:
                    entries = store.get_file_info(fs.FileSelector(at))
                except OSError as e:
                    out.append((rel, "error", None, None, str(e)[:500] or type(e).__name__))
                    continue
                own = {os.path.realpath(at[: len(base) + 1 + i] if i >= 0 else base) for i in [-1, *(k for k, c in enumerate(rel + "/") if c == "/" and rel)]} if local else set()
                for entry in entries:
                    name = entry.base_name
                    if name.startswith("."):
                        continue
                    path = f"{rel}/{name}" if rel else name
                    if entry.type == fs.FileType.Directory:
                        if os.path.realpath(entry.path) not in own if local else True:
                            out.append((path, "folder", None, None, None))
                    elif entry.type == fs.FileType.File:
                        out.append((path, "file", entry.size, entry.mtime_ns / 1e9 if entry.mtime_ns is not None else None, None))
            yield pd.DataFrame(out, columns=["rel_path", "what", "size", "mtime", "error"]).astype({"size": "Int64"})

    schema = "rel_path string, what string, size long, mtime double, error string"
    frontier = spark.range(1).select(F.lit("").alias("rel_path"))
    waiting, levels = 1, []
    while waiting:
        spread = frontier.repartition(max(1, min(100_000, -(-waiting // _A_TASK))), F.xxhash64("rel_path"))
        levels.append(materialise(spread.mapInPandas(listed, schema), "listing"))
        frontier = levels[-1].where("what = 'folder'").select("rel_path")
        waiting = frontier.count()
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    here = F.lit(top).alias("root")
    media = every.where("what = 'file'").withColumns({"filename": basename(F.col("rel_path")), "type": media_type(F.col("rel_path"))}).where("type is not null")
    failed = every.where("what = 'error'").select("rel_path", "error")
    folders = every.where("what = 'folder'").select("rel_path").unionByName(failed.where("rel_path = ''").select("rel_path")).join(failed, "rel_path", "left")
    return media.select(here, "rel_path", "filename", "type", "size", "mtime"), folders.select(here, "rel_path", "error")
