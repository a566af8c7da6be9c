"""Exchange documents: one JSON file for each machine, read with checks and written whole."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaquarry.operators.sync import export, retained_moves
from mediaquarry.storage import materialise, replace_file

FORMAT, VERSION, PREFIX, MAX_BYTES = "media-catalog-sync", 1, "sync-", 50 * 1024 * 1024

DOCUMENT = (
    "format string, version int, machine_id string, exported_at double, "
    "media array<struct<path: string, size: long, tags: array<struct<name: string, updated_at: double, deleted: boolean>>>>, "
    "moves array<struct<`from`: string, `to`: string, size: long, at: double>>"
)


def judged_documents(files: DataFrame, format_name: str = FORMAT) -> DataFrame:
    """Files of the binary source (path, length, content) as documents: file, doc and problem, null if it is fine.

    The contents of files that are too large are not asked for: the source reads a file only where its length is allowed.
    """
    small = F.col("length") <= MAX_BYTES
    rows = files.where(small).select(F.col("path").alias("file"), "length", F.col("content").cast("string").alias("text"))
    large = files.where(~small).select(F.col("path").alias("file"), "length", F.lit(None).cast("string").alias("text"))
    parsed = rows.unionByName(large).withColumn("doc", F.from_json("text", DOCUMENT, {"mode": "PERMISSIVE"}))
    version = F.get_json_object("text", "$.version")
    problem = (
        F.when(F.col("length") > MAX_BYTES, "file is too large")
        .when(F.get_json_object("text", "$.format").isNull() | (F.get_json_object("text", "$.format") != format_name), "not a sync file")
        .when(~F.coalesce(version.rlike("^[0-9]+$"), F.lit(False)) | (F.expr("try_cast(get_json_object(text, '$.version') as int)") > VERSION), "written by a newer version")
        .when(F.col("doc.machine_id").isNull(), "missing machine id")
    )
    return parsed.select("file", "doc", problem.alias("problem"))


def read_documents(spark: SparkSession, folder: str, own_machine: str | None = None, format_name: str = FORMAT, prefix: str = PREFIX) -> tuple[DataFrame, DataFrame]:
    """Documents of other machines (file, doc), and what is wrong with the other files (file, problem).

    ``format_name`` and ``prefix`` name the format in the documents and the files. A file may be too large, no JSON, of another format, of a newer version or without a machine id.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*.json").load(folder)
    judged = judged_documents(found, format_name)
    good = judged.where("problem is null")
    if own_machine is not None:
        good = good.where(F.col("doc.machine_id") != own_machine)
    return good.select("file", "doc"), judged.where("problem is not null").select("file", "problem")


def document_rows(media: DataFrame, links: DataFrame, moves: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """What this machine's document holds, a JSON row each: present media with tags by path, and the moves of the retention time by time."""
    rows = export(media, links).select("path", F.to_json(F.struct("path", "size", "tags")).alias("value"))
    kept = retained_moves(moves, now)
    record = F.struct(F.col("from_path").alias("from"), F.col("to_path").alias("to"), "size", F.col("moved_at").alias("at"))
    return rows, kept.select("moved_at", "from_path", "to_path", F.to_json(record).alias("value"))


def write_document(
    media: DataFrame, links: DataFrame, moves: DataFrame, folder: str, machine_id: str, now: float, format_name: str = FORMAT, prefix: str = PREFIX, max_bytes: int = MAX_BYTES,
    replace: Callable[[SparkSession, str, str], None] = replace_file,
) -> str:
    """Write the document next to the others: to a file of another name, which then takes the old one's place in one step.

    The rows are made in parallel and joined here once they are known to be small; ValueError if the document would be
    larger than ``max_bytes``, which no reader takes. The old document stays until then. ``replace`` puts the text in place;
    stores without a rename that overwrites need ``replace_keeping_old``.
    """
    spark = media.sparkSession
    parts = [materialise(rows.select("value"), "document-rows") for rows in document_rows(media, links, moves, now)]
    size = sum(p.agg(F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0))).first()[0] for p in parts)
    if size > max_bytes:
        raise ValueError(f"the document has {size} bytes; readers take {max_bytes}")
    ordered = [sorted((r["value"] for r in p.collect()), key=_place) for p in parts]
    head = json.dumps({"format": format_name, "version": VERSION, "machine_id": machine_id, "exported_at": float(now)})[:-1]
    text = f'{head}, "media": [{",".join(ordered[0])}], "moves": [{",".join(ordered[1])}]}}'
    final = f"{folder}/{prefix}{machine_id}.json"
    replace(spark, final, text)
    return final


def _place(row: str) -> tuple:
    record = json.loads(row)
    return (record.get("at", 0.0), record.get("path") or record.get("from"), record.get("to") or "")
