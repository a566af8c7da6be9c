"""Exact dedup over an extendible-hash index on shared files, in DataFrame operations only.

1. Rows are counted by the hash of their text: how many there are of each key, and how many bytes they hold.
2. A histogram of these bytes by the keys' leading bits sizes the index: a directory of 2^g cells is
   doubled until no bucket holds more than ``bucket_bytes``, or ``max_depth`` is reached. Only that
   histogram, of at most 2^max_depth rows, comes to the driver.
3. Rows go to the owner of their bucket, a range of keys: its number is the number of the owner's task, so one
   task processes a bucket and writes its file. Keys of ``fold_rows`` rows or more are folded by their bytes
   first, on the map side, so a text that a third of all rows share leaves each task once.
4. The owner sorts its rows by key and bytes. Different texts of one key are the links of a chain; rows
   of one link are a class. The entries, with link and verdict and without texts, are the bucket's file.
5. The verdicts are read from the files. Rows of folded keys look theirs up by key and SHA-256; of such keys
   there are at most 1 / fold_rows of all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaquarry.llm.common import materialise, text_of

#: Bytes of an entry besides its text.
_ENTRY = 64
#: Most folded keys there can be.
_FOLDED = 100_000


def build_directory(histogram: dict[int, int], depth: int, bucket_bytes: int) -> tuple[int, list[int]]:
    """Split overfull buckets, doubling the directory as needed.

    ``histogram`` has the bytes of keys by their ``depth`` leading bits. Returns the global depth g and,
    for each of the 2^g cells, the number of its bucket; buckets are numbered in key order.
    """

    def held(prefix: int, local: int) -> int:
        low = prefix << (depth - local)
        return sum(histogram.get(x, 0) for x in range(low, low + (1 << (depth - local))))

    buckets, waiting = [], [(0, 0)]
    while waiting:
        prefix, local = waiting.pop()
        if local < depth and held(prefix, local) > bucket_bytes:
            waiting += [(2 * prefix + 1, local + 1), (2 * prefix, local + 1)]
        else:
            buckets.append((prefix, local))
    g = max(local for _, local in buckets)
    cells: list[int] = []
    for number, (_, local) in enumerate(buckets):
        cells += [number] * (1 << (g - local))
    return g, cells


def _cell(depth: int) -> Column:
    return F.shiftrightunsigned("_key", 64 - depth).cast("int") if depth else F.lit(0)


def build_index(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = 16 << 20,
    max_depth: int = 18,
    fold_rows: int = 1000,
    key: Callable[[Column], Column] = F.xxhash64,
) -> tuple[DataFrame, DataFrame, int]:
    """The index, the rows of folded keys (_id, _key, _sha), and the number of buckets.

    The index, one file a bucket: _bucket, _key, _link (the text's number in the chain of its key), _sha, _folded,
    and an entry's _id with the _keep and _size of its class. A folded text has one entry.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"), key(text).alias("_key"))
    size = F.octet_length("_text").cast("long")
    keys = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), F.max(size).alias("longest"))
    keys = materialise(keys, "dedup-keys")
    total = keys.agg(F.sum("n")).first()[0] or 0
    # at most _FOLDED keys can have that many rows
    folded = F.col("n") >= max(fold_rows, -(-total // _FOLDED))
    held = F.when(folded, F.col("longest") + _ENTRY).otherwise(F.col("bytes") + _ENTRY * F.col("n"))

    depth = min(8, max_depth)
    while True:
        histogram = {r["cell"]: r["held"] for r in keys.groupBy(_cell(depth).alias("cell")).agg(F.sum(held).alias("held")).collect()}
        if depth >= max_depth or max(histogram.values(), default=0) <= bucket_bytes:
            break
        depth = min(depth + 5, max_depth)
    g, cells = build_directory(histogram, depth, bucket_bytes)
    buckets = cells[-1] + 1
    # one literal, however large the directory
    directory = F.split(F.lit(",".join(map(str, cells))), ",").cast("array<int>")
    bucket = F.element_at(directory, _cell(g) + 1).alias("_bucket")

    hot = F.broadcast(keys.where(folded).select(F.col("_key").alias("_hot")))
    met = F.col("_key") == F.col("_hot")
    few = rows.join(hot, met, "left_anti").select("_id", "_text", "_key", F.lit(1).cast("long").alias("_n"), F.lit(False).alias("_folded"))
    many = rows.join(hot, met, "left_semi")
    once = many.groupBy("_key", "_text").agg(F.max("_id").alias("_id"), F.count(F.lit(1)).alias("_n")).withColumn("_folded", F.lit(True))
    owned = few.unionByName(once).select("*", bucket).repartitionById(buckets, F.col("_bucket"))
    own_text = Window.partitionBy("_bucket", "_key", "_text")
    index = owned.select(
        "_bucket",
        "_key",
        F.dense_rank().over(Window.partitionBy("_bucket", "_key").orderBy("_text")).alias("_link"),
        "_id",
        F.max("_id").over(own_text).alias("_keep"),
        F.sum("_n").over(own_text).alias("_size"),
        F.sha2(F.col("_text").cast("binary"), 256).alias("_sha"),
        "_folded",
    )
    return materialise(index, "dedup-index"), many.select("_id", "_key", F.sha2(F.col("_text").cast("binary"), 256).alias("_sha")), buckets


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Classes of equal texts; of each class the row with the largest id stays.

    Returns one row per input row: the id, keep_id, group_size, kept and text_sha256. A null text is the
    empty text; the empty text is a text like others. A null id never stays: its row gets kept = false
    and the largest other id of its class, or null, as keep_id. Repeated rows count as often as they
    occur and share one verdict. An empty table gives an empty result. Other columns, whatever their
    names, are not read. ``settings``: see ``build_index``; none changes the result.
    """
    index, many, _ = build_index(docs, id_col=id_col, text_col=text_col, **settings)
    entries = index.where("not _folded").select("_id", "_keep", "_size", "_sha")
    folded = index.where("_folded").select(F.col("_key").alias("_own_key"), F.col("_sha").alias("_own_sha"), "_keep", "_size")
    if folded.count() <= 2 * _FOLDED:
        folded = F.broadcast(folded)
    looked_up = many.join(folded, (F.col("_key") == F.col("_own_key")) & (F.col("_sha") == F.col("_own_sha")))
    return entries.unionByName(looked_up.select("_id", "_keep", "_size", "_sha")).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.coalesce(F.col("_id") == F.col("_keep"), F.lit(False)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
