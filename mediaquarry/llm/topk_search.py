"""Exact top-k search by distributed histogram selection.

For a block of queries every task scores its vectors against the whole block and counts the scores in a
histogram for each query. The summed histograms tell which bin holds the k-th best score; the next pass
counts that bin alone in finer bins, until the k-th score is known exactly. The last pass keeps the rows
at or above it. What a task holds is bounded by its batch and the block, and what it sends by
queries * bins, however many vectors or ties there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sums of products below this are exact in doubles, so BLAS can make them.
EXACT = 2.0**52


def quantised(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and floor(scale * x) of a batch's usable vectors, by their length.

    Unusable: a null id or vector, and a null or non-finite component.
    """
    ids, vectors = batch.column(0), batch.column(1)
    keep = pc.and_(ids.is_valid(), vectors.is_valid())
    ids, vectors = ids.filter(keep), vectors.filter(keep)
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.int64)
    ids = ids.to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        rows = flat[starts[own][:, None] + np.arange(n)] if n else np.zeros((len(own), 0))
        fine = np.isfinite(rows).all(axis=1)
        if fine.any():
            yield ids[own[fine]].astype(np.int64), np.floor(scale * rows[fine])


def scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products, rows by queries, as int64; OverflowError where they might not fit."""
    top = np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0) * max(1, rows.shape[1])
    if top < EXACT:
        return (rows @ queries.T).astype(np.int64)
    if top >= 2.0**63:
        raise OverflowError("components are too large for scores of 64 bits")
    return rows.astype(np.int64) @ queries.astype(np.int64).T


def topk_search(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 5,
    scale: float = 256.0,
    bins: int = 512,
    query_block: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Each query's k best candidates: query_id, rank (from 1), vec_id, score.

    Score: the inner product of floor(scale * x). Candidates are all rows but those with the query's own
    id; ties go to the smaller id; a query with fewer than k candidates gets all. Vectors that are null
    or hold null or non-finite components, and rows with a null id, take no part. Only vectors of the
    query's own length are its candidates. Every usable row of a query id that occurs more than once
    asks, and the id's k best are taken over all of them; repeated candidate rows are candidates each. An empty table gives an empty result. Queries are
    taken in blocks of about ``query_block``; ``bins`` bounds a histogram. Neither changes the result.
    """
    table = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))

    def extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(x.shape[1], float(np.sqrt((x * x).sum(axis=1)).max())) for _, x in quantised(batch, scale)]
            yield pa.RecordBatch.from_pydict({"n": pa.array([f[0] for f in found], pa.int32()), "norm": pa.array([f[1] for f in found], pa.float64())})

    norms = dict(table.select("id", "v").mapInArrow(extents, "n int, norm double").groupBy("n").agg(F.max("norm")).collect())
    asked = table.where("q and id is not null").select("id", "v")
    blocks = max(1, -(-asked.count() // query_block))
    parts = []
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == block)
        parts.append(_block(table.select("id", "v"), own, norms, k, scale, bins))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block(table: DataFrame, own: DataFrame, norms: dict[int, float], k: int, scale: float, bins: int) -> DataFrame:
    """Candidates for the queries in ``own``: all above each k-th score, and of those at it the first k of each batch."""
    spark = table.sparkSession
    by_length: dict[int, tuple[list, list]] = {}
    for batch in [own.select("id", "v").toArrow()]:
        for piece in batch.to_batches():
            for ids, rows in quantised(piece, scale):
                held = by_length.setdefault(rows.shape[1], ([], []))
                held[0].append(ids)
                held[1].append(rows)
    queries = {n: (np.concatenate(a), np.concatenate(b)) for n, (a, b) in by_length.items()}
    # the interval [low, high) that holds the k-th best score, and how many of the k lie in it or below
    state = {}
    for n, (ids, rows) in queries.items():
        reach = (np.sqrt((rows * rows).sum(axis=1)) * norms[n] * (1 + 1e-9)).astype(np.int64) + 1
        state[n] = (-reach, reach + 1, np.full(len(ids), k, np.int64))
    # queries go by their place in the block, as an id can ask with several rows
    places = [(n, i) for n, (ids, _) in queries.items() for i in range(len(ids))]

    while any(((high - low) > 1).any() for low, high, _ in state.values()):
        shared = spark.sparkContext.broadcast((queries, state))

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, at = shared.value
            sums = {n: np.zeros((len(ids), bins), np.int64) for n, (ids, _) in asked.items()}
            for batch in batches:
                for ids, rows in quantised(batch, scale):
                    n = rows.shape[1]
                    if n in asked:
                        low, high, _ = at[n]
                        width = -(-(high - low) // bins)
                        s = scores(rows, asked[n][1])
                        inside = (s >= low) & (s < high) & (ids[:, None] != asked[n][0][None, :])
                        r, q = np.nonzero(inside)
                        cell = q * bins + (s[r, q] - low[q]) // width[q]
                        sums[n] += np.bincount(cell, minlength=sums[n].size).reshape(sums[n].shape)
            for n, held in sums.items():
                q, b = np.nonzero(held)
                yield pa.RecordBatch.from_pydict({"n": pa.array(np.full(len(q), n), pa.int32()), "q": pa.array(q, pa.int64()), "b": pa.array(b, pa.int32()), "c": pa.array(held[q, b], pa.int64())})

        totals = table.mapInArrow(counted, "n int, q long, b int, c long").groupBy("n", "q", "b").agg(F.sum("c").alias("c"))
        down = Window.partitionBy("n", "q").orderBy(F.desc("b"))
        want = {}
        needs = spark.createDataFrame(
            [(int(n), i, int(state[n][2][i])) for n, i in places], "n int, q long, need long"
        )
        cut = (
            totals.withColumn("upto", F.sum("c").over(down))
            .join(needs, ["n", "q"])
            .where("upto >= need and upto - c < need")
            .select("n", "q", "b", (F.col("upto") - F.col("c")).alias("above"))
        )
        for n, q, b, above in cut.collect():
            want[(n, q)] = (b, above)
        for n, (ids, _) in queries.items():
            low, high, need = state[n]
            width = -(-(high - low) // bins)
            new_low, new_high, new_need = low.copy(), high.copy(), need.copy()
            for i in range(len(ids)):
                if (n, i) in want:
                    b, above = want[(n, i)]
                    new_low[i] = low[i] + b * width[i]
                    new_high[i] = min(high[i], new_low[i] + width[i])
                    new_need[i] = need[i] - above
                else:  # fewer candidates than asked for: all of them count
                    new_high[i] = low[i] + 1
            state[n] = (new_low, new_high, new_need)

    shared = spark.sparkContext.broadcast((queries, {n: s[0] for n, s in state.items()}))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, least = shared.value
        for batch in batches:
            for ids, rows in quantised(batch, scale):
                n = rows.shape[1]
                if n not in asked:
                    continue
                by_id = np.argsort(ids, kind="stable")
                ids, rows = ids[by_id], rows[by_id]
                s = scores(rows, asked[n][1])
                other = ids[:, None] != asked[n][0][None, :]
                tied = (s == least[n]) & other
                q, r = np.nonzero((((s > least[n]) & other) | (tied & (np.cumsum(tied, axis=0) <= k))).T)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(asked[n][0][q], pa.int64()), "vec_id": pa.array(ids[r], pa.int64()), "score": pa.array(s[r, q], pa.int64())})

    return table.mapInArrow(kept, "query_id long, vec_id long, score long")
