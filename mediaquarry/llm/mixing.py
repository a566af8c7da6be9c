"""Mixing sources to target weights.

The words of each source, document after document in a fixed pseudorandom order, are one stream that is
cut into blocks of equal length. The mix is a row of slots, split into shards; each shard draws its
number of slots for every source from a multinomial. The draws are corrected against the total: they are those
of multinomials whose sums over all shards are the sources' slots, so that targets are met whatever the number
of shards. Such draws split a range of shards in two, and again, down to the single shard; on the way
a shard also learns how many slots of each source come before it. The slots of a source, counted over all
shards, run through pseudorandom permutations of its blocks, a new one for each pass, so no block is used twice
before all were used once. Blocks and slots meet by block index.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaquarry.llm.common import WORD, materialise, text_of

#: Chunks whose sizes are summed together, shards that are drawn together, and most tasks that draw.
_RUN, _GROUP, _TASKS = 4096, 8, 50_000
#: Most sources whose table is broadcast.
_SOURCES = 100_000


def fill_targets(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Share ``share`` times all sizes by weight; what a target has above ``cap`` times its size is reshared."""
    targets = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > cap * sizes[i]}
        if not over:
            for i in open_:
                targets[i] = unit * weights[i]
            break
        for i in over:
            targets[i] = float(cap * sizes[i])
        left = max(0.0, left - sum(targets[i] for i in over))
        open_ -= over
    return targets


def whole_slots(wanted: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Whole numbers with the rounded sum of ``wanted``, the largest fractions rounded up, none above its limit."""
    counts = np.minimum(np.floor(wanted), limits).astype(np.int64)
    rest = int(round(wanted.sum())) - int(counts.sum())
    order = np.argsort(counts - wanted, kind="stable")
    up = order[counts[order] < limits[order]][: max(0, rest)]
    counts[up] += 1
    return counts


def split_draw(totals: np.ndarray, left: int, seed: Sequence[int]) -> np.ndarray:
    """How many of ``left`` slots are of each source, where the slots are all that there are of ``totals``.

    A multinomial draw, given the totals: a multivariate hypergeometric one. Sums too large for
    it are drawn from the multinomial itself, and what passes a total is dealt to the others.
    """
    rng = np.random.default_rng(list(seed))
    if totals.sum() < 10**9:
        return rng.multivariate_hypergeometric(totals, left, method="marginals").astype(np.int64)
    counts = rng.multinomial(left, totals / totals.sum()).astype(np.int64)
    over = np.maximum(counts - totals, 0)
    counts -= over
    for i in np.argsort(counts - totals, kind="stable"):  # those with most room first
        more = min(int(over.sum()), int(totals[i] - counts[i]))
        if not over.sum():
            break
        counts[i] += more
        over = np.array([over.sum() - more])
    return counts


def shard_draws(totals: np.ndarray, shard_slots: int, low: int, high: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each shard from ``low`` to ``high``: its number, its sources, its slots of each, and how many of each come before.

    Only sources that a range of shards has slots of are carried into its halves.
    """
    slots = int(totals.sum())
    own = np.flatnonzero(totals)
    waiting = [(0, -(-slots // shard_slots), own, totals[own], np.zeros(len(own), np.int64))] if slots else []
    while waiting:
        begin, end, own, held, before = waiting.pop()
        if end <= low or begin >= high:
            continue
        if end - begin == 1:
            yield begin, own, held, before
            continue
        middle = (begin + end) // 2
        first = split_draw(held, (middle - begin) * shard_slots, (seed, begin, end))
        for half in ((middle, end, held - first, before + first), (begin, middle, first, before)):
            some = half[2] > 0
            waiting.append((half[0], half[1], own[some], half[2][some], half[3][some]))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a keyed pseudorandom permutation of 0..n-1 takes each index: a Feistel network, walked until it is below n."""
    half = np.uint64(max(1, (max(2, n) - 1).bit_length() + 1 >> 1))
    mask = np.uint64((1 << int(half)) - 1)
    out = index.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> half, out[walk] & mask
        for turn in range(4):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) % 2**64)
            left, right = right, left ^ (_mix(right + salt) & mask)
        out[walk] = (left << half) | right
        walk = walk[out[walk] >= np.uint64(n)]
    return out.astype(np.int64)


def _plan(docs: DataFrame, share: float, weights: Sequence[float], cap: float, id_col: str, text_col: str, source_col: str):
    """Sizes of all rows, and the sources in order with their targets. Only one row a source comes to the driver."""
    sizes = materialise(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(source_col).cast("string").alias("source"),
            F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
        ),
        "mix-sizes",
    )
    rows = sizes.groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).collect()
    # code points order as UTF-8 bytes do
    rows.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8", "surrogatepass")))
    targets = fill_targets([r[1] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], share, cap)
    return sizes, [(i, r[0], int(r[1]), int(r[2]), t) for (i, r), t in zip(enumerate(rows), targets, strict=True)]


def _placed(sizes: DataFrame, sources: DataFrame, rows: int, chunk_rows: int) -> DataFrame:
    """Rows with their source's number and the place of their first word in its stream.

    The order is by (chunk, id), chunks being hashes of ids. Prefix sums are taken in three steps, of rows in a
    chunk, of chunks in a run of chunks, and of runs, so the largest source is no group of its own.
    """
    chunks = max(1, -(-rows // chunk_rows))
    keyed = sizes.join(sources, sizes["source"].eqNullSafe(sources["source_name"])).select(
        "id", "source", "size", "src", "source_size", "target", F.pmod(F.xxhash64("id", "size"), F.lit(chunks)).alias("chunk")
    )

    def before(keys: list[str], order: list[str], what: str) -> Column:
        rows_before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(what).over(rows_before), F.lit(0))

    held = keyed.groupBy("src", "chunk").agg(F.sum("size").alias("held")).withColumn("run", F.floor(F.col("chunk") / _RUN))
    runs = held.groupBy("src", "run").agg(F.sum("held").alias("run_held")).select("src", "run", before(["src"], ["run"], "run_held").alias("run_base"))
    bases = held.withColumn("in_run", before(["src", "run"], ["chunk"], "held")).join(runs, ["src", "run"])
    bases = bases.select("src", "chunk", (F.col("run_base") + F.col("in_run")).alias("base"))
    return keyed.join(bases, ["src", "chunk"]).withColumn("start", F.col("base") + before(["src", "chunk"], ["id", "size"], "size"))


def _block_uses(spark, sources, block_words: int, shard_slots: int, cap: float, seed: int) -> DataFrame:
    """src, block, uses: how many slots of the mix each block fills."""
    blocks = np.array([-(-size // block_words) for _, _, size, _, _ in sources], np.int64)
    # slots of a source: its target over the mean length of its blocks
    wanted = np.array([t * b / s if s else 0.0 for (_, _, s, _, t), b in zip(sources, blocks, strict=True)])
    totals = whole_slots(wanted, np.floor(cap * blocks))
    shards = -(-int(totals.sum()) // shard_slots)

    def mapped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for group in frame["id"].tolist():
                for _, own, counts, first in shard_draws(totals, shard_slots, group * _GROUP, (group + 1) * _GROUP, seed):
                    for src, n, begin in zip(own.tolist(), counts.tolist(), first.tolist(), strict=True):
                        slot = np.arange(begin, begin + n)
                        turn = slot // blocks[src]
                        for pass_ in np.unique(turn).tolist():
                            at = slot[turn == pass_] - pass_ * blocks[src]
                            yield pd.DataFrame({"src": np.int32(src), "block": permuted(at, int(blocks[src]), (seed << 40) ^ (src << 8) ^ pass_)})

    groups = -(-shards // _GROUP)
    slots = spark.range(0, groups, 1, max(1, min(groups, _TASKS))).mapInPandas(mapped, "src int, block long")
    return slots.groupBy("src", "block").agg(F.count(F.lit(1)).alias("uses"))


def _spans(placed: DataFrame, uses: DataFrame, block_words: int) -> DataFrame:
    """For each row with words and each block that holds some of them: where they begin in the row, how many, and the uses."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), last)))
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return (
        cut.select("id", "source", "size", "src", "source_size", "target", "start", "block", (begin - F.col("start")).alias("offset"), (end - begin).alias("words"))
        # by sorting: nothing bounds the blocks, and the planner can't tell how many a few drawing rows give
        .join(uses.hint("merge"), ["src", "block"], "left")
        .withColumn("uses", F.coalesce("uses", F.lit(0)))
    )


def _prepared(docs, weights, share, cap, block_words, shard_slots, chunk_rows, seed, id_col, text_col, source_col):
    spark = docs.sparkSession
    sizes, sources = _plan(docs, share, weights, cap, id_col, text_col, source_col)
    rows = sum(s[3] for s in sources)
    table = spark.createDataFrame([(i, name, size, target) for i, name, size, _, target in sources], "src int, source_name string, source_size long, target double")
    placed = _placed(sizes, F.broadcast(table) if len(sources) <= _SOURCES else table, rows, chunk_rows)
    uses = _block_uses(spark, sources, block_words, shard_slots, cap, seed)
    return placed, _spans(placed, uses, block_words)


def mix_sources(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2,
    block_words: int = 64,
    shard_slots: int = 8192,
    chunk_rows: int = 2_000,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many words of each document the mix takes: id, size, source_size, target, taken.

    Sources, by code point with null last, have the ``weights`` in turn and share ``share`` times all
    words; no target passes ``cap`` times its source's size (see ``fill_targets``). A null text has no
    words; rows without words are returned with taken = 0. Null ids and sources are kept; repeated rows
    are rows of their own; an empty table gives an empty result; other columns are not read. The draw
    depends on ``seed`` and the data alone, so reruns agree.
    """
    placed, spans = _prepared(docs, weights, share, cap, block_words, shard_slots, chunk_rows, seed, id_col, text_col, source_col)
    taken = spans.groupBy("id", "size", "source_size", "target", "src", "start").agg(F.sum(F.col("words") * F.col("uses")).alias("taken")).drop("src", "start")
    none = placed.where("size = 0").select("id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(none).withColumnRenamed("id", id_col)


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", count_col: str | None = "n_chars", **settings) -> DataFrame:
    """The mix itself: for each pass over a document a row with the words that this pass takes.

    All columns of ``docs`` are returned. A text of which a pass takes every block stays as it is; else
    its taken words are joined by spaces, in order. ``count_col``, where there is one, is set to the new length.
    Rows without words, and documents that the mix leaves out, are gone. Rows with equal id, source and
    number of words have their own spans, dealt out in the order of their texts; other cases as in
    ``mix_sources``.
    """
    settings = {"weights": (3, 1, 2), "share": 1.5, "cap": 2, "block_words": 64, "shard_slots": 8192, "chunk_rows": 2_000, "seed": 1} | settings
    placed, spans = _prepared(docs, *[settings[k] for k in ("weights", "share", "cap", "block_words", "shard_slots", "chunk_rows", "seed")], id_col, text_col, source_col)
    # rows that look alike are told apart by their turn: by start there, by text here; left out ones count too
    alike = Window.partitionBy("id", "source", "size").orderBy("start")
    passes = (
        spans.withColumn("turn", F.dense_rank().over(alike))
        .where("uses > 0")
        .withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int"))))
        .groupBy("src", "start", "id", "source", "size", "turn", "pass")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "words"))).alias("spans"))
        .select(F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("turn").alias("_turn"), "spans")
    )
    whole = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["words"]) == F.col("_size")
    passes = passes.select("_id", "_source", "_size", "_turn", F.when(~whole, F.col("spans")).alias("_spans"))
    # the rows travel in one column, so that their names can't clash with those made here
    keyed = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("_row"),
        F.col(id_col).cast("long").alias("_own_id"),
        F.col(source_col).cast("string").alias("_own_source"),
        text_of(text_col).alias("_text"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("_own_size"),
    )
    keyed = keyed.withColumn("_own_turn", F.row_number().over(Window.partitionBy("_own_id", "_own_source", "_own_size").orderBy("_text")))
    met = keyed.join(
        passes,
        F.col("_own_id").eqNullSafe(F.col("_id")) & F.col("_own_source").eqNullSafe(F.col("_source")) & (F.col("_own_size") == F.col("_size")) & (F.col("_own_turn") == F.col("_turn")),
    )

    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, taken in zip(texts, spans, strict=True):
            if taken is not None:
                words = text.encode().split()
                text = b" ".join([w for s in taken for w in words[s["offset"] : s["offset"] + s["words"]]]).decode()
            out.append(text)
        return pd.Series(out, dtype=object)

    cut_text = F.pandas_udf(cut, "string")
    mixed = met.select("_row", F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(cut_text("_text", "_spans")).alias("_mixed"))
    kinds = dict(docs.dtypes)
    made = {text_col: F.col("_mixed").cast(kinds[text_col])}
    if count_col in kinds:
        made[count_col] = F.length("_mixed").cast(kinds[count_col])
    return mixed.select(*[made.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
