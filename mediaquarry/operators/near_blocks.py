"""Near hashes by blocks: rows sorted by length and hash are cut into blocks, and every two blocks that can have a match meet in one cell.

A cell compares whole arrays, so a pair that is not near costs about a nanosecond and is never a row. However many rows share a hash or
a piece of one, a cell is no larger than two blocks; rows are sent once for each block, at most ``MOST_BLOCKS`` times. Cells give all pairs,
in batches, or only links enough for the groups: those between parts of the blocks that were not linked already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaquarry.storage import materialise

#: Rows of a block, at least, and the number of blocks, at most.
LEAST_ROWS, MOST_BLOCKS = 2048, 64
#: Rows that are sent as one, elements compared at a time, and rows of a hash taken as one: the square of it is a batch of pairs.
_PIECE, _STRIP, _RUN = 512, 1 << 17, 512

_PIECES = "kind string, block int, piece int, least double, most double, h binary, id binary, length binary, label binary"


def near_rows(u: np.ndarray, v: np.ndarray, distance: int, du: np.ndarray, dv: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows r of u and c of v that match, and their distances, a strip at a time; both are sorted by length. Of one array (``same``) only r <= c."""
    at = 0
    while at < len(u):
        # rows of one strip have near lengths, so the columns that can match are a range
        first = max(at if same else 0, int(np.searchsorted(dv, _lowest(du[at]))))
        end = int(np.searchsorted(dv, _highest(du[at]), side="right"))
        rows = max(1, min(len(u) - at, _STRIP // max(1, end - first)))
        end = int(np.searchsorted(dv, _highest(du[at + rows - 1]), side="right"))
        if end > first:
            x, y = u[at : at + rows], v[first:end]
            bits = np.bitwise_count(x[:, None] ^ y[None, :])
            r, c = np.divmod(np.flatnonzero(bits <= distance), end - first)
            apart = bits[r, c]
            r, c = r + at, c + first
            fine = ~(np.abs(du[r] - dv[c]) > np.maximum(1.0, 0.02 * np.maximum(du[r], dv[c])))
            if same:
                fine &= r <= c
            if not fine.all():
                r, c, apart = r[fine], c[fine], apart[fine]
            if len(r):
                yield r, c, apart
        at += rows


def _lowest(x: float) -> float:
    """No smaller length matches one of x or more."""
    return x - max(1.0, 0.02 * x) - 1e-9 * (1 + abs(x))


def _highest(x: float) -> float:
    """No larger length matches one of x or less."""
    return max(x + 1.0, x / 0.98) + 1e-9 * (1 + abs(x))


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a and b, pairwise; every entry of ``root`` is then the smallest of its tree."""
    a, b = root[a], root[b]
    while (apart := a != b).any():
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root[:] = up
        a, b = root[a], root[b]


def _runs(h: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs of rows with one hash and length, each of at most ``_RUN`` rows."""
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (length[1:] != length[:-1])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    start = np.flatnonzero((np.arange(len(h)) - begin) % _RUN == 0)
    return start, np.diff(np.append(start, len(h)))


def _batch_of_pairs(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Pairs in the order of a and distance: in a columnar file both are runs, and only b takes room."""
    a, b, far = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((far, a))
    return pa.record_batch([pa.array(a[order]), pa.array(b[order]), pa.array(far[order])], names=["a", "b", "distance"])


def _pairs_of_cell(x: dict, y: dict | None, distance: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for part in _some_pairs(x, y, distance):
        held.append(part)
        n += len(part[0])
        if n >= _RUN * _RUN:
            yield _batch_of_pairs(held)
            held, n = [], 0
    if held:
        yield _batch_of_pairs(held)


def _some_pairs(x: dict, y: dict | None, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of two blocks, or of one with itself, a strip or a part of one at a time: a, b and distance."""
    same = y is None
    y = x if same else y
    (sx, nx), (sy, ny) = _runs(x["h"], x["length"]), _runs(y["h"], y["length"])
    for r, c, apart in near_rows(x["h"][sx], y["h"][sy], distance, x["length"][sx], y["length"][sy], same):
        many = nx[r] * ny[c]
        # a strip's pairs in batches of at most two full ones
        cuts = np.flatnonzero(np.diff(np.cumsum(many) // (_RUN * _RUN), prepend=0)) if many.sum() > _RUN * _RUN else []
        for part in np.split(np.arange(len(r)), cuts):
            if not len(part):
                continue
            k, total = many[part], int(many[part].sum())
            which = np.repeat(part, k)
            turn = np.arange(total) - np.repeat(np.cumsum(k) - k, k)
            i, j = sx[r[which]] + turn // ny[c[which]], sy[c[which]] + turn % ny[c[which]]
            far = apart[which].astype(np.int32)
            a, b = x["id"][i], y["id"][j]
            fine = a != b
            if same:
                fine &= i < j
            if not fine.all():
                a, b, far = a[fine], b[fine], far[fine]
            if len(a):
                yield np.minimum(a, b), np.maximum(a, b), far


def _links_of_cell(x: dict, y: dict | None, distance: int) -> Iterator[pa.RecordBatch]:
    """Links between the parts of two blocks, as stars; within a block its parts were linked when it was cut."""
    if y is None:
        apart = x["label"] != x["id"]
        a, b = x["label"][apart], x["id"][apart]
    else:
        labels, at = np.unique(np.concatenate([x["label"], y["label"]]), return_inverse=True)
        root, nx = np.arange(len(labels)), len(x["h"])
        for r, c, _ in near_rows(x["h"], y["h"], distance, x["length"], y["length"], False):
            unite(root, at[r], at[nx + c])
        apart = root != np.arange(len(labels))
        a, b = labels[root[apart]], labels[apart]
    if len(a):
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])


def _cut(distance: int | None):
    """A task's rows, sorted, as pieces of one block for each kind; with a distance the rows get the labels of the block's parts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table, block = pa.Table.from_batches(held), TaskContext.get().partitionId()
        kinds = table.column("kind").combine_chunks().dictionary_encode()
        codes, names = kinds.indices.to_numpy(), kinds.dictionary.to_pylist()
        every = {n: table.column(n).to_numpy() for n in ("h", "id", "length")}
        for code, name in enumerate(names):
            x = {n: v[codes == code] for n, v in every.items()}
            label = x["id"]
            if distance is not None:
                h, root = x["h"].view(np.uint64), np.arange(len(label))
                for r, c, _ in near_rows(h, h, distance, x["length"], x["length"], True):
                    unite(root, r, c)
                label = label[root]
            for piece, i in enumerate(range(0, len(label), _PIECE)):
                own = slice(i, i + _PIECE)
                length = x["length"][own]
                yield pa.RecordBatch.from_pylist([
                    {"kind": name, "block": block, "piece": piece, "least": float(length[0]), "most": float(length[-1]), "h": x["h"][own].tobytes(),
                     "id": x["id"][own].tobytes(), "length": length.tobytes(), "label": label[own].tobytes()}
                ], pa.schema([("kind", pa.string()), ("block", pa.int32()), ("piece", pa.int32()), ("least", pa.float64()), ("most", pa.float64()), *[(n, pa.binary()) for n in ("h", "id", "length", "label")]]))

    return cut


def _each_cell(of_cell, distance: int):
    """Rows come sorted by cell, side and piece; a cell is held until its last piece is there."""

    def block(pieces: list[dict]) -> dict:
        return {n: np.frombuffer(b"".join(p[n] for p in pieces), dtype=t) for n, t in (("h", np.uint64), ("id", np.int64), ("length", np.float64), ("label", np.int64))}

    def done(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        yield from of_cell(block(held[0]), block(held[1]) if held[1] else None, distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {0: [], 1: []}
        for batch in batches:
            for row in batch.to_pylist():
                if (key := (row["kind"], row["i"], row["j"])) != cell:
                    if cell is not None:
                        yield from done(held)
                    cell, held = key, {0: [], 1: []}
                held[row["side"]].append(row)
        if cell is not None:
            yield from done(held)

    return run


def _cells(rows: DataFrame, distance: int, linked: bool) -> DataFrame:
    """Pieces of the blocks in the cells where they meet: kind, i, j, side (0: of block i) and their arrays.

    Blocks that give links are cut by hash: near rows are then linked where they are cut. Those that give pairs are cut by id: of rows that
    have one length, block i has the smaller ids. A task's cells are neighbours, with few blocks j, so it writes pairs with few different b.
    """
    spark = rows.sparkSession
    rows = materialise(rows.select("kind", "h", "id", "length"), "near-rows")
    blocks = max(1, min(MOST_BLOCKS, -(-rows.count() // LEAST_ROWS)))
    dealt = rows.repartitionByRange(blocks, "kind", "length", *(["h", "id"] if linked else ["id", "h"])).sortWithinPartitions("kind", "length", "h", "id")
    pieces = materialise(dealt.mapInArrow(_cut(distance if linked else None), _PIECES), "near-pieces")
    ends = pieces.groupBy("kind", "block").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    x, y = (ends.select("kind", F.col("block").alias(n), F.col("least").alias(f"least_{n}"), F.col("most").alias(f"most_{n}")) for n in "ij")
    # later blocks have larger lengths: the nearest ones are the last of i and the first of j
    reach = F.greatest(F.col("most_i") + 1, F.col("most_i") / 0.98) + 1e-6 * (1 + F.abs("most_i"))
    met = materialise(x.join(y, "kind").where((F.col("i") <= F.col("j")) & (F.col("least_j") <= reach)).select("kind", "i", "j"), "near-cells")
    data = ["piece", "h", "id", "length", "label"]
    sides = [
        pieces.withColumnRenamed("block", own).join(F.broadcast(met if own == "i" else met.where("i < j")), ["kind", own]).select("kind", "i", "j", F.lit(side).alias("side"), *data)
        for side, own in enumerate("ij")
    ]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    every = sides[0].unionByName(sides[1])
    if linked:
        return every.repartition(parts, "kind", "i", "j").sortWithinPartitions("kind", "i", "j", "side", "piece")
    return every.repartitionByRange(parts, "kind", "j", "i").sortWithinPartitions("kind", "j", "i", "side", "piece")


def _usable(rows: DataFrame) -> DataFrame:
    fine = rows.select(F.col("kind").cast("string").alias("kind"), F.col("h").cast("long").alias("h"), F.col("id").cast("long").alias("id"), F.col("length").cast("double").alias("length"))
    return fine.where("kind is not null and h is not null and id is not null and abs(length) < double('infinity')")


def all_pairs(rows: DataFrame, distance: int) -> DataFrame:
    """Pairs a < b of rows (kind, h, id, length) of one kind with near hashes and matching lengths: a, b, distance. Unknown and unending lengths match nothing."""
    return _cells(_usable(rows), distance, False).mapInArrow(_each_cell(_pairs_of_cell, distance), "a long, b long, distance int")


def group_links(rows: DataFrame, distance: int) -> DataFrame:
    """Links enough for the groups of ``all_pairs``: a, b. Rows of one kind, hash and length are linked to the smallest of them."""
    rows = materialise(_usable(rows), "near-files")
    first = rows.groupBy("kind", "h", "length").agg(F.min("id").alias("first"))
    stars = rows.join(first, ["kind", "h", "length"]).where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    found = _cells(first.withColumnRenamed("first", "id"), distance, True).mapInArrow(_each_cell(_links_of_cell, distance), "a long, b long")
    return found.unionByName(stars)


def _links_of_keys(distance: int):
    """Rows come sorted by kind and key; those of one key are compared as arrays, new ones with all."""

    def links(x: dict) -> tuple[np.ndarray, np.ndarray]:
        hashes, at = np.unique(x["h"], return_inverse=True)
        own, root = np.flatnonzero(x["fresh"]), np.arange(len(hashes))
        same, zero = len(own) == len(at), np.zeros(len(at))
        for r, c, _ in near_rows(x["h"][own], x["h"], distance, zero[own], zero, same):
            unite(root, at[own[r]], at[c])
        apart = root != np.arange(len(hashes))
        return hashes[root[apart]].view(np.int64), hashes[apart].view(np.int64)

    def found(x: dict, whole: bool) -> tuple[list, dict]:
        """Links of the keys in sorted rows, and the rows of the last key where more of it may come."""
        n = len(x["h"])
        starts = np.flatnonzero(np.concatenate([[True], (x["code"][1:] != x["code"][:-1]) | (x["kind"][1:] != x["kind"][:-1])]))
        ends = np.append(starts[1:], n)
        if not whole:
            starts, ends, rest = starts[:-1], ends[:-1], int(starts[-1])
        else:
            rest = n
        anew = np.concatenate([[0], np.cumsum(x["fresh"])])
        met = np.flatnonzero((ends - starts > 1) & (anew[ends] > anew[starts]))
        out = [(x["kind"][starts[g]], *links({k: v[starts[g] : ends[g]] for k, v in x.items()})) for g in met]
        return [o for o in out if len(o[1])], {k: v[rest:] for k, v in x.items()}

    def joined(parts: list[dict]) -> dict:
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}

    def batch_of(out: list) -> pa.RecordBatch:
        kinds = np.concatenate([np.full(len(a), k, dtype=object) for k, a, _ in out])
        return pa.record_batch([pa.array(kinds, pa.string()), pa.array(np.concatenate([a for _, a, _ in out])), pa.array(np.concatenate([b for _, _, b in out]))], names=["kind", "hx", "hy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("kind", "code", "h", "fresh")}
            col["h"] = col["h"].view(np.uint64)
            held.append(col)
            if col["code"][-1] == held[0]["code"][0] and col["kind"][-1] == held[0]["kind"][0]:
                continue
            out, rest = found(joined(held), False)
            held = [rest]
            if out:
                yield batch_of(out)
        if held:
            out, _ = found(joined(held), True)
            if out:
                yield batch_of(out)

    return run


def links_by_keys(rows: DataFrame, distance: int) -> DataFrame:
    """Links enough for the groups of near hashes that share a key: kind, hx, hy. Of the rows (kind, h, key, fresh) only pairs with a fresh one count.

    A key's rows give fewer links than there are rows, however many of them are near.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    coded = rows.select("kind", F.xxhash64("key").alias("code"), "h", "fresh").repartition(parts, "kind", "code").sortWithinPartitions("kind", "code")
    return coded.mapInArrow(_links_of_keys(distance), "kind string, hx long, hy long").distinct()
