"""Merkle manifest of a dataset: a tree for each part, a tree over their roots, a proof for each row.

Rows are leaves; a leaf is a digest in hexadecimal. The leaves of a part, in the order of their ids, are cut into aligned
blocks of ``block`` leaves. A block is one contiguous matrix of 64-byte rows; reshaped by the fanout, its rows are
hashed level by level up to the block's root. The roots of blocks are the nodes of the next stage, which are cut into blocks
in turn, until a part has one node. So a task holds one block, whatever the size of a part; the parts' roots are the leaves of
one more tree, made the same way.

Proofs go down again: a block gets the siblings of its root's path and computes those of its own leaves, whose places follow
from a leaf's number alone. A claimed leaf is folded with the siblings up to the root.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaquarry.llm.common import materialise

#: Bytes of a digest as text.
_HEX = 64


def field(column: Column) -> Column:
    """A value as an unambiguous text: '-' for null, else its length in bytes, a colon, and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """The digest of a row's values."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


# -- one block -------------------------------------------------------------------------------------


def height(total: int, fanout: int, block: int) -> int:
    """Levels of a block in a tree of ``total`` nodes: up to one node, or up to the root of a full block."""
    levels, size = 0, 1
    while total > 1 and size < block:
        total, size, levels = -(-total // fanout), size * fanout, levels + 1
    return levels


def hashed(rows: np.ndarray) -> np.ndarray:
    """The digests of the rows of a matrix of bytes, as rows of 64 bytes."""
    data, width = rows.tobytes(), rows.shape[1]
    digests = "".join([sha256(data[i : i + width]).hexdigest() for i in range(0, len(data), width)])
    return np.frombuffer(digests.encode(), np.uint8).reshape(-1, _HEX)


def levels(leaves: np.ndarray, fanout: int, count: int) -> list[np.ndarray]:
    """The matrices of a block from its leaves up; the last run of a level may have fewer nodes, even one."""
    found = [leaves]
    for _ in range(count):
        own = found[-1]
        whole = len(own) // fanout * fanout
        above = [hashed(own[:whole].reshape(-1, fanout * _HEX))] if whole else []
        if whole < len(own):
            above.append(hashed(own[whole:].reshape(1, -1)))
        found.append(np.concatenate(above))
    return found


def siblings(buffers: list[bytes], level: int, node: int, fanout: int) -> tuple[bytes, bytes]:
    """The digests left and right of a node in its run."""
    low = node // fanout * fanout
    high = min(low + fanout, len(buffers[level]) // _HEX)
    own = buffers[level]
    return own[low * _HEX : node * _HEX], own[(node + 1) * _HEX : high * _HEX]


def folded(digest: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a digest leads to with the siblings of its path."""
    for left, right in zip(lefts, rights, strict=True):
        digest = sha256(f"{left}{digest}{right}".encode()).hexdigest()
    return digest


class Block:
    """The nodes of one aligned block, in the order of their places."""

    def __init__(self, digests: pd.Series, total: int, fanout: int, block: int):
        self.fanout = fanout
        leaves = np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, _HEX)
        self.levels = levels(leaves, fanout, height(total, fanout, block))
        self.buffers = [m.tobytes() for m in self.levels]
        self.root = self.buffers[-1].decode()

    def path(self, node: int) -> tuple[list[str], list[str]]:
        """The siblings of a leaf's path within the block, level by level."""
        lefts, rights = [], []
        for level in range(len(self.levels) - 1):
            left, right = siblings(self.buffers, level, node, self.fanout)
            lefts.append(left.decode())
            rights.append(right.decode())
            node //= self.fanout
        return lefts, rights

    def proofs(self, above: bytes) -> list[bytes]:
        """For each leaf all siblings of its path in a row, then ``above``. Nodes hand what they share down."""
        shared = [above]
        for level in range(len(self.levels) - 2, -1, -1):
            shared = [b"".join((*siblings(self.buffers, level, i, self.fanout), shared[i // self.fanout])) for i in range(len(self.levels[level]))]
        return shared


# -- all blocks ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Forest:
    """Trees by stages: nodes (_tree, _pos, _total, _digest, ...) from the leaves to one node a tree."""

    stages: list[DataFrame]
    fanout: int
    block: int

    @property
    def tops(self) -> DataFrame:
        """The root of each tree: _tree, _digest."""
        return self.stages[-1].select("_tree", "_digest")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds _pos, the place of a row in its _tree by ``order``, and _total, the tree's rows.

    Rows are sorted by ranges, so a tree may spread over all tasks; a task's rows of a tree get the number of those in tasks
    before it. Rows that are equal in ``order`` are told apart by where they are stored.
    """
    keys = ["_tree", *order, "_stored"]
    rows = rows.withColumn("_stored", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialise(ranged.withColumn("_task", F.shiftright("_at", 33)), "merkle-order")
    each = ranged.groupBy("_tree", "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("_tree")
    before = F.sum("_n").over(own.orderBy("_task")) - F.col("_n")
    starts = each.select("_tree", "_task", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("_total"))
    placed = ranged.join(starts, ["_tree", "_task"]).withColumn("_pos", F.col("_at") + F.col("_shift"))
    return placed.drop("_stored", "_at", "_task", "_shift")


def _block(size: int) -> Column:
    return ((F.col("_pos") - F.col("_pos") % size) / size).cast("long").alias("_block")


def grown(leaves: DataFrame, fanout: int, block: int) -> Forest:
    """The stages above numbered leaves. A tree with one node left keeps it while others grow on."""
    if fanout < 2 or block < fanout or fanout ** height(block, fanout, block) != block:
        raise ValueError("a block must hold a power of the fanout, above 1")

    def root(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_pos")
        top = Block(frame["_digest"], int(frame["_total"].iloc[0]), fanout, block)
        return pd.DataFrame({"_tree": frame["_tree"].iloc[:1], "_pos": frame["_block"].iloc[:1], "_total": -(-frame["_total"].iloc[:1] // block), "_digest": [top.root]})

    stages, most = [leaves], leaves.agg(F.max("_total")).first()[0] or 0
    while most > 1:
        below = stages[-1].select("_tree", "_pos", "_total", "_digest", _block(block))
        above = below.groupBy("_tree", "_block").applyInPandas(root, "_tree string, _pos long, _total long, _digest string")
        stages.append(materialise(above, "merkle-stage"))
        most = -(-most // block)
    return Forest(stages, fanout, block)


def _met(forest: Forest, stage: int, paths: DataFrame, made: Callable[[pd.DataFrame, Block, pd.Series], pd.DataFrame], schema: str) -> DataFrame:
    """Each block of a stage with the path of its root (_tree, _pos, _lefts, _rights, ...)."""
    fanout, block = forest.fanout, forest.block

    def both(frame: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_pos")
        return made(frame, Block(frame["_digest"], int(frame["_total"].iloc[0]), fanout, block), path.iloc[0])

    nodes = forest.stages[stage].select("*", _block(block))
    return nodes.groupBy("_tree", "_block").cogroup(paths.withColumnRenamed("_pos", "_block").groupBy("_tree", "_block")).applyInPandas(both, schema)


def paths_down(forest: Forest, tops: DataFrame, stage: int) -> DataFrame:
    """The paths of a stage's nodes, given those of the trees' roots (_tree, _lefts, _rights, _subroot): _tree, _pos and the same columns."""

    def made(frame: pd.DataFrame, own: Block, path: pd.Series) -> pd.DataFrame:
        found = [own.path(i) for i in range(len(frame))]
        out = frame[["_tree", "_pos"]].copy()
        out["_lefts"] = [[*lefts, *path["_lefts"]] for lefts, _ in found]
        out["_rights"] = [[*rights, *path["_rights"]] for _, rights in found]
        out["_subroot"] = path["_subroot"]
        return out

    paths = tops.withColumn("_pos", F.lit(0).cast("long"))
    for at in range(len(forest.stages) - 2, stage - 1, -1):
        paths = materialise(_met(forest, at, paths, made, "_tree string, _pos long, _lefts array<string>, _rights array<string>, _subroot string"), "merkle-paths")
    return paths


@dataclass(frozen=True)
class Manifest:
    """The trees of the parts, the tree over their roots, and its root; None where there are no rows."""

    parts: Forest
    top: Forest
    root: str | None

    def part_paths(self) -> DataFrame:
        """For each part the path of its root: _tree, _lefts, _rights, _subroot."""
        none = F.array().cast("array<string>")
        start = self.top.tops.select("_tree", none.alias("_lefts"), none.alias("_rights"), F.lit("").alias("_subroot"))
        down = paths_down(self.top, start, 0).select("_pos", "_lefts", "_rights")
        return self.top.stages[0].join(down, "_pos").select(F.col("_name").alias("_tree"), "_lefts", "_rights", F.col("_digest").alias("_subroot"))

    def block_paths(self) -> DataFrame:
        """For each block of leaves the path of its root."""
        return paths_down(self.parts, self.part_paths(), 1)


def build_manifest(rows: DataFrame, order: list[str], *, fanout: int = 2, block: int = 4096) -> Manifest:
    """The manifest of ``rows``: _tree (the part's key, in the order of the parts), _digest, and columns to order and carry."""
    parts = grown(materialise(numbered(rows, order), "merkle-leaves"), fanout, block)
    subroots = materialise(parts.tops.select(F.lit("").alias("_tree"), F.col("_tree").alias("_name"), "_digest"), "merkle-subroots")
    top = grown(materialise(numbered(subroots, ["_name"]), "merkle-parts"), fanout, block)
    found = top.tops.first()
    return Manifest(parts, top, found and found["_digest"])


def audited(manifest: Manifest, schema: str, claim: str = "_claim") -> DataFrame:
    """Every leaf with its subroot, the digest of its proof, and the root that the claimed leaf in ``claim`` folds to.

    ``schema``: the carried columns that are returned. A null claim is the stored leaf itself; such leaves, as all that lead to the
    stored root of their block, share the fold of that root.
    """
    carried = [c.strip().split(" ")[0] for c in schema.split(",")]

    def made(frame: pd.DataFrame, own: Block, path: pd.Series) -> pd.DataFrame:
        lefts, rights = list(path["_lefts"]), list(path["_rights"])
        above = "".join(x + y for x, y in zip(lefts, rights, strict=True)).encode()
        right = folded(own.root, lefts, rights)
        roots = []
        for i, (stored, claimed) in enumerate(zip(frame["_digest"], frame[claim], strict=True)):
            if claimed is None or claimed == stored:
                roots.append(right)
            else:
                inner = own.path(i)
                roots.append(folded(claimed, inner[0] + lefts, inner[1] + rights))
        out = frame[carried].copy()
        out["leaf"], out["subroot"] = frame["_digest"], path["_subroot"]
        out["proof_sha256"] = [sha256(p).hexdigest() for p in own.proofs(above)]
        out["folded_root"] = roots
        return out

    found = _met(manifest.parts, 0, manifest.block_paths(), made, f"{schema}, leaf string, subroot string, proof_sha256 string, folded_root string")
    return found.select(*carried, "leaf", "subroot", F.lit(manifest.root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(manifest.root)).alias("verified"))


def proofs(manifest: Manifest, schema: str) -> DataFrame:
    """The proof of every leaf as it is sent to a verifier: carried columns, leaf, and the siblings left and right of the path, level by level."""
    carried = [c.strip().split(" ")[0] for c in schema.split(",")]

    def made(frame: pd.DataFrame, own: Block, path: pd.Series) -> pd.DataFrame:
        found = [own.path(i) for i in range(len(frame))]
        out = frame[carried].copy()
        out["leaf"] = frame["_digest"]
        out["lefts"] = [[*x, *path["_lefts"]] for x, _ in found]
        out["rights"] = [[*x, *path["_rights"]] for _, x in found]
        return out

    return _met(manifest.parts, 0, manifest.block_paths(), made, f"{schema}, leaf string, lefts array<string>, rights array<string>")


def document_manifest(docs: DataFrame, *, every: int = 7, fanout: int = 2, block: int = 4096) -> DataFrame:
    """Manifest of documents by lang, with an audit in which some rows claim one character more.

    Rows whose crc32 of the id, as text, is divisible by ``every`` claim n_chars + 1. Returns doc_id, leaf, subroot, root, proof_sha256,
    folded_root and verified, one row per input row. Null fields are '-' in the leaf, so a null differs from an
    empty text; a null lang is a part of its own, the first. Null ids come first in their part and are not tampered with; rows
    that repeat an id follow each other by their leaves. A lone leaf is its part's root, a lone part's root the root; their
    proof is the digest of nothing. An empty table gives an empty result; other columns, whatever their names, are not read.
    """
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    claimed = F.coalesce(F.try_add(F.col("n_chars"), F.lit(1)), F.col("n_chars"))
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("_tree"),
        F.col("doc_id").cast("long").alias("_id"),
        leaf(*[F.col(c) for c in columns]).alias("_digest"),
        F.when(tampered, leaf(*[claimed if c == "n_chars" else F.col(c) for c in columns])).alias("_claim"),
    )
    manifest = build_manifest(materialise(rows, "merkle-rows"), ["_id", "_digest"], fanout=fanout, block=block)
    return audited(manifest, "_id long").withColumnRenamed("_id", "doc_id")
