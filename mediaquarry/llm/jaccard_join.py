"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct shingles. Documents whose sizes allow a link meet in a size band.
A band cuts the shingle space into g pieces; a document's sketch has a 64-bit word for each piece, in
which every shingle of the piece flips its hash's bits (XOR). A shingle that only one of two documents
has changes one word at most, so the number of words in which two sketches differ is a lower bound of
the symmetric difference. That in turn is at most d for linked documents, and g is above d: some word
is equal. The words are ordered by the number of shingles behind them, most first; by the prefix
principle it is enough to look at the first d + 1 words of each document, which leaves out the words
that stand for few shingles, or for none, and so for nothing in particular.

Words go to owner tasks by hash; a word that several documents have makes them candidates. Candidates
are not compared all with all: each is first compared with the word's smallest document. Documents that
are connected by then need no further comparison with each other; those of different components that
share a word are compared exactly, block against block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaquarry.llm.common import materialise, release_memory, text_of
from mediaquarry.llm.components import connected_components

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# -- sets --------------------------------------------------------------------------------------------


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles."""
    known: dict[bytes, int] = {}
    parts, lengths = [], []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        lengths.append(len(words))
        parts.append(np.array([known[w] if w in known else known.setdefault(w, len(known)) for w in words], np.int64))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))
    out = []
    tokens = hashes[np.concatenate(parts)] if known else np.zeros(0, np.uint64)
    width = max(0, len(tokens) - size + 1)
    rolled = np.full(width, np.uint64(size))
    for i in range(size):
        rolled = _mix(rolled * _A + tokens[i : i + width])
    at = 0
    for n in lengths:
        if n >= size:
            out.append(np.unique(rolled[at : at + n - size + 1]))
        elif n:
            whole = np.full(1, np.uint64(n))
            for t in tokens[at : at + n]:
                whole = _mix(whole * _A + t)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


# -- bands -------------------------------------------------------------------------------------------


class Bands:
    """Size bands for links of 100 * intersection >= percent * union.

    The smaller document of a pair has a size from ``low[j]`` up to below ``low[j + 1]`` in band j; the
    larger one may be as large as its partner can be. Bands grow by half, so a document is in 1.4 of them
    on average.
    """

    def __init__(self, percent: int):
        if not 0 < percent <= 100:
            raise ValueError("percent must be in 1..100")
        self.percent, self.low = percent, [1]

    def reach(self, total):
        """The largest symmetric difference of linked documents with ``total`` shingles together."""
        return total * (100 - self.percent) // (100 + self.percent)

    def partner(self, n):
        """The largest size that a document of n shingles can be linked with."""
        return n * 100 // self.percent

    def edges(self, largest: int) -> np.ndarray:
        while self.low[-1] <= largest:
            self.low.append(max(self.low[-1] + 1, self.low[-1] * 3 // 2))
        return np.array(self.low, np.int64)

    def pieces(self, j: int) -> int:
        """Words of a sketch in band j: one more than linked documents can differ by."""
        top = self.low[j + 1] - 1
        return self.reach(top + self.partner(top)) + 1

    def places(self, sizes: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(band, indices of the documents in it, how many words each needs)."""
        if not len(sizes):
            return []
        low = self.edges(int(sizes.max()))
        own = np.searchsorted(low, sizes, side="right") - 1
        out = []
        for j in range(len(low) - 1):
            top = int(low[j + 1]) - 1
            inside = np.flatnonzero((sizes > 0) & ((own == j) | ((own > j) & (sizes <= self.partner(top)))))
            if len(inside):
                n = sizes[inside]
                # where a document is beyond the band's own sizes, its partners there are smaller
                most = np.where(own[inside] == j, self.partner(n), top)
                out.append((j, inside, self.reach(n + most) + 1))
        return out


def sketch(sets: list[np.ndarray], pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and numbers of shingles behind them, both documents by pieces."""
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    cell = doc * pieces + (_mix(flat + _B) % np.uint64(pieces)).astype(np.int64)
    words = np.zeros(len(sets) * pieces, np.uint64)
    np.bitwise_xor.at(words, cell, flat)
    return words.reshape(-1, pieces), np.bincount(cell, minlength=len(words)).reshape(-1, pieces)


def sketch_keys(sets: list[np.ndarray], bands: Bands, chunk: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """The words to look at as 64-bit keys, and the index of the document of each."""
    sizes = np.array([len(s) for s in sets], np.int64)
    keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for j, inside, need in bands.places(sizes):
        pieces = bands.pieces(j)
        step = max(1, chunk // pieces)
        for at in range(0, len(inside), step):
            own, want = inside[at : at + step], need[at : at + step]
            words, loads = sketch([sets[i] for i in own], pieces)
            order = np.argsort(-loads, axis=1, kind="stable")
            first = np.arange(pieces)[None, :] < want[:, None]
            r, c = np.nonzero(first)
            piece = order[r, c]
            value = words[r, piece] + _A * loads[r, piece].astype(np.uint64)
            keys.append(_mix(_mix(value) + np.uint64(j * int(_A) % 2**64) + piece.astype(np.uint64) * _B))
            docs.append(own[r])
    return np.concatenate(keys), np.concatenate(docs)


# -- tasks -------------------------------------------------------------------------------------------


def _pieces_of(frames: Iterator[pd.DataFrame], chars: int) -> Iterator[pd.DataFrame]:
    """Frames cut so that each holds about ``chars`` characters, or one row."""
    for frame in frames:
        ends = frame["text"].str.len().cumsum().to_numpy() // chars
        for _, part in frame.groupby(ends, sort=False):
            yield part


def _contributions(frames: Iterator[pd.DataFrame], size: int, percent: int, owners: int, chars: int) -> Iterator[pd.DataFrame]:
    """Messages to owners. Of equal sets in one piece of input only the smallest id sends words; the others name it."""
    bands, turn = Bands(percent), 0
    for frame in _pieces_of(frames, chars):
        ids = frame["id"].to_numpy(np.int64)
        sets = shingle_sets(frame["text"].tolist(), size)
        first: dict[tuple[int, bytes], int] = {}
        rep = ids.copy()
        by_id = np.argsort(ids, kind="stable")
        sends = []
        for i in by_id:
            if len(sets[i]):
                j = first.setdefault((len(sets[i]), xxhash.xxh3_128_digest(sets[i].tobytes())), i)
                rep[i] = ids[j]
                if j == i:
                    sends.append(i)
        keys, at = sketch_keys([sets[i] for i in sends], bands)
        docs = ids[np.array(sends, np.int64)][at] if len(at) else np.zeros(0, np.int64)
        owner = ((keys >> np.uint64(17)) % np.uint64(owners)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        owner, keys, docs = owner[order], keys[order], docs[order]
        cuts = np.concatenate([np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), [len(owner)]]) if len(owner) else np.zeros(1, np.int64)
        turn += 1
        info = np.stack([ids, [len(s) for s in sets], rep]).astype(np.int64)
        rows = [((int(ids[0]) + turn) % owners, None, None, info.tobytes())]
        rows += [(int(owner[a]), keys[a:b].tobytes(), docs[a:b].tobytes(), None) for a, b in zip(cuts, cuts[1:], strict=False)]
        yield pd.DataFrame(rows, columns=["owner", "keys", "docs", "info"])
    release_memory()


def _shared(messages: pd.DataFrame) -> pd.DataFrame:
    """An owner's work: (key, id) of the words that several documents have; and what the messages say of documents."""
    info = [np.frombuffer(x, np.int64).reshape(3, -1) for x in messages["info"].dropna()]
    info = np.concatenate(info, axis=1) if info else np.zeros((3, 0), np.int64)
    keys = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in messages["keys"].dropna()]])
    docs = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, np.int64) for x in messages["docs"].dropna()]])
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    several = np.zeros(0, bool)
    if len(keys):
        several = np.minimum.reduceat(docs, starts) != np.maximum.reduceat(docs, starts)
    keep = np.repeat(several, np.diff(np.append(starts, len(keys))))
    a = np.concatenate([info[0], keys[keep].view(np.int64)])
    b = np.concatenate([info[1], docs[keep]])
    kind = np.repeat(np.array([0, 1], np.int32), [info.shape[1], int(keep.sum())])
    return pd.DataFrame({"kind": kind, "a": a, "b": b, "c": np.concatenate([info[2], np.zeros(int(keep.sum()), np.int64)])})


def linked(n: int, m: int, shared: int, percent: int) -> bool:
    return 100 * shared >= percent * (n + m - shared)


def _stars(frames: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (home, salt), the home's own row first; each other row is compared with it."""
    at, centre = None, None
    for frame in frames:
        found = []
        for home, salt, doc, data in zip(frame["home"], frame["salt"], frame["doc"], frame["set"], strict=True):
            own = np.frombuffer(data, np.uint64)
            if (home, salt) != at:
                at, centre = (home, salt), []
            if home == doc:
                centre.append(own)
            elif any(linked(len(c), len(own), len(np.intersect1d(c, own, assume_unique=True)), percent) for c in centre):
                found.append((home, doc))
        yield pd.DataFrame(found, columns=["a", "b"])
    release_memory()


def cross_links(docs: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], asks: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect different labels: enough of them to connect all that are linked, found exactly.

    Every document in ``asks`` is held against all others of other labels, first by sketches, then, where
    these leave it open, by the sets.
    """
    bands = Bands(percent)
    sizes = np.array([len(s) for s in sets], np.int64)
    parent = {int(x): int(x) for x in labels}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    pieces = int(max(8, min(512, bands.reach(2 * int(np.median(sizes))) + 1)))
    words, _ = sketch(sets, pieces)
    found = []
    for i in np.flatnonzero(asks):
        mine = root(int(labels[i]))
        limit = bands.reach(sizes + sizes[i])
        open_ = np.flatnonzero((sizes <= bands.partner(sizes[i])) & (bands.partner(sizes) >= sizes[i]) & (labels != labels[i]))
        open_ = open_[(words[open_] != words[i]).sum(axis=1) <= limit[open_]]
        for j in open_:
            theirs = root(int(labels[j]))
            if theirs != mine and linked(sizes[i], sizes[j], len(np.intersect1d(sets[i], sets[j], assume_unique=True)), percent):
                found.append((int(docs[i]), int(docs[j])))
                parent[max(mine, theirs)] = mine = min(mine, theirs)
    return found


def _rest(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    sets = [np.frombuffer(x, np.uint64) for x in group["set"]]
    found = cross_links(group["doc"].to_numpy(), group["label"].to_numpy(), sets, group["asks"].to_numpy(bool), percent)
    return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)


# -- the join ----------------------------------------------------------------------------------------


def jaccard_components(
    docs: DataFrame,
    *,
    shingle: int = 5,
    percent: int = 80,
    owner_bytes: int = 24_000_000,
    piece_chars: int = 1_500_000,
    home_rows: int = 20_000,
    block_shingles: int = 2_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Link documents whose shingle sets have 100 * intersection >= percent * union: id, n_shingles, component_id.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text of fewer words than
    ``shingle`` is one shingle, one without words has none and no links. component_id is the smallest id
    that links reach, the own included. A null text is the empty text. Rows with a null id take no part
    in links and have a null component. Rows that share an id are one document for links and keep their
    own n_shingles. An empty table gives an empty result; other columns are not read. The other
    parameters bound what a task holds and change no result.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    held = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = max(1, -(-held // owner_bytes))
    out = "owner int, keys binary, docs binary, info binary"
    sent = source.where("id is not null").mapInPandas(lambda frames: _contributions(frames, shingle, percent, owners, piece_chars), out)
    # one owner a task: several of them in one would add up
    owned = sent.repartitionById(owners, F.col("owner"))
    found = materialise(owned.groupBy("owner").applyInPandas(_shared, "kind int, a long, b long, c long"), "sketch-words")
    info = found.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("n_shingles"), F.col("c").alias("rep"))
    words = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("doc"))

    # homes: the smallest document of each word
    homes = materialise(words.groupBy("key").agg(F.min("doc").alias("home")), "word-homes")
    pairs = materialise(words.join(homes, "key").groupBy("home", "doc").agg(F.count(F.lit(1)).alias("shared")), "home-pairs")
    active = pairs.select("doc").distinct()

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _pieces_of(frames, piece_chars):
            sets = shingle_sets(frame["text"].tolist(), shingle)
            yield pd.DataFrame({"doc": frame["id"].array, "n": [len(s) for s in sets], "set": [s.tobytes() for s in sets]})
        release_memory()

    texts = source.join(_broadcast_if_small(active), source["id"] == active["doc"], "left_semi")
    sets = materialise(texts.mapInPandas(made, "doc long, n long, set binary"), "shingle-sets")

    # first each document with the home that it shares most words with, then with those that it isn't connected to yet
    twins = info.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    others = pairs.where("home <> doc")
    best = materialise(others.groupBy("doc").agg(F.max_by("home", F.struct("shared", -F.col("home"))).alias("home")), "best-homes")
    links = twins.unionByName(_star_links(best, sets, percent, home_rows))
    labels = connected_components(links)
    named = _labelled(_labelled(others.join(best, ["home", "doc"], "left_anti"), labels, "home"), labels, "doc")
    apart = materialise(named.where("home_label <> doc_label").select("home", "doc"), "open-homes")
    links = links.unionByName(_star_links(apart, sets, percent, home_rows))
    labels = connected_components(links)

    # words whose documents aren't all connected yet: they meet in a group named by the label that most of them have
    marked = _labelled(words, labels, "doc").select("key", "doc", F.col("doc_label").alias("label"))
    counts = marked.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    open_ = counts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("home"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    met = materialise(marked.join(open_.select("key", "home"), "key").select("home", "doc", "label").distinct(), "open-words")
    rest = sets.join(_broadcast_if_small(met), "doc").select("home", "doc", "label", "n", "set")
    sizes = met.join(sets.select("doc", "n"), "doc").groupBy("home").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks"))
    spread = rest.join(sizes, "home").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asking = spread.where("label <> home").select("home", F.col("block").alias("i"), every.alias("j"), "doc", "label", "set", F.lit(True).alias("asks"))
    # within one block a document that asks is there already
    asked = spread.select("home", every.alias("i"), F.col("block").alias("j"), "doc", "label", "set", F.lit(False).alias("asks")).where("i <> j or label = home")
    crossed = asking.unionByName(asked).groupBy("home", "i", "j").applyInPandas(lambda g: _rest(g, percent), "a long, b long")
    more = materialise(crossed, "open-links")
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more))
    own = info.join(labels, "id", "left").select("id", "n_shingles", F.coalesce("label", "id").alias("component_id"))
    return own.unionByName(_without_id(source, shingle)).withColumnRenamed("id", id_col)


def _labelled(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """``rows`` with the label of a document column; a document without links is its own."""
    own = labels.select(F.col("id").alias(column), F.col("label").alias("_label"))
    return rows.join(own, column, "left").withColumn(f"{column}_label", F.coalesce("_label", column)).drop("_label")


def _broadcast_if_small(ids: DataFrame, rows: int = 500_000) -> DataFrame:
    """``ids``, a few numbers a row, marked for broadcast if it was counted to have no more than ``rows``; else joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= rows else ids


def _star_links(pairs: DataFrame, sets: DataFrame, percent: int, home_rows: int) -> DataFrame:
    """The linked ones of pairs (home, doc). A home with many documents is dealt to several tasks, each of which gets the home's own set."""
    salts = pairs.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / home_rows).cast("int").alias("salts"))
    members = pairs.join(salts, "home").select("home", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int").alias("salt"), "doc")
    centres = salts.select("home", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("home").alias("doc"))
    rows = sets.join(_broadcast_if_small(members.unionByName(centres)), "doc").select("home", "salt", "doc", "set")
    rows = rows.repartition("home", "salt").sortWithinPartitions("home", "salt", F.col("doc") != F.col("home"))
    return materialise(rows.mapInPandas(lambda frames: _stars(frames, percent), "a long, b long"), "star-links")


def _without_id(source: DataFrame, shingle: int) -> DataFrame:
    """Rows with a null id, with their number of shingles and no component."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"n_shingles": [len(s) for s in shingle_sets(frame["text"].tolist(), shingle)]})

    rows = source.where("id is null").select("text").mapInPandas(counted, "n_shingles long")
    return rows.select(F.lit(None).cast("long").alias("id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
