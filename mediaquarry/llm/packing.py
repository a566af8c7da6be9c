"""Packing documents into windows of a fixed number of tokens, with next to no padding.

1. A document's tokens are cut into whole windows, which are sequences by themselves, and a rest that is shorter than a window.
2. Rests are counted by length. This histogram, which has as many cells as a window has tokens, is all that the driver sees.
3. Combinations of up to three lengths that fill a window are enumerated, and non-negative least squares, by accelerated projected
   gradients, finds how often to repeat each so that the histogram is met best. The repeats are rounded, as far as there are rests.
4. What is left is packed greedily: the longest rests that fit, then a cut of one more to fill the window; what is cut off is a
   rest again. Equal windows are packed at once, so the work depends on the number of lengths, not of documents. The tokens left at last are
   fewer than a window and are cut into powers of two, which need no padding.
5. The plan names its rests by length and number. A rest's number is its place in its task plus the number of equally long rests in the
   tasks before it, so documents look the plan up without meeting in groups.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict, deque
from collections.abc import Callable, Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaquarry.llm.common import materialise, release_memory, text_of

# -- tokens ----------------------------------------------------------------------------------------

#: White space, and what might be taken for it.
_SPACES = r"\s\x1c-\x1f\x85\u180e\u200b\ufeff"
_MORE_SPACES = "\u180e\u200b\ufeff"
#: A space between characters that surely are no white space: no token of the byte vocabulary reaches across.
_CUT = regex.compile(f"(?<=[^{_SPACES}]) (?=[^{_SPACES}])")
#: The first character that the quick encoder isn't asked about.
_LATIN = "\u0180"
#: Longer units are left to the library.
_LONG = 200
#: Characters of text that are encoded together.
_CHUNK = 4_000_000
#: What a unit's edges are: unsure at its beginning, at its end.
_BEGINS, _ENDS = 1, 2


def _spaced(c: str) -> bool:
    return c.isspace() or c in _MORE_SPACES


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each of several runs, one run after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class _Index(dict):
    """Units and their numbers; a unit that is asked for and missing gets the next number."""

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        return number


class ByteBpe:
    """Token ids of whole texts, as the tokenizers library gives them.

    Texts are cut at spaces no token reaches across, and each different unit is encoded once: Latin ones by
    ``quick``, a faster encoder of the same vocabulary where there is one, all others by the library. Units are joined for that; the tokens'
    byte lengths tell where each ends. A text with spaces of which that isn't sure is cut with more care. ``limit`` bounds the bytes of
    what is remembered; it changes no result.
    """

    #: Bytes of an entry besides its ids.
    _ENTRY = 160

    def __init__(self, library, quick: Callable[[str], Sequence[int]] | None = None, limit: int = 128 << 20):
        library.no_truncation()
        library.no_padding()
        self.library, self.quick, self.limit = library, quick, limit
        specials = library.get_added_tokens_decoder()
        self.specials = [t.content for t in specials.values()]
        vocabulary = library.get_vocab(with_added_tokens=True)
        #: bytes of each token; a special token's string stands for its own bytes, other tokens have a character a byte
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token.encode()) if i in specials else len(token)
        self.index = _Index()
        self.ids = np.empty(0, np.uint32)
        #: of each unit: its ids, how often it was met, its characters, its edges
        self.counts, self.used, self.chars, self.edges = (np.empty(0, np.int64) for _ in range(4))

    # A unit within a text stands for a space and itself; the first of a text has a space in front, as no other can.

    def _careful(self, text: str) -> list[str]:
        units = [text] if any(s in text for s in self.specials) else _CUT.split(text)
        units[0] = f" {units[0]}"
        return units

    def _joined(self, units: list[str], quick: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units in a row, and how many each has."""
        text = "".join(units)
        ids = np.array(self.quick(text) if quick else self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)) if text.isascii() else np.fromiter((len(u.encode()) for u in units), np.int64, len(units)))
        return ids, np.diff(np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1, prepend=0)

    def _add(self, units: list[str]) -> None:
        """Encode units that are new. Those within a text can be joined, as a space begins each and none ends them; others are encoded alone."""
        kinds: list[list[int]] = [[], [], []]
        edges = np.zeros(len(units), np.int64)
        for i, unit in enumerate(units):
            own = unit[1:] if unit[:1] == " " else unit
            if not own or _spaced(own[0]) or _spaced(own[-1]):
                edges[i] = (_BEGINS if not own or _spaced(own[0]) else 0) | (_ENDS if not own or _spaced(own[-1]) else 0)
                kinds[2].append(i)
            elif unit is not own or len(own) > _LONG:
                kinds[2].append(i)
            else:
                kinds[0 if self.quick and (own.isascii() or max(own) < _LATIN) else 1].append(i)
        flat, counts = [], np.zeros(len(units), np.int64)
        for kind in (0, 1):
            if kinds[kind]:
                ids, counts[kinds[kind]] = self._joined([f" {units[i]}" for i in kinds[kind]], kind == 0)
                flat.append(ids)
        alone = [units[i][1:] if units[i][:1] == " " else f" {units[i]}" for i in kinds[2]]
        found = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(alone, add_special_tokens=False)]
        counts[kinds[2]] = [len(x) for x in found]
        order = np.array([*kinds[0], *kinds[1], *kinds[2]], np.int64)
        starts = np.zeros(len(units), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        self.ids = np.concatenate([self.ids, np.concatenate([*flat, *found, np.empty(0, np.uint32)])[_spread(starts, counts)]])
        self.counts, self.edges = np.concatenate([self.counts, counts]), np.concatenate([self.edges, edges])
        self.used = np.concatenate([self.used, np.zeros(len(units), np.int64)])
        self.chars = np.concatenate([self.chars, np.fromiter(map(len, units), np.int64, len(units))])

    def _numbers(self, units: list[str]) -> np.ndarray:
        known = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        if len(self.index) > known:
            self._add(list(islice(self.index, known, None)))
        return at

    def encoded(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, none of which is null."""
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        low = 0
        while low < len(texts):
            done = int(sizes[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(sizes, done + _CHUNK, side="right")))
            yield from self._together(texts.slice(low, high - low))
            low = high

    def _together(self, texts: pa.Array) -> Iterator[np.ndarray]:
        cut = pc.split_pattern(texts, " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        bounds, units = bounds - bounds[0], cut.flatten()
        first = np.zeros(len(units), bool)
        first[bounds[:-1]] = True
        inner = units.filter(pa.array(~first)).dictionary_encode()
        at = np.empty(len(units), np.int64)
        at[first] = self._numbers([f" {u}" for u in units.filter(pa.array(first)).to_pylist()])
        at[~first] = self._numbers(inner.dictionary.to_pylist())[inner.indices.to_numpy()]
        edges = self.edges[at]
        unsure = np.zeros(len(units), bool)
        unsure[1:] = ((edges[1:] & _BEGINS) | (edges[:-1] & _ENDS)) > 0
        careful = np.logical_or.reduceat(unsure & ~first, bounds[:-1])
        for s in self.specials:
            careful |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if careful.any():
            runs = [at[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            for i in np.flatnonzero(careful).tolist():
                runs[i] = self._numbers(self._careful(texts[i].as_py()))
            at, bounds = np.concatenate(runs), np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        ids = self.ids[_spread((np.cumsum(self.counts) - self.counts)[at], self.counts[at])]
        ends = np.concatenate([[0], np.cumsum(self.counts[at])])[bounds]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield ids[a:b]
        self.used += np.bincount(at, minlength=len(self.used))
        if self._ENTRY * len(self.index) + self.ids.nbytes + int(self.chars.sum()) > self.limit:
            self._shrink()

    def _shrink(self) -> None:
        """Keep what was used most, up to half the limit."""
        size = self._ENTRY + 4 * self.counts + self.chars
        order = np.argsort(-self.used, kind="stable")
        kept = np.sort(order[np.cumsum(size[order]) <= self.limit // 2])
        units, starts = list(self.index), np.cumsum(self.counts) - self.counts
        self.ids = self.ids[_spread(starts[kept], self.counts[kept])]
        self.counts, self.used, self.chars, self.edges = self.counts[kept], self.used[kept] // 2, self.chars[kept], self.edges[kept]
        self.index = _Index((units[i], k) for k, i in enumerate(kept.tolist()))


_LOADED: dict[tuple, ByteBpe] = {}


def byte_bpe(vocabulary: str, ranks: bytes | None = None, pattern: str | None = None) -> ByteBpe:
    """The encoder of a vocabulary (the text of its file), made once in each worker."""
    key = (hash(vocabulary), hash(ranks))
    if key not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer

        quick = None
        if ranks is not None:
            import base64

            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
            quick = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        _LOADED.clear()
        _LOADED[key] = ByteBpe(Tokenizer.from_str(vocabulary), quick)
    return _LOADED[key]


# -- plan ------------------------------------------------------------------------------------------


def fillings(lengths: np.ndarray, window: int, depth: int = 3) -> np.ndarray:
    """All combinations of 2 to ``depth`` of the lengths, at most 3, that fill a window: a row each, ascending, with zeros in front."""
    own = np.zeros(window + 1, bool)
    own[lengths] = True
    own[0] = False
    first = np.flatnonzero(own)
    pairs = first[(2 * first <= window) & own[np.maximum(window - first, 0)]]
    rows = [np.stack([np.zeros_like(pairs), pairs, window - pairs], axis=1)]
    if depth >= 3:
        for a in first[3 * first <= window].tolist():
            b = first[(first >= a) & (2 * first <= window - a)]
            b = b[own[window - a - b]]
            rows.append(np.stack([np.full_like(b, a), b, window - a - b], axis=1))
    return np.concatenate(rows)


def repeats(combinations: np.ndarray, histogram: np.ndarray, steps: int = 600) -> np.ndarray:
    """How often to use each combination so that the lengths' counts come closest to the histogram: non-negative least squares.

    Accelerated projected gradients, restarted where the direction turns. A length of zero is no length.
    """
    columns = [combinations[:, i] for i in range(combinations.shape[1])]
    cells = len(histogram)

    def used(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(c, x, cells) for c in columns)
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return sum(r[c] for c in columns)

    v = np.ones(cells)
    largest = 1.0
    for _ in range(30):
        v[0] = 0
        w = used(back(v))
        largest = float(np.linalg.norm(w))
        if not largest:
            return np.zeros(len(combinations))
        v = w / largest
    step = 1 / (1.02 * largest)
    x = y = np.zeros(len(combinations))
    t = 1.0
    for _ in range(steps):
        gradient = back(used(y) - histogram)
        new = np.maximum(y - step * gradient, 0)
        if gradient @ (new - x) > 0:
            t = 1.0
        grown = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / grown * (new - x), new, grown
    return x


class Plan:
    """Which rests go where: rows of (length, first rest, rests, start in the rest, tokens, first sequence, offset)."""

    def __init__(self, histogram: Sequence[int], window: int, depth: int = 3):
        self.window = window
        #: rests, or what is left of them, by their number of tokens: runs of (length, start, first rest, rests)
        self._runs: dict[int, deque] = defaultdict(deque)
        self._left = np.array(histogram, np.int64)
        for length in np.flatnonzero(self._left).tolist():
            self._runs[length].append((length, 0, 0, int(self._left[length])))
        self.rows: list[tuple[int, ...]] = []
        self.sequences = 0
        self._fill(depth)
        self._pack()
        self._end()

    def _take(self, tokens: int, count: int, sequence: int, offset: int, cut: int | None = None) -> None:
        """The first ``count`` rests of so many tokens, to a place in as many sequences; of each only ``cut`` tokens if that is given."""
        self._left[tokens] -= count
        runs = self._runs[tokens]
        while count:
            length, start, first, rests = runs.popleft()
            n = min(count, rests)
            if n < rests:
                runs.appendleft((length, start, first + n, rests - n))
            self.rows.append((length, first, n, start, tokens if cut is None else cut, sequence, offset))
            if cut is not None:
                self._runs[tokens - cut].append((length, start + cut, first, n))
                self._left[tokens - cut] += n
            count, sequence = count - n, sequence + n

    def _fill(self, depth: int) -> None:
        found = fillings(np.flatnonzero(self._left), self.window, depth)
        if not len(found):
            return
        wanted = np.rint(repeats(found, self._left.astype(float))).astype(np.int64)
        for i in np.argsort(-wanted, kind="stable").tolist():
            if wanted[i] < 1:
                break
            lengths = [x for x in found[i].tolist() if x]
            n = min(int(wanted[i]), *(int(self._left[x]) // lengths.count(x) for x in lengths))
            if n:
                self._window([(x, None) for x in reversed(lengths)], n)

    def _window(self, pieces: list[tuple[int, int | None]], count: int) -> None:
        offset = 0
        for tokens, cut in pieces:
            self._take(tokens, count, self.sequences, offset, cut)
            offset += tokens if cut is None else cut
        self.sequences += count

    def _pieces(self, room: int) -> list[tuple[int, int | None]]:
        """The longest rests that fit, one after the other, and a cut of the shortest of the others for what is left of the room."""
        left, pieces = self._left.copy(), []
        while room:
            fit = np.flatnonzero(left[: room + 1])
            if not len(fit):
                break
            pieces.append((int(fit[-1]), None))
            left[fit[-1]] -= 1
            room -= int(fit[-1])
        if room:
            longer = np.flatnonzero(left)
            if len(longer):
                pieces.append((int(longer[0]), room))
        return pieces

    def _pack(self) -> None:
        tokens = int(self._left @ np.arange(len(self._left)))
        while tokens >= self.window:
            pieces = self._pieces(self.window)
            lengths = [x for x, _ in pieces]
            # as often as all of its rests are there
            count = min(int(self._left[x]) // lengths.count(x) for x in lengths)
            self._window(pieces, count)
            tokens -= count * self.window

    def _end(self) -> None:
        tokens = int(self._left @ np.arange(len(self._left)))
        while tokens:
            room = 1 << (tokens.bit_length() - 1)
            self._window(self._pieces(room), 1)
            tokens -= room


class Placement:
    """The plan's rows by length and number of the rest."""

    def __init__(self, plan: Plan):
        rows = np.array(plan.rows, np.int64).reshape(-1, 7)
        # within a length, rests between two borders of rows have the same rows
        keys, lists = [], []
        for length in np.unique(rows[:, 0]).tolist():
            own = rows[rows[:, 0] == length]
            borders = np.unique(np.concatenate([own[:, 1], own[:, 1] + own[:, 2]]))
            first, last = np.searchsorted(borders, own[:, 1]), np.searchsorted(borders, own[:, 1] + own[:, 2])
            span = last - first
            at = np.repeat(first, span) + (np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span))
            row = np.repeat(np.arange(len(own)), span)
            order = np.lexsort((own[row, 3], at))
            keys.append(np.stack([np.full(len(order), length), borders[at[order]]], axis=1))
            lists.append(own[row[order]])
        self.rows = np.concatenate(lists) if lists else rows
        every = np.concatenate(keys) if keys else np.zeros((0, 2), np.int64)
        new = np.ones(len(every), bool)
        new[1:] = (every[1:] != every[:-1]).any(axis=1)
        self.starts = np.flatnonzero(new)
        self.counts = np.diff(np.append(self.starts, len(every)))
        self.keys = self._key(every[self.starts, 0], every[self.starts, 1])

    @staticmethod
    def _key(length: np.ndarray, number: np.ndarray) -> np.ndarray:
        # in this order; a number has 48 bits
        return (length << 48) | number

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rests by length and number: which rest, and its rows, in the order of their starts."""
        at = np.searchsorted(self.keys, self._key(length, number), side="right") - 1
        held = self.counts[at]
        rest = np.repeat(np.arange(len(at)), held)
        row = np.repeat(self.starts[at] - (np.cumsum(held) - held), held) + np.arange(int(held.sum()))
        return rest, self.rows[row]


# -- documents -------------------------------------------------------------------------------------

_RESTS = "_task long, _tokens long, _length long, _local long, _before long, _crcs array<long>, _rest binary"


def pack_documents(
    docs: DataFrame, vocabulary: str, *, ranks: str | None = None, pattern: str | None = None, window: int = 1024, end: int = 0, depth: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pack whole texts, each with an end token behind it, into sequences of at most ``window`` tokens.

    ``vocabulary``: path of a tokenizers file, ``ranks`` and ``pattern``: of the same vocabulary for tiktoken, which is used for Latin
    text if given. Returns a row for each piece: id, start (the document's tokens before it), length, ids_crc32 (of its ids, little-endian
    unsigned 32-bit integers), doc_tokens, sequence_id, offset. Pieces of a sequence lie side by side from offset 0; all
    sequences have ``window`` tokens but for less than a window's tokens in all, which have powers of two, so nothing is padded.
    A null text is the empty text, which has the end token alone; null and repeated ids are kept, every row is packed; an empty
    table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    table = None
    if ranks is not None:
        with open(ranks, "rb") as f:
            table = f.read()
    shared = spark.sparkContext.broadcast((spec, table))
    kind = dict(docs.dtypes)[id_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, last = byte_bpe(*shared.value, pattern), np.array([end], "<u4").tobytes()
        task, seen, windows = TaskContext.get().partitionId(), np.zeros(window, np.int64), 0
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for ids in bpe.encoded(batch.column("text")):
                raw = ids.astype("<u4", copy=False).tobytes() + last
                whole, length = divmod(len(raw) // 4, window)
                view = memoryview(raw)
                crcs = [zlib.crc32(view[4 * window * k : 4 * window * (k + 1)]) for k in range(whole)]
                for column, value in zip(out, (len(raw) // 4, length, int(seen[length]), windows, crcs, raw[4 * window * whole :]), strict=True):
                    column.append(value)
                seen[length] += 1
                windows += whole
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            columns = [batch.column("_id"), pa.array([task] * batch.num_rows, pa.int64()), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_task", "_tokens", "_length", "_local", "_before", "_crcs", "_rest"])
        release_memory()

    cuts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text")).mapInArrow(cut, f"_id {kind}, {_RESTS}")
    cuts = materialise(cuts, "packing-rests")

    # a task's rests of a length, and its whole windows under the length 0, which no rest of tokens has
    windows = F.floor((F.col("_tokens") - F.col("_length")) / window).cast("long")
    rests = cuts.select("_task", "_length", F.when(F.col("_length") > 0, 1).otherwise(0).cast("long").alias("_n"))
    whole = cuts.select("_task", F.lit(0).cast("long").alias("_length"), windows.alias("_n"))
    each = materialise(rests.unionByName(whole).groupBy("_task", "_length").agg(F.sum("_n").alias("_n")), "packing-counts")
    histogram = [0] * window
    for r in each.where("_length > 0").groupBy("_length").agg(F.sum("_n").alias("n")).collect():
        histogram[r["_length"]] = r["n"]
    plan = Plan(histogram, window, depth)
    places, planned = spark.sparkContext.broadcast(Placement(plan)), plan.sequences

    before = F.sum("_n").over(Window.partitionBy("_length").orderBy("_task")) - F.col("_n")
    starts = each.select("_task", "_length", before.alias("_start"))
    rest_starts = starts.where("_length > 0").withColumnRenamed("_start", "_rest_start")
    window_starts = starts.where("_length = 0").select("_task", F.col("_start").alias("_window_start"))
    placed = cuts.join(rest_starts, ["_task", "_length"], "left").join(window_starts, "_task")
    placed = placed.select(
        "_id", "_tokens", "_length", "_crcs", "_rest", (F.col("_local") + F.coalesce("_rest_start", F.lit(0))).alias("_number"), (F.col("_before") + F.col("_window_start")).alias("_window")
    )

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield _pieces(frame, places.value, planned, window)

    schema = f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInPandas(pieces, schema).withColumnRenamed("_id", id_col)


def _pieces(frame: pd.DataFrame, places: Placement, planned: int, window: int) -> pd.DataFrame:
    """The pieces of documents: their whole windows, then those of their rests."""
    tokens, length = frame["_tokens"].to_numpy(np.int64), frame["_length"].to_numpy(np.int64)
    whole = (tokens - length) // window
    doc = np.repeat(np.arange(len(frame)), whole)
    place = np.arange(int(whole.sum())) - np.repeat(np.cumsum(whole) - whole, whole)
    crcs = np.fromiter(chain.from_iterable(frame["_crcs"]), np.int64, len(doc))
    sequence = planned + frame["_window"].to_numpy(np.int64)[doc] + place
    zeros = np.zeros(len(doc), np.int64)

    rests = np.flatnonzero(length)
    at, rows = places.find(length[rests], frame["_number"].to_numpy(np.int64)[rests])
    own = rests[at]
    raw = frame["_rest"].to_numpy()
    rest_crcs = [zlib.crc32(memoryview(raw[d])[4 * s : 4 * (s + n)]) for d, s, n in zip(own.tolist(), rows[:, 3].tolist(), rows[:, 4].tolist(), strict=True)]
    every = np.concatenate([doc, own])
    return pd.DataFrame(
        {
            "_id": frame["_id"].array.take(every),
            "start": np.concatenate([place * window, whole[own] * window + rows[:, 3]]),
            "length": np.concatenate([zeros + window, rows[:, 4]]),
            "ids_crc32": np.concatenate([crcs, np.array(rest_crcs, np.int64)]),
            "doc_tokens": tokens[every],
            "sequence_id": np.concatenate([sequence, rows[:, 5] + frame["_number"].to_numpy(np.int64)[own] - rows[:, 1]]),
            "offset": np.concatenate([zeros, rows[:, 6]]),
        }
    )
