"""Scoring texts with a weighted backoff automaton.

The model has n-grams of order one to three with Dirichlet smoothing. With c for training counts, N tokens
and V of them different,

    P(w)       = (c(w) + 0.5) / (N + 0.5 * (V + 1))
    P(w | b)   = (c(b w) + m2 * P(w)) / (c(b) + m2)
    P(w | a b) = (c(a b w) + m3 * P(w | b)) / (c(a b) + m3)

where the start of a text is a word before its first. As an automaton: the root, every word seen in training, the
start, and every seen pair that doesn't end a text are states; a seen n-gram is an arc from the state of all but its
last word to the state of its longest suffix that has one. Where a state has no arc for a word, its failure arc leads to its own longest
suffix, at the weight m / (c + m); the root has an arc for every word. m2 and m3 are fitted to the training
texts: the weight that failure arcs get in all is to be the share of n-grams seen once (Good and Turing).

The automaton of a large corpus has no size bound, so no task ever holds it. Texts are cut into blocks of
about ``block_tokens``. Blocks send their words, spelled out, to the tasks that own them; an owner adds up the
counts of all blocks and gives each word its number. Then blocks send pairs and triples, as these numbers, to
owners, and get back the totals of those they asked for. With them a block builds the part of the
automaton that its own texts can reach, and walks each text through it from left to right. Of an n-gram a
block sends one entry, so a common one brings its owner as many entries as there are blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaquarry.llm.common import crc_fold, materialise, release_memory, text_of

_HALF = 0.5
#: Number of the start of a text, which is a context only; owners give words smaller numbers.
START = np.uint64(1 << 63)
#: What m2 and m3 are chosen from.
GRID = 2.0 ** np.arange(0, 25)
#: So many texts or more are walked side by side; a text alone is walked in spans of so many tokens.
_SIDE_BY_SIDE, _WALK = 12, 1 << 16
#: Kinds of n-grams besides words: pairs that are contexts, pairs that end a text, and triples. Owners know them by the numbers of their words.
_KINDS = {"context": ("first", "last"), "pair": ("first", "last"), "triple": ("first", "middle", "last")}

_PARTS = [f"{kind}_{part}" for kind, places in _KINDS.items() for part in (*places, "counts")]


def tokens_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


# -- packing -------------------------------------------------------------------------------------


def _packed(values: np.ndarray) -> bytes:
    """Integers as planes of bytes, each compressed by itself: how many, which planes aren't zero, their lengths, the planes."""
    planes = np.ascontiguousarray(values).astype("<u8").view(np.uint8).reshape(-1, 8).T
    compressor = zstandard.ZstdCompressor(level=1, write_checksum=False)
    used = [k for k in range(8) if planes[k].any()]
    frames = [compressor.compress(planes[k].tobytes()) for k in used]
    head = np.array([len(values), sum(1 << k for k in used), *map(len, frames)], "<u4")
    return head.tobytes() + b"".join(frames)


def _unpacked(data: bytes) -> np.ndarray:
    size, mask = np.frombuffer(data, "<u4", 2).tolist()
    used = [k for k in range(8) if mask >> k & 1]
    at, planes = 8 + 4 * len(used), np.zeros((8, size), np.uint8)
    for k, length in zip(used, np.frombuffer(data, "<u4", len(used), 8).tolist(), strict=True):
        planes[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + length]), np.uint8)
        at += length
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _packed_steps(values: np.ndarray) -> bytes:
    """Integers as their differences, modulo 2 to the 64th, with the sign in the lowest bit."""
    steps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    return _packed((steps << 1) ^ (steps >> 63))


def _unpacked_steps(data: bytes) -> np.ndarray:
    steps = _unpacked(data).astype(np.int64)
    return np.cumsum(((steps >> 1) & np.int64((1 << 63) - 1)) ^ -(steps & 1), dtype=np.int64).view(np.uint64)


def _spelled(words: Sequence[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words))


def _read(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b" ")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _mixed(keys: Sequence[np.ndarray]) -> np.ndarray:
    """One hash of several numbers."""
    out = np.zeros(len(keys[0]), np.uint64)
    for key in keys:
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + _mix(key + np.uint64(0x632BE59BD9B4E019)))
    return out


def _by_owner(owner: np.ndarray, owners: int) -> np.ndarray:
    """The order by owner, otherwise as it was."""
    return np.argsort(owner.astype(np.uint16) if owners <= 1 << 16 else owner, kind="stable")


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, sorted, and where each value is among them."""
    at, found = pd.factorize(values)
    order = np.argsort(found)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return found[order], place[at]


def _owner(hashes: np.ndarray, owners: int) -> np.ndarray:
    """The owner of each hash: a range of its upper 32 bits."""
    return (((hashes >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)).astype(np.int64)


# -- blocks --------------------------------------------------------------------------------------


class Block:
    """Texts as numbers of the block's own ``words``; number 0 is the end of a text, spelled as the empty word.

    ``ids`` has all texts' tokens in a row, ``lengths`` counts each text's tokens with its end. ``train``
    says whether a text is a training text.
    """

    def __init__(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray, train: np.ndarray):
        self.words, self.ids, self.lengths, self.train = words, ids, lengths, train
        self.starts = np.cumsum(lengths) - lengths
        self.trained = np.repeat(train, lengths)
        #: base of combined numbers; the start of a text is the number after the last word
        self.base = len(words) + 1

    @classmethod
    def of(cls, row) -> Block:
        flags = np.asarray(row.flags, np.int64)
        return cls(_read(row.words), _unpacked(row.tokens).astype(np.int64), np.asarray(row.lengths, np.int64), flags % 2 == 1)

    def counts(self) -> np.ndarray:
        """Training counts of the words."""
        return np.bincount(self.ids[self.trained], minlength=len(self.words))

    def by_number(self, totals: np.ndarray, numbers: np.ndarray) -> tuple[Block, tuple[np.ndarray, np.ndarray]]:
        """The block with its words in the order of their ``numbers``, the end first, and both arrays in that order."""
        order = np.concatenate([[0], 1 + np.argsort(numbers[1:], kind="stable")])
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return Block([self.words[i] for i in order.tolist()], place[self.ids], self.lengths, self.train), (totals[order], numbers[order])

    def find_ngrams(self) -> None:
        """Number the block's pairs and triples.

        ``pairs`` are (before, word) in one integer, ``at_pair`` the pair at each place, ``context`` whether
        a pair is one, that is no end; ``triples`` are (pair before, word) and ``at_triple`` the triple at each
        place, -1 at the first of a text.
        """
        base, ids = self.base, self.ids
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[self.starts] = base - 1
        self.pairs, self.at_pair = _numbered(before * base + ids)
        self.context = self.pairs % base != 0
        inner = np.ones(len(ids), bool)
        inner[self.starts] = False
        places = np.flatnonzero(inner)
        self.triples, at = _numbered(self.at_pair[places - 1] * base + ids[places])
        #: for each triple the pair that ends it
        self.triple_ends = np.empty(len(self.triples), np.int64)
        self.triple_ends[at] = self.at_pair[places]
        self.at_triple = np.full(len(ids), -1, np.int64)
        self.at_triple[places] = at

    def questions(self, numbers: np.ndarray, known: np.ndarray, owners: int) -> dict[str, tuple]:
        """For each kind what is sent: which n-grams, by owner and then as they are numbered, their owners, and the numbers of their words.

        An n-gram with a word that training never saw is not sent.
        """
        number, seen = np.append(numbers, START), np.append(known, True)
        first, second = self.pairs // self.base, self.pairs % self.base
        usual = seen[first] & seen[second]
        before, last = self.triples // self.base, self.triples % self.base
        out = {}
        for kind in _KINDS:
            if kind == "triple":
                which = np.flatnonzero(usual[before] & seen[last])
                words = first[before[which]], second[before[which]], last[which]
            else:
                which = np.flatnonzero(usual & (self.context == (kind == "context")))
                words = first[which], second[which]
            keys = [number[w] for w in words]
            owner = _owner(_mixed(keys), owners)
            order = _by_owner(owner, owners)
            out[kind] = which[order], owner[order], *(k[order] for k in keys)
        return out


def _blocks(frames: Iterator[pd.DataFrame], block_tokens: int) -> Iterator[pd.DataFrame]:
    """Rows of the block table from rows (id, train, text). A text longer than a block gets one of its own."""
    vocabulary: dict[bytes, int] = {b"": 0}
    held: list = []
    parts: list[np.ndarray] = []
    size = 0

    def made() -> pd.DataFrame:
        row = {
            "ids": [h[0] or 0 for h in held],
            "flags": [h[1] + 2 * (h[0] is None) for h in held],
            "lengths": [h[2] for h in held],
            "n_words": len(vocabulary),
            "words": _spelled(list(vocabulary)),
            "tokens": _packed(np.concatenate(parts)),
        }
        return pd.DataFrame([row])

    for frame in frames:
        for doc_id, train, text in zip(frame["id"], frame["train"], frame["text"], strict=True):
            tokens = tokens_of(text)
            if size and size + len(tokens) + 1 > block_tokens:
                yield made()
                vocabulary, held, parts, size = {b"": 0}, [], [], 0
            known = vocabulary
            ids = np.zeros(len(tokens) + 1, np.uint32)
            ids[:-1] = [known[w] if w in known else known.setdefault(w, len(known)) for w in tokens]
            held.append((None if pd.isna(doc_id) else int(doc_id), bool(train), len(ids)))
            parts.append(ids)
            size += len(ids)
    if size:
        yield made()
    release_memory()


# -- owners --------------------------------------------------------------------------------------


def _word_owners(words: list[bytes], owners: int) -> np.ndarray:
    return _owner(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), owners)


def _word_messages(frames: Iterator[pd.DataFrame], owners: int) -> Iterator[pd.DataFrame]:
    """A block's words and their training counts, to each owner that has any of them."""
    for frame in frames:
        for row in frame.itertuples(index=False):
            block = Block.of(row)
            counts, owner = block.counts(), _word_owners(block.words, owners)
            order = _by_owner(owner, owners)
            out = []
            for p, own in _runs(owner[order]):
                which = order[own]
                out.append((row.block, p, _spelled([block.words[i] for i in which.tolist()]), _packed(counts[which])))
            yield pd.DataFrame(out, columns=["block", "owner", "words", "counts"])


def _runs(owner: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each owner in a sorted row of owners, and where it is."""
    present, first = np.unique(owner, return_index=True)
    for p, low, high in zip(present.tolist(), first.tolist(), [*first[1:].tolist(), len(owner)][: len(present)], strict=True):
        yield p, slice(low, high)


def _parted(values: np.ndarray, sizes: Sequence[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1])


def _own_words(messages: pd.DataFrame, owners: int) -> pd.DataFrame:
    """An owner's words: for each message totals and numbers, in the message's order; in the first row the owner's
    tokens, different tokens, and the weight of its words' failure arcs for every m of the grid."""
    index: dict[bytes, int] = {}
    at, sizes = [], []
    for data in messages["words"]:
        words = _read(data)
        at.append(np.array([index.setdefault(w, len(index)) for w in words], np.int64))
        sizes.append(len(words))
    place = np.concatenate(at)
    sums = np.bincount(place, np.concatenate([_unpacked(x) for x in messages["counts"]]), len(index)).astype(np.int64)
    # common words get small numbers, which compress
    number = np.empty(len(sums), np.uint64)
    number[np.argsort(-sums, kind="stable")] = np.arange(len(sums), dtype=np.uint64) * np.uint64(owners) + np.uint64(messages["owner"].iloc[0])
    out = pd.DataFrame({"block": messages["block"].to_numpy(), "owner": messages["owner"].to_numpy()})
    out["totals"] = [_packed(x) for x in _parted(sums[place], sizes)]
    out["numbers"] = [_packed(x) for x in _parted(number[place], sizes)]
    ends = index.get(b"", -1)
    inner = np.delete(sums, ends) if ends >= 0 else sums
    rest = [None] * (len(out) - 1)
    out["tokens"] = [int(sums.sum()), *rest]
    out["distinct"] = [int((sums > 0).sum()), *rest]
    out["mass"] = [_mass(inner).tolist(), *rest]
    return out


def _mass(counts: np.ndarray) -> np.ndarray:
    """Expected uses of the failure arcs of contexts with these counts, for every m of the grid."""
    size, times = np.unique(counts[counts > 0], return_counts=True)
    return (times * size * GRID[:, None] / (size + GRID[:, None])).sum(axis=1)


def _own_ngrams(messages: pd.DataFrame) -> pd.DataFrame:
    """An owner's n-grams: totals for every message in its order; in the first row how many pairs and triples were seen
    once, and the weight of its contexts' failure arcs for every m of the grid."""
    out = pd.DataFrame({"block": messages["block"].to_numpy(), "owner": messages["owner"].to_numpy()})
    once, mass = {}, [0.0] * len(GRID)
    for kind, places in _KINDS.items():
        counts = [_unpacked(x) for x in messages[f"{kind}_counts"]]
        sizes = [len(x) for x in counts]
        at = np.zeros(sum(sizes), np.int64)
        for place in places:
            read = _unpacked_steps if place == "first" else _unpacked
            words, different = pd.factorize(np.concatenate([read(x) for x in messages[f"{kind}_{place}"]]))
            at, keys = pd.factorize(at * max(1, len(different)) + words)
        sums = np.bincount(at, np.concatenate(counts), len(keys)).astype(np.int64)
        out[f"{kind}_totals"] = [_packed(x) for x in _parted(sums[at], sizes)]
        once[kind] = int((sums == 1).sum())
        if kind == "context":
            mass = _mass(sums).tolist()
    rest = [None] * (len(out) - 1)
    out["once_pairs"] = [once["context"] + once["pair"], *rest]
    out["once_triples"] = [once["triple"], *rest]
    out["mass"] = [mass, *rest]
    return out


def _ngram_messages(block_id: int, block: Block, words: tuple[np.ndarray, np.ndarray], owners: int) -> pd.DataFrame:
    """A block's pairs and triples with their training counts, to each owner that has any of them."""
    totals, numbers = words
    block.find_ngrams()
    inner = block.trained & (block.at_triple >= 0)
    pairs = np.bincount(block.at_pair[block.trained], minlength=len(block.pairs))
    counts = {"pair": pairs, "context": pairs, "triple": np.bincount(block.at_triple[inner], minlength=len(block.triples))}
    sent: dict[int, dict[str, bytes]] = {}
    for kind, (which, owner, *keys) in block.questions(numbers, totals > 0, owners).items():
        for p, own in _runs(owner):
            # n-grams with the same first word stand together
            parts = {f"{kind}_{place}": (_packed_steps if place == "first" else _packed)(k[own]) for place, k in zip(_KINDS[kind], keys, strict=True)}
            sent.setdefault(p, {}).update(parts, **{f"{kind}_counts": _packed(counts[kind][which[own]])})
    none = _packed(np.empty(0, np.uint64))
    return pd.DataFrame([(block_id, p, *(own.get(n, none) for n in _PARTS)) for p, own in sent.items()], columns=["block", "owner", *_PARTS])


def _word_answers(answers: pd.DataFrame, block: Block, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals and numbers of the block's words."""
    owner = _word_owners(block.words, owners)
    order = _by_owner(owner, owners)
    got = answers.sort_values("owner")
    totals, numbers = np.zeros(len(order), np.int64), np.zeros(len(order), np.uint64)
    totals[order] = np.concatenate([_unpacked(x) for x in got["totals"]])
    numbers[order] = np.concatenate([_unpacked(x) for x in got["numbers"]])
    return totals, numbers


def _ngram_answers(answers: pd.DataFrame, block: Block, words: tuple[np.ndarray, np.ndarray], owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals of the block's pairs and triples."""
    totals, numbers = words
    pairs, triples = np.zeros(len(block.pairs), np.int64), np.zeros(len(block.triples), np.int64)
    got = answers.sort_values("owner")
    for kind, (which, *_) in block.questions(numbers, totals > 0, owners).items():
        found = np.concatenate([np.empty(0, np.int64), *(_unpacked(x).astype(np.int64) for x in got[f"{kind}_totals"])])
        (triples if kind == "triple" else pairs)[which] = found
    return pairs, triples


# -- the automaton -------------------------------------------------------------------------------


class Automaton:
    """The part of the automaton that a block's texts can reach.

    States are numbers: 0 the root, 1 + w that of word w (the start of a text is the word after the last),
    then those of the pairs. ``words``, ``pairs`` and ``triples`` are the training totals of the block's n-grams.
    """

    def __init__(self, block: Block, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, texts: int, tokens: int, distinct: int, m2: float, m3: float):
        self.block, self.words, self.pairs, self.triples = block, words, pairs, triples
        base = block.base
        self.first_pair = base + 1
        contexts = np.append(words, texts)
        contexts[0] = 0  # nothing follows an end
        p1 = (words + _HALF) / (tokens + _HALF * (distinct + 1))
        before, last = block.pairs // base, block.pairs % base
        p2 = (pairs + m2 * p1[last]) / (contexts[before] + m2)
        inner = block.triples // base
        p3 = (triples + m3 * p2[block.triple_ends]) / (pairs[inner] + m3)
        self.log1 = np.log10(p1)
        self.start = base
        # the arcs of each place's word, from its pair's, its word's and the root's state: whether there is one, weight, next state
        ids, pair, triple = block.ids, block.at_pair, block.at_triple
        after_pair = np.where(block.context & (pairs > 0), self.first_pair + np.arange(len(pairs)), 1 + last)
        found = np.append(triples > 0, False)[triple]
        self.arcs3 = found, np.append(np.log10(p3), 0.0)[triple], np.append(after_pair[block.triple_ends], 0)[triple]
        self.arcs2 = (pairs > 0)[pair], np.log10(p2)[pair], after_pair[pair]
        self.arcs1 = self.log1[ids], np.where(words > 0, 1 + np.arange(len(words)), 0)[ids]
        # failure arcs; from a pair's state to its last word's, from a word's to the root
        self.pair_fail, self.pair_word = np.log10(m3 / (pairs + m3)), 1 + last
        self.word_fail = np.log10(m2 / (contexts + m2))

    def scores(self) -> np.ndarray:
        """Each text walked from left to right, all texts side by side while there are many, then one by one."""
        block = self.block
        order = np.argsort(-block.lengths, kind="stable")
        starts, lengths = block.starts[order], block.lengths[order]
        totals, states = np.zeros(len(order)), np.full(len(order), self.start, np.int64)
        # how many texts have a token at step j
        widths = len(order) - np.cumsum(np.bincount(lengths))
        step, width = 0, len(order)
        while width >= _SIDE_BY_SIDE:
            totals[:width], states[:width] = self.step(starts[:width] + step, states[:width], totals[:width])
            step += 1
            width = int(widths[step])
        for k in range(width):
            totals[k] = self.walk(int(starts[k]) + step, int(starts[k] + lengths[k]), int(states[k]), float(totals[k]))
        out = np.empty(len(order))
        out[order] = totals
        return out

    def step(self, places: np.ndarray, states: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One token of each of several texts: failure arcs down to a state that has an arc for it, and that arc."""
        weight, to = self.arcs1[0][places], self.arcs1[1][places]
        deep = states >= self.first_pair
        there3, there2 = deep & self.arcs3[0][places], self.arcs2[0][places]
        down = np.flatnonzero(deep & ~there3)
        totals, states = totals.copy(), states.copy()
        pair = states[down] - self.first_pair
        totals[down] += self.pair_fail[pair]
        states[down] = self.pair_word[pair]
        middle = ~there3 & (states > 0)
        down = np.flatnonzero(middle & ~there2)
        totals[down] += self.word_fail[states[down] - 1]
        for there, arcs in ((np.flatnonzero(middle & there2), self.arcs2), (np.flatnonzero(there3), self.arcs3)):
            weight[there], to[there] = arcs[1][places[there]], arcs[2][places[there]]
        return totals + weight, to

    def walk(self, low: int, high: int, state: int, total: float) -> float:
        """One traversal of the places from ``low`` to ``high``: the state is carried, log-probabilities are added up."""
        first, pair_fail, pair_word, word_fail = self.first_pair, self.pair_fail, self.pair_word, self.word_fail
        for begin in range(low, high, _WALK):
            span = slice(begin, min(high, begin + _WALK))
            arcs = [x[span].tolist() for x in (*self.arcs3, *self.arcs2, *self.arcs1)]
            for there3, weight3, to3, there2, weight2, to2, weight1, to1 in zip(*arcs, strict=True):
                if state >= first:
                    if there3:
                        total += weight3
                        state = to3
                        continue
                    total += pair_fail[state - first]
                    state = pair_word[state - first]
                if state:
                    if there2:
                        total += weight2
                        state = to2
                        continue
                    total += word_fail[state - 1]
                total += weight1
                state = to1
        return float(total)


def fitted(mass: Sequence[float], once: float) -> float:
    """The m whose expected uses of failure arcs are the number of n-grams seen once, between those of the grid."""
    mass = np.asarray(mass)
    if not once or not mass.any():
        return float(GRID[0])
    return float(2 ** np.interp(np.log(once), np.log(mass), np.log2(GRID)))


def score_language_model(
    docs: DataFrame,
    *,
    held_out_fold: int = 1,
    block_tokens: int = 700_000,
    owner_keys: int = 1_500_000,
    smoothing: tuple[float, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Score every whole text: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training texts are those outside the held-out fold; every text is scored. Tokens are the words, A-Z
    lower-cased, and one end. A null text is the empty text, whose only token is its end. Null ids are
    kept and fall into the fold of the empty text's crc32. Repeated rows train and are scored each; an
    empty table gives an empty result; without training texts every token is unknown. Other columns are
    not read. ``smoothing`` replaces the fitted (m2, m3). ``block_tokens`` and ``owner_keys`` bound what a task holds
    and change no result beyond the order of sums.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (crc_fold(F.col(id_col)) != held_out_fold).alias("train"), text_of(text_col).alias("text"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _blocks(frames, block_tokens)

    made = rows.mapInPandas(cut, "ids array<long>, flags array<int>, lengths array<long>, n_words long, words binary, tokens binary")
    blocks = materialise(made.select(F.monotonically_increasing_id().alias("block"), "*"), "lm-blocks")
    counted = blocks.select(
        F.sum(F.size(F.filter("flags", lambda t: t % 2 == 1))).alias("texts"),
        F.sum("n_words").alias("words"),
        F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)).alias("tokens"),
    ).first()
    texts = int(counted["texts"] or 0)
    word_owners = max(1, -(-int(counted["words"] or 0) // owner_keys))
    ngram_owners = max(1, -(-int(counted["tokens"] or 0) // owner_keys))

    def words_asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _word_messages(frames, word_owners)

    def own_words(messages: pd.DataFrame) -> pd.DataFrame:
        return _own_words(messages, word_owners)

    asked = blocks.mapInPandas(words_asked, "block long, owner int, words binary, counts binary")
    reply = "block long, owner int, totals binary, numbers binary, tokens long, distinct long, mass array<double>"
    word_answers = materialise(asked.repartitionById(word_owners, F.col("owner")).groupBy("owner").applyInPandas(own_words, reply), "lm-words")
    tokens, distinct, mass2 = _sums(word_answers, ["tokens", "distinct"])

    def ngrams_asked(_key, own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        found = []
        for row in own.itertuples(index=False):
            block = Block.of(row)
            block, words = block.by_number(*_word_answers(got, block, word_owners))
            found.append(_ngram_messages(row.block, block, words, ngram_owners))
        return pd.concat(found)

    own_blocks = blocks.select("block", "flags", "lengths", "words", "tokens")
    own_answers = word_answers.select("block", "owner", "totals", "numbers")
    parts = ", ".join(f"{part} binary" for part in _PARTS)
    asked = own_blocks.groupBy("block").cogroup(own_answers.groupBy("block")).applyInPandas(ngrams_asked, f"block long, owner int, {parts}")
    totals = ", ".join(f"{kind}_totals binary" for kind in _KINDS)
    reply = f"block long, owner int, {totals}, once_pairs long, once_triples long, mass array<double>"
    ngram_answers = materialise(asked.repartitionById(ngram_owners, F.col("owner")).groupBy("owner").applyInPandas(_own_ngrams, reply), "lm-ngrams")
    once2, once3, mass3 = _sums(ngram_answers, ["once_pairs", "once_triples"])
    # the start of a text is a context as well
    m2, m3 = smoothing or (fitted(mass2 + texts * GRID / (texts + GRID), once2), fitted(mass3, once3))

    def walked(_key, own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        found = []
        for row in own.itertuples(index=False):
            block = Block.of(row)
            block, words = block.by_number(*_word_answers(got[got["totals"].notna()], block, word_owners))
            block.find_ngrams()
            pairs, triples = _ngram_answers(got[got["totals"].isna()], block, words, ngram_owners)
            model = Automaton(block, words[0], pairs, triples, texts, tokens, distinct, m2, m3)
            ids = pd.array(np.asarray(row.ids, np.int64), dtype="Int64")
            ids[np.asarray(row.flags) >= 2] = pd.NA
            found.append(
                pd.DataFrame(
                    {
                        "id": ids,
                        "n_tokens": block.lengths,
                        "n_known": np.add.reduceat((words[0] > 0)[block.ids].astype(np.int64), block.starts),
                        "train_tokens": tokens,
                        "base_score": np.add.reduceat(model.log1[block.ids], block.starts),
                        "score": model.scores(),
                    }
                )
            )
        return pd.concat(found)

    both = own_answers.unionByName(ngram_answers.select("block", "owner", *[f"{k}_totals" for k in _KINDS]), allowMissingColumns=True)
    scored = (
        blocks.groupBy("block")
        .cogroup(both.groupBy("block"))
        .applyInPandas(walked, "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
    return scored.select(
        F.col("id").alias(id_col), (crc_fold(F.col("id")) == held_out_fold).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def _sums(answers: DataFrame, names: Sequence[str]) -> tuple:
    """Sums of the owners' figures, and of their weights for every m of the grid: one row comes to the driver."""
    mass = [F.sum(F.get("mass", F.lit(k))).alias(f"m{k}") for k in range(len(GRID))]
    row = answers.select(*[F.sum(n).alias(n) for n in names], *mass).first()
    return (*(int(row[n] or 0) for n in names), np.array([row[f"m{k}"] or 0.0 for k in range(len(GRID))]))
