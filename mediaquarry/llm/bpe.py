"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word the last token of its encoding is unique, and a token that ends the prefix is
that last token exactly if it is compatible with the last token of what precedes it: if the two, put
side by side, are not merged differently. An automaton over the vocabulary, with failure links, gives
the tokens that end at each position; the longest compatible one is stored, and following the stored
tokens back from the end of the word gives its ids.

The words of a batch of texts are encoded once each, all of them together and place by place: the heads
of the words are sorted, so a prefix that words share is worked out at the first of them only. Words and
their ids stay in a table of bounded size until the task ends; beyond the bound the half that was used most is
kept. The automaton lives on in a worker as a few arrays.

Letters, digits, case and composition are those of Python's Unicode tables. Where these and the library's may not agree,
as for code points that only one of them has, texts and words are normalised and cut by the library's own normaliser and
pattern, before they are encoded here. Which code points these are is found by asking the library for every one.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import sha256
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaquarry.llm.common import release_memory, text_of

#: White space as the vocabulary's normaliser sees it; str.split() also splits at the four below.
_OTHER_SPACES = regex.compile(r"[\x1c-\x1f]")
_SPACES = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

#: A symbol is a byte, plus this where it is the last of a word.
_LAST = 256
#: Tokens and states fit into so many bits of a combined key.
_BITS = 20
#: Longer words are encoded one by one, over arrays of their own.
_LONG = 64
#: Words that are encoded together.
_TOGETHER = 1 << 16
#: Characters of text that are encoded together.
_CHUNK = 4_000_000


@lru_cache(maxsize=2)
def odd_points(spec: str) -> str:
    """A pattern for the code points that Python's Unicode tables lack or that the library normalises otherwise, alone or next to other marks."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(spec).normalizer
    kinds = [unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1)]
    odd = {chr(c) for c, kind in enumerate(kinds) if kind == "Cn"}
    points = [chr(c) for c, kind in enumerate(kinds) if kind not in ("Cn", "Co", "Cs")]
    # a letter keeps what is before apart from what comes after; marks of the lowest and the highest class show the class between
    for probe in ("{}", "a\u0345{}", "a{}\u0334"):
        for i in range(0, len(points), 4096):
            asked = [probe.format(c) for c in points[i : i + 4096]]
            own = [WordBpe.normalised(x) for x in asked]
            if library.normalize_str("x".join(asked)) != "x".join(own):
                odd |= {c for c, x, y in zip(points[i : i + 4096], asked, own, strict=True) if library.normalize_str(x) != y}
    codes = sorted(map(ord, odd))
    first = [c for k, c in enumerate(codes) if not k or codes[k - 1] != c - 1]
    last = [c for k, c in enumerate(codes) if k + 1 == len(codes) or codes[k + 1] != c + 1]
    return "[" + "".join(f"\\U{x:08x}-\\U{y:08x}" for x, y in zip(first, last, strict=True)) + "]"


#: Code points below the first that Python's tables lack; those that other tables know less about are above it, too.
_MAYBE_ODD = re.compile("[\u0378-\U0010ffff]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else free))
        free += b not in plain
    return out


def _lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is in a sorted table, and whether it is there."""
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each of several runs, one run after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class WordBpe:
    """A vocabulary with merges whose words end with a marked symbol.

    ``spec``: the text of the vocabulary's JSON file, ``odd`` the pattern of ``odd_points``. ``cache_bytes`` bounds what is
    remembered between words; it changes no result.
    """

    def __init__(self, spec: str, odd: str | None = None, cache_bytes: int = 96 << 20):
        self._text, self._library, self._odd = spec, None, re.compile(odd or odd_points(spec))
        spec = json.loads(spec)
        model = spec["model"]
        suffix: str = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.specials.items()}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))))
        self._pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        parts = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        #: for each token the rank of the merge that makes it (-1: none) and its two parts
        size = max(self.strings) + 1
        self.made = np.full((size, 3), -1, np.int64)
        for r, (a, b, whole) in enumerate(parts):
            self.made[whole] = r, a, b
        pairs = np.array([(a << _BITS) | b for a, b, _ in parts], np.int64)
        order = np.argsort(pairs)
        self._pairs, self._pair_ranks = pairs[order], order.astype(np.int64)
        #: pairs whose compatibility is known, each at one slot; a later pair takes the slot over
        self._known = np.full(1 << 20, -1, np.int64)
        self._known_fits = np.zeros(1 << 20, bool)
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self._build_automaton(
            {
                i: self._codes(token, suffix, byte_of)
                for token, i in vocab.items()
                if self.made[i, 0] >= 0 or len(token.removesuffix(suffix) or token) == 1
            }
        )
        self.words = _Words(self, cache_bytes)

    # -- automaton -------------------------------------------------------------------------------

    @staticmethod
    def _codes(token: str, suffix: str, byte_of: dict[str, int]) -> list[int]:
        """The symbols of a token."""
        marked = token.endswith(suffix) and token != suffix
        codes = [byte_of[c] for c in (token[: -len(suffix)] if marked else token)]
        if marked:
            codes[-1] += _LAST
        return codes

    def _build_automaton(self, tokens: dict[int, list[int]]) -> None:
        goto: list[dict[int, int]] = [{}]
        ends: list[tuple[int, int] | None] = [None]
        for i, codes in tokens.items():
            at = 0
            for c in codes:
                if c not in goto[at]:
                    goto[at][c] = len(goto)
                    goto.append({})
                    ends.append(None)
                at = goto[at][c]
            ends[at] = (len(codes), i)
        fail = [0] * len(goto)
        found: list[tuple] = [()] * len(goto)  # the tokens that end here, longest first
        waiting = list(goto[0].values())
        for at in waiting:
            found[at] = (ends[at],) if ends[at] else ()
        for at in waiting:  # grows while it is walked
            for c, to in goto[at].items():
                back = fail[at]
                while back and c not in goto[back]:
                    back = fail[back]
                fail[to] = goto[back].get(c, 0)
                found[to] = ((ends[to],) if ends[to] else ()) + found[fail[to]]
                waiting.append(to)
        # arrays from here on: workers that live on hold little
        arcs = sorted(((at << _BITS) | c, to) for at, own in enumerate(goto) for c, to in own.items())
        self._arcs, self._arc_ends = (np.array(column, np.int64) for column in zip(*arcs, strict=True))
        self._fail = np.array(fail, np.int64)
        counts = np.array([len(f) for f in found], np.int64)
        self._found_until = np.cumsum(counts)
        self._found_from = self._found_until - counts
        flat = np.array([t for f in found for t in f], np.int64).reshape(-1, 2)
        self._found_sizes, self._found_tokens = flat[:, 0].copy(), flat[:, 1].copy()

    def _steps(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The state after one symbol from each state: its arc, or that of the next state along the failure links."""
        out, at = np.zeros_like(states), states
        open_ = np.arange(len(states))
        while len(open_):
            arc, found = _lookup(self._arcs, (at << _BITS) | codes[open_])
            out[open_[found]] = self._arc_ends[arc[found]]
            on = ~found & (at > 0)  # at the root, without an arc: the root
            open_, at = open_[on], self._fail[at[on]]
        return out

    # -- compatibility ---------------------------------------------------------------------------

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, are left alone by the merges."""
        return bool(self._fit(np.array([left], np.int64), np.array([right], np.int64))[0])

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``fits`` for many pairs: those known, then each other pair once."""
        keys = (left << _BITS) | right
        slots = ((keys * 0x9E3779B1) >> 12) & (len(self._known) - 1)
        out = self._known_fits[slots]
        new = np.flatnonzero(self._known[slots] != keys)
        if len(new):
            pairs, at = np.unique(keys[new], return_inverse=True)
            out[new] = self._undone(pairs >> _BITS, pairs & ((1 << _BITS) - 1))[at]
            self._known[slots[new]] = keys[new]
            # of pairs that share a slot the last one has it; it is written with its own answer
            self._known_fits[slots[new]] = out[new]
        return out

    def _undone(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Going back in time from both tokens, the later merge is undone first; at every stage the two symbols that
        meet must not have been merged before the stage ended. Of equal merges the left one came first, so the
        right one is undone first.
        """
        out = np.ones(len(a), bool)
        open_, until = np.arange(len(a)), np.full(len(a), len(self._pairs), np.int64)
        while len(open_):
            at, merged = _lookup(self._pairs, (a << _BITS) | b)
            bad = merged & (self._pair_ranks[at] < until)
            out[open_[bad]] = False
            ra, rb = self.made[a, 0], self.made[b, 0]
            on = ~bad & ((ra >= 0) | (rb >= 0))
            open_, a, b, ra, rb = open_[on], a[on], b[on], ra[on], rb[on]
            left = ra > rb
            a, b, until = np.where(left, self.made[a, 2], a), np.where(left, b, self.made[b, 1]), np.where(left, ra, rb + 1)
        return out

    # -- words -----------------------------------------------------------------------------------

    def _last_tokens(self, rows: np.ndarray, end: int | np.ndarray, states: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Size and id of the last token of prefixes that lead to ``states``.

        ``rows`` and ``end`` say whose prefix it is and how long; ``before[n, row]`` is the last token of that row's
        first n symbols, -1 for none.
        """
        ends = np.broadcast_to(end, rows.shape)
        sizes, tokens = np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        open_, at = np.arange(len(rows)), self._found_from[states]
        while len(open_):
            if (at >= self._found_until[states[open_]]).any():
                raise ValueError("a symbol that the vocabulary lacks")
            size, token = self._found_sizes[at], self._found_tokens[at]
            last = before[ends[open_] - size, rows[open_]]
            good = last < 0
            inner = np.flatnonzero(~good)
            good[inner] = self._fit(last[inner], token[inner])
            sizes[open_[good]], tokens[open_[good]] = size[good], token[good]
            open_, at = open_[~good], at[~good] + 1
        return sizes, tokens

    def _encode_together(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in sorted order, none longer than ``_LONG``: all ids in a row, and how many each word has."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        widest = int(lengths.max())
        codes = np.zeros((n, widest), np.int64)
        codes[np.arange(widest) < lengths[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        # how much of its head each word shares with the head before it
        inside = np.arange(widest) < np.minimum(lengths[1:], lengths[:-1])[:, None] - 1
        shared = np.zeros(n, np.int64)
        shared[1:] = np.cumprod((codes[1:] == codes[:-1]) & inside, axis=1).sum(axis=1)
        tokens = np.full((widest + 1, n), -1, np.int64)
        sizes = np.zeros((widest + 1, n), np.int64)
        states = np.zeros(n, np.int64)
        head_states = np.zeros(n, np.int64)
        for j in range(widest - 1):
            new = np.flatnonzero((lengths - 1 > j) & (shared <= j))
            if not len(new):
                break
            after = self._steps(states[new], codes[new, j])
            size, token = self._last_tokens(new, j + 1, after, tokens)
            # each prefix is followed, in the order of the words, by the words that share it
            run = np.zeros(n, np.int64)
            run[new] = 1
            run = np.maximum(np.cumsum(run) - 1, 0)
            states, sizes[j + 1], tokens[j + 1] = after[run], size[run], token[run]
            head = lengths == j + 2
            head_states[head] = states[head]
        every = np.arange(n)
        final = self._steps(head_states, codes[every, lengths - 1] + _LAST)
        size, token = self._last_tokens(every, lengths, final, tokens)
        found, left = [(every, token)], lengths - size
        rows = every
        while True:
            on = left > 0
            rows, left = rows[on], left[on]
            if not len(rows):
                break
            found.append((rows, tokens[left, rows]))
            left = left - sizes[left, rows]
        counts = np.zeros(n, np.int64)
        for own, _ in found:
            counts[own] += 1
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]), np.uint32)
        for back, (own, ids) in enumerate(found):
            out[ends[own] - 1 - back] = ids
        return out, counts

    def _encode_long(self, piece: bytes) -> list[int]:
        """One long word, over lists of its own, so that it takes room in proportion to its length."""
        steps: dict[tuple[int, int], int] = {}
        fits: dict[tuple[int, int], bool] = {}
        state, last = 0, [(0, -1)]
        for end, c in enumerate([*piece[:-1], piece[-1] + _LAST], 1):
            if (state, c) not in steps:
                steps[state, c] = int(self._steps(np.array([state], np.int64), np.array([c], np.int64))[0])
            state = steps[state, c]
            own = slice(self._found_from[state], self._found_until[state])
            for size, token in zip(self._found_sizes[own].tolist(), self._found_tokens[own].tolist(), strict=True):
                pair = (last[end - size][1], token)
                if pair not in fits:
                    fits[pair] = pair[0] < 0 or self.fits(*pair)
                if fits[pair]:
                    last.append((size, token))
                    break
            else:
                raise ValueError("a symbol that the vocabulary lacks")
        out, i = [], len(piece)
        while i:
            size, token = last[i]
            out.append(token)
            i -= size
        out.reverse()
        return out

    def encode_pieces(self, pieces: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in sorted order: all ids in a row, and how many each word has."""
        raw = [p.encode() for p in pieces]  # bytes sort as code points do
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        short, long_ = np.flatnonzero(lengths <= _LONG), np.flatnonzero(lengths > _LONG).tolist()
        flat, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for i in long_:
            ids = self._encode_long(raw[i])
            flat.append(np.array(ids, np.uint32))
            counts.append(np.array([len(ids)]))
        for first in range(0, len(short), _TOGETHER):
            ids, own = self._encode_together([raw[i] for i in short[first : first + _TOGETHER].tolist()])
            flat.append(ids)
            counts.append(own)
        held = np.concatenate(counts)
        starts, sizes = np.empty_like(lengths), np.empty_like(lengths)
        at = np.concatenate([np.array(long_, np.int64), short])
        starts[at], sizes[at] = np.cumsum(held) - held, held
        return np.concatenate(flat)[_spread(starts, sizes)], sizes

    def _is_odd(self, text: str) -> bool:
        """Whether a text has code points on which Python's tables and the library's may not agree."""
        return _MAYBE_ODD.search(text) is not None and self._odd.search(text) is not None

    @property
    def library(self):
        """The library's reading of the same file, of which the normaliser and the pre-tokens are asked."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._text)
        return self._library

    def pieces(self, word: str) -> list[str]:
        """The pre-tokens of a word: letters alone need no pattern."""
        if self._is_odd(word):
            return [word[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(word)]
        if word.isalpha():
            return [word]
        if word[-1] in ",.;:!?" and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self._pieces.findall(word)

    # -- texts -----------------------------------------------------------------------------------

    def _split(self, text: str) -> list[str]:
        """The words of a text between special tokens, which themselves get a space in front."""
        if not any(s in text for s in self.specials):
            return self._plain(text)
        words, at = [], 0
        for m in self._special.finditer(text):
            words += [*self._plain(text[at : m.start()]), " " + m[0]]
            at = m.end()
        return words + self._plain(text[at:])

    @staticmethod
    def normalised(text: str) -> str:
        """Composed and in lower case, character by character where a final sigma might depend on its place."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return "".join([c.lower() for c in text]) if "\u03a3" in text else text.lower()

    def _plain(self, text: str) -> list[str]:
        if self._is_odd(text):
            text = self.library.normalizer.normalize_str(text)
        else:
            text = self.normalised(text)
        return [w for w in _SPACES.split(text) if w] if _OTHER_SPACES.search(text) else text.split()

    def encoded(self, texts: Sequence[str]) -> Iterator[tuple[bytes, bytes]]:
        """For each text the ids as little-endian unsigned 32-bit integers, and the text that they decode to in UTF-8."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            if held and size + len(text) > _CHUNK:
                yield from self.words.encoded(held)
                held, size = [], 0
            held.append(self._split(text))
            size += len(text)
        if held:
            yield from self.words.encoded(held)

    def forget(self) -> None:
        """Drop the words."""
        self.words = _Words(self, self.words.limit)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.encoded([text]))[0], "<u4").tolist()

    def decode(self, ids: Sequence[int]) -> str:
        """The tokens' strings with a space between, as the vocabulary has no decoder of its own; unknown ids are skipped."""
        return " ".join([self.strings[i] for i in ids if i in self.strings])


class _Index(dict):
    """Words and their numbers; a word that is asked for and missing gets the next number."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class _Words:
    """Ids and decoded strings of words between white space, of at most about ``limit`` bytes.

    Special tokens, with a space in front, are words that are always there.
    """

    #: Bytes of an entry besides its characters.
    _ENTRY = 200

    def __init__(self, bpe: WordBpe, limit: int):
        self.bpe, self.limit = bpe, limit
        names = [f"{bpe.strings.get(i, '')} " for i in range(len(bpe.made))]
        #: the tokens' strings, each with a space behind
        self.names = pa.array(names, pa.large_binary())
        self.name_sizes = np.array([len(n.encode()) for n in names], np.int64)
        self.index = _Index((" " + s, k) for k, s in enumerate(bpe.specials))
        self.ids = np.array(list(bpe.specials.values()), np.uint32)
        self.counts = np.ones(len(self.ids), np.int64)
        self.used = np.zeros(len(self.ids), np.int64)
        self.decoded = self.names.take(pa.array(self.ids))

    def _add(self, words: list[str]) -> None:
        """Encode words that the table lacks."""
        bpe = self.bpe
        cut: list[str] = []
        until = [0]
        for word in words:
            cut += bpe.pieces(word)
            until.append(len(cut))
        pieces = sorted(set(cut))
        number = dict(zip(pieces, range(len(pieces)), strict=True))
        flat, held = bpe.encode_pieces(pieces)
        at = np.array([number[p] for p in cut], np.int64)
        ids = flat[_spread((np.cumsum(held) - held)[at], held[at])]
        # the ids of a word are those of its pieces
        id_until = np.concatenate([[0], np.cumsum(held[at])])[until]
        text_until = np.concatenate([[0], np.cumsum(self.name_sizes[ids])])[id_until]
        text = self.names.take(pa.array(ids))
        made = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(text_until.astype(np.int64)), text.buffers()[2]])
        self.decoded = pa.concat_arrays([self.decoded, made])
        self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, np.diff(id_until)])
        self.used = np.concatenate([self.used, np.zeros(len(words), np.int64)])

    def encoded(self, texts: list[list[str]]) -> Iterator[tuple[bytes, bytes]]:
        index, known = self.index, len(self.index)
        at = np.fromiter(map(index.__getitem__, chain.from_iterable(texts)), np.int64)
        if len(index) > known:
            self._add(list(islice(index, known, None)))
        held = self.counts[at]
        ids = self.ids[_spread((np.cumsum(self.counts) - self.counts)[at], held)].astype("<u4").tobytes()
        until = 4 * np.concatenate([[0], np.cumsum(held)])
        text = self.decoded.take(pa.array(at))
        ends, data = np.frombuffer(text.buffers()[1], np.int64, len(at) + 1), text.buffers()[2]
        low = 0
        for words in texts:
            high = low + len(words)
            # without the last space
            yield ids[until[low] : until[high]], data[ends[low] : ends[high] - 1].to_pybytes() if words else b""
            low = high
        self.used += np.bincount(at, minlength=len(self.used))
        if self._ENTRY * len(index) + self.decoded.nbytes > self.limit:
            self._shrink()

    def _shrink(self) -> None:
        """Keep the special tokens and what was used most, up to half the limit."""
        words, starts = list(self.index), np.cumsum(self.counts) - self.counts
        size = self._ENTRY + np.diff(np.frombuffer(self.decoded.buffers()[1], np.int64, len(words) + 1))
        fixed = len(self.bpe.specials)
        order = np.argsort(-self.used[fixed:], kind="stable") + fixed
        kept = np.concatenate([np.arange(fixed), np.sort(order[np.cumsum(size[order]) <= self.limit // 2])])
        self.ids, self.counts, self.used = self.ids[_spread(starts[kept], self.counts[kept])], self.counts[kept], self.used[kept] // 2
        self.index = _Index((words[i], k) for k, i in enumerate(kept.tolist()))
        self.decoded = self.decoded.take(pa.array(kept))


_LOADED: dict[str, WordBpe] = {}


def loaded(spec: str, odd: str) -> WordBpe:
    """The encoder for a vocabulary, made once in each worker."""
    if spec not in _LOADED:
        _LOADED.clear()
        _LOADED[spec] = WordBpe(spec, odd)
    return _LOADED[spec]


def _shared(spark: SparkSession, vocabulary: str) -> Broadcast[tuple[str, str]]:
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    return spark.sparkContext.broadcast((spec, odd_points(spec)))


def bpe_round_trip(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again: id, n_tokens, ids_sha256, decoded_sha256.

    ``vocabulary``: the path of the vocabulary's JSON file, read by the driver. A null text is the empty
    text, which has no tokens. Strings of special tokens in a text become those tokens. Null ids are
    kept; one row out per row in; an empty table gives an empty result; other columns are not read.
    """
    shared = _shared(docs.sparkSession, vocabulary)

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(*shared.value)
        for frame in frames:
            rows = [(len(ids) // 4, sha256(ids).hexdigest(), sha256(decoded).hexdigest()) for ids, decoded in bpe.encoded(frame["text"])]
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "id", frame["id"].array)
            yield out
        # workers live on after a task, next to those of other operators
        bpe.forget()
        release_memory()

    kind = dict(docs.dtypes)[id_col]
    return (
        docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
        .mapInPandas(made, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
        .withColumnRenamed("id", id_col)
    )


def bpe_encode(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids themselves: id and ids, an array of int. Nulls and the rest as in ``bpe_round_trip``."""
    shared = _shared(docs.sparkSession, vocabulary)

    def ids_of(texts: pd.Series) -> pd.Series:
        found = loaded(*shared.value).encoded(texts)
        return pd.Series([np.frombuffer(ids, "<u4").astype(np.int32) for ids, _ in found], dtype=object)

    return docs.select(F.col(id_col), F.pandas_udf(ids_of, "array<int>")(text_of(text_col)).alias("ids"))


def bpe_decode(encoded: DataFrame, vocabulary: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of id arrays: id and text. A null array gives null, an empty one the empty text."""
    shared = _shared(encoded.sparkSession, vocabulary)

    def text(ids: pd.Series) -> pd.Series:
        bpe = loaded(*shared.value)
        return pd.Series([None if x is None else bpe.decode(list(x)) for x in ids], dtype=object)

    return encoded.select(F.col(id_col), F.pandas_udf(text, "string")(F.col(ids_col)).alias("text"))
