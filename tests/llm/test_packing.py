import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from mediaquarry.llm.packing import Placement, Plan, byte_bpe, fillings, pack_documents, repeats

VOCABULARY, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(VOCABULARY)
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def own():
    with open(VOCABULARY, encoding="utf-8") as f, open(RANKS, "rb") as g:
        return byte_bpe(f.read(), g.read(), public_tokenizers.PATTERN)


def same(own, library, texts):
    for text, got, want in zip(texts, own.encoded(pa.array(texts)), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids, repr(text)


def test_ids_of_random_texts(own, library):
    r = random.Random(5)
    letters = [chr(c) for c in [*range(0x20, 0x7F), *range(0x9, 0xE), *range(0x1C, 0x20), 0x85, 0xA0, 0x180E, 0x200B, 0x2028, 0x3000, 0xFEFF, 0x301, 0x3A3, 0x1F600, 0xAC00, 0x660, 0, 0x7F, *range(0xA1, 0x250), 0x558, 0x1C89, 0xA7CB, 0x16EA0]]
    words = [" ", "  ", "\n", " \n", "don't", "we'll", "<|endoftext|>", "hello", "é", "x" * 300, "12345"]
    for _ in range(30):
        same(own, library, ["".join(r.choice(words) if r.random() < 0.4 else r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(60)])


def test_every_latin_character_next_to_every_kind(own, library):
    same(own, library, [a + chr(c) + b for c in range(0x250) for a in ("", "a", "1", " ", "!", "a ", "'") for b in ("", "b", "2", " x", "?", "\n c")])


def test_ids_of_a_file_of_texts(own, library, spark):
    same(own, library, [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()])


def test_the_table_of_units_stays_bounded_and_right(library):
    with open(VOCABULARY, encoding="utf-8") as f:
        small = byte_bpe(f.read())
    small.limit = 60_000
    r = random.Random(6)
    for _ in range(6):
        same(small, library, [" ".join("".join(r.choice("etaoin") for _ in range(r.randint(1, 7))) for _ in range(300)) for _ in range(4)])
    assert len(small.index) == len(small.counts) == len(small.used) == len(small.edges) < 1500


def test_fillings_are_all_combinations():
    lengths = [1, 2, 3, 5, 6, 8]
    want = {(0, a, b) for a in lengths for b in lengths if a <= b and a + b == 9} | {(a, b, c) for a in lengths for b in lengths for c in lengths if a <= b <= c and a + b + c == 9}
    assert {tuple(x) for x in fillings(np.array(lengths), 9).tolist()} == want
    assert {tuple(x) for x in fillings(np.array(lengths), 9, depth=2).tolist()} == {x for x in want if not x[0]}


def test_least_squares_meets_what_can_be_met():
    found = fillings(np.arange(1, 32), 32)
    r = np.random.default_rng(1)
    known = np.where(r.random(len(found)) < 0.2, r.integers(1, 50, len(found)), 0).astype(float)
    histogram = sum(np.bincount(found[:, i], known, 32) for i in range(3))
    histogram[0] = 0
    x = repeats(found, histogram, 3000)
    used = sum(np.bincount(found[:, i], x, 32) for i in range(3))
    used[0] = 0
    assert (x >= 0).all() and np.abs(used - histogram).max() < 0.02 * histogram.max()


def expand(plan, histogram, window):
    """All pieces of a plan, by looking every rest up; checks that they fill their sequences and rests without gaps."""
    places = Placement(plan)
    length = np.repeat(np.arange(window), histogram)
    number = np.concatenate([np.arange(n) for n in histogram]) if len(length) else length
    rest, rows = places.find(length, number)
    inside, sequences = defaultdict(list), defaultdict(list)
    for k, row in zip(rest.tolist(), rows.tolist(), strict=True):
        inside[k].append((row[3], row[4]))
        sequences[row[5] + int(number[k]) - row[1]].append((row[6], row[4]))
    for pieces, total in [*((inside[k], int(length[k])) for k in range(len(length))), *((own, None) for own in sequences.values())]:
        at = 0
        for start, n in sorted(pieces):
            assert start == at and n > 0
            at += n
        assert total in (None, at)
    assert sorted(sequences) == list(range(plan.sequences))
    return Counter(sum(n for _, n in own) for own in sequences.values()), len(rest)


@pytest.mark.parametrize("histogram", [{}, {1: 1}, {60: 500}, {33: 1, 40: 2}, {1: 1000}, {63: 7, 1: 3, 2: 2}, {32: 9, 16: 2, 8: 1}, {i: (i * 37) % 23 for i in range(1, 64)}])
def test_plans_fill_windows(histogram):
    counts = [histogram.get(i, 0) for i in range(64)]
    fills, pieces = expand(Plan(counts, 64), counts, 64)
    tokens = sum(i * n for i, n in enumerate(counts))
    assert fills[64] == tokens // 64
    # what is left has powers of two
    assert sorted(k for k in fills if k < 64) == [1 << i for i in range(6) if tokens % 64 >> i & 1]


def test_most_rests_stay_whole():
    r = np.random.default_rng(2)
    counts = np.bincount(r.integers(1, 256, 20_000), minlength=256)
    fills, pieces = expand(Plan(counts, 256), counts, 256)
    assert pieces < 1.05 * counts.sum()


def test_tables(docs, hard, library, small):
    rows = hard + [(r.doc_id + 1000, r.text) for r in small.collect()]
    ids = defaultdict(list)
    for i, text in rows:
        ids[i].append([*library.encode(text or "", add_special_tokens=False).ids, 0])
    found = pack_documents(docs(rows), VOCABULARY, ranks=RANKS, pattern=public_tokenizers.PATTERN).collect()
    sequences = defaultdict(list)
    pieces = Counter()
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
        # the piece is a part of a text of its id
        assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        pieces[r.doc_id, r.doc_tokens, "tokens"] += r.length
    for i, texts in ids.items():
        for n, k in Counter(len(x) for x in texts).items():
            assert pieces[i, n, "tokens"] == n * k
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    assert sum(sum(n for _, n in own) not in (1 << b for b in range(11)) for own in sequences.values()) == 0
    assert pack_documents(docs([]), VOCABULARY).count() == 0


def test_the_library_alone_gives_the_same(docs):
    rows = [(i, "one two  three\n " * i) for i in range(40)]
    quick = pack_documents(docs(rows), VOCABULARY, ranks=RANKS, pattern=public_tokenizers.PATTERN, window=64)
    assert sorted(map(tuple, quick.collect())) == sorted(map(tuple, pack_documents(docs(rows), VOCABULARY, window=64).collect()))
