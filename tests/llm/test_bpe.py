import hashlib
import random
import struct

import pytest

from mediaquarry.llm.bpe import WordBpe, bpe_decode, bpe_encode, bpe_round_trip
from mediaquarry.llm.queries import vocabulary_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary_path())
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def own():
    with open(vocabulary_path(), encoding="utf-8") as f:
        return WordBpe(f.read(), cache_bytes=200_000)


def same(own, library, texts):
    found = library.encode_batch(texts, add_special_tokens=False)
    for text, want, (ids, decoded) in zip(texts, found, own.encoded(texts), strict=True):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want.ids, repr(text)
        assert decoded.decode() == library.decode(want.ids, skip_special_tokens=False) == own.decode(want.ids)


def test_random_texts(own, library):
    r = random.Random(2)
    alphabet = [chr(c) for c in [*range(0x20, 0x7F), *range(0x9, 0xE), *range(0x1C, 0x20), 0x85, 0xA0, 0x2028, 0x3000, 0x301, 0x3A3, 0x130, 0xDF, 0x1F600, 0xAC00, 0x1100, 0x1161, 0x660, 0, 0x7F, *range(0xC0, 0x250)]]
    words = ["hello", "don't", "we'll", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|"]
    for _ in range(30):
        same(own, library, ["".join(r.choice(words) if r.random() < 0.05 else r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(60)])


def test_every_code_point_alone_and_between_others(own, library):
    # every one of the planes that have characters, every sixteenth of the others
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x33480 or 0xE0000 <= c < 0xE0200 or c % 16 == 0)]
    for plane in range(0, len(points), 1 << 16):
        own_plane = points[plane : plane + (1 << 16)]
        same(own, library, ["".join(f"a{c}b {c} 1{c}2 !{c}A{c}\u0307 " for c in own_plane[i : i + 64]) for i in range(0, len(own_plane), 64)])


def test_mixtures_of_any_code_points(own, library):
    r = random.Random(9)
    known = [chr(c) for c in range(0x3000)]
    for _ in range(20):
        same(own, library, ["".join(chr(c) if not 0xD800 <= (c := r.choice([r.randrange(0x3000), r.randrange(0x20000), r.randrange(0x110000)])) < 0xE000 else r.choice(known) for _ in range(r.randint(0, 40))) for _ in range(60)])


def test_words_of_few_letters(own, library):
    r = random.Random(3)
    for _ in range(20):
        same(own, library, ["".join(r.choice("aabceinnttssoorh") for _ in range(r.randint(0, 120))) for _ in range(150)])


def test_long_texts(own, library):
    same(own, library, ["a" * 50_000, "", "ab" * 20_000, "word " * 20_000, "\U0001f600" * 5000, "!" * 9999])


def test_words_of_all_lengths_round_the_bound_of_long_ones(own, library):
    same(own, library, [" ".join(c * n for n in range(55, 75)) for c in ("a", "th", "é")])


def test_the_table_stays_bounded_and_right(own, library):
    r = random.Random(4)
    for _ in range(5):
        same(own, library, [" ".join("".join(r.choice("etaoin") for _ in range(r.randint(1, 9))) for _ in range(400)) for _ in range(5)])
    assert len(own.words.index) == len(own.words.counts) == len(own.words.decoded) < 1500
    same(own, library, ["<|endoftext|> a <|startoftext|>b"])


def test_a_file_of_texts(own, library, spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    same(own, library, texts)


def test_tables(docs, hard, library, small):
    rows = hard + [(r.doc_id, r.text) for r in small.collect()]
    got = {}
    for r in bpe_round_trip(docs(rows), vocabulary_path()).collect():
        got.setdefault(r.doc_id, set()).add((r.n_tokens, r.ids_sha256, r.decoded_sha256))
    want = {}
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.setdefault(i, set()).add((len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == want
    assert bpe_round_trip(docs([]), vocabulary_path()).count() == 0


def test_ids_and_back(docs):
    back = bpe_decode(bpe_encode(docs([(1, "Hello world"), (2, None)]), vocabulary_path()), vocabulary_path())
    assert {r.doc_id: r.text for r in back.collect()} == {1: "hello</w> world</w>", 2: ""}
