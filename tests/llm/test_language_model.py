import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from mediaquarry.llm.language_model import GRID, Automaton, Block, fitted, score_language_model, tokens_of

END = b""


class Formula:
    """The probabilities by their definition, over whole counts; a context starts with None at the start of a text."""

    def __init__(self, texts, m2, m3):
        self.m2, self.m3, self.texts = m2, m3, len(texts)
        self.c1 = Counter(w for t in texts for w in t)
        self.c2 = Counter(p for t in texts for p in zip([None, *t], t, strict=False))
        self.c3 = Counter(p for t in texts for p in zip([None, *t], t, t[1:], strict=False))
        self.n, self.v = sum(self.c1.values()), len(self.c1)

    def p1(self, w):
        return (self.c1[w] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def p2(self, w, b):
        c = self.texts if b is None else self.c1[b]
        return (self.c2[b, w] + self.m2 * self.p1(w)) / (c + self.m2)

    def p3(self, w, a, b):
        return (self.c3[a, b, w] + self.m3 * self.p2(w, b)) / (self.c2[a, b] + self.m3)

    def score(self, t):
        return sum(math.log10(self.p2(w, None) if i == 0 else self.p3(w, t[i - 2] if i > 1 else None, t[i - 1])) for i, w in enumerate(t))


def brute(rows, m2, m3):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    texts = [[*tokens_of(t), END] for _, t in rows]
    f = Formula([t for t, h in zip(texts, held, strict=True) if not h], m2, m3)
    return sorted(
        [
            (i, h, len(t), sum(f.c1[w] > 0 for w in t), f.n, round(sum(math.log10(f.p1(w)) for w in t), 6), round(f.score(t), 6))
            for (i, _), t, h in zip(rows, texts, held, strict=True)
        ],
        key=str,
    )


def got(table, **settings):
    found = score_language_model(table, **settings).collect()
    return sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found], key=str)


def random_rows(n):
    r = random.Random(5)
    return [(i, " ".join(f"W{min(r.randint(0, 16), r.randint(0, 16))}" for _ in range(i % 13))) for i in range(50, 50 + n)]


@pytest.mark.parametrize("block_tokens, owner_keys", [(40, 50), (1_000_000, 1_500_000), (60, 100), (60, 3)])
def test_equals_the_formula_over_everything(docs, hard, block_tokens, owner_keys):
    rows = hard[:-3] + hard[-1:] + random_rows(90)
    found = got(docs(rows), smoothing=(3.0, 1.5), block_tokens=block_tokens, owner_keys=owner_keys)
    assert found == brute(rows, 3.0, 1.5)


def automaton(texts, every, m2, m3):
    """The automaton over one block that holds the texts of ``every``, and the formula, both with the counts of ``texts``."""
    f = Formula(texts, m2, m3)
    words = list(dict.fromkeys([END, *(w for t in every for w in t)]))
    number = {w: i for i, w in enumerate(words)}
    block = Block(words, np.array([number[w] for t in every for w in t]), np.array([len(t) for t in every]), np.ones(len(every), bool))
    block.find_ngrams()
    spelled = [*words, None]
    pairs = [(spelled[k // block.base], spelled[k % block.base]) for k in block.pairs.tolist()]
    triples = [(*pairs[k // block.base], spelled[k % block.base]) for k in block.triples.tolist()]
    counts = (np.array([c[x] for x in of], np.int64) for c, of in ((f.c1, words), (f.c2, pairs), (f.c3, triples)))
    return Automaton(block, *counts, f.texts, f.n, f.v, m2, m3), f


TEXTS = [[b"a", b"b", b"a", b"b", END], [b"b", b"b", b"c", END], [b"a", b"b", b"c", END], [END]]


def test_probabilities_after_any_state_sum_to_one():
    words = [b"a", b"b", b"c", b"unseen"]
    heads = [[], *([a] for a in words), *([a, b] for a in words for b in words)]
    every = [[*h, w] for h in heads for w in [*words, END]]
    model, _ = automaton(TEXTS, [*every, *heads[1:]], 1.5, 0.7)
    found = dict(zip(map(tuple, [*every, *heads[1:]]), model.scores(), strict=True)) | {(): 0.0}
    for head in heads:
        assert sum(10 ** found[*head, w] for w in [*words, END]) == pytest.approx(10 ** found[tuple(head)])


def test_walks_side_by_side_and_alone_agree_with_the_formula():
    r = random.Random(8)
    every = TEXTS + [[r.choice([b"a", b"b", b"c", b"d", b"e"]) for _ in range(r.randint(0, 40))] + [END] for _ in range(40)]
    model, f = automaton(every[:30], every, 2.0, 0.5)
    ends = np.cumsum(model.block.lengths).tolist()
    assert model.scores() == pytest.approx([f.score(t) for t in every])
    assert [model.walk(e - len(t), e, model.start, 0.0) for t, e in zip(every, ends, strict=True)] == pytest.approx([f.score(t) for t in every])
    places, states = np.arange(len(every[5])), []
    state, total = np.array([model.start]), np.zeros(1)
    for p in places + ends[4]:
        total, state = model.step(np.array([p]), state, total)
        states.append(int(state[0]))
    assert max(states) >= model.first_pair > min(states)


def test_fitted_smoothing():
    counts = np.array([1, 2, 50, 1000])
    mass = (counts * GRID[:, None] / (counts + GRID[:, None])).sum(axis=1)
    m = fitted(mass, 40)
    assert sum(c * m / (c + m) for c in counts) == pytest.approx(40, rel=0.05)
    assert fitted(mass, 0) == GRID[0] and fitted(np.zeros(len(GRID)), 3) == GRID[0]


def test_long_texts_and_empty_tables(docs, hard):
    found = {r.doc_id: r.n_tokens for r in score_language_model(docs(hard)).collect()}
    assert found[6] == 30_001 and found[7] == 2 and found[2] == 1
    assert score_language_model(docs([])).count() == 0
    alone = score_language_model(docs([(1, "a b")]), held_out_fold=zlib.crc32(b"1") % 5).first()
    assert alone.train_tokens == 0 and alone.n_known == 0 and math.isfinite(alone.score)


def test_context_helps_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = score_language_model(docs).where("held_out").toPandas()
    tokens = found.n_tokens.sum()
    assert found.base_score.sum() / tokens < -4.0
    assert found.score.sum() / tokens > -3.5
