import itertools
import random

import numpy as np
import pytest

from mediaquarry.llm.jaccard_join import Bands, cross_links, jaccard_components, linked, shingle_sets, sketch, sketch_keys


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i is not None and j is not None and a and b and linked(len(a), len(b), len(a & b), percent):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=str)


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_linked_sets_share_a_word(percent):
    r = random.Random(percent)
    pairs = 0
    for trial in range(120):
        n = r.choice([1, 2, 3, 5, 8, 13, 21, 40, 80, 147, 300, 700])
        base = np.unique(np.random.default_rng(trial).integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
        sets = [base]
        for _ in range(5):
            x = list(base)
            for _ in range(r.randint(0, max(1, len(x) * (100 - percent) // 100))):
                what = r.random()
                if what < 0.4 and len(x) > 1:
                    x.pop(r.randrange(len(x)))
                elif what < 0.7:
                    x.append(np.uint64(r.getrandbits(63)))
                else:
                    x[r.randrange(len(x))] = np.uint64(r.getrandbits(63))
            sets.append(np.unique(np.array(x, np.uint64)))
        keys, at = sketch_keys(sets, Bands(percent), chunk=1000)
        held = {}
        for k, d in zip(keys.tolist(), at.tolist(), strict=True):
            held.setdefault(k, set()).add(d)
        met = {p for s in held.values() for p in itertools.combinations(sorted(s), 2)}
        for i, j in itertools.combinations(range(len(sets)), 2):
            a, b = sets[i], sets[j]
            if linked(len(a), len(b), len(np.intersect1d(a, b)), percent):
                pairs += 1
                assert (i, j) in met
            words, _ = sketch([a, b], 64)
            assert (words[0] != words[1]).sum() <= len(a) + len(b) - 2 * len(np.intersect1d(a, b))
    assert pairs > 100


def copies(r, n, words=60):
    vocabulary = [f"w{i}" for i in range(400)]
    base = [r.choice(vocabulary) for _ in range(words)]
    out = []
    for _ in range(n):
        x = list(base)
        for _ in range(r.randint(0, 6)):
            x[r.randrange(len(x))] = r.choice(vocabulary)
        out.append(" ".join(x))
    return out


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_components_equal_brute_force(docs, hard, size, percent):
    r = random.Random(size)
    texts = [t for n in (40, 25, 8) for t in copies(r, n)] + [" ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 12))) for _ in range(40)]
    r.shuffle(texts)
    rows = hard + list(enumerate(texts, 100))
    got = jaccard_components(docs(rows).repartition(3), shingle=size, percent=percent, home_rows=10, block_shingles=300, owner_bytes=3000, piece_chars=2000)
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows, size, percent)


def test_cross_links_connect_all_that_are_linked():
    r = random.Random(9)
    sets = shingle_sets(copies(r, 60), 3)
    docs = np.arange(60)
    found = cross_links(docs, docs.copy(), sets, np.ones(60, bool), 70)
    want = [(i, j) for i, j in itertools.combinations(range(60), 2) if linked(len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j])), 70)]

    def parts(links):
        label = list(range(60))
        for _ in range(60):
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert parts(found) == parts(want)


def test_empty_table(docs):
    assert jaccard_components(docs([])).count() == 0
