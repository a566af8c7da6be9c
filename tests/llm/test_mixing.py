import numpy as np
import pytest

from mediaquarry.llm import mixing


def test_targets():
    assert mixing.fill_targets([100, 10, 50], [3, 1, 2], 1.5, 2) == [132.0, 20.0, 88.0]
    assert mixing.fill_targets([], [], 1.5, 2) == []
    assert mixing.fill_targets([0, 0], [3, 1], 1.5, 2) == [0.0, 0.0]
    assert mixing.fill_targets([5, 5], [1, 1], 2, 2) == [10.0, 10.0]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutations(n):
    a, b = (mixing.permuted(np.arange(n), n, key) for key in (5, 6))
    assert sorted(a.tolist()) == list(range(n))
    assert n < 10 or a.tolist() != b.tolist()


def test_draws_are_multinomial_given_the_totals():
    totals = np.array([500, 0, 300, 205])
    draws = [list(mixing.shard_draws(totals, 10, 0, 1000, seed)) for seed in range(200)]
    for shards in draws:
        assert sorted(x[0] for x in shards) == list(range(101))
        before = np.zeros(4, np.int64)
        for number, own, counts, first in sorted(shards, key=lambda x: x[0]):
            assert (before[own] == first).all() and counts.sum() == (10 if number < 100 else 5)
            before[own] += counts
        assert (before == totals).all()
    # a shard's draw of the first source: mean and variance of the hypergeometric distribution
    firsts = [next((int(n) for o, n in zip(own, counts, strict=True) if o == 0), 0) for shards in draws for number, own, counts, _ in shards if number in (7, 40)]
    p = 500 / 1005
    assert abs(np.mean(firsts) - 10 * p) < 0.3
    assert np.var(firsts) == pytest.approx(10 * p * (1 - p) * 995 / 1004, rel=0.25)
    some = {x[0]: x[2].tolist() for x in mixing.shard_draws(totals, 10, 16, 24, 3)}
    assert some == {x[0]: x[2].tolist() for x in draws[3] if 16 <= x[0] < 24}


def test_draws_beyond_the_bound_of_the_exact_one():
    totals = np.array([3 * 10**9, 10, 10**9])
    counts = mixing.split_draw(totals, 2 * 10**9, (1,))
    assert counts.sum() == 2 * 10**9 and (counts <= totals).all() and abs(counts[0] - 1.5e9) < 1e6
    tight = mixing.split_draw(totals, int(totals.sum()) - 1, (1,))
    assert tight.sum() == totals.sum() - 1 and (tight <= totals).all()


def test_whole_slots():
    assert mixing.whole_slots(np.array([1.2, 2.7, 0.1]), np.array([9, 9, 9])).tolist() == [1, 3, 0]
    assert mixing.whole_slots(np.array([1.5, 1.5]), np.array([1, 9])).tolist() == [1, 2]


def rows_of(n):
    return [(i, " ".join(f"w{i}.{j}" for j in range(20 + i % 90)), ["a", "b", "é", None, "Z"][i % 5 if i % 3 else 0]) for i in range(n)]


def test_mix_meets_targets_and_caps(docs):
    rows = rows_of(600)
    got = mixing.mix_sources(docs(rows), block_words=8, shard_slots=64, chunk_rows=50).collect()
    assert len(got) == len(rows) and {r.doc_id: r.size for r in got} == {i: len(t.split()) for i, t, _ in rows}
    by = {}
    source = {i: s for i, _, s in rows}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(source[r.doc_id], []).append(r)
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    want = mixing.fill_targets([sum(r.size for r in by[s]) for s in order], [3, 1, 2, 3, 1], 1.5, 2)
    for s, t in zip(order, want, strict=True):
        assert all(r.target == pytest.approx(t) for r in by[s]) and {r.source_size for r in by[s]} == {sum(r.size for r in by[s])}
        assert sum(r.taken for r in by[s]) == pytest.approx(t, rel=0.01, abs=16)
    again = mixing.mix_sources(docs(rows).repartition(7), block_words=8, shard_slots=64, chunk_rows=50).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in got}


def brute(spark, rows, block_words, shard_slots, chunk_rows, seed=1):
    """``taken`` of every row by lists: streams, blocks, shards in turn, and permutations of slots."""
    sizes = [(k, i, len((t or "").split()), s) for k, (i, t, s) in enumerate(rows)]
    chunks = max(1, -(-len(rows) // chunk_rows))
    table = spark.createDataFrame([(k, i, n) for k, i, n, _ in sizes], "k int, id long, size long")
    chunk = {r.k: r.c for r in table.selectExpr("k", f"pmod(xxhash64(id, size), {chunks}) as c").collect()}
    order = sorted({s for *_, s in sizes if s is not None}, key=lambda s: s.encode()) + [None] * any(s is None for *_, s in sizes)
    held = [sum(n for _, _, n, x in sizes if x == s) for s in order]
    targets = mixing.fill_targets(held, [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5, 2)
    blocks = [-(-n // block_words) for n in held]
    totals = mixing.whole_slots(np.array([t * b / n if n else 0 for t, b, n in zip(targets, blocks, held, strict=True)]), np.array([2 * b for b in blocks]))
    uses = [[0] * b for b in blocks]
    used = [0] * len(order)
    for _, own, counts, _ in sorted(mixing.shard_draws(totals, shard_slots, 0, 10**9, seed), key=lambda x: x[0]):
        for src, n in zip(own.tolist(), counts.tolist(), strict=True):
            for slot in range(used[src], used[src] + n):
                turn, at = divmod(slot, blocks[src])
                uses[src][int(mixing.permuted(np.array([at]), blocks[src], (seed << 40) ^ (src << 8) ^ turn)[0])] += 1
            used[src] += n
    taken = {}
    for src, s in enumerate(order):
        place = 0
        for k, _, n, _ in sorted((x for x in sizes if x[3] == s), key=lambda x: (chunk[x[0]], x[1] is not None, x[1] or 0, x[2])):
            taken[k] = sum(uses[src][(place + j) // block_words] for j in range(n))
            place += n
    return [(i, n, taken[k]) for k, i, n, _ in sizes]


def test_taken_by_brute_force(spark, docs):
    rows = [(None if i % 50 == 9 else i, " ".join("w" * (1 + (i * i) % 37)) if i % 11 else None, ["a", "b", "é", None, "Z"][i % 5 if i % 3 else 0]) for i in range(400)]
    settings = {"block_words": 4, "shard_slots": 32, "chunk_rows": 30}
    got = [(r.doc_id, r.size, r.taken) for r in mixing.mix_sources(docs(rows), **settings).collect()]
    assert sorted(got, key=str) == sorted(brute(spark, rows, **settings), key=str)


def test_documents_without_a_count(docs):
    table = docs(rows_of(30)).drop("n_chars")
    assert mixing.mix_documents(table).columns == table.columns
    assert mixing.mix_documents(table, count_col=None).count() > 0


def test_hard_cases_and_empty_table(docs, hard):
    got = mixing.mix_sources(docs(hard)).collect()
    assert len(got) == len(hard) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert {r.taken for r in got if r.size == 0} == {0}
    assert mixing.mix_sources(docs([])).count() == 0
    assert mixing.mix_sources(docs([(1, None), (2, "  ")])).count() == 2
    assert mixing.mix_documents(docs([])).count() == 0


def test_mixed_documents_hold_the_words_that_were_taken(docs):
    rows = rows_of(200)
    table = docs(rows)
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(table, block_words=8).collect()}
    mixed = mixing.mix_documents(table, block_words=8)
    assert mixed.columns == table.columns
    words = {}
    texts = {i: t for i, t, _ in rows}
    for r in mixed.collect():
        own = texts[r.doc_id].split()
        assert r.n_chars == len(r.text) and r.text.split() == [w for w in own if w in set(r.text.split())]
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {i: n for i, n in taken.items() if n}


def test_rows_of_equal_id_and_size_keep_their_own_blocks(docs):
    rows = [(None if i % 2 else 7, " ".join(f"w{i}.{j}" for j in range(40)), "ab"[i // 60]) for i in range(120)]
    table = docs(rows)
    taken = [r.taken for r in mixing.mix_sources(table, weights=(1, 1), share=0.5, block_words=8).collect()]
    words = {}
    for r in mixing.mix_documents(table, weights=(1, 1), share=0.5, block_words=8).collect():
        own = r.text.split()
        assert len({w.split(".")[0] for w in own}) == 1
        words[own[0].split(".")[0]] = words.get(own[0].split(".")[0], 0) + len(own)
    assert sorted(words.values()) == sorted(n for n in taken if n)
    assert len(set(taken)) > 1
