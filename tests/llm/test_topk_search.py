import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaquarry.llm.topk_search import scores, topk_search

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in usable:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(w) == len(v))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def run(spark, rows, **options):
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], KIND).withColumns({c: F.lit(1) for c in ("id", "v", "q", "n", "rank", "score")})
    return sorted(tuple(r) for r in topk_search(table, F.col("vec_id") % 50 == 0, **options).collect())


@pytest.mark.parametrize("options", [{}, {"bins": 3, "query_block": 2}, {"k": 1}, {"k": 1000}])
def test_brute_force(spark, options):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(-100, 150)]
    assert run(spark, rows, **options) == brute(rows, options.get("k", 5))


def test_ties_go_to_smaller_ids_however_many(spark):
    rows = [(i, [1.0, 0.5]) for i in range(300, -1, -1)]
    assert run(spark, rows) == brute(rows, 5)


def test_unusable_vectors_and_lengths(spark):
    rows = [(0, [1.0, 2.0]), (50, None), (100, [1.0, None]), (150, [float("nan"), 1.0]), (200, []), (250, [1.0]), (1, [0.5, 0.5]), (2, [float("inf"), 0.0]), (3, []), (None, [1.0, 1.0]), (4, [3.0, 3.0]), (4, [3.0, 3.0])]
    assert run(spark, rows) == brute(rows, 5)


def test_large_components_stay_exact(spark):
    rows = [(i, [1e6 + i, -1e6]) for i in range(60)]
    assert run(spark, rows) == brute(rows, 5)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []


def test_every_usable_row_of_a_repeated_query_asks(spark):
    nan = float("nan")
    asks = [(0, [3.0, 1.0]), (0, [nan, 9.0]), (0, [1.0, 3.0]), (50, [nan, nan]), (50, [1.0, -1.0]), (100, [2.0, 2.0]), (100, [2.0, 2.0])]
    rows = asks + [(i, [math.cos(i), math.sin(i)]) for i in range(1, 40)]
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if all(map(math.isfinite, v))]
    want = []
    for q in (0, 50, 100):
        pairs = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for j, v in usable if j == q for i, w in usable if i != q)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(pairs[:5], 1)]
    assert run(spark, rows) == want
    assert run(spark, rows, bins=3, query_block=2) == want


def test_scores_that_do_not_fit_are_an_error():
    with pytest.raises(OverflowError):
        scores(np.array([[1e18, 1.0]]), np.array([[100.0, 1.0]]))
    assert scores(np.array([[1e9, 1.0]]), np.array([[2e9, 1.0]])).tolist() == [[2 * 10**18 + 1]]
