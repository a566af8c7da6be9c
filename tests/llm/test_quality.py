import random

import numpy as np
import pytest

from mediaquarry.llm import quality


def test_additive_model_learns_bins_and_a_pair():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_additive(x, y, rounds=40, pair_rounds=80, n_pairs=2)
    assert (0, 1) in model.pairs
    fresh = rng.random((1000, 3))
    assert (((fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.5)) == (model.score(fresh) > 0.5)).mean() > 0.95


def test_scoring_is_the_sum_of_table_entries():
    rng = np.random.default_rng(2)
    x = rng.random((400, 4))
    model = quality.fit_additive(x, (x.sum(axis=1) > 2).astype(float), rounds=10, pair_rounds=5, n_pairs=3)
    bins = model.binned(x[:1])[0]
    total = model.intercept + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
    total += sum(t[bins[f], bins[g]] for (f, g), t in zip(model.pairs, model.pair_tables, strict=True))
    assert model.score(x[:1])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_few_labels():
    assert quality.fit_additive(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((1, 2)))[0] == 0.5
    assert quality.fit_additive(np.zeros((9, 2)), np.ones(9)).score(np.zeros((1, 2)))[0] > 0.8


def test_features_of_any_text(hard):
    for _, text in hard:
        found = quality.features(text)
        assert len(found) == len(quality.FEATURES) and np.isfinite(found).all()
    assert quality.features(None) == quality.features("")


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.score_quality(docs, quality.train(docs, labels)).where("held_out").join(labels, "doc_id").select("score", "quality").toPandas()
    good, bad = scored.score[scored.quality == 1], scored.score[scored.quality == 0]
    assert len(good) and len(bad)
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.9
    assert (good >= 0.3).mean() > 0.95 and (bad < 0.3).mean() > 0.6


def test_hard_cases_and_empty_tables(spark, docs, hard):
    r = random.Random(3)
    rows = hard + [(i, " ".join(r.choice(["good", "words", "here", "now"]) for _ in range(20)) if i % 2 else "### " * 20) for i in range(100, 160)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100, 160)] + [(100, None, None), (None, 1, 0), (101, 1, 0)], "doc_id long, quality int, toxic int")
    table = docs(rows)
    model = quality.train(table, labels)
    got = quality.score_quality(table, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.keep_quality(table, model).columns == table.columns
    assert quality.score_quality(docs([]), model).count() == 0
    untrained = quality.train(table, labels.limit(0))
    assert {r.score for r in quality.score_quality(table, untrained).collect()} == {0.5}


def plain_features(text):
    """The features by loops over characters and words."""
    import math
    import re

    data = (text or "").encode()
    words = [w for w in re.split(rb"[ \t-\r]+", data) if w]
    if not words:
        return [0.0] * len(quality.FEATURES)
    n, held = len(words), sum(len(w) for w in words)
    mean = held / n
    kinds = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]

    def share(characters, whole):
        return sum(data.count(bytes([c])) for c in characters) / whole

    return [
        math.log(1 + n), mean, math.sqrt(sum((len(w) - mean) ** 2 for w in words) / n), sum(len(w) <= 3 for w in words) / n, len(kinds) / n**0.9, max(kinds.values()) / n,
        sum(words[i] == words[i - 1] for i in range(1, n)) / n, sum(len(w) == 1 and not w.isalnum() for w in words) / n, share(b"#$%&*+/<=>@[\\]^_`{|}~", held), share(b"!?", held),
        share(b".", n), share(b",", n), share(b"0123456789", held), share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", held), sum(c >= 128 for c in data) / held,
        n / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), sum(b"A" <= w[1:2] <= b"Z" for w in words) / n,
    ]


def test_every_score_by_brute_force(spark, small, hard):
    """All texts of a table: features by loops, bins by counting edges, scores by adding table entries one by one."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.train(small, labels)
    assert model.tables and model.pairs
    texts = {r.doc_id: r.text for r in small.collect()}
    got = {r.doc_id: r for r in quality.score_quality(small, model).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        x = plain_features(text)
        assert quality.features(text) == pytest.approx(x, rel=1e-12, abs=1e-12)
        bins = [sum(v >= e for e in edges) for v, edges in zip(quality.features(text), model.edges, strict=True)]
        total = model.intercept + sum(t[b] for t, b in zip(model.tables, bins, strict=True)) + sum(t[bins[f]][bins[g]] for (f, g), t in zip(model.pairs, model.pair_tables, strict=True))
        score = 1 / (1 + np.exp(-total))
        assert got[i].score == pytest.approx(score) and got[i].predicted == int(got[i].score >= 0.3)
    for _, text in hard:
        assert quality.features(text) == pytest.approx(plain_features(text), rel=1e-9)
