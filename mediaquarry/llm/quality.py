"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits, feature by feature, a shallow tree to the current residuals and adds it to that
feature's lookup table over bins; afterwards the pairs of features with the most left to explain get
two-dimensional tables the same way. A text is scored by looking its features up in the tables and
adding the entries.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaquarry.llm.common import crc_fold, release_memory, text_of

FEATURES = (
    "log_words", "word_bytes", "word_bytes_spread", "short_words", "distinct_words", "top_word", "repeats",
    "alone_symbols", "symbols", "marks", "full_stops", "commas", "digits", "capitals", "non_ascii",
    "words_a_line", "distinct_lines", "capitals_in_words",
)

_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~", np.uint8))
_MARKS = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))


def features(text: str | None) -> list[float]:
    """The features of a whole text; those of the empty text are zero."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    held = int(lengths.sum())
    common = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    capitals = int(counts[65:91].sum())
    return [
        float(np.log1p(n)),
        held / n,
        float(lengths.std()),
        float((lengths <= 3).mean()),
        len(common) / n**0.9,
        max(common.values()) / n,
        sum(map(eq, words, words[1:])) / n,
        sum(c for w, c in common.items() if len(w) == 1 and not w.isalnum()) / n,
        float(counts[_SYMBOLS].sum()) / held,
        float(counts[_MARKS].sum()) / held,
        float(counts[46]) / n,
        float(counts[44]) / n,
        float(counts[48:58].sum()) / held,
        capitals / held,
        float(counts[128:].sum()) / held,
        n / max(1, len(lines)),
        len(set(lines)) / max(1, len(lines)),
        sum(c for w, c in common.items() if w[1:2].isupper()) / n,
    ]


@dataclass
class AdditiveModel:
    """Bin edges for each feature, a table for each feature and one for each chosen pair; tables hold log odds."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.intercept)
        if self.edges and len(x):
            b = self.binned(x)
            for f, table in enumerate(self.tables):
                total += table[b[:, f]]
            for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[b[:, f], b[:, g]]
        return 1 / (1 + np.exp(-total))


def _leaf(g: np.ndarray | float, h: np.ndarray | float, ridge: float):
    return g / (h + ridge)


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The step function over bins, of at most ``leaves`` steps, that lowers the loss most."""
    cuts = [0, len(g)]
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def worth(a, b):
        return (G[b] - G[a]) ** 2 / (H[b] - H[a] + ridge)

    while len(cuts) <= leaves:
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                i = int(gain.argmax())
                best = max(best, (float(gain[i]), int(at[i])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = _leaf(G[b] - G[a], H[b] - H[a], ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best cut of each feature, crossed: four leaves over a grid of bins, and its gain."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    n, m = g.shape
    if n < 2 or m < 2:
        return np.zeros_like(g), 0.0
    a, b = np.ogrid[: n - 1, : m - 1]
    quarters = []
    for s in (G, H):
        q11 = s[a, b]
        q12 = s[a, m - 1] - q11
        q21 = s[n - 1, b] - q11
        quarters.append([q11, q12, q21, s[-1, -1] - q11 - q12 - q21])
    gain = sum(x * x / (y + ridge) for x, y in zip(*quarters, strict=True)) - G[-1, -1] ** 2 / (H[-1, -1] + ridge)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    for (rows, cols), x, y in zip(
        [(slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, m)), (slice(i + 1, n), slice(0, j + 1)), (slice(i + 1, n), slice(j + 1, m))],
        *quarters,
        strict=True,
    ):
        out[rows, cols] = _leaf(x[i, j], y[i, j], ridge)
    return out, float(gain[i, j])


def fit_additive(
    x: np.ndarray,
    y: np.ndarray,
    *,
    bins: int = 48,
    rounds: int = 250,
    pair_rounds: int = 80,
    n_pairs: int = 8,
    leaves: int = 3,
    rate: float = 0.08,
    ridge: float = 2.0,
) -> AdditiveModel:
    """Fit on rows ``x`` with labels ``y`` (0 or 1). Without rows the model says 0.5 always; with one class, near that class."""
    model = AdditiveModel()
    if not len(y):
        return model
    p = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(p / (1 - p)))
    if y.min() == y.max():
        return model
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        middles = (values[1:] + values[:-1]) / 2
        if len(middles) >= bins:
            middles = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]))
        model.edges.append(middles)
        model.tables.append(np.zeros(len(middles) + 1))
    b = model.binned(x)
    total = np.full(len(y), model.intercept)

    def residuals():
        q = 1 / (1 + np.exp(-total))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            g, h = residuals()
            step = rate * _shallow_tree(np.bincount(b[:, f], g, len(table)), np.bincount(b[:, f], h, len(table)), leaves, ridge)
            table += step
            total += step[b[:, f]]

    def grids(f, g_at, grad, hess):
        shape = (len(model.tables[f]), len(model.tables[g_at]))
        cell = b[:, f] * shape[1] + b[:, g_at]
        return np.bincount(cell, grad, shape[0] * shape[1]).reshape(shape), np.bincount(cell, hess, shape[0] * shape[1]).reshape(shape)

    g, h = residuals()
    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: (-_pair_tree(*grids(*p, g, h), ridge)[1], p))
    model.pairs = ranked[:n_pairs]
    model.pair_tables = [np.zeros((len(model.tables[f]), len(model.tables[g]))) for f, g in model.pairs]
    for _ in range(pair_rounds):
        for (f, g_at), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = residuals()
            step = rate * _pair_tree(*grids(f, g_at, g, h), ridge)[0]
            table += step
            total += step[b[:, f], b[:, g_at]]
    return model


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    held_out_fold: int = 0,
    sample_rows: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> AdditiveModel:
    """Fit on at most ``sample_rows`` labelled rows, the first by a hash of their id, outside the held-out fold.

    Rows with a null label or id are left out; of several labels of one id the majority counts (ties: 1).
    """
    rows = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & (crc_fold(F.col("id")) != held_out_fold))
        .groupBy("id")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "label": frame["label"], "x": [features(t) for t in frame["text"]]})

    found = (
        texts.join(F.broadcast(rows), "id")
        .select("id", "label", "text")
        .mapInPandas(made, "id long, label int, x array<double>")
        .orderBy(F.xxhash64("id"), "id", "x")
        .limit(sample_rows)
        .toPandas()
    )
    x = np.array(found["x"].tolist(), dtype=np.float64).reshape(len(found), len(FEATURES))
    return fit_additive(x, found["label"].to_numpy(np.float64))


def score_quality(
    docs: DataFrame,
    model: AdditiveModel,
    *,
    threshold: float = 0.3,
    held_out_fold: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Score every whole text: id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    A null text is the empty text, which is scored like others. Null ids are kept and count as held out or
    not by the crc32 of the empty text. One row out per row in; an empty table gives an empty result;
    other columns are not read.
    """

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array([features(t) for t in frame["text"]], dtype=np.float64).reshape(len(frame), len(FEATURES))
            s = model.score(x)
            yield pd.DataFrame({"id": frame["id"].array, "held_out": frame["held_out"].array, "score": s, "predicted": (s >= threshold).astype(np.int32)})
        release_memory()

    kind = dict(docs.dtypes)[id_col]
    return (
        docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), (crc_fold(F.col(id_col)) == held_out_fold).alias("held_out"))
        .mapInPandas(scored, f"id {kind}, held_out boolean, score double, predicted int")
        .withColumnRenamed("id", id_col)
    )


def keep_quality(docs: DataFrame, model: AdditiveModel, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows whose text scores at least ``threshold``, with all their columns."""

    def kept(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            x = np.array([features(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))
            yield pd.Series(model.score(x) >= threshold)
        release_memory()

    return docs.where(F.pandas_udf(kept, "boolean")(text_of(text_col)))
