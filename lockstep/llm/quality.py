"""Operator 3, quality classifier: a generalised additive model with pairwise interactions.

Features are computed from the whole text alone. Training bins each feature by quantiles of the sample and cycles over the
features: each step fits a tree of at most three leaves to the gradient sums of one feature's bins and adds it to that feature's lookup
table. Then the pairs whose quadrants explain most of what is left get small two-way tables in the same manner. A score is the
logistic of the intercept plus one table entry per feature and pair, added for a whole batch at once.

The sample is the ``max_rows`` labelled documents (20,000) of smallest hash of doc_id, so it is the same in any layout; scoring covers
every row. Defined results: a null text counts as empty and is scored; a null doc_id is never learned and not held out; null
labels are skipped; several labels of one document: the smallest counts; of several rows with one doc_id the one with the smallest
features is learned, all are scored; without labels of both kinds every score is the labels' mean (0.5 without any); columns named as a result are
replaced.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lockstep.llm.encoding import slices

FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "lower", "digit", "symbol", "point", "pipe", "other_bytes", "distinct_words",
    "top_word", "same_as_last", "distinct_lines", "log_lines", "line_words", "capital_words", "odd_word_ends", "distinct_pairs",
)
_CLASS = np.zeros(256, np.int64)  # 0 others, 1 upper, 2 lower, 3 digit, 4 symbol, 5 point, 6 pipe, 7 white space, 8 beyond ASCII
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#$%&*+<=>@^_`~\\/{}[]!", b".,;:?", b"|", b" \t\n\r\x0b\x0c"), 1):
    _CLASS[list(_set)] = _k
_CLASS[128:] = 8


def features(text: str) -> list[float]:
    """The features of one text, in the order of ``FEATURES``; each is finite, and 0 where there is nothing to count."""
    raw = text.encode("utf-8", "replace")
    kinds = np.bincount(_CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), 9)
    seen = max(1.0, len(raw) - kinds[7])
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n, m = max(1, len(words)), max(1, len(lines))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    letters = max(1.0, kinds[1] + kinds[2] + kinds[8])
    return [
        math.log1p(len(text)), math.log1p(len(words)), seen / n, kinds[1] / letters, kinds[2] / letters, kinds[3] / seen, kinds[4] / seen, kinds[5] / seen, kinds[6] / seen, kinds[8] / seen,
        len(counts) / n, max(counts.values(), default=0) / n, sum(map(operator.eq, words, islice(words, 1, None))) / n, len(set(lines)) / m, math.log1p(len(lines)), len(words) / m,
        sum(map(str.istitle, words)) / n, sum(not w[-1].isalnum() for w in words) / n, len(set(zip(words, islice(words, 1, None)))) / n,
    ]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; such rows are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class AdditiveModel:
    """Cut points, lookup tables per feature and per pair, and the intercept: a few kB whatever the corpus."""

    def __init__(self, cuts: list[np.ndarray], tables: list[np.ndarray], coarse: list[np.ndarray], pairs: list[tuple[int, int]], grids: list[np.ndarray], intercept: float):
        self.cuts, self.tables, self.coarse, self.pairs, self.grids, self.intercept = cuts, tables, coarse, pairs, grids, intercept

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, j], "right")]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _quantile_cuts(column: np.ndarray, bins: int) -> np.ndarray:
    found = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
    return found[found > column.min()] if len(column) else found


def _leaves(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The step of each bin under the tree of at most ``leaves`` leaves that splits best, greedily."""
    borders = [0, len(g)]
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + ridge)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(borders, borders[1:]):
            if b - a > 1:
                k = np.arange(a + 1, b)
                gain = worth(a, k) + worth(k, b) - worth(a, b)
                i = int(gain.argmax())
                best = max(best, (float(gain[i]), int(k[i])), key=lambda x: x[0])
        if best[1] is None:
            break
        borders = sorted([*borders, best[1]])
    step = np.empty(len(g))
    for a, b in zip(borders, borders[1:]):
        step[a:b] = (G[b] - G[a]) / (H[b] - H[a] + ridge)
    return step


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a grid into four quadrants: its gain, and the step of each cell."""
    G, H = (np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for a in (g, h))
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    a, b = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    parts = lambda S: (S[a, b], S[a, -1] - S[a, b], S[-1, b] - S[a, b], S[-1, -1] - S[a, -1] - S[-1, b] + S[a, b])
    gain = sum(x**2 / (y + ridge) for x, y in zip(parts(G), parts(H), strict=True)) - G[-1, -1] ** 2 / (H[-1, -1] + ridge)
    i = np.unravel_index(gain.argmax(), gain.shape)
    p, q = int(a[i]), int(b[i])
    step = np.empty(g.shape)
    for rows, cols in ((slice(p), slice(q)), (slice(p), slice(q, None)), (slice(p, None), slice(q)), (slice(p, None), slice(q, None))):
        step[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return float(gain[i]), step


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.1, pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 40, ridge: float = 5.0) -> AdditiveModel:
    """Cyclic boosting of the single features, then of the ``pairs`` most telling pairs, with logistic loss."""
    width = x.shape[1]
    mean = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    flat = AdditiveModel([np.empty(0)] * width, [np.zeros(1)] * width, [np.empty(0)] * width, [], [], math.log(mean / (1 - mean)))
    if len(np.unique(y)) < 2:
        return flat
    cuts, coarse = ([_quantile_cuts(x[:, j], k) for j in range(width)] for k in (bins, pair_bins))
    at = [np.searchsorted(cuts[j], x[:, j], "right") for j in range(width)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    total = np.full(len(y), flat.intercept)
    for _ in range(rounds):
        for j in range(width):
            p = 1 / (1 + np.exp(-total))
            g, h = (np.bincount(at[j], w, len(tables[j])) for w in (y - p, p * (1 - p)))
            step = rate * _leaves(g, h, 3, ridge)
            tables[j] += step
            total += step[at[j]]
    p = 1 / (1 + np.exp(-total))
    cell = [np.searchsorted(coarse[j], x[:, j], "right") for j in range(width)]
    size = [len(c) + 1 for c in coarse]

    def grid(i: int, j: int, p: np.ndarray) -> tuple[float, np.ndarray]:
        flat_at = cell[i] * size[j] + cell[j]
        return _quadrants(*(np.bincount(flat_at, w, size[i] * size[j]).reshape(size[i], size[j]) for w in (y - p, p * (1 - p))), ridge)

    ranked = sorted(((-grid(i, j, p)[0], i, j) for i in range(width) for j in range(i + 1, width)))[:pairs]
    chosen = [(i, j) for gain, i, j in ranked if gain < 0]
    grids = [np.zeros((size[i], size[j])) for i, j in chosen]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(chosen):
            step = rate * grid(i, j, 1 / (1 + np.exp(-total)))[1]
            grids[k] += step
            total += step[cell[i], cell[j]]
    return AdditiveModel(cuts, tables, coarse, chosen, grids, flat.intercept)


def _with_features(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = [features(t or "") for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    return df.select("doc_id", "quality", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, quality int, x array<double>")


def train(documents: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> AdditiveModel:
    """Learns ``quality`` from the documents that are not held out, at most ``max_rows`` of them."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = _with_features(texts).groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("r")).orderBy("doc_id").collect()
    x = np.array([r["r"]["x"] for r in rows], np.float64).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["r"]["quality"] for r in rows], np.float64))


def scored(df: DataFrame, model: AdditiveModel, keep: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """``keep`` (or all columns) of every row, with ``score`` and ``predicted``."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("score", "predicted", "_text")]
    shape = T.StructType([*(df.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                s = model.score(np.array([features(t or "") for t in batch.column("_text").to_pylist()]).reshape(-1, len(FEATURES)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return df.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(run, shape)
