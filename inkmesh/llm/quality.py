"""Operator 6, quality classifier: histogram gradient-boosted trees over statistics of whole texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh.llm.labelled import held_out, labelled_sample
from inkmesh.llm.text import give_back, id_and_text, in_slices, keep_where

STATISTICS = (
    "log_words", "log_chars", "word_length", "distinct_words", "top_word", "distinct_pairs", "same_as_last", "short_words", "longest_word",
    "upper", "lower", "digits", "symbols", "bars", "marks", "exclaims", "points", "spaces", "beyond_ascii", "log_lines", "repeated_lines", "words_a_line",
)

_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
_SYMBOLS, _MARKS, _POINTS, _SPACES, _BEYOND = b"#*$%&<>@^~=+_\\/", b",;:\"'()[]{}-", b".?", b" \t\n\r\x0b\x0c", bytes(range(128, 256))


def statistics(text: str) -> list[float]:
    """The statistics of one whole text, in the order of STATISTICS; of an empty text, zeros."""
    data, words, lines = text.encode("utf-8", "surrogatepass"), text.split(), [x for x in text.split("\n") if x]
    size, n = len(data) or 1, len(words) or 1

    def share(of: bytes) -> float:
        return (len(data) - len(data.translate(None, of))) / size

    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lengths = list(map(len, words))
    return [
        np.log1p(len(words)), np.log1p(len(text)), sum(lengths) / n, len(counts) / n, max(counts.values(), default=0) / n, pairs / max(1, n - 1),
        sum(map(str.__eq__, words, words[1:])) / n, sum(map((3).__gt__, lengths)) / n, max(lengths, default=0),
        share(_UPPER), share(_LOWER), share(_DIGITS), share(_SYMBOLS), share(b"|"), share(_MARKS), share(b"!"), share(_POINTS), share(_SPACES), share(_BEYOND),
        np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)),
    ]


@dataclass(frozen=True)
class Trees:
    """Boosted trees as flat arrays: a node goes left if its feature is at most its cut; a leaf points at itself."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int
    learned: int = 0  # labelled rows the trees were fitted on

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for the rows of x: all rows go down all trees at once, one level at a time."""
        z = np.full(len(x), self.bias)
        if len(self.roots) and len(x):
            at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
            rows = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            z += self.value[at].sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, least: float = 20, l2: float = 1.0) -> Trees:
    """Gradient boosting for log loss on histograms of `bins` quantile bins; a leaf keeps `least` rows or more."""
    n, m = x.shape if x.ndim == 2 else (0, len(STATISTICS))
    base = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    bias = float(np.log(base / (1 - base)))
    nodes: list[list[float]] = []  # feature, cut, left, right, value
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
        codes = np.stack([np.searchsorted(edges[j], x[:, j]) for j in range(m)], 1)
        flat = codes + bins * np.arange(m)
        z = np.full(n, bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            roots.append(len(nodes))
            work = [(np.arange(n), 0, len(nodes))]
            nodes.append([0, 0, 0, 0, 0])
            while work:
                rows, level, at = work.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                best = (1e-6, -1, 0)
                if level < depth and len(rows) >= 2 * least:
                    cells = flat[rows].ravel()
                    hist = [np.bincount(cells, np.repeat(k, m) if k is not None else None, bins * m).reshape(m, bins).cumsum(1)[:, :-1] for k in (g[rows], h[rows], None)]
                    gl, hl, cl = hist
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    gain[(cl < least) | (len(rows) - cl < least)] = -1
                    for j in range(m):
                        gain[j, len(edges[j]) :] = -1
                    j, k = np.unravel_index(int(np.argmax(gain)), gain.shape)
                    if gain[j, k] > best[0]:
                        best = (float(gain[j, k]), int(j), int(k))
                if best[1] < 0:
                    value = rate * gs / (hs + l2)
                    nodes[at] = [0, np.inf, at, at, value]
                    z[rows] += value
                    continue
                _, j, k = best
                goes = codes[rows, j] <= k
                a, b = len(nodes), len(nodes) + 1
                nodes += [[0, 0, 0, 0, 0], [0, 0, 0, 0, 0]]
                nodes[at] = [j, edges[j][k], a, b, 0]
                work += [(rows[goes], level + 1, a), (rows[~goes], level + 1, b)]
    t = np.array(nodes, float).reshape(-1, 5)
    return Trees(np.array(roots, np.int64), t[:, 0].astype(np.int64), t[:, 1], t[:, 2].astype(np.int64), t[:, 3].astype(np.int64), t[:, 4], bias, depth, n)


def _matrix(texts: Sequence[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), len(STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, most: int = 20_000) -> Trees:
    """Fit on at most `most` labelled documents (labels.quality), never on the held-out fold.

    Only the statistics of those documents reach the driver. Without labels, or with one class, the model is a constant.
    """

    def measure(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(c) for c in _matrix(texts).T)], ["doc_id", "label", *STATISTICS])

    sample = labelled_sample(docs, labels, "quality", folds, fold, most).select("doc_id", "text", "label")
    found: pd.DataFrame = sample.mapInArrow(in_slices(measure), "doc_id long, label int, " + ", ".join(f"{c} double" for c in STATISTICS)).toPandas().sort_values(["doc_id", *STATISTICS])
    fitted = fit_trees(found[list(STATISTICS)].to_numpy(float), found["label"].to_numpy(float))
    give_back()
    return fitted


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """documents -> doc_id, score. Null texts count as empty, whose statistics are zeros; repeated rows stay."""

    def run(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(_matrix(texts)))], ["doc_id", "score"])

    return id_and_text(docs).mapInArrow(in_slices(run), "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, threshold: float = 0.7, most: int = 20_000) -> DataFrame:
    """documents, labels -> doc_id, held_out, score, predicted (1 if score >= threshold). One row per row of documents."""
    scored = score(docs, fit(docs, labels, folds, fold, most))
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of documents, with all their columns, whose quality reaches the threshold; all rows if no label was learned.

    Null texts count as empty, whose statistics are zeros; each of repeated rows and of rows that tie is judged by its
    own text, null ids included. An empty table gives an empty table.
    """
    model = fit(docs, labels)
    return keep_where(docs, lambda texts: model.score(_matrix(texts)) >= threshold) if model.learned else docs
