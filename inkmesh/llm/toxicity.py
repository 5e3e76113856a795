"""Operator 8, toxicity: a sparse logistic model of word presence, regularised by counterfactual identity swaps."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh.llm.labelled import SKETCH, copies, held_out, labelled_sample, sketch
from inkmesh.llm.near_copies import shingle_hashes
from inkmesh.llm.text import give_back, id_and_text, in_slices, keep_where
from inkmesh.plans.staging import stage

# Words that name groups of people; a word may be swapped for any other of its line.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("woman", "man", "girl", "boy", "frau", "mann", "femme", "homme", "mujer", "hombre"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("black", "white", "asian", "latino", "arab", "african", "european", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "migrants", "citizens", "natives"),
    ("deaf", "blind", "disabled", "autistic", "old", "young", "elderly"),
)

_WORD = re.compile(r"[^\W_]+")
STEMS = (4, 5, 6, 7)


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features_of(words: set[str]) -> list[str]:
    """The words, and their stems: `abcd*` where a longer word begins with abcd, `abcd**` where two or more do.

    Inflected languages spread one insult over many word forms; what the forms share is how they begin.
    """
    stems = Counter(w[:k] for w in words for k in STEMS if len(w) > k)
    return [*words, *(s + "*" for s in stems), *(s + "**" for s, n in stems.items() if n > 1)]


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of words and stems (all others weigh nothing) and a bias."""

    weights: dict[str, float]
    bias: float

    @cached_property
    def _parts(self) -> tuple[dict[str, float], dict[int, dict[str, tuple[float, float]]]]:
        words = {w: v for w, v in self.weights.items() if not w.endswith("*")}
        stems: dict[int, dict[str, tuple[float, float]]] = {}
        for s in {w.rstrip("*") for w in self.weights if w.endswith("*")}:
            stems.setdefault(len(s), {})[s] = (self.weights.get(s + "*", 0.0), self.weights.get(s + "**", 0.0))
        return words, stems

    def logit(self, text: str) -> float:
        words, (known, stems) = words_of(text), self._parts
        hits = [known[w] for w in words & known.keys()]
        for k, of in stems.items():
            for s in {w[:k] for w in words} & of.keys():
                forms = sum(len(w) > k and w.startswith(s) for w in words)
                hits += [of[s][0] * (forms > 0), of[s][1] * (forms > 1)]
        return self.bias + math.fsum(hits)

    def score(self, texts: Sequence[str]) -> np.ndarray:
        z = np.array([self.logit(t) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def swap_counts(rows: list[np.ndarray], weight: np.ndarray, groups: list[list[int]]) -> list[tuple[int, int, float]]:
    """(a, b, w): over labelled texts that hold a but not b, both of one group, the weight of those whose a becomes b."""
    group_of = {a: g for g in groups for a in g}
    found: dict[tuple[int, int], float] = {}
    for row, w in zip(rows, weight):
        have = set(row.tolist())
        for a in have & group_of.keys():
            for b in group_of[a]:
                if b not in have:
                    found[a, b] = found.get((a, b), 0.0) + w
    return [(a, b, w) for (a, b), w in found.items()]


def swapped_features(words: set[str], groups: Sequence[Sequence[str]]) -> Iterator[tuple[list[str], list[str]]]:
    """For each swap of a word for another of its group that the text does not hold: the features that come and that go."""
    own = [(a, b) for g in groups for a in g if a in words for b in g if b not in words]
    if not own:
        return
    forms = Counter(w[:k] for w in words for k in STEMS if len(w) > k)
    for a, b in dict.fromkeys(own):
        after = Counter({s: forms[s] for w in (a, b) for s in (w[:k] for k in STEMS)})
        before = dict(after)
        after.subtract(a[:k] for k in STEMS if len(a) > k)
        after.update(b[:k] for k in STEMS if len(b) > k)
        come = [s + m for s in before for m, n in (("*", 1), ("**", 2)) if before[s] < n <= after[s]]
        go = [s + m for s in before for m, n in (("*", 1), ("**", 2)) if after[s] < n <= before[s]]
        yield [b, *come], [a, *go]


def balanced(label: np.ndarray, weight: np.ndarray, power: float = 1.0) -> np.ndarray:
    """The weights, those of label 1 times (weight of label 0 / weight of label 1)^power; as they are where one class is missing."""
    pos, neg = float((weight * label).sum()), float((weight * (1 - label)).sum())
    return np.where(label == 1, weight * (neg / pos) ** power, weight) if pos > 0 and neg > 0 else weight


def fit_weights(rows: list[np.ndarray], label: np.ndarray, weight: np.ndarray, n_words: int, groups: list[list[int]], l1: float = 2e-4, swap: float = 1.0, rounds: int = 300, swaps: list[tuple[Sequence[int], float]] | None = None) -> tuple[np.ndarray, float]:
    """Minimise mean weighted log loss + l1 |w| + swap * mean over swapped texts of (score change)^2, by FISTA.

    A score is linear in the features, so a swap changes it by the weights of those that come less those that go: the
    penalty is a quadratic form over the swaps of the labelled texts, and its pull grows with how often those occur.
    swaps holds (feature numbers, weight), k + 1 for a feature k that comes and -k - 1 for one that goes; without it,
    the words of groups are swapped one for one.
    """
    n = len(rows)
    ends = np.cumsum([0, *map(len, rows)])
    cuts = [0, *(int(np.searchsorted(ends, k, "right")) - 1 for k in range(1_000_000, int(ends[-1]), 1_000_000)), n]
    blocks = [(a, b, np.concatenate([*rows[a:b], np.zeros(0, np.int32)]).astype(np.int32), np.repeat(np.arange(b - a, dtype=np.int32), np.diff(ends[a : b + 1]))) for a, b in zip(cuts, cuts[1:])]
    v = weight / weight.sum()
    if swaps is None:
        swaps = [((-a - 1, b + 1), w) for a, b, w in swap_counts(rows, v, groups)]
    signed = np.array([k for ks, _ in swaps for k in ks], np.int64)
    at, dcol, sign = np.repeat(np.arange(len(swaps)), [len(ks) for ks, _ in swaps]), np.abs(signed) - 1, np.sign(signed).astype(float)
    pw = np.array([w for _, w in swaps], float)
    pw = swap * pw / pw.sum() if len(swaps) else pw
    base = float(np.clip((v * label).sum(), 1e-4, 1 - 1e-4))
    w, bias = np.zeros(n_words), float(np.log(base / (1 - base)))

    def loss_and_grad(w: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        z = bias + np.concatenate([np.bincount(row, w[col], b - a) for a, b, col, row in blocks])  # a block of texts at a time
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        e = v * (p - label)
        d = np.bincount(at, sign * w[dcol], len(pw))
        g = sum(np.bincount(col, e[a:b][row], n_words) for a, b, col, row in blocks) + np.bincount(dcol, (2 * pw * d)[at] * sign, n_words)
        return float((v * (np.logaddexp(0, z) - label * z)).sum() + (pw * d * d).sum()), g, float(e.sum())

    step, y, yb, t = 1.0, w.copy(), bias, 1.0
    for _ in range(rounds):
        f, g, gb = loss_and_grad(y, yb)
        while True:  # backtracking on the step
            w2 = y - step * g
            w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * l1, 0)
            b2 = yb - step * gb
            f2 = loss_and_grad(w2, b2)[0]
            dw, db = w2 - y, b2 - yb
            if f2 <= f + g @ dw + gb * db + (dw @ dw + db * db) / (2 * step) + 1e-12 or step < 1e-8:
                break
            step /= 2
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, yb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - bias)
        w, bias, t, step = w2, b2, t2, step * 1.25
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, most: int = 20_000, vocabulary: int = 3000, least: int = 8, identity: Sequence[Sequence[str]] = IDENTITY_TERMS, swap: float = 1.0, balance: float = 1.0, l1: float = 1e-4) -> ToxicityModel:
    """Fit on at most `most` labelled documents (labels.toxic), never on the held-out fold.

    Words and stems are chosen in Spark: of those in `least` (8) texts or more, the `vocabulary` (3000) with the largest
    difference in frequency between the classes, in standard errors; identity terms join them always. Near copies
    of one label, by wide sketches of the sample (see copies), share the weight of one text. With balance 1 both classes
    weigh the same together, with 0 as many as they are, between them by the power. Swaps are counted in Spark, each with
    all the features it changes. Without labels the model scores 0.5 everywhere short of the threshold; with one class only, it
    scores that class's rate.
    """

    def sketched(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([sketch(shingle_hashes(t, 5)).tobytes() for t in texts], pa.binary())], ["doc_id", "label", "sketch"])

    def count(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        found: dict[str, list[float]] = {}
        for t, label, v in zip(texts, part.column(1).to_pylist(), part.column(2).to_pylist()):
            for w in features_of(words_of(t)):
                c = found.setdefault(w, [0, 0.0, 0.0])
                c[0] += 1
                c[1] += v
                c[2] += v * label
        df, n, pos = zip(*found.values()) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(df, pa.int64()), pa.array(n, pa.float64()), pa.array(pos, pa.float64())], ["word", "df", "n", "pos"])

    sample = stage(labelled_sample(docs, labels, "toxic", folds, fold, most), "labelled")
    drawn: pd.DataFrame = sample.select("doc_id", "text", "label").mapInArrow(in_slices(sketched), "doc_id long, label int, sketch binary").toPandas().sort_values("doc_id")
    sketches = np.frombuffer(b"".join(drawn["sketch"]), np.uint32).reshape(len(drawn), SKETCH)
    shares = pd.DataFrame({"doc_id": drawn["doc_id"].to_numpy(np.int64), "v": 1.0 / copies(sketches, drawn["label"].to_numpy())})
    weights = docs.sparkSession.createDataFrame(shares, "doc_id long, v double")  # a row for each of the sample, which `most` bounds
    weighted = stage(sample.join(F.broadcast(weights), "doc_id").select("doc_id", "label", "v", "text"), "toxicity")
    total = weighted.agg(F.sum("v").alias("n"), F.sum(F.col("v") * F.col("label")).alias("pos")).first()
    if not total["n"]:
        return ToxicityModel({}, 0.0)
    base = total["pos"] / total["n"]
    each = weighted.select("text", "label", "v").mapInArrow(in_slices(count), "word string, df long, n double, pos double").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("df", "n", "pos")])
    gap = F.abs(F.col("pos") - base * F.col("n")) / F.sqrt(F.col("n") * (base * (1 - base)) + 1e-9)
    terms = [t for g in identity for t in g]
    best = [r["word"] for r in each.where(F.col("df") >= least).orderBy(gap.desc(), "word").limit(vocabulary).select("word").collect()]
    index = {w: k for k, w in enumerate(dict.fromkeys([*best, *terms]))}

    def select(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        hits = [sorted(index[w] for w in features_of(words_of(t)) if w in index) for t in texts]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(hits, pa.list_(pa.int32()))], ["doc_id", "label", "v", "hits"])

    def change(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        sums: Counter[tuple[int, ...]] = Counter()
        for t, v in zip(texts, part.column(1).to_pylist()):
            for come, go in swapped_features(words_of(t), identity):
                sums[tuple(sorted([index[x] + 1 for x in come if x in index] + [-index[x] - 1 for x in go if x in index]))] += v
        return pa.RecordBatch.from_arrays([pa.array([list(k) for k in sums], pa.list_(pa.int32())), pa.array(list(sums.values()), pa.float64())], ["change", "v"])

    found: pd.DataFrame = weighted.select("doc_id", "label", "v", "text").mapInArrow(in_slices(select), "doc_id long, label int, v double, hits array<int>").toPandas().sort_values("doc_id")
    rows = [np.asarray(x, np.int32) for x in found.pop("hits")]
    changes: pd.DataFrame = weighted.select("text", "v").mapInArrow(in_slices(change), "change array<int>, v double").groupBy("change").agg(F.sum("v").alias("v")).orderBy("change").toPandas()
    swaps = [(list(map(int, k)), v) for k, v in zip(changes["change"], changes["v"])]
    label = found["label"].to_numpy(float)
    w, bias = fit_weights(rows, label, balanced(label, found["v"].to_numpy(float), balance), len(index), [], l1=l1, swap=swap, swaps=swaps)
    give_back()
    return ToxicityModel({t: float(w[k]) for t, k in index.items() if w[k]}, bias)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """documents -> doc_id, score (0 to 1). Null and empty texts score the model's bias; repeated rows stay."""

    def run(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(texts))], ["doc_id", "score"])

    return id_and_text(docs).mapInArrow(in_slices(run), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, threshold: float = 0.7, **settings: object) -> DataFrame:
    """documents, labels -> doc_id, held_out, score, predicted (1 if score >= threshold). One row per row of documents."""
    scored = score(docs, fit(docs, labels, folds, fold, **settings))
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of documents, with all their columns, whose toxicity is below the threshold.

    Null and empty texts score the model's bias, so without labels all rows stay; each of repeated rows and of rows that
    tie is judged by its own text, null ids included. An empty table gives an empty table.
    """
    model = fit(docs, labels)
    return keep_where(docs, lambda texts: model.score(texts) < threshold)
