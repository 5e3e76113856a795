"""Operator 7, language identification: unigrams over a fixed public vocabulary, all segmentations summed."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh.llm.labelled import held_out
from inkmesh.llm.lattice import PieceTable, code_points
from inkmesh.llm.packing import tokenizer_path
from inkmesh.llm.text import Generations, id_and_text, in_slices, no_cycles
from inkmesh.plans.staging import stage

VOCABULARY = "piece_bpe_32k.model"
#: Words up to so many letters are summed many at once; in longer ones probabilities are rescaled on the way.
SHORT = 24


@cache
def _word(last: int) -> re.Pattern[str]:
    """A letter, and the letters and combining marks behind it (Unicode categories L and M), of code points up to `last`."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(last + 1)]

    def ranges(of: str) -> str:
        out, c = [], 0
        for kind, run in groupby(kinds, lambda k: k in of):
            n = sum(1 for _ in run)
            if kind:
                out.append(f"\\U{c:08x}-\\U{c + n - 1:08x}")
            c += n
        return "".join(out)

    return re.compile(f"[{ranges('L')}][{ranges('LM')}]*")


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters and their marks, each whole, with the vocabulary's mark of a word's beginning."""
    text = text.lower()
    # Sets that end at U+FFFF are looked up in one step, wider ones range by range; wider characters take two UTF-16 units.
    narrow = len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
    return ["▁" + w for w in _word(0xFFFF if narrow else sys.maxunicode).findall(text)]


def letter_pieces(path: str) -> list[str]:
    """The vocabulary's lower-case pieces of letters and marks, with or without the mark of a word's beginning, in its order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return [p for p in pieces if p == p.lower() and (p == "▁" or all(unicodedata.category(c)[0] in "LM" for c in p.removeprefix("▁")) and p.removeprefix("▁"))]


@dataclass
class PieceModel:
    """log p(piece | language) as rows of probabilities; the row behind the last piece is that of an unknown letter."""

    langs: list[str]
    pieces: list[str]
    p: np.ndarray
    _table: PieceTable | None = field(default=None, repr=False)
    _words: Generations | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None, "_words": None}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    def lattice(self, words: list[str]) -> np.ndarray:
        """For words of one length n: piece numbers by word, end 1..n and piece length 1..K; absent ones point at a row of zeros."""
        if self._table is None:
            self._table = PieceTable(self.pieces)
        n, none, unknown, most = len(words[0]), len(self.pieces) + 1, len(self.pieces), min(self.longest, len(words[0]))
        rows = self._table.rows(code_points(words), most).reshape(-1, len(words), n + 1)
        ids = np.full((len(words), n, most), none, np.int32)
        for k in range(1, most + 1):
            found = rows[k, :, : n - k + 1]
            ids[:, k - 1 :, k - 1] = np.where(found >= 0, found, unknown if k == 1 else none)
        return ids

    def forward(self, ids: np.ndarray) -> np.ndarray:
        """alpha[word, end, language]: the sum over all segmentations of the first `end` letters."""
        m, n, most = ids.shape
        alpha = np.zeros((m, n + 1, self.p.shape[1]))
        alpha[:, 0] = 1
        for j in range(1, n + 1):
            k = min(j, most)
            alpha[:, j] = (alpha[:, j - k : j][:, ::-1] * self.p[ids[:, j - 1, :k]]).sum(1)
        return alpha

    def long_score(self, word: str) -> np.ndarray:
        """log p(word | language) of a word of any length: only the last places are kept, and rescaled as they shrink."""
        logs, step = np.zeros(len(self.langs)), 50_000
        window = np.zeros((self.longest, len(self.langs)))  # alpha of the last places, the latest first
        window[0] = 1
        for a in range(0, len(word), step):
            lead = min(a, self.longest - 1)  # pieces that end here may begin in the block before
            ids = self.lattice([word[a - lead : a + step]])[0, lead:]
            for row in ids:
                new = (window[: len(row)] * self.p[row]).sum(0)
                window[1:] = window[:-1]
                window[0] = new
                if new.min() < 1e-100:
                    top = np.maximum(window.max(0), 1e-300)
                    window /= top
                    logs += np.log(top)
        return logs + np.log(window[0])

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log p(word | language), a row each, all segmentations summed."""
        out = np.zeros((len(words), len(self.langs)))
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, at in by_length.items():
            if n > SHORT:
                for i in at:
                    out[i] = self.long_score(words[i])
                continue
            for k in range(0, len(at), 4000):
                some = at[k : k + 4000]
                p = self.forward(self.lattice([words[i] for i in some]))[:, -1]
                out[some] = np.log(np.maximum(p, 1e-300))
                for i in np.flatnonzero(p.min(1, initial=1) < 1e-290).tolist():
                    out[some[i]] = self.long_score(words[some[i]])
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its share among all; und and 0 for a text without letters."""
        if self._words is None:
            self._words = Generations(200_000)
        found = [words_of(t) for t in texts]
        new = self._words.missing(set().union(*found))
        if new:
            self._words.young.update(zip(new, self.word_scores(new)))
        get, langs, scores = self._words.young.__getitem__, [], []
        for words in found:
            if not words or not self.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            counts = Counter(words)
            z = np.fromiter(counts.values(), float, len(counts)) @ np.array(list(map(get, counts)))
            e = np.exp(z - z.max())
            k = int(z.argmax())
            langs.append(self.langs[k])
            scores.append(float(e[k] / e.sum()))
        return langs, scores


def _expected(model: PieceModel, words: list[str], lang: list[int], count: list[float]) -> np.ndarray:
    """Expected piece counts by language: forward times backward over each word's segmentations."""
    total = np.zeros_like(model.p)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, at in by_length.items():
        for b in range(0, len(at), 4000):
            some = at[b : b + 4000]
            ids = model.lattice([words[i] for i in some])
            l, c = np.array([lang[i] for i in some]), np.array([count[i] for i in some])
            p = model.p[ids, l[:, None, None]]  # word, end, length
            alpha, beta = np.zeros((len(some), n + 1)), np.zeros((len(some), n + 1))
            alpha[:, 0] = beta[:, n] = 1
            for j in range(1, n + 1):
                k = min(j, ids.shape[2])
                alpha[:, j] = (alpha[:, j - k : j][:, ::-1] * p[:, j - 1, :k]).sum(1)
            for j in range(n, 0, -1):
                for k in range(1, min(j, ids.shape[2]) + 1):
                    beta[:, j - k] += p[:, j - 1, k - 1] * beta[:, j]
            z = np.maximum(alpha[:, n], 1e-300)
            for j in range(1, n + 1):
                k = min(j, ids.shape[2])
                e = alpha[:, j - k : j][:, ::-1] * p[:, j - 1, :k] * (c * beta[:, j] / z)[:, None]
                np.add.at(total, (ids[:, j - 1, :k], l[:, None]), e)
    return total


def _probabilities(counts: np.ndarray, floor: float) -> np.ndarray:
    """Counts by piece and language, the unknown letter's row last but one, to probabilities; the last row is no piece."""
    c = counts.copy()
    c[:-1] += floor
    c[-1] = 0
    return c / c.sum(0)


def fit(docs: DataFrame, path: str | None = None, folds: int = 3, fold: int = 1, most: int = 1500, rounds: int = 2) -> PieceModel:
    """Fit on about `most` (1500) documents of each language outside the held-out fold, chosen by hash of doc_id.

    Every non-null value of lang is learned; their names and numbers of documents reach the driver, a row a language.
    Words are counted in Spark; every round of expectation and maximisation runs over the counted words in Spark and
    returns one number a piece and language, whatever the size of the corpus. For counting alone, words of over SHORT
    letters are learned in parts of SHORT.
    """
    pieces = letter_pieces(path or tokenizer_path(VOCABULARY))
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    taught = taught.where(~held_out(F.col("doc_id"), folds, fold))
    sizes = taught.groupBy("lang").count()
    langs = sorted(r["lang"] for r in sizes.select("lang").collect())
    if not langs:
        return PieceModel([], pieces, np.zeros((len(pieces) + 2, 0)))
    number = {x: k for k, x in enumerate(langs)}
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(most) / F.col("count") * F.lit(1 << 30)

    def count(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        found: dict[str, Counter] = {}
        for x, t in zip(part.column(1).to_pylist(), texts):
            found.setdefault(x, Counter()).update(w[k : k + SHORT] for w in words_of(t) for k in range(0, len(w), SHORT))
        rows = [(number[x], w, float(n)) for x, c in found.items() for w, n in c.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.float64()))], ["l", "w", "n"])

    counted = taught.join(sizes, "lang").where(chosen).select("doc_id", "lang", "text").mapInArrow(in_slices(count), "l int, w string, n double")
    counted = stage(counted.groupBy("l", "w").agg(F.sum("n").alias("n")), "words")
    p = _probabilities(np.ones((len(pieces) + 2, len(langs))), 1.0)
    for _ in range(rounds):
        model = PieceModel(langs, pieces, p)

        def expect(batches: Iterator[pa.RecordBatch], model: PieceModel = model) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                e = _expected(model, b.column(1).to_pylist(), b.column(0).to_pylist(), b.column(2).to_pylist())
                total = e if total is None else total + e
            if total is not None:
                i, l = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(l, pa.int32()), pa.array(total[i, l])], ["i", "l", "e"])

        sums = counted.mapInArrow(expect, "i int, l int, e double").groupBy("i", "l").agg(F.sum("e").alias("e")).toPandas()
        total = np.zeros_like(p)
        total[sums["i"], sums["l"]] = sums["e"]
        p = _probabilities(total, 0.01)
    return PieceModel(langs, pieces, p)


def languages(docs: DataFrame, path: str | None = None, folds: int = 3, fold: int = 1, **settings: int) -> DataFrame:
    """documents -> doc_id, held_out, lang_pred, score: the likeliest learned language of each whole text.

    und and 0 if text is null or has no letter, or no language was learned. Ties go to the first language by name;
    repeated rows stay.
    """
    model = fit(docs, path, folds, fold, **settings)

    def run(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        with no_cycles():
            langs, scores = model.predict(texts)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    found = id_and_text(docs).mapInArrow(in_slices(run), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "lang_pred", "score")
