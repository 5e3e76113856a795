"""Operator 3, best-fit packing: token counts, pieces, and best-fit decreasing with a segment tree over capacities."""

from __future__ import annotations

import math
import re
import zlib
from functools import cache, cached_property
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh.llm.text import Generations, id_and_text, in_slices, no_cycles
from inkmesh.plans.staging import stage

WORD_VOCABULARY = "word_bpe_49k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"

#: Where text is cut into words when str.split() would cut at more than the tokenizer's white space.
_SPLIT = re.compile(r"[ \t\n\r]+")
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")

# The tokenizer's own classes of characters, for code points up to U+00FF, and their lower case.
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_LOWER = np.frombuffer(bytes(range(256)).decode("latin-1").lower().encode("latin-1"), np.uint8)
_KIND = np.full(256, _OTHER, np.uint8)
for _kind, _some in ((_SPACE, "\t\n\v\f\r \x85\xa0"), (_NUMBER, "0123456789²³¹¼½¾"), (_LETTER, [chr(c) for c in range(256) if chr(c).isalpha()])):
    _KIND[[ord(c) for c in _some]] = _kind


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is on this machine; every function here also takes a path of the caller's."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if visible, else the next from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in seen} | {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in seen)}


def _latin(text: str) -> bytes | None:
    """The text, a byte a letter, if it has only code points up to U+00FF and no mark of a special token."""
    if "<|" in text:
        return None
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


def cut_parts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, cuts, first): lower-cased letters of all texts, where their parts and white space begin, and each text's first cut.

    Part k is letters[cuts[k] : cuts[k + 1]], one of the tokenizer's pattern
    's|'t|'re|'ve|'m|'ll|'d|[letters]+|[number]|[other]+, or a run of white space. No part lies in two texts.
    """
    begin = np.cumsum([0, *map(len, texts)])
    n = int(begin[-1])
    low = _LOWER[np.frombuffer(b"".join([*texts, b"\0\0\0"]), np.uint8)]
    kind = _KIND[low]
    edge = np.zeros(n + 3, bool)  # between two texts
    edge[begin] = True
    cut = edge.copy()
    cut[1:n] |= (kind[1:n] != kind[: n - 1]) | (kind[1:n] == _NUMBER)
    # an apostrophe that is no part of a longer run takes the letters of a contraction from the run behind it
    q = np.flatnonzero(low[:n] == ord("'"))
    q = q[cut[q] & (kind[q + 1] == _LETTER) & ~edge[q + 1]]
    a, b = low[q + 1], low[q + 2]
    one, two = np.isin(a, list(b"stmd")), ((b == ord("e")) & np.isin(a, list(b"rv")) | (a == ord("l")) & (b == ord("l"))) & ~edge[q + 2]
    cut[q[one | two] + 1] = False
    cut[q[one] + 2] = True
    cut[q[two] + 3] = True
    cuts = np.flatnonzero(cut[: n + 1])
    return low[:n], cuts, np.searchsorted(cuts, begin)


def _values(array: pa.LargeBinaryArray, at: np.ndarray | slice = slice(None)) -> list[bytes]:
    """Values of a new array without nulls; with numbers `at`, in order, what lies between each and the next. (to_pylist makes a scalar a value.)"""
    _, offsets, data = array.buffers()
    places, whole = np.frombuffer(offsets, np.int64)[: len(array) + 1][at].tolist(), (data or pa.py_buffer(b"")).to_pybytes()
    return [whole[a:b] for a, b in zip(places, places[1:])]


class WordEncoder:
    """ids of whole texts, as little-endian unsigned 32-bit bytes, by way of a cache of their parts.

    No token crosses a part of the tokenizer's pattern. Text of code points up to U+00FF is lower-cased and cut into
    parts here, all texts at once, exactly as the tokenizer does it for them; each distinct part is looked up once, and
    only parts that are new go through the merges, many in one call: the last token of each part ends in the
    vocabulary's word-end mark. Words (white space, which the tokenizer drops, lies around them) with other code points
    or a special token's mark go through the whole tokenizer, and only those: their text is taken apart around them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self.merges = path, Tokenizer.from_file(path)
        self.merges.normalizer, self.merges.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        vocabulary = self.merges.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.letters = _byte_letters()
        self.words, self.parts = Generations(), Generations(200_000, 6_000_000)

    @cached_property
    def whole(self):
        """The tokenizer as it is, some 25 MB that only words of other code points need."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _written(self, part: bytes) -> str:
        text = part.decode("latin-1")
        return text if part.isalnum() else text.encode("utf-8").decode("latin-1").translate(self.letters)

    def _learn(self, parts: list[bytes]) -> None:
        found, new = self.parts.young, []
        for p in parts:
            if _KIND[p[0]] == _SPACE:
                found[p] = b""
            else:
                new.append(p)
        for k in range(0, len(new), 2000):
            some = new[k : k + 2000]
            ids = np.array(self.merges.encode(" ".join(map(self._written, some)), add_special_tokens=False).ids, "<u4")
            at = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
            data = ids.tobytes()
            found.update((p, data[4 * a : 4 * b]) for p, a, b in zip(some, at, at[1:]))

    def _learn_words(self, words: list[str]) -> None:
        for w, e in zip(words, self.whole.encode_batch(words, add_special_tokens=False)):
            self.words.young[w] = np.array(e.ids, "<u4").tobytes()

    def _by_parts(self, texts: list[bytes]) -> list[bytes]:
        if not any(texts):
            return [b""] * len(texts)
        letters, cuts, first = cut_parts(texts)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(letters)]).dictionary_encode()
        names = _values(parts.dictionary)
        new = self.parts.missing(set(names))
        if new:
            self._learn(new)
        ids = pa.array(map(self.parts.young.__getitem__, names), pa.large_binary()).take(parts.indices)
        return _values(ids, first)

    def encode(self, texts: list[str]) -> list[bytes]:
        with no_cycles():
            return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[bytes]:
        plain: list[bytes] = []
        other: set[str] = set()
        plans: list[list[str | None]] = []  # of each text, in order: None for what is next of `plain`, or a word of `other`
        for t in texts:
            whole = _latin(t)
            if whole is not None:
                plain.append(whole)
                plans.append([None])
                continue
            plan: list[str | None] = []
            for ours, words in groupby(_SPLIT.split(t) if any(c in t for c in _ODD) else t.split(), lambda w: "<|" not in w and (w.isascii() or max(w) <= "\xff")):
                if ours:
                    plain.append(" ".join(words).encode("latin-1"))
                    plan.append(None)
                else:
                    plan += words
            other.update(w for w in plan if w is not None)
            plans.append(plan)
        new = self.words.missing(other)
        if new:
            self._learn_words(new)
        ids, get = iter(self._by_parts(plain)), self.words.young.__getitem__
        return [b"".join([next(ids) if w is None else get(w) for w in plan]) for plan in plans]


@cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def token_pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """documents -> one row per piece: doc_id, piece, start, length, ids_crc32.

    A document is its tokens and then end_id; a null or empty text is end_id alone. Only a document of more than `size`
    tokens is cut, into pieces of `size`, the last as long as what is left.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        out: list[tuple] = []
        for doc, data in zip(part.column(0).to_pylist(), _encoder(path).encode(texts)):
            data += end
            n = len(data) // 4
            out += [(doc, k, s, min(size, n - s), zlib.crc32(data[4 * s : 4 * (s + size)])) for k, s in enumerate(range(0, n, size))]
        doc, piece, start, length, crc = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs).mapInArrow(in_slices(run, most=1_000_000), PIECES)


class Capacities:
    """A segment tree over remaining capacities 0..size: leaf c counts the open bins with c left.

    tightest(need) walks from the root to the smallest c >= need that has a bin, in O(log size).
    """

    def __init__(self, size: int):
        self.n = 1 << size.bit_length()
        self.count = [0] * (2 * self.n)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def push(self, left: int, bin_: int) -> None:
        self.bins[left].append(bin_)
        i = left + self.n
        while i:
            self.count[i] += 1
            i >>= 1

    def pop(self, left: int) -> int:
        i = left + self.n
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.bins[left].pop()

    def tightest(self, need: int) -> int:
        """The smallest capacity >= need with an open bin, or -1."""
        i, count = need + self.n, self.count
        if count[i]:
            return need
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.n
            i >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length and the number of bins. Longest first, ties in the given order; every length is 1..size."""
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    tree = Capacities(size)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        left = tree.tightest(need) if need < size else -1
        if left < 0:
            b, left, used = used, size, used + 1
        else:
            b = tree.pop(left)
        bins[i], offsets[i] = b, size - left
        if left > need:
            tree.push(left - need, b)
    return bins, offsets, used


def pack(pieces: DataFrame, size: int = 2048, group_rows: int = 40_000, rows: int | None = None) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) -> the same rows with sequence_id and offset.

    Pieces are dealt by hash into groups of about group_rows, each packed whole in one task: every group sees the same
    mix of lengths, so it loses at most its last few bins to the whole, under one in a thousand, and groups grow in
    number, not in size, with the data. A piece of full size is a sequence of its own and stays out of the groups.
    `rows` is the number of the other pieces, if known; else it is counted.
    """
    full, open_ = pieces.where(F.col("length") == size), pieces.where(F.col("length") != size)
    groups = max(1, math.ceil((open_.count() if rows is None else rows) / group_rows))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets, _ = best_fit_decreasing(pdf["length"].to_numpy(), size)
        return pdf.drop(columns="g").assign(sequence_id=(int(key[0]) << 40) + bins, offset=offsets)

    # the row's own number goes into the hash too, so that many equal rows do not fill one group
    dealt = open_.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    alone = full.select("*", (F.lit(-1).cast("long") - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return dealt.groupBy("g").applyInPandas(run, PLACED).unionByName(alone)


def pack_documents(docs: DataFrame, path: str | None = None, size: int = 2048, end_id: int = 0, group_rows: int = 40_000) -> DataFrame:
    """Pack every whole document into sequences of at most `size` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece. Repeated rows are packed
    each on its own, a null doc_id stays null, an empty table gives no rows.
    """
    pieces = stage(token_pieces(docs, path or tokenizer_path(WORD_VOCABULARY), size, end_id), "pieces")
    return pack(pieces, size, group_rows)
