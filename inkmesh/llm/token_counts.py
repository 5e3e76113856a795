"""Operator 1, token counts: whole texts are encoded once and their tokens joined to sections by character span."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmesh.llm.packing import tokenizer_path
from inkmesh.llm.text import Generations, no_cycles, slices

VOCABULARY = "byte_bpe_50k.tiktoken"
RULES = ("first", "last", "most")

# The tokenizer's white space, as its own pattern has it.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: No token crosses these: the tokenizer's pattern takes a space only before what follows it, and starts anew at white space.
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


class SpanEncoder:
    """Byte lengths of the tokens of whole texts, by way of a cache of the texts' chunks."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = {i: len(t) for t, i in ranks.items()}
        self.chunks = Generations()

    def lengths(self, texts: list[str]) -> list[np.ndarray]:
        with no_cycles():
            chunks = [_CHUNK.findall(t) for t in texts]
            new = self.chunks.missing(set().union(*chunks))
            if new:
                encode, size, known = self.encoding.encode_ordinary, self.size.__getitem__, self.chunks.young
                for c in new:  # a chunk of white space is one piece of the pattern, whose search overflows the stack in long ones
                    known[c] = bytes(map(size, self.encoding._encode_single_piece(c) if c.isspace() else encode(c)))
            get = self.chunks.young.__getitem__
            return [np.frombuffer(b"".join(map(get, c)), np.uint8) for c in chunks]


@cache
def _encoder(path: str) -> SpanEncoder:
    return SpanEncoder(path)


def allocate(lengths: np.ndarray, starts: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them also reach into another.

    lengths: of consecutive tokens, covering the text from 0; starts: ascending beginnings of the sections, which tile
    the text from 0 on. A token across a boundary goes whole to the section of its first byte, of its last, or to that
    with most of its bytes, the first of equals. So the sections' counts always add up to the document's.
    """
    end = np.cumsum(lengths, dtype=np.int64)
    begin = end - lengths
    first, last = np.searchsorted(starts, begin, "right") - 1, np.searchsorted(starts, end - 1, "right") - 1
    to = last.copy() if rule == "last" else first.copy()
    across = np.flatnonzero(first != last)
    if rule == "most":
        for t in across.tolist():
            cuts = np.r_[begin[t], starts[first[t] + 1 : last[t] + 1], end[t]]
            to[t] = first[t] + int(np.argmax(np.diff(cuts)))
    return np.bincount(to, minlength=len(starts)), np.bincount(to[across], minlength=len(starts))


SCHEMA = "doc_id long, section int, start long, end long, n_tokens long, n_across long"


def section_tokens(docs: DataFrame, path: str | None = None, rule: str = "first", sections: Column | None = None) -> DataFrame:
    """documents -> doc_id, section, start, end, n_tokens, n_across: tokens of each section of each whole text.

    sections: a column of character offsets at which sections begin, tiling the text; the first section always begins
    at 0, and of sections that begin at one place all but the last are empty. Without it, each line with its line end is a section. start and end count code points, end
    excluded; n_across counts tokens given to a section that also reach into another, by `rule` (see allocate). A null
    or empty text has one empty section; repeated rows stay.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    path = path or tokenizer_path(VOCABULARY)
    given = sections is not None
    cuts = sections.cast("array<long>") if given else F.lit(None).cast("array<long>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), cuts.alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for part, texts in slices(batch):
                columns: list[list[np.ndarray]] = [[] for _ in range(5)]
                sizes = []
                for text, cut, lengths in zip(texts, part.column(2).to_pylist(), encoder.lengths(texts)):
                    data = np.frombuffer(text.encode("utf-8"), np.uint8)
                    letter = (data & 0xC0) != 0x80
                    if given:
                        at = np.r_[np.flatnonzero(letter), len(data)]
                        own = sorted(c for c in cut or [] if c is not None)
                        chars = np.clip(np.array(own if own and own[0] == 0 else [0, *own], np.int64), 0, len(at) - 1)
                        starts = at[chars]
                    else:
                        lines = np.flatnonzero(data == 10) + 1
                        starts = np.r_[0, lines[lines < len(data)]]
                        chars = np.r_[0, np.cumsum(letter, dtype=np.int64)[starts[1:] - 1]]
                    n, across = allocate(lengths, starts, rule)
                    for c, x in zip(columns, (np.arange(len(starts)), chars, np.r_[chars[1:], letter.sum()], n, across)):
                        c.append(x)
                    sizes.append(len(starts))
                joined = [np.concatenate(c) for c in columns]
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(joined[0].astype(np.int32)), *(pa.array(x.astype(np.int64)) for x in joined[1:])], ["doc_id", "section", "start", "end", "n_tokens", "n_across"])

    return rows.mapInArrow(run, SCHEMA)


def field_tokens(docs: DataFrame, fields: list[str], path: str | None = None, rule: str = "first", joint: str = "\n") -> DataFrame:
    """Tokens of named string columns: a row's fields are joined by `joint`, encoded once as one text, and attributed back.

    Returns doc_id, field, n_tokens, n_across. A field's section takes in the joint behind it; a null field is empty
    and has no tokens of its own but the joint's.
    """
    parts = [F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit(joint if k + 1 < len(fields) else "")) for k, f in enumerate(fields)]
    begins = [F.lit(0)]
    for p in parts[:-1]:
        begins.append(begins[-1] + F.length(p))
    text = docs.select("doc_id", F.concat(*parts).alias("text"), F.array(*begins).alias("cuts"))
    counts = section_tokens(text, path, rule, F.col("cuts"))
    names = F.array(*[F.lit(f) for f in fields])
    return counts.select("doc_id", F.element_at(names, F.col("section") + 1).alias("field"), "n_tokens", "n_across")
