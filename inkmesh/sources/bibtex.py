"""BibTeX: entries are cut at lines that begin with @, and scanned by counting braces and quotes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmesh.sources import raw
from inkmesh.sources.split import put_together

_OPENS = re.compile(r"@?\s*(\w+)\s*[{(]")
_BRACE = re.compile("[{}]")
_QUOTE = re.compile('[{}"]')
_GAP = re.compile(r"\s*")
_SPACE = re.compile(r"[\s,]*")
_JOIN = re.compile(r"\s*#")
_NAME = re.compile(r"[^=,{}()]*")
_BARE = re.compile(r"[^\s,#{}()]*")

Part = tuple[bool, str]
Entry = tuple[str, str, dict[str, list[Part]]]


def _group(t: str, p: int, tokens: re.Pattern, end: str) -> tuple[str, int]:
    """The text from p to the closing `end` of depth zero, and the place behind it; to the end of t if nothing closes."""
    depth = 0
    for m in tokens.finditer(t, p):
        c = m.group()
        if c == end and depth == 0:
            return t[p : m.start()], m.end()
        depth += c == "{"
        depth -= c == "}" and depth > 0
    return t[p:], len(t)


def _value(t: str, p: int) -> tuple[list[Part], int]:
    """Parts joined by #: (is a macro, text). Every step moves on, so a value costs its length."""
    parts: list[Part] = []
    while p < len(t):
        p = _GAP.match(t, p).end()
        if p >= len(t):
            break
        if t[p] == "{":
            text, p = _group(t, p + 1, _BRACE, "}")
            parts.append((False, text))
        elif t[p] == '"':
            text, p = _group(t, p + 1, _QUOTE, '"')
            parts.append((False, text))
        else:
            m = _BARE.match(t, p)
            if m.end() == p:
                break
            parts.append((not m.group()[0].isdigit(), m.group()))
            p = m.end()
        rest = _JOIN.match(t, p)
        if not rest:
            break
        p = rest.end()
    return parts, p


def entries(t: str) -> Iterator[Entry]:
    """(kind, key, fields) of the entries of a text, without comments and preambles; a macro is an entry of kind string. Of a repeated field the last counts."""
    p = _GAP.match(t, 0).end()
    while p >= 0:
        m = _OPENS.match(t, p)
        if not m:
            p = t.find("@", p + 1)
            continue
        kind, p = m.group(1).lower(), m.end()
        if kind in ("comment", "preamble"):
            _, p = _group(t, p, _BRACE, "}")
        else:
            key = ""
            if kind != "string":
                name = _NAME.match(t, p)
                key, p = name.group().strip(), name.end()
            fields: dict[str, list[Part]] = {}
            while True:
                name = _NAME.match(t, _SPACE.match(t, p).end())
                p = name.end()
                if p >= len(t) or t[p] != "=":
                    p += p < len(t) and t[p] in "})"
                    break
                fields[name.group().strip().lower()], p = _value(t, p + 1)
            yield kind, key, fields
        p = t.find("@", p)


_PARTS = "array<struct<macro: boolean, text: string>>"


def _text(parts: Column, macros: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.when(p["macro"], F.coalesce(F.try_element_at(macros, F.lower(p["text"])), p["text"])).otherwise(p["text"])), "")


def read_entries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, rec_id, kind, key, fields (a map from names in lower case to texts) of every entry; macros of a file are put in.

    An entry begins at a line that begins with @, a word and an opening bracket, or behind another's end; other lines
    with @ belong to what is open. So a missing brace costs one entry and not the rest of the file. An unknown macro
    stands for its own name.
    """
    cut = raw.pieces(spark, path, "\n@").withColumn("seq", F.monotonically_increasing_id())
    texts = put_together(cut.withColumn("opens", F.col("value").rlike(r"^\s*@?\s*\w+\s*[{(]")).withColumn("closes", F.lit(False)), "\n@")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("name", pa.string()), ("parts", pa.list_(pa.struct([("macro", pa.bool_()), ("text", pa.string())])))]))
        for batch in batches:
            rows = []
            for file, rec_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                for k, (what, key, fields) in enumerate(entries(text)):
                    rows.append((file, rec_id, k, what, key, [{"name": n, "parts": [{"macro": a, "text": b} for a, b in v]} for n, v in fields.items()]))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), kind))], ["file", "rec_id", "k", "kind", "key", "fields"])

    found = texts.select("file", "rec_id", "text").mapInArrow(scan, f"file string, rec_id long, k int, kind string, key string, fields array<struct<name: string, parts: {_PARTS}>>")
    given = found.where("kind = 'string'").select("file", "rec_id", "k", F.explode("fields").alias("f"))
    none = F.expr("cast(map() as map<string, string>)")
    step = lambda m, x: F.map_concat(F.map_filter(m, lambda n, _: n != x["f"]["name"]), F.create_map(x["f"]["name"], _text(x["f"]["parts"], m)))
    macros = given.groupBy("file").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("rec_id", "k", "f"))), none, step).alias("macros"))
    told = found.where("kind <> 'string'").join(macros, "file", "left").withColumn("macros", F.coalesce("macros", none))
    fields = F.map_from_entries(F.transform("fields", lambda f: F.struct(f["name"], _text(f["parts"], F.col("macros")))))
    return told.select("file", (F.col("rec_id") + F.col("k")).alias("rec_id"), "kind", "key", fields.alias("fields"))
