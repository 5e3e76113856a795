"""One large file by many tasks: CSV records with line ends inside quotes, and the objects of a JSON page.

Whether a line or a bracket stands inside quotes depends on everything before it. So each block of a file says what it
does to the state (an odd number of quotes turns it, brackets raise or lower the depth, for both states it may begin in);
a scan over the blocks, a row each, gives the state in which each begins; then every piece knows where it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkmesh.plans.staging import stage
from inkmesh.sources import raw

#: Tables with a row for each block are broadcast up to so many rows.
_FEW = 100_000
_TOKENS = re.compile(r'\\.|["{}\[\]]', re.S)


def effects(text: str) -> tuple[int, int, int, int, int]:
    """What a piece of JSON does: 1 if it holds an odd number of quotes; then, if it begins outside a string, how much deeper it ends and gets at most; then the same if it begins inside one."""
    inside, depth, most = 0, [0, 0], [0, 0]
    for token in _TOKENS.findall(text):
        if token == '"':
            inside ^= 1
        elif len(token) == 1:
            # brackets count for the start that has us outside strings here
            depth[inside] += 1 if token in "{[" else -1
            most[inside] = max(most[inside], depth[inside])
    return inside, depth[0], most[0], depth[1], most[1]


def _told(json: bool):
    """file, start, value -> and seq, turns, down, and for JSON deep, up, deep_in, up_in: what a piece does, and what was before it in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, seq, before = None, TaskContext.get().partitionId() << 32, [0, 0, 0]
        for batch in batches:
            files, starts, values = (c.to_pylist() for c in batch.columns)
            out = []
            for at in zip(files, starts, values):
                if at[:2] != block:
                    block, before = at[:2], [0, 0, 0]
                e = effects(at[2]) if json else (at[2].count('"') & 1, 0, 0, 0, 0)
                out.append((seq, *before, *e))
                # a block that begins outside a string is inside one here if before[0] is odd
                turned = before[0]
                before = [turned ^ e[0], before[1] + e[3 if turned else 1], before[2] + e[1 if turned else 3]]
                seq += 1
            columns = list(zip(*out)) or [()] * 9
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], ["file", "start", "value", "seq", *_STATE])

    return run


#: Before a piece in its block: quotes turned, depth if the block begins outside a string, depth if inside. Of the piece: see effects.
_STATE = ("turned", "deep", "deep_in", "turns", "d", "most", "d_in", "most_in")


def _joined(rows: DataFrame, facts: DataFrame) -> DataFrame:
    facts = stage(facts, "blocks")
    return rows.join(F.broadcast(facts) if facts.count() <= _FEW else facts, ["file", "start"])


def _placed(pieces: DataFrame, json: bool) -> DataFrame:
    """pieces with block (its number), inside (0, 1: the state before the piece) and depth before it."""
    rows = stage(pieces.mapInArrow(_told(json), "file string, start long, value string, seq long, " + ", ".join(f"{c} long" for c in _STATE)), "pieces")
    here, there = F.col("turned") == 0, lambda a, b: F.when(F.col("turned") == 0, F.col(a)).otherwise(F.col(b))
    ends = rows.groupBy("file", "start").agg(F.max_by(F.struct((F.col("turned") + F.col("turns")).alias("turns"), (F.col("deep") + there("d", "d_in")).alias("deep"), (F.col("deep_in") + there("d_in", "d")).alias("deep_in")), "seq").alias("e"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    state = ends.select("file", "start", "e", (F.coalesce(F.sum("e.turns").over(earlier), F.lit(0)) % 2).alias("begins"))
    state = state.withColumn("goes", F.when(F.col("begins") == 0, F.col("e.deep")).otherwise(F.col("e.deep_in")))
    facts = state.select("file", "start", "begins", F.coalesce(F.sum("goes").over(earlier), F.lit(0)).alias("above"), F.row_number().over(Window.orderBy("file", "start")).cast("long").alias("block"))  # a row a block
    out = _joined(rows, facts)
    inside = (F.col("begins") + F.col("turned")) % 2
    depth = F.col("above") + F.when(F.col("begins") == 0, F.col("deep")).otherwise(F.col("deep_in"))
    return out.select("file", "start", "block", "seq", "value", inside.alias("inside"), "turns", depth.alias("depth"), F.when(inside == 0, F.col("d")).otherwise(F.col("d_in")).alias("d"), F.when(inside == 0, F.col("most")).otherwise(F.col("most_in")).alias("most"))


def _rec_id(block: Column, seq: Column) -> Column:
    """Grows in the order of files and of records in them: the block's number, and 32 bits of a task's own count."""
    return F.shiftleft(block, 32) + F.pmod(seq, F.lit(1 << 32))


def put_together(dealt: DataFrame, sep: str, numbers: DataFrame | None = None) -> DataFrame:
    """file, start, seq, value, opens, closes, in order inside a block -> file, rec_id, text: an opening piece and those behind it up to a closing one, or to the next that opens.

    Pieces of a block stream by; records that lie in one block are done there, and only those that may cross a block's
    end are brought together. numbers: file, start, block of all blocks, if they are known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []

        def let_go() -> pa.RecordBatch:
            rows, names = list(zip(*out)) or [()] * 6, ("file", "start", "key", "seq", "text", "whole")
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], list(names))

        for batch in batches:
            for file, start, seq, value, opens, closes in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (held[:2] != (file, start) or opens):
                    out.append((*held[:4], sep.join(held[4]), False))
                    held = None
                if opens or held is None:
                    held = (file, start, seq if opens else None, seq, [])
                held[4].append(value)
                if closes and held[2] is not None:
                    out.append((*held[:4], sep.join(held[4]), True))
                    held = None
            yield let_go()
        if held:
            out.append((*held[:4], sep.join(held[4]), False))
        yield let_go()

    rows = dealt.select("file", "start", "seq", "value", "opens", "closes")
    parts = stage(rows.mapInArrow(run, "file string, start long, key long, seq long, text string, whole boolean"), "parts")
    opened = parts.groupBy("file", "start").agg(F.max("key").alias("last"))
    if numbers is None:
        opened = opened.withColumn("block", F.row_number().over(Window.orderBy("file", "start")).cast("long"))  # a row a block
    else:
        opened = opened.join(numbers, ["file", "start"])
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    facts = opened.select("file", "start", "block", F.last(F.when(F.col("last").isNotNull(), F.struct("block", F.col("last").alias("key"))), ignorenulls=True).over(earlier).alias("from"))
    known = _joined(parts, facts).withColumn("at", F.when(F.col("key").isNotNull(), F.struct("block", "key")).otherwise(F.col("from"))).where("at is not null")
    whole = known.where("whole").select("file", "at", "text")
    crossing = known.where("not whole").groupBy("file", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", "text"))), lambda x: x["text"]), sep).alias("text"))
    return whole.unionByName(crossing).select("file", _rec_id(F.col("at.block"), F.col("at.key")).alias("rec_id"), "text")


def _in_order(pieces: DataFrame) -> DataFrame:
    return pieces.repartition("file", "start").sortWithinPartitions("file", "start", "seq")


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, rec_id, text of every record of CSV files: lines, but for line ends between quotes. Lines of white space alone are none.

    A quote always begins or ends quoting, as the format demands; the lines of a field end in a line feed, however they
    did. An open quote at a file's end closes with it.
    """
    x = _placed(raw.pieces(spark, path), json=False)
    x = x.withColumn("opens", F.col("inside") == 0).withColumn("closes", (F.col("inside") + F.col("turns")) % 2 == 0)
    lines = x.where("opens and closes").select("file", _rec_id(F.col("block"), F.col("seq")).alias("rec_id"), F.col("value").alias("text"))
    longer = put_together(_in_order(x.where("not (opens and closes)")), "\n", x.select("file", "start", "block").distinct())
    return lines.unionByName(longer).where(F.trim("text") != "")


def csv_table(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """rec_id and the columns of CSV files with a header, all strings; every file's first record is its header, the first file's holds."""
    records = stage(csv_records(spark, path), "records")
    ends = records.groupBy("file").agg(F.min("rec_id").alias("rec_id"))
    first = records.join(F.broadcast(ends.agg(F.min("rec_id").alias("rec_id"))), "rec_id", "left_semi").first()
    if first is None:
        return spark.createDataFrame([], "rec_id long")
    import csv

    names = next(csv.reader([first["text"]], delimiter=sep))
    numbered = ", ".join(f"c{k} string" for k in range(len(names)))
    rows = records.join(ends, ["file", "rec_id"], "left_anti").select("rec_id", F.from_csv("text", numbered, {"sep": sep, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "maxColumns": str(max(20480, len(names)))}).alias("r"))
    return rows.select("rec_id", *[F.col(f"r.c{k}").alias(n or f"_c{k}") for k, n in enumerate(names)])


def json_objects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, rec_id, text of the objects in the root array of JSON files, or in the arrays and objects of their root object.

    A file may be one line of any length: it is cut behind every closing brace. Objects elsewhere in the root object
    (counts, groups) come along; the caller takes what has the fields of a work.
    """
    x = _placed(raw.pieces(spark, path, "}").withColumn("value", F.concat("value", F.lit("}"))), json=True)
    root = x.groupBy("file").agg(F.min_by(F.regexp_extract("value", r"^\s*(\S)", 1), F.struct("block", "seq")).alias("root"))
    # objects of a root array begin at depth 1, those of an array in a root object at depth 2
    x = x.join(root, "file").withColumn("level", F.when(F.col("root") == "[", 1).otherwise(2))
    x = x.withColumn("opens", (F.col("depth") <= F.col("level")) & (F.col("depth") + F.col("most") > F.col("level")))
    x = x.where("opens or depth > level").withColumn("closes", F.col("depth") + F.col("d") <= F.col("level"))

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, inside, depth, level, opens = (c.to_pylist() for c in batch.columns[4:9])
            out = [_from_level(v, i, d, n) if o else v for v, i, d, n, o in zip(values, inside, depth, level, opens)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.string()), *batch.columns[8:]], ["file", "start", "block", "seq", "value", "opens", "closes"])

    cut = x.select("file", "start", "block", "seq", "value", "inside", "depth", "level", "opens", "closes").mapInArrow(trimmed, "file string, start long, block long, seq long, value string, opens boolean, closes boolean")
    return put_together(_in_order(cut), "", x.select("file", "start", "block").distinct())


def _from_level(text: str, inside: int, depth: int, level: int) -> str:
    """The text from the bracket on that leads below the level."""
    for m in _TOKENS.finditer(text):
        token = m.group()
        if token == '"':
            inside ^= 1
        elif len(token) == 1 and not inside:
            depth += 1 if token in "{[" else -1
            if depth > level:
                return text[m.start() :]
    return text
