"""What lies in front of every format: files, their first bytes, their encoding, and their contents cut at a separator."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of a path, and first bytes of each, that are looked at.
HEAD = 4000
_BOMS = ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"))


@dataclass(frozen=True)
class Source:
    """A file, its encoding, and its first characters without byte order mark."""

    path: str
    encoding: str
    head: str


def encoding_of(head: bytes) -> str:
    """By the byte order mark; without one, by zero bytes: text of mostly one-byte letters has them at every other place in UTF-16."""
    for mark, name in _BOMS:
        if head.startswith(mark):
            return name
    even, odd = head[::2].count(0), head[1::2].count(0)
    if len(head) >= 4 and max(even, odd) * 4 >= len(head):
        return "UTF-16LE" if odd > even else "UTF-16BE"
    return "UTF-8"


def sources(spark: SparkSession, path: str | list[str], head: int = HEAD) -> list[Source]:
    """The files of paths, folders or patterns, in order of their names; hidden ones and those that begin with _ are none.

    Only the first bytes of each file are read here, through the file system that Spark itself uses, unpacked if the
    name says so.
    """
    jvm = spark._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    out = []

    def look(fs, status) -> None:
        at = status.getPath()
        if at.getName().startswith((".", "_")):
            return
        if status.isDirectory():
            for inner in sorted(fs.listStatus(at), key=lambda s: s.getPath().toString()):
                look(fs, inner)
            return
        stream = fs.open(at)
        try:
            codec = codecs.getCodec(at)
            raw = bytes((codec.createInputStream(stream) if codec is not None else stream).readNBytes(head))
        finally:
            stream.close()
        name = encoding_of(raw)
        out.append(Source(at.toString(), name, raw.decode(name, "replace").lstrip("\ufeff")))

    for p in [path] if isinstance(path, str) else path:
        place = jvm.org.apache.hadoop.fs.Path(p)
        fs = place.getFileSystem(conf)
        found = fs.globStatus(place)
        if not found:
            raise FileNotFoundError(p)
        for status in sorted(found, key=lambda s: s.getPath().toString()):
            look(fs, status)
    return out


def pieces(spark: SparkSession, path: str | list[str], sep: str = "\n", found: list[Source] | None = None) -> DataFrame:
    """file, start, value: the contents of files between separators, decoded, without byte order marks and carriage returns at an end.

    A file is read by as many tasks as it has blocks; start is where the block of a piece begins. Inside a block pieces
    come in their order. A UTF-16 file is cut at the separator's code units; should a cut fall inside a character (a
    letter of U+0A00 to U+0AFF beside one of U+xx00 looks like a line's end), the query fails instead of reading it wrongly.
    """
    found = sources(spark, path) if found is None else found
    parts = []
    for name in sorted({s.encoding for s in found}):
        rows = spark.read.option("lineSep", sep).option("encoding", name).text([s.path for s in found if s.encoding == name])
        value = F.col("value")
        if name != "UTF-8":
            raw = value.cast("binary")
            value = F.when(F.octet_length(raw) % 2 == 0, F.decode(raw, name)).otherwise(F.raise_error(F.lit(f"a separator inside a character: convert this {name} file to UTF-8")))
        parts.append(rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.regexp_replace(value, "^\ufeff|\r$", "").alias("value")))
    if not parts:
        return spark.createDataFrame([], "file string, start long, value string")
    return reduce(DataFrame.unionByName, parts)
