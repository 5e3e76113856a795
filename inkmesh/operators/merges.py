"""A thesaurus as an append-only log of versions: merges are added, undone and read as of any version; nothing is written over."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A change of the thesaurus: an empty replacement ignores the key, null takes its entry away.
CHANGES = "key string, replace_by string, version long"


class Conflict(RuntimeError):
    """Another writer took the version first: read the log again and decide anew."""


@dataclass(frozen=True)
class Version:
    """One entry of the log. state: the merges, oldest first, that hold in this version; before: the version it undoes to; merged: the merge that it ends with."""

    number: int
    note: str
    state: tuple[str, ...]
    before: int | None
    merged: int = 0


class MergeLog:
    """The log in a folder that driver and executors share.

    `changes/` holds a Parquet folder for each merge, `versions/` a small file for each version, made by the file
    system's create-unless-there, which lets one of two writers win. A merge whose version was lost to another writer
    leaves a folder that no version names. Versions count from 1; version 0 is the empty thesaurus. Files are one for
    each action of a user, so the driver reads the list of them; entries of the thesaurus stay in Spark.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        place = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _file(self, number: int) -> object:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/{number:012d}.json")

    def versions(self) -> list[Version]:
        """All versions, oldest first."""
        folder = f"{self.path}/versions"
        if not self._fs.exists(self._jvm.org.apache.hadoop.fs.Path(folder)):
            return []
        lines = self.spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").collect()
        told = {e["number"]: e for e in (json.loads(r["value"]) for r in lines)}
        out: dict[int, Version] = {0: Version(0, "", (), None)}
        for number in sorted(told):
            e = told[number]
            if "undo_to" in e:
                back = out[e["undo_to"]]
                out[number] = Version(number, e["note"], back.state, back.before, back.merged)
            else:
                out[number] = Version(number, e["note"], (*out[number - 1].state, e["merge"]), number - 1, number)
        return [out[n] for n in sorted(told)]

    def latest(self) -> int:
        found = self.versions()
        return found[-1].number if found else 0

    def _commit(self, number: int, entry: dict) -> int:
        entry = {"number": number, **entry}
        try:
            stream = self._fs.create(self._file(number), False)
        except Exception as e:
            if self._fs.exists(self._file(number)):
                raise Conflict(f"version {number} is taken") from e
            raise
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        return number

    def merge(self, changes: DataFrame, base: int | None = None, note: str = "merge") -> int:
        """Add (key, replace_by) on top of version `base` (the latest, if None) and return the new version.

        Raises Conflict if base is no longer the latest. Null keys are passed over; of several replacements of one key
        the largest counts, null last. An entry that renames a key to itself takes its entry away.
        """
        base = self.latest() if base is None else base
        one = changes.where("key is not null").groupBy("key").agg(F.max("replace_by").alias("replace_by"))
        own = F.when(~F.col("replace_by").eqNullSafe(F.col("key")), F.col("replace_by"))
        name = uuid.uuid4().hex
        one.select("key", own.alias("replace_by"), F.lit(base + 1).cast("long").alias("version")).write.parquet(f"{self.path}/changes/{name}")
        if self.latest() != base:
            raise Conflict(f"version {base} is no longer the latest")
        return self._commit(base + 1, {"merge": name, "note": note})

    def merge_groups(self, groups: DataFrame, base: int | None = None, note: str = "merge of variants") -> int:
        """Add groups (target, members): members become their target; a target that was ignored is a term again."""
        base = self.latest() if base is None else base
        members = groups.select(F.explode("members").alias("key"), F.col("target").alias("replace_by")).where("key <> replace_by")
        ignored = self.as_of(base).where("replace_by = ''").select("key")
        again = groups.select(F.col("target").alias("key")).distinct().join(ignored, "key", "left_semi").select("key", F.lit(None).cast("string").alias("replace_by"))
        return self.merge(members.unionByName(again), base, note)

    def ignore(self, keys: DataFrame, base: int | None = None, note: str = "ignored terms") -> int:
        """Add keys that are dropped from now on."""
        return self.merge(keys.select("key", F.lit("").alias("replace_by")), base, note)

    def undo(self, steps: int = 1, base: int | None = None) -> int:
        """Add a version that equals the one before the last `steps` merges not yet undone; all are kept, so any number can be undone.

        Raises ValueError if fewer merges are left, Conflict if base is no longer the latest.
        """
        found = {0: Version(0, "", (), None), **{v.number: v for v in self.versions()}}
        latest = max(found)
        if base is not None and base != latest:
            raise Conflict(f"version {base} is no longer the latest")
        at = found[latest]
        for _ in range(steps):
            if at.before is None:
                raise ValueError("nothing is left to undo")
            note, at = found[at.merged].note, found[at.before]
        return self._commit(latest + 1, {"undo_to": at.number, "note": f"undo of {note}" if steps == 1 else f"undo of {steps} merges"})

    def as_of(self, version: int | None = None) -> DataFrame:
        """key, replace_by: the thesaurus in a version (the latest, if None); the last merge that names a key decides."""
        found = {0: Version(0, "", (), None), **{v.number: v for v in self.versions()}}
        version = max(found) if version is None else version
        if version not in found:
            raise ValueError(f"there is no version {version}")
        names = found[version].state
        if not names:
            return self.spark.createDataFrame([], "key string, replace_by string")
        all_changes = self.spark.read.schema(CHANGES).parquet(*[f"{self.path}/changes/{n}" for n in names])
        last = all_changes.groupBy("key").agg(F.max_by(F.struct("replace_by"), "version").alias("e"))
        return last.select("key", F.col("e.replace_by").alias("replace_by")).where("replace_by is not null")

    def history(self) -> DataFrame:
        """version, note, merges: every version and how many merges hold in it."""
        return self.spark.createDataFrame([(v.number, v.note, len(v.state)) for v in self.versions()], "version long, note string, merges int")
