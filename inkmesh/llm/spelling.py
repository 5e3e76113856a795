"""Operator 13, spelling variants: words one edit apart, by automata that walk tries of the vocabulary, and the forms they lead to."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh.llm.text import give_back, slices
from inkmesh.plans.scan import running
from inkmesh.plans.staging import stage

#: A run of letters. All are below U+0100, so Latin-1 holds a word in a byte a code point.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Code points of the words of one trie shard at most (a longer word is a shard of its own), and shards that small vocabularies are cut into.
SHARD = 400_000
SHARDS = 12
#: Shards whose bytes are up to this are broadcast; beyond, they are joined by a shuffle.
BROADCAST = 64 << 20
#: Entries of a task's counter before it is emptied.
_MOST = 200_000


def runs(doc_id: int | None, text: str, damage: int = 97) -> Counter:
    """Runs of letters, A-Z lowered, with their numbers; a run whose checksum with doc_id `damage` divides has lost a code point.

    The checksum is the CRC-32 of `<doc_id>:<run>` and also says which code point goes; a null doc_id is written empty.
    """
    out: Counter = Counter()
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes.lower knows A-Z alone
    for w, n in Counter(RUN.findall(low)).items():
        h = zlib.crc32(w.encode(), head)
        if damage and h % damage == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
        out[w] += n
    return out


def word_counts(docs: DataFrame, least: int = 3, shortest: int = 5, damage: int = 97) -> DataFrame:
    """documents -> word, n: words of `shortest` code points or more with `least` occurrences or more in all texts together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        letters = 0

        def let_go() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for part, texts in slices(batch):
                for doc_id, t in zip(part.column(0).to_pylist(), texts):
                    for w, n in runs(doc_id, t, damage).items():
                        if len(w) >= shortest:
                            letters += len(w) if w not in total else 0
                            total[w] += n
                if len(total) >= _MOST or letters >= 16 * _MOST:
                    yield let_go()
                    letters = 0
        yield let_go()
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Trie:
    """A trie of sorted words in arrays: nodes by depth, the children of a node side by side in order of their letters."""

    def __init__(self, labels: np.ndarray, first: np.ndarray, word: np.ndarray):
        #: the letter that leads to a node; a node's children are first[i] to first[i + 1]; the number of the word that ends there, or -1
        self.labels, self.first, self.word = labels, first, word
        self._lists = None

    @classmethod
    def of(cls, words: list[bytes]) -> Trie:
        """Of distinct words in order of their bytes."""
        labels, first, word = [0], [], []
        level = [(0, len(words))]  # ranges of words that share the path to a node
        depth = 0
        while level:
            below = []
            for lo, hi in level:
                first.append(len(labels))
                ends = len(words[lo]) == depth if lo < hi else False
                word.append(lo if ends else -1)
                lo += ends
                while lo < hi:
                    c, at = words[lo][depth], lo
                    while at < hi and words[at][depth] == c:
                        at += 1
                    labels.append(c)
                    below.append((lo, at))
                    lo = at
            level, depth = below, depth + 1
        first.append(len(labels))
        return cls(np.array(labels, np.uint8), np.array(first, np.int32), np.array(word, np.int32))

    def near(self, w: bytes) -> list[int]:
        """Numbers of the words at Levenshtein distance one from w.

        The automaton's states are (letters of w read, edits); it goes down the trie depth-first. While no edit is
        made there is one path; beside it every child opens a replacement and an insertion, and a skipped letter of w
        a deletion, each of which then follows w letter by letter. States met before are not entered again, so a word
        costs no more than the nodes at hand.
        """
        if self._lists is None:
            self._lists = self.labels.tobytes(), self.first.tolist(), self.word.tolist()
        labels, first, word = self._lists
        n, found, seen = len(w), set(), set()
        node, i = 0, 0
        while True:
            begin, end = first[node], first[node + 1]
            own = w[i] if i < n else -1
            todo = [(node, i + 1)] if i < n else []  # w[i] deleted
            on = -1
            for child in range(begin, end):
                c = labels[child]
                if c == own:
                    on = child
                elif i < n:
                    todo.append((child, i + 1))  # replaced
                todo.append((child, i))  # c inserted
            for at, j in todo:
                while True:
                    if j - i > 1 or n > 64:  # states that several edits reach
                        if (at, j) in seen:
                            break
                        seen.add((at, j))
                    if j == n:
                        if word[at] >= 0:
                            found.add(word[at])
                        break
                    k = labels.find(w[j], first[at], first[at + 1])
                    if k < 0:
                        break
                    at, j = k, j + 1
            if on < 0:
                break
            node, i = on, i + 1
        if i == n and word[node] >= 0:
            found.discard(word[node])  # w itself
        return sorted(found)


def shards(vocabulary: DataFrame) -> DataFrame:
    """word, n -> shard, words (Latin-1, a line each), counts, labels, first, word: a trie of each stretch of the sorted vocabulary."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, rows in zip(batch.column(0), batch.column(1)):
                words, counts = (rows.values.field(k) for k in (0, 1))
                words = [w.encode("latin-1") for w in words.to_pylist()]
                t = Trie.of(words)
                arrays = (b"\n".join(words), counts.to_numpy().astype("<i8").tobytes(), t.labels.tobytes(), t.first.astype("<i4").tobytes(), t.word.astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()], pa.int64()), *(pa.array([x], pa.binary()) for x in arrays)], ["shard", "words", "counts", "labels", "first", "word"])

    placed = running(vocabulary.withColumn("size", F.length("word").cast("long")), [F.col("word")], ("size",))
    total = placed.agg(F.coalesce(F.max("run_size"), F.lit(0))).first()[0]
    size = max(1, min(SHARD, -(-total // SHARDS)))
    cut = placed.select(F.floor((F.col("run_size") - F.col("size")) / size).alias("shard"), "word", "n")
    groups = cut.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("rows"))
    return stage(groups.mapInArrow(build, "shard long, words binary, counts binary, labels binary, first binary, word binary"), "tries")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block (words, counts) and a trie -> word, n, n_near and best (-n and word of the near word with the largest n, the first of equals)."""
    last, trie, others, numbers = None, None, [], []
    for batch in batches:
        for row in zip(*batch.columns):
            mine, counts, shard, words, other_counts, labels, first, ends = row
            if shard.as_py() != last:
                last = shard.as_py()
                trie = Trie(*(np.frombuffer(x.as_py(), kind) for x, kind in ((labels, np.uint8), (first, "<i4"), (ends, "<i4"))))
                others, numbers = words.as_py().split(b"\n"), np.frombuffer(other_counts.as_py(), "<i8").tolist()
            out: list[tuple] = []
            for w, n in zip(mine.as_py().split(b"\n"), np.frombuffer(counts.as_py(), "<i8").tolist()):
                near = trie.near(w)
                if near:
                    best = min(near, key=lambda k: (-numbers[k], others[k]))
                    out.append((w.decode("latin-1"), n, len(near), -numbers[best], others[best].decode("latin-1")))
            if out:
                word, n, many, low, form = zip(*out)
                best = pa.StructArray.from_arrays([pa.array(low, pa.int64()), pa.array(form, pa.string())], ["low", "form"])
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(many, pa.int64()), best], ["word", "n", "n_near", "best"])
    give_back()


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """word, n -> word, n, n_near, best (low: -n, form) of the words that have near words.

    Every shard of the vocabulary is at once a trie and a block of words, and every block meets every trie; a task
    holds one of each. Ids of shards, a number for some 400,000 code points, travel in one row.
    """
    tries = shards(vocabulary)
    ids = tries.agg(F.collect_list("shard").alias("ids"))
    many = tries.count()
    blocks = tries.select(F.col("words").alias("mine"), F.col("counts").alias("own")).join(F.broadcast(ids)).select("mine", "own", F.explode("ids").alias("shard"))
    size = tries.agg(F.coalesce(F.sum(sum((F.octet_length(c) for c in ("words", "counts", "labels", "first", "word")), F.lit(0))), F.lit(0))).first()[0]
    blocks = blocks.repartition(max(1, many * min(many, 16)), "shard", F.xxhash64("mine"))  # by number, as few bytes mean much work here
    both = blocks.join(F.broadcast(tries) if size <= BROADCAST else tries, "shard")
    met = both.select("mine", "own", "shard", "words", "counts", "labels", "first", "word").mapInArrow(_neighbours, "word string, n long, n_near long, best struct<low: long, form: string>")
    return met.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, form (not null) -> word, root: the last form. A form has twice its word's n or more, so chains end, and each round halves them."""
    links = stage(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links


def variants(docs: DataFrame, least: int = 3, shortest: int = 5, ratio: int = 2, damage: int = 97) -> DataFrame:
    """documents -> word, form, root, n, n_near, form_n of every word of the vocabulary.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lowered, with the planted damage (see runs; 0: none), of
    `shortest` code points or more and `least` occurrences or more. Near words differ by one inserted, deleted or
    replaced code point. form: the near word of the largest n, the first in code-point order of equals, if that n is
    `ratio` times the word's or more; else null. root: where forms lead to, the word itself without a form. Null and
    empty texts have no words; repeated rows count each; an empty table gives no rows. Words of any length are whole
    words. ratio must be 2 or more, so that forms cannot lead in a circle.
    """
    if ratio < 2:
        raise ValueError("ratio is 2 or more")
    words = stage(word_counts(docs, least, shortest, damage), "words")
    near = neighbours(words).select("word", "n_near", F.when(-F.col("best.low") >= ratio * F.col("n"), F.col("best.form")).alias("form"), (-F.col("best.low")).alias("form_n"))
    told = stage(words.join(near, "word", "left").select("word", "form", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("form").isNotNull(), F.col("form_n")).alias("form_n")), "near")
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
