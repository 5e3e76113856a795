"""Operator 10, SentencePiece encoding and decoding: the n best segmentations over a public vocabulary's lattice."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkmesh.llm.lattice import PieceTable, code_points
from inkmesh.llm.packing import tokenizer_path
from inkmesh.llm.text import Generations, id_and_text, in_slices, no_cycles

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
#: Texts are cut before marks that follow a letter, and around line ends: no piece crosses these places.
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

#: Chunks up to so many letters go forward abreast; longer ones, if no cut parts them, are searched one by one.
LONG = 64

Best = list[tuple[float, tuple[int, ...]]]


class PieceCoder:
    """n-best segmentation, and decoding.

    A text is marked with a space before it, spaces become the vocabulary's mark, and nothing else changes. A piece
    scores what the vocabulary says; a letter that is no piece becomes its UTF-8 byte pieces, at the lowest score less 10.
    """

    def __init__(self, path: str, n: int = 3):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n, self.pieces, self.bytes, self.table = n, {}, {}, []
        for i in range(model.get_piece_size()):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                self.table.append(bytes([int(p[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.table.append(b"")
            else:
                self.pieces[p] = (i, model.get_score(i))
                self.table.append(p.replace(SPACE, " ").encode())
        self.unknown = min(s for _, s in self.pieces.values()) - 10
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece has a space behind a letter: texts cannot be cut before spaces")
        if any("\n" in p for p in self.pieces):
            raise ValueError("a piece has a line end: texts cannot be cut around line ends")
        #: Two letters that no piece holds side by side: every segmentation has a boundary between them.
        self.inside = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.longest = max(map(len, self.pieces))
        names = list(self.pieces)
        self.ids, self.scores = np.array([self.pieces[p][0] for p in names] + [-1]), np.array([self.pieces[p][1] for p in names] + [self.unknown])
        self.lookup = PieceTable(names)
        self.by_id = np.zeros(model.get_piece_size())
        self.by_id[self.ids[:-1]] = self.scores[:-1]
        self.sizes = np.array(list(map(len, self.table)))
        self.chunks, self.several = Generations(300_000, 8_000_000), Generations(20_000)

    def _edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, back, id): the pieces that end at place j are first[j] to first[j + 1], shortest first, each with its length; id -1 is an unknown letter."""
        ends, backs, ids = [], [], []
        n, step = len(text), 50_000
        for a in range(0, n, step):  # blocks bound the table of lookups, which is as wide as the longest piece
            block = text[a : a + step + self.longest]
            row = self.lookup.rows(code_points([block]), self.longest)[:, : min(step, n - a)]
            at = np.flatnonzero(row[1] < 0)
            k, p = np.nonzero(row >= 0)
            ends.append(np.r_[a + p + k, a + at + 1])
            backs.append(np.r_[k, np.ones(len(at), np.int64)])
            ids.append(np.r_[self.ids[row[k, p]], np.full(len(at), -1)])
        end, back, own = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (ends, backs, ids))
        turn = np.lexsort((back, end))
        return np.searchsorted(end[turn], np.arange(n + 2)), back[turn].astype(np.int32), own[turn].astype(np.int32)

    def _few_edges(self, text: str) -> tuple[list[int], list[int], list[int], list[float]]:
        """What _edges gives, and scores, of a short text: as lists, by plain lookups."""
        bounds, back, own, score = [0, 0], [], [], []
        get = self.pieces.get
        for j in range(1, len(text) + 1):
            for i in range(j - 1, max(-1, j - self.longest - 1), -1):
                p = get(text[i:j])
                if p is None and i + 1 < j:
                    continue
                back.append(j - i)
                own.append(-1 if p is None else p[0])
                score.append(self.unknown if p is None else p[1])
            bounds.append(len(back))
        return bounds, back, own, score

    def search(self, text: str) -> Best:
        """The n best (score, ids) of a text, best first.

        Viterbi forward gives every place's best score from the left. A-star backward from the end, its heuristic that
        exact score, then pops paths in order of score: no path is opened that is worse than those returned. Of equal
        scores the path that has come furthest goes first, and a place is passed at most n times, since no more of its
        paths can be among the n best: so ties, such as those of a run of one letter, cost no more than other text.
        Paths share what they have in common, by pointers back.
        """
        end = len(text)
        if end <= LONG:
            bounds, back, own, score = self._few_edges(text)
        else:
            first, back, own = self._edges(text)
            bounds, score = first.tolist(), np.where(own >= 0, self.by_id[own], self.unknown)
        best = [0.0]
        for a in range(0, end, 50_000):
            b = min(end, a + 50_000)
            lo = bounds[a + 1]
            ks, ss = list(back[lo : bounds[b + 1]]), list(score[lo : bounds[b + 1]])
            for j in range(a + 1, b + 1):
                x, y = bounds[j] - lo, bounds[j + 1] - lo
                best.append(max([best[j - k] + s for k, s in zip(ks[x:y], ss[x:y])]))
        heap: list[tuple] = [(-best[end], end, 0, 0.0, None)]
        passed: dict[int, int] = {}
        out: Best = []
        opened = 0
        while heap and len(out) < self.n:
            _, j, _, done, path = heapq.heappop(heap)
            if j == 0:
                out.append((done, self._path(path, text)))
                continue
            passed[j] = passed.get(j, 0) + 1
            if passed[j] > self.n:
                continue
            for e in range(bounds[j], bounds[j + 1]):
                i, s = j - int(back[e]), float(score[e])
                if passed.get(i, 0) < self.n:
                    opened += 1
                    heapq.heappush(heap, (-(done + s + best[i]), i, opened, done + s, (int(own[e]), i, path)))
        return out

    def _path(self, path: tuple | None, text: str) -> tuple[int, ...]:
        ids: list[int] = []
        while path is not None:
            piece, place, path = path
            ids += [piece] if piece >= 0 else [self.bytes[b] for b in text[place].encode("utf-8", "surrogatepass")]
        return tuple(ids)

    def _cut(self, chunk: str) -> list[str]:
        cuts = [0, *(k for k in range(1, len(chunk)) if chunk[k - 1 : k + 1] not in self.inside), len(chunk)]
        return [chunk[a:b] for a, b in zip(cuts, cuts[1:])]

    def chunks_of(self, text: str) -> list[str]:
        """A text's independent chunks: long ones are cut on between letters that no piece joins."""
        if not text:
            return []
        found = _CHUNK.findall((SPACE + text).replace(" ", SPACE))
        if max(map(len, found)) <= LONG:
            return found
        return [s for c in found for s in ([c] if len(c) <= LONG else self._cut(c))]

    def nbest(self, chunk: str) -> list[tuple[float, bytes]]:
        """The n best of one chunk."""
        return [(s, np.array(i, "<u4").tobytes()) for s, i in self.search(chunk)]

    def _known(self, chunk: str, first: bytes | None = None) -> list[tuple[float, bytes]]:
        """nbest of a chunk; of segmentations that score alike, `first`, which forward has chosen, leads."""
        if self.several.missing({chunk}):
            best = self.nbest(chunk)
            if first is not None and best[0][1] != first:
                best = [(best[0][0], first), *(x for x in best if x[1] != first)][: self.n]
            self.several.young[chunk] = best
        return self.several.young[chunk]

    def forward(self, chunks: list[str]) -> list[tuple[float, float, bytes]]:
        """(best score, what the second best loses, ids of the best) of many chunks at once.

        Viterbi forward with the two best scores of every place, a step a letter, all chunks abreast; pieces are looked
        up by a rolling hash in one table. Of equal scores the shorter last piece wins.
        """
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(-size, kind="stable").tolist()
        size = size[order]
        begin = np.r_[0, np.cumsum(size + 1)]  # place p of chunk c is at begin[c] + p, p = 0..size
        letters = code_points([chunks[i] for i in order])
        n, most = len(letters), self.longest
        row = self.lookup.rows(letters, most)
        score = np.where(row >= 0, self.scores[row], -np.inf)
        score[1, row[1] < 0] = self.unknown
        one, two, back = np.full(n, -np.inf), np.full(n, -np.inf), np.zeros(n, np.int64)
        one[begin[:-1]] = 0
        active = len(order)
        for j in range(1, int(size[0]) + 1 if len(size) else 0):
            while size[active - 1] < j:
                active -= 1
            k = min(j, most)
            at = begin[:active, None] + j
            came = at - np.arange(1, k + 1)
            edge = score[np.arange(1, k + 1)[None, :], came]
            a, b = one[came] + edge, two[came] + edge
            pick = a.argmax(1)
            rows = np.arange(active)
            at = at[:, 0]
            one[at], back[at] = a[rows, pick], pick + 1
            a[rows, pick] = b[rows, pick]
            b[rows, pick] = -np.inf
            two[at] = np.maximum(a.max(1), b.max(1))
        last = begin[:-1] + size
        where, piece, place, own = [], [], last.copy(), np.arange(len(order))
        while len(own):  # back along the best paths
            k = back[place]
            place = place - k
            where.append(place)
            piece.append(row[k, place])
            more = place > begin[own]
            own, place = own[more], place[more]
        at, found = np.concatenate([*where, np.zeros(0, np.int64)]), np.concatenate([*piece, np.zeros(0, np.int64)])
        turn = np.argsort(at)
        at, ids = at[turn], self.ids[found[turn]]
        cuts = np.searchsorted(at, begin).tolist()
        data = ids.astype("<u4").tobytes()
        odd = set(np.searchsorted(begin, at[ids < 0], "right") - 1)  # chunks with a letter that is no piece
        out: list = [None] * len(chunks)
        gaps, bests = (one[last] - two[last]).tolist(), one[last].tolist()
        for c, i in enumerate(order):
            if c in odd:
                some = self._known(chunks[i])
                out[i] = (some[0][0], some[0][0] - some[1][0] if len(some) > 1 else np.inf, some[0][1])
            else:
                out[i] = (bests[c], gaps[c], data[4 * cuts[c] : 4 * cuts[c + 1]])
        return out

    def _learn(self, chunks: list[str]) -> None:
        short = [c for c in chunks if len(c) <= LONG]
        for k in range(0, len(short), 10_000):
            some = short[k : k + 10_000]
            self.chunks.young.update(zip(some, self.forward(some)))
        for c in chunks:
            if len(c) > LONG:
                some = self._known(c)
                self.chunks.young[c] = (some[0][0], some[0][0] - some[1][0] if len(some) > 1 else np.inf, some[0][1])

    def encode(self, texts: list[str]) -> list[list[tuple[float, bytes]]]:
        """Of each text its n best (score, ids as little-endian unsigned 32-bit bytes), best first; of an empty text, one without ids."""
        with no_cycles():
            cut = list(map(self.chunks_of, texts))
            new = self.chunks.missing(set().union(*cut))
            if new:
                self._learn(new)
            get = self.chunks.young.__getitem__
            return [self._whole(chunks, *zip(*map(get, chunks))) if chunks else [(0.0, b"")] for chunks in cut]

    def _whole(self, names: list[str], scores: tuple[float, ...], gaps: tuple[float, ...], parts: tuple[bytes, ...]) -> list[tuple[float, bytes]]:
        """n best of a text from those of its chunks: chunks are independent, so only the n - 1 chunks that lose least matter."""
        total = sum(scores)
        out = [(total, b"".join(parts))]
        if self.n > 1:
            gap = np.array(gaps)
            least = np.argsort(gap, kind="stable")[: self.n - 1] if len(gap) <= 64 else self._least(gap)
            choices: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
            several = {k: self._known(names[k], parts[k]) for k in sorted(least[np.isfinite(gap[least])].tolist())}
            for k, best in several.items():
                own = [best[0][0] - s for s, _ in best]
                choices = sorted((d + own[r], c + ((k, r),) if r else c) for d, c in choices for r in range(len(own)))[: self.n]
            whole = out[0][1]
            begin = {k: sum(map(len, parts[:k])) for k in several}
            for lost, choice in choices[1:]:
                other, at = [], 0
                for k, r in choice:  # in order of k
                    other += [whole[at : begin[k]], several[k][r][1]]
                    at = begin[k] + len(parts[k])
                out.append((total - lost, b"".join([*other, whole[at:]])))
        return out

    def _least(self, gap: np.ndarray) -> np.ndarray:
        most = np.partition(gap, self.n - 2)[self.n - 2]
        return np.r_[np.flatnonzero(gap < most), np.flatnonzero(gap == most)][: self.n - 1]

    def decode(self, ids: bytes) -> str:
        """The text of ids, without the space that encoding put before it; byte pieces that are no UTF-8 become U+FFFD."""
        return self.decode_all([ids])[0]

    def decode_all(self, many: list[bytes]) -> list[str]:
        """What decode gives of each; pieces that one shares with the first, at its beginning and its end, are joined once."""
        join = lambda ids: b"".join(map(self.table.__getitem__, ids.tolist()))
        first, *rest = [np.frombuffer(ids, "<u4") for ids in many]
        whole = join(first)
        out = [whole.decode("utf-8", "replace").removeprefix(" ")]
        size = self.sizes[first] if rest else None
        for ids in rest:
            n = min(len(first), len(ids))
            head = np.flatnonzero(first[:n] != ids[:n])
            head = int(head[0]) if len(head) else n
            left = n - head
            tail = np.flatnonzero(first[len(first) - left :][::-1] != ids[len(ids) - left :][::-1])
            tail = int(tail[0]) if len(tail) else left
            text = whole[: size[:head].sum()] + join(ids[head : len(ids) - tail]) + whole[len(whole) - size[len(first) - tail :].sum() :]
            out.append(out[0] if text == whole else text.decode("utf-8", "replace").removeprefix(" "))
        return out


@cache
def _coder(path: str, n: int) -> PieceCoder:
    return PieceCoder(path, n)


def encode(docs: DataFrame, n: int = 3, path: str | None = None, decoded: bool = False) -> DataFrame:
    """documents -> doc_id, rank (1 best), score, ids (little-endian unsigned 32-bit): up to n rows a document.

    With `decoded` also text, what decode makes of the ids, in the same pass and by the same worker.
    A null or empty text has one segmentation, without ids. Repeated rows stay, each with its own ranks; equal scores rank
    in a fixed order, given by the text alone. A text of any length and make, unbroken ones too, takes time and memory in
    proportion to its length.
    """
    path = path or tokenizer_path(VOCABULARY)

    def run(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        coder = _coder(path, n)
        rows = []
        for doc, best in zip(part.column(0).to_pylist(), coder.encode(texts)):
            more = [[t] for t in coder.decode_all([ids for _, ids in best])] if decoded else [[]] * len(best)
            rows += [(doc, r, s, ids, *more[r - 1]) for r, (s, ids) in enumerate(best, 1)]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names)

    names = ["doc_id", "rank", "score", "ids", *["text"] * decoded]
    kinds = [pa.int64(), pa.int32(), pa.float64(), pa.binary(), *[pa.string()] * decoded]
    return id_and_text(docs).mapInArrow(in_slices(run, most=1_000_000), "doc_id long, rank int, score double, ids binary" + ", text string" * decoded)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, rank, score, ids -> the same and text. Null ids decode to an empty text."""
    path = path or tokenizer_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, 1)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([coder.decode(x or b"") for x in part.column(3).to_pylist()], pa.string())], ["doc_id", "rank", "score", "ids", "text"])

    return encoded.select("doc_id", "rank", "score", "ids").mapInArrow(run, "doc_id long, rank int, score double, ids binary, text string")
