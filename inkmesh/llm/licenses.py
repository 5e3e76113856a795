"""Operator 4, licence scans: a positional rare-token index over licence templates."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from inkmesh.llm.text import id_and_text, in_slices

# Phrases that give a base label wherever their words stand consecutively.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Texts that templates share.
_WARRANTY = """this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
_NO_NAMES = """neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"""
_USE = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"""
_AUTHOR = """the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"""
_NOTICE = """{0} is free software you can redistribute it and or modify it under the terms of the gnu {1} as published by the free software foundation either version {2} of the license or at your option any later version {0} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {1} for more details"""

# Fixed values: (label, template, key phrases of which every one must stand in the aligned region).
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software""", ("permission is hereby granted", "the software without restriction", "shall be included in all copies")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted", "without restriction")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("apache-2.0", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license""", ("apache license", "version 2 0", "except in compliance with the license")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3.0", _NOTICE.format("this program", "general public license", 3), ("gnu general public license", "version 3 of the license")),
    ("gpl-2.0", _NOTICE.format("this program", "general public license", 2), ("gnu general public license", "version 2 of the license")),
    ("lgpl-3.0", _NOTICE.format("this library", "lesser general public license", 3), ("gnu lesser general public license", "version 3 of the license")),
    ("lgpl-2.1", _NOTICE.format("this library", "lesser general public license", "2 1"), ("gnu lesser general public license", "version 2 1 of the license")),
    ("agpl-3.0", _NOTICE.format("this program", "affero general public license", 3), ("gnu affero general public license", "version 3 of the license")),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license", "version 3")),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial", "4 0")),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike", "4 0")),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("bsd-2-clause", f"{_BSD} {_WARRANTY}", ("redistribution and use in source and binary forms", "must reproduce the above copyright notice", "this software is provided by")),
    ("bsd-3-clause", f"{_BSD} {_NO_NAMES} {_WARRANTY}", ("redistribution and use in source and binary forms", "neither the name of", "endorse or promote products", "this software is provided by")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("mozilla public license", "v 2 0")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "v 2 0")),
    ("isc", f"{_USE} provided that the above copyright notice and this permission notice appear in all copies {_AUTHOR}", ("with or without fee", "this permission notice appear in all copies")),
    ("0bsd", f"{_USE} {_AUTHOR}", ("with or without fee is hereby granted", "hereby granted the software is provided")),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means""", ("unencumbered software", "public domain")),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution""", ("must not be misrepresented", "plainly marked as such")),
)

#: Bytes of words are letters a-z, digits and all beyond ASCII; the rest separates. Lower-cases A-Z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case A-Z, then the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass(frozen=True)
class Index:
    """Of each template: its label, words, key phrases and their words, idf in all, and the places of its rare words.

    postings holds by word what share of which template's idf it brings wherever it stands.
    """

    labels: tuple[str, ...]
    words: tuple[tuple[bytes, ...], ...]
    keys: tuple[tuple[tuple[bytes, ...], ...], ...]
    key_words: tuple[frozenset[bytes], ...]
    idf: dict[bytes, float]
    total: tuple[float, ...]
    postings: dict[bytes, tuple[tuple[int, float], ...]]
    rare: tuple[tuple[tuple[bytes, int], ...], ...]
    rare_words: frozenset[bytes]


@cache
def build_index(templates: tuple = TEMPLATES, rare: float = 1.2) -> Index:
    """The index; words of an idf of `rare` or more are the rare ones."""
    words = tuple(tuple(words_of(t)) for _, t, _ in templates)
    keys = tuple(tuple(tuple(words_of(p)) for p in ps) for _, _, ps in templates)
    df = Counter(w for t in words for w in set(t))
    idf = {w: math.log((1 + len(words)) / n) for w, n in df.items()}
    total = tuple(sum(idf[w] for w in t) for t in words)
    postings: dict[bytes, list] = {}
    for k, t in enumerate(words):
        for w, n in Counter(t).items():
            postings.setdefault(w, []).append((k, n * idf[w] / total[k]))
    places = tuple(tuple((w, place) for place, w in enumerate(t) if idf[w] >= rare) for t in words)
    return Index(tuple(x for x, _, _ in templates), words, keys, tuple(frozenset(w for p in ps for w in p) for ps in keys), idf, total, {w: tuple(p) for w, p in postings.items()}, places, frozenset(w for p in places for w, _ in p))


def find_phrase(words: list[bytes], phrase: tuple[bytes, ...], begin: int = 0, end: int | None = None) -> list[int]:
    """Every place in words[begin:end] where the phrase's words stand consecutively."""
    at, n, end, out = begin, len(phrase), len(words) if end is None else end, []
    while True:
        try:
            at = words.index(phrase[0], at, max(at, end - n + 1))
        except ValueError:
            return out
        if tuple(words[at : at + n]) == phrase:
            out.append(at)
        at += 1


def align(words: list[bytes], template: tuple[bytes, ...], idf: dict[bytes, float], begin: int, gap: int = 8) -> tuple[float, int, int]:
    """(share of the template's idf that stands in place, first, end) of an alignment that begins near words[begin].

    Words follow each other as in the template; where they do not, the next two words of the template are looked for up
    to `gap` words to either side, and what follows is expected from there on. So words may be put in, left out or
    replaced, and the shift adds up without end.
    """
    total = got = 0.0
    shift, last, first, n = begin, -1, -1, len(words)
    for j, w in enumerate(template):
        total += idf[w]
        at = j + shift
        if not (last < at < n and words[at] == w):
            pair = list(template[j : j + 2])
            near = [p for p in range(max(last + 1, at - gap), min(n, at + gap + 1)) if words[p] == w and words[p : p + 2] == pair] if len(pair) > 1 else []
            if not near:
                continue
            at = min(near, key=lambda p: (abs(p - at), p))
            shift = at - j
        got += idf[w]
        last = at
        if first < 0:
            first = at
    return got / total, first, last + 1


def attainable(here: set[bytes], index: Index) -> list[float]:
    """The most that an alignment of each template can score in a file of the words `here`: their share of its idf."""
    most = [0.0] * len(index.words)
    for w in here & index.postings.keys():
        for k, share in index.postings[w]:
            most[k] += share
    return most


def candidates(at: dict[bytes, list[int]], rare: tuple[tuple[bytes, int], ...], slack: int = 8) -> list[int]:
    """Where a template may begin: two different rare words of it, or the only one it has, stand as far apart as in it, give or take `slack`.

    `at` holds the places of the file's rare licence words, `rare` the template's postings. Its places, as those where
    the template would begin, are sorted and intersected within the slack.
    """
    found = sorted((p - place, w) for w, place in rare if w in at for p in at[w])
    need = min(2, len({w for w, _ in rare}))
    left, seen, since, out = 0, Counter(), None, []
    for begin, w in found:
        seen[w] += 1
        while begin - found[left][0] > slack:
            seen[found[left][1]] -= 1
            if not seen[found[left][1]]:
                del seen[found[left][1]]
            left += 1
        if len(seen) >= need and (since is None or begin - since > slack):
            since = begin
            out += {found[left][0], begin}
    return out


def scan(words: list[bytes], index: Index, enough: float = 0.8, places: list[tuple[int, int]] | None = None, any_score: bool = True) -> tuple[dict[str, float], float]:
    """(label -> score, the best score of any alignment) of the licences that a file's words hold.

    An alignment (see align, candidates) that gathers `enough` of its template's idf, and all of its key phrases, is a
    find; its score is the share of idf that stands in place. Of finds in one place only the one that covers most
    counts. Templates whose words in the file cannot gather `enough`, or that lack a word of a key phrase, are passed
    over, unless with any_score they could still raise the best score. `places` replaces the index's candidates.
    """
    finds: list[tuple[float, float, int, int, str]] = []
    best, at = 0.0, None
    here = set(words)
    wanted: dict[int, list[int]] | None = None
    if places is not None:
        wanted = {}
        for k, begin in places:
            wanted.setdefault(k, []).append(begin)
    for k, most in enumerate(attainable(here, index)):
        most += 1e-9  # sums in another order
        if not (most >= enough and index.key_words[k] <= here or any_score and most > best):
            continue
        if at is None:
            at = {}
            for i, w in enumerate(words):
                if w in index.rare_words:
                    at.setdefault(w, []).append(i)
        for begin in candidates(at, index.rare[k]) if wanted is None else wanted.get(k, ()):
            score, lo, hi = align(words, index.words[k], index.idf, begin)
            best = max(best, score)
            if score >= enough and all(find_phrase(words, p, lo, hi) for p in index.keys[k]):
                finds.append((score * index.total[k], score, lo, hi, index.labels[k]))
    out: dict[str, float] = {}
    taken: list[tuple[int, int]] = []
    for _, score, lo, hi, label in sorted(finds, key=lambda f: (-f[0], f[4], f[2])):
        if all(hi <= a or lo >= b for a, b in taken):
            taken.append((lo, hi))
            out[label] = max(out.get(label, 0.0), score)
    return out, best


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """documents -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts every place of a base phrase, first_word and last_word are the smallest and largest word index of
    such places, null without one. labels joins base labels and those of aligned templates; score is the share of a
    template's idf that its best alignment finds in place, 0 without a label: a text that only names a licence scores
    as much of a licence line as it holds. Null and empty texts have no words; repeated rows stay.
    """

    def run(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        index = build_index(templates)
        phrases = [(tuple(words_of(p)), label) for p, label in BASE_PHRASES.items()]
        out = []
        for t in texts:
            words = words_of(t)
            places, base = [], set()
            for phrase, label in phrases:
                if found := find_phrase(words, phrase):
                    places += found
                    base.add(label)
            finds, best = scan(words, index, any_score=bool(base))
            score = best if base else max(finds.values(), default=0.0)
            out.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | finds.keys())), score))
        columns = [pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()))]
        return pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return id_and_text(docs).mapInArrow(in_slices(run), SCHEMA)
