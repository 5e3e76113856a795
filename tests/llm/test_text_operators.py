import hashlib
import random
import unicodedata
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import xxhash

from inkmesh.llm import fingerprint, licenses, packing, pieces, queries, rules, simhash, token_counts

DATA = "/root/testdata/sf0.001"
ALPHABET = [chr(c) for c in [*range(127), 32, 32, 10, 10, *range(160, 256), 0x300, 0x301, 0x3A3, 0x3C2, 0x130, 0x2028, 0x4E2D, 0x1F600, 0x85, 0x1C]]


def noise(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(n)] + ["", "   ", "a <|endoftext|> b", "x<|endoftext|>y"]


def texts():
    return pq.read_table(f"{DATA}/documents.parquet", columns=["text"])["text"].to_pylist()[:100]


def odd(spark):
    return spark.createDataFrame([(1, None, "s", 1), (2, "", "s", 2), (None, "a b c", None, 3), (3, "w " * 30_000, "z", 4), (3, "w " * 30_000, "z", 4)], "doc_id long, text string, source string, fp int")


def test_word_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path(packing.WORD_VOCABULARY)
    whole, own = Tokenizer.from_file(path), packing.WordEncoder(path)
    some = noise(1500, 1) + texts()
    for t, got in zip(some, own.encode(some)):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_best_fit_against_a_plain_search():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = rng.integers(1, 65, rng.integers(1, 200))
        bins, offsets, n = packing.best_fit_decreasing(lengths, 64)
        left, want = [], {}
        for i in np.argsort(-lengths, kind="stable"):
            fits = [(c, b) for b, c in enumerate(left) if c >= lengths[i]]
            if fits:
                c = min(fits)[0]
            else:
                left.append(64)
                c = 64
            b = next(b for b, x in enumerate(left) if x == c)
            left[b] -= lengths[i]
            want[i] = c
        assert n == len(left)  # the same choice of remaining capacity at every step gives the same number of bins
        assert [64 - offsets[i] for i in want] == list(want.values())
        assert max(np.bincount(bins, lengths)) <= 64


def test_packing_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    x = packing.pack_documents(docs, group_rows=100).toPandas()
    n = x.groupby("doc_id").length.sum()
    assert len(n) == docs.count() and (x.start == x.sort_values(["doc_id", "piece"]).groupby("doc_id").length.cumsum() - x.length).all()
    s = x.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id").length.cumsum() - s.length == s.offset).all() and s.groupby("sequence_id").length.sum().max() <= 2048
    assert x.sequence_id.nunique() <= 1.02 * x.length.sum() / 2048 + 4
    got = packing.pack_documents(odd(spark)).toPandas()
    assert (got[got.doc_id.isin([1, 2])].length == 1).all() and packing.pack_documents(odd(spark).limit(0)).count() == 0


def test_simhash_and_components(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    x = simhash.near_duplicates(docs).toPandas()
    by = dict(zip(docs.toPandas().doc_id, docs.toPandas().text))

    def plain(t):
        w = t.encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in h) > len(h)) if h else 0

    assert all(plain(by[d]) == f % (1 << 64) for d, f in zip(x.doc_id, x.fp))
    kept = simhash.keep_one(docs)
    assert kept.count() == x.component_id.nunique() and kept.columns == docs.columns
    got = {r["doc_id"]: r for r in simhash.near_duplicates(odd(spark)).collect()}
    assert got[1]["fp"] == got[2]["fp"] == 0 and got[2]["component_id"] == 1
    assert simhash.near_duplicates(odd(spark).limit(0)).count() == 0


def test_anchor_links_lose_none(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False))) for b in base for _ in range(20)]
    fps = np.unique(np.array([*base, *near], np.uint64))
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, f in enumerate(fps):
        for g in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ f) <= 3]:
            root[find(int(g))] = find(int(f))
    frame = spark.createDataFrame([(int(f.view(np.int64)),) for f in fps], "fp long")
    for hot in (1024, 3):
        edges = [(r.a, r.b) for r in simhash.link_fingerprints(frame, hot=hot).collect()]
        assert all(bin((a ^ b) % (1 << 64)).count("1") <= 3 for a, b in edges)
        own = {int(f): int(f) for f in fps}

        def top(x):
            while own[x] != x:
                x = own[x]
            return x

        for a, b in edges:
            own[top(a % (1 << 64))] = top(b % (1 << 64))
        groups = lambda r, f: sorted(sorted(int(x) for x in fps if f(int(x)) == c) for c in {f(int(x)) for x in fps})
        assert groups(own, top) == groups(root, find)


def test_crowded_anchors_are_split(spark):
    rng = np.random.default_rng(1)
    home = np.uint64(0)  # the zero codeword: these all meet at one anchor of the lower half
    low = np.array([sum(1 << int(k) for k in rng.choice(31, 2, replace=False)) for _ in range(20_000)], np.uint64)
    fps = np.unique(home ^ low ^ (rng.integers(0, 1 << 32, 20_000, dtype=np.uint64) << np.uint64(32))).view(np.int64)
    key, one, held = np.zeros(len(fps), np.int64), np.ones(len(fps), bool), np.full(len(fps), 0xFFFFFFFF)
    again = simhash.split(key, fps, one, held, np.zeros(len(fps), np.int32))
    assert len(again[0]) == 4 * len(fps) and np.unique(again[0], return_counts=True)[1].max() < 1000
    third = simhash.split(*again)
    assert len(third[0]) == 16 * len(fps) and np.unique(third[0], return_counts=True)[1].max() < 40
    frame = spark.createDataFrame([(int(f),) for f in fps[:6000]], "fp long")
    want = {(int(a), int(b)) for k, a in enumerate(fps[:6000]) for b in fps[:6000][np.bitwise_count((fps[:6000] ^ a).view(np.uint64)) <= 3] if a < b}
    root = {int(f): int(f) for f in fps[:6000]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    got = [(r.a, r.b) for r in simhash.link_fingerprints(frame).collect()]
    assert set(got) <= want
    for a, b in got:
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for a, b in want)


def test_fingerprints(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    x = fingerprint.edited_fingerprints(docs).toPandas().sort_values("doc_id", ascending=False).reset_index(drop=True)
    p = docs.toPandas().sort_values("doc_id", ascending=False).reset_index(drop=True)
    assert (x.doc_id == p.doc_id).all()
    canon = lambda t: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())
    for i, t in enumerate(p.text):
        k = len(t) // 3
        edited = t[: len(t) - k] + p.text[(i + 1) % len(p)][:k]
        assert x.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest() and x.n_chars[i] == len(t)
        assert x.near_edited[i] == float(canon(t) == canon(edited)) and x.near_next[i] == float(canon(t) == canon(p.text[(i + 1) % len(p)]))
    groups = {}
    for d, t in zip(p.doc_id, p.text):
        groups[canon(t)] = min(d, groups.get(canon(t), d))
    assert [groups[canon(t)] for t in p.text] == x.group_id.tolist()
    assert x.groupby("fingerprint").group_id.nunique().max() == 1


def test_fingerprints_of_odd_rows_and_small_groups(spark):
    got = fingerprint.edited_fingerprints(odd(spark)).collect()
    assert len(got) == 5 and fingerprint.edited_fingerprints(odd(spark).limit(0)).count() == 0
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1
    one = spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")
    assert fingerprint.edited_fingerprints(one).first().edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    rows = [(i * i * 37 % 10_007, f"{i} text {i}") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    nxt = {r.doc_id: r.next_text for r in fingerprint.with_next(frame, ["text"], group_rows=20).collect()}
    order = sorted(rows, reverse=True)
    assert nxt == {d: order[(k + 1) % len(order)][1] for k, (d, _) in enumerate(order)}
    forms = spark.createDataFrame([(1, "É  a ß"), (2, "é A SS"), (3, "e a ss")], "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in fingerprint.exact_groups(forms).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id: r.group_id for r in fingerprint.exact_groups(forms, small=0).collect()} == {1: 1, 2: 1, 3: 3}


def test_rules(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.sql(rules.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.op9_quality_rules(spark, DATA).toPandas().sort_values("doc_id").reset_index(drop=True)[want.columns]
    assert all((got[c] == want[c]).all() for c in want.columns) and len(got) == len(want)
    x = rules.quality_rules(odd(spark)).collect()
    assert len(x) == 5 and {(r.n_words, r.n_repeat_words) for r in x if r.doc_id == 3} == {(30_000, 30_000)} and all(r.base_failed for r in x)
    assert rules.quality_rules(odd(spark).limit(0)).count() == 0
    hosts = [(i, "bad" if i < 200 else f"h{i % 20}", i < 190) for i in range(1000)] + [(1000, "one", True)]
    kept = {r.host: r.host_kept for r in rules.host_verdicts(spark.createDataFrame(hosts, "doc_id long, host string, base_failed boolean")).collect()}
    assert not kept["bad"] and kept["h3"]


def test_licences(spark):
    t = [(1, "Released under the MIT License. x MIT license"), (2, "Licensed under CC BY-NC 4.0."), (3, "Licensed under the Apache License, Version 2.0."), (4, "no licence"), (5, "GNU General Public Licence"), (6, "general  PUBLIC-license"), (7, "MITİ license")]
    x = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(t, "doc_id long, text string")).collect()}
    assert (x[1].n_base, x[1].first_word, x[1].last_word, x[1].base_labels, x[1].labels) == (2, 3, 6, "mit", "mit")
    assert (x[2].n_base, x[2].first_word, x[2].labels) == (0, None, "cc-by-nc-4.0") and x[3].labels == "apache,apache-2.0"
    assert (x[4].labels, x[4].score) == ("", 0.0) and x[5].n_base == 0 and x[6].base_labels == "gpl" and x[7].n_base == 0
    assert licenses.license_scan(odd(spark)).count() == 5 and licenses.license_scan(odd(spark).limit(0)).count() == 0


def test_sections(spark):
    enc = token_counts.SpanEncoder(token_counts.tokenizer_path(token_counts.VOCABULARY))
    some = noise(1500, 2) + texts()
    for t, got in zip(some, enc.lengths(some)):
        assert got.tolist() == [enc.size[i] for i in enc.encoding.encode_ordinary(t)]
    frame = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    for rule in token_counts.RULES:
        x = token_counts.section_tokens(frame, rule=rule).toPandas()
        assert x.groupby("doc_id").n_tokens.sum().tolist() == [len(l) for l in enc.lengths(some)]
        lines = {d: "".join(some[d][s:e] for s, e in zip(g.start, g.end)) for d, g in x.sort_values("section").groupby("doc_id")}
        assert all(lines[d] == t for d, t in enumerate(some))
    n, across = token_counts.allocate(np.array([3, 4, 2]), np.array([0, 2, 8]), "most")
    assert n.tolist() == [1, 2, 0] and across.tolist() == [1, 1, 0]
    n, _ = token_counts.allocate(np.array([3, 4, 2]), np.array([0, 2, 8]), "last")
    assert n.tolist() == [0, 2, 1]
    two = spark.createDataFrame([(1, "a title", None), (2, None, "body text")], "doc_id long, title string, body string")
    f = {(r.doc_id, r.field): r.n_tokens for r in token_counts.field_tokens(two, ["title", "body"]).collect()}
    assert f[1, "title"] == 3 and f[2, "body"] == 2
    assert token_counts.section_tokens(odd(spark)).where("n_tokens = 0").count() == 2 and token_counts.section_tokens(odd(spark).limit(0)).count() == 0


def test_segmentations(spark):
    coder = pieces.PieceCoder(pieces.tokenizer_path(pieces.VOCABULARY), 3)
    some = noise(600, 3) + texts()
    encoded = coder.encode(some)
    assert all(coder.decode(ids) == t for t, best in zip(some, encoded) for _, ids in best)
    assert all(len({i for _, i in best}) == len(best) and [s for s, _ in best] == sorted([s for s, _ in best], reverse=True) for best in encoded)
    rng = random.Random(5)
    runs = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 200))) for letters in ("a", "ab", "-=", "_", "=", "the ", "éx中", "ab1 \n") * 12]
    for t in [x[:40] for x in some if x][:150] + runs:
        marked = pieces.SPACE + t.replace(" ", pieces.SPACE)
        every = [[0.0]]  # the three best scores of every place, by plain dynamic programming over all pieces
        for j in range(1, len(marked) + 1):
            known = [(i, coder.pieces.get(marked[i:j], (0, coder.unknown if i == j - 1 else None))[1]) for i in range(max(0, j - coder.longest), j)]
            every.append(sorted((v + p for i, p in known if p is not None for v in every[i]), reverse=True)[:3])
        best = coder.encode([t])[0]
        assert np.allclose([s for s, _ in best], every[-1]) and len({i for _, i in best}) == len(best) and all(coder.decode(i) == t for _, i in best)
    x = queries.op10_sentencepiece_nbest(spark, DATA).toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    crc = {d: zlib.crc32(t.encode()) for d, t in zip(docs.doc_id, docs.text)}
    assert all(crc[d] == c for d, c in zip(x.doc_id, x.text_crc32)) and x.doc_id.nunique() == len(docs)
    assert [r.n for r in pieces.decode(pieces.encode(odd(spark), 2)).groupBy("doc_id").count().toDF("doc_id", "n").orderBy("doc_id").collect()][1:] == [1, 1, 4]
    assert pieces.encode(odd(spark).limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        before, kept = kept.count(), step(spark, kept, DATA).cache()
        assert kept.columns == docs.columns and 0 < kept.count() <= before, name
    packed = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}
