import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmesh.operators import cleaning, graph, match, network, similarity, stats, units
from inkmesh.plans.components import connected_components
from inkmesh.plans.spec import MapSpec, catalogue
from inkmesh import schema


def records(spark, rows):
    full = [{f: None for f in schema.RECORDS.fieldNames()} | {"rec_id": i, "cites": 0} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[f] for f in schema.RECORDS.fieldNames()) for r in full], schema.RECORDS)


def test_catalogue():
    assert len(catalogue()) == 20
    with pytest.raises(ValueError):
        MapSpec("coauthorship", "terms")
    assert MapSpec(unit="terms").minimum == 10 and MapSpec("cocitation", "refs").minimum == 20


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_greedy_duplicates(spark):
    long = "A sufficiently long title number "
    rows = [{"doi": "10.1/a", "title": long + "one"}, {"doi": "10.1/b", "title": long + "one"}, {"doi": "10.1/b", "title": long + "three"}, {"title": "short"}, {"title": "short"}]
    assert sorted(r["rec_id"] for r in match.deduplicate(records(spark, rows)).collect()) == [0, 2, 3, 4]
    rng = random.Random(3)
    many = [{"doi": f"10.1/{rng.randrange(60)}" if rng.random() < 0.7 else None, "title": long + str(rng.randrange(60))} for _ in range(160)]
    dois, titles, kept = set(), set(), []
    for i, r in enumerate(many):
        if (r["doi"] and r["doi"] in dois) or r["title"] in titles:
            continue
        kept.append(i)
        titles.add(r["title"])
        if r["doi"]:
            dois.add(r["doi"])
    assert sorted(r["rec_id"] for r in match.deduplicate(records(spark, many)).collect()) == kept


def test_strict_matching_rejects_ambiguity(spark):
    cited = {"authors": ["Smith, J"], "year": 2000, "volume": "5", "pages": "10-20"}
    ref = "Smith J, 2000, SOME J, V5, P10"
    one = records(spark, [cited, {"refs": [ref]}])
    two = records(spark, [cited, cited, {"refs": [ref]}])
    assert [tuple(r) for r in match.match_refs_strict(one).collect()] == [(1, 0)]
    assert match.match_refs_strict(two).count() == 0
    assert [tuple(r) for r in match.match_refs_first(two).collect()] == [(2, 0)]


def test_maps_of_all_kinds(spark):
    rng = random.Random(5)
    words = ["graph theory", "deep learning", "text mining", "bibliometrics", "citation analysis", "networks"]
    rows = [{"title": f"{rng.choice(words)} {rng.choice(words)} methods {i}", "abstract": " ".join(rng.sample(words, 3)), "authors": rng.sample(["Lee, J", "Smith, A", "Petrov, B", "Doe, J"], 2), "keywords": rng.sample(words, 3), "index_terms": rng.sample(words, 2), "source": rng.choice(["J Sci", "J Art"]), "affiliations": rng.sample(["Univ A", "Inst B", "Lab C"], 2), "countries": rng.sample(["France", "Spain", "Italy"], 2), "year": 2000 + i % 5, "cites": i, "doi": f"10.1/{i}", "refs": [f"Lee J, 1999, J REF, V{rng.randrange(3)}, P1", f"Doe J, 1998, J OLD, V2, P{rng.randrange(3)}", f"X Y, 2001, Q, DOI 10.1/{max(0, i - 1 - rng.randrange(3))}"]} for i in range(40)]
    recs = records(spark, rows)
    for analysis, unit in catalogue():
        _, _, pairs = network.raw_pairs(recs, MapSpec(analysis, unit, min_count=1))
        assert dict(pairs.dtypes) == {"a": "string", "b": "string", "w": "double"}, (analysis, unit)
    for analysis, unit in (("cooccurrence", "terms"), ("citation", "authors"), ("coupling", "documents")):
        nodes, links = network.build_map(recs, MapSpec(analysis, unit, min_count=1, largest=False))
        assert set(nodes.columns) >= {"key", "label", "links", "total_link_strength"} and nodes.count() >= 2 and links.count() >= 1, (analysis, unit)
    with pytest.raises(ValueError):
        network.build_map(recs.limit(0))
    with pytest.raises(ValueError):
        network.build_map(recs, MapSpec(min_count=10_000))


def test_cooccurrence_against_brute_force(spark):
    rng = random.Random(7)
    docs = {d: rng.sample("abcdefg", rng.randrange(1, 6)) for d in range(60)}
    inc = spark.createDataFrame([(d, k) for d, ks in docs.items() for k in ks], "doc long, key string")
    want: dict = {}
    for ks in docs.values():
        for a, b in itertools.combinations(sorted(ks), 2):
            want[a, b] = want.get((a, b), 0) + 1 / (len(ks) - 1)
    got = {(r["a"], r["b"]): r["w"] for r in network.cooccurrence(inc, fractional=True).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    fast = {r["key"]: r["tls"] for r in network.strength_without_pairs(inc, fractional=True).collect()}
    slow = {r["key"]: r["tls"] for r in network.total_link_strength(network.cooccurrence(inc, fractional=True)).collect()}
    assert all(abs(fast[k] - slow[k]) < 1e-9 for k in slow)


def test_thesaurus_and_exclusions(spark):
    recs = records(spark, [{"keywords": ["Graphs", "nets", "noise", "x"]}])
    th = spark.createDataFrame([("nets", "Networks"), ("noise", "")], "key string, replace_by string")
    got = {(r["key"], r["label"]) for r in units.incidence(recs, "keywords", th).collect()}
    assert got == {("graphs", "Graphs"), ("networks", "Networks")}
    ex = spark.createDataFrame([("graphs",)], "key string")
    assert [r["key"] for r in units.incidence(recs, "keywords", th, ex).collect()] == ["networks"]


def test_g_and_h(spark):
    rng = random.Random(2)
    for n in (0, 1, 7, 60):
        c = sorted((rng.randrange(30) for _ in range(n)), reverse=True)
        h = max([i for i in range(1, n + 1) if c[i - 1] >= i], default=0)
        g = max([i for i in range(1, n + 1) if sum(c[:i]) >= i * i], default=0)
        df = spark.createDataFrame([(x, 1) for x in c], "cites int, one int")
        assert stats.g_index(df).first()["g"] == g
        if n:
            assert stats.h_index(df, ["one"]).first()["h"] == h


def test_bursts_against_a_plain_automaton(spark):
    rng = random.Random(4)
    years = range(2000, 2010)
    d = {y: rng.randrange(20, 30) for y in years}
    docs, inc, n = [], [], 0
    for y in years:
        for k in range(d[y]):
            docs.append((n, y, 0))
            for t, p in (("a", 0.8 if 2003 <= y <= 2005 else 0.1), ("b", 0.3), ("c", 0.05)):
                if rng.random() < p:
                    inc.append((n, t))
            n += 1
    want = {}
    for t in "abc":
        r = {y: sum(1 for i, k in inc if k == t and docs[i][1] == y) for y in years}
        total, all_ = sum(r.values()), sum(d.values())
        if total < 3:
            continue
        p = (total / all_, min(0.9999, 2 * total / all_))
        cost = {(y, s): -(r[y] * np.log(p[s]) + (d[y] - r[y]) * np.log(1 - p[s])) for y in years for s in (0, 1)}
        best = None
        for path in itertools.product((0, 1), repeat=len(years)):
            c = sum(cost[y, s] for y, s in zip(years, path)) + np.log(len(years)) * sum(b > a for a, b in zip((0, *path), path))
            if best is None or c < best[0] - 1e-9:
                best = (c, path)
        runs = []
        for s, group in itertools.groupby(zip(years, best[1]), key=lambda x: x[1]):
            if s:
                ys = [y for y, _ in group]
                runs.append((sum(cost[y, 0] - cost[y, 1] for y in ys), ys[0], ys[-1]))
        if runs and max(runs)[0] > 0:
            want[t] = max(runs)
    got = {r["key"]: (r["strength"], r["start"], r["end"]) for r in stats.bursts(spark.createDataFrame(inc, "doc long, key string"), spark.createDataFrame(docs, "doc long, year int, cites int"), least=3).collect()}
    assert got.keys() == want.keys() and "a" in got
    for t in want:
        assert got[t][1:] == want[t][1:] and abs(got[t][0] - want[t][0]) < 1e-6


def test_clusters_layout_and_metrics(spark):
    edges = [(f"{g}{i}", f"{g}{j}", 3.0) for g in "abc" for i, j in itertools.combinations(range(5), 2)] + [("a0", "b0", 1.0), ("b1", "c1", 1.0)]
    links = network.normalise(spark.createDataFrame(edges, "a string, b string, w double"))
    best = {r["key"]: r["cluster"] for r in graph.best_clusters(graph.cluster(links, seeds=3)).collect()}
    assert len(best) == 15 and all(len({best[f"{g}{i}"] for i in range(5)}) == 1 for g in "abc") and len(set(best.values())) == 3
    nodes = spark.createDataFrame(list(best.items()), "key string, cluster int")
    q = graph.partition_quality(nodes, links).first()
    assert q["modularity"] > 0.5
    s = graph.stability(graph.cluster(links, (1.0,), seeds=3)).first()
    assert s["mean_ari"] == 1.0
    xy = graph.place(links, starts=2).collect()
    pos = {r["key"]: np.array([r["x"], r["y"]]) for r in xy}
    near = np.mean([np.linalg.norm(pos["a1"] - pos[f"a{i}"]) for i in range(2, 5)])
    assert near < np.linalg.norm(pos["a1"] - pos["c4"])
    b = {r["key"]: r["betweenness"] for r in graph.centralities(links).collect()}
    assert max(b, key=b.get) in ("b0", "b1") and b["a4"] == 0
    sizes = graph.network_summary(nodes, links).first()
    assert (sizes["components"], sizes["isolated"]) == (1, 0)
    role = {r["key"]: r["participation"] for r in graph.roles(nodes, links).collect()}
    assert role["a4"] == 0 and role["b0"] > 0


def test_main_path_counts(spark):
    # 1 <- 2 <- 4, 1 <- 3 <- 4, 4 <- 5: two paths, all through 4-5
    edges = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (1, 5)], "citing long, cited long")
    years = spark.createDataFrame([(i, 2000 + i) for i in range(1, 6)], "doc long, year int")
    spc = {(r["citing"], r["cited"]): round(r["spc"], 6) for r in graph.path_counts(edges, years).collect()}
    assert spc == {(2, 1): 0.5, (3, 1): 0.5, (4, 2): 0.5, (4, 3): 0.5, (5, 4): 1.0}
    path = [(r["cited"], r["citing"]) for r in graph.main_path(graph.path_counts(edges, years), years).orderBy("step").collect()]
    assert path == [(1, 2), (2, 4), (4, 5)]


def test_similarity(spark):
    tok = F.split("text", " ")
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b d"), (3, "x y z"), (4, "")], "doc long, text string")
    seeds = spark.createDataFrame([(1, "a b c")], "doc long, text string")
    s = {r["doc"]: r["score"] for r in similarity.similarity_to_seeds(docs, seeds, tok).collect()}
    assert abs(s[1] - 1) < 1e-9 and 0 < s[2] < 1 and s[3] == 0 and s[4] <= 1e-9
    ranked = similarity.rerank(similarity.similarity_to_seeds(docs, seeds, tok), seeds, most=1, least=0.05).orderBy("rank").collect()
    assert [r["doc"] for r in ranked] == [1, 2]


def test_variants(spark):
    rows = [("co word analysis", "co-word analysis", 5), ("coword analysis", "coword analysis", 9), ("bibliometrics", "bibliometrics", 4), ("bibliometrcs", "bibliometrcs", 1), ("dataset 10", "dataset 10", 1), ("dataset 11", "dataset 11", 1)]
    counts = spark.createDataFrame(rows, "key string, label string, n long")
    g = cleaning.variant_groups(counts).collect()
    assert len(g) == 1 and g[0]["target"] == "coword analysis"
    assert sorted(tuple(r) for r in cleaning.typo_pairs(counts).collect()) == [("bibliometrcs", "bibliometrics"), ("co word analysis", "coword analysis")]
    th = cleaning.merge_terms(spark.createDataFrame([], "key string, replace_by string"), cleaning.variant_groups(counts))
    assert [tuple(r) for r in th.collect()] == [("co word analysis", "coword analysis")]


def test_unit_coupling_needs_no_document_pairs(spark):
    rng = random.Random(1)
    refs = spark.createDataFrame([(rng.randrange(40), rng.randrange(12)) for _ in range(200)], "doc long, ref long")
    inc = spark.createDataFrame([(rng.randrange(40), rng.choice("abcde")) for _ in range(90)], "doc long, key string")
    for fractional in (False, True):
        slow, fast = (
            {(r.a, r.b): round(r.w, 6) for r in df.collect()}
            for df in (network.unit_links(network.coupling(refs, fractional=fractional), inc, fractional), network.coupling_units(refs, inc, fractional=fractional))
        )
        assert slow == fast


def test_token_rows_are_the_token_arrays(spark):
    from inkmesh.functions.terms import similarity_token_rows, similarity_tokens

    df = spark.createDataFrame([(1, "Graph Neural Networks of large-scale data -x 12 studies classified optimization"), (2, ""), (3, None), (4, "été naïve 2020 test")], "doc long, text string")
    a, b = df.select("doc", F.explode(similarity_tokens(F.col("text"))).alias("token")), similarity_token_rows(df)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
