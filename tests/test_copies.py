"""Queries over the star tables twice, with shifted keys, so that their networks fall into two parts."""

import duckdb
import pytest

from inkmesh import queries, record_queries

DATA = "/root/testdata/sf0.001"
KEYS = {"orders": ("o_orderkey", "o_custkey"), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "lineitem": ("l_orderkey", "l_partkey", "l_suppkey")}
NAMES = {"customer": "c_name", "supplier": "s_name"}


@pytest.fixture(scope="module")
def twice(tmp_path_factory):
    d, c = tmp_path_factory.mktemp("twice"), duckdb.connect()
    for t, keys in KEYS.items():
        moved = [f"{k} + x * 1000000 AS {k}" for k in keys] + [f"{n} || CASE x WHEN 1 THEN 'b' ELSE '' END AS {n}" for n in [NAMES.get(t)] if n]
        c.sql(f"COPY (SELECT * REPLACE ({', '.join(moved)}) FROM '{DATA}/{t}.parquet', (VALUES (0), (1)) v(x)) TO '{d}/{t}.parquet' (FORMAT parquet)".replace("SELECT *", "SELECT * EXCLUDE (x)"))
    c.sql(f"COPY (FROM '{DATA}/nation.parquet') TO '{d}/nation.parquet' (FORMAT parquet)")
    for t in (*KEYS, "nation"):
        c.sql(f"CREATE VIEW {t} AS FROM '{d}/{t}.parquet'")
    return str(d), c


def same(spark, twice, name):
    d, c = twice
    all_of = queries.QUERIES | record_queries.QUERIES
    got, want = all_of[name](spark, d).toPandas(), c.sql((queries.ORACLE_SQL | record_queries.ORACLE_SQL)[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(want)
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


@pytest.mark.parametrize("name", ["map_author_nodes", "map_author_links", "map_cocited_nodes", "map_cocited_links"])
def test_maps_of_two_components(spark, twice, name):
    same(spark, twice, name)


@pytest.mark.parametrize("name", ["map_coupling_nodes", "map_coupling_links", "map_citation_nodes", "map_citation_links", "matched_strictly", "matched_first", "country_tops"])
def test_records_of_two_components(spark, twice, name):
    same(spark, twice, name)


def test_maps_make_no_pairs_of_all_items(spark, monkeypatch):
    """Strengths come from documents, so only the items of the map are paired."""
    from inkmesh.operators import network
    from inkmesh.plans.spec import MapSpec

    found = record_queries.records(spark, DATA, *network.columns_of(MapSpec("coauthorship", "authors")))
    assert set(found.columns) == {"rec_id", "year", "cites", "authors"}
    staged = []
    monkeypatch.setattr(network, "stage", lambda df, name="t": staged.append(name) or df)
    network.build_map(found, MapSpec("coauthorship", "authors", max_items=3, largest=False), labels=False)
    assert "pairs" not in staged


def test_missing_keys_of_references_meet_nowhere(spark):
    """A reference without a DOI is no row of the join: all of them would have gone to one task."""
    from inkmesh.operators import match

    recs = spark.createDataFrame([(0, "10.1/a", ["Fell, A"], 1980, "1", "9", []), (1, None, ["Bo, C"], 1990, "2", "7", ["Fell A, 1980, J SETS, V1, P9", "Nobody", "X, DOI 10.1/a"])], "rec_id long, doi string, authors array<string>, year int, volume string, pages string, refs array<string>")
    assert [tuple(r) for r in match.match_refs_strict(recs).collect()] == [(1, 0)]
    plan = match.match_refs_strict(recs)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan


def test_parsed_table_is_the_expression(spark):
    from inkmesh.functions import refs as R

    rows = ["Fell A, 1980, J SETS, V1, P9", "Bo, C. (1999a). A title, J Nets, 12(3), pp. 33-40", "", None, "  O'Neil-Smith JR, 2001, V3, P4, DOI https://doi.org/10.1/X. ", "1984", "Anon, 1850, NATURE", "Ørsted H C, 1820, ANN, P273"]
    df = spark.createDataFrame([(r,) for r in rows], "ref string")
    assert R.parsed(df, "ref").select("p").collect() == df.select(R.ref_parse(df.ref).alias("p")).collect()


def test_coupling_of_documents_shuffles_lists(spark, twice):
    import pyarrow as pa
    import numpy as np

    from inkmesh.operators import network

    rng = np.random.default_rng(2)
    rows = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 300, 3000), rng.zipf(1.5, 3000) % 60)})
    df = spark.createDataFrame(rows, "doc long, ref long")
    for fractional in (False, True):
        of, want = {}, {}
        for doc, ref in rows:
            of.setdefault(ref, []).append(doc)
        for docs in of.values():
            for i, a in enumerate(docs):
                for b in docs[i + 1 :] if 2 <= len(docs) <= 200 else ():
                    want[a, b] = want.get((a, b), 0) + (1 / (len(docs) - 1) if fractional else 1)
        made = network.coupling(df, 200, fractional)
        got = {(r["a"], r["b"]): r["w"] for r in made.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # what is shuffled by document are lists; a row a pair was joined and then aggregated before
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" in plan and not any("(ref" in x and "Join Inner" in x and "(a" in x for x in plan.splitlines())
    batches = [pa.RecordBatch.from_pydict({"a": a, "f": [1.0] * len(a), "bs": b}) for a, b in (([1, 2], [[2, 3], [3]]), ([2, 2], [[3, 4], [4]]), ([5], [[6]]))]
    out = [x for y in network._shared(iter(batches)) for x in y.to_pylist()]
    assert sorted((r["a"], r["b"], r["w"]) for r in out) == [(1, 2, 1.0), (1, 3, 1.0), (2, 3, 2.0), (2, 4, 2.0), (5, 6, 1.0)]
    same(spark, twice, "coupling_documents")


def test_tops_of_countries_read_what_they_need(spark, monkeypatch):
    from inkmesh.operators import geo

    staged = []
    monkeypatch.setattr(record_queries, "stage", lambda df, name="t": staged.append(set(df.columns)) or df)
    got = record_queries.country_tops(spark, DATA)
    assert staged == [{"rec_id", "countries", "keywords", "authors", "source", "affiliations"}] and "label" not in got.columns
    found = record_queries.records(spark, DATA, *sorted(staged[0])).where("rec_id < 200")
    assert sorted(geo.country_tops(found).drop("label").collect()) == sorted(geo.country_tops(found, labels=False).collect())
