from pyspark.sql import functions as F

from inkmesh import schema
from inkmesh.operators import match
from inkmesh.operators.network import build_map
from inkmesh.sources import readers, samples, writers


def mulberry32(seed, n):
    out, a = [], seed
    for _ in range(n):
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((a ^ (a >> 15)) * (a | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        out.append((t ^ (t >> 14)) / 4294967296.0)
    return out


def test_draws(spark):
    for seed in (1, 4242, 0xFFFFFFFF):
        got = [r[0] for r in spark.range(500).select(samples.draw(seed, F.col("id")).alias("u")).collect()]
        assert got == mulberry32(seed, 500)


def test_records(spark, tmp_path):
    recs = samples.sample_records(spark, 140)
    assert recs.schema.simpleString() == schema.RECORDS.simpleString()
    rows = recs.collect()
    assert len(rows) == 140 and {r.year for r in rows} == set(range(2016, 2025)) and len({r.source for r in rows}) == 4
    assert all(1 <= len(r.authors) <= 3 and 1 <= len(r.countries) <= 3 and 0 <= r.cites < 220 and 1 <= len(r.refs) <= 11 for r in rows)
    assert 0.55 < sum(r.doi is not None for r in rows) / 140 < 0.85
    assert samples.sample_records(spark, 200, parts=7).where("rec_id < 140").orderBy("rec_id").collect() == rows
    assert samples.sample_records(spark, 140, seed=777).collect() != rows and samples.sample_records(spark, 0).count() == 0
    edges = match.match_refs_strict(recs).collect()
    inner = sum(", CLASSICS," not in x for r in rows for x in r.refs)
    assert len(edges) == inner > 100 and all(e["cited"] < e["citing"] for e in edges)
    writers.write_records(recs.coalesce(1), str(tmp_path / "wos"), "wos")
    back = readers.read_wos(spark, str(tmp_path / "wos"))
    assert sorted((r.title, r.year, r.cites, r.doi, tuple(r.keywords), len(r.refs)) for r in back.collect()) == sorted((r.title, r.year, r.cites, r.doi, tuple(r.keywords), len(r.refs)) for r in rows)
    nodes, links = build_map(back)
    assert nodes.count() >= 30 and links.count() > 50


def test_many_records(spark):
    many = samples.sample_records(spark, 100_000, parts=16)
    assert many.rdd.getNumPartitions() == 16
    got = many.agg(F.count_distinct("key").alias("n"), F.avg("cites").alias("c"), F.avg(F.col("doi").isNotNull().cast("int")).alias("d")).first()
    assert got["n"] == 100_000 and abs(got["c"] - 220 / 3.3) < 2 and abs(got["d"] - 0.7) < 0.01
