import csv
import json

from inkmesh.operators import graph, stats
from inkmesh.sources import readers, tables, writers


def read(path):
    out = []
    for part in sorted(path.glob("part-*")):
        with open(part, newline="", encoding="utf-8") as f:
            rows = list(csv.reader(f))
        out += rows if not out else rows[1:]
    return out


def test_items(spark, tmp_path):
    nodes = spark.createDataFrame(
        [("a", "Alpha, \"first\"", 0, 0.12345, -2.0, 12.0, 1999.5), ("b", "beta", 0, 1.0, 0.0, 3.25, None), ("c", None, 1, None, 1.0, 7.0, float("nan")), ("d", "delta", None, 0.0, 0.0, 100.0, 2.0)],
        "key string, label string, cluster int, x double, y double, `weight<Docs>` double, avg_year double",
    )
    links = spark.createDataFrame([("a", "b", 2.0), ("a", "c", 1.0)], "a string, b string, w double")
    between = graph.centralities(links.withColumn("s", links.w))
    tables.write_csv(tables.item_table(nodes, links, ("weight<Docs>",), ("avg_year",), between).orderBy("id"), str(tmp_path / "items"))
    head, a, b, c, d = read(tmp_path / "items")
    assert head == "id label cluster cluster_name x y weight<Docs> avg_year degree betweenness participation role".split()
    assert a == ["a", "Alpha, \"first\"", "1", "Alpha, \"first\", beta", "0.123", "-2.000", "12", "1999.5", "2", "1", "0.444", "peripheral"]
    assert b[2:11] == ["1", "Alpha, \"first\", beta", "1.000", "0.000", "3.25", "", "1", "0", "0"]
    assert c[:2] == ["c", "c"] and c[2:9] == ["2", "c", "", "1.000", "7", "", "1"]
    assert d[2:4] == ["", ""] and d[6:10] == ["100", "2", "0", ""]
    assert tables.item_table(nodes.limit(0), links.limit(0), ("weight<Docs>",)).count() == 0
    assert tables.item_table(nodes, links.limit(0), ("weight<Docs>",)).where("degree <> '0' or betweenness is not null").count() == 0


def test_actors(spark, tmp_path):
    inc = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (3, "z")], "doc long, key string")
    docs = spark.createDataFrame([(1, 2001, 5), (2, 2004, 2), (3, None, 0)], "doc long, year int, cites int")
    tables.write_csv(tables.actor_columns(stats.actor_table(inc, docs)).coalesce(1), str(tmp_path / "actors"))
    assert read(tmp_path / "actors") == [tables.ACTOR_COLUMNS.split(), ["x", "2", "7", "2", "3.5", "2001", "2004"], ["y", "1", "2", "1", "2", "2004", "2004"], ["z", "1", "0", "0", "0", "0", "0"]]


def test_sweep(spark):
    rows = [(0.5, s, q, k, c) for s, q, cs in ((7, 2.0, (0, 0, 0, 0)), (9, 3.0, (0, 0, 0, 1))) for k, c in enumerate(cs)]
    rows += [(1.25, s, 1.23456, k, c) for s in (7, 9) for k, c in enumerate((0, 0, 1, 2))]
    runs = spark.createDataFrame(rows, "resolution double, seed long, quality double, key int, cluster int")
    got = [tuple(r) for r in tables.sweep_columns(runs, graph.stability(runs)).collect()]
    assert got == [("0.5", 2, 1, 2, "2", "0", "1"), ("1.25", 3, 3, 3, "1.2346", "1", "0.5")]
    one = runs.where("seed = 7")
    assert [r["mean_ari"] for r in tables.sweep_columns(one, graph.stability(one)).collect()] == ["1", "1"]


def test_best_resolution(spark):
    best = lambda *rows, base=1.0: [r[0] for r in graph.best_resolution(spark.createDataFrame(list(rows), "resolution double, clusters double, mean_ari double"), base).collect()]
    assert best((0.2, 1.0, 1.0), (0.5, 4.0, 0.8), (1.0, 5.0, 0.795), (2.0, 9.0, 0.804)) == [1.0]
    assert best((0.5, 4.0, 0.8), (1.0, 5.0, 0.6), (2.0, 9.0, 0.82)) == [2.0]
    assert best((0.5, 4.0, 0.8), (2.0, 9.0, 0.8), base=1.5) == [2.0] and best((0.5, 1.4, 0.9)) == []


def test_works(spark, tmp_path):
    works = [(k % 3, k, json.dumps({"id": f"W{k}", "title": 'A "quoted", [bracketed]\nline'})) for k in range(500)] + [(0, 3, None), (1, 1, json.dumps({"id": "W1", "title": "twice"}))]
    df = spark.createDataFrame(works, "query int, position long, work string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be one file
    try:
        tables.write_works(df, str(tmp_path / "w"), 'one; "two"', "saved pages")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "w").glob("part-*"))
    got = json.loads("".join(p.read_text() for p in parts))
    assert len(parts) > 1 and list(got) == ["query", "source", "count", "results"]
    assert (got["query"], got["source"], got["count"]) == ('one; "two"', "saved pages", 501)
    assert [w["id"] for w in got["results"]] == ["W%d" % k for _, k, _ in sorted((w for w in works if w[2]), key=lambda w: w[:2])]
    tables.write_works(df.limit(0), str(tmp_path / "none"), "q")
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*"))))["results"] == []


def test_record_columns(spark, tmp_path):
    text = "PT J\nAU Okonkwo, MT\nAF Okonkwo, Maria T.\nTI Nets\nSO J NETS\nPU Ash\nLA English\nDT Article\nPY 2011\nUT X:1\nER\n"
    (tmp_path / "a.txt").write_text(text)
    recs = readers.read_records(spark, str(tmp_path / "a.txt"))
    table = writers.scopus_table(recs)
    assert len(table.columns) == 18 and table.columns[:3] == ["Authors", "Author full names", "Title"] and table.columns[-4:] == ["Document Type", "Language of Original Document", "Publisher", "EID"]
    row = table.first()
    assert row["Authors"] == "Okonkwo, MT" and row["Publisher"] == "Ash" and row["Language of Original Document"] == "English"
