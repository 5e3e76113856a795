import json

from pyspark.sql import functions as F

from inkmesh import schema
from inkmesh.operators import match
from inkmesh.sources import readers, writers
from inkmesh.streaming import living, windows

WOS = """FN Export
VR 1.0
PT J
AU Petrov, BA
   Lee, J
TI A study of
   networks
SO J INFORM SCI
DE graph theory; text mining
ID BIBLIOMETRICS
C1 [Petrov, BA] Univ Leeds, Sch Math, Leeds, England.
   [Lee, J] Seoul Natl Univ, Seoul, South Korea.
CR Johnson T, 2010, PATTE RECOG, V54, P118
   Smith J, 1999, J X, V1, P2, DOI 10.1/Z
TC 0
Z9 7
PY 2015
VL 3
BP 11
DI 10.1/ABC
UT WOS:1
ER

PT J
AU Doe, J
TI Second
PY 2016
ER

EF
"""
RIS = "TY  - JOUR\r\nAU  - Petrov, Boris\r\nTI  - A study\r\nPY  - 2015/03\r\nJO  - J Sci\r\nKW  - one; two\r\nKW  - three\r\nN1  - Times cited: 12\r\nDO  - https://doi.org/10.1/X\r\nER  - \r\n\r\nTY  - CONF\r\nA1  - Lee, J\r\nT1  - Other\r\nER  - \r\n"
BIB = '@article{key1,\n  title = {A {Study} of {\\"o}nes},\n  author = {Petrov, Boris and Lee, Jin},\n  year = 2015,\n  journal = "J Sci",\n  keywords = {a; b},\n  note = {cited By 5}\n}\n@misc{k2,\n  title={Second}, year={2016}\n}\n'
OPENALEX = {"results": [{"id": "https://openalex.org/W1", "title": "A study", "publication_year": 2015, "doi": "https://doi.org/10.1/x", "cited_by_count": 4, "type": "article", "primary_location": {"source": {"display_name": "J Sci"}}, "biblio": {"volume": "3", "first_page": "11"}, "authorships": [{"author": {"display_name": "Boris Petrov"}, "institutions": [{"display_name": "Leeds", "country_code": "GB"}]}], "keywords": [{"display_name": "Graphs"}], "concepts": [{"display_name": "Math", "level": 1, "score": 0.5}, {"display_name": "Top", "level": 0, "score": 0.9}], "referenced_works": ["https://openalex.org/W9"], "abstract_inverted_index": {"world": [1], "hello": [0, 2]}}]}


def _write(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(text.encode())
    return str(p)


def test_sniffing():
    assert [readers.sniff(t) for t in (WOS, RIS, BIB, json.dumps(OPENALEX), "PT\tAU\n", "Authors,Title,Year,Source title\n", "id\tlabel\tx\n", "1\t2\t3\n4\t5\t6\n", "??")] == ["wos", "ris", "bibtex", "openalex", "wos_tab", "scopus", "vosviewer_map", "vosviewer_network", ""]


def test_wos(spark, tmp_path):
    a, b = readers.read_records(spark, _write(tmp_path, "a.txt", WOS)).orderBy("rec_id").collect()
    assert (a.title, a.year, a.cites, a.doi, a.volume, a.pages) == ("A study of networks", 2015, 7, "10.1/abc", "3", "11")
    assert a.authors == ["Petrov, BA", "Lee, J"] and a.keywords == ["graph theory", "text mining"] and len(a.refs) == 2
    assert a.countries == ["United Kingdom", "South Korea"] and a.affiliations == ["Univ Leeds", "Seoul Natl Univ"]
    assert b.title == "Second" and b.doi is None and b.refs == []


def test_ris_and_bibtex(spark, tmp_path):
    a, b = readers.read_records(spark, _write(tmp_path, "a.ris", RIS)).orderBy("rec_id").collect()
    assert (a.title, a.year, a.cites, a.doi, a.keywords) == ("A study", 2015, 12, "10.1/x", ["one", "two", "three"]) and b.authors == ["Lee, J"]
    a, b = readers.read_records(spark, _write(tmp_path, "a.bib", BIB)).orderBy("rec_id").collect()
    assert (a.title, a.year, a.cites, a.source, a.authors, a.keywords) == ("A Study of ones", 2015, 5, "J Sci", ["Petrov, Boris", "Lee, Jin"], ["a", "b"]) and b.title == "Second"


def test_openalex(spark, tmp_path):
    (a,) = readers.read_records(spark, _write(tmp_path, "a.json", json.dumps(OPENALEX))).collect()
    assert (a.title, a.abstract, a.index_terms, a.countries, a.refs, a.key, a.keywords) == ("A study", "hello world hello", ["math"], ["United Kingdom"], ["DOI openalex:W9"], "W1", ["graphs"])


def test_round_trips(spark, tmp_path):
    recs = readers.read_records(spark, _write(tmp_path, "a.txt", WOS))
    for kind, back in (("wos", readers.read_wos), ("ris", readers.read_ris), ("csv", readers.read_scopus)):
        path = str(tmp_path / kind)
        writers.write_records(recs.coalesce(1), path, kind)
        got = sorted(back(spark, path).collect(), key=lambda r: r.title)
        assert [r.title for r in got] == ["A study of networks", "Second"] and got[0].doi == "10.1/abc" and got[0].year == 2015, kind
        assert got[0].authors == ["Petrov, BA", "Lee, J"] and got[0].keywords == ["graph theory", "text mining"], kind
        if kind != "ris":
            assert got[0].countries == ["United Kingdom", "South Korea"] and len(got[0].refs) == 2 and got[0].cites == 7, kind


def test_maps_thesaurus_and_projects(spark, tmp_path):
    nodes, links = readers.read_vosviewer(spark, _write(tmp_path, "m.txt", "id\tlabel\tx\ty\tcluster\tweight<Links>\n1\tone\t0.5\t0.2\t1\t3\n2\ttwo\t0\t1\t2\t1\n"), _write(tmp_path, "n.txt", "1\t2\t3\n2\t1\t5\n2\t2\t9\n1\t3\n"))
    n = {r["key"]: r for r in nodes.collect()}
    assert n["1"]["y"] == -0.2 and n["1"]["cluster"] == 0 and n["1"]["weight<Links>"] == 3 and n["3"]["label"] == "3"
    assert {(r.a, r.b, r.w) for r in links.collect()} == {("1", "2", 5.0), ("1", "3", 1.0)}
    writers.write_vosviewer(nodes, links, str(tmp_path / "m"), str(tmp_path / "n"))
    again, _ = readers.read_vosviewer(spark, str(tmp_path / "m"), str(tmp_path / "n"))
    assert again.count() == 3
    th = spark.createDataFrame([("nets", "networks"), ("noise", "")], schema.THESAURUS)
    writers.write_thesaurus(th, str(tmp_path / "t"))
    assert {tuple(r) for r in readers.read_thesaurus(spark, str(tmp_path / "t")).collect()} == {("nets", "networks"), ("noise", "")}
    writers.save_project({"links": links}, str(tmp_path / "p"), {"min": 5})
    tables, settings = writers.open_project(spark, str(tmp_path / "p"))
    assert settings == {"min": 5} and tables["links"].count() == 2


def test_living_map(spark, tmp_path):
    corpus = readers.read_records(spark, _write(tmp_path, "a.txt", WOS))
    nodes = spark.createDataFrame([("graph theory", 1), ("text mining", 0), ("other", 0)], "key string, cluster int")
    new = corpus.where("title = 'Second'").withColumn("title", F.lit("An entirely new publication")).withColumn("keywords", F.array(F.lit("Text mining"), F.lit("Other"))).withColumn("rec_id", F.lit(10).cast("long"))
    fetched = corpus.unionByName(new)
    placed, count = living.check(fetched, corpus, "keywords", nodes)
    assert [(r.rec_id, r.cluster, r.votes) for r in placed.where("cluster is not null").collect()] == [(10, 0, 2)]
    base, out, inbox = (str(tmp_path / x) for x in ("corpus", "placed", "inbox"))
    corpus.write.parquet(base)
    fetched.write.parquet(inbox)
    living.follow(spark, inbox, base, "keywords", nodes, out, str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(out).where("title = 'An entirely new publication'").count() == 1
    assert match.unknown_records(fetched, spark.read.parquet(base)).where("title like 'An%'").count() == 0
    held = spark.read.parquet(base)
    assert held.select("rec_id").distinct().count() == held.count()
    living.follow(spark, inbox, base, "keywords", nodes, out, str(tmp_path / "cp2")).awaitTermination(120)  # the same batch once more
    assert spark.read.parquet(base).count() == held.count() and spark.read.parquet(out).where("title = 'An entirely new publication'").count() == 1


def test_windows_as_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    want = {(r.key, r.day): r.n for r in windows.daily_counts(events).collect()}
    stream = windows.daily_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), late="2 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert {(r.key, r.day): r.n for r in spark.table("daily").collect()} == want
    assert windows.sessions(events).agg(F.sum("n")).first()[0] == events.count()
