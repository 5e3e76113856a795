"""Files of any size and encoding: what many tasks read together equals what one reads alone."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmesh.sources import raw, readers
from inkmesh.sources.bibtex import entries, read_entries
from inkmesh.sources.split import csv_table, effects, json_objects
from tests.test_sources import BIB, OPENALEX, RIS, WOS

SCOPUS = 'Authors,Title,Year,Source title,Cited by,DOI,Affiliations,Author Keywords,EID\r\n"Petrov, B.; Lee, J.","A ""quoted"" study\r\nin two lines",2015,J Sci,7,10.1/X,"Univ Leeds, Leeds, United Kingdom; Seoul Natl Univ, Seoul, South Korea",graphs; maps,2-s2.0-1\r\n\r\nDoe J.,Zweite Übersicht,2016,J Ö,,,,,\r\n'
TAB = "PT\tAU\tTI\tSO\tPY\tTC\tDE\tC1\r\nJ\tPetrov, BA; Lee, J\tA study of networks\tJ SCI\t2015\t7\tgraph theory; text mining\t[Petrov, BA] Univ Leeds, Leeds, England\r\nJ\tDoe, J\tZweite Übersicht\tJ Ö\t2016\t0\t\t\r\n"


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_by_many_tasks_equals_sparks_own_reader(spark, tmp_path, small_blocks):
    rng = random.Random(1)
    cell = lambda: "".join(rng.choices(["a", "b ", ",", '"', "\n", "x" * 40, "é", "", "'"], weights=[5, 5, 2, 1, 1, 1, 1, 1, 1], k=rng.randrange(1, 12))) + "."
    lines = ["id,one,two"] + [",".join([str(k), *('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') else c for c in (cell(), cell()))]) for k in range(600)]
    lines[50] += "\n"
    lines += ['600,"' + "long\n" * 2000 + '",end']  # a record over many blocks
    path = tmp_path / "x.csv"
    path.write_text("\n".join(lines) + "\n", newline="")
    assert raw.pieces(spark, str(path)).rdd.getNumPartitions() > 4
    got = csv_table(spark, str(path)).orderBy("rec_id").select("id", "one", "two")
    want = spark.read.csv(str(path), header=True, quote='"', escape='"', multiLine=True)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()] and got.count() == 601


def test_json_by_many_tasks_equals_sparks_own_reader(spark, tmp_path, small_blocks):
    rng = random.Random(2)
    text = lambda: "".join(rng.choices(['"', "\\", "}", "{", "]", "[", ",", "a", "é", "\n"], k=rng.randrange(0, 30)))
    works = [{"id": f"W{k}", "title": f"t{k} {text()}", "biblio": {"volume": text(), "first_page": "1"}, "authorships": [{"author": {"display_name": text()}, "institutions": [{"display_name": "x{", "country_code": "GB"}]}] * rng.randrange(3)} for k in range(200)]
    works.append({"id": "W200", "title": "}" * 9000})
    schema = "id string, title string, biblio struct<volume: string, first_page: string>, authorships array<struct<author: struct<display_name: string>, institutions: array<struct<display_name: string, country_code: string>>>>"
    page = {"meta": {"count": 3, "note": 'a "}" here', "x": {"y": {}}}, "results": works, "group_by": [{"key": "k", "n": 1}]}
    for name, content, indent in (("page", page, None), ("array", works, None), ("pretty", page, 2)):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(content, indent=indent, ensure_ascii=False))
        pages = spark.read.schema(T.StructType([T.StructField("results", T.ArrayType(T.StructType.fromDDL(schema)))])).json(str(path), multiLine=True)
        own = spark.read.schema(schema).json(str(path), multiLine=True) if name == "array" else pages.select(F.explode("results").alias("r")).select("r.*")
        got = json_objects(spark, str(path)).orderBy("rec_id").select(F.from_json("text", schema).alias("r")).where("r.id is not null").select("r.*")
        assert raw.pieces(spark, str(path), "}").rdd.getNumPartitions() > 4
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in own.collect()] and got.count() == 201, name
        assert readers.read_openalex(spark, str(path)).count() == 201


def test_effects_against_a_plain_machine():
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choices(['"', '\\"', "\\\\", "}", "{", "]", "[", "a"], k=rng.randrange(12)))
        for begins, at in ((0, 1), (1, 3)):
            inside, depth, most, escaped = begins, 0, 0, False
            for c in text:
                if escaped:
                    escaped = False
                elif c == "\\":
                    escaped = True
                elif c == '"':
                    inside ^= 1
                elif not inside and c in "{}[]":
                    depth += 1 if c in "{[" else -1
                    most = max(most, depth)
            assert effects(text)[at : at + 2] == (depth, most) and effects(text)[0] == inside ^ begins


@pytest.mark.parametrize("encoding", ["utf-8-sig", "utf-16-le", "utf-16-be"])
def test_encodings_of_every_format(spark, tmp_path, encoding):
    page = json.dumps(OPENALEX)
    for name, text in (("a.txt", WOS), ("a.ris", RIS), ("a.bib", BIB), ("a.json", page), ("a.csv", SCOPUS), ("b.txt", TAB)):
        (tmp_path / f"plain-{name}").write_bytes(text.encode())
        mark = "﻿" if encoding in ("utf-16-le", "utf-16-be") and name != "a.ris" else ""  # one without a mark
        (tmp_path / name).write_bytes((mark + text).encode(encoding))
        want, got = (readers.read_records(spark, str(tmp_path / n)).orderBy("rec_id").drop("rec_id").collect() for n in (f"plain-{name}", name))
        assert got == want and len(want) == (1 if name == "a.json" else 2), name
        if name == "a.csv":
            assert want[0].title == 'A "quoted" study\nin two lines' and want[0].countries == ["United Kingdom", "South Korea"] and want[1].source == "J Ö"


def test_bibtex_values(spark, tmp_path):
    long = "word {in} braces " * 70_000
    text = (
        "% a comment with @ sign\n@string{jsci = \"Journal of \" # {Science}}\n@STRING(lead = jsci # { Letters})\n@comment{ @article{no, title={x}} }\n"
        "@article{k1,\n title = {" + "{" * 10 + "Deep" + "}" * 10 + " title},\n journal = lead # \" B\",\n year = 2015, month = jan,\n abstract = {" + long + "},\n author = {Petrov, Boris and Lee, Jin},\n"
        ' note = "quoted {"}inner{"} text",\n affiliations = {Univ Leeds, Leeds, England; Seoul Natl Univ, South Korea}}\n'
        "@misc{k2, title = {An address\n@home in braces}, year = 1999 } @book(k3, title = \"Same line\", year = {2001})\n@article{broken, title = {never closed\n@article{k4, title = {After it}}\n"
    )
    (tmp_path / "x.bib").write_text(text)
    got = {r["key"]: r for r in read_entries(spark, str(tmp_path / "x.bib")).collect()}
    assert set(got) == {"k1", "k2", "k3", "broken", "k4"} and got["k1"]["fields"]["journal"] == "Journal of Science Letters B" and got["k1"]["fields"]["month"] == "jan"
    assert got["k1"]["fields"]["abstract"] == long and got["k1"]["fields"]["note"] == 'quoted {"}inner{"} text' and got["k2"]["fields"]["title"] == "An address\n@home in braces"
    records = {r.key: r for r in readers.read_bibtex(spark, str(tmp_path / "x.bib")).collect()}
    assert records["k1"].title == "Deep title" and len(records["k1"].abstract) > 900_000 and records["k3"].title == "Same line" and records["k4"].title == "After it"
    assert records["k1"].countries == ["United Kingdom", "South Korea"] and records["k1"].affiliations == ["Univ Leeds", "Seoul Natl Univ"] and records["k3"].year == 2001


def test_bibtex_over_many_blocks(spark, tmp_path, small_blocks):
    (tmp_path / "x.bib").write_text("".join(f"@article{{k{k},\n title = {{Title {k}}},\n abstract = {{{'text ' * (k % 7 * 200)}\n@ {k}}}\n}}\n" for k in range(60)))
    got = readers.read_bibtex(spark, str(tmp_path / "x.bib")).orderBy("rec_id").collect()
    assert [r.key for r in got] == [f"k{k}" for k in range(60)] and got[13].abstract.endswith("text @ 13") and list(entries("no entry")) == []
