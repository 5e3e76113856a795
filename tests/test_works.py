import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from inkmesh.sources import works

TITLES = {f"W{k}": f"work {k} on {'graphs' if k % 2 else 'maps'}{' and graphs' if k % 6 == 0 else ''}" for k in range(30)}


class Service(BaseHTTPRequestHandler):
    asked: list[dict] = []
    busy = 0

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        Service.asked.append(q)
        if Service.busy:
            Service.busy -= 1
            self.send_error(429)
            return
        if q.get("search") == "forbidden":
            self.send_error(403)
            return
        if "search" in q:
            words = [w.strip("() ") for w in q["search"].split(" AND ")]
            found = [i for i, t in TITLES.items() if all(w in t for w in words)]
        else:
            wanted = q["filter"].split(":", 1)[1].split(",")[0].split("|")
            found = [i for i in TITLES if f"10.1/{i.lower()}" in wanted]
        at = 0 if q["cursor"] == "*" else int(q["cursor"])
        page = found[at : at + int(q["per-page"])]
        body = {"meta": {"next_cursor": str(at + len(page))}, "results": [{"id": f"https://x.org/{i}", "display_name": TITLES[i], "doi": f"https://doi.org/10.1/{i}", "publication_year": 2000} for i in page]}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/works"
    server.shutdown()


def has(word):
    return {t for t in TITLES.values() if word in t}


def test_any_and_all_terms_with_provenance(spark, url):
    records, terms = works.search(spark, url, terms="graphs; maps;Graphs", per_page=4, **{"from": 1990, "to": 2005})
    got = {r.title: r.terms for r in records.join(terms, "rec_id").collect()}
    assert got == {t: [w for w in ("graphs", "maps") if w in t] for t in TITLES.values()}
    assert Service.asked[-1]["filter"] == "from_publication_date:1990-01-01,to_publication_date:2005-12-31"
    both, _ = works.search(spark, url, terms="graphs; maps", mode="all", per_page=3)
    assert {r.title for r in both.collect()} == has("graphs") & has("maps")
    few, _ = works.search(spark, url, terms="graphs", per_page=4, most=6)
    assert few.count() == 6


def test_batches_of_dois_are_partitions(spark, url):
    wanted = [f"10.1/w{k}" for k in range(30)] + [f"10.9/none{k}" for k in range(80)]
    works.register(spark)
    rows = spark.read.format("works").options(url=url, dois=" ".join(wanted)).load()
    assert rows.rdd.getNumPartitions() == 3
    records, _ = works.merged(rows)
    assert {r.doi for r in records.collect()} == {f"10.1/w{k}" for k in range(30)}


def test_busy_and_refusing_services(spark, url):
    Service.busy = 2
    records, _ = works.search(spark, url, terms="maps", wait=0.01)
    assert {r.title for r in records.collect()} == has("maps")
    with pytest.raises(Exception, match="HTTP 403"):
        works.search(spark, url, terms="forbidden", wait=0.01)[0].collect()
    with pytest.raises(ValueError):
        works.queries({"terms": " ; "})


def test_a_stream_resumes_without_loss_or_repeats(spark, url, tmp_path):
    works.register(spark)

    def run(batches):
        q = spark.readStream.format("works").options(url=url, terms="graphs;maps", per_page=3).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        end = time.time() + 90
        while time.time() < end and len(list((tmp_path / "cp" / "commits").glob("[0-9]*"))) < batches:
            time.sleep(0.2)
        q.stop()

    run(2)
    first = spark.read.parquet(str(tmp_path / "out")).count()
    assert 0 < first
    (last := max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))).unlink()  # broke off before its commit
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    run(7)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len({(r.query, r.position) for r in rows}) == len(rows) == len(has("graphs")) + len(has("maps"))
    assert {json.loads(r.work)["display_name"] for r in rows} == set(TITLES.values())
