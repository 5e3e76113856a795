"""Works behind a paged REST service, as a Spark data source: every query is a partition, and a stream resumes at its cursors."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from inkmesh.functions.text import norm_doi
from inkmesh.sources.readers import works_to_records

#: DOIs of one request, and works of one page.
DOI_BATCH, PAGE = 50, 200
#: Columns asked for.
SELECT = "id,doi,display_name,publication_year,authorships,primary_location,keywords,concepts,abstract_inverted_index,cited_by_count,type,language,biblio,referenced_works"
SCHEMA = "query int, term string, position long, id string, work string"

Row = tuple[int, str, int, str, str]


@dataclass(frozen=True)
class Query(InputPartition):
    """One chain of pages: its number, the term that its works are marked with, and the request's parameters."""

    number: int
    term: str
    params: tuple[tuple[str, str], ...]


def split_terms(text: str) -> list[str]:
    """Terms between semicolons or line ends, each once, whatever its case."""
    out: dict[str, str] = {}
    for t in re.split(r"[;\n]", text):
        if t.strip():
            out.setdefault(" ".join(t.lower().split()), t.strip())
    return list(out.values())


def queries(options: dict[str, str]) -> list[Query]:
    """What the options ask for: batches of DOIs, or a query for each term (mode any), or one for all terms together (mode all)."""
    own = {k.lower(): v for k, v in options.items()}
    dates = [f"{k}_publication_date:{own[k]}-{end}" for k, end in (("from", "01-01"), ("to", "12-31")) if own.get(k)]
    common = {"select": own.get("select", SELECT)} | ({"mailto": own["mail"]} if own.get("mail") else {}) | ({"api_key": own["key"]} if own.get("key") else {})
    found: list[tuple[str, dict[str, str]]] = []
    dois = list(dict.fromkeys(d for d in re.split(r"[\s,;]+", own.get("dois", "")) if d))
    for k in range(0, len(dois), DOI_BATCH):
        found.append(("", {"filter": ",".join(["doi:" + "|".join(dois[k : k + DOI_BATCH]), *dates]), "per-page": str(DOI_BATCH)}))
    terms = split_terms(own.get("terms", ""))
    mode = own.get("mode", "any")
    if mode not in ("any", "all"):
        raise ValueError("mode is any or all")
    if mode == "all" and len(terms) > 1:
        terms = [" AND ".join(f"({t})" for t in terms)]
    for t in terms:
        where = [f"{own['field']}.search:{t}"] if own.get("field") else []
        found.append((t, ({} if where else {"search": t}) | ({"filter": ",".join(where + dates)} if where or dates else {}) | {"per-page": own.get("per_page", str(PAGE))}))
    if not found:
        raise ValueError("give terms or dois")
    return [Query(k, term, tuple((common | params).items())) for k, (term, params) in enumerate(found)]


def fetch(url: str, query: Query, cursor: str, tries: int = 5, wait: float = 1.0) -> tuple[list[dict], str | None]:
    """The works of a page and the next page's cursor, None behind the last. Busy services are asked again, twice as long after each try."""
    at = url + ("&" if "?" in url else "?") + urllib.parse.urlencode([*query.params, ("cursor", cursor)])
    for k in range(tries):
        try:
            with urllib.request.urlopen(at, timeout=60) as answer:
                page = json.load(answer)
            works = page.get("results") or []
            following = (page.get("meta") or {}).get("next_cursor") if works else None
            return works, following
        except urllib.error.HTTPError as e:
            if e.code in (401, 403):
                raise RuntimeError(f"the service refused the key or address (HTTP {e.code})") from e
            if e.code not in (429, 500, 502, 503, 504) or k + 1 == tries:
                raise RuntimeError(f"the request failed (HTTP {e.code})") from e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            if k + 1 == tries:
                raise RuntimeError(f"the request failed ({e})") from e
        time.sleep(wait * 2**k)
    raise AssertionError


def _rows(query: Query, works: list[dict], first: int) -> Iterator[Row]:
    for k, w in enumerate(works):
        yield query.number, query.term, first + k, str(w.get("id") or ""), json.dumps(w, ensure_ascii=False)


class WorksSource(DataSource):
    """format("works"). Options: url; terms (between semicolons), mode (any, all), field, or dois; from, to (years); select; per_page; most (works of a query, 0: all); tries, wait; mail, key."""

    @classmethod
    def name(cls) -> str:
        return "works"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Pages(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Following(dict(self.options))


class _Options:
    def __init__(self, options: dict[str, str]):
        own = {k.lower(): v for k, v in options.items()}
        if not own.get("url"):
            raise ValueError("give the url of the works")
        self.url, self.most = own["url"], int(own.get("most", 0))
        self.queries = queries(options)
        self.tries, self.wait = int(own.get("tries", 5)), float(own.get("wait", 1.0))

    def page(self, query: Query, cursor: str, first: int) -> tuple[list[dict], str | None]:
        works, following = fetch(self.url, query, cursor, self.tries, self.wait)
        if self.most and first + len(works) >= self.most:
            works, following = works[: self.most - first], None
        return works, following


class _Pages(_Options, DataSourceReader):
    """Every query is a partition, which walks its pages and hands each on before it asks for the next."""

    def partitions(self) -> list[Query]:
        return self.queries

    def read(self, partition: Query) -> Iterator[Row]:
        cursor, n = "*", 0
        while cursor is not None:
            works, cursor = self.page(partition, cursor, n)
            yield from _rows(partition, works, n)
            n += len(works)


class _Following(_Options, SimpleDataSourceStreamReader):
    """A page of each unfinished query a batch. An offset holds each query's cursor (null: done) and how many works came before it."""

    def initialOffset(self) -> dict:
        return {"cursor": ["*"] * len(self.queries), "works": [0] * len(self.queries)}

    def read(self, start: dict) -> tuple[Iterator[Row], dict]:
        rows, cursors, counts = [], list(start["cursor"]), list(start["works"])
        for k, q in enumerate(self.queries):
            if cursors[k] is not None:
                works, cursors[k] = self.page(q, cursors[k], counts[k])
                rows.extend(_rows(q, works, counts[k]))
                counts[k] += len(works)
        return iter(rows), {"cursor": cursors, "works": counts}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[Row]:
        """The same pages once more, after a failure: by cursor, up to the works that the end has counted."""
        for k, q in enumerate(self.queries):
            cursor, n = start["cursor"][k], start["works"][k]
            while cursor is not None and n < end["works"][k]:
                works, cursor = self.page(q, cursor, n)
                yield from _rows(q, works[: end["works"][k] - n], n)
                n += len(works)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorksSource)


def search(spark: SparkSession, url: str, **options: object) -> tuple[DataFrame, DataFrame]:
    """(records, rec_id and terms): every work once, at its first place, with the terms that found it in their order."""
    register(spark)
    return merged(spark.read.format("works").options(url=url, **{k: str(v) for k, v in options.items()}).load())


def merged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the source -> (records, rec_id and terms). Works are told apart by id, else by DOI; those with neither are each their own."""
    doi = norm_doi(F.coalesce(F.get_json_object("work", "$.doi"), F.lit("")))
    own = F.concat_ws(":", "query", "position")
    key = F.when(F.col("id") != "", F.col("id")).when(doi != "", doi).otherwise(own)
    place = F.struct("query", "position")
    one = rows.groupBy(key.alias("key")).agg(F.min(place).alias("at"), F.min_by("work", place).alias("work"), F.collect_set(F.when(F.col("term") != "", F.struct("query", "term"))).alias("terms"))
    one = one.withColumn("rec_id", F.shiftleft(F.col("at.query").cast("long"), 32) + F.col("at.position"))
    return works_to_records(one.select("rec_id", F.col("work").alias("text"))), one.select("rec_id", F.transform(F.array_sort("terms"), lambda t: t["term"]).alias("terms"))
