"""The main path, with components counted by several tasks."""

import math

import pytest

from inkmesh.operators import graph


def plain(edges, year):
    kept = sorted({(a, b) for a, b in edges if (year[b], b) < (year[a], a)})
    docs = sorted({d for e in kept for d in e}, key=lambda d: (year[d], d))
    out, into = {}, {}
    for a, b in kept:
        out.setdefault(b, []).append(a)
        into.setdefault(a, []).append(b)
    head, tail = {}, {}
    for d in docs:
        head[d] = sum(head[x] for x in into[d]) if d in into else 1
    for d in reversed(docs):
        tail[d] = sum(tail[x] for x in out[d]) if d in out else 1
    total = sum(tail[d] for d in docs if d not in into)
    return {(a, b): head[b] * tail[a] / total for a, b in kept}


@pytest.mark.parametrize("at_once", [3, 200_000])
def test_components_are_counted_apart_and_ranked_together(spark, monkeypatch, at_once):
    monkeypatch.setattr(graph, "LINKS_AT_ONCE", at_once)
    monkeypatch.setattr(graph, "MOST_LINKS", 15)  # all links together are more
    edges = [(100 * g + a, 100 * g + b) for g in range(6) for a, b in ((1, 0), (2, 0), (3, 1), (3, 2), (4, 3), (5, 4), (0, 5))] + [(404, 402)]
    year = {100 * g + i: 2000 + i for g in range(6) for i in range(6)}
    e, y = spark.createDataFrame(edges, "citing long, cited long"), spark.createDataFrame(list(year.items()), "doc long, year int")
    got = {(r["citing"], r["cited"]): r["spc"] for r in graph.path_counts(e, y).collect()}
    want = plain(edges, year)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)
    path = graph.main_path(graph.path_counts(e, y), y).orderBy("step").collect()
    assert [(r["cited"], r["citing"]) for r in path][-2:] == [(403, 404), (404, 405)] and path[0]["cited"] == 400
    assert graph.path_counts(e.limit(0), y).count() == 0 and graph.main_path(graph.path_counts(e.limit(0), y), y).count() == 0
