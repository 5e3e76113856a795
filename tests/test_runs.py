import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inkmesh.operators.network import build_map, records_flow
from inkmesh.plans import progress, staging
from inkmesh.plans.spec import MapSpec
from inkmesh.record_queries import records

DATA = "/root/testdata/sf0.001"


def folders(spark):
    return set(Path(staging.shared_dir(spark).removeprefix("file://")).glob("inkmesh-*"))


def test_a_cancelled_map_leaves_no_table(spark):
    before, caught, tag = folders(spark), [], "test-cancel"

    def work():
        try:
            with progress.tagged(spark, tag):
                build_map(records(spark, DATA), MapSpec("coauthorship", "authors"))
        except Exception as e:
            caught.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    until = time.monotonic() + 60
    while not (folders(spark) - before) and time.monotonic() < until:  # until a table is being written
        time.sleep(0.02)
    progress.cancel(spark, tag)
    thread.join(90)
    assert not thread.is_alive() and len(caught) == 1
    assert folders(spark) == before
    with progress.tagged(spark, tag):  # the tag is free again
        assert staging.stage(spark.range(5)).count() == 5


def test_a_run_that_fails_cleans_up_and_one_that_ends_well_keeps(spark):
    before = folders(spark)
    with pytest.raises(ZeroDivisionError), progress.tagged(spark):
        staging.stage(spark.range(10))
        1 / 0
    assert folders(spark) == before
    with progress.tagged(spark) as outer:
        kept = staging.stage(spark.range(100))
        with pytest.raises(staging.Cancelled), progress.tagged(spark) as inner:
            progress.cancel(spark, inner)
            staging.stage(spark.range(10))
        assert kept.count() == 100
        rows = progress.progress(spark, outer).collect()
    assert len(folders(spark) - before) == 1 and kept.agg(F.sum("id")).first()[0] == 4950
    assert rows and all(r["failed"] == 0 and r["done"] <= r["tasks"] for r in rows) and {r["status"] for r in rows} == {"SUCCEEDED"}
    staging.stage(spark.range(3))  # outside a run nothing is recorded
    assert progress.progress(spark, "nobody").count() == 0


FLOW = "rec_id long, title string, year int, cites int, keywords array<string>"


def test_flow_of_records(spark):
    found = spark.createDataFrame([(1, "a", 2000, 3, ["x", "y"]), (2, "a", 2000, 3, ["x"]), (3, "b", 1990, 1, ["x"]), (4, "c", 2001, None, None), (5, "d", None, 2, ["X", "z"]), (6, "e", 2002, 0, ["y", "q1"])], FLOW)
    kept, out = found.where("rec_id <> 2"), spark.createDataFrame([("yy",), ("xx",)], "key string")
    longer = found.withColumn("keywords", F.transform("keywords", lambda k: F.concat(k, k)))
    nodes = spark.createDataFrame([("xx",)], "key string")
    got = records_flow(longer, kept, MapSpec(min_count=2, year_from=1995), exclusions=out, nodes=nodes).first().asDict()
    assert got == {"identified": 6, "duplicates": 1, "screened": 5, "outside_years": 1, "without_units": 1, "analysed": 3, "items_found": 4, "items_meeting": 2, "items_excluded": 2, "items_in_map": 1}
    none = records_flow(longer.limit(0), kept.limit(0)).first().asDict()
    assert none.pop("items_in_map") is None and set(none.values()) == {0}
