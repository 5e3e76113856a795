import random
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from inkmesh.operators import stats
from inkmesh.plans.scan import running
from inkmesh.plans.staging import shared_dir


def test_running_against_plain_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaaab") if rng.random() < 0.9 else None, i, rng.choice([None, rng.randrange(100)]), rng.random(), "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long, v long, x double, part string").repartition(7)
    got = running(df, [F.col("k").desc_nulls_last(), F.col("i")], ("v", "x"), parts=5).orderBy("rank").collect()
    want = sorted(rows, key=lambda r: (r[0] is None, [-ord(c) for c in r[0] or ""], r[1]))
    assert [r["i"] for r in got] == [r[1] for r in want] and [r["rank"] for r in got] == list(range(1, 3001))
    assert [r["run_v"] for r in got] == np.cumsum([r[2] or 0 for r in want]).tolist()
    assert np.allclose([r["run_x"] for r in got], np.cumsum([r[3] for r in want])) and got[0]["part"] == "x"
    assert running(df.limit(0), [F.col("i")], ("v",)).collect() == []


def test_a_key_of_all_rows_is_spread(spark):
    df = spark.range(4000).select(F.col("id").alias("doc"), F.lit("same").alias("label"))
    running(df, [F.col("label"), F.col("doc")], parts=8)
    newest = max(Path(shared_dir(spark).removeprefix("file://")).glob("inkmesh-ranges-*"), key=lambda p: p.stat().st_mtime)
    assert max(pq.read_metadata(p).num_rows for p in newest.glob("*.parquet")) < 2000
    got = {r["doc"]: r["label"] for r in stats.label_suffixes(df.union(spark.sql("select 9999L, 'one'")).union(spark.sql("select 10000L, string(null)"))).collect()}
    assert got[0] == "samea" and got[27] == "sameb" and got[9999] == "one" and got[10000] is None and len(got) == 4002


def test_no_window_over_all_sources(spark):
    inc = spark.createDataFrame([(i, f"s{min(i % 7, 3)}") for i in range(70)] + [(0, None)], "doc long, key string")
    got = {r["key"]: (r["docs"], r["rank"], r["zone"]) for r in stats.bradford(inc).collect()}
    assert got == {"s3": (40, 1, 1), "s0": (10, 2, 2), "s1": (10, 3, 3), "s2": (10, 4, 3), None: (1, 5, 3)}
