import pytest

from inkmesh.operators.merges import Conflict, MergeLog
from inkmesh.operators.network import build_map
from inkmesh.plans.spec import MapSpec
from inkmesh.plans.staging import new_folder
from inkmesh.record_queries import records

PAIRS = "key string, replace_by string"


def state(log, version=None):
    return {r["key"]: r["replace_by"] for r in log.as_of(version).collect()}


def test_merges_undone_step_by_step(spark):
    log = MergeLog(spark, new_folder(spark, "test"))
    assert log.latest() == 0 and state(log) == {}
    want = [{}]
    for k in range(1, 23):
        log.merge(spark.createDataFrame([(f"k{k}", "x"), ("again", f"v{k}")], PAIRS), base=k - 1, note=f"step {k}")
        want.append({**want[-1], f"k{k}": "x", "again": f"v{k}"})
    assert state(log, 7) == want[7] and state(log) == want[22]
    for k in range(1, 21):  # twenty steps back, each a version of its own
        assert log.undo() == 22 + k
    assert state(log) == want[2] and state(log, 30) == want[14] and state(log, 22) == want[22]
    notes = {r["version"]: (r["note"], r["merges"]) for r in log.history().collect()}
    assert notes[22] == ("step 22", 22) and notes[23] == ("undo of step 22", 21) and notes[42] == ("undo of step 3", 2)
    v = log.merge(spark.createDataFrame([("new", "n")], PAIRS))
    assert state(log) == {**want[2], "new": "n"} and log.undo(3) == v + 1 and state(log) == {}
    with pytest.raises(ValueError):
        log.undo()
    with pytest.raises(ValueError):
        log.as_of(99)
    assert state(log, 0) == {}


def test_two_writers(spark):
    path = new_folder(spark, "test")
    one, two = MergeLog(spark, path), MergeLog(spark, path)
    one.merge(spark.createDataFrame([("a", "b")], PAIRS), base=0)
    with pytest.raises(Conflict):
        two.merge(spark.createDataFrame([("a", "c")], PAIRS), base=0)
    with pytest.raises(Conflict):
        two.undo(base=0)
    with pytest.raises(Conflict):  # both saw version 1 as the latest, the first to create the file wins
        one._commit(2, {"undo_to": 0, "note": ""})
        two._commit(2, {"undo_to": 1, "note": ""})
    assert state(two) == {} and state(two, 1) == {"a": "b"} and two.latest() == 2


def test_odd_changes(spark):
    log = MergeLog(spark, new_folder(spark, "test"))
    log.merge(spark.createDataFrame([(None, "x"), ("a", None), ("b", "b"), ("c", "y"), ("c", "z"), ("d", "")], PAIRS))
    assert state(log) == {"c": "z", "d": ""}
    log.merge(spark.createDataFrame([], PAIRS))
    groups = spark.createDataFrame([("d", ["d", "dd", "ddd"]), ("q", ["q", "qs"])], "target string, members array<string>")
    log.merge_groups(groups)
    assert state(log) == {"c": "z", "dd": "d", "ddd": "d", "qs": "q"}  # d was ignored and is a term again
    log.ignore(spark.createDataFrame([("qs",)], "key string"))
    assert state(log)["qs"] == "" and log.undo() == 5 and state(log)["qs"] == "q" and state(log, 2) == {"c": "z", "d": ""}


def test_map_as_of_any_version(spark):
    log = MergeLog(spark, new_folder(spark, "test"))
    r = records(spark, "/root/testdata/sf0.001")
    log.merge(spark.createDataFrame([("brand#11", "Eleven"), ("brand#12", "Eleven")], PAIRS))
    log.undo()
    keys = lambda v: {x["key"] for x in build_map(r, MapSpec(min_count=1), thesaurus=log.as_of(v))[0].collect()}
    plain, merged = keys(2), keys(1)
    assert "eleven" in merged and merged - {"eleven"} == plain - {"brand#11", "brand#12"} and "eleven" not in plain
