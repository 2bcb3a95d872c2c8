"""The merged store: what a commit rewrites, replays, failures, and streams over it."""

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from heatloom.sources import opendata, store

SCHEMA = "k string, d string, seq int, v string"


def files(root):
    found = {}
    for folder, _, names in os.walk(f"{root}/rows"):
        for n in names:
            if n.endswith(".parquet"):
                path = os.path.join(folder, n)
                found[path] = (os.path.getsize(path), os.stat(path).st_mtime_ns)
    return found


def put(spark, root, data, batch=None, schema=SCHEMA):
    return store.commit(spark.createDataFrame(data, schema), root, ["k", "d"], ["seq"], F.col("d"), batch, "d")


def current(spark, root):
    return rows(store.read_store(spark, root), "k", "d", "v")


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    root = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        store.read_store(spark, root)
    assert put(spark, root, [("a", "01", 1, "x"), ("a", "01", 2, "later"), ("b", "02", 1, "y"), ("c", None, 1, "z")], "b0") == 0
    before = files(root)
    assert put(spark, root, [("a", "01", 0, "newer commit"), ("d", "03", 1, "w")], "b1") == 1
    after = files(root)
    assert all(after[p] == s for p, s in before.items())  # nothing stored is changed or removed
    assert {p.split("store_part=")[1].split("/")[0] for p in set(after) - set(before)} == {"01", "03"}
    assert current(spark, root) == sorted([("a", "01", "newer commit"), ("b", "02", "y"), ("c", None, "z"), ("d", "03", "w")], key=repr)
    assert rows(store.read_store(spark, root, ["02"]), "k") == [("b",)]
    assert store.last_entry(spark, root)["mark"] == "03"
    plan = store.read_store(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan and "Join" not in plan
    assert store.vacuum(spark, root) == 1 and current(spark, root)[0][2] == "newer commit"


def test_replay_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "s")
    put(spark, root, [("a", "01", 1, "x")], "b0")
    put(spark, root, [("a", "01", 1, "y")], "b1")
    before = files(root)
    assert put(spark, root, [("a", "01", 1, "x")], "b0") is None
    assert files(root) == before and current(spark, root) == [("a", "01", "y")]


def test_failure_before_the_entry_leaves_the_table(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    put(spark, root, [("a", "01", 1, "x"), ("b", "02", 1, "y")], "b0")

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_put", fails)
        with pytest.raises(OSError):
            put(spark, root, [("a", "01", 1, "half")], "b1")
    assert current(spark, root) == [("a", "01", "x"), ("b", "02", "y")]
    assert put(spark, root, [("a", "01", 1, "whole")], "b1") == 1
    assert current(spark, root) == [("a", "01", "whole"), ("b", "02", "y")]
    with pytest.raises(RuntimeError):
        store._put(spark, f"{root}/ledger", "00000001.json", "{}")


def test_new_columns_and_empty_commits(spark, tmp_path):
    root = str(tmp_path / "s")
    put(spark, root, [("a", "01", 1, "x")])
    assert put(spark, root, [], "none") == 1
    put(spark, root, [("b", "02", 1, "y", 7)], schema=SCHEMA + ", extra int")
    assert rows(store.read_store(spark, root), "k", "extra") == [("a", None), ("b", 7)]


def test_increment_reads_only_its_buckets(spark, tmp_path):
    root = str(tmp_path / "s")
    schema = "`:id` string, `:updated_at` string, v string"
    first = spark.createDataFrame([(str(k), "2020", "a") for k in range(400)], schema)
    opendata.load_increment(first, root, 8)
    before = files(root)
    got = opendata.load_increment(spark.createDataFrame([("1", "2021", "b"), ("2", "2019", "too old"), ("new", "2021", "c")], schema), root, 8)
    assert got.count() == 401 and rows(got.where("v != 'a'"), ":id", "v") == [("1", "b"), ("new", "c")]
    added = {p.split("store_part=")[1].split("/")[0] for p in set(files(root)) - set(before)}
    assert len(added) <= 2 and opendata.next_part(spark, root) == 2
