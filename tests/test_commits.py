import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from siftwell.sources import plans
from siftwell.sources.commits import CommitTable, progress


@pytest.fixture
def table(spark, tmp_path):
    return CommitTable(spark, str(tmp_path / "t"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_each_batch_counts_once(spark, table):
    assert table.commits() == []
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.append("a", spark.range(5)) and not table.append("a", spark.range(5)) and table.append("b/ü", spark.range(5, 8))
    assert ids(table.read()) == list(range(8))
    assert [(c["batch"], c["rows"]) for c in table.commits()] == [("a", 5), ("b/ü", 3)]
    assert [tuple(r)[:2] for r in progress(table).collect()] == [("a", 5), ("b/ü", 3)]
    assert ids(table.remaining(spark.range(12), "id")) == [8, 9, 10, 11]


def test_a_writer_that_dies_between_data_and_commit_leaves_nothing(spark, table, monkeypatch):
    table.append("a", spark.range(3))

    def die(batch, folder):
        raise KeyboardInterrupt

    monkeypatch.setattr(table, "_commit", die)
    with pytest.raises(KeyboardInterrupt):
        table.append("b", spark.range(3, 6))
    monkeypatch.undo()
    assert ids(table.read()) == [0, 1, 2] and not table.done("b")
    assert len(os.listdir(f"{table.root}/data")) == 2
    assert table.append("b", spark.range(3, 6)) and ids(table.read()) == list(range(6))
    assert len(table.vacuum(older_than=0)) == 1 and len(table.vacuum(older_than=0)) == 0
    assert ids(table.read()) == list(range(6)) and table.vacuum() == []


def test_a_writer_that_dies_between_lock_and_commit_is_cleared(spark, table):
    table.append("a", spark.range(1))
    open(f"{table._log('b')}.lock", "w").close()
    assert not table.append("b", spark.range(1, 2)) and ids(table.read()) == [0]
    table.vacuum(older_than=0)
    assert table.append("b", spark.range(1, 2)) and ids(table.read()) == [0, 1]


def test_writers_at_the_same_time(spark, table):
    won = []

    def write(batch, start):
        won.append((batch, table.append(batch, spark.range(start, start + 10).repartition(2))))

    threads = [threading.Thread(target=write, args=(f"b{i % 4}", 10 * (i % 4))) for i in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(b for b, ok in won if ok) == ["b0", "b1", "b2", "b3"] and len(won) == 12
    assert ids(table.read()) == list(range(40))


def test_a_failing_batch_is_not_committed(spark, table):
    bad = spark.range(10).withColumn("x", F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.lit("y")))
    with pytest.raises(Exception, match="broken"):
        table.append("a", bad)
    assert table.commits() == []


def test_analysis_of_an_executed_plan(spark):
    left = spark.range(1000).withColumn("k", F.col("id") % 10)
    right = spark.range(10).withColumnRenamed("id", "k").hint("broadcast")
    df = left.join(right, "k").filter("id >= 100").groupBy("k").agg(F.count("*").alias("n"))
    found = json.loads(plans.analyze_json(df))
    assert found["rows"] == 10 and found["seconds"] > 0
    seen = plans.operators(found)
    names = [n for _, n, _, _ in seen]
    assert "HashAggregate" in names and any("BroadcastHashJoin" in n for n in names) and any("Exchange" in n for n in names)
    rows = {n: r for _, n, r, _ in seen if r is not None}
    assert rows["BroadcastHashJoin"] == 900 and next(r for _, n, r, _ in seen if n == "HashAggregate") == 10
    assert all(ms >= 0 for *_, ms in seen if ms is not None) and any(ms is not None for *_, ms in seen)
    assert plans.analyze(df.filter("false"))["rows"] == 0
