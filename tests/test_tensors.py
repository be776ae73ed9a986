import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.sources import tensors as X

SCHEMA = "pid bigint, vector array<float>, ragged array<int>, name string, score double, ok boolean, small tinyint"


@pytest.fixture
def rows(spark):
    data = [(i, [float(i), i / 2], list(range(i % 4)), f"näme {i}" if i % 5 else None, None if i % 7 == 3 else i / 3, i % 2 == 0, i % 100) for i in range(500)]
    data += [(1000, [1.0, 2.0], None, "", float("nan"), None, None)]
    return spark.createDataFrame(data, SCHEMA)


def listed(df):
    return sorted((repr(r) for r in df.collect()))


def test_round_trip_append_and_overwrite(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    X.write(rows.repartition(3), path)
    back = X.read(spark, path)
    assert back.schema == rows.schema and listed(back) == listed(rows)
    X.write(rows.limit(10), path)
    assert X.read(spark, path).count() == 511
    X.write(rows.filter("pid < 5"), path, "overwrite")
    assert listed(X.read(spark, path)) == listed(rows.filter("pid < 5"))
    assert len([p for p in os.listdir(path) if p.startswith("part-")]) == len(X._manifest(path)["parts"])
    X.write(rows.filter("false"), path, "overwrite")
    assert X.read(spark, path).count() == 0


def test_files_are_plain_arrays(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    X.write(rows.filter("pid < 500").coalesce(1).orderBy("pid"), path)
    part = X._manifest(path)["parts"][0]
    vectors = np.load(f"{path}/{part['name']}/vector.npy", mmap_mode="r")
    assert vectors.shape == (500, 2) and vectors.dtype == np.float32 and vectors[7].tolist() == [7.0, 3.5]
    found = X.matrices(spark, f"{path}/{part['name']}/vector.npy")
    assert found.count() == 500 and found.filter("row = 7").first()["vector"] == [7.0, 3.5]


def test_only_wanted_columns_are_opened(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    X.write(rows, path)
    for part in X._manifest(path)["parts"]:
        for name in ("vector", "ragged.values", "ragged.offsets", "name.values"):
            at = f"{path}/{part['name']}/{name}.npy"
            if os.path.exists(at):
                os.remove(at)
    assert X.read(spark, path, ["pid", "score"]).filter("pid = 6").first()["score"] == 2.0
    with pytest.raises(Exception, match="vector|No such file"):
        X.read(spark, path).collect()


def test_parts_that_a_filter_rules_out_are_not_read(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    X.write(rows.filter("pid < 500").repartitionByRange(5, "pid"), path)
    parts = X._manifest(path)["parts"]
    first = min(parts, key=lambda p: p["stats"]["pid"][0])
    for p in parts:  # a part that is read would fail
        if p is not first:
            os.remove(f"{path}/{p['name']}/pid.npy")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        high = first["stats"]["pid"][1]
        assert X.read(spark, path).filter(F.col("pid") <= high).count() == high + 1
        assert X.read(spark, path).filter(F.col("pid").isin(3, 4)).count() == 2 and X.read(spark, path).filter("pid < 3").count() == 3
        assert X.read(spark, path).filter("pid = 2 AND score > 0").count() == 1 and X.read(spark, path).filter("pid > 100000").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_what_a_failed_writer_leaves_is_not_seen(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    X.write(rows.limit(20).coalesce(1), path)
    before = X._manifest(path)
    bad = rows.repartition(4, "pid").withColumn("score", F.when(F.col("pid") == 77, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("score")))
    with pytest.raises(Exception, match="broken"):
        X.write(bad, path)
    assert X._manifest(path) == before and X.read(spark, path).count() == 20


def test_kinds_that_no_array_holds(spark, tmp_path):
    with pytest.raises(ValueError):
        X.write(spark.range(1).select(F.current_timestamp().alias("t")), str(tmp_path / "t"))
    with pytest.raises(Exception, match="nulls inside"):
        X.write(spark.createDataFrame([(1, [1.0, None])], "a int, v array<double>"), str(tmp_path / "u"))
