import json
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from siftwell.sources import readers, sinks
from siftwell.streaming import windows


def test_papers(spark, tmp_path):
    good = {"bibcode": "b", "title": ["T"], "abstract": "A", "body": "One. Two.", "doi": ["d", "e"], "author": ["x"], "reference": [], "pubdate": "2012-00-00", "keyword": ["k"]}
    (tmp_path / "a.json").write_text(json.dumps([good, {k: v for k, v in good.items() if k != "body"}, good | {"doi": []}]))
    rows = readers.prepared(readers.papers(spark, str(tmp_path / "a.json"))).collect()
    assert len(rows) == 1 and rows[0]["title"] == "T" and rows[0]["doi"] == "d" and rows[0]["pubdate"] == "2012-01-01"
    assert rows[0]["loaded_from"].endswith("a.json") and rows[0]["body_sentences"] == ["One. Two."]


def test_csv_keeps_cells(spark, tmp_path):
    (tmp_path / "c.csv").write_text('masked_cit_context,masked_token_target,citing_title,citing_abstract,target_title,target_abstract\na,,NA,"x\ny",null,"say ""z"""\n')
    assert tuple(readers.csv_strings(spark, str(tmp_path / "c.csv")).first()) == ("a", "", "NA", "x\ny", "null", 'say "z"')


def test_result_tree_and_config(spark, tmp_path):
    for name, body in (("gs_min10_inc2_ov3", {"average_hitrate_at_k": [0.5]}), ("gs_min20_inc2_ov0", {"stats": {"average_stats": {"hitrate": [0.7]}}}), ("gs_min30_inc1_ov0", {"average_stats": {"hitrate": [0.9]}})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "r.json").write_text(json.dumps(body))
    rows = readers.result_tree(spark, str(tmp_path)).orderBy("min_len").collect()
    assert [(r["min_len"], r["overlap"], r["hitrate"]) for r in rows] == [(10, 3, [0.5]), (20, 0, [0.7]), (30, 0, [0.9])]

    @dataclass(frozen=True)
    class C:
        top_k: int
        metric: str = "IP"

    assert readers.config(C, '{"top_k": 5}') == C(5)
    with pytest.raises(ValueError, match="patience"):
        readers.config(C, '{"top_k": 5, "patience": 1}')


def test_store(spark, tmp_path):
    store = sinks.PassageStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("d", "text one", 20200101, 3), ("e", "text two", 20210101, -1)], "doi string, text string, pubdate int, citation_count bigint")
    assert store.create("p", rows, "hashing_64") == 2 and store.create("p", rows, "hashing_64") == 0
    more = rows.unionByName(rows.withColumn("text", F.lit("text three")).limit(1))
    assert store.create("p", more, "hashing_64") == 1 and store.describe("p")["dim"] == 64
    store.duplicate("p", "q")
    with pytest.raises(Exception, match="exists"):
        store.duplicate("p", "q")
    store.export("q", str(tmp_path / "out"))
    (tmp_path / "out" / "more.json").write_text("\n{broken\n\n")
    store.load(str(tmp_path / "out"), "r")
    assert store.read("r").count() == 3 and store.select_by_doc("r", "e").count() == 1 and store.vectors("r").columns == ["vector"]
    store.rename("r", "s")
    with pytest.raises(ValueError):
        store.rename("s", "q")
    store.drop("q")
    assert store.list() == ["p", "s"]
    with pytest.raises(ValueError):
        store.create("t", rows.drop("pubdate"), "hashing_64")


def test_rewrite_and_results(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    sinks.rewrite(spark, path, lambda df: df.filter("id > 2"))
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception):
        sinks.rewrite(spark, path, lambda df: df.select("nothing"))
    assert spark.read.parquet(path).count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    means = spark.createDataFrame([(1, 0.5, 0.2, 0.1), (2, 0.6, 0.4, 0.05)], "k int, hitrate double, recall double, iou double")
    out = sinks.write_result(spark, str(tmp_path / "r.json"), {"a": 1}, means)
    assert json.loads((tmp_path / "r.json").read_text()) == out and out["best_recall_k"] == 0.4 and out["average_iou_at_k"] == [0.1, 0.05]
    (tmp_path / "v" / "3").mkdir(parents=True)
    assert sinks.next_version(spark, str(tmp_path / "v")).endswith("/4")
    assert "Filter" in sinks.plan_of(spark.read.parquet(path).filter("id > 3"))


def test_stream_skips_what_is_stored(spark, tmp_path):
    rows = spark.createDataFrame([("d", "one"), ("d", "one"), ("e", "two")], "doc string, text string")
    rows.write.json(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("doc string, text string").json(str(tmp_path / "in"))
        windows.load_new(stream, str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination()
        rows.limit(1).write.mode("append").json(str(tmp_path / "in"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_stream_windows_equal_batch(spark, tmp_path):
    events = spark.sql("SELECT timestamp_seconds(1700000000 + id * 400) AS ts, id % 3 AS user_id, 'a' AS event_type, CAST(id AS DOUBLE) AS value FROM range(40)")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = windows.tumbling(stream, "1 hour", "10 minutes").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, windows.tumbling(events, "1 hour").collect()))
    assert windows.sessions(events, "10 minutes").agg(F.sum("n")).first()[0] == 40
    assert windows.sliding(events, "1 hour", "30 minutes").agg(F.sum("n")).first()[0] == 80
