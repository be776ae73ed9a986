import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import graph as G
from siftwell.operators import search as S


@pytest.fixture(scope="module")
def passages(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 2
    x = centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16)) * (1 + rng.integers(0, 2, (3000, 1)))
    x[7] = x[8]  # a tie
    rows = [(i, v.tolist(), i % 101) for i, v in enumerate(x)] + [(9001, None, 3), (9002, [0.0] * 16, 5)]
    return spark.createDataFrame(rows, "pid bigint, vector array<double>, pubdate int").cache()


@pytest.fixture(scope="module")
def queries(passages):
    return passages.filter("pid % 60 = 0").withColumnRenamed("pid", "qid")


def pairs(hits):
    return {(r["qid"], r["pid"]) for r in hits.collect()}


@pytest.mark.parametrize("metric", ["IP", "COSINE", "L2"])
def test_graph_finds_nearly_all_with_fewer_distances(passages, queries, metric):
    built = G.build(passages, 12, 48, metric, shards=2).cache()
    found = G.search(built, queries, 10, 80, metric, counted=True).collect()
    want = pairs(S.top_k(queries, passages, 10, metric))
    assert len(want & {(r["qid"], r["pid"]) for r in found}) >= 0.95 * len(want)
    assert sum({r["qid"]: r["computed"] for r in found}.values()) < 0.5 * queries.count() * passages.count()
    assert all(len(r["near"]) <= 2 * 12 + 4 for r in built.collect())


def test_more_ef_finds_more_and_all_of_it_is_exact(passages, queries):
    built = G.build(passages, 6, 24, "L2", shards=3).cache()
    want = pairs(S.top_k(queries, passages, 10, "L2"))
    hits = [len(want & pairs(G.search(built, queries, 10, ef, "L2"))) for ef in (11, 60, 3000)]
    assert hits[0] <= hits[1] <= hits[2] == len(want)


def test_stored_graph_with_threshold_and_without_index(spark, passages, queries, tmp_path):
    index = G.GraphIndex.create(passages, str(tmp_path / "g"), m=10, ef_construction=40, metric="COSINE")
    again = G.GraphIndex(spark, str(tmp_path / "g"))
    assert again.settings == {"m": 10, "ef_construction": 40, "metric": "COSINE"}
    exact = S.top_k(queries, passages, 5, "COSINE")
    assert pairs(again.search(queries, 5, use_index=False)) == pairs(exact)
    near = pairs(exact.filter("score >= 0.8"))
    assert pairs(again.search(queries, 5, use_index=False, threshold=0.8)) == near
    assert len(pairs(index.search(queries, 5, 100, threshold=0.8)) & near) >= 0.95 * len(near) > 0


def test_graph_of_few_equal_or_no_passages(spark, passages):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)] + [(50, [5.0, 5.0])], "pid bigint, vector array<double>")
    q = same.filter("pid < 2").withColumnRenamed("pid", "qid")
    found = G.search(G.build(same, 3, 5, "L2", shards=1), q, 40, 100, "L2").collect()
    assert len(found) == 80 and {r["pid"] for r in found if r["rank"] == 40} == {50}
    one = same.filter("pid = 50")
    assert G.search(G.build(one), q, 3).count() == 2
    assert G.search(G.build(same.filter("false")), q, 3).count() == 0 and G.search(G.build(same), q.filter("false"), 3).count() == 0


def test_links_reach_every_passage():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(200, 4)), rng.normal(size=(200, 4)) + 100, rng.normal(size=(3, 4)) - 500])
    links = G.link(x, 4, 8)
    seen, todo = {0}, [0]
    while todo:
        new = set(links[todo.pop()]) - seen
        seen |= new
        todo += new
    assert len(seen) == len(x)


def test_blocks_later_than_every_query_are_passed_over(spark, passages, queries, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "_BLOCK", 64)
    early = queries.filter("pubdate < 30")
    S.by_date(passages, 6).write.parquet(str(tmp_path / "dated"))
    stored = spark.read.parquet(str(tmp_path / "dated"))
    want = sorted((r["qid"], r["rank"], r["pid"]) for r in S.top_k_native(early, passages, 7, "L2", True).collect())
    assert sorted((r["qid"], r["rank"], r["pid"]) for r in S.top_k(early, stored, 7, "L2", True).collect()) == want
    work = S.top_k_work(early, stored, 7, "L2", True).agg(F.sum("products")).first()[0]
    assert work < 0.75 * early.count() * stored.filter("pubdate < 30").count()
    plan = S.top_k(early, stored, 7, "L2", True)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(pubdate" in plan


def test_local_best_skips_blocks_and_old_queries():
    rng = np.random.default_rng(1)
    q, p = rng.normal(size=(10, 3)), rng.normal(size=(5 * S._BLOCK, 3))
    when, dates = np.arange(10) * 10, np.repeat([0, 40, 95, 200, 300], S._BLOCK)
    best = S.LocalBest(np.arange(10), q, 4, "IP", when)
    best.add(np.arange(len(p)) + 100, p, dates)
    assert (best.blocks, best.skipped) == (5, 3) and best.products == S._BLOCK * (10 + 6)
    scores = np.where(dates[None] <= when[:, None], q @ p.T, -np.inf)
    got = best.rows().sort_values(["qid", "score"], ascending=[True, False])
    for i in range(10):
        assert got[got["qid"] == i]["pid"].tolist() == (np.argsort(-scores[i])[:4] + 100).tolist()


def test_dated_search_without_queries_or_dates(spark, passages, queries):
    assert S.top_k(queries.filter("false"), passages, 3, "IP", True).count() == 0
    assert S.top_k(queries, passages.filter("false"), 3, "IP", True).count() == 0
    assert S.top_k(queries.withColumn("pubdate", F.lit(None).cast("int")), passages, 3, "IP", True).count() == 0
    with pytest.raises(ValueError):
        S.top_k_native(spark.range(0, 300_000).select(F.col("id").alias("qid"), F.array(*[F.lit(1.0)] * 16).alias("vector")), passages, 3)


def test_a_shard_gives_no_more_than_k_of_a_query(spark, passages, queries, monkeypatch):
    """A walk keeps ef_search passages of each query; only k of them may leave the task."""
    seen, ranked = [], S._ranked
    monkeypatch.setattr(S, "_ranked", lambda found, k, metric: (seen.append(found.groupBy("qid").count().agg({"count": "max"}).first()[0]), ranked(found, k, metric))[1])
    graph = G.build(passages, 8, 32, "L2", shards=2)
    near = G.search(graph, queries, 5, ef_search=200, metric="L2")
    assert near.count() == 5 * queries.count() and seen[0] <= 2 * 5


@pytest.mark.parametrize("limit", ["NATIVE_PAIRS", "NATIVE_BYTES"])
def test_large_products_go_by_matrices(spark, passages, queries, monkeypatch, limit):
    want = sorted((r["qid"], r["rank"], r["pid"]) for r in S.top_k_native(queries, passages, 5).collect())
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan(S.top_k_sized(queries, passages, 5))
    monkeypatch.setattr(S, limit, 100)
    found = S.top_k_sized(queries, passages, 5)
    assert "MapInPandas" in plan(found) and sorted((r["qid"], r["rank"], r["pid"]) for r in found.collect()) == want
