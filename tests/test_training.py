import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import training as T
from siftwell.operators.learn import Adapter


@pytest.fixture(scope="module")
def tables(spark):
    """Passages, and queries that are turned and noisy copies of their positives."""
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    p = unit(rng.normal(size=(240, 8)))
    turn = np.linalg.qr(np.eye(8) + 0.35 * rng.normal(size=(8, 8)))[0]
    q = unit(p[:120] @ turn + 0.05 * rng.normal(size=(120, 8)))
    passages = spark.createDataFrame([(i + 1000, v.tolist()) for i, v in enumerate(p)], "pid bigint, vector array<double>").cache()
    queries = spark.createDataFrame([(i, v.tolist(), "val" if i % 4 == 0 else "train") for i, v in enumerate(q)], "qid bigint, vector array<double>, split string").cache()
    positives = spark.createDataFrame([(i, i + 1000) for i in range(120)] + [(0, 1000)], "qid bigint, pid bigint").cache()
    return queries, passages, positives


@pytest.mark.parametrize("loss", ["triplet", "cosine"])
@pytest.mark.parametrize("residual", [True, False])
def test_gradients_are_those_of_the_loss(loss, residual):
    rng = np.random.default_rng(1)
    x, p, q = (rng.normal(size=(6, 5)) for _ in range(3))
    a, config = Adapter.new(5, 7, residual), T.Config(loss=loss, margin=0.3)
    s = T.sums(a, x, p, q, config, (0.7, 0.4))
    for w, g in ((a.w1, s.g1), (a.w2, s.g2)):
        for at in [(0, 0), (2, 3), (4, 4)]:
            w[at] += 1e-6
            up = T.sums(a, x, p, q, config, (0.7, 0.4)).loss
            w[at] -= 2e-6
            down = T.sums(a, x, p, q, config, (0.7, 0.4)).loss
            w[at] += 1e-6
            assert abs((up - down) / 2e-6 - g[at]) < 1e-5


def test_same_weights_however_rows_are_partitioned(spark, tables, monkeypatch):
    monkeypatch.setattr(T, "FAN_IN", 2)
    start = Adapter.new(8, 16)
    rows = T.mine(start, *tables, n=2).cache()
    config = T.Config(epochs=3, batches=2, rate=0.02, rebuild_patience=99)
    one, four = (T.train(start, lambda _, n=n: rows.repartition(n), config) for n in (1, 4))
    assert np.allclose(one[0].w1, four[0].w1, atol=1e-9) and np.allclose(one[0].w2, four[0].w2, atol=1e-9)
    assert np.allclose([h[1:5] for h in one[1]], [h[1:5] for h in four[1]], atol=1e-9)
    assert not np.allclose(one[0].w1, start.w1)


def test_training_raises_the_margin_and_keeps_the_best(spark, tables, tmp_path):
    start = Adapter.new(8, 32)
    config = T.Config(epochs=6, batches=2, rate=0.05, loss="cosine", margin=0.0, weights=lambda step, total: (1.0, 0.5 + 0.5 * step / total))
    best, history = T.train(start, lambda now: T.mine(now, *tables, n=2), config, str(tmp_path / "run"))
    assert history[-1][2] > history[0][2] and max(h[4] for h in history) > history[0][4]
    kept = sorted(p.name for p in (tmp_path / "run").iterdir())
    last = [h for h in history if h[6]][-1]
    assert kept == [f"epoch-{h[0]:05d}" for h in history if h[6]] and last[4] == max(h[4] for h in history)
    again = T.load(spark, str(tmp_path / "run" / kept[-1]))
    assert np.array_equal(again.w1, best.w1) and np.array_equal(again.w2, best.w2) and again.scale == best.scale


def test_rows_are_made_anew_when_the_margin_stands_still(tables):
    """Rows whose negatives are their positives always have the margin 0."""
    calls, rows = [], T.mine(Adapter.new(8, 16), *tables, n=1).withColumn("negative", F.col("positive")).cache()

    def triplets(now):
        calls.append(now.w1.copy())
        return rows

    _, history = T.train(Adapter.new(8, 16), triplets, T.Config(epochs=6, batches=1, loss="cosine", rebuild_patience=2))
    assert [h[5] for h in history] == [False, False, True, False, False, True] and len(calls) == 2
    assert not np.array_equal(calls[0], calls[1])


def test_mined_negatives_are_the_nearest_that_are_no_positives(tables):
    queries, passages, positives = tables
    start = Adapter.new(8, 4)
    rows = T.mine(start, queries, passages, positives, 3).collect()
    assert len(rows) == 120 * 3
    x = {r["qid"]: np.array(r["vector"]) for r in queries.collect()}
    p = {r["pid"]: np.array(r["vector"]) for r in passages.collect()}
    for qid in (0, 7, 50):
        u = start(x[qid][None])[0]
        near = sorted((k for k in p if k != qid + 1000), key=lambda k: -(u.astype(np.float32).astype(float) @ p[k]))[:3]
        got = [r for r in rows if r["qid"] == qid]
        assert {tuple(r["negative"]) for r in got} == {tuple(p[k].tolist()) for k in near}
        assert all(r["positive"] == p[qid + 1000].tolist() for r in got)


def test_without_rows(spark, tables):
    start = Adapter.new(8, 4)
    rows = T.mine(start, *tables, n=1).cache()
    none, history = T.train(start, lambda _: rows.filter("false"), T.Config(epochs=2, batches=1))
    assert np.array_equal(none.w1, start.w1) and all(h[6] for h in history)
    last, _ = T.train(start, lambda _: rows.filter(F.col("split") == "train"), T.Config(epochs=2, batches=1))
    assert not np.array_equal(last.w1, start.w1)
