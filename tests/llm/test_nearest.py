import numpy as np
import pytest

from siftwell.llm import nearest as A


def rows(n, dim, seed, centres=10):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return [(i, [float(x) for x in np.float32(c[i % centres] + 0.6 * rng.normal(size=dim))]) for i in range(n)]


def brute(data, queries, k):
    ids = np.array([i for i, _ in data])
    x = np.array([v for _, v in data], float)
    out = {}
    for q in queries:
        v = x[ids == q][0]
        s = (x * v).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((v * v).sum()))
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_recall_and_scores(spark):
    data = rows(6000, 16, 1)
    d = spark.createDataFrame(data, "vec_id bigint, embedding array<float>").repartition(3)
    got = {}
    for r in A.search(d.filter("vec_id % 50 = 0"), d, 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute(data, range(0, 6000, 50), 5)
    assert set(got) == set(want) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hits = sum(len({v for v, _ in want[q]} & {v for v, _ in got[q].values()}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    exact = {q: dict(brute(data, [q], 6000)[q]) for q in list(want)[:10]}
    for q, scores in exact.items():
        for v, s in got[q].values():
            assert s == pytest.approx(scores[v], abs=1e-12)


def test_hot_vector_and_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 64)
    data = rows(300, 8, 2)
    hot = data[0][1]
    data = [(i, hot if i % 3 == 0 else v) for i, v in data]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [float("nan")] + [1.0] * 7), (1004, [None] + [1.0] * 7), (None, hot), (1005, [1.0, 2.0]), (1006, [float("inf")] * 8)]
    d = spark.createDataFrame([*data, *odd, data[3]], "vec_id bigint, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in A.search(d.filter("vec_id % 50 = 0"), d, 5).collect())
    assert [g[2] for g in got if g[0] == 0] == [3, 6, 9, 12, 15] and [g[2] for g in got if g[0] == 150] == [0, 3, 6, 9, 12]
    assert not {g[0] for g in got} & {1000}
    few = spark.createDataFrame(data[:3], "vec_id bigint, embedding array<float>")
    assert A.search(few.filter("vec_id = 0"), few, 5).count() == 2
    assert A.search(few, few.filter("false"), 5).count() == 0 and A.search(few.filter("false"), few, 5).count() == 0


def test_queries_with_short_lists_read_all(spark, monkeypatch):
    """Lists of about two vectors, of which a query reads one: the neighbours that are missing come from all lists."""
    monkeypatch.setattr(A, "LIST_SIZE", 2)
    monkeypatch.setattr(A, "REPLICAS", 1)
    fitted = A.fit

    def narrow(*args):
        index = fitted(*args)
        index.ratio = 1.0
        return index

    monkeypatch.setattr(A, "fit", narrow)
    data = rows(60, 8, 4, centres=20)
    d = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in A.search(d.filter("vec_id % 10 = 0"), d, 20).collect())
    want = brute(data, range(0, 60, 10), 20)
    assert got == [(q, i, v) for q in want for i, (v, _) in enumerate(want[q], 1)]
