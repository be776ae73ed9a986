"""Navigable small-world graphs over passages: an approximate index that reads a small part of the vectors for each query.

Passages are dealt to shards of a bounded number by a hash of their id. Each shard, built in a task of its own, links every passage to up
to m others: of its ef_construction nearest ones those that are nearer to it than to any link chosen before, so that links lead in
all directions; links go both ways, and what cannot be reached from the entry is linked to its nearest passage that can. A search
walks from the entry, always on from the nearest passage not yet left, until ef_search found ones are nearer than all that is open.
Inner product and cosine become Euclidean distance by one more coordinate or by unit length, so the same graph serves every metric.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import search as S

#: Passages of a shard on average, and queries that one task walks with.
SHARD_ROWS, QUERY_ROWS = 8192, 50_000
_ROWS = "shard int, node int, pid {pid}, vector array<double>, near array<int>"


def _normal(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors whose Euclidean order is the metric's; queries of an inner product get 0 as the coordinate that `lifted` adds."""
    if metric == "COSINE":
        size = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    return np.concatenate([x, np.zeros((len(x), 1))], 1) if metric == "IP" else x


def lifted(x: np.ndarray, metric: str) -> np.ndarray:
    out = _normal(x, metric)
    if metric == "IP" and len(x):  # all passages get the length of the longest, so the nearest has the largest product
        size = (x * x).sum(1)
        out[:, -1] = np.sqrt(size.max() - size)
    return out


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T), 0.0)


def _chosen(near: np.ndarray, far: np.ndarray, between: np.ndarray, m: int) -> list[int]:
    """Of candidates by distance those nearer to the passage than to a chosen one, filled up to m by the nearest left."""
    out: list[int] = []
    for i in range(len(near)):
        if len(out) == m:
            break
        if all(far[i] < between[i, j] for j in out):
            out.append(i)
    out += [i for i in range(len(near)) if i not in set(out)][: m - len(out)]
    return near[out].tolist()


def link(x: np.ndarray, m: int, ef_construction: int) -> list[list[int]]:
    """The links of each of the vectors; the entry is number 0."""
    n = len(x)
    links: list[list[int]] = [[] for _ in range(n)]
    ef = min(max(ef_construction, m), n - 1)
    if ef > 0:
        for i in range(0, n, 1024):
            far = _far(x[i : i + 1024], x)
            far[np.arange(len(far)), np.arange(i, i + len(far))] = np.inf
            near = np.argpartition(far, ef - 1, 1)[:, :ef]
            own = np.take_along_axis(far, near, 1)
            order = np.lexsort((near, own), axis=1)
            near, own = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
            for k in range(len(far)):
                links[i + k] = _chosen(near[k], own[k], _far(x[near[k]], x[near[k]]), m)
    back = [list(own) for own in links]
    for i, own in enumerate(links):
        for j in own:
            if i not in back[j] and len(back[j]) < 2 * m:
                back[j].append(i)
    _connect(x, back)
    return back


def _connect(x: np.ndarray, links: list[list[int]]) -> None:
    """Links every passage that the entry does not lead to."""
    seen = np.zeros(len(x), bool)

    def walk(start: int) -> None:
        todo = [start]
        seen[start] = True
        while todo:
            for j in links[todo.pop()]:
                if not seen[j]:
                    seen[j] = True
                    todo.append(j)

    if len(x):
        walk(0)
    while not seen.all():
        out, inside = np.flatnonzero(~seen)[:1024], np.flatnonzero(seen)
        far = _far(x[out], x[inside])
        i, j = np.unravel_index(int(far.argmin()), far.shape)
        links[inside[j]].append(int(out[i]))
        links[out[i]].append(int(inside[j]))
        walk(int(out[i]))


def walk(x: np.ndarray, links: list[np.ndarray], q: np.ndarray, ef: int) -> tuple[list[tuple[float, int]], int]:
    """The ef nearest that the walk finds, nearest first, and the number of distances that it computed."""
    seen = np.zeros(len(x), bool)
    seen[0] = True
    d = float(((x[0] - q) ** 2).sum())
    open_, found, computed = [(d, 0)], [(-d, 0)], 1
    while open_:
        d, i = heapq.heappop(open_)
        if len(found) >= ef and d > -found[0][0]:
            break
        near = links[i]
        near = near[~seen[near]]
        if not len(near):
            continue
        seen[near] = True
        far = ((x[near] - q) ** 2).sum(1)
        computed += len(near)
        for e, j in zip(far.tolist(), near.tolist(), strict=True):
            if len(found) < ef or e < -found[0][0]:
                heapq.heappush(open_, (e, j))
                heapq.heappush(found, (-e, j))
                if len(found) > ef:
                    heapq.heappop(found)
    return sorted((-d, i) for d, i in found), computed


def build(passages: DataFrame, m: int = 16, ef_construction: int = 64, metric: str = "IP", shards: int | None = None) -> DataFrame:
    """(shard, node, pid, vector, near): the graph of each shard. Passages without a vector take no part; equal vectors each do."""
    rows = passages.select("pid", F.col("vector").cast("array<double>").alias("vector")).filter("vector is not null")
    shards = shards or max(1, -(-rows.count() // SHARD_ROWS))
    schema = _ROWS.format(pid=rows.schema["pid"].dataType.simpleString())

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pid", ignore_index=True)
        x = lifted(np.stack(frame["vector"].to_numpy()), metric)
        middle = int(_far(x, x.mean(0, keepdims=True))[:, 0].argmin())  # the entry comes first
        frame = frame.iloc[[middle, *(i for i in range(len(frame)) if i != middle)]].reset_index(drop=True)
        x = lifted(np.stack(frame["vector"].to_numpy()), metric)
        return frame.assign(node=range(len(frame)), near=link(x, m, ef_construction))[["shard", "node", "pid", "vector", "near"]]

    return rows.withColumn("shard", F.pmod(F.xxhash64("pid"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(grow, schema)


def search(
    graph: DataFrame, queries: DataFrame, k: int, ef_search: int = 64, metric: str = "IP", threshold: float | None = None, counted: bool = False
) -> DataFrame:
    """As top_k, by a walk through every shard: (qid, rank, pid, score), with counted the distances computed for the query as well.

    ef_search is the number of passages that a walk keeps, at least k + 1: more find more of the true ones. threshold leaves out hits
    whose score is worse. The passages of a group are one shard, its queries at most about QUERY_ROWS."""
    ef = max(ef_search, k + 1)  # one more, for the passage of the query's own id
    q = queries.select("qid", F.col("vector").cast("array<double>").alias("vector")).filter("vector is not null")
    parts = max(1, -(-q.count() // QUERY_ROWS))
    shards = graph.select("shard").distinct()
    deal = F.sequence(F.lit(0), F.lit(parts - 1))
    of = {"pid": graph.schema["pid"].dataType.simpleString(), "qid": q.schema["qid"].dataType.simpleString()}

    sign = 1.0 if S.HIGHER_IS_BETTER[metric] else -1.0

    def best(own: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(own) and len(nodes):
            nodes = nodes.sort_values("node")
            plain = np.stack(nodes["vector"].to_numpy())
            x, near = lifted(plain, metric), [np.asarray(v, np.int64) for v in nodes["near"]]
            ids = nodes["pid"].to_numpy()
            vectors = np.stack(own["vector"].to_numpy())
            for qid, vector, query in zip(own["qid"], vectors, _normal(vectors, metric), strict=True):
                found, computed = walk(x, near, query, ef)
                at = np.array([i for _, i in found if ids[i] != qid], np.int64)
                scores = S._scores(vector[None], plain[at], metric)[0]
                at, scores = at[~np.isnan(scores)], scores[~np.isnan(scores)]
                # No more than k of a shard can be among the k best of all; a walk keeps many more.
                first = np.lexsort((ids[at], -sign * np.round(scores, S.PLACES)))[:k]
                rows += [(qid, p, s, computed) for p, s in zip(ids[at[first]].tolist(), scores[first].tolist(), strict=True)]
        return pd.DataFrame(rows, columns=["qid", "pid", "score", "computed"])

    # Every shard is walked, so each query goes to each of them: rows of queries times shards, never of passages.
    q = q.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int"))
    numbers = [r["shard"] for r in shards.collect()]
    q = q.withColumn("shard", F.explode(F.array(*map(F.lit, numbers)).cast("array<int>")))
    nodes = graph.withColumn("part", F.explode(deal))
    sides = q.groupBy("shard", "part").cogroup(nodes.groupBy("shard", "part"))
    found = sides.applyInPandas(best, f"qid {of['qid']}, pid {of['pid']}, score double, computed bigint")
    if threshold is not None:
        found = found.filter(F.col("score") >= threshold if S.HIGHER_IS_BETTER[metric] else F.col("score") <= threshold)
    top = S._ranked(found.drop("computed"), k, metric).select("qid", "rank", "pid", "score")
    if counted:
        work = found.groupBy("qid", F.pmod(F.xxhash64("pid"), F.lit(max(numbers, default=0) + 1)).alias("shard")).agg(F.first("computed").alias("computed"))
        top = top.join(work.groupBy("qid").agg(F.sum("computed").alias("computed")), "qid")
    return top


class GraphIndex:
    """A graph stored beside its collection, with the settings it was built by."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.settings = json.loads(spark.read.text(f"{path}/settings").first()["value"])

    @classmethod
    def create(cls, passages: DataFrame, path: str, m: int = 16, ef_construction: int = 64, metric: str = "IP") -> GraphIndex:
        spark = passages.sparkSession
        build(passages, m, ef_construction, metric).write.mode("errorifexists").partitionBy("shard").parquet(f"{path}/graph")
        settings = json.dumps({"m": m, "ef_construction": ef_construction, "metric": metric})
        spark.createDataFrame([(settings,)], "value string").coalesce(1).write.text(f"{path}/settings")
        return cls(spark, path)

    def graph(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/graph")

    def search(self, queries: DataFrame, k: int, ef_search: int = 64, use_index: bool = True, threshold: float | None = None) -> DataFrame:
        """The k best of each query; without use_index exactly, by a scan of the stored vectors."""
        metric = self.settings["metric"]
        if use_index:
            return search(self.graph(), queries, k, ef_search, metric, threshold)
        top = S.top_k(queries, self.graph().select("pid", "vector"), k, metric)
        if threshold is None:
            return top
        return top.filter(F.col("score") >= threshold if S.HIGHER_IS_BETTER[metric] else F.col("score") <= threshold)
