"""Approximate nearest neighbours by balanced posting lists.

1. A bounded sample is clustered by balanced k-means (a loaded centroid is made to look farther away), on the driver.
2. Every vector goes to the list of its nearest centroid, and, if it lies near a boundary, to other lists whose centroids
   are almost as near (replication). The centroids are searched by an in-memory graph: each knows its nearest others, and a
   best-first walk visits few of them.
3. A query reads the lists whose centroid distance is within a ratio of the nearest one's (distance-ratio pruning). The ratio
   is fitted: it is the smallest at which the sample's true neighbours lie in the lists read, for the wanted share of them.
4. Lists are cut into blocks of bounded size, so the list of a hot vector is read by many tasks; each block gives its best, and
   the best of all blocks are ranked by the exact cosine in double precision.
5. Queries whose lists held fewer neighbours than wanted (other rows of their own id, or small lists) read all lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.scratch import Scratch

#: Vectors that the clustering reads; vectors a list should hold; bound on the number of lists (their centroids are broadcast).
SAMPLE, LIST_SIZE, MAX_LISTS = 20_000, 256, 4096
#: A vector joins up to so many lists whose squared distance is within this factor of its nearest one's.
REPLICAS, BOUNDARY = 4, 1.10
#: Neighbours of a centroid in the graph, and candidates that a walk keeps at least.
DEGREE, BEAM = 24, 48
#: Share of the sample's true neighbours that the fitted ratio must reach, and sample queries that it is fitted on.
RECALL, PROBES = 0.985, 400
#: Vectors of a list that one task reads at once.
BLOCK = 2048
TIE = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def balanced_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k unit centroids of unit vectors x. A centroid's load is charged on its distance, so that lists even out."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    charge = np.zeros(k)
    for _ in range(rounds):
        near = np.concatenate([np.argmax(part @ c.T - charge, 1) for part in np.array_split(x, max(1, len(x) * k // 20_000_000))])
        load = np.bincount(near, minlength=k)
        charge = np.clip(charge + 0.02 * (load * k / len(x) - 1.0), 0, 0.3)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        full = (load > 0) & ((total * total).sum(1) > 0)
        c[full] = unit(total[full])
        c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


@dataclass
class Graph:
    """Centroids, the neighbours of each, and entry points of a walk."""

    centroids: np.ndarray
    edges: np.ndarray
    entry: np.ndarray

    @classmethod
    def build(cls, c: np.ndarray) -> Graph:
        order = np.argsort(-(c @ c.T), 1, kind="stable")[:, 1 : DEGREE + 1]
        rng = np.random.default_rng(11)
        far = rng.integers(0, len(c), (len(c), 4))  # a few long edges keep the graph in one piece
        edges = np.concatenate([order, far], 1)
        return cls(c, edges, np.unique(np.linspace(0, len(c) - 1, min(len(c), 16)).astype(int)))

    def search(self, q: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """Centroids within ratio of the nearest one's squared distance, as far as the walk meets them: numbers, distances."""
        seen = np.zeros(len(self.centroids), bool)
        frontier = self.entry
        seen[frontier] = True
        ids, dist = frontier, 2.0 - 2.0 * (self.centroids[frontier] @ q)
        while len(frontier):
            bound = max(dist.min() * ratio, np.partition(dist, min(BEAM, len(dist)) - 1)[min(BEAM, len(dist)) - 1])
            new = np.unique(self.edges[frontier])
            new = new[~seen[new]]
            seen[new] = True
            d = 2.0 - 2.0 * (self.centroids[new] @ q)
            ids, dist = np.concatenate([ids, new]), np.concatenate([dist, d])
            frontier = new[d <= bound]
        keep = dist <= max(dist.min() * ratio, 1e-12)
        order = np.argsort(dist[keep], kind="stable")
        return ids[keep][order], dist[keep][order]


@dataclass
class Index:
    graph: Graph
    ratio: float

    def lists(self, v: np.ndarray) -> np.ndarray:
        """Lists that hold v."""
        return self.graph.search(v, BOUNDARY)[0][:REPLICAS]

    def probes(self, q: np.ndarray) -> np.ndarray:
        return self.graph.search(q, self.ratio)[0]


def fit(x: np.ndarray, n_all: int, k: int) -> Index:
    """x: unit vectors of the sample, n_all: vectors that will be indexed, k: neighbours wanted."""
    n_lists = int(min(MAX_LISTS, max(1, n_all // LIST_SIZE), max(1, len(x) // 8)))
    index = Index(Graph.build(balanced_kmeans(x, n_lists)), 1.0)
    if n_lists == 1:
        return index
    held = [frozenset(index.lists(v).tolist()) for v in x]
    need = []
    for i in range(0, len(x), max(1, len(x) // PROBES)):
        sims = x @ x[i]
        sims[i] = -2.0
        ids, dist = index.graph.search(x[i], 1e9)
        factor = dict(zip(ids.tolist(), (dist / max(dist[0], 1e-12)).tolist(), strict=True))
        for j in np.argsort(-sims, kind="stable")[:k]:
            need.append(min(factor.get(h, 1e9) for h in held[j]))
    index.ratio = float(np.quantile(need, RECALL)) * 1.02
    return index


def _cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of each row of v with q; every row is summed alike, so equal vectors get equal scores."""
    return (v * q).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((q * q).sum()))


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is not null, holds neither null nor non-finite components and is not zero."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    live = F.exists("embedding", lambda v: v != 0)
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and size(embedding) > 0").filter(~bad & live)


def search(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of vectors by cosine, best first, ties to the smaller vec_id.

    Both tables have vec_id and embedding; rows of the query's own vec_id are no candidates. Null, empty and zero vectors and those with
    null or non-finite components take no part, nor do rows without an id. Repeated rows count once; rows of one id and several
    vectors count as the nearest of them. With fewer than k candidates all are returned. Vectors of other lengths than the commonest take no part.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    base = _usable(vectors)
    size = base.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if size is None:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in schema.split(", "))])
    base = base.filter(F.size("embedding") == size["d"])
    few = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toPandas()
    index = fit(unit(np.stack(few["embedding"].to_numpy())), size["n"], k)
    shared = spark.sparkContext.broadcast(index)

    def place(frames: Iterator[pd.DataFrame], probe: bool) -> Iterator[pd.DataFrame]:
        ix = shared.value
        for frame in frames:
            if len(frame):
                found = [(ix.probes if probe else ix.lists)(v) for v in unit(np.stack(frame["embedding"].to_numpy()))]
                yield pd.DataFrame({"vec_id": frame["vec_id"], "embedding": frame["embedding"], "list": [f.tolist() for f in found]})

    kind = "vec_id bigint, embedding array<double>, list array<int>"
    held = base.mapInPandas(lambda f: place(f, False), kind).select("vec_id", "embedding", F.explode("list").alias("list"))
    counts = scratch.keep(held.groupBy("list").agg(F.count("*").alias("n")), "counts")
    # A list of n vectors is dealt over ceil(n / BLOCK) blocks; its queries go to all of them.
    blocks = counts.select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")).hint("broadcast")
    held = held.join(blocks, "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "embedding")
    asked = _usable(queries).filter(F.size("embedding") == size["d"])

    def in_blocks(routed: DataFrame) -> DataFrame:
        return routed.join(blocks, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "embedding")

    def best(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            v = np.stack(right["embedding"].to_numpy())
            ids = right["vec_id"].to_numpy()
            u = unit(v)
            for q_id, q in zip(left["vec_id"], left["embedding"], strict=True):
                rough = u @ (q / np.sqrt((q * q).sum()))
                rough[ids == q_id] = -2.0
                if len(rough) > k:
                    cut = np.partition(rough, len(rough) - k)[len(rough) - k]
                    near = np.flatnonzero((rough >= cut - TIE) & (ids != q_id))
                else:
                    near = np.flatnonzero(ids != q_id)
                score = _cosines(q, v[near])
                order = np.lexsort((ids[near], -score))
                seen: list[int] = []
                for o in order:
                    if len(seen) == k:
                        break
                    if ids[near[o]] not in seen:
                        seen.append(ids[near[o]])
                        out.append((q_id, ids[near[o]], score[o]))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def ranked(routed: DataFrame) -> DataFrame:
        both = in_blocks(routed).groupBy("list", "block").cogroup(held.groupBy("list", "block"))
        found = both.applyInPandas(best, "query_id bigint, vec_id bigint, score double")
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return once.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    near = ranked(asked.mapInPandas(lambda f: place(f, True), kind).select("vec_id", "embedding", F.explode("list").alias("list")))
    near = scratch.keep(near, "near")
    full = near.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = scratch.keep(asked.join(full, "vec_id", "left_anti"), "short")
    if short.isEmpty():
        return near
    lists = F.sequence(F.lit(0), F.lit(len(index.graph.centroids) - 1))
    rest = ranked(short.select("vec_id", "embedding", F.explode(lists).alias("list")))
    return near.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").select(*rest.columns).unionByName(rest)
