"""Vector top-k joins under a date predicate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions import vectors as V

#: Scores are compared after rounding to so many places, so that ties do not hang on the order of a sum.
PLACES = 9
HIGHER_IS_BETTER = {"IP": True, "COSINE": True, "L2": False}
#: Bytes of query vectors that are shipped to every task at once; more queries go in several blocks.
QUERY_BYTES, NATIVE_BYTES = 64 << 20, 16 << 20
#: Pairs that built-in expressions score in a reasonable time: each component of each of them is looked at one by one.
NATIVE_PAIRS = 1 << 24
#: Queries and passages of one matrix product.
_BLOCK = 1024


def score_column(metric: str, a: Column, b: Column) -> Column:
    return {"IP": V.dot, "COSINE": V.cosine, "L2": V.l2}[metric](a, b)


def _order(metric: str) -> list[Column]:
    s = F.round("score", PLACES)
    return [s.desc() if HIGHER_IS_BETTER[metric] else s.asc(), F.col("pid")]


def _ranked(scored: DataFrame, k: int, metric: str) -> DataFrame:
    by = Window.partitionBy("qid").orderBy(*_order(metric))
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def top_k_native(queries: DataFrame, passages: DataFrame, k: int, metric: str = "IP", dated: bool = False) -> DataFrame:
    """As top_k, in built-in expressions only: the plain statement of the semantics, for queries that can be broadcast (16 MB, checked)."""
    n, width = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    if n * (8 * (width or 0) + 16) > NATIVE_BYTES:
        raise ValueError("too many queries to broadcast; top_k takes any number")
    p = passages.select("pid", F.col("vector").alias("pv"), *(["pubdate"] if dated else []))
    q = queries.select("qid", F.col("vector").alias("qv"), *([F.col("pubdate").alias("qdate")] if dated else []))
    on = (F.col("pid") != F.col("qid")) if not dated else (F.col("pid") != F.col("qid")) & (F.col("pubdate") <= F.col("qdate"))
    scored = p.join(F.broadcast(q), on).select("qid", "pid", score_column(metric, F.col("qv"), F.col("pv")).alias("score"))
    return _ranked(scored.filter("score is not null"), k, metric).select("qid", "rank", "pid", "score")


def top_k_sized(queries: DataFrame, passages: DataFrame, k: int, metric: str = "IP", dated: bool = False) -> DataFrame:
    """As top_k, in built-in expressions while queries and pairs are few enough for them, else by its matrix products."""
    n, width = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    small = n * (8 * (width or 0) + 16) <= NATIVE_BYTES and n * passages.count() <= NATIVE_PAIRS
    return (top_k_native if small else top_k)(queries, passages, k, metric, dated)


def _scores(q: np.ndarray, p: np.ndarray, metric: str) -> np.ndarray:
    if metric == "IP":
        return q @ p.T
    if metric == "COSINE":
        size = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((p * p).sum(1))[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(size == 0, np.nan, (q @ p.T) / size)
    d = (q * q).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2.0 * (q @ p.T)
    return np.sqrt(np.maximum(d, 0.0))


class LocalBest:
    """The k best passages of each query among those that one task sees, by matrix products of blocks.

    With dates, the queries stand in order of theirs: a block of passages meets only queries that are not older than its earliest passage,
    and none at all if that is later than every query. products counts scores computed, skipped the blocks that met no query."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, metric: str, when: np.ndarray | None = None):
        order = np.argsort(when, kind="stable") if when is not None else np.arange(len(ids))
        self.ids, self.matrix, self.when = ids[order], matrix[order], None if when is None else when[order]
        self.k, self.metric, self.sign = k, metric, 1.0 if HIGHER_IS_BETTER[metric] else -1.0
        #: Of each block of queries: keys (higher is better), ids and scores of what was found, best first, k columns at most.
        self.best = [(np.zeros((len(ids[j : j + _BLOCK]), 0)), np.zeros((len(ids[j : j + _BLOCK]), 0), np.int64), np.zeros((len(ids[j : j + _BLOCK]), 0))) for j in range(0, len(ids), _BLOCK)]
        self.blocks = self.skipped = self.products = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray, dates: np.ndarray | None = None) -> None:
        if dates is not None:  # in order of date, so that blocks are narrow
            order = np.argsort(dates, kind="stable")
            ids, vectors, dates = ids[order], vectors[order], dates[order]
        for i in range(0, len(ids), _BLOCK):
            part = slice(i, i + _BLOCK)
            first = 0 if dates is None else int(np.searchsorted(self.when, dates[i], "left"))
            self.blocks += 1
            self.skipped += first == len(self.ids)
            for b in range(first // _BLOCK, len(self.best)):
                self._score(b, max(first - b * _BLOCK, 0), ids[part], vectors[part], None if dates is None else dates[part])

    def _score(self, b: int, first: int, ids: np.ndarray, vectors: np.ndarray, dates: np.ndarray | None) -> None:
        """Block b of the queries, from the first that is young enough, with a block of passages."""
        rows = slice(b * _BLOCK + first, (b + 1) * _BLOCK)
        scores = _scores(self.matrix[rows], vectors, self.metric)
        self.products += scores.size
        keys = self.sign * np.round(scores, PLACES)
        bad = (ids[None, :] == self.ids[rows, None]) | np.isnan(keys)
        if dates is not None:
            bad |= ~(dates[None, :] <= self.when[rows, None])
        keys[bad] = -np.inf
        old = [x[first:] for x in self.best[b]]
        full = old[0].shape[1] >= self.k
        better = ((keys >= old[0][:, -1:] if full else True) & ~bad).any(0)  # the others can enter no query's k best
        if not better.any():
            return
        own = keys[:, better], np.broadcast_to(ids[better], (len(scores), int(better.sum()))), scores[:, better]
        keys, found, scores = (np.concatenate(x, 1) for x in zip(old, own, strict=True))
        order = np.lexsort((found, -keys), axis=1)[:, : self.k]
        new = [np.take_along_axis(x, order, 1) for x in (keys, found, scores)]
        if first:  # the older queries above keep what they have
            fill = (-np.inf, 0, 0.0)
            above = [np.pad(x[:first], ((0, 0), (0, y.shape[1] - x.shape[1])), constant_values=v) for x, y, v in zip(self.best[b], new, fill, strict=True)]
            new = [np.concatenate(x, 0) for x in zip(above, new, strict=True)]
        self.best[b] = tuple(new)

    def rows(self) -> pd.DataFrame:
        parts = []
        for b, (keys, found, scores) in enumerate(self.best):
            q, place = np.nonzero(keys > -np.inf)
            parts.append(pd.DataFrame({"qid": self.ids[b * _BLOCK + q], "pid": found[q, place], "score": scores[q, place]}))
        return pd.concat(parts) if parts else pd.DataFrame({"qid": self.ids[:0], "pid": self.ids[:0], "score": np.zeros(0)})


def by_date(passages: DataFrame, parts: int) -> DataFrame:
    """Passages laid out by date: written like this, row groups and blocks that are later than all queries are passed over."""
    return passages.repartitionByRange(parts, "pubdate").sortWithinPartitions("pubdate")


def top_k(queries: DataFrame, passages: DataFrame, k: int, metric: str = "IP", dated: bool = False) -> DataFrame:
    """(qid, rank, pid, score): each query's k best passages, ties to the smaller pid. No passage meets a query of its own id.

    queries: qid, vector and, if dated, pubdate; passages: pid, vector, pubdate. dated: only passages published no later than
    the query count, before the k are taken, so a query may get fewer. Passages stream through matrix products with blocks of
    queries; a task keeps only its k best of each query, and one window over these ends it. Passages later than every query are left out
    by the scan, and blocks (see by_date) meet only queries that may take one of theirs. Null vectors do not take part.
    """
    found = _over_blocks(queries, passages, k, metric, dated, False)
    return _ranked(found, k, metric).select("qid", "rank", "pid", "score")


def top_k_work(queries: DataFrame, passages: DataFrame, k: int, metric: str = "IP", dated: bool = False) -> DataFrame:
    """(blocks, skipped, products) of each task of top_k: blocks of passages, those that met no query, scores computed."""
    return _over_blocks(queries, passages, k, metric, dated, True)


def _over_blocks(queries: DataFrame, passages: DataFrame, k: int, metric: str, dated: bool, work: bool) -> DataFrame:
    dates = ["pubdate"] if dated else []
    q = queries.select("qid", "vector", *dates).filter("vector is not null")
    if dated:
        q = q.filter("pubdate is not null")
    last = F.max("pubdate") if dated else F.lit(None)
    n, width, last = q.agg(F.count("*"), F.max(F.size("vector")), last).first()
    if dated:
        passages = passages.filter(F.col("pubdate") <= F.lit(last).cast(passages.schema["pubdate"].dataType))
    blocks = max(1, -(-n * (8 * (width or 0) + 16) // QUERY_BYTES))
    parts = []
    for b in range(blocks):
        own = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        parts.append(_local_best(own.toPandas(), passages, k, metric, dated, work))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _local_best(frame: pd.DataFrame, passages: DataFrame, k: int, metric: str, dated: bool, work: bool = False) -> DataFrame:
    ids = frame["qid"].to_numpy()
    matrix = np.stack(frame["vector"].to_numpy()).astype(np.float64) if len(frame) else np.zeros((0, 1))
    when = frame["pubdate"].to_numpy() if dated else None
    shared = passages.sparkSession.sparkContext.broadcast((ids, matrix, when))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q, q_when = shared.value
        best = LocalBest(q_ids, q, k, metric, q_when)
        for frame in frames:
            if len(frame) and len(q_ids):
                best.add(frame["pid"].to_numpy(), np.stack(frame["vector"].to_numpy()).astype(np.float64), frame["pubdate"].to_numpy() if dated else None)
        yield pd.DataFrame({"blocks": [best.blocks], "skipped": [best.skipped], "products": [best.products]}) if work else best.rows()

    source = passages.select("pid", "vector", *(["pubdate"] if dated else [])).filter("vector is not null")
    kinds = {f.name: f.dataType for f in source.schema.fields}
    schema = T.StructType([T.StructField("qid", kinds["pid"]), T.StructField("pid", kinds["pid"]), T.StructField("score", T.DoubleType())])
    return source.mapInPandas(run, "blocks bigint, skipped bigint, products bigint" if work else schema)


#: Passages of a cell that one task scores.
CELL_ROWS = 100_000


class ClusteredIndex:
    """Passages in cells of a k-means clustering, stored by cell, so that a search reads the nearest cells only."""

    def __init__(self, path: str, centroids: np.ndarray):
        self.path, self.centroids = path, centroids

    @classmethod
    def build(cls, passages: DataFrame, path: str, cells: int = 16, seed: int = 42) -> ClusteredIndex:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        data = passages.withColumn("features", array_to_vector(F.transform("vector", lambda x: x.cast("double"))))
        model = KMeans(k=cells, seed=seed, featuresCol="features", predictionCol="cell").fit(data.select("features"))
        model.transform(data).drop("features").write.partitionBy("cell").mode("errorifexists").parquet(path)
        return cls(path, np.array(model.clusterCenters()))

    def search(self, queries: DataFrame, k: int, probes: int = 4, metric: str = "IP") -> DataFrame:
        """As top_k, over the `probes` cells nearest to each query. Queries stay distributed: each goes to the blocks of its cells, a block
        holding so many rows that one product takes little memory."""
        spark = queries.sparkSession
        passages = spark.read.parquet(self.path).filter("vector is not null")
        counts = passages.groupBy("cell").count()
        blocks = F.greatest(F.ceil(F.col("count") / CELL_ROWS), F.lit(1)).cast("int")
        sizes = counts.select("cell", blocks.alias("blocks"))
        centroids = spark.sparkContext.broadcast(self.centroids)

        def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                q = np.stack(frame["vector"].to_numpy()).astype(np.float64)
                d = _scores(q, centroids.value, "L2")
                yield frame.assign(cell=list(np.argsort(d, 1, kind="stable")[:, :probes].astype(np.int32)))

        kind = queries.schema["qid"].dataType.simpleString()
        q = queries.select("qid", F.col("vector").cast("array<double>").alias("vector")).filter("vector is not null")
        q = q.mapInPandas(near, f"qid {kind}, vector array<double>, cell array<int>").withColumn("cell", F.explode("cell"))
        q = q.join(sizes, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        n, width = q.agg(F.count("*"), F.max(F.size("vector"))).first()
        parts = max(1, -(-n * (8 * (width or 0) + 16) // QUERY_BYTES))  # all queries may ask for one cell
        q = q.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int"))
        p = passages.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int"))
        p = p.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        key = ["cell", "block", "part"]

        def best(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if own.empty or rows.empty:
                return pd.DataFrame({"qid": pd.Series(dtype="int64"), "pid": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
            found = LocalBest(own["qid"].to_numpy(), np.stack(own["vector"].to_numpy()), k, metric)
            found.add(rows["pid"].to_numpy(), np.stack(rows["vector"].to_numpy()).astype(np.float64))
            return found.rows()

        of = p.schema["pid"].dataType.simpleString()
        sides = q.select(*key, "qid", "vector").groupBy(*key).cogroup(p.select(*key, "pid", "vector").groupBy(*key))
        found = sides.applyInPandas(best, f"qid {kind}, pid {of}, score double")
        return _ranked(found, k, metric).select("qid", "rank", "pid", "score")
