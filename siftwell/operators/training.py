"""Training of an adapter on triplets that stay distributed.

Every step is one pass over a mini-batch: each task sums the gradients of its rows, the sums meet in a tree, and the driver, which holds
nothing but the weights, takes an Adam step. After an epoch the margin (mean similarity to positives less that to negatives) is taken on
both splits. The weights with the best margin on the validation split are stored; when the margin of the training split has not
improved for some epochs, the negatives are mined anew with the present weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from siftwell.operators import search as S
from siftwell.operators.learn import Adapter

#: Partial sums that reach the driver at most; more are summed by tasks first.
FAN_IN = 32

#: Weights of positives and negatives by (step, all steps).
Weights = Callable[[int, int], tuple[float, float]]


@dataclass(frozen=True)
class Config:
    """loss: "triplet" (negative - positive + margin, at least 0) or "cosine" (1 - positive, and negative - margin, at least 0)."""

    epochs: int = 10
    batches: int = 4
    rate: float = 0.01
    margin: float = 0.1
    loss: str = "triplet"
    weight_decay: float = 0.0
    rebuild_patience: int = 3
    weights: Weights = lambda step, total: (1.0, 1.0)
    seed: int = 42


@dataclass
class Sums:
    """Sums over rows: gradients of both weight matrices, loss, similarities, number."""

    g1: np.ndarray
    g2: np.ndarray
    loss: float
    positive: float
    negative: float
    n: int

    def margin(self) -> float:
        return (self.positive - self.negative) / max(self.n, 1)


def sums(adapter: Adapter, x: np.ndarray, p: np.ndarray, q: np.ndarray, config: Config, weights: tuple[float, float] = (1.0, 1.0)) -> Sums:
    """Of anchors x with their positives p and negatives q."""
    z, gate, h, y, size = adapter._forward(x)
    u = y / size
    to_p, to_q = (u * p).sum(1), (u * q).sum(1)
    if config.loss == "triplet":
        loss = np.maximum(to_q - to_p + config.margin, 0)
        du = (q - p) * (loss > 0)[:, None]
    elif config.loss == "cosine":
        over = np.maximum(to_q - config.margin, 0)
        loss = weights[0] * (1 - to_p) + weights[1] * over
        du = -weights[0] * p + weights[1] * q * (over > 0)[:, None]
    else:
        raise ValueError(f"no loss {config.loss!r}")
    dy = (du - u * (u * du).sum(1, keepdims=True)) / size * (adapter.scale if adapter.residual else 1.0)
    dz = (dy @ adapter.w2.T) * gate * (1 + z * (1 - gate))
    return Sums(x.T @ dz, h.T @ dy, float(loss.sum()), float(to_p.sum()), float(to_q.sum()), len(x))


def total(rows: DataFrame, adapter: Adapter, config: Config, weights: tuple[float, float] = (1.0, 1.0)) -> Sums:
    """The sums over all rows (anchor, positive, negative: arrays), made where the rows are."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(adapter)
    shape1, shape2 = adapter.w1.shape, adapter.w2.shape

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        out = Sums(np.zeros(shape1), np.zeros(shape2), 0.0, 0.0, 0.0, 0)
        for frame in frames:
            if len(frame):
                x, p, q = (np.stack(frame[c].to_numpy()).astype(np.float64) for c in ("anchor", "positive", "negative"))
                add(out, sums(shared.value, x, p, q, config, weights))
        if out.n:
            yield row(TaskContext.get().partitionId(), out)

    def add(to: Sums, other: Sums) -> None:
        to.g1 += other.g1
        to.g2 += other.g2
        to.loss, to.positive, to.negative, to.n = to.loss + other.loss, to.positive + other.positive, to.negative + other.negative, to.n + other.n

    def row(part: int, s: Sums) -> pd.DataFrame:
        return pd.DataFrame({"part": [part], "g1": [s.g1.ravel()], "g2": [s.g2.ravel()], "loss": [s.loss], "positive": [s.positive], "negative": [s.negative], "n": [s.n]})

    def read(frame: pd.DataFrame) -> Sums:
        out = Sums(np.zeros(shape1), np.zeros(shape2), 0.0, 0.0, 0.0, 0)
        for r in frame.sort_values("part").itertuples(index=False):
            add(out, Sums(np.asarray(r.g1).reshape(shape1), np.asarray(r.g2).reshape(shape2), r.loss, r.positive, r.negative, r.n))
        return out

    schema = "part int, g1 array<double>, g2 array<double>, loss double, positive double, negative double, n bigint"
    parts = rows.select("anchor", "positive", "negative").mapInPandas(run, schema)
    branch = F.pmod("part", F.lit(FAN_IN)).cast("int").alias("branch")
    parts = parts.groupBy(branch).applyInPandas(lambda key, frame: row(int(key[0]), read(frame)), schema)
    found = read(parts.toPandas())
    shared.destroy()
    return found


@dataclass
class Adam:
    rate: float
    decay: float = 0.0
    beta: tuple[float, float] = (0.9, 0.999)
    step: int = 0
    moments: list = field(default_factory=list)

    def update(self, weights: list[np.ndarray], gradients: list[np.ndarray]) -> None:
        self.step += 1
        self.moments = self.moments or [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        for w, g, (m, v) in zip(weights, gradients, self.moments, strict=True):
            g = g + self.decay * w
            m += (1 - self.beta[0]) * (g - m)
            v += (1 - self.beta[1]) * (g * g - v)
            w -= self.rate * (m / (1 - self.beta[0] ** self.step)) / (np.sqrt(v / (1 - self.beta[1] ** self.step)) + 1e-8)


def mine(adapter: Adapter, queries: DataFrame, passages: DataFrame, positives: DataFrame, n: int = 3) -> DataFrame:
    """(qid, split, anchor, positive, negative): every positive of a query with each of the n passages nearest to the adapted query that are
    none of its positives. queries: qid, vector, split; passages: pid, vector; positives: qid, pid."""
    known = positives.select("qid", "pid").distinct()
    most = known.groupBy("qid").count().agg(F.max("count")).first()[0] or 0
    near = S.top_k(adapter.apply(queries.select("qid", "vector")), passages, n + most, "IP")
    near = near.join(known, ["qid", "pid"], "left_anti")
    order = F.row_number().over(S.Window.partitionBy("qid").orderBy("rank"))
    near = near.withColumn("place", order).filter(F.col("place") <= n)
    vectors = passages.select("pid", F.col("vector").cast("array<double>").alias("vector"))
    of = lambda df, name: df.select("qid", "pid").join(vectors, "pid").select("qid", F.col("vector").alias(name))
    anchors = queries.select("qid", "split", F.col("vector").cast("array<double>").alias("anchor")).filter("vector is not null")
    return anchors.join(of(known, "positive"), "qid").join(of(near, "negative"), "qid")


def save(spark: SparkSession, adapter: Adapter, path: str) -> None:
    row = [(adapter.w1.shape[0], adapter.w1.shape[1], adapter.w1.ravel().tolist(), adapter.w2.ravel().tolist(), adapter.residual, adapter.scale)]
    schema = "dim int, hidden int, w1 array<double>, w2 array<double>, residual boolean, scale double"
    spark.createDataFrame(row, schema).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Adapter:
    r = spark.read.parquet(path).first()
    return Adapter(np.array(r["w1"]).reshape(r["dim"], r["hidden"]), np.array(r["w2"]).reshape(r["hidden"], r["dim"]), r["residual"], r["scale"])


HISTORY = "epoch int, loss double, train_margin double, val_loss double, val_margin double, rebuilt boolean, best boolean"


def train(adapter: Adapter, triplets: Callable[[Adapter], DataFrame], config: Config, path: str | None = None) -> tuple[Adapter, list[tuple]]:
    """The adapter with the best validation margin, and one row of HISTORY for each epoch.

    triplets gives the rows (qid, split "train" or "val", anchor, positive, negative) for the weights of the moment: `mine`, or a fixed
    table. A row belongs to a batch by a hash of its contents and the epoch, so the batches are the same however rows are
    partitioned. With a path, the best weights so far are stored there, one folder an epoch (the last one complete is the best). Without
    validation rows the last weights are the best; without training rows the weights stay.
    """
    now = Adapter(adapter.w1.copy(), adapter.w2.copy(), adapter.residual, adapter.scale)
    best, history = (Adapter(now.w1.copy(), now.w2.copy(), now.residual, now.scale), -np.inf), []
    rows = triplets(now).persist(StorageLevel.MEMORY_AND_DISK)
    optimizer, top, stale, step = Adam(config.rate, config.weight_decay), -np.inf, 0, 0
    steps = config.epochs * config.batches
    for epoch in range(1, config.epochs + 1):
        own = rows.filter("split = 'train'")
        batch = F.pmod(F.xxhash64("qid", "positive", "negative", F.lit(config.seed + epoch)), F.lit(config.batches))
        seen = Sums(np.zeros(0), np.zeros(0), 0.0, 0.0, 0.0, 0)
        for b in range(config.batches):
            s = total(own.filter(batch == b), now, config, config.weights(step, steps))
            step += 1
            if s.n:
                optimizer.update([now.w1, now.w2], [s.g1 / s.n, s.g2 / s.n])
                seen.loss, seen.positive, seen.negative, seen.n = seen.loss + s.loss, seen.positive + s.positive, seen.negative + s.negative, seen.n + s.n
        val = total(rows.filter("split = 'val'"), now, config, config.weights(step, steps))
        better = val.margin() > best[1] if val.n else True
        if better:
            best = Adapter(now.w1.copy(), now.w2.copy(), now.residual, now.scale), val.margin() if val.n else -np.inf
            if path:
                save(rows.sparkSession, now, f"{path}/epoch-{epoch:05d}")
        stale = 0 if seen.margin() > top else stale + 1
        top = max(top, seen.margin())
        rebuilt = stale >= config.rebuild_patience
        history.append((epoch, seen.loss / max(seen.n, 1), seen.margin(), val.loss / max(val.n, 1), val.margin(), rebuilt, better))
        if rebuilt and epoch < config.epochs:
            rows.unpersist()
            rows = triplets(now).persist(StorageLevel.MEMORY_AND_DISK)
            optimizer, top, stale = Adam(config.rate, config.weight_decay), -np.inf, 0
    rows.unpersist()
    return best[0], history
