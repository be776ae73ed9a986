"""Sinks and the passage store: Parquet tables under a root folder, with the maintenance operations of a vector collection."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import schemas
from siftwell.functions.embed import embed
from siftwell.operators.tables import resume
from siftwell.sources import readers

PASSAGE_COLUMNS = ("doi", "text", "pubdate", "citation_count")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_splits(df: DataFrame, path: str, column: str = "split") -> None:
    df.write.partitionBy(column).parquet(path)


def rewrite(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], fmt: str = "parquet", schema=None) -> None:
    """Replaces a table by what change makes of it: written beside it, then renamed, so a failure leaves the old one."""
    fs, old = _fs(spark, path)
    beside = f"{path.rstrip('/')}.new"
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        change(reader.format(fmt).load(path)).write.format(fmt).mode("overwrite").save(beside)
    except Exception:
        fs.delete(_fs(spark, beside)[1], True)
        raise
    gone = _fs(spark, f"{path.rstrip('/')}.old")[1]
    fs.delete(gone, True)
    fs.rename(old, gone)
    fs.rename(_fs(spark, beside)[1], old)
    fs.delete(gone, True)


def write_result(spark: SparkSession, path: str, config: dict, means: DataFrame) -> dict:
    """The summary of a run, one JSON document: the configuration, averages at every k, and the best recall and IoU."""
    rows = means.orderBy("k").collect()  # one row for each k, whatever the data
    out = {"config": config} | {f"average_{c}_at_k": [r[c] for r in rows] for c in ("hitrate", "iou", "recall")}
    out |= {f"best_{c}_k": max((r[c] for r in rows), default=0.0) for c in ("recall", "iou")}
    fs, p = _fs(spark, path)
    stream = fs.create(p, True)
    stream.write(bytearray(json.dumps(out).encode()))
    stream.close()
    return out


def next_version(spark: SparkSession, root: str) -> str:
    """The folder below root named by the next free integer."""
    fs, p = _fs(spark, root)
    taken = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return f"{root}/{1 + max((int(t) for t in taken if t.isdigit()), default=0)}"


class PassageStore:
    """Collections of passages with vectors, one Parquet folder each."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        fs, p = _fs(self.spark, self.path(name))
        return fs.exists(p)

    def list(self) -> list[str]:
        fs, p = _fs(self.spark, self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def describe(self, name: str) -> dict:
        df = self.read(name)
        row = df.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
        return {"name": name, "rows": row["n"], "dim": row["dim"], "columns": df.dtypes}

    def create(self, name: str, rows: DataFrame, embedder: str, normalize: bool = True) -> int:
        """Embeds and stores the passages that the collection does not hold yet; gives their number.

        rows have exactly the columns of a passage. An existing collection is resumed: passages whose doc and first characters it
        holds are left out."""
        rows = schemas.exact_columns(rows, PASSAGE_COLUMNS)
        if self.exists(name):
            held = self.read(name).select(F.col("doi").alias("doc"), "text")
            rows = resume(held, rows.withColumnRenamed("doi", "doc")).withColumnRenamed("doc", "doi")
        n = rows.count()
        if n:
            embed(rows, "text", "vector", embedder, normalize).write.mode("append").parquet(self.path(name))
        return n

    def duplicate(self, source: str, name: str) -> None:
        self.read(source).write.mode("errorifexists").parquet(self.path(name))

    def rename(self, name: str, new: str) -> None:
        if self.exists(new):
            raise ValueError(f"{new} exists")
        fs, p = _fs(self.spark, self.path(name))
        fs.rename(p, _fs(self.spark, self.path(new))[1])

    def drop(self, name: str) -> None:
        fs, p = _fs(self.spark, self.path(name))
        fs.delete(p, True)

    def export(self, name: str, path: str) -> None:
        self.read(name).drop("id").write.json(path)

    def load(self, path: str, name: str) -> None:
        """From JSON lines of passages with vectors; malformed lines are skipped."""
        kind = schemas.schema("VECTOR_PASSAGE")
        df = readers.jsonl(self.spark, path, kind, drop_malformed=True).drop("id")
        df.filter("vector is not null").write.mode("errorifexists").parquet(self.path(name))

    def vectors(self, name: str) -> DataFrame:
        return self.read(name).select("vector")

    def select_by_doc(self, name: str, doc: str) -> DataFrame:
        return self.read(name).filter(F.col("doi") == doc)


def plan_of(df: DataFrame) -> str:
    """The formatted physical plan, as text."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
