"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


#: Spark removes a query's shuffle files at its end; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The temporary folder of each application that has no setting.
_OWN: dict[str, str] = {}

BATCH_SETTING, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset: on one machine (as in tests) a temporary folder, on a cluster an error."""
    named = spark.conf.get(SETTING, None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        named = _OWN[app] if app in _OWN else _OWN.setdefault(app, f"file://{tempfile.mkdtemp(prefix='siftwell-')}")
    return named.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in batches of at most BATCH rows: the session's default of 10,000 takes tens of megabytes a batch,
    on both sides, of an executor's memory. A smaller setting of the session's stays."""
    if int(spark.conf.get(BATCH_SETTING, "10000")) > BATCH:
        spark.conf.set(BATCH_SETTING, str(BATCH))


class Scratch:
    """Written tables that cut lineage: a lost executor costs a re-read, not a recomputation.

    Each table is written once as Parquet below the shared folder and read back with its own schema (so an empty
    table keeps its columns). drop() and only() remove tables that no later plan reads; the rest goes when Python exits.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/siftwell-{uuid.uuid4().hex}"
        self.n = 0
        self.live: dict[str, str] = {}
        atexit.register(self._remove, self.root)

    @contextlib.contextmanager
    def settings(self, batch: int = BATCH):
        """Within it, shuffle files go with their query and Arrow batches hold at most so many rows; then the session is as before."""
        conf = self.spark.conf
        before = {name: conf.get(name, None) for name in (CLEANUP, BATCH_SETTING)}
        conf.set(CLEANUP, "true")
        conf.set(BATCH_SETTING, str(min(batch, int(before[BATCH_SETTING] or 10_000))))
        try:
            yield
        finally:
            for name, value in before.items():
                conf.unset(name) if value is None else conf.set(name, value)

    def keep(self, df: DataFrame, name: str, batch: int = BATCH, codec: str | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        with self.settings(batch):
            df.write.options(**({"compression": codec} if codec else {})).parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        read.siftwell_path = path
        self.live[path] = name
        return read

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self.live.pop(df.siftwell_path, None)
            self._remove(df.siftwell_path)

    def only(self, *tables: DataFrame) -> None:
        """Drops every table but these: what an operator calls once its result reads nothing else."""
        keep = {df.siftwell_path for df in tables}
        for path in [p for p in self.live if p not in keep]:
            del self.live[path]
            self._remove(path)

    def _remove(self, path: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is None:  # the session has ended
            return
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


#: Sets that a task unfolds into rows of elements.
TASK_SETS = 8192


def spread(df: DataFrame, n_rows: int, by: str) -> DataFrame:
    """df dealt by a column over tasks of about TASK_SETS rows: adaptive execution would deal it by its bytes, which are few before it is unfolded."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n_rows // TASK_SETS)), by)


def maybe_broadcast(df: DataFrame, n_rows: int, row_bytes: int, limit: int = 16 << 20) -> DataFrame:
    """df with a broadcast hint if its measured size keeps within limit; beyond it Spark shuffles."""
    return df.hint("broadcast") if n_rows * row_bytes <= limit else df
