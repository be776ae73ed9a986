"""Tables that several writers append to, batch by batch, each batch once.

A batch is written into a folder of its own and counts from the moment its commit file is there. That file is made in one step that
fails where it exists, so of two writers of one batch one wins, and writers of different batches do not meet. What a writer that died has
left is never read; `vacuum` removes it. The commits say what is done, so that a run that broke off goes on with the rest.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG, DATA = "_commits", "data"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class CommitTable:
    """Batches of rows as Parquet (or another format) below a root folder."""

    def __init__(self, spark: SparkSession, root: str, fmt: str = "parquet"):
        self.spark, self.root, self.fmt = spark, root.rstrip("/"), fmt

    def _log(self, batch: str) -> str:
        return f"{self.root}/{LOG}/{batch.encode().hex()}.json"

    def commits(self) -> list[dict]:
        """The commits, by time: batch, folder, rows, time. One small file a batch."""
        fs, p = _fs(self.spark, f"{self.root}/{LOG}")
        if not fs.exists(p):
            return []
        # Files that a writer has made but not yet filled belong to batches that are not there yet.
        lines = self.spark.read.text(f"{self.root}/{LOG}/*.json").collect() if fs.listStatus(p) else []
        return sorted((json.loads(r["value"]) for r in lines), key=lambda c: (c["time"], c["batch"]))

    def done(self, batch: str) -> bool:
        fs, p = _fs(self.spark, self._log(batch))
        return fs.exists(p)

    def append(self, batch: str, rows: DataFrame) -> bool:
        """Writes the batch and commits it; False, and nothing written that counts, if it is there already."""
        if self.done(batch):
            return False
        folder = f"{DATA}/{uuid.uuid4().hex}"
        rows.write.format(self.fmt).save(f"{self.root}/{folder}")
        return self._commit(batch, folder)

    def _commit(self, batch: str, folder: str) -> bool:
        n = self._read([folder]).count()
        entry = json.dumps({"batch": batch, "folder": folder, "rows": n, "time": time.time()}).encode()
        fs, full = _fs(self.spark, f"{self.root}/{LOG}/.{uuid.uuid4().hex}")
        out = fs.create(full, False)
        out.write(bytearray(entry))
        out.close()
        mark = _fs(self.spark, self._log(batch))[1]
        # A lock that only one can make goes before the file that counts, which then appears whole.
        lock = _fs(self.spark, f"{self._log(batch)}.lock")[1]
        if not (self._only(fs, lock) and fs.rename(full, mark)):
            fs.delete(full, False)
            fs.delete(_fs(self.spark, f"{self.root}/{folder}")[1], True)
            return False
        return True

    def _only(self, fs, path) -> bool:
        """Whether this writer, and no other, has made the file."""
        try:
            fs.create(path, False).close()
        except Exception:  # it exists: the message differs between file systems
            if fs.exists(path):
                return False
            raise
        return True

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.format(self.fmt).load([f"{self.root}/{f}" for f in folders])

    def read(self) -> DataFrame:
        """The rows of all committed batches."""
        found = self.commits()
        if not found:
            raise FileNotFoundError(f"{self.root} has no committed batch")
        return self._read([c["folder"] for c in found])

    def remaining(self, rows: DataFrame, key: str) -> DataFrame:
        """Those of rows whose key no committed batch holds: what a run that broke off has still to do."""
        found = self.commits()
        return rows.join(self._read([c["folder"] for c in found]).select(key).distinct(), key, "left_anti") if found else rows

    def vacuum(self, older_than: float = 86_400.0) -> list[str]:
        """Removes data, locks and unfinished commits that no commit names and that are older (seconds); gives the folders."""
        keep, gone = {c["folder"] for c in self.commits()}, []
        limit = (time.time() - older_than) * 1000
        fs, p = _fs(self.spark, f"{self.root}/{DATA}")
        for s in fs.listStatus(p) if fs.exists(p) else []:
            name = f"{DATA}/{s.getPath().getName()}"
            if name not in keep and s.getModificationTime() <= limit:
                fs.delete(s.getPath(), True)
                gone.append(name)
        fs, p = _fs(self.spark, f"{self.root}/{LOG}")
        names = {s.getPath().getName(): s for s in fs.listStatus(p)} if fs.exists(p) else {}
        for name, s in names.items():
            dead = name.startswith(".") or (name.endswith(".lock") and name.removesuffix(".lock") not in names)
            if dead and s.getModificationTime() <= limit:
                fs.delete(s.getPath(), False)
        return sorted(gone)


def progress(table: CommitTable) -> DataFrame:
    """(batch, rows, seconds): what is committed and how long after the one before."""
    found = table.commits()
    rows = [(c["batch"], c["rows"], c["time"] - (found[i - 1]["time"] if i else c["time"])) for i, c in enumerate(found)]
    return table.spark.createDataFrame(rows, "batch string, rows bigint, seconds double").orderBy(F.col("batch"))
