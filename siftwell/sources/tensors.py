"""Tables of array files: a data source for tensors that other programs map into memory.

A table is a folder of parts and a manifest. Each part holds one .npy file a column: a vector for numbers, a matrix for arrays that all have
one length, values and offsets for arrays of several lengths and for strings, and a mask where there are nulls. Only parts that the
manifest lists are read; it is written last and moved into its place, so a failed or repeated task leaves nothing that can be seen.
Columns that are not asked for are not opened, and parts whose least and greatest values rule a filter out are not read.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

FORMAT = "tensors"
#: Rows of a part, and of a batch that is read at once.
PART_ROWS, BATCH_ROWS = 1 << 16, 1 << 13
MANIFEST = "_manifest.json"
_NUMBERS = {T.ByteType: "i1", T.ShortType: "<i2", T.IntegerType: "<i4", T.LongType: "<i8", T.FloatType: "<f4", T.DoubleType: "<f8", T.BooleanType: "?"}


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _dtype(kind: T.DataType) -> str:
    kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if type(kind) not in _NUMBERS:
        raise ValueError(f"no array file holds {kind.simpleString()}")
    return _NUMBERS[type(kind)]


def check(schema: T.StructType) -> None:
    for f in schema.fields:
        if not isinstance(f.dataType, T.StringType):
            _dtype(f.dataType)


def _encoded(column: pa.Array, kind: T.DataType) -> tuple[str, dict[str, np.ndarray]]:
    """The shape in which a column is stored, and its arrays by the ends of their names."""
    out = {} if not column.null_count else {".null": column.is_null().to_numpy(zero_copy_only=False)}
    if isinstance(kind, T.StringType):
        parts = [(x or "").encode() for x in column.to_pylist()]
        data = np.frombuffer(b"".join(parts), np.uint8)
        return "string", out | {".values": data, ".offsets": np.cumsum([0] + [len(p) for p in parts]).astype("<i8")}
    if isinstance(kind, T.ArrayType):
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        flat = column.flatten()
        if flat.null_count:
            raise ValueError("array files hold no nulls inside arrays")
        values = flat.to_numpy(zero_copy_only=False).astype(_dtype(kind))
        if len(lengths) and not column.null_count and (lengths == lengths[0]).all():
            return "wide", out | {"": values.reshape(len(lengths), -1)}
        return "ragged", out | {".values": values, ".offsets": np.concatenate(([0], np.cumsum(lengths))).astype("<i8")}
    fill = pa.scalar(False if isinstance(kind, T.BooleanType) else 0, column.type)
    return "flat", out | {"": pc.fill_null(column, fill).to_numpy(zero_copy_only=False).astype(_dtype(kind))}


def _stats(column: pa.Array, kind: T.DataType) -> list | None:
    if isinstance(kind, T.ArrayType) or not len(column) or column.null_count == len(column):
        return None
    low, high = (pc.min_max(column)[k].as_py() for k in ("min", "max"))
    return None if low != low or high != high else [low, high]


@dataclass
class Written(D.WriterCommitMessage):
    parts: list[dict]


class TensorWriter(D.DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        check(schema)
        self.path, self.schema, self.overwrite = path, schema, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        parts, held, n = [], [], 0
        for batch in iterator:
            for i in range(0, batch.num_rows, PART_ROWS):
                held.append(batch.slice(i, PART_ROWS))
                n += held[-1].num_rows
                if n >= PART_ROWS:
                    parts.append(self._part(held))
                    held, n = [], 0
        return Written(parts + ([self._part(held)] if n else []))

    def _part(self, batches: list[pa.RecordBatch]) -> dict:
        fs, root = _fs(self.path)
        name = f"part-{uuid.uuid4().hex}"
        fs.create_dir(f"{root}/{name}", recursive=True)
        table = pa.Table.from_batches(batches)
        shapes, stats = {}, {}
        for f in self.schema.fields:
            column = table.column(f.name).combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            shapes[f.name], arrays = _encoded(column, f.dataType)
            stats[f.name] = _stats(column, f.dataType)
            for end, array in arrays.items():
                with fs.open_output_stream(f"{root}/{name}/{f.name}{end}.npy") as out:
                    buffer = io.BytesIO()
                    np.save(buffer, array, allow_pickle=False)
                    out.write(buffer.getvalue())
            shapes[f.name] += "?" if ".null" in arrays else ""
        return {"name": name, "rows": table.num_rows, "shapes": shapes, "stats": stats}

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        old = [] if self.overwrite else _manifest(self.path, {"parts": []})["parts"]
        new = [p for m in messages if m for p in m.parts]
        beside = f"{root}/{MANIFEST}.{uuid.uuid4().hex}"
        with fs.open_output_stream(beside) as out:
            out.write(json.dumps({"schema": self.schema.jsonValue(), "parts": old + new}).encode())
        fs.move(beside, f"{root}/{MANIFEST}")
        if self.overwrite:
            self._remove({p["name"] for p in new})

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _fs(self.path)
        for m in messages:
            for p in m.parts if m else []:
                fs.delete_dir(f"{root}/{p['name']}")

    def _remove(self, keep: set[str]) -> None:
        from pyarrow.fs import FileSelector, FileType

        fs, root = _fs(self.path)
        for info in fs.get_file_info(FileSelector(root)):
            if info.type == FileType.Directory and info.base_name.startswith("part-") and info.base_name not in keep:
                fs.delete_dir(info.path)


def _manifest(path: str, default: dict | None = None) -> dict:
    from pyarrow.fs import FileType

    fs, root = _fs(path)
    at = f"{root}/{MANIFEST}"
    if default is not None and fs.get_file_info(at).type == FileType.NotFound:
        return default
    with fs.open_input_stream(at) as f:
        return json.loads(f.read())


@dataclass
class Part(D.InputPartition):
    spec: dict


def _rules_out(f: D.Filter, stats: dict) -> bool:
    """Whether no row between the stats passes the filter."""
    name = ".".join(f.attribute) if hasattr(f, "attribute") else None
    low, high = stats.get(name) or (None, None)
    if low is None:
        return False
    match f:
        case D.EqualTo():
            return not low <= f.value <= high
        case D.In():
            return all(v is None or not low <= v <= high for v in f.value)
        case D.GreaterThan():
            return high <= f.value
        case D.GreaterThanOrEqual():
            return high < f.value
        case D.LessThan():
            return low >= f.value
        case D.LessThanOrEqual():
            return low > f.value
    return False


class TensorReader(D.DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema, self.filters = path, schema, []

    def partitions(self) -> list[Part]:
        parts = _manifest(self.path)["parts"]
        return [Part(p) for p in parts if not any(_rules_out(f, p["stats"]) for f in self.filters)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:  # a table without parts
            return
        fs, root = _fs(self.path)
        spec, kinds = partition.spec, to_arrow_schema(self.schema)

        def array(name: str, end: str, start: int, stop: int) -> np.ndarray:
            with fs.open_input_file(f"{root}/{spec['name']}/{name}{end}.npy") as f:
                return _rows(f, start, stop)

        for at in range(0, spec["rows"], BATCH_ROWS):
            end = min(at + BATCH_ROWS, spec["rows"])
            columns = []
            for f in kinds:
                shape = spec["shapes"][f.name]
                null = array(f.name, ".null", at, end) if shape.endswith("?") else None
                columns.append(_decoded(shape.rstrip("?"), lambda e, a, b, name=f.name: array(name, e, a, b), at, end, f.type, null))
            yield pa.record_batch(columns, schema=kinds)


class FilteringReader(TensorReader):
    """For sessions that push filters down to sources in Python; others refuse a reader that would take them."""

    def pushFilters(self, filters: list[D.Filter]):  # noqa: N802
        """All filters are used to leave parts out; Spark applies them to rows as well."""
        self.filters = list(filters)
        yield from self.filters


def _rows(f, start: int, stop: int) -> np.ndarray:
    """Rows start to stop of an open .npy file; only they are read."""
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(f)
    if dtype.hasobject or fortran:
        raise ValueError("only plain arrays in row order are read")
    width = dtype.itemsize * int(np.prod(shape[1:], dtype=np.int64))
    f.seek(f.tell() + start * width)
    return np.frombuffer(f.read((stop - start) * width), dtype).reshape(-1, *shape[1:])


def _decoded(shape: str, array, at: int, end: int, kind: pa.DataType, null: np.ndarray | None) -> pa.Array:
    if shape == "flat":
        return pa.array(array("", at, end), kind, mask=null)
    if shape == "wide":
        values = array("", at, end)
        offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1), kind.value_type), type=kind)
    bounds = array(".offsets", at, end + 1)
    values = array(".values", int(bounds[0]), int(bounds[-1]))
    offsets = pa.array((bounds - bounds[0]).astype(np.int32), mask=None if null is None else np.append(null, False))
    if shape == "ragged":
        return pa.ListArray.from_arrays(offsets, pa.array(values, kind.value_type), type=kind)
    data, cuts = values.tobytes(), (bounds - bounds[0]).tolist()
    texts = [None if null is not None and null[i] else data[cuts[i] : cuts[i + 1]].decode() for i in range(end - at)]
    return pa.array(texts, kind)


class TensorSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(_manifest(self.options["path"])["schema"])

    def reader(self, schema: T.StructType) -> TensorReader:
        kind = FilteringReader if self.options.get("filters") == "true" else TensorReader
        return kind(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> TensorWriter:
        return TensorWriter(self.options["path"], schema, overwrite)


def write(df: DataFrame, path: str, mode: str = "append") -> None:
    """Adds the rows to the table at path, or with mode "overwrite" replaces it. One writer of a table at a time."""
    check(df.schema)
    df.sparkSession.dataSource.register(TensorSource)
    df.write.format(FORMAT).mode(mode).save(path)


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The table at path; with columns, only their files are opened. Filters leave parts out where the session allows it
    (spark.sql.python.filterPushdown.enabled)."""
    spark.dataSource.register(TensorSource)
    reader = spark.read.format(FORMAT).option("filters", spark.conf.get("spark.sql.python.filterPushdown.enabled"))
    if columns is not None:
        whole = T.StructType.fromJson(_manifest(path)["schema"])
        reader = reader.schema(T.StructType([whole[c] for c in columns]))
    return reader.load(path)


def matrices(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, vector) of every row of the .npy matrices that path names (a file, a folder or a pattern), read by Spark; vectors
    have one row a number. Files with objects inside are refused."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                x = x.reshape(len(x), -1).astype(np.float64)
                for at in range(0, len(x), BATCH_ROWS):
                    part = x[at : at + BATCH_ROWS]
                    offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * x.shape[1])
                    vectors = pa.ListArray.from_arrays(offsets, pa.array(part.reshape(-1)))
                    yield pa.record_batch([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), vectors], ["path", "row", "vector"])

    return files.mapInArrow(rows, "path string, row bigint, vector array<double>")
