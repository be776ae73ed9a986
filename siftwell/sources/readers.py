"""Scans: JSON lines, JSON arrays, CSV, text logs, result trees, artefacts and configuration."""

from __future__ import annotations

import json
from dataclasses import fields
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell import schemas
from siftwell.functions import dates as D
from siftwell.functions import text as X

C = TypeVar("C")
REQUIRED = ("bibcode", "title", "abstract", "body", "doi", "author", "reference", "pubdate")


def jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType, drop_malformed: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed ones too if asked, else they are an error."""
    mode = "DROPMALFORMED" if drop_malformed else "FAILFAST"
    return spark.read.schema(schema).option("mode", mode).json(paths)


def papers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Arrays of raw papers, whole files: those with all required keys, title and doi flattened, keywords renamed, dates repaired, and
    the file each came from."""
    raw = spark.read.schema(schemas.schema("RAW_PAPER")).option("multiLine", True).json(paths)
    whole = raw.withColumn("loaded_from", F.col("_metadata.file_path"))
    kept = schemas.complete_rows(whole, REQUIRED).filter("size(title) > 0 and size(doi) > 0")
    return kept.select(
        "bibcode", F.element_at("title", 1).alias("title"), "abstract", "body", F.element_at("doi", 1).alias("doi"), "author",
        F.col("keyword").alias("keywords"), "reference", D.repaired(F.col("pubdate")).alias("pubdate"), "citation_count", "doctype",
        F.col("doi").alias("dois"), "loaded_from",
    )


def prepared(papers: DataFrame, threshold: int = 60) -> DataFrame:
    """papers with body_sentences: sentences, short ones merged."""
    trimmed = F.transform(X.sentences(F.col("body")), X.strip)
    return papers.withColumn("body_sentences", X.merge_short(F.filter(trimmed, lambda s: s != ""), threshold))


def passages(documents: DataFrame) -> DataFrame:
    """Documents (text, doc_id, pubdate, citation_count?) as passages to chunk; a missing citation count is -1."""
    df = schemas.require_columns(documents, ["text", "doc_id", "pubdate"])
    if "citation_count" not in df.columns:
        df = df.withColumn("citation_count", F.lit(None).cast("bigint"))
    return df.select(F.col("doc_id").alias("doi"), X.without_nul(F.col("text")).alias("text"), "pubdate", F.coalesce("citation_count", F.lit(-1)).alias("citation_count"))


def csv_strings(spark: SparkSession, path: str, schema: str = "CITATION_CONTEXT") -> DataFrame:
    """A CSV file with a header, every cell as it stands: empty cells are empty strings."""
    return spark.read.schema(schemas.schema(schema)).csv(path, header=True, multiLine=True, escape='"').na.fill("")


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def result_tree(spark: SparkSession, root: str, pattern: str = r"gs_min(\d+)_inc(\d+)_ov(\d+)") -> DataFrame:
    """Result JSON files below a folder, with their paths and the parameters in these; older files nest their averages."""
    stats = "average_hitrate_at_k array<double>, average_iou_at_k array<double>, average_recall_at_k array<double>"
    nested = "struct<average_stats:struct<hitrate:array<double>,iou:array<double>,recall:array<double>>>"
    flat = "struct<hitrate:array<double>,iou:array<double>,recall:array<double>>"
    raw = spark.read.schema(f"{stats}, stats {nested}, average_stats {flat}").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    pick = lambda name: F.coalesce(f"average_{name}_at_k", f"average_stats.{name}", f"stats.average_stats.{name}").alias(name)
    path = F.col("_metadata.file_path")
    return raw.select(path.alias("path"), *X.numbers_in(path, pattern, "min_len", "increment", "overlap"), pick("hitrate"), pick("iou"), pick("recall"))


def config(kind: type[C], text: str) -> C:
    """A dataclass from YAML or JSON text; unknown keys are an error that names them."""
    try:
        import yaml

        values = yaml.safe_load(text)
    except ImportError:
        values = json.loads(text)
    unknown = sorted(set(values) - {f.name for f in fields(kind)})
    if unknown:
        raise ValueError(f"{kind.__name__} has no {', '.join(unknown)}")
    return kind(**values)


def binary_text(spark: SparkSession, path: str, extract) -> DataFrame:
    """(path, text) of binary documents; extract turns the bytes of one into text and runs in Arrow batches."""
    import pandas as pd

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: extract(bytes(b)))

    text = run(F.col("content"))
    clean = X.squeeze(F.regexp_replace(F.regexp_replace(text, r"-\n", ""), r"\n", " "))
    return spark.read.format("binaryFile").load(path).select("path", clean.alias("text"))
