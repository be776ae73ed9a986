"""Relational operators: deduplication, resolution, sampling, statistics, pivots, grids and semi-structured columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as X


def not_longer(df: DataFrame, column: str, n: int = 250_000) -> DataFrame:
    """Rows whose text has at most n characters; a null text has none."""
    return df.filter(F.coalesce(F.length(column), F.lit(0)) <= n)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, whether both hold the same distinct rows: (only_a, only_b, same)."""
    sides = a.distinct().withColumn("_side", F.lit(1)).unionByName(b.distinct().withColumn("_side", F.lit(2)))
    met = sides.groupBy(*a.columns).agg(F.sum("_side").alias("_in"))
    return met.agg(F.count_if(F.col("_in") == 1).alias("only_a"), F.count_if(F.col("_in") == 2).alias("only_b")).withColumn("same", F.col("only_a") + F.col("only_b") == 0)


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def insert_new(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not stored yet, each key once: what an insert that ignores conflicts would add."""
    fresh = rows.dropDuplicates(keys)
    return fresh.join(stored.select(keys), keys, "left_anti")


PREFIX = 100


def resume(stored: DataFrame, rows: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """Rows of (doc, text) that have no stored row of that doc and the same first characters. Null docs equal null docs."""
    key = stored.select(F.col("doc").alias("_doc"), F.substring("text", 1, prefix).alias("_head")).distinct()
    on = rows["doc"].eqNullSafe(key["_doc"]) & F.substring(rows["text"], 1, prefix).eqNullSafe(key["_head"])
    return rows.join(key, on, "left_anti")


def updated(base: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """base with column taken from changes where they have the key."""
    new = changes.select(key, F.col(column).alias("_new"))
    return base.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def resolve_unique(wanted: DataFrame, candidates: DataFrame, key: str, where: Column) -> DataFrame:
    """Pairs of wanted (wid, key, ...) and candidates (cid, key, ...) under `where`, if a wid has exactly one cid."""
    met = wanted.join(candidates, key).filter(where).select("wid", "cid").distinct()
    return met.groupBy("wid").agg(F.count("*").alias("n"), F.min("cid").alias("cid")).filter("n = 1").select("wid", "cid")


def bibcode_matches(author: Column, year: Column, references: Column) -> Column:
    """References that begin with the year and end with the author's initial."""
    initial = F.upper(F.substring(author, 1, 1))
    return F.filter(references, lambda r: r.startswith(F.substring(year, 1, 4)) & r.endswith(initial))


# Sampling by hash: the same rows on every run and every cluster.


def hash_fraction(key: Column, seed: int = 42) -> Column:
    """A number in [0, 1) from the key's md5."""
    hexed = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"/{seed}")).cast("binary")), 1, 8)
    return F.conv(hexed, 16, 10).cast("bigint") / F.lit(float(1 << 32))


def sample(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    return df.filter(hash_fraction(F.col(key), seed) < fraction)


def split(df: DataFrame, key: str, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    u = hash_fraction(F.col(key), seed)
    name = F.when(u < train, "train").when(u < train + val, "val").otherwise("test")
    return df.withColumn("split", name)


def random_of(df: DataFrame, group: str, key: Column, n: int) -> DataFrame:
    """n rows of each group, in order of the key's hash: adds pick from 1."""
    by = Window.partitionBy(group).orderBy(F.md5(key.cast("string").cast("binary")))
    return df.withColumn("pick", F.row_number().over(by)).filter(F.col("pick") <= n)


# Statistics.


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, sample standard deviation, minimum, quartiles by linear interpolation, maximum."""
    c = F.col(column).cast("double")
    q = lambda p: F.percentile(c, F.lit(p))
    return df.agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"),
        q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), F.max(c).alias("max"),
    )


def summary(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """As describe, with the population standard deviation and the median, for each key."""
    c = F.col(column).cast("double")
    q = lambda p: F.percentile(c, F.lit(p))
    return df.groupBy(*keys).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), q(0.5).alias("median"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"),
        F.max(c).alias("max"), q(0.25).alias("p25"), q(0.75).alias("p75"),
    )


def shares(df: DataFrame, key: str) -> DataFrame:
    """Rows of each value, and their percentage of all."""
    counted = df.groupBy(key).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select(key, "n", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 2).alias("pct"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows of each of `bins` equal bins of [low, high); 0 and bins + 1 hold what lies outside."""
    b = F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def grid(df: DataFrame, row: str, column: str, values: list, value: Column) -> DataFrame:
    """One row for each value of `row`, one column for each of values; null where there is none."""
    return df.groupBy(row).pivot(column, values).agg(value)


def invalid_cells(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column) of cells that are null or blank."""
    long = df.select(key, *[F.col(c).cast("string") for c in columns]).unpivot(key, columns, "column", "value")
    return long.filter(F.col("value").isNull() | (X.strip(F.col("value")) == "")).select(key, "column")


def parameter_grid(spark, lengths: tuple[int, int, int], overlaps: tuple[int, int, int], margin: int = 50) -> DataFrame:
    """Every (min_len, overlap) of two ranges (first, end, step) with an overlap of at most min_len - margin."""
    a = spark.range(*lengths).select(F.col("id").alias("min_len"))
    b = spark.range(*overlaps).select(F.col("id").alias("overlap"))
    return a.crossJoin(b).filter(F.col("overlap") <= F.col("min_len") - margin)


# Nested results.


def nested(hits: DataFrame, *columns: str) -> DataFrame:
    """(qid, results): each query's hits, in order of rank."""
    x = F.array_sort(F.collect_list(F.struct("rank", *columns)))
    return hits.groupBy("qid").agg(x.alias("results"))


def flattened(rows: DataFrame) -> DataFrame:
    return rows.select("qid", F.explode("results").alias("r")).select("qid", "r.*")


LOG_LINE = r"^(WARNING|ERROR) - (?:Multiple matches on '(.*)'; choosing (.*)|No close matches found for title: (.*))$"


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """(level, title, chosen) of the lines that tell of title matches; other lines are left out."""
    group = lambda i: F.nullif(F.regexp_extract(column, LOG_LINE, i), F.lit(""))
    return lines.filter(F.col(column).rlike(LOG_LINE)).select(
        group(1).alias("level"), F.coalesce(group(2), group(4)).alias("title"), group(3).alias("chosen")
    )
