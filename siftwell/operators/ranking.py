"""Ranks, scores, fusion and evaluation of search hits in long form: one row a hit, (qid, rank, ...)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import dates as D
from siftwell.functions import text as X

RRF_K = 60


def rank_first(df: DataFrame, score: str, position: str, group: str = "qid", into: str = "rank") -> DataFrame:
    """Descending ranks, ties by position; null scores come last and have no rank."""
    by = Window.partitionBy(group).orderBy(F.desc_nulls_last(score), position)
    return df.withColumn(into, F.when(F.col(score).isNotNull(), F.row_number().over(by)))


# Scores: name -> function of the hits, giving a column.
SCORES: dict[str, Callable[[], Column]] = {}


def score(name: str):
    def wrap(fn: Callable[[], Column]) -> Callable[[], Column]:
        SCORES[name] = fn
        return fn

    return wrap


def get_score(name: str) -> Callable[[], Column]:
    if name not in SCORES:
        raise KeyError(f"no score {name}; there are {', '.join(sorted(SCORES))}")
    return SCORES[name]


@score("reciprocal_rank")
def reciprocal_rank() -> Column:
    return F.lit(1.0) / F.col("rank")


@score("retrieval_count")
def retrieval_count() -> Column:
    """Hits of the same document in the query's list."""
    return F.count("*").over(Window.partitionBy("qid", "doc")).cast("double")


@score("log_citations")
def log_citations() -> Column:
    return F.log1p(F.greatest(F.col("citation_count"), F.lit(0)).cast("double"))


@score("negative_log_years_old")
def negative_log_years_old() -> Column:
    """Of dates qdate (the query's) and pdate; a passage younger than its query is an error."""
    years = D.years_between(F.col("qdate"), F.col("pdate"))
    checked = F.when(years < 0, F.raise_error(F.lit("a passage is younger than its query"))).otherwise(years)
    return -F.log1p(checked)


@score("similarity")
def similarity() -> Column:
    return F.col("score")


def apply_scores(hits: DataFrame, names: list[str], dry_run: bool = False) -> DataFrame:
    """hits with a column score_<name> each; a dry run takes two hits only."""
    df = hits.orderBy("qid", "rank").limit(2) if dry_run else hits
    return df.withColumns({f"score_{n}": get_score(n)() for n in names})


def bm25(queries: DataFrame, corpus: DataFrame, k1: float = 1.5, b: float = 0.75, per_query: bool = False, kind: str = "okapi") -> DataFrame:
    """(qid, pid, bm25) of the pairs that share a term.

    queries: qid, query; corpus: pid, text. per_query: the corpus has a qid, and each query is scored among its own hits only, as
    though they were the whole corpus. kind: "okapi" (terms are tokens(), each counts once in a query) or "robertson" (terms are
    long_tokens(), each counts as often as the query has it, terms of half the passages or more weigh nothing, no factor k1 + 1)."""
    if kind not in ("okapi", "robertson"):
        raise ValueError(f"no kind {kind} of BM25; there are okapi, robertson")
    cut = X.tokens if kind == "okapi" else X.long_tokens
    own = ["qid"] if per_query else []
    rows = corpus.select(*own, "pid", F.coalesce("text", F.lit("")).alias("text"))
    sizes = rows.select(*own, F.size(cut(F.col("text"))).alias("dl")).groupBy(*own).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    repeated = not rows.groupBy(*own, "pid").count().filter("count > 1").isEmpty()
    if repeated:  # rows of one passage and one length count as one text
        same = rows.groupBy(*own, "pid", F.size(cut(F.col("text"))).alias("dl"))
        rows = same.agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
        words = rows.select(*own, "pid", "dl", cut(F.col("text")).alias("w"))
    else:
        words = rows.select(*own, "pid", cut(F.col("text")).alias("w")).select(*own, "pid", F.size("w").alias("dl"), "w")
    asked = queries.select("qid", F.explode(cut(F.coalesce("query", F.lit("")))).alias("term"))
    asked = asked.groupBy("qid", "term").agg((F.lit(1) if kind == "okapi" else F.count("*")).cast("int").alias("times"))
    if per_query:
        scored = _bm25_own(words, sizes, asked, k1, b, kind)
    elif asked.count() <= BM25_TERMS:
        scored = _bm25_shipped(words, sizes, asked, k1, b, kind)
    else:
        scored = _bm25_joined(words, sizes, asked, k1, b, kind)
    return scored.groupBy("qid", "pid").agg(F.sum("bm25").alias("bm25")) if repeated else scored


#: Words of all queries together that go to the tasks as they are; of more, words of passages meet them in joins.
BM25_TERMS = 1 << 19
#: Terms of scores that a task sums at once, at most.
BM25_SUMS = 1 << 21


def _idf(n: Column, df: Column, times: Column, k1: float, kind: str) -> Column:
    odds = (n - df + 0.5) / (df + 0.5)
    return F.log1p(odds) * (k1 + 1) if kind == "okapi" else F.log(F.greatest(odds, F.lit(1.0))) * times


def _bm25_own(words: DataFrame, sizes: DataFrame, asked: DataFrame, k1: float, b: float, kind: str) -> DataFrame:
    """Each passage meets its own query's words in one row, so words of passages are neither dealt nor sorted: its counts stay arrays."""
    terms = asked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term", "times"))).alias("terms"))
    met = words.join(terms, "qid").select("qid", "pid", "dl", "w", F.col("terms.term").alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, times = [], [], []
            for i, (w, t) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                place = {term: j for j, term in enumerate(t)}
                had = Counter(place[x] for x in w if x in place)
                if had:
                    at.append(i)
                    found.append(sorted(had))
                    times.append([had[j] for j in found[-1]])
            kept = batch.select([0, 1, 2]).take(pa.array(at, pa.int64()))
            ints = pa.list_(pa.int32())
            yield pa.record_batch([*kept.columns, pa.array(found, ints), pa.array(times, ints)], ["qid", "pid", "dl", "at", "f"])

    types = {c: words.schema[c].dataType.simpleString() for c in ("qid", "pid")}
    packed = met.mapInArrow(count, f"qid {types['qid']}, pid {types['pid']}, dl int, at array<int>, f array<int>")
    whole = terms.select("qid", F.posexplode("terms").alias("at", "x")).select("qid", "at", F.lit(0).alias("c"), F.col("x.times").alias("times"))
    held = packed.select("qid", F.explode("at").alias("at")).select("qid", "at", F.lit(1).alias("c"), F.lit(0).alias("times"))
    each = whole.unionByName(held).groupBy("qid", "at").agg(F.sum("c").alias("df"), F.max("times").alias("times")).join(sizes, "qid")
    each = each.select("qid", "avgdl", "at", _idf(F.col("n"), F.col("df"), F.col("times"), k1, kind).alias("idf"))
    weights = each.groupBy("qid", "avgdl").agg(F.array_sort(F.collect_list(F.struct("at", "idf"))).alias("weights"))
    weights = weights.select("qid", "avgdl", F.col("weights.idf").alias("idf"))
    base = k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    parts = F.zip_with("at", "f", lambda i, f: F.get(F.col("idf"), i) * f / (f + base))
    return packed.join(weights, "qid").select("qid", "pid", F.aggregate(parts, F.lit(0.0), lambda x, y: x + y).alias("bm25"))


def _bm25_shipped(words: DataFrame, sizes: DataFrame, asked: DataFrame, k1: float, b: float, kind: str) -> DataFrame:
    """The words of all queries go to the tasks, with their idf from a scan before; a passage's sums are made where it is read, without a shuffle."""
    terms = asked.select("term").distinct()
    df = words.select(F.explode(F.array_distinct("w")).alias("term")).join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("df"))
    size = sizes.first()
    avgdl = size["avgdl"] or 1.0
    known = asked.join(F.broadcast(df), "term").withColumn("idf", _idf(F.lit(size["n"]), F.col("df"), F.col("times"), k1, kind))
    known = known.select("qid", "term", "idf").toArrow().combine_chunks()
    ids, vocabulary = ((pa.array([], c.type).dictionary_encode() if not len(c) else c.chunk(0).dictionary_encode(null_encoding="encode")) for c in (known["qid"], known["term"]))
    term_of = vocabulary.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(term_of, kind="stable")
    whose, idf = ids.indices.to_numpy(zero_copy_only=False)[order].astype(np.int64), known["idf"].to_numpy()[order]
    first = np.searchsorted(term_of[order], np.arange(len(vocabulary.dictionary) + 1))
    qids, vocabulary = ids.dictionary, vocabulary.dictionary
    n_asked = max(len(qids), 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BM25_SUMS // max(len(whose), 1))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                lists = batch.column(2)
                term = pc.index_in(lists.flatten(), value_set=vocabulary.cast(lists.type.value_type))
                row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                term = pc.fill_null(term, -1).to_numpy(zero_copy_only=False).astype(np.int64)
                pair, f = np.unique(row[term >= 0] * len(vocabulary) + term[term >= 0], return_counts=True)
                row, term = np.divmod(pair, max(len(vocabulary), 1))
                dl = batch.column(1).to_numpy(zero_copy_only=False)[row]
                part = f / (f + k1 * (1 - b + b * dl / avgdl))
                n = first[term + 1] - first[term]
                at = np.repeat(first[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
                to = np.repeat(row, n) * n_asked + whose[at]
                got = np.flatnonzero(np.bincount(to, minlength=1))
                total = np.bincount(to, np.repeat(part, n) * idf[at], minlength=1)[got]
                yield pa.record_batch([qids.take(pa.array(got % n_asked)), batch.column(0).take(pa.array(got // n_asked)), pa.array(total, pa.float64())], ["qid", "pid", "bm25"])

    types = asked.schema["qid"].dataType.simpleString(), words.schema["pid"].dataType.simpleString()
    return words.select("pid", "dl", "w").mapInArrow(score, f"qid {types[0]}, pid {types[1]}, bm25 double")


def _bm25_joined(words: DataFrame, sizes: DataFrame, asked: DataFrame, k1: float, b: float, kind: str) -> DataFrame:
    # Only words that some query has are counted: all others end in the task that reads them.
    every = words.select("pid", "dl", F.explode("w").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    wanted = every.groupBy("pid", "dl", "term").agg(F.count("*").alias("f"))
    df_of = wanted.groupBy("term").agg(F.count("*").alias("df"))
    met = wanted.join(df_of, "term").crossJoin(F.broadcast(sizes)).join(asked, "term")
    part = _idf(F.col("n"), F.col("df"), F.col("times"), k1, kind) * F.col("f") / (F.col("f") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return met.groupBy("qid", "pid").agg(F.sum(part).alias("bm25"))


#: Rerankers: name -> function of (queries, texts), lists of one length, giving a score or a pair of logits (no, yes) each.
RERANKERS: dict[str, Callable[[list[str], list[str]], Sequence]] = {}
BATCH = 16


def reranker(name: str):
    def wrap(fn: Callable[[list[str], list[str]], Sequence]) -> Callable[[list[str], list[str]], Sequence]:
        RERANKERS[name] = fn
        return fn

    return wrap


@reranker("overlap")
def overlap(queries: list[str], texts: list[str]) -> list[tuple[float, float]]:
    """An offline stand-in for a model: logits are the logarithms of the query's distinct words that a text lacks and has, plus one."""
    out = []
    for q, t in zip(queries, texts, strict=True):
        asked, held = (set(re.findall("[a-z0-9_]+", re.sub("[A-Z]", lambda m: m[0].lower(), x))) for x in (q, t))
        out.append((math.log(len(asked - held) + 1), math.log(len(asked & held) + 1)))
    return out


def softmax_yes(no: float, yes: float) -> float:
    """The share of the second of two logits."""
    top = max(no, yes)
    return math.exp(yes - top) / (math.exp(no - top) + math.exp(yes - top))


def rerank(hits: DataFrame, name: str, query: str = "query", text: str = "text", into: str = "score_rerank", batch: int = BATCH) -> DataFrame:
    """hits with the scores of a registered reranker, which is given `batch` pairs at once; logits become the probability of yes. Null
    queries and texts are empty. Hits stay in their partitions."""
    if name not in RERANKERS:
        raise KeyError(f"no reranker {name}; there are {', '.join(sorted(RERANKERS))}")
    model = RERANKERS[name]

    @F.pandas_udf("double")
    def scored(q: pd.Series, t: pd.Series) -> pd.Series:
        asked, texts = q.fillna("").tolist(), t.fillna("").tolist()
        out: list[float] = []
        for i in range(0, len(asked), batch):
            found = model(asked[i : i + batch], texts[i : i + batch])
            out += [softmax_yes(*x) if isinstance(x, (tuple, list)) else float(x) for x in found]
        return pd.Series(out, dtype="float64")

    return hits.withColumn(into, scored(F.col(query), F.col(text)))


def fuse(hits: DataFrame, weights: dict[str, float], top_k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion of score columns among the first top_k hits: adds rrf and new_rank.

    The ranks of a score are those of rank_first, by the old rank; a null score adds nothing."""
    df = hits.filter(F.col("rank") <= top_k)
    for name in weights:
        df = rank_first(df, name, "rank", into=f"_r_{name}")
    terms = [F.coalesce(F.lit(float(w)) / (F.col(f"_r_{n}") + rrf_k), F.lit(0.0)) for n, w in weights.items()]
    df = df.withColumn("rrf", reduce(lambda a, c: a + c, terms)).drop(*[f"_r_{n}" for n in weights])
    by = Window.partitionBy("qid").orderBy(F.desc(F.round("rrf", 12)), "rank")
    return df.withColumn("new_rank", F.row_number().over(by))


def weight_grid(spark, dim: int, steps: int = 10) -> DataFrame:
    """All weights w1..w<dim> that are multiples of 1/steps and sum to one, counted in whole steps."""
    if dim < 2:
        raise ValueError("a grid of weights needs two dimensions")
    df = spark.range(steps + 1).select(F.col("id").alias("n1"))
    for i in range(2, dim):
        df = df.crossJoin(spark.range(steps + 1).select(F.col("id").alias(f"n{i}")))
    rest = F.lit(steps) - reduce(lambda a, c: a + c, [F.col(f"n{i}") for i in range(1, dim)])
    df = df.withColumn(f"n{dim}", rest).filter(F.col(f"n{dim}") >= 0)
    return df.select(*[(F.col(f"n{i}") / steps).alias(f"w{i}") for i in range(1, dim + 1)])


def fuse_grid(hits: DataFrame, names: list[str], weights: DataFrame, top_k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Every hit under every weight vector (w1.. for the names in order): adds weights, rrf and new_rank in one job."""
    df = hits.filter(F.col("rank") <= top_k)
    for name in names:
        df = rank_first(df, name, "rank", into=f"_r_{name}")
    df = df.crossJoin(F.broadcast(weights))
    terms = [F.coalesce(F.col(f"w{i + 1}") / (F.col(f"_r_{n}") + rrf_k), F.lit(0.0)) for i, n in enumerate(names)]
    ws = [f"w{i + 1}" for i in range(len(names))]
    by = Window.partitionBy(*ws, "qid").orderBy(F.desc(F.round("rrf", 12)), "rank")
    df = df.withColumn("rrf", reduce(lambda a, c: a + c, terms)).drop(*[f"_r_{n}" for n in names])
    return df.withColumn("new_rank", F.row_number().over(by))


def stats_at_k(hits: DataFrame, targets: DataFrame, keys: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """(qid, k, hitrate, recall, iou) for every k up to the number of a query's hits.

    targets: qid, targets (array of documents). hit rate: whether any target is among the first k; recall: distinct targets found over
    all targets, repeats counted; IoU: of the sets of targets and of retrieved documents. No targets: all are 0.
    """
    keys = keys or ["qid"]
    joined = hits.join(targets, "qid").withColumn("wanted", F.array_contains("targets", F.col("doc")))
    first = F.row_number().over(Window.partitionBy(*keys, "doc").orderBy(rank)) == 1
    marked = joined.withColumns({"new_hit": (first & F.col("wanted")).cast("int"), "new_miss": (first & ~F.col("wanted")).cast("int")})
    upto = Window.partitionBy(*keys).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    found, missed = F.sum("new_hit").over(upto), F.sum("new_miss").over(upto)
    n, distinct = F.size("targets"), F.size(F.array_distinct("targets"))
    return marked.select(
        *keys,
        F.col(rank).alias("k"),
        F.when(found > 0, 1.0).otherwise(0.0).alias("hitrate"),
        F.when(n == 0, 0.0).otherwise(found / F.greatest(n, F.lit(1))).alias("recall"),
        F.when(n == 0, 0.0).otherwise(found / F.greatest(distinct + missed, F.lit(1))).alias("iou"),
    )


def filled(stats: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """stats for every k up to top_k: beyond a query's last hit its last values are repeated; without hits they are 0."""
    grid = queries.select("qid", F.explode(F.sequence(F.lit(1), F.lit(top_k))).alias("k"))
    upto = Window.partitionBy("qid").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(stats, ["qid", "k"], "left")
    return full.select("qid", "k", *[F.coalesce(F.last(c, ignorenulls=True).over(upto), F.lit(0.0)).alias(c) for c in ("hitrate", "recall", "iou")])


def averages(stats: DataFrame, *keys: str) -> DataFrame:
    return stats.groupBy(*keys, "k").agg(*[F.avg(c).alias(c) for c in ("hitrate", "recall", "iou")])


def best_k(means: DataFrame) -> DataFrame:
    """The first k of the greatest IoU, and the greatest recall and IoU."""
    return means.agg(
        F.max_by("k", F.struct(F.round("iou", 12), -F.col("k"))).alias("best_k"),
        F.max("recall").alias("best_recall_k"),
        F.max("iou").alias("best_iou_k"),
    )


def stat_diffs(old: DataFrame, new: DataFrame) -> DataFrame:
    named = old.select("k", *[F.col(c).alias(f"old_{c}") for c in ("hitrate", "recall", "iou")])
    return new.join(named, "k").select("k", *[(F.col(c) - F.col(f"old_{c}")).alias(c) for c in ("hitrate", "recall", "iou")])
