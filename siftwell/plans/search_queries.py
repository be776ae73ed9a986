"""Queries of vector search, merging, evaluation, scoring and mining. Search queries are the vectors whose id 50 divides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import vectors as V
from siftwell.operators import graph as GR
from siftwell.operators import learn as L
from siftwell.operators import merge as M
from siftwell.operators import ranking as R
from siftwell.operators import search as S
from siftwell.operators import tables as T
from siftwell.operators import training as TR
from siftwell.plans.catalog import query, table

K = 20


def _passages(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(
        F.col("vec_id").alias("pid"), F.col("embedding").alias("vector"), F.col("label").alias("doc"), (F.col("vec_id") % 97).alias("pubdate")
    )


def _queries(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").filter("vec_id % 50 = 0")
    targets = F.array("label", "label", ((F.col("label") + 3) % 10).cast("int"))
    return e.select(
        F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"), (F.col("vec_id") % 97).alias("pubdate"), targets.alias("targets"), "label"
    )


def _hits(spark, d, k: int = K, metric: str = "IP", dated: bool = False) -> DataFrame:
    p = _passages(spark, d)
    return S.top_k(_queries(spark, d), p, k, metric, dated).join(p.select("pid", "doc"), "pid")


_PAIRS = """q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS qv, label AS ql, vec_id % 97 AS qdate FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT vec_id AS pid, CAST(embedding AS DOUBLE[]) AS pv, label AS doc, vec_id % 97 AS pubdate FROM embeddings),
s AS (SELECT qid, ql, qdate, pid, doc, pubdate, list_inner_product(qv, pv) AS score,
  list_inner_product(qv, pv) / (sqrt(list_inner_product(qv, qv)) * sqrt(list_inner_product(pv, pv))) AS cosine,
  list_distance(qv, pv) AS l2 FROM q, p WHERE pid <> qid)"""


def _top(k: int = K, where: str = "true", by: str = "score", desc: bool = True) -> str:
    way = "DESC" if desc else "ASC"
    return f"""WITH {_PAIRS},
h AS (SELECT qid, ql, pid, doc, {by} AS score, row_number() OVER (PARTITION BY qid ORDER BY round({by}, 9) {way}, pid) AS rank FROM s WHERE {where} QUALIFY rank <= {k})"""


_SHOW = "SELECT qid, CAST(rank AS INTEGER) AS rank, pid, round(score, 6) AS score FROM h"


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "rank", "pid", V.rounded("score", 6).alias("score"))


@query(_top() + _SHOW)
def knn_topk_ip(spark, d):
    return _shown(_hits(spark, d))


@query(_top(by="l2", desc=False) + _SHOW)
def knn_l2(spark, d):
    return _shown(_hits(spark, d, metric="L2"))


@query(_top(by="cosine") + "SELECT qid, CAST(rank AS INTEGER) AS rank, pid, round(1 - score, 6) AS distance FROM h")
def knn_cosine_distance(spark, d):
    h = _hits(spark, d, metric="COSINE")
    return h.select("qid", "rank", "pid", V.rounded(1 - F.col("score"), 6).alias("distance"))


@query(_top(where="pubdate <= qdate") + _SHOW)
def search_date_filtered(spark, d):
    return _shown(_hits(spark, d, dated=True))


@query(_top() + _SHOW)
def knn_topk_native(spark, d):
    """Scored by built-in expressions, which look at every component: large products of queries and passages go by matrices."""
    return _shown(S.top_k_sized(_queries(spark, d), _passages(spark, d), K))


@query(_top(k=10, by="cosine") + _SHOW)
def graph_search(spark, d):
    """A walk through graphs that keeps half as many passages as a shard holds: on these tables it finds all of the true ones."""
    built = GR.build(_passages(spark, d), m=24, ef_construction=96, metric="COSINE")
    return _shown(GR.search(built, _queries(spark, d), 10, ef_search=400, metric="COSINE"))


@query(_top(k=10, by="l2", desc=False, where="pubdate <= qdate AND qdate < 40") + _SHOW)
def search_early(spark, d):
    """Queries that are all early: the passages after the last of them are never read."""
    return _shown(S.top_k(_queries(spark, d).filter("pubdate < 40"), _passages(spark, d), 10, "L2", dated=True))


_TARGETS = """t AS (SELECT qid, [ql, ql, (ql + 3) % 10] AS targets FROM q),
m AS (SELECT h.qid, h.rank, targets, CASE WHEN row_number() OVER (PARTITION BY h.qid, doc ORDER BY rank) = 1 THEN 1 ELSE 0 END AS first,
  list_contains(targets, doc) AS wanted FROM h JOIN t ON h.qid = t.qid),
a AS (SELECT qid, rank AS k, targets,
  sum(CASE WHEN wanted THEN first ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank) AS found,
  sum(CASE WHEN wanted THEN 0 ELSE first END) OVER (PARTITION BY qid ORDER BY rank) AS missed FROM m),
st AS (SELECT qid, CAST(k AS INTEGER) AS k, CASE WHEN found > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hitrate, CAST(found AS DOUBLE) / len(targets) AS recall,
  CAST(found AS DOUBLE) / (len(list_distinct(targets)) + missed) AS iou FROM a)"""


def _stats(spark, d, k: int = K, dated: bool = False) -> DataFrame:
    return R.stats_at_k(_hits(spark, d, k, dated=dated), _queries(spark, d).select("qid", "targets"))


def _rounded(df: DataFrame, *keys: str, names=("hitrate", "recall", "iou")) -> DataFrame:
    return df.select(*keys, *[F.round(n, 6).alias(n) for n in names])


@query(_top() + f", {_TARGETS} SELECT k, round(avg(hitrate), 6) AS hitrate, round(avg(recall), 6) AS recall, round(avg(iou), 6) AS iou FROM st GROUP BY k")
def metrics_at_k(spark, d):
    return _rounded(R.averages(_stats(spark, d)), "k")


@query(_top() + f", {_TARGETS} SELECT qid, k, round(recall, 6) AS recall FROM st")
def recall_at_k(spark, d):
    return _rounded(_stats(spark, d), "qid", "k", names=["recall"])


@query(_top() + f", {_TARGETS} SELECT qid, k, hitrate FROM st")
def hitrate_at_k(spark, d):
    return _stats(spark, d).select("qid", "k", "hitrate")


@query(_top() + f", {_TARGETS} SELECT qid, k, round(iou, 6) AS iou FROM st")
def iou_at_k(spark, d):
    return _rounded(_stats(spark, d), "qid", "k", names=["iou"])


@query(
    _top(where="pubdate <= qdate", k=60)
    + f""", {_TARGETS}, g AS (SELECT qid, CAST(unnest(range(1, 61)) AS INTEGER) AS k FROM q),
f AS (SELECT g.qid, g.k, hitrate, recall, iou FROM g LEFT JOIN st ON g.qid = st.qid AND g.k = st.k)
SELECT qid, k, {", ".join(f"round(coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY qid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 6) AS {c}" for c in ("hitrate", "recall", "iou"))} FROM f"""
)
def metrics_ffill(spark, d):
    return _rounded(R.filled(_stats(spark, d, 60, dated=True), _queries(spark, d), 60), "qid", "k")


_MEANS = "av AS (SELECT k, avg(hitrate) AS hitrate, avg(recall) AS recall, avg(iou) AS iou FROM st GROUP BY k)"


@query(_top() + f", {_TARGETS}, {_MEANS} SELECT arg_max(k, (round(iou, 12), -k)) AS best_k, round(max(recall), 6) AS best_recall_k, round(max(iou), 6) AS best_iou_k FROM av")
def best_k_iou(spark, d):
    best = R.best_k(R.averages(_stats(spark, d)))
    return best.select("best_k", F.round("best_recall_k", 6).alias("best_recall_k"), F.round("best_iou_k", 6).alias("best_iou_k"))


def _both(first: str, second: str) -> str:
    """Mean statistics of the plain search and of the dated one, as av0 and av1."""
    out = f"WITH {_PAIRS}, t AS (SELECT qid, [ql, ql, (ql + 3) % 10] AS targets FROM q)"
    for i, where in enumerate((first, second)):
        h = f"h{i} AS (SELECT qid, pid, doc, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, pid) AS rank FROM s WHERE {where} QUALIFY rank <= {K})"
        body = _TARGETS.split("\n", 1)[1]
        for name in ("m", "a", "st"):
            body = body.replace(f"{name} AS (SELECT", f"{name}{i} AS (SELECT").replace(f"FROM {name})", f"FROM {name}{i})")
        body = body.replace("FROM h JOIN", f"FROM h{i} h JOIN")
        out += f", {h},\n{body}, " + _MEANS.replace("av AS", f"av{i} AS").replace("FROM st", f"FROM st{i}")
    return out


@query(_both("true", "pubdate <= qdate") + " SELECT b.k, " + ", ".join(f"round(b.{c} - a.{c}, 6) AS {c}" for c in ("hitrate", "recall", "iou")) + " FROM av0 a JOIN av1 b ON a.k = b.k")
def stat_diffs(spark, d):
    return _rounded(R.stat_diffs(R.averages(_stats(spark, d)), R.averages(_stats(spark, d, dated=True))), "k")


@query(_top() + f", {_TARGETS}, {_MEANS} SELECT k, round(hitrate, 6) AS hitrate, round(recall, 6) AS recall FROM av WHERE k IN (5, 10)")
def stats_table(spark, d):
    return _rounded(R.averages(_stats(spark, d)).filter(F.col("k").isin(5, 10)), "k", names=["hitrate", "recall"])


@query(_top() + "SELECT qid, CAST(rank AS INTEGER) AS rank, pid, CAST(count(*) OVER (PARTITION BY qid, doc) AS DOUBLE) AS retrieval_count FROM h")
def score_retrieval_count(spark, d):
    return R.apply_scores(_hits(spark, d), ["retrieval_count"]).select("qid", "rank", "pid", F.col("score_retrieval_count").alias("retrieval_count"))


@query(_top() + "SELECT qid, CAST(rank AS INTEGER) AS rank, pid, round(1.0 / rank, 6) AS reciprocal_rank FROM h")
def score_reciprocal_rank(spark, d):
    return R.apply_scores(_hits(spark, d), ["reciprocal_rank"]).select("qid", "rank", "pid", F.round("score_reciprocal_rank", 6).alias("reciprocal_rank"))


@query(_top() + "SELECT qid, pid, CAST(row_number() OVER (PARTITION BY qid ORDER BY doc DESC, rank) AS INTEGER) AS new_rank FROM h")
def rank_first(spark, d):
    return R.rank_first(_hits(spark, d), "doc", "rank", into="new_rank").select("qid", "pid", "new_rank")


def _scored(spark, d) -> DataFrame:
    h = _hits(spark, d).withColumns(
        {
            "citation_count": (F.col("pid") * 37) % 211,
            "qdate": F.to_date(F.lit("2024-01-01")),
            "pdate": F.date_sub(F.to_date(F.lit("2024-01-01")), (F.col("pid") % 4000).cast("int")),
        }
    )
    return R.apply_scores(h, ["reciprocal_rank", "retrieval_count", "log_citations", "negative_log_years_old", "similarity"])


_SCORES = """, c AS (SELECT qid, rank, pid, doc, 1.0 / rank AS score_reciprocal_rank, CAST(count(*) OVER (PARTITION BY qid, doc) AS DOUBLE) AS score_retrieval_count,
  ln(1 + (pid * 37) % 211) AS score_log_citations, -ln(1 + (pid % 4000) / 365.25) AS score_negative_log_years_old, score AS score_similarity FROM h)"""


@query(_top() + _SCORES + "SELECT qid, CAST(rank AS INTEGER) AS rank, pid, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("score_reciprocal_rank", "score_retrieval_count", "score_log_citations", "score_negative_log_years_old", "score_similarity")) + " FROM c")
def apply_metrics_all(spark, d):
    s = _scored(spark, d)
    return s.select("qid", "rank", "pid", *[V.rounded(c, 6).alias(c) for c in s.columns if c.startswith("score_")])


_RRF = """, r AS (SELECT qid, rank, pid, doc, row_number() OVER (PARTITION BY qid ORDER BY score_log_citations DESC, rank) AS r1,
  row_number() OVER (PARTITION BY qid ORDER BY score_retrieval_count DESC, rank) AS r2,
  row_number() OVER (PARTITION BY qid ORDER BY score_similarity DESC, rank) AS r3 FROM c)"""
_FUSED = {"score_log_citations": 0.2, "score_retrieval_count": 0.3, "score_similarity": 0.5}


@query(
    _top() + _SCORES + _RRF + """, f AS (SELECT *, 0.2 / (r1 + 60) + 0.3 / (r2 + 60) + 0.5 / (r3 + 60) AS rrf FROM r)
SELECT qid, pid, round(rrf, 9) AS rrf, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 12) DESC, rank) AS INTEGER) AS new_rank FROM f"""
)
def rrf_fuse(spark, d):
    return R.fuse(_scored(spark, d), _FUSED, K).select("qid", "pid", F.round("rrf", 9).alias("rrf"), "new_rank")


_GRID = """w AS (SELECT a.i / 10.0::DOUBLE AS w1, b.i / 10.0::DOUBLE AS w2, (10 - a.i - b.i) / 10.0::DOUBLE AS w3 FROM range(0, 11) a(i), range(0, 11) b(i) WHERE a.i + b.i <= 10)"""


@query(
    _top() + _SCORES + _RRF + f""", {_GRID}, f AS (SELECT r.*, w1, w2, w3, w1 / (r1 + 60) + w2 / (r2 + 60) + w3 / (r3 + 60) AS rrf FROM r, w),
n AS (SELECT qid, doc, w1, w2, w3, row_number() OVER (PARTITION BY w1, w2, w3, qid ORDER BY round(rrf, 12) DESC, rank) AS k FROM f),
g AS (SELECT n.qid, w1, w2, w3, k, list_contains([ql, ql, (ql + 3) % 10], doc) AS hit FROM n JOIN q ON n.qid = q.qid WHERE k <= 5),
b AS (SELECT qid, w1, w2, w3, max(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS hit FROM g GROUP BY ALL)
SELECT w1, w2, w3, round(avg(hit), 6) AS hitrate_at_5 FROM b GROUP BY w1, w2, w3"""
)
def rrf_gridsearch(spark, d):
    fused = R.fuse_grid(_scored(spark, d), list(_FUSED), R.weight_grid(spark, 3), K).filter("new_rank <= 5")
    hit = fused.join(_queries(spark, d).select("qid", "targets"), "qid").groupBy("w1", "w2", "w3", "qid").agg(F.max(F.array_contains("targets", F.col("doc")).cast("double")).alias("hit"))
    return hit.groupBy("w1", "w2", "w3").agg(F.round(F.avg("hit"), 6).alias("hitrate_at_5"))


@query(f"WITH {_GRID} SELECT w1, w2, w3 FROM w")
def weight_simplex(spark, d):
    return R.weight_grid(spark, 3)


# Merges. The second list is the dated search, the third that of the vectors with their signs turned in the second half.


def _lists(spark, d, k):
    q, p = _queries(spark, d), _passages(spark, d)
    turned = F.transform("vector", lambda x, i: F.when(i < 32, x).otherwise(-x))
    a = S.top_k(q, p, k)
    b = S.top_k(q, p, k, dated=True)
    c = S.top_k(q.withColumn("vector", turned), p, k)
    return a, b, c


def _list_sql(k: int) -> str:
    cols = "SELECT qid, pid, rank, score"
    return f"""WITH {_PAIRS},
s3 AS (SELECT qid, pid, list_inner_product(list_concat(qv[1:32], list_transform(qv[33:], lambda x: -x)), pv) AS score FROM q, p WHERE pid <> qid),
l AS ({cols}, 0 AS li FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, pid) AS rank FROM s QUALIFY rank <= {k})
  UNION ALL {cols}, 1 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, pid) AS rank FROM s WHERE pubdate <= qdate QUALIFY rank <= {k})
  UNION ALL {cols}, 2 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, pid) AS rank FROM s3 QUALIFY rank <= {k}))"""


def _merged(df: DataFrame) -> DataFrame:
    return df.select("qid", "new_rank", "pid", "list_idx")


_PICK = "SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY {order}) AS INTEGER) AS new_rank, pid, CAST(li AS INTEGER) AS list_idx FROM l WHERE {where} QUALIFY new_rank <= {k}"


@query(_list_sql(K) + _PICK.format(order="rank, li", where="rank <= 7", k=K))
def mqe_interleave(spark, d):
    return _merged(M.multiple_expansion(list(_lists(spark, d, K)), K, interleave=True))


@query(_list_sql(K) + _PICK.format(order="round(score, 9) DESC, li, rank", where="rank <= 7", k=K))
def mqe_sorted(spark, d):
    return _merged(M.multiple_expansion(list(_lists(spark, d, K)), K))


@query(_list_sql(K) + _PICK.format(order="round(score, 9) DESC, li, rank", where="rank <= 10 AND li IN (0, 2)", k=K).replace("CAST(li AS INTEGER)", "CAST(li / 2 AS INTEGER)"))
def mixed_expansion(spark, d):
    a, _, c = _lists(spark, d, K)
    return _merged(M.mixed_expansion(a, c, K))


@query(_list_sql(K) + _PICK.format(order="rank, li", where="rank <= 10 AND li IN (0, 2)", k=K).replace("CAST(li AS INTEGER)", "CAST(li / 2 AS INTEGER)"))
def fifty_fifty(spark, d):
    a, _, c = _lists(spark, d, K)
    return _merged(M.fifty_fifty(a, c, K))


@query(
    _list_sql(K) + """, z AS (SELECT l.qid, l.pid, l.li, l.rank, p.doc, row_number() OVER (PARTITION BY l.qid, p.doc ORDER BY li, rank) AS n FROM l JOIN p ON l.pid = p.pid)
SELECT qid, doc, pid, CAST(li AS INTEGER) AS list_idx, CAST(rank AS INTEGER) AS rank FROM z WHERE n = 1"""
)
def merge_dedup_first(spark, d):
    df = M.numbered(*_lists(spark, d, K)).join(_passages(spark, d).select("pid", "doc"), "pid")
    return M.deduplicated(df).select("qid", "doc", "pid", "list_idx", "rank")


@query(
    _list_sql(K) + """, f AS (SELECT qid, pid AS cid, min((rank, li)) AS place FROM l GROUP BY qid, pid)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY place) AS INTEGER) AS new_rank, cid FROM f QUALIFY new_rank <= 20"""
)
def interleaved_strategy(spark, d):
    df = M.numbered(*_lists(spark, d, K)).select("qid", F.col("list_idx").alias("rep"), F.col("pid").alias("cid"), "score")
    return M.interleaved_distinct(df, K)


@query(_list_sql(K) + ", g AS (SELECT qid, list(pid) FILTER (li = 0) AS a, list(pid) FILTER (li = 2) AS b FROM l GROUP BY qid) SELECT qid, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM g")
def jaccard(spark, d):
    a, _, c = _lists(spark, d, K)
    both = a.groupBy("qid").agg(F.collect_list("pid").alias("a")).join(c.groupBy("qid").agg(F.collect_list("pid").alias("b")), "qid")
    return both.select("qid", F.round(M.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query(_top() + "SELECT qid, list(CAST(rank AS INTEGER) ORDER BY rank) AS ranks, list(pid ORDER BY rank) AS pids FROM h GROUP BY qid")
def nest_results(spark, d):
    n = T.nested(_hits(spark, d), "pid")
    return n.select("qid", F.transform("results", lambda r: r["rank"]).alias("ranks"), F.transform("results", lambda r: r["pid"]).alias("pids"))


# Mining and learning.

_BEST = f"""WITH {_PAIRS}, t AS (SELECT DISTINCT qid, unnest([ql, (ql + 3) % 10]) AS doc FROM q),
b AS (SELECT s.qid, s.doc, s.pid, s.score, row_number() OVER (PARTITION BY s.qid, s.doc ORDER BY round(s.score, 9) DESC, s.pid) AS rank FROM s JOIN t ON s.qid = t.qid AND s.doc = t.doc)"""


@query(_BEST + " SELECT qid, doc, pid, round(score, 6) AS score FROM b WHERE rank = 1")
def best_passage_per_target(spark, d):
    return L.best_passages(_queries(spark, d), _passages(spark, d), vectors=False).select("qid", "doc", "pid", V.rounded("score", 6).alias("score"))


@query(_BEST + " SELECT qid, doc, CAST(rank AS INTEGER) AS rank, pid FROM b WHERE rank <= 3")
def top_positives(spark, d):
    return L.best_passages(_queries(spark, d), _passages(spark, d), 3, False).select("qid", "doc", "rank", "pid")


_NEG = _top(k=400) + ", n AS (SELECT qid, pid, doc, row_number() OVER (PARTITION BY qid ORDER BY rank) AS new_rank FROM h WHERE doc NOT IN (ql, (ql + 3) % 10) QUALIFY new_rank <= 5)"


def _negatives(spark, d, n: int = 5) -> DataFrame:
    targets = _queries(spark, d).select("qid", F.explode("targets").alias("doc"))
    return L.hard_negatives(_hits(spark, d, 400), targets, n)


@query(_NEG + " SELECT qid, CAST(new_rank AS INTEGER) AS new_rank, pid FROM n")
def hard_negatives(spark, d):
    return _negatives(spark, d).select("qid", "new_rank", "pid")


@query(
    _BEST + """, n AS (SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY rank) AS new_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, pid) AS rank FROM s QUALIFY rank <= 400) WHERE doc NOT IN (ql, (ql + 3) % 10) QUALIFY new_rank <= 5)
SELECT b.qid, b.pid AS positive, n.pid AS negative FROM b JOIN n ON b.qid = n.qid WHERE b.rank <= 3"""
)
def triplets(spark, d):
    return L.triplets(L.best_passages(_queries(spark, d), _passages(spark, d), 3, False), _negatives(spark, d))


@query(
    f"""WITH {_PAIRS}, n AS (SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY md5(CAST(pid AS VARCHAR)), pid) AS pick FROM s WHERE doc NOT IN (ql, (ql + 3) % 10))
SELECT qid, pid, CAST(pick AS INTEGER) AS pick FROM n WHERE pick <= 4"""
)
def random_negatives(spark, d):
    return L.random_negatives(_queries(spark, d), _passages(spark, d), 4)


@query(
    _NEG + f""", c AS (SELECT qid, CAST('0x' || substring(md5(CAST(qid AS VARCHAR) || '/42'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.5 AS hard FROM q),
r AS (SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY md5(CAST(pid AS VARCHAR)), pid) AS pick FROM s WHERE doc NOT IN (ql, (ql + 3) % 10) QUALIFY pick <= 4),
b AS (SELECT qid, pid, true AS hard FROM n UNION ALL SELECT qid, pid, false FROM r)
SELECT qid, first(pid ORDER BY md5(qid || '/' || pid || '/42'), pid) AS pid, hard FROM b JOIN c USING (qid, hard) GROUP BY qid, hard"""
)
def mixed_negatives(spark, d):
    return L.mixed_negatives(_negatives(spark, d), L.random_negatives(_queries(spark, d), _passages(spark, d), 4))


@query()
def adapter_training(spark, d):
    """The history of a short training: queries of one label, negatives mined anew by the weights of the moment."""
    queries = _queries(spark, d).select("qid", "vector", F.when(F.col("qid") % 200 == 0, "val").otherwise("train").alias("split"), "label")
    passages = _passages(spark, d)
    near = S.top_k(queries, passages, 200, "IP").join(passages.select("pid", "doc"), "pid").join(queries.select("qid", "label"), "qid")
    positives = near.filter("doc = label").withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).filter("n <= 2").select("qid", "pid")
    dim = len(passages.first()["vector"])
    _, history = TR.train(L.Adapter.new(dim, 32), lambda now: TR.mine(now, queries, passages, positives, 2), TR.Config(epochs=2, batches=2))
    return spark.createDataFrame(history, TR.HISTORY)


_MARGINS = _NEG + """, x AS (SELECT qid, max(score) AS hard FROM (SELECT n.qid, h.score FROM n JOIN h ON n.qid = h.qid AND n.pid = h.pid) GROUP BY qid),
y AS (SELECT h.qid, list(h.score ORDER BY h.rank) AS sims FROM h WHERE doc IN (ql, (ql + 3) % 10) AND rank <= 400 GROUP BY h.qid),
z AS (SELECT y.qid, list_transform(sims, lambda v: round(v - hard, 6)) AS margins FROM x JOIN y ON x.qid = y.qid)"""


def _margins(spark, d) -> DataFrame:
    neg = _negatives(spark, d).groupBy("qid").agg(F.max("score").alias("hard"))
    h = _hits(spark, d, 400).join(_queries(spark, d).select("qid", "targets"), "qid").filter(F.array_contains("targets", F.col("doc")))
    sims = h.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("x"))
    return sims.join(neg, "qid").select("qid", F.transform("x", lambda s: V.rounded(s["score"] - F.col("hard"), 6)).alias("margins"))


@query(_MARGINS + " SELECT qid, margins FROM z")
def margins(spark, d):
    return _margins(spark, d)


@query(_MARGINS + " SELECT qid, len(list_filter(margins, lambda v: v < 0)) > 0 AS has_negative FROM z")
def exists_negative_margin(spark, d):
    return _margins(spark, d).select("qid", F.exists("margins", lambda m: m < 0).alias("has_negative"))


@query(_MARGINS + " SELECT qid, list_transform(range(1, len(margins)), lambda i: round(margins[i] - margins[i + 1], 6)) AS diffs FROM z")
def margin_diffs(spark, d):
    m = _margins(spark, d)
    later = F.slice("margins", F.lit(2), F.greatest(F.size("margins") - 1, F.lit(0)))
    earlier = F.slice("margins", F.lit(1), F.greatest(F.size("margins") - 1, F.lit(0)))
    return m.select("qid", F.zip_with(earlier, later, lambda a, b: V.rounded(a - b, 6)).alias("diffs"))


@query(
    _NEG + """, w AS (SELECT n.qid, n.pid, n.new_rank, h.score FROM n JOIN h ON n.qid = h.qid AND n.pid = h.pid)
SELECT qid, pid, round(1.0 / count(*) OVER (PARTITION BY qid), 6) AS uniform, CAST(ntile(4) OVER (PARTITION BY qid ORDER BY round(score, 9), new_rank DESC) AS DOUBLE) AS bins,
  round(greatest(score, 0) / sum(greatest(score, 0)) OVER (PARTITION BY qid), 6) AS cosine, round((1.0 / new_rank) / sum(1.0 / new_rank) OVER (PARTITION BY qid), 6) AS inverse_rank FROM w"""
)
def negative_weights(spark, d):
    n = _negatives(spark, d)
    kinds = ("uniform", "bins", "cosine", "inverse_rank")
    return n.select("qid", "pid", *[F.round(L.negative_weights(k, F.col("score"), F.col("new_rank")), 6).alias(k) for k in kinds])


@query(
    f"""WITH {_PAIRS} SELECT qid, count(*) AS n, round(avg(CASE WHEN doc IN (ql, (ql + 3) % 10) THEN 1 - cosine ELSE greatest(0, cosine - 0.1) END), 6) AS loss FROM s GROUP BY qid"""
)
def cosine_embedding_loss(spark, d):
    losses = L.cosine_losses(_queries(spark, d), _passages(spark, d))
    return losses.select("qid", "n", F.round("loss", 6).alias("loss"))


@query(
    """WITH s AS (SELECT unnest(range(0, 4001, 50)) AS step)
SELECT step, round(least(step / 4000.0, 1), 6) AS basic, round(CASE WHEN step < 1000 THEN 0 ELSE least(0.5 * (step - 1000) / 3000.0, 0.5) END, 6) AS slow,
  round(CASE WHEN step < 2000 THEN 0 ELSE least((step - 2000) / 2000.0, 1) END, 6) AS late, 0.0::DOUBLE AS positive_only FROM s"""
)
def loss_schedule(spark, d):
    step, total = F.col("id"), F.lit(4000.0)
    names = {"basic": "linear_basic", "slow": "linear_slow", "late": "linear_late", "positive_only": "positive_only"}
    return spark.range(0, 4001, 50).select(step.alias("step"), *[F.round(L.SCHEDULES[f](step, total)[1].cast("double"), 6).alias(n) for n, f in names.items()])


# Vectors.


@query(
    """WITH v AS (SELECT unnest(range(0, len(embedding))) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)
SELECT CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM v GROUP BY pos"""
)
def vector_mean(spark, d):
    m = L.mean_vector(table(spark, d, "embeddings"), "embedding")
    return m.select("pos", V.rounded("mean", 6).alias("mean"), V.rounded("std", 6).alias("std"))


@query(
    """WITH v AS (SELECT unnest(range(0, len(embedding))) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
m AS (SELECT avg(x) AS mean, var_samp(x) AS var FROM v GROUP BY pos) SELECT round(sum(var), 6) AS var_trace, round(sqrt(sum(mean * mean)), 6) AS mean_norm FROM m"""
)
def vector_var_trace(spark, d):
    m = L.mean_vector(table(spark, d, "embeddings"), "embedding")
    return m.agg(V.rounded(F.sum("var"), 6).alias("var_trace"), V.rounded(F.sqrt(F.sum(F.col("mean") * F.col("mean"))), 6).alias("mean_norm"))


@query(
    f"""{_top(k=1)} SELECT qid, pid, round(score, 6) AS ip, round(score / (sqrt(list_inner_product(qv, qv)) * sqrt(list_inner_product(pv, pv))), 6) AS cosine FROM h JOIN q USING (qid) JOIN p USING (pid)"""
)
def cosine_pairs(spark, d):
    q, p = _queries(spark, d).select("qid", F.col("vector").alias("qv")), _passages(spark, d).select("pid", F.col("vector").alias("pv"))
    h = _hits(spark, d, 1).join(q, "qid").join(p, "pid")
    return h.select("qid", "pid", V.rounded("score", 6).alias("ip"), V.rounded(V.cosine(F.col("qv"), F.col("pv")), 6).alias("cosine"))


@query(
    """SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm,
  list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6)) AS unit FROM embeddings"""
)
def l2_normalize(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", V.rounded(V.norm(F.col("embedding")), 6).alias("norm"), F.transform(V.normalized(F.col("embedding")), lambda x: V.rounded(x, 6)).alias("unit"))


@query(
    """WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x + i / 640.0) AS y FROM embeddings)
SELECT vec_id, list_transform(y, lambda x: round(x / sqrt(list_inner_product(y, y)), 6)) AS shifted FROM v"""
)
def diff_vector_apply(spark, d):
    difference = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i / F.lit(640.0))
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.transform(V.shifted(F.col("embedding"), difference), lambda x: V.rounded(x, 6)).alias("shifted"))


@query(
    _BEST + """, w AS (SELECT unnest(range(0, 64)) AS pos, unnest(list_transform(list_zip(pv, qv), lambda z: z[1] - z[2])) AS x FROM b JOIN p ON b.pid = p.pid JOIN q ON b.qid = q.qid WHERE rank = 1)
SELECT CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS mean FROM w GROUP BY pos"""
)
def mean_difference_vector(spark, d):
    q = _queries(spark, d)
    best = L.best_passages(q, _passages(spark, d)).join(q.select("qid", F.col("vector").alias("qv")), "qid")
    m = L.mean_vector(best.select(V.subtracted(F.col("vector"), F.col("qv")).alias("diff")), "diff")
    return m.select("pos", V.rounded("mean", 6).alias("mean"))


@query()
def all_but_top(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    mean, parts, _ = L.principal(e, "embedding")
    out = L.without_top(e, "embedding", mean, parts, 2, "reduced")
    return out.select("vec_id", F.transform("reduced", lambda x: V.rounded(x, 6)).alias("reduced"))


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, len(embedding) AS n FROM embeddings)
SELECT vec_id, list_concat([round(sqrt(list_inner_product(e, e)), 6)], list_transform(range(1, n), lambda i: round(CASE WHEN i < n - 1
  THEN atan2(sqrt(list_sum(list_transform(e[i + 1:n], lambda x: x * x))), e[i]) ELSE atan2(e[n], e[n - 1]) END, 6))) AS spherical FROM v"""
)
def to_spherical(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.transform(V.to_spherical(F.col("embedding")), lambda x: V.rounded(x, 6)).alias("spherical"))


@query(
    """SELECT vec_id, list_concat(CAST(embedding AS FLOAT[]), list_transform(range(0, 6), lambda i: 0::FLOAT)) AS padded FROM embeddings"""
)
def pad_arrays(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.padded(F.col("embedding"), F.lit(70)).alias("padded"))
