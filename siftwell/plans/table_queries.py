"""Queries of scans, filters, joins, aggregates, windows, text, dates and nested columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import dates as D
from siftwell.functions import text as X
from siftwell.functions import vectors as V
from siftwell.operators import extract as E
from siftwell.operators import learn as L
from siftwell.operators import merge as M
from siftwell.operators import ranking as R
from siftwell.operators import segment as G
from siftwell.operators import tables as T
from siftwell.operators import titles as S
from siftwell.plans.catalog import folder, query, table
from siftwell.sources import plans as P
from siftwell.sources import tensors
from siftwell.sources.commits import CommitTable
from siftwell.streaming import windows as SW

# Sources, sinks and maintenance.


@query("SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents")
def scan_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query(
    """WITH l AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'WARNING - Multiple matches on ''' || url || '''; choosing ' || page_id
  WHEN page_id % 3 = 1 THEN 'ERROR - No close matches found for title: ' || url ELSE 'INFO - ' || url END AS value FROM pages)
SELECT CASE page_id % 3 WHEN 0 THEN 'WARNING' ELSE 'ERROR' END AS level, split_part(split_part(value, CASE page_id % 3 WHEN 0 THEN 'on ''' ELSE 'title: ' END, 2), '''; choosing', 1) AS title,
  CASE page_id % 3 WHEN 0 THEN CAST(page_id AS VARCHAR) END AS chosen FROM l WHERE page_id % 3 < 2"""
)
def log_parse(spark, d):
    p = table(spark, d, "pages")
    third = F.col("page_id") % 3
    line = (
        F.when(third == 0, F.concat(F.lit("WARNING - Multiple matches on '"), "url", F.lit("'; choosing "), F.col("page_id").cast("string")))
        .when(third == 1, F.concat(F.lit("ERROR - No close matches found for title: "), "url"))
        .otherwise(F.concat(F.lit("INFO - "), "url"))
    )
    return T.parse_log(p.select(line.alias("value")))


@query(
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '-\n', '', 'g'), '\s+', ' ', 'g')) AS text FROM pages"""
)
def page_text_clean(spark, d):
    return table(spark, d, "pages").select("page_id", X.page_text(F.col("html")).alias("text"))


_STORED = "SELECT source AS doc, substring(text, 1, 100) AS head FROM documents WHERE lang = 'en'"


@query(f"WITH k AS ({_STORED}) SELECT doc_id FROM documents x WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc = x.source AND k.head = substring(x.text, 1, 100))")
def resume_anti_join(spark, d):
    rows = table(spark, d, "documents").withColumnRenamed("source", "doc")
    return T.resume(rows.filter("lang = 'en'"), rows).select("doc_id")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "embeddings", "nation", "pages", "region")))
def catalog_counts(spark, d):
    parts = [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("documents", "embeddings", "nation", "pages", "region")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def update_from_join(spark, d):
    base = table(spark, d, "documents").select("doc_id", F.lit(-1).alias("quality"))
    return T.updated(base, table(spark, d, "labels"), "doc_id", "quality")


@query(
    """SELECT n_name, round(100.0::DOUBLE * sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) / nullif(count(c_custkey), 0), 2) AS pct
FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name"""
)
def pct_nullif(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    j = n.join(c, n["n_nationkey"] == c["c_nationkey"], "left")
    good = F.sum(F.when(F.col("c_acctbal") > 0, 1).otherwise(0))
    return j.groupBy("n_name").agg(F.round(F.lit(100.0) * good / F.nullif(F.count("c_custkey"), F.lit(0)), 2).alias("pct"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 49 OR l_discount = 0.1 ORDER BY l_quantity DESC, l_orderkey, l_linenumber")
def filter_or_sort3(spark, d):
    x = table(spark, d, "lineitem").filter("l_quantity > 49 OR l_discount = 0.1")
    return x.select("l_orderkey", "l_linenumber", "l_quantity").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber")


# Filters.


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) - INTERVAL 30 DAY FROM orders)")
def scalar_subquery_filter(spark, d):
    o = table(spark, d, "orders")
    last = o.agg((F.max("o_orderdate") - F.expr("INTERVAL 30 DAYS")).alias("last"))
    return o.join(F.broadcast(last), F.col("o_orderdate") < F.col("last")).select("o_orderkey")


@query("SELECT conv_id, turn, text FROM conversations WHERE conv_id = 7")
def select_by_doc(spark, d):
    return table(spark, d, "conversations").filter("conv_id = 7").select("conv_id", "turn", "text")


@query("SELECT doc_id, md5('Title: ' || source || chr(10) || chr(10) || 'Abstract: ' || lang || chr(10) || chr(10) || text) AS assembled FROM documents")
def doc_assemble(spark, d):
    whole = F.concat(F.lit("Title: "), "source", F.lit("\n\nAbstract: "), "lang", F.lit("\n\n"), "text")
    return table(spark, d, "documents").select("doc_id", F.md5(whole).alias("assembled"))


@query("SELECT doc_id, n_chars FROM documents WHERE length(text) >= 5000")
def filter_min_length(spark, d):
    return table(spark, d, "documents").filter(F.length("text") >= 5000).select("doc_id", "n_chars")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_seen(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_targets(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").filter("quality = 1"), "doc_id", "left_semi").select("doc_id")


@query(
    r"""WITH t AS (SELECT conv_id, turn, len(regexp_extract_all(text, '[A-Za-z]{12,}')) AS n FROM conversations)
SELECT CASE WHEN n IS NULL THEN 'none' WHEN n > 0 THEN 'nontrivial' ELSE 'trivial' END AS route, count(*) AS rows FROM t GROUP BY 1"""
)
def route_by_array_size(spark, d):
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]{12,})"), F.lit(1))
    n = F.when(F.col("text").isNotNull(), F.size(words))
    route = F.when(n.isNull(), "none").when(n > 0, "nontrivial").otherwise("trivial")
    return table(spark, d, "conversations").groupBy(route.alias("route")).agg(F.count("*").alias("rows"))


@query("SELECT p_partkey, substring(p_name, 5, 5) AS code FROM part WHERE substring(p_name, 5, 5) NOT IN ('l rin', 'e rin', ' ring')")
def substr_not_in(spark, d):
    code = F.substring("p_name", 5, 5)
    return table(spark, d, "part").filter(~code.isin("l rin", "e rin", " ring")).select("p_partkey", code.alias("code"))


@query(
    """WITH t AS (SELECT conv_id * 1000 + turn AS key, CASE WHEN turn % 2 = 0 THEN role END AS a, CASE WHEN length(text) < 60 THEN ' ' ELSE text END AS b FROM conversations)
SELECT key, 'a' AS "column" FROM t WHERE a IS NULL OR trim(a) = '' UNION ALL SELECT key, 'b' FROM t WHERE b IS NULL OR trim(b) = ''"""
)
def invalid_cells_unpivot(spark, d):
    c = table(spark, d, "conversations")
    t = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("a"), F.when(F.length("text") < 60, " ").otherwise(F.col("text")).alias("b"))
    return T.invalid_cells(t, "key", ["a", "b"])


@query(
    """WITH a AS (SELECT o_orderkey, list(l_returnflag ORDER BY l_linenumber) AS modes FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)
SELECT o_orderkey FROM a WHERE len(list_filter(modes, lambda m: starts_with(lower(m), 'r'))) > 0"""
)
def author_prefix_exists(spark, d):
    modes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("modes"))
    o = table(spark, d, "orders").join(modes, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.filter(F.exists("modes", lambda m: F.lower(m).startswith("r"))).select("o_orderkey")


# Joins.


def _papers(spark, d) -> DataFrame:
    """Conversations as documents: their texts in order."""
    x = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return x.select(
        F.col("conv_id").cast("string").alias("doi"), F.concat(F.lit("Conversation "), "conv_id").alias("title"), F.lit("none").alias("abstract"),
        F.transform("x", lambda s: s["text"]).alias("body_sentences"),
    )


def _asked(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("source_doi"), F.col("text").alias("sent_no_cit"), F.col("turn").cast("int").alias("sent_idx"))


def _expanded(spark, d, name: str) -> DataFrame:
    out = M.expand(_asked(spark, d), _papers(spark, d), name)
    return out.select(F.col("source_doi").cast("bigint").alias("conv_id"), F.col("sent_idx").cast("bigint").alias("turn"), "query")


def _previous_sql(n: int) -> str:
    return f"coalesce(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), '') || ' ' || text"


def _register_previous(n: int) -> None:
    @query(f"SELECT conv_id, turn, {_previous_sql(n)} AS query FROM conversations", name=f"expand_prev_{n}")
    def run(spark, d):
        return _expanded(spark, d, f"add_prev_{n}")


for _n in (1, 2, 3, 5, 7):
    _register_previous(_n)


@query("SELECT conv_id, turn, text AS query FROM conversations")
def expand_join_context(spark, d):
    return _expanded(spark, d, "identity")


_TITLE = "chr(10) || chr(10) || 'Title' || chr(10) || 'Conversation ' || conv_id"


@query(f"SELECT conv_id, turn, 'IMPORTANT:' || chr(10) || text || {_TITLE} AS query FROM conversations")
def expand_title(spark, d):
    return _expanded(spark, d, "add_title")


@query(f"SELECT conv_id, turn, 'IMPORTANT:' || chr(10) || {_previous_sql(3)} || {_TITLE} AS query FROM conversations")
def expand_title_prev_3(spark, d):
    return _expanded(spark, d, "add_title_prev_3")


@query(
    """SELECT l_orderkey AS wid, min(s_suppkey) AS cid FROM (SELECT DISTINCT l_orderkey, s_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 5000)
GROUP BY l_orderkey HAVING count(*) = 1"""
)
def resolve_unique_candidate(spark, d):
    wanted = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("wid"), F.col("l_suppkey").alias("key"))
    found = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cid"), F.col("s_suppkey").alias("key"), "s_acctbal")
    return T.resolve_unique(wanted, found, "key", F.col("s_acctbal") > 5000)


@query("SELECT c_custkey, r_name FROM customer CROSS JOIN (SELECT r_name FROM region WHERE r_regionkey = 2)")
def cross_join_single_row(spark, d):
    one = table(spark, d, "region").filter("r_regionkey = 2").select("r_name")
    return table(spark, d, "customer").select("c_custkey").crossJoin(F.broadcast(one))


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def inner_join_topk(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_name", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query(
    """SELECT conv_id, round(CAST(sum(length(text)) FILTER (role = 'assistant') AS DOUBLE) / sum(length(text)), 6) AS share FROM conversations GROUP BY conv_id"""
)
def length_proportion(spark, d):
    mine = F.sum(F.when(F.col("role") == "assistant", F.length("text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.round(mine.cast("double") / F.sum(F.length("text")), 6).alias("share"))


def _titles(spark, d) -> tuple[DataFrame, DataFrame]:
    """Titles as they stand in a catalogue (the beginnings of documents, and short names), and noisy ones: two letters exchanged, an
    article before or a word fewer, half of a title, other signs, short names with a letter more or less."""
    first = table(spark, d, "documents").select("doc_id", F.substring_index(F.substring("text", 1, 70), " ", 6).alias("title")).filter("length(title) > 12")
    name = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("title"))
    cut = F.substring_index("title", " ", -5)
    noisy = F.element_at(
        F.array(
            F.concat(F.substring("title", 2, 1), F.substring("title", 1, 1), F.expr("substring(title, 3)")),
            F.concat(F.lit("The "), F.upper("title")), cut, F.concat(cut, F.lit("-")), F.substring("title", 1, 14), F.reverse("title"),
        ),
        F.pmod(F.col("doc_id"), F.lit(6)).cast("int") + 1,
    )
    short = F.when(F.col("k") % 2 == 0, F.substring("title", 2, 4)).otherwise(F.concat(F.lit("l"), F.substring("title", 1, 5)))
    wanted = first.filter("doc_id % 10 < 2").select(noisy.alias("title")).unionByName(name.filter("k % 40 < 2").select(short.alias("title")))
    return wanted, first.select("title").unionByName(name.select("title"))


@query()
def title_cascade(spark, d):
    return S.resolve_titles(*_titles(spark, d))


@query()
def similar_titles(spark, d):
    wanted, known = _titles(spark, d)
    normal = lambda df, name: df.select(X.normal_title(F.col("title")).alias(name))
    return S.most_similar(normal(wanted, "a"), normal(known, "b"), 0.7).withColumn("ratio", F.round("ratio", 6))


@query(r"""SELECT p_partkey, lower(regexp_replace(p_name, '[^\p{L}\p{N}]', '', 'g')) AS norm FROM part""")
def norm_title(spark, d):
    return table(spark, d, "part").select("p_partkey", X.normal_title(F.col("p_name")).alias("norm"))


@query(
    """WITH t AS (SELECT n_nationkey, lower(n_name) AS a, lower(r_name) AS b FROM nation, region)
SELECT n_nationkey, b, (contains(b, substring(a, 1, CAST(floor(length(a) / 2) AS INTEGER))) AND length(a) > 1) OR contains(b, substring(a, CAST(floor(length(a) / 2) AS INTEGER) + 1))
  OR (contains(a, substring(b, 1, CAST(floor(length(b) / 2) AS INTEGER))) AND length(b) > 1) OR contains(a, substring(b, CAST(floor(length(b) / 2) AS INTEGER) + 1)) AS held FROM t"""
)
def half_contains(spark, d):
    t = table(spark, d, "nation").crossJoin(F.broadcast(table(spark, d, "region"))).select("n_nationkey", F.lower("n_name").alias("a"), F.lower("r_name").alias("b"))
    return t.select("n_nationkey", "b", X.half_contains(F.col("a"), F.col("b")).alias("held"))


@query(
    """WITH t AS (SELECT DISTINCT lower(n_name) AS a, lower(r_name) AS b FROM nation, region)
SELECT a, b, CAST(levenshtein(a, b) AS INTEGER) AS distance FROM t QUALIFY row_number() OVER (PARTITION BY a ORDER BY levenshtein(a, b), b) = 1"""
)
def fuzzy_levenshtein(spark, d):
    t = table(spark, d, "nation").crossJoin(F.broadcast(table(spark, d, "region"))).select(F.lower("n_name").alias("a"), F.lower("r_name").alias("b")).distinct()
    return T.first_of(t.withColumn("distance", F.levenshtein("a", "b")), ["a"], ["distance", "b"]).select("a", "b", "distance")


@query()
def close_matches(spark, d):
    t = table(spark, d, "nation").crossJoin(F.broadcast(table(spark, d, "region")))
    return S.close_matches(t.select(F.lower("n_name").alias("a"), F.lower("r_name").alias("b")), 0.3)


# Aggregates.


@query("SELECT count(DISTINCT label) AS n, list(DISTINCT label ORDER BY label) AS labels FROM embeddings")
def distinct_targets(spark, d):
    return table(spark, d, "embeddings").agg(F.countDistinct("label").alias("n"), F.array_sort(F.collect_set("label")).alias("labels"))


@query("SELECT text_md5, doc_id FROM (SELECT md5(text) AS text_md5, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_first(spark, d):
    keyed = table(spark, d, "documents").select(F.md5("text").alias("text_md5"), "doc_id")
    return keyed.groupBy("text_md5").agg(F.min("doc_id").alias("doc_id"))


_STATS = "round(avg(x), 6) AS mean, round({std}(x), 6) AS std, min(x) AS min, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.75) AS p75, max(x) AS max"


def _round_stats(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("SELECT count(x) AS n, quantile_cont(x, 0.5) AS p50, " + _STATS.format(std="stddev_samp") + " FROM (SELECT CAST(length(text) AS DOUBLE) AS x FROM documents)")
def describe_lengths(spark, d):
    return _round_stats(T.describe(table(spark, d, "documents").select(F.length("text").alias("x")), "x"))


@query("SELECT lang, count(x) AS n, median(x) AS median, " + _STATS.format(std="stddev_pop") + " FROM (SELECT lang, CAST(length(text) AS DOUBLE) AS x FROM documents) GROUP BY lang")
def summary_stats(spark, d):
    return _round_stats(T.summary(table(spark, d, "documents").select("lang", F.length("text").alias("x")), "x", "lang"))


@query("SELECT l_orderkey, list(l_partkey ORDER BY l_partkey) AS parts FROM lineitem GROUP BY l_orderkey")
def collect_multimap(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("parts"))


@query("SELECT toxic, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM labels), 2) AS pct FROM labels GROUP BY toxic")
def verdict_pct(spark, d):
    return T.shares(table(spark, d, "labels"), "toxic")


@query("SELECT label, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT label, list_sum(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY label")
def cluster_stats(spark, d):
    e = table(spark, d, "embeddings").select("label", V.total(F.transform("embedding", lambda x: x.cast("double"))).alias("x"))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"))


@query(
    """WITH g AS (SELECT l_linestatus, l_returnflag, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL)
SELECT l_linestatus, l_returnflag, round(v, 4) AS best FROM g ORDER BY v DESC, l_linestatus, l_returnflag LIMIT 1"""
)
def grid_argmax(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.avg("l_extendedprice").alias("v"))
    return g.orderBy(F.desc("v"), "l_linestatus", "l_returnflag").limit(1).select("l_linestatus", "l_returnflag", F.round("v", 4).alias("best"))


@query(
    """SELECT l_linestatus, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS A, round(avg(l_quantity) FILTER (l_returnflag = 'N'), 6) AS N,
  round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS R FROM lineitem GROUP BY l_linestatus"""
)
def pivot_grid(spark, d):
    return T.grid(table(spark, d, "lineitem"), "l_linestatus", "l_returnflag", ["A", "N", "R"], F.round(F.avg("l_quantity"), 6))


@query("SELECT CAST(CASE WHEN x < 0 THEN 0 WHEN x >= 10000 THEN 51 ELSE floor(x / 200.0) + 1 END AS BIGINT) AS bin, count(*) AS n FROM (SELECT length(text) AS x FROM documents) GROUP BY 1")
def histogram(spark, d):
    return T.histogram(table(spark, d, "documents").select(F.length("text").alias("x")), "x", 0, 10000, 50)


# Windows.


@query(
    r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.?!]\s)(\S)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents),
f AS (SELECT doc_id, list_reduce(list_transform(s, lambda x: {'done': []::VARCHAR[], 'buf': x}), lambda a, b: CASE WHEN length(a.buf) + length(b.buf) < 60
  THEN {'done': a.done, 'buf': a.buf || b.buf || ' '}
  ELSE {'done': CASE WHEN a.buf = '' THEN a.done ELSE list_append(a.done, regexp_replace(a.buf, '^\s+|\s+$', '', 'g')) END, 'buf': b.buf} END, {'done': []::VARCHAR[], 'buf': ''}) AS f FROM s)
SELECT doc_id, CASE WHEN f.buf = '' THEN f.done ELSE list_append(f.done, regexp_replace(f.buf, '^\s+|\s+$', '', 'g')) END AS merged FROM f"""
)
def merge_short_sentences(spark, d):
    s = F.filter(F.transform(X.sentences(F.col("text")), X.strip), lambda s: s != "")
    return table(spark, d, "documents").select("doc_id", X.merge_short(s).alias("merged"))


@query(
    """WITH b AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS place, sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations)
SELECT conv_id, turn, CAST(lead(coalesce(place, 0), 1, total) OVER (PARTITION BY conv_id ORDER BY turn) - coalesce(place, 0) AS BIGINT) AS length FROM b"""
)
def boundary_lengths(spark, d):
    by = Window.partitionBy("conv_id").orderBy("turn")
    before = F.sum(F.length("text")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum(F.length("text")).over(Window.partitionBy("conv_id"))
    b = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(before, F.lit(0)).alias("at"), total.alias("total"))
    return b.select("conv_id", "turn", (F.coalesce(F.lead("at").over(by), F.col("total")) - F.col("at")).alias("length"))


@query(
    """WITH l AS (SELECT o_custkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step FROM orders)
SELECT o_custkey, coalesce(bool_and(step > 0), true) AS rising FROM l GROUP BY o_custkey"""
)
def monotone_check(spark, d):
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    steps = table(spark, d, "orders").select("o_custkey", (F.col("o_totalprice") - F.lag("o_totalprice").over(by)).alias("step"))
    return steps.groupBy("o_custkey").agg(F.coalesce(F.bool_and(F.col("step") > 0), F.lit(True)).alias("rising"))


@query(
    """WITH s AS (SELECT c_mktsegment, CAST(sum(o_totalprice) AS DOUBLE) AS v FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment)
SELECT c_mktsegment, round(sum(v) OVER (ORDER BY v DESC, c_mktsegment) / sum(v) OVER (), 6) AS share FROM s"""
)
def cumulative_share(spark, d):
    s = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").agg(F.sum("o_totalprice").cast("double").alias("v"))
    upto = Window.orderBy(F.desc("v"), "c_mktsegment").rowsBetween(Window.unboundedPreceding, 0)
    return s.select("c_mktsegment", F.round(F.sum("v").over(upto) / F.sum("v").over(Window.partitionBy(F.lit(0))), 6).alias("share"))


# Sampling, sets and grids.

_UNIT = "CAST('0x' || substring(md5(CAST({key} AS VARCHAR) || '/42'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query(f"SELECT doc_id FROM documents WHERE {_UNIT.format(key='doc_id')} < 0.1")
def hash_sample(spark, d):
    return T.sample(table(spark, d, "documents"), "doc_id", 0.1).select("doc_id")


@query(f"WITH u AS (SELECT doc_id, {_UNIT.format(key='doc_id')} AS u FROM documents) SELECT doc_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split FROM u")
def hash_split(spark, d):
    return T.split(table(spark, d, "documents"), "doc_id").select("doc_id", "split")


@query("SELECT DISTINCT c_nationkey AS k FROM customer UNION SELECT n_nationkey FROM nation")
def union_dedup(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    return a.unionByName(b).distinct()


def _keys(spark, d) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return o, table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"))


_SETS = "SELECT o_custkey AS k FROM orders {op} SELECT c_custkey FROM customer WHERE c_acctbal > 0"


@query(_SETS.format(op="INTERSECT"))
def set_intersect(spark, d):
    a, b = _keys(spark, d)
    return a.intersect(b)


@query(_SETS.format(op="EXCEPT"))
def set_except(spark, d):
    a, b = _keys(spark, d)
    return a.subtract(b)


@query(_SETS.format(op="UNION"))
def set_union(spark, d):
    a, b = _keys(spark, d)
    return a.union(b).distinct()


@query("SELECT a.i AS min_len, b.i AS overlap FROM range(100, 1001, 100) a(i), range(0, 501, 50) b(i) WHERE b.i <= a.i - 50")
def param_grid(spark, d):
    return T.parameter_grid(spark, (100, 1001, 100), (0, 501, 50))


# Nested columns and text.


@query("SELECT l_orderkey, unnest(list_distinct(list(l_returnflag))) AS mode FROM lineitem GROUP BY l_orderkey")
def explode_terms(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("modes")).select("l_orderkey", F.explode_outer("modes").alias("mode"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query(
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(replace(text, ' the ', ' [REF] ( ) '), '\[REF\]', '', 'g'), '\(\s*\)', '', 'g'), '\s+', ' ', 'g'))) AS cleaned FROM documents"""
)
def clean_query(spark, d):
    marked = F.replace("text", F.lit(" the "), F.lit(" [REF] ( ) "))
    return table(spark, d, "documents").select("doc_id", F.md5(X.clean_query(marked)).alias("cleaned"))


def _masked_sql(column: str, part: str) -> str:
    forms = [part[:n] for n in range(len(part), 0, -1)]
    return "CASE " + " ".join(f"WHEN contains({column}, '{f}') THEN replace({column}, '{f}', '[REF]')" for f in forms) + f" ELSE {column} END"


@query(f"WITH m AS (SELECT doc_id, {_masked_sql('text', 'the')} AS x FROM documents) SELECT doc_id, md5({_masked_sql('x', 'on')}) AS masked FROM m")
def mask_substrings(spark, d):
    parts = F.array(F.lit("the"), F.lit("on"))
    return table(spark, d, "documents").select("doc_id", F.md5(X.mask_substrings(F.col("text"), parts)).alias("masked"))


_CITED = " Smith et al. (2010a), Doe 1999; O'Neil & Müller ( 2004 ) and Ito, Sato and Abe-Kato, 2011b"


@query(
    f"""WITH t AS (SELECT doc_id, text || '{_CITED.replace("'", "''")}' AS x FROM documents)
SELECT doc_id, regexp_extract_all(x, '{X.CITATION.replace("'", "''")}', 1) AS authors, regexp_extract_all(x, '{X.CITATION.replace("'", "''")}', 2) AS years FROM t"""
)
def inline_citations(spark, d):
    c = X.citations(F.concat("text", F.lit(_CITED)))
    return table(spark, d, "documents").select("doc_id", F.transform(c, lambda z: z["author"]).alias("authors"), F.transform(c, lambda z: z["year"]).alias("years"))


@query(
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[.?!]\s\S')) + 1 AS INTEGER) AS n_sentences, length(text) AS n_chars, true AS whole FROM documents"""
)
def sentence_split(spark, d):
    s = X.sentences(F.col("text"))
    t = table(spark, d, "documents").select("doc_id", F.col("text"), s.alias("s"))
    return t.select("doc_id", F.size("s").alias("n_sentences"), V.total(F.transform("s", lambda x: F.length(x).cast("double"))).cast("bigint").alias("n_chars"), (F.array_join("s", "") == F.col("text")).alias("whole"))


@query(
    """WITH c AS (SELECT doc_id, unnest(range(1, greatest(length(text) - 150, 1) + 1, 1350)) AS start, text FROM documents)
SELECT doc_id, CAST(start AS INTEGER) AS start, md5(substring(text, start, 1500)) AS chunk_md5 FROM c"""
)
def chunk_fixed_stride(spark, d):
    at = X.chunk_starts(F.col("text"), 1500, 150)
    c = table(spark, d, "documents").select("doc_id", "text", F.explode(at).alias("start"))
    return c.select("doc_id", "start", F.md5(F.substring(F.col("text"), F.col("start"), F.lit(1500))).alias("chunk_md5"))


@query()
def chunk_text(spark, d):
    return G.chunk(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "chunk_no", F.length("text").alias("n_chars"))


@query()
def semantic_breakpoints(spark, d):
    e = table(spark, d, "embeddings").select((F.col("vec_id") / 50).cast("int").alias("doc"), "vec_id", "embedding")
    b = G.breakpoints(e, "doc", "vec_id", "embedding")
    return b.select("doc", "vec_id", F.round("distance", 6).alias("distance"), F.round("threshold", 6).alias("threshold"), "cut")


@query("SELECT doc_id, CAST(instr(text, 'tion') - 1 AS INTEGER) AS at FROM documents")
def instr_offsets(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.instr("text", "tion") - 1).alias("at"))


@query("SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda t: lower(t)) AS tokens FROM benchmark")
def tokenize(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.tokens(F.col("text")).alias("tokens"))


@query(r"""SELECT page_id, TRY_CAST(regexp_extract(url, '/([a-z]+)/([0-9]+)', 2) AS INTEGER) AS number FROM pages""")
def regex_params(spark, d):
    return table(spark, d, "pages").select("page_id", *X.numbers_in(F.col("url"), r"/[a-z]+/([0-9]+)", "number"))


@query("SELECT doc_id, CAST(len(string_split(text, ' ')) AS INTEGER) AS words, CAST(length(text) AS INTEGER) AS chars, CAST(len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS INTEGER) AS tokens FROM documents")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.split("text", " ")).alias("words"), F.length("text").alias("chars"), F.size(X.tokens(F.col("text"))).alias("tokens"))


# Dates and scores.


@query("SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS pubdate FROM orders")
def date_to_int(spark, d):
    return table(spark, d, "orders").select("o_orderkey", D.date_int(F.col("o_orderdate")).alias("pubdate"))


@query("SELECT o_orderkey, round(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') / 365.25, 6) AS years FROM orders")
def years_old(spark, d):
    asked = D.int_date(F.lit(20000101))
    return table(spark, d, "orders").select("o_orderkey", F.round(D.years_between(asked, D.int_date(D.date_int(F.col("o_orderdate")))), 6).alias("years"))


@query("SELECT o_orderkey, replace(strftime(o_orderdate, '%Y') || '-' || CASE WHEN o_orderkey % 2 = 0 THEN '00' ELSE strftime(o_orderdate, '%m') END || '-00', '-00', '-01') AS repaired FROM orders")
def repair_date(spark, d):
    raw = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-"), F.when(F.col("o_orderkey") % 2 == 0, "00").otherwise(F.date_format("o_orderdate", "MM")), F.lit("-00"))
    return table(spark, d, "orders").select("o_orderkey", D.repaired(raw).alias("repaired"))


@query("SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders")
def month_to_int(spark, d):
    return table(spark, d, "orders").select("o_orderkey", D.month_number(F.concat(F.lit("in "), F.date_format("o_orderdate", "MMMM"))).alias("month"))


@query("SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS score FROM orders")
def score_log_citations(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(F.log1p(F.col("o_totalprice").cast("double")), 6).alias("score"))


@query("SELECT o_orderkey, round(-ln(1 + date_diff('day', CAST(o_orderdate AS DATE), DATE '2030-01-01') / 365.25), 6) AS score FROM orders")
def score_neg_log_years(spark, d):
    o = table(spark, d, "orders").withColumns({"qdate": F.to_date(F.lit("2030-01-01")), "pdate": F.to_date("o_orderdate")})
    return o.select("o_orderkey", F.round(R.get_score("negative_log_years_old")(), 6).alias("score"))


_BM25 = """qt AS (SELECT DISTINCT qid, unnest(list_transform(regexp_extract_all(query, '[A-Za-z0-9_]+'), lambda t: lower(t))) AS term FROM asked),
dt AS (SELECT {own} pid, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+'), lambda t: lower(t)) AS w FROM corpus),
sz AS (SELECT {own} count(*) AS n, avg(len(w)) AS avgdl FROM dt {group}),
tf AS (SELECT {own} pid, dl, term, count(*) AS f FROM (SELECT {own} pid, len(w) AS dl, unnest(w) AS term FROM dt) GROUP BY ALL),
df AS (SELECT {own} term, count(*) AS df FROM tf GROUP BY ALL)
SELECT qt.qid, tf.pid, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25
FROM qt JOIN tf ON qt.term = tf.term {on} JOIN df ON df.term = tf.term {df_on} {size} GROUP BY qt.qid, tf.pid"""


@query(
    "WITH asked AS (SELECT item_id AS qid, text AS query FROM benchmark), corpus AS (SELECT doc_id AS pid, text FROM documents), "
    + _BM25.format(own="", group="", on="", df_on="", size=", sz")
)
def bm25_corpus(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    corpus = table(spark, d, "documents").select(F.col("doc_id").alias("pid"), "text")
    s = R.bm25(asked, corpus)
    return s.select("qid", "pid", F.round("bm25", 6).alias("bm25"))


@query(
    "WITH asked AS (SELECT conv_id AS qid, text AS query FROM conversations WHERE turn = 0), corpus AS (SELECT conv_id AS qid, turn AS pid, text FROM conversations WHERE turn > 0), "
    + _BM25.format(own="qid,", group="GROUP BY qid", on="AND qt.qid = tf.qid", df_on="AND df.qid = tf.qid", size="JOIN sz ON sz.qid = tf.qid")
)
def bm25_scratch(spark, d):
    c = table(spark, d, "conversations")
    asked = c.filter("turn = 0").select(F.col("conv_id").alias("qid"), F.col("text").alias("query"))
    hits = c.filter("turn > 0").select(F.col("conv_id").alias("qid"), F.col("turn").alias("pid"), "text")
    return R.bm25(asked, hits, per_query=True).select("qid", "pid", F.round("bm25", 6).alias("bm25"))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query(
    f"""WITH c AS (SELECT conv_id AS qid, turn AS pid, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t NOT IN ({_STOP})) AS w FROM conversations),
qt AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest(w) AS term FROM c WHERE pid = 0) GROUP BY ALL),
sz AS (SELECT qid, count(*) AS n, avg(len(w)) AS avgdl FROM c WHERE pid > 0 GROUP BY qid),
tf AS (SELECT qid, pid, dl, term, count(*) AS f FROM (SELECT qid, pid, len(w) AS dl, unnest(w) AS term FROM c WHERE pid > 0) GROUP BY ALL),
df AS (SELECT qid, term, count(*) AS df FROM tf GROUP BY ALL)
SELECT qid, pid, round(sum(times * ln(greatest((n - df + 0.5) / (df + 0.5), 1)) * f / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25
FROM qt JOIN tf USING (qid, term) JOIN df USING (qid, term) JOIN sz USING (qid) GROUP BY qid, pid"""
)
def bm25_robertson(spark, d):
    c = table(spark, d, "conversations")
    asked = c.filter("turn = 0").select(F.col("conv_id").alias("qid"), F.col("text").alias("query"))
    hits = c.filter("turn > 0").select(F.col("conv_id").alias("qid"), F.col("turn").alias("pid"), "text")
    return R.bm25(asked, hits, per_query=True, kind="robertson").select("qid", "pid", F.round("bm25", 6).alias("bm25"))


@query(
    """WITH w AS (SELECT conv_id AS qid, turn AS pid, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]+')) AS w FROM conversations),
m AS (SELECT h.qid, h.pid, len(list_intersect(q.w, h.w)) AS had, len(q.w) AS n FROM w h JOIN w q ON q.qid = h.qid AND q.pid = 0 WHERE h.pid > 0)
SELECT qid, pid, round((had + 1) / (n + 2), 6) AS score_rerank FROM m"""
)
def rerank_overlap(spark, d):
    c = table(spark, d, "conversations")
    asked = c.filter("turn = 0").select(F.col("conv_id").alias("qid"), F.col("text").alias("query"))
    hits = c.filter("turn > 0").select(F.col("conv_id").alias("qid"), F.col("turn").alias("pid"), "text")
    scored = R.rerank(hits.join(asked, "qid"), "overlap")
    return scored.select("qid", "pid", F.round("score_rerank", 6).alias("score_rerank"))


# Smaller operators.


@query("SELECT doc_id, n_chars FROM documents WHERE coalesce(length(text), 0) <= 2000")
def not_longer(spark, d):
    return T.not_longer(table(spark, d, "documents"), "text", 2000).select("doc_id", "n_chars")


@query(
    """WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer), b AS (SELECT DISTINCT n_nationkey AS k FROM nation WHERE n_regionkey < 4),
d AS (SELECT (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS only_a, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS only_b)
SELECT only_a, only_b, only_a + only_b = 0 AS same FROM d"""
)
def set_equality(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    return T.same_rows(a, table(spark, d, "nation").filter("n_regionkey < 4").select(F.col("n_nationkey").alias("k")))


@query(
    """SELECT user_id % 10 AS epoch, round(sum(value * (event_id % 16 + 1)) / sum(event_id % 16 + 1), 6) AS loss,
  round(sum(cos(event_id) * (event_id % 16 + 1)) / sum(event_id % 16 + 1), 6) AS similarity, CAST(sum(event_id % 16 + 1) AS BIGINT) AS n FROM events GROUP BY 1"""
)
def epoch_means(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 10).alias("epoch"), F.col("value").alias("loss"), F.cos("event_id").alias("similarity"), (F.col("event_id") % 16 + 1).alias("size"))
    return L.epoch_means(e).select("epoch", F.round("loss", 6).alias("loss"), F.round("similarity", 6).alias("similarity"), "n")


@query("SELECT item_id, 'Context:' || chr(10) || '* ' || substring(text, 1, 40) || chr(10) || '* ' || lower(text) || chr(10) || chr(10) || 'Query:' || chr(10) || text AS asked FROM benchmark")
def reranker_context(spark, d):
    t = table(spark, d, "benchmark")
    return t.select("item_id", X.reranker_context(F.col("text"), F.substring("text", 1, 40), F.lower("text")).alias("asked"))


@query("SELECT page_id, 'Page ' || page_id || ': <' || url || '>.' AS prompt FROM pages")
def format_prompt(spark, d):
    return table(spark, d, "pages").select("page_id", X.format_prompt("Page {n}: <{u}>.", n=F.col("page_id"), u=F.col("url")).alias("prompt"))


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def insert_new(spark, d):
    stored = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"))
    return T.insert_new(stored, table(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR))) AS INTEGER) AS pick FROM documents QUALIFY pick <= 2")
def random_of_group(spark, d):
    return T.random_of(table(spark, d, "documents").select("source", "doc_id"), "source", F.col("doc_id"), 2)


@query("SELECT vec_id, round(greatest(0, cos(vec_id) - sin(vec_id) + 0.1), 6) AS loss FROM embeddings")
def triplet_loss(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(L.triplet_loss(F.sin("vec_id"), F.cos("vec_id")), 6).alias("loss"))


# Extras: event-time windows, in batch form; the same functions take streams.


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def window_tumbling(spark, d):
    w = SW.tumbling(table(spark, d, "events"), "1 hour")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM events, (VALUES (0), (1)) AS w(k) GROUP BY 1, 2"""
)
def window_sliding(spark, d):
    w = SW.sliding(table(spark, d, "events"), "1 hour", "30 minutes")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH e AS (SELECT user_id, ts, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE, true)::INT AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def window_session(spark, d):
    w = SW.sessions(table(spark, d, "events"), "30 minutes")
    return w.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n")


# Sinks that read back what they wrote.


@query("SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dim, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings WHERE vec_id >= 0")
def tensor_table(spark, d):
    """All vectors as array files and back, without the columns that nobody asks for."""
    path = folder(spark, "tensors")
    tensors.write(table(spark, d, "embeddings"), path)
    back = tensors.read(spark, path, ["vec_id", "label", "embedding"]).filter("vec_id >= 0")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("vec_id", "label", F.size("embedding").alias("dim"), F.round(total, 6).alias("total"))


@query("SELECT o_orderstatus, count(*) AS n, sum(o_orderkey) AS keys FROM orders GROUP BY o_orderstatus")
def committed_batches(spark, d):
    """Orders appended in batches, one of them twice and one without its commit: each counts once."""
    store, orders = CommitTable(spark, folder(spark, "orders")), table(spark, d, "orders")
    for batch in (0, 1, 0, 2):
        store.append(f"batch-{batch}", orders.filter(F.col("o_orderkey") % 3 == batch))
    orders.limit(5).write.parquet(f"{store.root}/data/unfinished")
    return store.read().groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").cast("decimal(38,0)").alias("keys"))


@query()
def executed_plan(spark, d):
    """The operators of a join with aggregation, with the rows that each gave; times differ from run to run and are left out."""
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = P.operators(P.analyze(joined.groupBy("o_orderpriority").agg(F.sum("l_quantity").alias("quantity"))))
    return spark.createDataFrame([(i, depth, node, n) for i, (depth, node, n, _) in enumerate(rows)], "place int, depth int, node string, rows bigint")


@query()
def extraction_chain(spark, d):
    """Whether each document's first line is a sentence, and the years that its parentheses name: calls with conditions between them."""
    first = table(spark, d, "documents").select("doc_id", F.coalesce(F.substring_index("text", "\n", 1), F.lit("")).alias("sentence"))
    found = E.chain(first, E.citation_steps(), concurrency=4)
    return found.select("doc_id", "valid", F.size("substrings").alias("n"), "masked", F.array_join("trace", ", ").alias("trace"))


_ENDS = "list_transform(string_split(regexp_replace(text, '([.?!]\\s)(\\S)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: length(s))"


@query(
    f"""WITH s AS (SELECT doc_id, {_ENDS} AS a, length(text) AS n FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, a, list_concat(list_transform(range(1, n // 200 + 1), lambda i: CAST(200 AS BIGINT)), CASE WHEN n % 200 > 0 THEN [n % 200] ELSE [] END) AS b FROM s),
c AS (SELECT doc_id, list_transform(range(1, len(a)), lambda i: list_sum(a[1:i])) AS x, list_transform(range(1, len(b)), lambda i: list_sum(b[1:i])) AS y FROM w),
o AS (SELECT doc_id, len(list_intersect(x, y)) AS same, len(x) + len(y) AS total FROM c)
SELECT doc_id, round(CASE WHEN total = 0 THEN 1.0 ELSE CAST(same AS DOUBLE) / (total - same) END, 9) AS similarity FROM o"""
)
def boundary_similarity(spark, d):
    """Sentence ends against cuts at every 200 characters; with near = 1 no boundary moves, which SQL can state."""
    text = table(spark, d, "documents").filter("length(text) > 0")
    n = F.length("text")
    whole = F.when(n >= 200, F.array_repeat(F.lit(200), F.floor(n / 200).cast("int"))).otherwise(F.array().cast("array<int>"))
    rest = F.when(n % 200 > 0, F.array(n % 200)).otherwise(F.array().cast("array<int>"))
    lengths = text.select("doc_id", F.transform(X.sentences(F.col("text")), lambda s: F.length(s)).alias("lengths_a"), F.concat(whole, rest).alias("lengths_b"))
    return G.compare(lengths, near=1).select("doc_id", F.round("boundary_similarity", 9).alias("similarity"))
