"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.chat_format import read_back, segments
from siftwell.llm.collocations import collocations
from siftwell.llm.decontaminate import n_hit, scan
from siftwell.llm.filter_audit import cells, interactions
from siftwell.llm.filter_audit import judge as judge_filters
from siftwell.llm.license_scan import TEMPLATES
from siftwell.llm.license_scan import scan as scan_licenses
from siftwell.llm.line_dedup import remove_lines
from siftwell.llm.near_dedup import classify
from siftwell.llm.nearest import search
from siftwell.llm.packing import pack
from siftwell.llm.pii import BASE
from siftwell.llm.pii import find as find_pii
from siftwell.llm.toxicity import fit, held_out, score
from siftwell.llm.url_filter import judge
from siftwell.llm.word_bpe import encode

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query(
    "op7_near_dedup",
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
c AS (SELECT min(doc_id) AS cid, list_sort(sh) AS sh FROM s WHERE len(sh) > 0 GROUP BY 2),
u AS (SELECT cid, len(sh) AS n, unnest(sh) AS g FROM c),
p AS (
  SELECT a.cid AS x, b.cid AS y FROM u a JOIN u b ON a.g = b.g AND a.cid < b.cid
  GROUP BY a.cid, b.cid, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
r AS (SELECT cid AS node, cid AS seen FROM c UNION SELECT r.node, e.y FROM r JOIN e ON r.seen = e.x),
l AS (SELECT node, min(seen) AS low FROM r GROUP BY node),
k AS (SELECT c.sh, l.low FROM c JOIN l ON c.cid = l.node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(k.low, s.doc_id) AS component_id,
  s.doc_id = coalesce(k.low, s.doc_id) AS kept
FROM s LEFT JOIN k ON list_sort(s.sh) = k.sh
""",
)
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), n_words=4, percent=80)


@_query(
    "op2_decontaminate",
    r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS m, unnest(list_transform(range(1, len(ws) - least(10, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(10, len(ws)) - 1], ' '))) AS g FROM bw WHERE len(ws) > 0),
ms AS (SELECT DISTINCT m FROM iw),
dg AS (
  SELECT doc_id, m, unnest(range(1, len(ws) - m + 2)) AS i, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS g FROM dw, ms WHERE len(ws) >= m),
hit AS (SELECT DISTINCT doc_id, dg.i, dg.m, item_id FROM dg JOIN iw ON dg.g = iw.g AND dg.m = iw.m),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM hit),
h AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY 1)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h ON dw.doc_id = h.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id
""",
)
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit() > 0).alias("contaminated"),
    )


@_query("op1_pack")
def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(documents, fit(documents, _table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


@_query("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


#: Escaped text, in SQL: the template's control strings, in their order.
_ESCAPED = "replace(coalesce(text, ''), '\\', '\\\\')"
for _c in ("</s>", "<</SYS>>", "<<SYS>>", "<s>", "<|end|>", "<|role|>", "[/INST]", "[INST]"):
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"


@_query(
    "op10_chat_format",
    f"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS last FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED}) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 ELSE 7 END) AS BIGINT) AS formatted_chars,
  bool_and(last IS DISTINCT FROM turn AND CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS DISTINCT FROM 'user' ELSE before IS NOT DISTINCT FROM 'user' END) AS valid
FROM o GROUP BY conv_id
""",
)
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    back = read_back(segments(rows.unionByName(probe)))
    return back.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        "loss_chars",
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@_query("op9_url_filter")
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(_table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@_query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))
    base = F.filter("pii", lambda p: p["kind"].isin(*BASE))
    of = lambda kind: F.filter("pii", lambda p: p["kind"] == kind)
    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.array_join(F.transform(base, told), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("pii", told), ",").alias("spans"),
    )


@_query("op6_nearest")
def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return search(vectors.filter("vec_id % 50 = 0"), vectors, 5)


@_query(
    "op4_license_scan",
    f"""
WITH t AS (
  SELECT name, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') AS w FROM (VALUES {", ".join(f"('{n}', '{x}')" for n, x in TEMPLATES.items())}) v(name, body)),
ts AS (
  SELECT name, greatest(8, CAST(pow(2, ceil(log2(len(w)))) AS INTEGER)) AS span,
    list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS sh FROM t),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
ds AS (SELECT doc_id, len(w) AS n, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) END AS sh FROM d),
g AS (
  SELECT DISTINCT ds.doc_id, x.span, k.i FROM ds, (SELECT DISTINCT span FROM ts) x,
    unnest(range(0, CAST(greatest(floor((n - 1) / x.span), 1) AS BIGINT))) AS k(i) WHERE n > 0),
hit AS (
  SELECT DISTINCT g.doc_id, ts.name FROM g JOIN ds ON g.doc_id = ds.doc_id JOIN ts ON g.span = ts.span
  WHERE list_has_any(ds.sh, ts.sh) AND
    100 * len(list_intersect(list_distinct(ds.sh[g.i * g.span + 1:g.i * g.span + 2 * g.span - 4]), ts.sh)) >= 80 * len(ts.sh)),
h AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM hit GROUP BY doc_id)
SELECT ds.doc_id, CAST(coalesce(h.n, 0) AS BIGINT) AS n_licenses, coalesce(h.names, '') AS licenses FROM ds LEFT JOIN h ON ds.doc_id = h.doc_id
""",
)
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("licenses").cast("bigint").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))


@_query(
    "op11_collocations",
    r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
tot AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) v(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 10),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
x AS (SELECT lang, phrase, a, i, array_to_string(ws[1:i], ' ') AS lp, array_to_string(ws[i + 1:k], ' ') AS rp FROM c, (VALUES (1), (2)) v(i) WHERE i < k),
s AS (
  SELECT x.lang, x.phrase, a, i, lf.f AS l, rf.f AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(lf.f AS HUGEINT) * rf.f) AS BIGINT) AS score
  FROM x JOIN f lf ON lf.lang = x.lang AND lf.phrase = lp JOIN f rf ON rf.lang = x.lang AND rf.phrase = rp),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS best FROM s),
cov AS (
  SELECT lang, sub, max(a) AS cover FROM (
    SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS sub FROM c WHERE k = 3) GROUP BY lang, sub),
z AS (
  SELECT b.lang, b.phrase, a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN cov ON b.lang = cov.lang AND b.phrase = sub WHERE best = 1 AND (cover IS NULL OR 100 * cover < 50 * a))
SELECT z.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM z JOIN tot ON z.lang = tot.lang WHERE rank <= 2000
""",
)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


@_query("op12_word_bpe")
def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    coded = encode(_table(spark, sf_dir, "documents"), tokenizer, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@_query(
    "op13_filter_audit",
    r"""
WITH RECURSIVE perm AS (
  SELECT '' AS o UNION ALL SELECT o || x FROM perm, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(o, x)),
st AS (
  SELECT o AS filter_order, CAST(k AS INTEGER) AS step, substr(o, CAST(k AS INTEGER), 1) AS f, substr(o, 1, CAST(k AS INTEGER) - 1) AS b FROM perm, range(1, 6) r(k) WHERE length(o) = 5),
sb AS (
  SELECT *, CASE f WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 4 WHEN 'D' THEN 8 ELSE 16 END AS own,
    CASE WHEN contains(b, 'A') THEN 1 ELSE 0 END + CASE WHEN contains(b, 'B') THEN 2 ELSE 0 END + CASE WHEN contains(b, 'C') THEN 4 ELSE 0 END
    + CASE WHEN contains(b, 'D') THEN 8 ELSE 0 END + CASE WHEN contains(b, 'E') THEN 16 ELSE 0 END AS ahead FROM st),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ 	-
]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > first THEN 16 ELSE 0 END AS mask,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
r AS (
  SELECT part, filter_order, step, f,
    CAST(coalesce(sum(n) FILTER (mask & (own + ahead) = 0), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & ahead = 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & ahead <> 0), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (mask & own <> 0 AND mask & ahead = 0), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & ahead = 0), 0) AS BIGINT) AS toxic_lost
  FROM c, sb GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
""",
)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(cells(judge_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))))
