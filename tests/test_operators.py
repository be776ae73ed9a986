"""Operators against plain restatements of their definitions, on tables of a few rows."""

import difflib
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell import schemas
from siftwell.functions import dates as D
from siftwell.functions import embed as E
from siftwell.functions import text as X
from siftwell.functions import vectors as V
from siftwell.operators import learn as L
from siftwell.operators import merge as M
from siftwell.operators import ranking as R
from siftwell.operators import search as S
from siftwell.operators import segment as G
from siftwell.operators import tables as T
from siftwell.operators import titles as N


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=8))], i % 4, i % 7) for i in range(60)]
    rows[10] = (10, rows[20][1], 2, 3)  # a tie
    return spark.createDataFrame(rows, "pid bigint, vector array<float>, doc int, pubdate int").cache()


@pytest.mark.parametrize("metric", ["IP", "COSINE", "L2"])
@pytest.mark.parametrize("dated", [False, True])
def test_both_searches_agree(vectors, metric, dated):
    q = vectors.filter("pid % 7 = 3").withColumnRenamed("pid", "qid")
    a, b = (sorted((r[0], r[1], r[2], round(r[3], 9)) for r in f(q, vectors, 9, metric, dated).collect()) for f in (S.top_k, S.top_k_native))
    assert a == b and (dated or len(a) == 9 * q.count())


def test_many_queries_go_in_blocks(vectors, monkeypatch):
    q = vectors.withColumnRenamed("pid", "qid")
    found = lambda: sorted((*r[:3], round(r[3], 9)) for r in S.top_k(q, vectors, 3).collect())
    want = found()
    monkeypatch.setattr(S, "QUERY_BYTES", 1000)
    assert found() == want


def test_clustered_index_reaches_most_neighbours(vectors, tmp_path):
    index = S.ClusteredIndex.build(vectors, str(tmp_path / "ivf"), cells=4)
    q = vectors.filter("pid < 10").withColumnRenamed("pid", "qid")
    want = {(r["qid"], r["pid"]) for r in S.top_k(q, vectors, 5).collect()}
    assert {(r["qid"], r["pid"]) for r in index.search(q, 5, probes=4).collect()} == want
    assert len({(r["qid"], r["pid"]) for r in index.search(q, 5, probes=2).collect()} & want) >= 0.4 * len(want)


def stats(targets, docs):
    out, seen, hits = [], set(), set()
    for d in docs:
        seen.add(d)
        hits |= {d} & set(targets)
        n = len(targets)
        out.append((float(bool(hits)), len(hits) / n if n else 0.0, len(hits) / len(set(targets) | seen) if n else 0.0))
    return out


def test_statistics_at_k(spark):
    rng = random.Random(2)
    lists = {q: [rng.choice("abcdef") for _ in range(q + 1)] for q in range(6)}
    targets = {0: ["a"], 1: ["a", "a", "b"], 2: [], 3: ["z"], 4: ["a", "b", "c"], 5: ["f"], 6: ["a"]}
    h = spark.createDataFrame([(q, i + 1, d) for q, ds in lists.items() for i, d in enumerate(ds)], "qid int, rank int, doc string")
    t = spark.createDataFrame(list(targets.items()), "qid int, targets array<string>")
    s = R.stats_at_k(h, t)
    got = {(r["qid"], r["k"]): (r["hitrate"], r["recall"], r["iou"]) for r in s.collect()}
    for q, docs in lists.items():
        for k, want in enumerate(stats(targets[q], docs), 1):
            assert got[q, k] == pytest.approx(want)
            assert want[1] <= 1 and (k == 1 or got[q, k][1] >= got[q, k - 1][1])
    full = {(r["qid"], r["k"]): r["recall"] for r in R.filled(s, t, 8).collect()}
    assert len(full) == 7 * 8 and full[1, 8] == pytest.approx(got[1, 2][1]) and full[6, 3] == 0.0
    assert R.best_k(R.averages(s)).first()["best_k"] >= 1


def test_fusion(spark):
    rows = [(1, i + 1, f"d{i}", float(s), float(c)) for i, (s, c) in enumerate([(5, 1), (4, 9), (4, 9), (1, 2)])]
    h = spark.createDataFrame(rows, "qid int, rank int, doc string, a double, b double")
    assert [r["doc"] for r in R.fuse(h, {"a": 1.0}, 10).orderBy("new_rank").collect()] == ["d0", "d1", "d2", "d3"]
    got = {r["doc"]: r["rrf"] for r in R.fuse(h, {"a": 0.4, "b": 0.6}, 10).collect()}
    ra, rb = {"d0": 1, "d1": 2, "d2": 3, "d3": 4}, {"d1": 1, "d2": 2, "d3": 3, "d0": 4}
    assert got == pytest.approx({d: 0.4 / (ra[d] + 60) + 0.6 / (rb[d] + 60) for d in ra})
    assert R.fuse(h, {"a": 1.0}, 2).count() == 2
    for dim, n in ((2, 11), (3, 66)):
        w = R.weight_grid(h.sparkSession, dim).collect()
        assert len(w) == n and all(sum(x) == pytest.approx(1) for x in w)
    grid = R.fuse_grid(h, ["a", "b"], R.weight_grid(h.sparkSession, 2), 10)
    assert {r["doc"]: r["rrf"] for r in grid.filter("abs(w1 - 0.4) < 1e-9").collect()} == pytest.approx(got)
    with pytest.raises(KeyError):
        R.get_score("nothing")


def test_bm25(spark):
    docs = {0: "the cat sat", 1: "the dog sat on the mat", 2: "", 3: "cats"}
    asked = {7: "The cat the", 8: "dog mat"}
    d = spark.createDataFrame(list(docs.items()), "pid int, text string")
    q = spark.createDataFrame(list(asked.items()), "qid int, query string")
    got = {(r["qid"], r["pid"]): r["bm25"] for r in R.bm25(q, d).collect()}
    toks = {p: re.findall(r"[a-z0-9_]+", t.lower()) for p, t in docs.items()}
    avg = sum(map(len, toks.values())) / len(toks)
    want = {}
    for qid, text in asked.items():
        for term in set(re.findall(r"[a-z0-9_]+", text.lower())):
            df = sum(term in t for t in toks.values())
            for p, t in toks.items():
                if f := t.count(term):
                    idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                    want[qid, p] = want.get((qid, p), 0) + idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / avg))
    assert got == pytest.approx(want)


def test_merges(spark):
    lists = [[("a", 9.0), ("b", 5.0), ("c", 1.0)], [("d", 8.0), ("a", 5.0), ("e", 4.0)], [("f", 7.0)]]
    frames = [spark.createDataFrame([(1, i + 1, p, s) for i, (p, s) in enumerate(x)], "qid int, rank int, pid string, score double") for x in lists]
    order = lambda df: [r["pid"] for r in df.orderBy("new_rank").collect()]
    assert order(M.interleaved(M.numbered(*frames), 5)) == ["a", "d", "f", "b", "a"]
    assert order(M.by_score(M.numbered(*frames), 5)) == ["a", "d", "f", "b", "a"]
    assert order(M.multiple_expansion(frames, 6)) == ["a", "d", "f", "b", "a", "e"] and M.share_of_each(6, 3) == 3
    assert order(M.mixed_expansion(frames[0], frames[1], 4)) == ["a", "d", "b", "a"]
    assert order(M.fifty_fifty(frames[0], frames[1], 4)) == ["a", "d", "b", "a"]
    with pytest.raises(Exception, match="shorter"):
        M.fifty_fifty(frames[0], frames[2], 4).collect()
    first = M.deduplicated(M.numbered(*frames).withColumn("doc", F.col("pid")))
    assert sorted(r["doc"] for r in first.collect()) == list("abcdef")


def test_expansion(spark):
    docs = spark.createDataFrame([("x", "T", None, ["s0", "s1", "s2", "s3"])], "doi string, title string, abstract string, body_sentences array<string>")
    q = spark.createDataFrame([("x", f"s{i}", i) for i in range(4)], "source_doi string, sent_no_cit string, sent_idx int")
    for name, want in {
        "identity": ["s0", "s1", "s2", "s3"], "add_prev_2": [" s0", "s0 s1", "s0 s1 s2", "s1 s2 s3"],
        "add_title_abstract": [f"IMPORTANT:\ns{i}\n\nTitle\nT\n\nAbstract\n" for i in range(4)],
    }.items():
        assert [r["query"] for r in M.expand(q, docs, name).orderBy("sent_idx").collect()] == want
    with pytest.raises(Exception, match="no document"):
        M.expand(q, docs.filter("doi = 'y'"), "identity").collect()
    with pytest.raises(ValueError):
        M.expand(q, docs, "nothing")


def fold(sents, threshold):
    """Gathered as long as all characters, with a space behind each gathered sentence, stay under the threshold."""
    out, held = [], ""
    for s in sents:
        if len(held + s) < threshold:
            held = f"{held}{s} "
            continue
        out += [held.strip()] * (held != "")
        held = s
    return out + [held.strip()] * (held != "")


def test_text(spark):
    rng = random.Random(3)
    for _ in range(20):
        s = ["x" * rng.randint(1, 30) for _ in range(rng.randint(0, 8))]
        assert one(spark, X.merge_short(F.array(*[F.lit(x) for x in s]).cast("array<string>"), 20))[0] == fold(s, 20)
    long = "A sentence of more than sixty characters stands alone in here, truly."
    s = F.array(*[F.lit(x) for x in ("Short one.", long, "Tiny.", "End.")])
    assert one(spark, X.merge_short(s))[0] == ["Short one.", long, "Tiny.End."]
    assert one(spark, X.merge_short(F.array(F.lit("a" * 30), F.lit("b" * 40), F.lit("c."), F.lit("d."))))[0] == ["a" * 30, "b" * 40 + "c. d."]
    text = "One. Two?  Three! 4.5 is no end. "
    assert "".join(one(spark, X.sentences(F.lit(text)))[0]) == text
    assert one(spark, X.clean_query(F.lit(" a [REF] (  ) b\n c ")))[0] == "a b c"
    mask = lambda t, *parts: one(spark, X.mask_substrings(F.lit(t), F.array(*[F.lit(p) for p in parts])))[0]
    assert mask("see (A 2010).", " (A 2010) ") == "see [REF]." and mask("see A 2010", "A 2010);.") == "see [REF]" and mask("x", "zzzz") == "x"
    c = one(spark, X.citations(F.lit("As Smith et al. (2010a) and Müller, 1999 say")))[0]
    assert [(x["author"], x["year"]) for x in c] == [("Smith et al. ", "2010a"), ("Müller, ", "1999")]
    assert one(spark, X.tokens(F.lit("A-b_c 9")))[0] == ["a", "b_c", "9"]
    assert one(spark, X.format_prompt("{a} and {b}!", a=F.lit("x"), b=F.lit(2)))[0] == "x and 2!"
    chunks = one(spark, X.chunks(F.lit("abcdefghij"), 4, 1))[0]
    assert chunks == ["abcd", "defg", "ghij"]
    assert one(spark, X.reranker_context(F.lit("q"), F.lit("e")))[0] == "Context:\n* e\n\nQuery:\nq"


def test_dates(spark):
    assert one(spark, D.date_int(F.lit("2012-03-04")), D.repaired(F.lit("2012-00-00")), D.month_number(F.lit("early March 2010")), D.month_number(F.lit("?")))[:] == (20120304, "2012-01-01", 3, 1)
    assert one(spark, D.years_between(D.int_date(F.lit(20200101)), D.int_date(F.lit(20190101))))[0] == pytest.approx(365 / 365.25)


def test_vectors(spark):
    rng = np.random.default_rng(4)
    for n in (2, 3, 5):
        v = rng.normal(size=n)
        col = F.array(*[F.lit(float(x)) for x in v])
        assert one(spark, V.from_spherical(V.to_spherical(col)))[0] == pytest.approx(v)
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, V.normalized(a), V.normalized(b), V.cosine(a, b), V.l2(a, b))[:] == ([0.6, 0.8], [0.0, 0.0], None, 5.0)
    assert one(spark, V.times_matrix(a, [[0, 1], [1, 0]]))[0] == pytest.approx([0.8, 0.6])


def test_linear_algebra(vectors):
    x = np.array([r["vector"] for r in vectors.orderBy("pid").collect()], float)
    mean, cov, n = L.covariance(vectors, "vector")
    assert n == 60 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T))
    _, parts, var = L.principal(vectors, "vector")
    out = np.array([r["y"] for r in L.without_top(vectors, "vector", mean, parts, 2, "y").orderBy("pid").collect()])
    assert np.allclose(out @ parts[:2].T, 0, atol=1e-9) and np.allclose(np.linalg.norm(out, axis=1), 1) and (np.diff(var) <= 1e-12).all()
    r = np.linalg.qr(np.random.default_rng(5).normal(size=(8, 8)))[0]
    r[:, 0] *= np.sign(np.linalg.det(r))
    assert np.allclose(L.rotation(x, x @ r), r)
    u, v = x[0] / np.linalg.norm(x[0]), x[1] / np.linalg.norm(x[1])
    m = L.minimal_rotation(u, v)
    assert np.allclose(u @ m, v) and np.allclose(m @ m.T, np.eye(8))
    stat = {r["pos"]: r for r in L.mean_vector(vectors, "vector").collect()}
    assert stat[3]["mean"] == pytest.approx(x[:, 3].mean()) and stat[3]["std"] == pytest.approx(x[:, 3].std())


def test_adapter_learns():
    rng = np.random.default_rng(6)
    unit = lambda z: z / np.linalg.norm(z, axis=1, keepdims=True)
    a, neg = unit(rng.normal(size=(200, 6))), unit(rng.normal(size=(200, 6)))
    pos = a[:, ::-1].copy()
    net = L.Adapter.new(6, 16, residual=False).train(a, pos, neg, epochs=60, rate=0.5)
    assert min(net.history) < 0.8 * net.history[0] and np.allclose(np.linalg.norm(net(a), axis=1), 1)


def test_mining(vectors):
    q = vectors.filter("pid in (1, 2)").select(F.col("pid").alias("qid"), "vector", F.array(F.lit(0), F.lit(3), F.lit(3)).alias("targets"))
    best = L.best_passages(q, vectors, 2)
    assert best.count() == 8
    hits = S.top_k(q, vectors, 60).join(vectors.select("pid", "doc"), "pid")
    neg = L.hard_negatives(hits, q.select("qid", F.explode("targets").alias("doc")), 3)
    assert {r["doc"] for r in neg.collect()} <= {1, 2} and neg.count() == 6
    assert L.triplets(best, neg).count() == 2 * 4 * 3


def test_losses_and_schedules(spark):
    assert one(spark, L.cosine_loss(F.lit(0.5), F.lit(True)), L.cosine_loss(F.lit(0.5), F.lit(False)), L.triplet_loss(F.lit(0.9), F.lit(0.2)))[:] == pytest.approx((0.5, 0.4, 0.0))
    at = lambda name, s: one(spark, *[c.cast("double") for c in L.SCHEDULES[name](F.lit(s), F.lit(3000.0))])[:]
    assert [at("linear_slow", s)[1] for s in (0, 999, 1000, 2000, 3000)] == [0, 0, 0, 0.25, 0.5]
    assert at("linear_basic", 1500)[1] == 0.5 and at("linear_late", 1500)[1] == 0 and at("linear_late", 3000)[1] == 1 and at("positive_only", 9) == (1, 0)
    nce = one(spark, L.info_nce(F.lit(0.9), F.array(F.lit(0.1), F.lit(0.2)), F.array(F.lit(1.0), F.lit(2.0)), 0.5))[0]
    assert nce == pytest.approx(-math.log(math.exp(1.8) / (math.exp(1.8) + math.exp(0.2) + 2 * math.exp(0.4))))


def test_tables(spark):
    t = spark.createDataFrame([("Deep Learning!", 1), ("a study of the oceans and the seas", 2), ("zzz qqq vvv www", 3), ("graph theoretical methods applid", 4)], "title string, n int")
    c = spark.createDataFrame([("Deep learning",), ("A Study of the Oceans and the Seas, Part II",), ("Graph theoretic methods, applied",)], "title string")
    got = {r["title"]: (r["match"], r["how"]) for r in N.resolve_titles(t, c).collect()}
    assert got["Deep Learning!"] == ("Deep learning", "exact") and got["a study of the oceans and the seas"][1] == "half"
    assert got["zzz qqq vvv www"] == (None, "none") and got["graph theoretical methods applid"][0] == "Graph theoretic methods, applied"
    pairs = spark.createDataFrame([("apple", x) for x in ("ape", "apply", "peach", "puppy")], "a string, b string")
    assert [r["b"] for r in N.close_matches(pairs).orderBy(F.desc("ratio")).collect()] == difflib.get_close_matches("apple", ["ape", "apply", "peach", "puppy"])
    stored = spark.createDataFrame([("d", "x" * 100 + "old")], "doc string, text string")
    rows = spark.createDataFrame([("d", "x" * 100 + "new"), ("e", "x" * 100), ("d", "y"), (None, "y")], "doc string, text string")
    assert T.resume(stored, rows).count() == 3
    lines = spark.createDataFrame([("WARNING - Multiple matches on 'A'; choosing B",), ("ERROR - No close matches found for title: C",), ("noise",)], "value string")
    assert [tuple(r) for r in T.parse_log(lines).orderBy("title").collect()] == [("WARNING", "A", "B"), ("ERROR", "C", None)]
    assert T.invalid_cells(spark.createDataFrame([(1, " ", "x"), (2, None, "")], "k int, a string, b string"), "k", ["a", "b"]).count() == 3
    parts = T.split(spark.range(2000), "id").groupBy("split").count().collect()
    assert {r["split"] for r in parts} == {"train", "val", "test"} and abs(next(r["count"] for r in parts if r["split"] == "train") - 1400) < 100
    x = one(spark, T.bibcode_matches(F.lit("smith"), F.lit("2010a"), F.array(F.lit("2010ApJ...S"), F.lit("2011ApJ...S"))))[0]
    assert x == ["2010ApJ...S"]


def test_segments(spark):
    rng = random.Random(5)
    for _ in range(50):
        text = "".join(rng.choice([f"word{i} ", f"end{i}. ", "\n\n", f"x{i}", "\x00"]) for i in range(rng.randint(0, 120)))
        parts = G.split_text(text, 60, 10)
        assert all(0 < len(p) <= 60 and p.strip() for p in parts)
        at = 0
        clean = text.replace("\x00", "")
        for p in parts:  # chunks cover all that isn't blank, in order
            i = clean.find(p, max(0, at - 11))
            assert i >= 0 and not clean[at:i].strip()
            at = max(at, i + len(p))
        assert not clean[at:].strip()
    assert G.boundary_similarity([3, 3, 4], [3, 3, 4]) == 1.0 and G.boundary_similarity([5, 5], [10]) == 0.0
    assert G.boundary_similarity([4, 6], [5, 5]) == 0.5
    v = spark.createDataFrame([(0, i, [1.0, 0.1 * (i % 2) + 5.0 * (i > 5)]) for i in range(12)], "g int, i int, v array<double>")
    for kind, amount in (("percentile", 90.0), ("standard_deviation", 2.0), ("interquartile", 1.5)):
        assert [r["i"] for r in G.breakpoints(v, "g", "i", "v", kind, amount).filter("cut").collect()] == [6]


def test_embedding_and_schemas(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "i int, t string")
    rows = {r["i"]: r["v"] for r in E.embed_once(d, "t", "v", "hashing_64").collect()}
    assert rows[1] == rows[2] and np.linalg.norm(rows[1]) == pytest.approx(1)
    with pytest.raises(ValueError):
        E.provider("nothing")
    for bad in (lambda: schemas.exact_columns(d, ["i"]), lambda: schemas.require_columns(d, ["x"])):
        with pytest.raises(ValueError):
            bad()
    assert schemas.complete_rows(d, ["t"]).count() == 2 and "results" in schemas.schema("SEARCH_RESULT").names


def test_citations_of_several_authors(spark):
    text = "See Smith & Jones (2010), Ito, Sato and Abe-Kato, 2011b; O'Neil et al. ( 2004 ) and Müller 1999."
    found = spark.createDataFrame([(text,), ("none here",), (None,)], "t string").select(X.citations(F.col("t")).alias("c")).collect()
    assert [tuple(c) for c in found[0]["c"]] == re.findall(X.CITATION, text) and len(found[0]["c"]) == 4
    assert found[1]["c"] == [] and found[2]["c"] is None


def test_bm25_robertson(spark):
    texts = ["The red fox", "a red red dog sleeps", "blue fox runs far away", "green tree", None]
    query = "red fox and red trees"
    q = spark.createDataFrame([(1, query), (2, None)], "qid int, query string")
    rows = R.bm25(q, spark.createDataFrame(list(enumerate(texts)), "pid int, text string"), kind="robertson").collect()
    words = [[w for w in re.findall(r"\w\w+", (t or "").lower()) if w not in X.STOP_WORDS] for t in texts]
    mean = sum(map(len, words)) / len(words)
    want = {}
    for term in [w for w in re.findall(r"\w\w+", query) if w not in X.STOP_WORDS]:
        n = sum(term in w for w in words)
        for i, w in enumerate(words):
            if term in w:
                weight = math.log(max((len(words) - n + 0.5) / (n + 0.5), 1))
                want[i] = want.get(i, 0) + weight * w.count(term) / (w.count(term) + 1.5 * (0.25 + 0.75 * len(w) / mean))
    assert {r["pid"]: round(r["bm25"], 9) for r in rows} == {i: round(x, 9) for i, x in want.items()}
    with pytest.raises(ValueError):
        R.bm25(q, q, kind="other")


def test_rerank(spark):
    hits = spark.createDataFrame([(1, "red fox", "A Red dog"), (2, "red fox", None), (3, None, "x"), (4, "red fox", "fox red")], "pid int, query string, text string")
    got = {r["pid"]: r["score_rerank"] for r in R.rerank(hits, "overlap", batch=2).collect()}
    assert got == pytest.approx({1: 0.5, 2: 0.25, 3: 0.5, 4: 0.75})
    assert R.softmax_yes(-1000.0, 1000.0) == 1.0 and R.rerank(hits.limit(0), "overlap").count() == 0
    with pytest.raises(KeyError):
        R.rerank(hits, "none")


def test_random_negatives_by_brute_force(spark):
    passages = [(i, i % 7) for i in range(60)]
    queries = [(0, [0, 1]), (3, [3, 3, 4, 5, 6]), (8, list(range(7))), (100, [])]
    q, p = spark.createDataFrame(queries, "qid int, targets array<int>"), spark.createDataFrame(passages, "pid int, doc int")
    order = sorted(passages, key=lambda x: hashlib.md5(str(x[0]).encode()).hexdigest())
    want = {(qid, pid, k) for qid, t in queries for k, pid in enumerate([pid for pid, doc in order if doc not in t and pid != qid][:4], 1)}
    assert {tuple(r) for r in L.random_negatives(q, p, 4).collect()} == want
    mixed = L.mixed_negatives(p.selectExpr("doc qid", "pid"), p.selectExpr("doc qid", "pid + 1000 pid"), 0.5).collect()
    assert all((r["pid"] < 1000) == r["hard"] for r in mixed) and len(mixed) == 7 and len({r["hard"] for r in mixed}) == 2
    assert not any(r["hard"] for r in L.mixed_negatives(p.selectExpr("doc qid", "pid"), p.selectExpr("doc qid", "pid"), 0.0).collect())


def test_small_operators(spark):
    rows = spark.createDataFrame([(1, "abcd"), (2, None), (3, "")], "i int, t string")
    assert {r["i"] for r in T.not_longer(rows, "t", 3).collect()} == {2, 3}
    a, b = spark.createDataFrame([(1,), (1,), (None,)], "k int"), spark.createDataFrame([(None,), (1,)], "k int")
    assert tuple(T.same_rows(a, b).first()) == (0, 0, True) and tuple(T.same_rows(a, b.filter("k = 1")).first()) == (1, 0, False)
    batches = spark.createDataFrame([(0, 1.0, 0.5, 1), (0, 4.0, None, 2), (1, None, None, 3)], "epoch int, loss double, similarity double, size int")
    assert sorted(map(tuple, L.epoch_means(batches).collect())) == [(0, 3.0, 0.5, 3), (1, None, None, 3)]


def test_small_negatives_round_to_negative_zero(spark):
    """As SQL rounds them; a comparison of digests sees the sign."""
    values = F.array(*[F.lit(x) for x in (-4e-7, 4e-7, -6e-7, 0.0, math.inf)])
    got = one(spark, F.transform(values, lambda x: V.rounded(x, 6)).alias("x"), V.rounded(F.lit(None).cast("double"), 6).alias("none"))
    assert [str(x) for x in got["x"]] == ["-0.0", "0.0", "-1e-06", "0.0", "inf"] and got["none"] is None


def test_normalized_takes_the_norm_once(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, []), (4, None)], "i int, v array<double>")
    assert [r["n"] for r in rows.orderBy("i").select(V.normalized(F.col("v")).alias("n")).collect()] == [[0.6, 0.8], [0.0, 0.0], [], None]


def test_best_passages_and_cosine_losses_over_blocks(spark, vectors, monkeypatch):
    """Blocks of any size give what plain expressions give; the rows that leave the tasks grow with the queries, not with the pairs."""
    q = vectors.filter("pid in (1, 2, 3)").select(F.col("pid").alias("qid"), "vector", F.array(F.lit(0), F.lit(3), F.lit(3), F.lit(9)).alias("targets"))
    rows, asked = vectors.collect(), q.collect()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    cosine = lambda a, b: dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))
    want, losses = [], {}
    for a in asked:
        for doc in (0, 3):
            near = sorted((-round(dot(a["vector"], p["vector"]), 9), p["pid"]) for p in rows if p["doc"] == doc and p["pid"] != a["qid"])
            want += [(a["qid"], doc, i + 1, pid) for i, (_, pid) in enumerate(near[:4])]
        near = [(cosine(a["vector"], p["vector"]), p["doc"]) for p in rows if p["pid"] != a["qid"]]
        losses[a["qid"]] = sum(1 - s if d in (0, 3) else max(0.0, s - 0.1) for s, d in near) / len(near)
    for size in (64, 64 << 20):
        monkeypatch.setattr(S, "QUERY_BYTES", size)
        best = L.best_passages(q, vectors, 4, vectors=False)
        assert sorted(tuple(r)[:4] for r in best.collect()) == sorted(want)
        got = {r["qid"]: (r["n"], r["loss"]) for r in L.cosine_losses(q, vectors).collect()}
        assert got == {k: (59, pytest.approx(v)) for k, v in losses.items()}
    lost = vectors.unionByName(spark.createDataFrame([(99, None, 9, 0)], vectors.schema))
    assert [(r["qid"], r["pid"], r["score"]) for r in L.best_passages(q, lost, 1, False).filter("doc = 9").orderBy("qid").collect()] == [(i, 99, None) for i in (1, 2, 3)]


@pytest.mark.parametrize("kind", ["okapi", "robertson"])
def test_bm25_sums_where_passages_are_read(spark, monkeypatch, kind):
    """No pair of a query and a passage is shuffled; sums are those of joins, with rows that repeat a passage, null ids and texts too."""
    docs = [(i, f"red fox {'dog ' * (i % 4)} w{i % 7} tree blue {'red' if i % 3 else ''}") for i in range(40)] + [(3, "red red fox extra"), (None, "tree fox"), (50, None)]
    asked = [("a", "Red fox red"), ("b", "tree w3 w5 nothing"), (None, "dog blue"), ("c", None), ("d", "zebra")]
    q, d = spark.createDataFrame(asked, "qid string, query string"), spark.createDataFrame(docs, "pid int, text string")
    once = R.bm25(q, d.filter("pid <> 3"), kind=kind)
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    for corpus in (d, d.filter("pid <> 3"), d.filter("false")):
        got = {(r["qid"], r["pid"]): r["bm25"] for r in R.bm25(q, corpus, kind=kind).collect()}
        with monkeypatch.context() as m:
            m.setattr(R, "BM25_TERMS", -1)
            assert got == pytest.approx({(r["qid"], r["pid"]): r["bm25"] for r in R.bm25(q, corpus, kind=kind).collect()})
        assert len(got) > 60 or corpus.isEmpty()
    assert R.bm25(q.filter("false"), d, kind=kind).isEmpty()


@pytest.mark.parametrize("kind", ["okapi", "robertson"])
def test_bm25_of_own_hits_deals_no_words(spark, kind):
    """Words of passages are never rows; sums are those of each query by itself, with rows that repeat a passage too."""
    asked = [(1, "red fox and tree"), (2, "blue blue dog"), (3, "nothing here"), (4, None)]
    hits = [(q, i, f"red {'fox ' * (i % 3)} dog{i} {'blue dog' if q == 2 and i % 4 == 0 else 'tree'} w{q}") for q in range(6) for i in range(8)]
    hits += [(1, 3, "red one"), (2, 9, None), (2, 2, "red fox fox  dog2 tree w2")]
    q, d = spark.createDataFrame(asked, "qid int, query string"), spark.createDataFrame(hits, "qid int, pid int, text string")
    scored = R.bm25(q, d, per_query=True, kind=kind)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(w" not in plan and "MapInArrow" in plan
    got = {(r["qid"], r["pid"]): r["bm25"] for r in scored.collect()}
    want = {}
    for qid, _ in asked:
        alone = R.bm25(q.filter(F.col("qid") == qid), d.filter(F.col("qid") == qid).drop("qid"), kind=kind)
        want |= {(r["qid"], r["pid"]): r["bm25"] for r in alone.collect()}
    assert got == pytest.approx(want) and len(got) > 8
