"""The operators made of DataFrame operations only."""

import random
import time

import pytest
from pyspark.sql import functions as F

from siftwell.llm import chat_format as C
from siftwell.llm import license_scan as N
from siftwell.llm import line_dedup as L
from siftwell.llm import url_filter as U
from tests.llm.conftest import prose


def no_python(df):
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def windows(line, width=5):
    """All windows of the normalised line, written without the operator."""
    norm = line.strip(" ").lower()
    return {norm[k : k + width] for k in range(max(1, len(norm) - width + 1))}


def similar(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def kept_lines(rows):
    """Brute force: of each component of similar lines the first one of the smallest doc_id stays."""
    every = [(i, n, line) for i, text in rows for n, line in enumerate(text.split("\n"))]
    sets, parent = [windows(x[2]) for x in every], list(range(len(every)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(every)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    out = {}
    for k, (i, _, line) in enumerate(every):
        out.setdefault(i, []).extend([line] if find(k) == k or not line.strip(" ") else [])
    return {i: "\n".join(x) for i, x in out.items()}


def test_lines_by_brute_force(spark):
    rng, rows = random.Random(8), []
    signs = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳"
    pool = [prose(i, 40) for i in range(12)] + ["".join(rng.choice(signs) for _ in range(60)) for _ in range(6)]
    pool += [f"https://example.org/{rng.choice(('news', 'shop'))}/{rng.randrange(9999)}/{prose(i, 5).replace(' ', '-')}" for i in range(8)]
    pool += [f'{{"id":"{i}","text":"{prose(90 + i, 8).replace(" ", "_")}"}}' for i in range(4)] + ["les.", "ab", "menu", "😀😀 smile 😀", ""]
    for i in range(70):
        lines = []
        for _ in range(rng.randint(1, 5)):
            line = list(rng.choice(pool))
            for _ in range(rng.choice((0, 0, 1, 2)) if len(line) > 30 else 0):  # typos
                line[rng.randrange(len(line))] = rng.choice("xyz")
            lines.append("".join(line).upper() if rng.random() < 0.1 else "".join(line))
        rows.append((i, "\n".join(lines)))
    got = L.remove_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    no_python(got)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == kept_lines(rows)


def test_lines_without_spaces_that_share_an_opening_stay(spark):
    rows = [
        (1, "https://example.org/news/2021/spring-flowers-open-early"), (2, "https://example.org/shop/9914/blue-bicycle-with-basket"),
        (3, "今天天气很好我们一起去公园散步看花吧朋友"), (4, "今天天气很好但是股票市场大幅下跌引起恐慌"), (5, "z" * 200_000), (6, "z" * 190_000 + "y"),
    ]
    got = {r["doc_id"]: r["n_removed"] for r in L.remove_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0}  # zzzzz against zzzzz and zzzzy: 50 %


def test_recall_of_bands_just_above_the_threshold(spark):
    """Pairs of lines with a similarity of 0.8 to 0.84, of many lengths: those that the bands or the bitmaps lose."""
    rng, rows, near = random.Random(5), [], set()
    while len(near) < 400:
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.choice((25, 60, 120, 400, 1500)))).strip()
        other = list(line)
        for _ in range(max(1, len(line) // 45)):
            other[rng.randrange(len(other))] = rng.choice("0123456789")
        other = "".join(other)
        a, b = windows(line), windows(other)
        if 0.8 <= len(a & b) / len(a | b) <= 0.84:
            near.add(len(rows))
            rows += [(len(rows), line), (len(rows) + 1, other)]
    got = {r["doc_id"]: r["n_removed"] for r in L.remove_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(got[i + 1] for i in near) >= 0.98 * len(near) and sum(got.values()) <= len(near)


def test_large_buckets_of_lines_lose_no_link(spark, monkeypatch):
    """One long line in many versions, some linked through others only: every pair of the large buckets is tried, in chunks too."""
    from siftwell.llm import stars

    rng, rows = random.Random(12), []
    base = prose(77, 60)
    for i in range(90):
        line = list(base)
        for _ in range(rng.randint(4, 14)):
            line[rng.randrange(len(line))] = rng.choice("0123456789")
        rows.append((i, "".join(line)))
    monkeypatch.setattr(stars, "CHUNK", 16)
    got = L.remove_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    no_python(got)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == kept_lines(rows)


def test_lines_beside_columns_of_any_name(spark, docs):
    clash = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(("gone", "row", "h1", "rk", "own_id", "gone_id", "a.b"))])
    got = L.remove_lines(clash)
    assert got.columns == [c for c in clash.columns if c != "n_removed"] + ["n_lines", "n_removed"]
    assert got.select("gone", "`a.b`").distinct().collect() == [(0, 6)]


def test_lines_of_awkward_documents(docs, no_docs):
    rows = L.remove_lines(docs).collect()
    assert len(rows) == docs.count() and L.remove_lines(no_docs).count() == 0
    texts = {r["doc_id"]: r for r in rows}
    assert texts[2]["text"] == "" and texts[2]["n_removed"] == 1 and texts[1]["n_removed"] == 0
    assert texts[5]["text"] is None and texts[6]["text"] == "" and texts[7]["text"] == "   "
    assert "\n" not in texts[14]["text"] and texts[14]["n_lines"] == 3 and texts[14]["n_removed"] == 2
    long = {r["doc_id"]: r for r in L.remove_lines(docs, min_chars=20).collect()}
    assert long[14]["n_removed"] == 2  # the short line is equal to one of another document
    assert [r["n_removed"] for r in rows if r["doc_id"] == 10] == [r["n_removed"] for r in rows if r["doc_id"] == 10][::-1]


def test_shorter_lines_must_be_equal(spark):
    line = "nineteen characters"
    rows = [(1, f"first of all\n{line}\nab"), (2, f"second\n{line.upper()} \nab"), (3, f"third\n{line}s\nabc"), (4, f"fourth\n{line}s and more of them\nx"), (5, f"fifth\n{line}s and more of them!\ny")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = lambda n: {r["doc_id"]: r["text"].split("\n") for r in L.remove_lines(d, min_chars=n).collect()}
    assert left(1) == {1: rows[0][1].split("\n"), 2: ["second"], 3: ["third", "abc"], 4: rows[3][1].split("\n"), 5: ["fifth", "y"]}
    assert left(20) == left(1) | {3: rows[2][1].split("\n")} | {4: rows[3][1].split("\n"), 5: ["fifth", "y"]}


def test_licenses(spark, docs, no_docs):
    head = N.TEMPLATES["mit-notice"]
    rows = [
        (1, prose(1, 50) + " " + N.TEMPLATES["gpl-3.0"] + prose(2, 50)), (2, prose(3, 33) + "\n" + head.replace("free of charge", "free of any charge") + prose(4, 9)),
        (3, "Released under the MIT License."), (4, prose(5, 20_000) + " licensed under cc by-nc 4.0 " + prose(6, 100)), (5, head[: len(head) // 2]), (5, "license copyright permission"),
    ]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("license", F.lit("clash"))
    found = N.scan(d)
    no_python(found)
    assert sorted((r["doc_id"], r["licenses"]) for r in found.collect()) == [
        (1, ["gpl-3.0"]), (2, ["mit-notice"]), (3, ["mit"]), (4, ["cc-by-nc-4.0"]), (5, []), (5, []),
    ]
    assert N.scan(docs).filter("size(licenses) > 0").count() == 0 and N.scan(docs).count() == docs.count()
    assert N.scan(no_docs).count() == 0


def test_urls(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    rows = [
        ("http://A.Example.NET/en/1", "allow", "example.net/en/"), ("https://x.net", None, None), ("https://x.net/", "block", "net/"), ("http://internet/", None, None),
        ("http://example.com/de/?q", "block", "example.com/de/"), ("http://example.com/dex", None, None), ("ftp://a.b.org/fr/#f", "allow", "org/fr/"), (None, None, None), ("no scheme", None, None),
        ("", None, None), ("http://x.net/", "block", "net/"), ("http://x.net/", "block", "net/"),
    ]
    rows += [(f"http://site{i}.{'net' if i % 2 else 'org'}/{'a' if i % 2 else 'fr'}/{i}", None, None) for i in range(60)]
    d = spark.createDataFrame([(i, u, "x") for i, (u, *_) in enumerate(rows)], "page_id bigint, url string, rule string")
    out = U.judge(d, rules)
    no_python(out)
    got = {r["page_id"]: r for r in out.collect()}
    assert len(got) == len(rows) and set(out.columns) == {"page_id", "url", "host", "path", "rule", "verdict"}
    for i, (_, verdict, rule) in enumerate(rows[:12]):
        assert got[i]["rule"] == rule and (verdict is None or got[i]["verdict"] == verdict), rows[i]
    assert (got[0]["host"], got[0]["path"]) == ("a.example.net", "/en/1") and (got[7]["host"], got[8]["path"]) == ("", "")
    assert all(r["verdict"] in ("allow", "block") for r in got.values())
    assert U.judge(d.filter("false"), rules).count() == 0
    assert {r["verdict"] for r in U.judge(d.filter("rule is null or url like '%nothing%'"), rules).collect()} <= {"allow"}


def test_url_trees_learn_held_out_labels(spark):
    rng = random.Random(6)
    rows = []
    for i in range(800):
        bad = rng.random() < 0.5
        digits = "".join(rng.choice("0123456789") for _ in range(12 if bad else 1))
        rows.append((i, f"http://h{i % 7}.example.{'biz' if bad else 'com'}/{'a/b/c/d/' if bad else 'a/'}{digits}", int(bad)))
    d = spark.createDataFrame(rows, "page_id bigint, url string, label int")
    out = U.judge(d.filter("page_id % 4 = 0").drop("label"), [], d.filter("page_id % 4 <> 0"))
    truth = {i: bad for i, _, bad in rows}
    assert all((r["verdict"] == "block") == bool(truth[r["page_id"]]) for r in out.collect())


TEXTS = ["", "plain", "[INST] x [/INST]", "\\[INST]", "<\\s>", "\\\\", "</s></s>", "<<SYS>><</SYS>>", "a\n\nb", "<|end|><|role|>", "[\\INST]", "é\u0000x", None]


def test_chat_round_trip(spark):
    rng, rows = random.Random(7), []
    roles = ["system", "user", "assistant", "tool", "", None, "a\nb"]
    for conv in range(60):
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, turn, rng.choice(roles), rng.choice(TEXTS) if rng.random() < 0.6 else (rng.choice(TEXTS) or "") + (rng.choice(TEXTS) or "")))
    rows += [(70, 0, "user", "a"), (70, 1, "assistant", "b"), (70, 1, "assistant", "b"), (71, 0, "user", "q"), (71, 1, "assistant", "r"), (None, 0, "user", "x")]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("fault", F.lit("clash"))
    out = C.read_back(C.segments(d))
    no_python(out)
    got = {r["conv_id"]: r for r in out.collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        assert got[conv]["turns"] == "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        learned = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        assert got[conv]["learned"] == learned and got[conv]["loss_chars"] == len(learned) and got[conv]["n_turns"] == len(turns)
    assert got[71]["valid"] and not got[70]["valid"]
    assert C.segments(d.filter("false")).count() == 0


def test_chat_order(spark):
    rows = [(1, i, r, "t") for i, r in enumerate(["system", "user", "assistant", "user"])] + [(2, i, r, "t") for i, r in enumerate(["assistant", "user", "user", "alien"])]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    faults = {(r["conv_id"], r["turn"]): r["fault"] for r in C.validate(d).collect()}
    assert faults == {(1, 0): None, (1, 1): None, (1, 2): None, (1, 3): None, (2, 0): "order", (2, 1): None, (2, 2): "order", (2, 3): "role"}
    with pytest.raises(ValueError):
        C.Template({"user": ("x", "yy", False)}, {})


def test_lines_with_one_wrong_character(spark):
    pairs = [
        ("the quick brown fox jumps over the lazy dog near the old riverbank", "the quick brown fox jumps over the lazy dxg near the old riverbank"),
        ("https://example.org/a/long/path/without/any/space/index.html?page=1", "https://example.org/a/long/path/without/any/space/index.html?page=2"),
    ]
    apart = ["https://example.org/one/quite/different/address", "https://example.org/many/other/things/are/found/there"]
    rows = [(i, line) for i, line in enumerate([x for p in pairs for x in p] + apart)]
    got = L.remove_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    no_python(got)
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0, 5: 0}


def test_wide_bitmaps_rule_out_no_linked_lines(spark):
    """Sizes count a repeated window once, and no more bits differ than windows, with characters beyond the basic plane too."""
    rng = random.Random(3)
    lines = [prose(i, 40) + " " + "over and over again " * 10 + "😀" * (i % 3) for i in range(6)]
    for line in list(lines):
        other = list(line)
        for _ in range(6):
            other[rng.randrange(len(other))] = rng.choice("0123456789")
        lines.append("".join(other))
    lines = [line.strip() for line in lines]  # as _normal gives them
    df = spark.createDataFrame(list(enumerate(lines)), "h1 bigint, norm string")
    got = {r["node"]: r for r in L._wide(df).collect()}
    for i, a in enumerate(lines):
        assert got[i]["n"] == len(windows(a)) and len(got[i]["wide"]) == L.WIDE_WORDS
        for j, b in enumerate(lines):
            differ = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(got[i]["wide"], got[j]["wide"], strict=True))
            assert differ <= len(windows(a) ^ windows(b)) and (i == j or differ > 0)


def test_a_document_of_many_lines_is_split_once(spark):
    """Before, its text was split again for each line that stays: minutes for this one."""
    n = 40_000
    text = "\n".join(f"{i}: line {i * 7919 % n}" for i in range(n)) + "\n0: line 0"
    began = time.perf_counter()
    row = L.remove_lines(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), min_chars=40).first()
    assert row["n_removed"] == 1 and row["text"] == text.rsplit("\n", 1)[0] and time.perf_counter() - began < 60


def test_arrays_are_not_made_again_for_an_inferred_filter(spark):
    docs = spark.createDataFrame([(1, prose(1, 60)), (2, None), (3, "")], "doc_id bigint, text string")
    lines = L.lines_of(docs)
    for df in (lines, L._signed(lines), L._wide(lines.select("h1", "norm"))):
        assert "(size(" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [r["doc_id"] for r in lines.collect()] == [1]


def test_similarity_makes_each_set_once(spark):
    """Nor are wide bitmaps gathered again for each of their words."""
    lines = spark.createDataFrame([(1, prose(1, 60))], "h1 bigint, norm string")
    plan = lines.filter(L._similar(L._hashes(F.col("norm")), L._hashes(F.col("norm")), 80))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct(") == 2 and L._wide(lines).first()["n"] == len(windows(lines.first()["norm"]))
