import random
import re

from siftwell.llm import decontaminate as D


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    out = []
    for key, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, body in items:
            b = words(body)
            m = min(window, len(b))
            runs = {tuple(b[i : i + m]) for i in range(len(b) - m + 1)} if b else set()
            for i in range(len(w) - m + 1):
                if m and tuple(w[i : i + m]) in runs:
                    hit.update(range(i, i + m))
                    found.add(str(item))
        out.append((key, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocab = ["a", "b", "c", "dé", "E1"]
    draw = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "-", "_"]) for _ in range(n))
    items = [(i, draw(rng.randint(0, 14))) for i in range(25)] + [(30, None), (31, ""), (31, "x y"), (32, "a b")]
    docs = [(i, draw(rng.randint(0, 60))) for i in range(60)] + [(60, None), (61, ""), (None, draw(30)), (62, draw(40)), (62, draw(40))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (10**6, 40):
        monkeypatch.setattr(D, "BLOCK_WORDS", block)
        got = D.scan(d, b).select("doc_id", "n_words", D.n_hit().alias("h"), "items").collect()
        assert sorted(((r[0], r[1], r[2], list(r[3])) for r in got), key=repr) == brute(docs, items)


def test_cutting(spark, docs, no_docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(1, f"Before, one two three. {item}! And after it much more text stands here."), (2, item), (3, "clean text"), (4, None), (5, "")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", spark.range(1).select().columns and None or __import__("pyspark.sql.functions", fromlist=["lit"]).lit(0).cast("bigint"))
    b = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    out = {r["doc_id"]: r for r in D.decontaminate(d, b).collect()}
    assert set(out) == {1, 3, 4, 5}
    assert out[1]["text"] == "Before, one two three. ! And after it much more text stands here."
    assert out[1]["n_chars"] == len(out[1]["text"]) and out[3]["text"] == "clean text"
    same = D.decontaminate(docs, b)
    assert same.columns == docs.columns and same.count() == docs.count()
    assert D.decontaminate(no_docs, b).count() == 0 and D.scan(docs, b.filter("false")).count() == docs.count()


def test_cutting_by_blocks_equals_one_block(spark, monkeypatch):
    w = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(w[0:14])), (2, " ".join(w[8:22])), (3, " ".join(w[40:52]))]
    docs = [
        (1, "start here " + " ".join(w[0:22]) + " then a good many other words follow so that less than half of them is hit by any item at all"),
        (2, " ".join(w[0:12]) + " p q r s t u " + " ".join(w[40:52])),
        (3, " ".join(w[42:47]) + " " + " ".join(w[0:12]) + " " + " ".join(w[47:52]) + " and so on with words that are in no item, one after the other, until the end"),
        (4, None), (5, ""), (6, "nothing"),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    out = []
    for block in (10**6, 10):
        monkeypatch.setattr(D, "BLOCK_WORDS", block)
        out.append(sorted(tuple(r) for r in D.decontaminate(d, b).select("doc_id", "text").collect() if r["text"] is not None))
    assert out[0] == out[1] and [r[0] for r in out[0]] == [1, 3, 5, 6]
    assert out[0][0][1].startswith("start here  then a good")
