import hashlib
import json
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from siftwell.llm import word_bpe as W

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = (
    "<|endoftext|> <|startoftext|> <|ENDOFTEXT|> it's IT'S we'll 12345 x²½ ΣΑΣ İstanbul étude ́a ̸= naïve 日本語テスト 한국어 한 🙂👍🏽 a b "
    "a\u0085b  x \x1f y\x1cz \x00 ﻿bom ﬁ ǅ ß ẞ … -- ___ 'S ''re don't ‍"
).split(" ")


def library(texts):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    out = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    return [(ids, t.decode(ids, skip_special_tokens=False)) for ids in out]


def random_texts(seed, n):
    rng = random.Random(seed)
    chars = "abcXYZ éÉ日́̀'’.,!<|>\t\n\r\x0b\x0c 　\u0085ΣİI1²"
    own = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return own + [rng.choice([" ", "\t", "\n\n", "  "]).join(rng.choice(ODD) for _ in range(rng.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("frequent", [0, 30, 1 << 19])
def test_matches_the_library(spark, monkeypatch, frequent):
    monkeypatch.setattr(W, "FREQUENT", frequent)
    texts = random_texts(frequent, 120) + [None, "", "   ", "\n", "a" * 300_000, "wörd " * 60_000, " " * 200_000, "日" * 50_000, "one two", "one two"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "of none"), (None, "of none"), (None, None), (3, texts[3]), (3, "other text, same id"), (4, texts[3])]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS word", "doc_id AS same", "1 AS pos", "text AS ids", "2 AS codes")
    got = W.decode(W.encode(d, PATH), PATH).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    both = W.encode(d, PATH, decoded=True).collect()
    assert sorted(map(tuple, both), key=key) == sorted(map(tuple, got), key=key)
    expected = [(i, ids, text) for (i, _), (ids, text) in zip(rows, library([t for _, t in rows]), strict=True)]
    assert sorted(((r["doc_id"], r["ids"], r["text"]) for r in got), key=key) == sorted(expected, key=key)


def test_query_over_the_small_table(spark):
    import __spark_entry__ as entry

    rows = spark.read.parquet(f"{entry.SMOKE_DIR}/documents.parquet").select("doc_id", "text").collect()
    expected = {r["doc_id"]: x for r, x in zip(rows, library([r["text"] for r in rows]), strict=True)}
    got = entry.queries()["op12_word_bpe"](spark, entry.SMOKE_DIR).collect()
    assert len(got) == len(rows)
    for r in got:
        ids, text = expected[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_each_distinct_word_is_encoded_once(spark):
    texts = spark.createDataFrame([("a b a",), ("b\tc",), ("",), (" a ",)], "text string")
    found = {r["word"]: (r["n"], r["ids"]) for r in W.word_table(texts, PATH).collect()}
    t = Tokenizer.from_file(PATH)
    assert found == {w: (n, t.encode(w, add_special_tokens=False).ids) for w, n in (("a", 3), ("b", 2), ("c", 1))}


def test_decoding_of_any_ids(spark):
    t = Tokenizer.from_file(PATH)
    rows = [(1, [49407, 320, 49406]), (2, []), (3, None), (4, [-1, 5, 60_000, 6]), (5, [70_000])]
    d = spark.createDataFrame(rows, "key int, ids array<int>").selectExpr("'old' AS text", "*", "key AS piece").repartition(1)
    got = {r["key"]: r["text"] for r in W.decode(d, PATH).collect()}
    assert got == {1: t.decode([49407, 320, 49406], skip_special_tokens=False), 2: "", 3: None, 4: t.decode([5, 6], skip_special_tokens=False), 5: ""}


def test_no_documents_and_awkward_ones(spark, docs, no_docs):
    assert W.encode(no_docs, PATH).count() == 0 and W.decode(W.encode(no_docs, PATH), PATH).count() == 0
    assert W.encode(docs, PATH).count() == docs.count()


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError):
        W.require_words(public_tokenizers.path("byte_bpe_50k.json"))
    spec = json.load(open(PATH))
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        W.require_words(str(tmp_path / "t.json"))


def test_codes_round_trip():
    import numpy as np

    for codes in (np.zeros(0, np.uint32), np.array([0, 1, 255, 256, 70_000, 2**32 - 1], np.uint32)):
        assert W._unpack(W._pack(codes)).tolist() == codes.tolist()
    empty = W.Frequent(pa.table({"hash": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))}))
    assert empty.numbers(np.array([5], np.uint64)).tolist() == [0] and empty.lengths.tolist() == [0]


def test_words_whose_hashes_meet_are_not_taken_as_frequent(spark):
    rows = [("a", 9, 5, [1]), ("b", 8, 6, [2]), ("c", 7, 6, [3]), ("d" * 70, 50, 5, [4]), ("e", 3, 7, [5])]
    often, others = W._frequent(spark.createDataFrame(rows, "word string, n bigint, hash bigint, ids array<int>"))
    assert often.to_pylist() == [{"hash": 7, "ids": [5]}]
    assert sorted(r["word"] for r in others.collect()) == ["a", "b", "c", "d" * 70]


def test_spans_in_blocks_are_those_of_the_whole(monkeypatch):
    import numpy as np

    from siftwell.llm import wordhash as H

    rng = random.Random(3)
    data = " ".join(rng.choice(["a", "wörd", "x" * 5, " "]) for _ in range(800)).encode() + b" " + b"y" * 900 + b" end"
    whole = H.word_spans(data)
    monkeypatch.setattr(H, "BLOCK", 100)
    hashes, starts, ends = H.all_spans(data)
    assert np.array_equal(starts, whole[1]) and np.array_equal(ends, whole[2])
    long = ends - starts > 100
    assert np.array_equal(hashes[~long], whole[0][~long]) and (hashes[long] == 0).all() and long.sum() == 1
    assert [len(x) for x in H.all_spans(b"")] == [0, 0, 0]
