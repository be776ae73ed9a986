import random
import re
from collections import Counter

import numpy as np
import pytest

from siftwell.llm import collocations as C


def brute(docs, longest=3, least=10, cover=50, top=2000):
    """All phrases counted one by one."""
    counts, n = {}, Counter()
    for text, lang in docs:
        own = counts.setdefault(lang or "und", Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        rows = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and b >= least and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in f.items())
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = ["the", "The", "of", "new", "york", "city", "a", "é", "naïve", "\x85x", "b\x1fc", "x-y", "İ", "Σ"] + [f"w{i}" for i in range(12)]
    passage = " ".join(rng.choice(vocab) for _ in range(90))
    docs = []
    for _ in range(n):
        words = [rng.choice(vocab) + rng.choice(["", "", "", "", ",", ". ", "!", "\n", ";"]) for _ in range(rng.randint(0, 60))]
        docs.append((rng.choice([" ", "\t", "  "]).join(words) + rng.choice(["", " New York City", " " + passage]), rng.choice(["en", "en", "de", None])))
    return docs + [(None, "en"), ("", None), ("   ", "fr"), ("one two", "fr"), ("... !!", "en"), ("a a a a a a a a a a a a a a", "it"), ("ab cd " * 30_000, "long")]


def rows(spark, docs, **kw):
    d = spark.createDataFrame(docs, "text string, lang string").selectExpr("1 AS doc_id", "*", "lang AS phrase", "text AS run", "3 AS block")
    return sorted(tuple(r) for r in C.collocations(d, **kw).collect())


@pytest.mark.parametrize("shard, kw", [(100_000, {}), (25, {}), (60, {"longest": 4, "least": 8, "cover_percent": 70, "top": 15})])
def test_matches_brute_force(spark, monkeypatch, shard, kw):
    monkeypatch.setattr(C, "SHARD", shard)
    docs = corpus(4, 150)
    docs += docs[:20]  # repeated rows count again
    names = {"cover_percent": "cover"}
    expected = brute(docs, **{names.get(k, k): v for k, v in kw.items()})
    assert rows(spark, docs, **kw) == expected and len(expected) > 40


def test_a_sketch_that_is_far_too_small_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "LEAST_BITS", 7)
    monkeypatch.setattr(C, "MOST_BITS", 7)
    monkeypatch.setattr(C, "FAN_IN", 2)
    docs = corpus(9, 60)
    assert rows(spark, docs) == brute(docs)


def test_long_runs_are_cut_so_that_each_phrase_lies_in_one_part():
    rng = random.Random(1)
    for n in (2, 30, 34, 35, 36, 64, 66, 67, 68, 69, 200):
        words = [rng.choice(["a", "ö", "bb"]) for _ in range(n)]
        data, at = " ".join(words).encode(), C.word_spans(" ".join(words).encode())
        for longest in (2, 3, 4):
            phrases = sorted({" ".join(words[i : i + k]) for k in range(2, longest + 1) for i in range(n - k + 1)})
            own, parts = zip(*C._cut_run(data, at[1], at[2], longest), strict=True)
            parts = [p.decode() for p in parts]
            real = Counter(" ".join(words[i : i + k]) for k in range(2, longest + 1) for i in range(n - k + 1))
            got = C._scan(parts, np.array(own), np.full(len(own), 2), phrases)
            assert dict(zip(phrases, got.tolist(), strict=True)) == {p: 2 * c for p, c in real.items()}


@pytest.mark.parametrize("least", [2, 10, 15, 16, 200, 255, 256, 70_000])
def test_counters_stop_at_the_threshold(least):
    rng = np.random.default_rng(least)
    counters, plain = C.Counters(8, least), np.zeros((C.ROWS, 256), np.int64)
    for _ in range(40):
        at = rng.choice(256, 60, replace=False)
        n = np.minimum(rng.integers(1, 2 * least, 60), least)
        for row in range(C.ROWS):
            counters.add(row, at, n)
            plain[row, at] = np.minimum(plain[row, at] + n, least)
        read = np.concatenate([C.Counters.read(b, least) for _, b in counters.blocks()]) if counters.data.any() else []
        assert read.tolist() == plain.reshape(-1).tolist()
    assert C.Counters.read(C.Counters.write(plain[0], least), least).tolist() == plain[0].tolist()


def test_scores_beyond_64_bits(spark):
    big = 4 * 10**12
    phrases = spark.createDataFrame([("en", "a b", big - 1), ("en", "b c", 10)], "lang string, phrase string, f bigint")
    single = spark.createDataFrame([("en", "a", big), ("en", "b", big + 7), ("en", "c", 11)], "lang string, phrase string, f bigint")
    got = {r["phrase"]: r["score"] for r in C.scored(phrases, single, 50).collect()}
    assert got == {"a b": 10**6 * (big - 1) ** 2 // (big * (big + 7)), "b c": 10**6 * 100 // ((big + 7) * 11)}


def test_no_documents_and_awkward_ones(spark, docs, no_docs):
    assert C.collocations(no_docs, lang="root").count() == 0
    assert C.collocations(docs.filter("doc_id IN (5, 6, 7)"), lang="root").count() == 0
    found = C.collocations(docs, lang="root", least=2).collect()
    assert {"o"} < {r["lang"] for r in found} and all(r["a"] >= 2 for r in found)
