import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siftwell.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_equals_the_tokenizer():
    ours, plain = P.Encoder(PATH), Tokenizer.from_file(PATH)
    assert ours.fast is not None
    rng = random.Random(1)
    pieces = [" ", "  ", "\n", "\t", "word", "it's", "'LL", "123", "é", "<|endoftext|>", "中", ".", "\u3000", "a", "\r\n", "\u0301"]
    for _ in range(2000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert ours.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids, text
    for text in ("a" * 100_000, " " * 50_000, "".join(rng.choice("abcdefghij") for _ in range(50_000)), "中" * 20_000):
        assert ours.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids


RUNS = [" ", "\n", "\t", "\r\n", "\u3000", "a", "1", "^", "中", "́", " a", "\n "]


def test_long_runs_of_every_class_of_character(spark):
    """Through the encoder and through pack: white space, letters, digits, signs, marks; also where text follows."""
    ours, plain = P.Encoder(PATH), Tokenizer.from_file(PATH)
    texts = [(r * 2_000_000)[:2_000_000] + end for r in RUNS for end in ("", "x")]
    wanted = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert all(ours.encode(t).tolist() == w for t, w in zip(texts, wanted, strict=True))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    got = {r["doc_id"]: r["n"] for r in P.pack(d, PATH).groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect()}
    assert got == {k: len(w) + 1 for k, w in enumerate(wanted)}


def test_encoder_equals_the_tokenizer_for_every_character():
    ours, plain = P.Encoder(PATH), Tokenizer.from_file(PATH)
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for i in range(0, len(points), 8192):
        texts = [f"a{c}b {c} 1{c}2  {c}{c} ,{c}" for c in map(chr, points[i : i + 8192])]
        want = plain.encode_batch_fast(texts, add_special_tokens=False)
        assert all(ours.encode(t).tolist() == w.ids for t, w in zip(texts, want, strict=True))


def test_other_tokenizers_are_encoded_by_their_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    ours, plain = P.Encoder(path), Tokenizer.from_file(path)
    assert ours.fast is None
    assert ours.encode("Some Words, here.").tolist() == plain.encode("Some Words, here.", add_special_tokens=False).ids


def test_crossover_beats_its_start():
    """Triplets that fill a bin exactly: best fit decreasing needs 47 bins for 40, and crossovers save at least four of them."""
    rng, sizes = random.Random(0), []
    for _ in range(40):
        a = rng.randint(380, 490)
        b = rng.randint(250, (1000 - a) // 2)
        sizes += [a, b, 1000 - a - b]
    start = len(P._start(sizes, 1000, random.Random(0), 0.0).groups)
    assert start == 47 and 40 <= len(P.evolve(sizes, 1000, 0, [], crossovers=24).groups) <= 43
    assert len(P.evolve(sizes, 1000, 0, [], crossovers=200).groups) <= 42


def test_packing_needs_no_more_sequences_than_best_fit_decreasing(spark, monkeypatch):
    monkeypatch.setattr(P, "CELL", 64)
    rng = random.Random(4)
    sizes = [rng.randint(20, 100) for _ in range(600)]
    items = spark.createDataFrame(list(enumerate(sizes)), "uid bigint, length bigint")
    rows = P._packed(items, len(sizes), 150, P.Scratch(spark)).collect()
    assert sorted(r["uid"] for r in rows) == list(range(600)) and all(r["length"] == sizes[r["uid"]] for r in rows)
    bins = {}
    for r in rows:
        bins[r["cell"], r["bin"]] = bins.get((r["cell"], r["bin"]), 0) + r["length"]
    assert max(bins.values()) <= 150 and len(bins) <= len(P._start(sizes, 150, random.Random(0), 0.0).groups) + 3


@pytest.mark.parametrize("n", [1, 5, 8, 9, 16, 17, 100])
def test_cuts_cover(n):
    c = P.cuts(n, 8)
    assert [s for s, _ in c] == [sum(x for _, x in c[:i]) for i in range(len(c))] and sum(x for _, x in c) == n
    assert all(x == 8 for _, x in c[1:]) and (len(c) == 1 or 0 < c[0][1] <= 8)


def test_crossover_keeps_every_item_once():
    rng = random.Random(2)
    sizes = [rng.randint(1, 100) for _ in range(300)]
    a, b = (P._start(sizes, 100, random.Random(i), 0.3) for i in (1, 2))
    child = P.crossover(a, b, sizes, 100, rng)
    assert sorted(i for g in child.groups for i in g) == list(range(300))
    assert all(sum(sizes[i] for i in g) == 100 - r for g, r in zip(child.groups, child.room))
    best = P.evolve(sizes, 100, 3, [a, b])
    assert len(best.groups) <= min(len(a.groups), len(b.groups)) and len(best.groups) >= -(-sum(sizes) // 100)


def test_pack_is_an_exact_round_trip(spark, docs, no_docs, monkeypatch):
    monkeypatch.setattr(P, "CELL", 8)
    plain = Tokenizer.from_file(PATH)
    rows = P.pack(docs, PATH, capacity=512, with_ids=True).collect()
    want = sorted(plain.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in docs.collect())
    by_doc, sequences = {}, {}
    for r in rows:
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["ids"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    got = []
    for key, parts in by_doc.items():
        copies = sum(p == 0 for p, _, _ in parts)
        for c in range(copies):
            got.append([t for p in sorted(parts)[c::copies] for t in p[2]])
    assert sorted(got) == want
    assert P.pack(no_docs, PATH).count() == 0
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-total // 512) + 3
