import random
import zlib

import pyspark.sql.functions as F

from siftwell.llm import toxicity as T
from tests.llm.conftest import prose

BAD = ["vorkel", "vorkeln", "grumsh", "snathe"]


def corpus(n):
    rng, docs, labels = random.Random(9), [], []
    for i in range(n):
        words = prose(i, 60).split()
        bad = i % 5 == 0
        for _ in range(4 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_spans(spark):
    docs, labels = corpus(300)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("toxicity", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    rows = T.score(d, T.fit(d, lab)).withColumn("out", T.held_out(F.col("doc_id"))).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r["out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all((r["toxicity"] >= 0.5) == bool(truth[r["doc_id"]]) for r in held)
    for r in rows:
        for s in r["toxic_spans"]:
            assert r["text"][s["start"] : s["end"]] in BAD


def test_awkward_rows(spark, docs, no_docs):
    texts, labels = corpus(100)
    d = spark.createDataFrame(texts, "doc_id bigint, text string")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = T.fit(d, lab)
    got = T.score(docs, model)
    assert got.columns == [*docs.columns, "toxicity", "toxic_spans"] and got.count() == docs.count()
    assert got.filter("toxicity is null or toxicity < 0 or toxicity > 1").count() == 0
    assert T.score(no_docs, model).count() == 0
    assert T.fit(d, lab.filter("false")) is None and T.fit(d, lab.filter("toxic = 0")) is None
    assert T.score(docs, None).filter("toxicity <> 0").count() == 0
    assert T.keep_clean(docs, lab).columns == docs.columns


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    e, t = rng.normal(size=(T.CLASSES, 2)), rng.normal(size=(2, 2))
    gaps, kinds = [1, 0, 3, 2], [4, 9, 2]
    seq = [k for g, k in zip(gaps, kinds) for k in [0] * g + [k]] + [0] * gaps[-1]
    p = np.zeros((len(seq), 2))
    for path in itertools.product((0, 1), repeat=len(seq)):
        w = sum(e[k, y] for k, y in zip(seq, path)) + sum(t[a, b] for a, b in zip((0, *path), path))
        for i, y in enumerate(path):
            p[i, y] += np.exp(w)
    want = [p[i, 1] / p[i].sum() for i, k in enumerate(seq) if k]
    got = T.Chain(e, t).marginals(gaps, kinds)
    assert np.allclose(got, want)


def test_chain_is_fitted_on_all_sequences():
    """Toxic sequences that come after 400 clean ones count like those before them."""
    strong, weak = T.STRONG * (T.STEPS + 1), 1
    clean = [([2, 3], [weak], [0]) for _ in range(500)]
    toxic = [([2, 0, 3], [strong, weak], [1, 1]) for _ in range(300)]
    late, early = T._fit_chain(clean + toxic), T._fit_chain(toxic + clean)
    for a, b in zip(late, early, strict=True):
        assert abs(a - b).max() < 1e-6
    p = T.Chain(*late).marginals([2, 0, 3], [strong, weak])
    assert p.min() > 0.5


def test_likelihood_and_gradient_equal_enumeration():
    import itertools

    import numpy as np

    rng, pick = np.random.default_rng(3), random.Random(3)
    e, t = 0.5 * rng.normal(size=(T.CLASSES, 2)), 0.5 * rng.normal(size=(2, 2))
    sequences = []
    for _ in range(8):
        k = pick.randint(0, 4)
        sequences.append(([pick.randint(0, 2) for _ in range(k + 1)], [pick.randrange(1, T.CLASSES) for _ in range(k)], [pick.randint(0, 1) for _ in range(k)]))

    def brute(e, t):
        total = 0.0
        for gaps, kinds, tags in sequences:
            if kinds:
                seq = [k for g, k in zip(gaps, kinds) for k in [0] * g + [k]] + [0] * gaps[-1]
                true = [y for g, y in zip(gaps, tags) for y in [0] * g + [y]] + [0] * gaps[-1]
                score = lambda path: sum(e[k, y] for k, y in zip(seq, path)) + sum(t[a, b] for a, b in zip((0, *path), path))
                total += score(true) - np.logaddexp.reduce([score(p) for p in itertools.product((0, 1), repeat=len(seq))])
        return total

    value, de, dt = T.Sequences(sequences).likelihood(e, t)
    assert np.isclose(value, brute(e, t))
    h = 1e-6
    for x, d in ((e, de), (t, dt)):
        for at in [(0, 0), (0, 1), (1, 0), (1, 1)] + ([(sequences[-1][1][0], 1)] if x is e and sequences[-1][1] else []):
            x[at] += h
            up = brute(e, t)
            x[at] -= 2 * h
            down = brute(e, t)
            x[at] += h
            assert np.isclose(d[at], (up - down) / (2 * h), atol=1e-4)


def test_fit_raises_the_likelihood():
    pick, sequences = random.Random(7), []
    for i in range(200):
        kinds = [pick.choice((1, 8, 24, 40)) for _ in range(pick.randint(1, 30))]
        sequences.append(([pick.randint(0, 40) for _ in range(len(kinds) + 1)], kinds, [int(i % 3 == 0 and k >= 24 and pick.random() < 0.9) for k in kinds]))
    told: list[float] = []
    T._fit_chain(sequences, told=told)
    assert len(told) > 5 and all(a < b for a, b in zip(told, told[1:])) and told[-1] > 0.5 * told[0]


def test_columns_of_the_same_names_stay(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"toxicity": F.lit("mine"), "toxic_spans": F.lit(7)})
    left = T.keep_clean(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert left.columns == d.columns and left.select("toxicity", "toxic_spans").distinct().collect() == [("mine", 7)]
    assert sorted(r["doc_id"] for r in left.collect()) == [i for i in range(200) if i % 5]
