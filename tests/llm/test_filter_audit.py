import itertools
import random
import re

import numpy as np

from siftwell.llm import filter_audit as A


def brute(docs, labels):
    """Every order applied to the documents themselves."""
    fails = []
    for doc_id, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x, _ in docs),
        }
        told = [(q, x) for i, q, x in labels if i is not None and i == doc_id]
        fails.append((source or "", out, any(q == 1 for q, _ in told), any(x == 1 for _, x in told)))
    rows = {}
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                before = [d for d in own if d[1][f] and any(d[1][g] for g in order[:k])]
                unique = [d for d in own if d[1][f] and sum(d[1].values()) == 1]
                shapley[f] += len(gone)
                rows[part, "".join(order), k + 1] = [len(left), len(gone), len(before), len(unique), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, k), row in rows.items():
            if p == part:
                row.append(shapley[order[k - 1]])
    return {k: tuple(v) for k, v in rows.items()}


def test_plain_changes_visit_every_order_by_single_swaps():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in A.swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert seen == set(itertools.permutations(range(n)))


def test_only_the_two_steps_of_a_swap_are_computed():
    mask = np.arange(32)
    walk = A.Walk(5, mask, mask * 0 + 3, mask * 0 + 1, mask * 0)
    seen, total = walk.orders()
    assert len(seen) == 120 and walk.updates == 5 + 119 * 2
    assert sum(total) == 120 * 31 * 3  # in every order all failing documents go


def test_matches_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(90)] + ["Big", "WORD", "é#", "a|b", "\x1f"]
    draw = lambda n, v: rng.choice([" ", "\t", "\n", "  "]).join(rng.choice(words[:v] + words[90:] * (rng.random() < 0.3)) for _ in range(n))
    docs = [(i, draw(rng.choice([3, 49, 50, 51, 70, 120]), rng.choice([20, 60, 90])), rng.choice(["x", "y", None, ""])) for i in range(120)]
    docs += [(200 + i, rng.choice(docs)[1], rng.choice(["x", "y", "z"])) for i in range(60)]
    docs += [(300, None, "x"), (301, "", "y"), (302, "   ", "y"), (None, docs[3][1], "x"), (None, None, None), (5, docs[5][1], "y"), (303, "one " * 40_000, "long")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 260, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").selectExpr("*", "source AS part", "text AS same", "1 AS first", "2 AS toxic", "3 AS mask")
    found = A.interactions(A.cells(A.judge(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found.collect()}
    assert got == brute(docs, labels) and len(got) == 600 * len({s or "" for _, _, s in docs})


def test_no_documents_and_awkward_ones(spark, docs, no_docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    audit = lambda d: A.interactions(A.cells(A.judge(d, labels, part="root")))
    assert audit(no_docs).count() == 0
    rows = audit(docs).filter("filter_order = 'ABCDE' AND step = 5").collect()
    assert len(rows) == docs.select("root").distinct().count() and all(r["good_lost"] == 0 for r in rows)
