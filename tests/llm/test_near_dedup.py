import random

from siftwell.llm.components import components
from siftwell.llm.near_dedup import classify, deduplicate
from siftwell.llm.scratch import Scratch
from siftwell.llm.wordhash import shingles, word_hashes
from tests.llm.conftest import prose


def words(text):
    return (text or "").lower().split() if (text or "").isascii() else [w for w in (text or "").split()]


def sets_of(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n):
    sets = [sets_of(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (key, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        low = min(same, default=None) if sets[i] else key
        out.append((key, len(sets[i]), low, (not sets[i]) or key == low))
    return sorted(out, key=repr)


def test_matches_brute_force_with_awkward_rows(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((tuple(r) for r in classify(docs, 4).collect()), key=repr)
    assert got == brute(rows, 4)


def test_groups_of_edited_copies(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for group in range(3):
        base = prose(100 + group, 150).split()
        for _ in range(20):
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(999)}"
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n + i, prose(500 + i, 60)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in classify(df, 5).collect()), key=repr)
    assert got == brute(rows, 5)


def test_deduplicate_keeps_columns_and_one_row_of_each_group(docs, no_docs):
    left = deduplicate(docs)
    assert left.columns == docs.columns
    ids = sorted((r["doc_id"] for r in left.collect()), key=repr)
    # 10 repeats the text of 4 but for two words, 2 and 3 that of 1, 9 that of 8
    assert ids == sorted([1, 4, 5, 6, 7, 8, None, 12, 13, 14, 15], key=repr)
    assert deduplicate(no_docs).count() == 0 and classify(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, x) for x in range(101, 130)] + [(7, 7), (129, 50)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r["node"]: r["root"] for r in components(df, Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(21)} | {x: 50 for x in [50, *range(100, 130)]}
    assert components(df.filter("u = v"), Scratch(spark)).count() == 0


def test_word_hashes_do_not_depend_on_place():
    a, b = word_hashes(b"x yy zzz"), word_hashes(b"  zzz  x yy ")
    assert a.tolist() == b[[1, 2, 0]].tolist()
    assert len(shingles(a, 5)) == 1 and len(shingles(word_hashes(b""), 5)) == 0
    long = b"ab cd " * 400_000
    assert len(set(word_hashes(long).tolist())) == 2


def test_last_pass_tries_pairs_without_a_centre(spark, monkeypatch):
    """A large bucket whose only link is between two nodes that no round took as centre."""
    from siftwell.llm import stars

    n = 60
    nodes = [(k, i) for k in ("a", "b") for i in range(n)]
    bands = spark.createDataFrame(nodes, "key string, node bigint")
    linked = spark.createDataFrame([(i, j) for i in range(0, n, 12) for j in range(i + 1, i + 2)], "u bigint, v bigint")
    sketches = spark.createDataFrame([(i, 10, 1 << (i // 12)) for i in range(n)], "node bigint, size bigint, w0 bigint")
    for chunk in (512, 7):
        monkeypatch.setattr(stars, "CHUNK", chunk)
        # Nodes 0 and 1, 2 and 3 ... have equal sets; only some of these pairs are confirmed.
        elements = lambda nodes: nodes.selectExpr("node", "10 AS size", "explode(sequence(0, 9)) AS e").selectExpr("node", "size", "node div 2 * 10 + e AS element")
        confirm = lambda pairs: pairs.join(linked, ["u", "v"], "left_semi")
        roots = stars.link(bands, sketches, 80, lambda nodes: (confirm, elements), Scratch(spark))
        assert {r["node"]: r["root"] for r in roots.collect()} == {i + j: i for i in range(0, n, 12) for j in (0, 1)}


def test_last_pass_finds_all_links_of_one_bucket(spark, monkeypatch):
    """Sets of many sizes, all in one bucket: some nearly equal, many that share half of their elements. Rounds are switched off."""
    import random

    from siftwell.llm import stars

    monkeypatch.setattr(stars, "PAIRS", 1 << 40)
    rng = random.Random(8)
    common = list(range(30))
    sets = []
    for i in range(40):
        base = set(rng.sample(common, rng.randint(5, 25))) | {1000 + 50 * i + j for j in range(rng.randint(1, 30))}
        for _ in range(rng.randint(1, 5)):
            sets.append({x for x in base if rng.random() < 0.95} | ({9000 + len(sets)} if rng.random() < 0.5 else set()))
    n = len(sets)
    exact = [(u, v) for u in range(n) for v in range(u + 1, n) if 100 * len(sets[u] & sets[v]) >= 80 * len(sets[u] | sets[v])]
    root = list(range(n))
    for _ in range(n):
        for u, v in exact:
            root[u] = root[v] = min(root[u], root[v])
    bands = spark.createDataFrame([("a", i) for i in range(n)], "key string, node bigint")
    sketches = spark.createDataFrame([(i, len(x), 0) for i, x in enumerate(sets)], "node bigint, size bigint, w0 bigint")
    held = spark.createDataFrame([(i, len(x), y) for i, x in enumerate(sets) for y in x], "node bigint, size int, element bigint")
    linked = spark.createDataFrame(exact, "u bigint, v bigint")
    tried = []

    def confirm(pairs):
        tried.append(pairs.count())
        return pairs.join(linked, ["u", "v"], "left_semi")

    for chunk in (512, 3):
        monkeypatch.setattr(stars, "CHUNK", chunk)
        roots = stars.link(bands, sketches, 80, lambda nodes: (confirm, lambda own: held.join(own, "node", "left_semi")), Scratch(spark))
        got = {r["node"]: r["root"] for r in roots.collect()}
        assert [got.get(i, i) for i in range(n)] == root
    assert tried[1] == tried[3] < n * (n - 1) / 2 / 4  # far fewer pairs than all


def test_bitmaps_rule_out_no_linked_pair():
    import numpy as np

    from siftwell.llm.near_dedup import bitmap

    rng = np.random.default_rng(2)
    for _ in range(300):
        size, cut = int(rng.integers(5, 3000)), int(rng.integers(0, 40))
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        b = np.unique(np.append(a[cut:], rng.integers(0, 1 << 63, cut).astype(np.uint64)))
        same = len(np.intersect1d(a, b))
        differ = sum(bin(int(x) & (2**64 - 1)).count("1") for x in bitmap(a) ^ bitmap(b))
        assert differ <= len(a) + len(b) - 2 * same


def test_last_pass_writes_no_elements_and_joins_by_slices(spark, monkeypatch):
    """All pairs of one bucket are left to the last pass; slices of any size give the links of brute force, and elements are never written."""
    from siftwell.llm import stars

    monkeypatch.setattr(stars, "PAIRS", 1 << 40)
    rng = random.Random(5)
    sets = {}
    for i in range(12):
        base = [rng.randrange(10**6) for _ in range(20 + 3 * i)]
        for j, edits in enumerate((0, 1, 2, 4)):
            sets[4 * i + j] = set(base[edits:]) | {rng.randrange(10**6) for _ in range(edits)}
    alike = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    want = {i: min(j for j in sets if j // 4 == i // 4) for i in sets if any(j != i and alike(sets[i], sets[j]) for j in sets)}
    held = spark.createDataFrame([(n, len(x), e) for n, x in sets.items() for e in x], "node bigint, size int, element bigint").cache()
    bands = spark.createDataFrame([(0, n) for n in sets], "key bigint, node bigint")
    sketches = spark.createDataFrame([(n, 10**6, 0) for n in sets], "node bigint, size bigint, w0 bigint")

    good = spark.createDataFrame([(u, v) for u in sets for v in sets if u < v and alike(sets[u], sets[v])], "u bigint, v bigint").cache()
    confirm = lambda pairs: pairs.join(good, ["u", "v"], "left_semi")

    for size in (64, 1 << 20):
        monkeypatch.setattr(stars, "SLICE", size)
        scratch = Scratch(spark)
        kept, keep = [], scratch.keep
        monkeypatch.setattr(scratch, "keep", lambda df, name, **how: (kept.append(name), keep(df, name, **how))[1])
        roots = stars.link(bands, sketches, 80, lambda nodes: (confirm, lambda own: held.join(own, "node", "left_semi")), scratch)
        got = {r["node"]: r["root"] for r in roots.collect()}
        assert {n: r // 4 for n, r in got.items()} == {n: r // 4 for n, r in want.items()}
        assert "elements" not in kept and (kept.count("slice") > 1) == (size == 64)


def test_last_pass_of_buckets_that_bitmaps_tell_apart_takes_no_elements(spark, monkeypatch):
    """Such buckets meet by themselves; one of more than CROWD members, or that the bitmaps tell nothing about, meets through elements."""
    from siftwell.llm import stars

    monkeypatch.setattr(stars, "PAIRS", 1 << 40)
    n = 60
    bands = spark.createDataFrame([(k, i) for k in range(2) for i in range(n)], "key bigint, node bigint")
    linked = spark.createDataFrame([(i, i + 1) for i in range(0, n, 2)], "u bigint, v bigint")
    confirm = lambda pairs: pairs.join(linked, ["u", "v"], "left_semi")
    asked = []

    def elements(nodes):
        asked.append(1)
        return nodes.selectExpr("node", "10 AS size", "explode(sequence(0, 9)) AS e").selectExpr("node", "size", "node div 2 * 10 + e AS element")

    for crowd, told, need in ((1024, True, 0), (59, True, 1), (1024, False, 1)):
        monkeypatch.setattr(stars, "CROWD", crowd)
        sketches = spark.createDataFrame([(i, 10, 1023 << (i // 2) if told else 0) for i in range(n)], "node bigint, size bigint, w0 bigint")
        asked.clear()
        roots = stars.link(bands, sketches, 80, lambda nodes: (confirm, elements), Scratch(spark))
        assert {r["node"]: r["root"] for r in roots.collect()} == {i: i // 2 * 2 for i in range(n)} and len(asked) == need


def test_last_pass_with_wider_bitmaps_takes_no_elements(spark, monkeypatch):
    """Bitmaps that tell nothing: wider ones do, in buckets of any size (dealt over blocks), and a pair that many buckets hold meets in one of them."""
    from siftwell.llm import stars

    monkeypatch.setattr(stars, "PAIRS", 1 << 40)
    n = 60
    bands = spark.createDataFrame([(k, i) for k in range(3) for i in range(n) if k < 2 or i % 3], "key bigint, node bigint")
    sketches = spark.createDataFrame([(i, 500, 0) for i in range(n)], "node bigint, size bigint, w0 bigint")
    bits = {i: [1023 if j == i // 2 else 0 for j in range(64)] if i % 5 else None for i in range(n)}  # some have none
    table = spark.createDataFrame([(i, 10, b) for i, b in bits.items() if b], "node bigint, n bigint, wide array<bigint>")
    linked = spark.createDataFrame([(i, i + 1) for i in range(0, n, 2)], "u bigint, v bigint")
    met, asked = [], []

    def confirm(pairs):
        rows = [(r["u"], r["v"]) for r in pairs.collect()]
        met.append(rows)
        return pairs.join(linked, ["u", "v"], "left_semi")

    def elements(nodes):
        asked.append(1)
        return nodes.selectExpr("node", "10 AS size", "explode(sequence(0, 9)) AS e").selectExpr("node", "size", "node div 2 * 10 + e AS element")

    wide = lambda nodes: table.join(nodes, "node", "left_semi")
    monkeypatch.setattr(stars, "FEW", 64)
    for crowd, folded in ((1024, 64), (7, 16)):
        monkeypatch.setattr(stars, "CROWD", crowd)
        monkeypatch.setattr(stars, "FOLDED", folded)
        met.clear()
        roots = stars.link(bands, sketches, 80, lambda nodes: (confirm, elements, wide), Scratch(spark))
        assert {r["node"]: r["root"] for r in roots.collect()} == {i: i // 2 * 2 for i in range(n)} and not asked
        some = lambda u, v: not (bits[u] and bits[v]) or (u // 2) % folded == (v // 2) % folded
        assert len(met[-1]) == len(set(met[-1])) and all(some(u, v) for u, v in met[-1])
    monkeypatch.setattr(stars, "FEW", 0)
    roots = stars.link(bands, sketches, 80, lambda nodes: (confirm, elements, wide), Scratch(spark))
    assert {r["node"]: r["root"] for r in roots.collect()} == {i: i // 2 * 2 for i in range(n)} and asked


def test_wider_bitmaps_are_made_only_where_narrow_ones_tell_little(spark, monkeypatch):
    from siftwell.llm import stars

    monkeypatch.setattr(stars, "PAIRS", 1 << 40)
    n = 60
    bands = spark.createDataFrame([(0, i) for i in range(n)] + [(1, n + i) for i in range(n)], "key bigint, node bigint")
    sketches = spark.createDataFrame([(i, 2, 3 << i // 2 * 2) if i < n else (i, 10, 0) for i in range(2 * n)], "node bigint, size bigint, w0 bigint")
    table = spark.createDataFrame([(i, 10, [1023 if j == i // 2 else 0 for j in range(64)]) for i in range(2 * n)], "node bigint, n bigint, wide array<bigint>")
    linked = spark.createDataFrame([(i, i + 1) for i in range(0, 2 * n, 2)], "u bigint, v bigint")
    asked = []

    def wide(nodes):
        asked.append({r["node"] for r in nodes.collect()})
        return table.join(nodes, "node", "left_semi")

    confirm = lambda pairs: pairs.join(linked, ["u", "v"], "left_semi")
    for told, need in ((n, []), (2 * n, [set(range(n, 2 * n))])):
        asked.clear()
        roots = stars.link(bands.filter(f"node < {told}"), sketches, 80, lambda nodes: (confirm, None, wide), Scratch(spark))
        assert {r["node"]: r["root"] for r in roots.collect()} == {i: i // 2 * 2 for i in range(told)} and asked == need
