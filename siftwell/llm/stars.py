"""Links between members of buckets by star-shaped candidate edges (DataFrame operations only).

Small buckets propose every pair. In a large bucket edges from a few centres to the members that are not in their component
are proposed, so pairs grow with the members, not with their square. Rounds repeat with other centres while the pairs that they
would leave are many and they find links. What is then still in two components of one bucket meets inside buckets of up to CROWD members, where
the join itself applies the bound on bitmaps, so that only pairs that may be linked become rows. Members of larger buckets, and of those that the
bitmaps tell little about, meet through the elements of the sets: two sets of the wanted similarity share an element among the first few of each in one order of all elements (prefix
filter), and the order puts first what only one component holds, then what is rare. So no pair that can be linked is left untried, members that
are alike in their bands only never become pairs, and the rounds only save work. An exact bound on bitmaps of the sets passes over pairs that cannot
be linked, before anything large is read for them. Where wider bitmaps can be had (Wide), the last pass bounds by these too, and larger buckets meet inside as well,
dealt over pairs of blocks of up to CROWD members; elements are then left to buckets that the wider ones tell little about.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.components import components
from siftwell.llm.scratch import Scratch, maybe_broadcast

#: In buckets of up to so many members every pair is tried at once.
SMALL_BUCKET = 8
#: Centres of a large bucket in each round after the first.
CENTRES = 2
#: The last pass takes over once it has at most so many pairs for each member, or from a round whose links are fewer than
#: this share of all. Both change the work, not the result.
PAIRS, PROGRESS = 64, 0.002
#: In the last pass buckets of up to so many members meet by themselves, if the bitmaps leave at most so many pairs for each member; others meet
#: through elements.
CROWD, FEW = 1024, 4
#: Wider bitmaps are made for members of buckets only that the narrow ones leave with more than so many pairs for each member: a bitmap costs about as much
#: as two or three pairs.
SINGLE = 1
#: Words to which wider bitmaps are folded at first; buckets that these leave with more than FEW pairs take them whole.
FOLDED = 32
#: Members that hold one element and that a task pairs with the others at once.
CHUNK = 512
#: Rows of elements that are joined at once in the last pass.
SLICE = 8 << 20


#: Of pairs (u, v) those that are similar enough; of nodes (node) the elements of their sets (node, size, element).
Confirm = Callable[[DataFrame], DataFrame]
Elements = Callable[[DataFrame], DataFrame]
#: Of nodes (node) wider bitmaps of those sets that need one: (node, n, wide), the set's exact size and an array of words that is as long for all.
Wide = Callable[[DataFrame], DataFrame]


def _dice(seed: int) -> Column:
    """A random order of nodes, the same in all buckets: where buckets overlap they have centres in common."""
    return F.struct(F.xxhash64("node", F.lit(seed)), F.col("node"))


def _stars(now: DataFrame, orders: list[Column]) -> DataFrame:
    """Pairs (u, v), u < v, of a bucket's centres (its last node in each of the orders) and its members outside a centre's
    component. now: members with roots."""
    last = [F.max(F.struct(o.alias("by"), F.col("node").alias("centre"), F.col("root").alias("home"))).alias(f"c{i}") for i, o in enumerate(orders)]
    bucket = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), *last).filter("low <> high")
    centres = F.array(*[F.struct(f"c{i}.centre", f"c{i}.home") for i in range(len(orders))])
    met = now.join(bucket.select("key", centres.alias("centres")), "key").select("node", "root", F.explode("centres").alias("c"))
    met = met.filter("root <> c.home").select("node", F.col("c.centre").alias("centre"))
    return met.select(F.least("node", "centre").alias("u"), F.greatest("node", "centre").alias("v"))


def _all_pairs(few: DataFrame) -> DataFrame:
    """few: members of small buckets."""
    ours, theirs = (few.select("key", F.col("node").alias(x)) for x in "uv")
    return ours.join(theirs, "key").filter("u < v").select("u", "v")


def _words(sketches: DataFrame) -> list[str]:
    return [c for c in sketches.columns if c not in ("node", "size")]


def _near(words: list[str], percent: int) -> Column:
    """False only for pairs that cannot reach percent of similarity. Of sets with S members together and d in one alone,
    100 * intersection >= percent * union means (100 + percent) * d <= (100 - percent) * S; d is at least the number of bits that differ."""
    return _bound(sum((F.bit_count(F.col(f"u_{w}").bitwiseXOR(F.col(f"v_{w}"))) for w in words), F.lit(0)), percent)


def _bound(differ: Column, percent: int) -> Column:
    return (100 + percent) * differ <= (100 - percent) * (F.col("u_size") + F.col("v_size"))


def possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that their sketches do not rule out. sketches: node, size (of its set, or more), and the words of a bitmap
    with a bit for each hash of the set."""
    words = _words(sketches)
    for x in "uv":
        pairs = pairs.join(sketches.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ["size", *words]]), x)
    return pairs.filter(_near(words, percent)).select("u", "v")


def _untried(now: DataFrame, sketches: DataFrame, percent: int, elements: Elements, wide: Wide | None, scratch: Scratch) -> DataFrame:
    """The pairs (u, v) of two components that may be linked, among the nodes of buckets that hold several components."""
    several = now.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high"))
    several = scratch.keep(several.filter("low <> high").select("key", "m"), "several")
    left = several if wide else several.filter(F.col("m") <= CROWD)
    open_to = lambda keys, n: now.join(maybe_broadcast(keys, n, 24), "key")
    n_left, most = left.agg(F.count("*"), F.max("m")).first()
    # A pair meets in the smallest key that it shares, so that it is one row however many buckets hold it.
    keys = scratch.keep(open_to(left, n_left).groupBy("node").agg(F.collect_list("key").alias("keys")), "keys")
    own, found = None, []
    for words in (0, FOLDED, None) if wide else (None,):
        known = open_to(left, n_left).join(sketches, "node").join(keys, "node")
        known = known.select("key", "m", "node", "root", "size", F.ceil(F.col("m") / CROWD).cast("int").alias("blocks"), "keys", *_words(sketches))
        if wide and words != 0:
            own = own or scratch.keep(wide(open_to(left, n_left).select("node").distinct()), "wide")
            known = known.join(own.select("node", "n", _folded(F.col("wide"), words).alias("wide")), "node", "left")
            known = known.withColumn("size", F.coalesce("n", "size")).drop("n")
        known = scratch.keep(known, "inside")
        # Counted before they are written: where the bitmaps tell little, a bucket is left to wider ones, in the end to the elements.
        met = _inside(known, percent, most or 0).groupBy("key").agg(F.count("*").alias("pairs"))
        dense = scratch.keep(left.join(met, "key").filter(F.col("pairs") > (SINGLE if words == 0 else FEW) * F.col("m")).select("key", "m"), "dense")
        n_left = dense.count()
        found.append(_inside(known.join(maybe_broadcast(dense.select("key"), n_left, 16), "key", "left_anti"), percent, most or 0).select("u", "v"))
        left = dense
        if not n_left:
            break
    bad = left.select("key") if wide else left.select("key").unionByName(several.filter(F.col("m") > CROWD).select("key"))
    n_bad = bad.count()
    if n_bad:
        found.append(_by_elements(now.join(maybe_broadcast(bad, n_bad, 16), "key", "left_semi"), sketches, percent, elements, scratch))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _folded(wide: Column, words: int | None) -> Column:
    """A bitmap of so many words, to which the longer one is folded; None: as it is."""
    if words is None:
        return wide
    of = lambda i: F.aggregate(F.sequence(i, F.size(wide) - 1, F.lit(words)), F.lit(0).cast("bigint"), lambda acc, j: acc.bitwiseOR(F.get(wide, j)))
    return F.when(wide.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(words - 1)), of))


def _inside(known: DataFrame, percent: int, most: int) -> DataFrame:
    """The pairs (key, u, v) of one bucket and two components that their sketches do not rule out. The bound is part of the join, so that the others
    are never rows. known: members of buckets, with root, sketch, wider bitmap (if any) and the number of the bucket's blocks; most: members of the largest bucket."""
    words = [c for c in known.columns if c not in ("key", "m", "node", "root", "size", "blocks", "keys", "wide")]
    others = ["keys", "wide"] if "wide" in known.columns else ["keys"]
    sides, block = {}, F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    for x, mine, other in (("u", "i", "j"), ("v", "j", "i")):
        side = known.select("key", block.alias(mine) if most > CROWD else F.lit(0).alias(mine), "blocks", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "root", "size", *words, *others)])
        met = F.sequence(F.col("i"), F.col("blocks") - 1) if x == "u" else F.sequence(F.lit(0), F.col("j"))
        sides[x] = side.withColumn(other, F.explode(met) if most > CROWD else F.lit(0)).drop("blocks")
    once = (F.col("i") < F.col("j")) | (F.col("u_node") < F.col("v_node"))
    near = _near(words, percent) & (F.array_min(F.array_intersect("u_keys", "v_keys")) == F.col("key"))
    if "wide" in others:
        differ = F.aggregate(F.zip_with("u_wide", "v_wide", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, x: n + x)
        near = near & F.coalesce(_bound(differ, percent), F.lit(True))
    pairs = sides["u"].join(sides["v"], ["key", "i", "j"]).filter(once & (F.col("u_root") != F.col("v_root")) & near)
    return pairs.select("key", F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v"))


def _by_elements(now: DataFrame, sketches: DataFrame, percent: int, elements: Elements, scratch: Scratch) -> DataFrame:
    """The pairs (u, v) of two components that may be linked, among all nodes of now.

    Of sets of x and y elements that reach the similarity, at least percent * x / 100 elements are common, so one of them is among the
    first x - that + 1 of either set, in whatever order of all elements; in the smaller set it comes earlier still, for at least
    2 * percent * x / (100 + percent) of its x elements are common. An element that many hold is dealt over chunks. Elements are joined by slices
    of about SLICE rows, whose shuffle files go before the next slice."""
    nodes = scratch.keep(now.select("node", "root").distinct(), "open")
    # Elements are never written: they are taken from the sets twice, where the sets are, and only what several components hold is counted.
    held = elements(nodes.select("node")).join(nodes.hint("shuffle_hash"), "node").select("node", "root", "size", "element")
    known = held.groupBy("element").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    known = scratch.keep(known.filter("low <> high").select("element", "n"), "known")
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("n", F.lit(0)), "element"))
    first = held.join(maybe_broadcast(known, known.count(), 16), "element", "left").withColumn("place", place)
    first = first.filter((F.col("place") <= F.col("size") - F.ceil(F.col("size") * percent / 100 - 1e-9) + 1) & F.col("n").isNotNull())
    first = scratch.keep(first.select("element", "node", "root", F.col("size").alias("own"), "place"), "prefixes")
    scratch.drop(known)
    chunks = first.groupBy("element").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.min("root").alias("low"), F.max("root").alias("high"))
    chunks = scratch.keep(chunks.filter("low <> high").select("element", "chunks"), "chunks")
    few = maybe_broadcast(chunks, chunks.count(), 12)
    slices = max(1, -(-first.count() // SLICE))
    found = []
    for i in range(slices):
        met = first.filter(F.pmod(F.xxhash64("element"), F.lit(slices)) == i).join(few, "element")
        side = lambda rows, x, chunk: rows.select("element", chunk.alias("chunk"), *[F.col(c).alias(f"{x}_{c}") for c in ("node", "root", "own", "place")])
        early = F.col("place") <= F.col("own") - F.ceil(F.col("own") * (2 * percent / (100 + percent)) - 1e-9) + 1
        ours = side(met.filter(early), "u", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        theirs = side(met, "v", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        pairs = ours.join(theirs, ["element", "chunk"]).filter("u_root <> v_root and (u_own < v_own or (u_own = v_own and u_node < v_node))")
        # Ruled out inside the join, before anything is written or made distinct: behind the first element that a pair has in common, it has at
        # most so many more of them as either set has elements.
        ahead = 1 + F.least(F.col("u_own") - F.col("u_place"), F.col("v_own") - F.col("v_place"))
        pairs = pairs.filter((100 + percent) * ahead >= percent * (F.col("u_own") + F.col("v_own")))
        pairs = pairs.select(F.least("u_node", "v_node").alias("u"), F.greatest("u_node", "v_node").alias("v")).distinct()
        found.append(scratch.keep(possible(pairs, sketches, percent), "slice"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _open(now: DataFrame) -> tuple[int, int]:
    """Members of the buckets that hold several components, and their pairs in two components."""
    parts = now.groupBy("key", "root").agg(F.count("*").alias("c"))
    whole = parts.groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c").cast("double") * F.col("c")).alias("within"), F.count("*").alias("parts"))
    row = whole.filter("parts > 1").agg(F.sum("m").alias("m"), F.sum((F.col("m").cast("double") * F.col("m") - F.col("within")) / 2).alias("pairs")).first()
    return row["m"] or 0, int(row["pairs"] or 0)


def link(bands: DataFrame, sketches: DataFrame, percent: int, prepare: Callable[[DataFrame], tuple[Confirm, Elements] | tuple[Confirm, Elements, Wide]], scratch: Scratch) -> DataFrame:
    """(node, root) for every node that a confirmed link joins to others.

    bands: (key, node), distinct. sketches: see possible(). prepare: given the nodes (column node, distinct) that may be asked for, returns the
    functions for pairs and for elements, and that for wider bitmaps where there is one.

    The first round tries all pairs of small buckets, and in large ones each node with the node that meets most others and one
    taken by chance. Later rounds take other centres in the large buckets that hold several components, and a last pass all pairs left."""
    sized = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("u"), F.max("node").alias("v")).filter("n > 1")
    sized = scratch.keep(sized, "buckets")
    more = sized.filter("n > 2").select("key", "n")
    members = scratch.keep(bands.join(maybe_broadcast(more, more.count(), 16), "key"), "members")
    crowd = members.filter(F.col("n") > SMALL_BUCKET)
    mass = crowd.groupBy("node").agg(F.sum("n").alias("mass"))
    large = scratch.keep(crowd.join(mass, "node"), "large")
    stars = _stars(large.withColumn("root", F.col("node")), [F.struct("mass", "node"), _dice(0)])
    first = sized.filter("n = 2").select("u", "v").unionByName(_all_pairs(members.filter(F.col("n") <= SMALL_BUCKET))).unionByName(stars).distinct()
    first = scratch.keep(possible(first, sketches, percent), "pairs")
    scratch.drop(sized, members)
    ends = first.select(F.col("u").alias("node")).unionByName(first.select(F.col("v").alias("node"))).unionByName(large.select("node"))
    confirm, elements, *wide = prepare(ends.distinct())
    links = scratch.keep(confirm(first), "links")
    scratch.drop(first)
    if links.isEmpty() and large.isEmpty():
        return links.select(F.col("u").alias("node"), F.col("u").alias("root"))
    roots = components(links, scratch)
    turn = 0
    while True:
        now = scratch.keep(_rooted(large, roots), "rooted")
        n_members, n_pairs = _open(now)
        if not n_pairs:
            return roots
        if n_pairs <= PAIRS * n_members:
            break
        pairs = _stars(now, [_dice(turn * CENTRES + i + 1) for i in range(CENTRES)]).distinct()
        found = scratch.keep(confirm(possible(pairs, sketches, percent)), "links")
        fresh = found.count()
        turn += 1
        if fresh:
            links = links.unionByName(found)
            roots = components(links, scratch)
        if fresh <= PROGRESS * links.count():
            scratch.drop(now)
            now = scratch.keep(_rooted(large, roots), "rooted")
            break
        scratch.drop(now)
    scratch.drop(large)
    found = scratch.keep(confirm(_untried(now, sketches, percent, elements, wide[0] if wide else None, scratch)), "links")
    return roots if found.isEmpty() else components(links.unionByName(found), scratch)


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
