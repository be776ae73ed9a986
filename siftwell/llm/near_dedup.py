"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped edges.

1. Each text becomes the set of its word shingles (64-bit hashes) in one vectorised pass. One permutation deals the set
   over the bins; the smallest value of each bin is its slot, and an empty bin borrows from a bin picked by a 2-universal
   chain of hashes (optimal densification), the same for all documents.
2. Texts with the same set form a class (128-bit fingerprint); from here on a thousand copies cost as much as one.
3. Each band of slots is a bucket key. Inside a bucket only star edges are proposed: from one centre to the members
   that are not in its component yet. The centre is the class that shares most with others, so the original of a
   group of edited copies is met first; pairs grow with the members, not their square.
4. Edges that bitmaps of the sets do not rule out are confirmed on the full sets. Later rounds (stars.link) propose new centres in
   buckets that still hold several components, and a last pass all pairs that are left.
5. Components by large-star/small-star.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.scratch import Scratch, maybe_broadcast, small_batches, spread
from siftwell.llm.stars import Confirm, Elements, link
from siftwell.llm.wordhash import mix64, shingles, word_hashes

#: Rows and bands: a pair of similarity 0.8 shares no band with a probability of (1 - 0.8^5)^25 = 0.00005.
ROWS, BANDS = 5, 25
#: 64-bit words of a set's bitmap.
WORDS = 16

_LOWER = bytes(32 if i in b"\t\n\x0b\x0c\r " else i + 32 if 65 <= i <= 90 else i for i in range(256))


class OnePermutation:
    """Slots of sets of 64-bit hashes. An empty set has none."""

    def __init__(self, rows: int = ROWS, bands: int = BANDS):
        self.rows, self.bands, self.bins = rows, bands, rows * bands
        self.edges = np.array([(i << 64) // self.bins for i in range(self.bins)], np.uint64)

    def _donor(self, attempt: int, bins: np.ndarray) -> np.ndarray:
        key = mix64(bins.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt + 1))
        return (key % np.uint64(self.bins)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """hashes: sorted and distinct."""
        at = np.searchsorted(hashes, self.edges)
        full = at < np.append(at[1:], len(hashes))
        out = np.zeros(self.bins, np.uint64)
        out[full] = hashes[at[full]]
        empty = np.flatnonzero(~full)
        attempt = 0
        while len(empty):
            donor = self._donor(attempt, empty)
            found = full[donor]
            out[empty[found]] = out[donor[found]]
            empty = empty[~found]
            attempt += 1
        return out

    def bands_of(self, hashes: np.ndarray) -> np.ndarray:
        slots = self.slots(hashes).reshape(self.bands, self.rows)
        key = np.arange(self.bands, dtype=np.uint64)
        for i in range(self.rows):
            key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + slots[:, i])
        return key.view(np.int64)


def text_shingles(text: bytes | None, n_words: int) -> np.ndarray:
    """Words are runs of anything but ASCII white space; A-Z are lower-cased."""
    return shingles(word_hashes(text.translate(_LOWER)), n_words) if text else np.empty(0, np.uint64)


def fingerprint(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[object, bytes | None]]:
    for i in range(0, batch.num_rows, 256):
        part = batch.slice(i, 256)
        yield from zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """WORDS 64-bit words with a bit for each of the hashes."""
    bits = np.zeros(64 * WORDS, np.uint8)
    bits[(mix64(hashes) % np.uint64(64 * WORDS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def signatures(documents: DataFrame, n_words: int) -> DataFrame:
    """doc_id, n_shingles, fp (fingerprint of the set), the band keys and the bitmap of each document."""
    kind = documents.schema["doc_id"].dataType
    small_batches(documents.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = OnePermutation()
        for batch in batches:
            sizes, prints, bands, bits = [], [], [], []
            for _, text in _rows(batch):
                found = text_shingles(text, n_words)
                sizes.append(len(found))
                prints.append(fingerprint(found))
                bands.append(family.bands_of(found) if len(found) else None)
                bits.append(bitmap(found) if len(found) else None)
            longs = pa.list_(pa.int64())
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, longs), pa.array(bits, longs)],
                ["doc_id", "n_shingles", "fp", "bands", "bits"],
            )

    return documents.select("doc_id", "text").mapInArrow(
        sign, f"doc_id {kind.simpleString()}, n_shingles bigint, fp binary, bands array<bigint>, bits array<bigint>"
    )


def _sets(documents: DataFrame, n_words: int) -> DataFrame:
    """fp and the full set of each document."""
    small_batches(documents.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                found = [text_shingles(t, n_words) for _, t in _rows(batch.slice(i, 256))]
                yield pa.record_batch(
                    [pa.array([fingerprint(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], ["fp", "hashes"]
                )

    return documents.select("doc_id", "text").mapInArrow(emit, "fp binary, hashes binary")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) with 100 * intersection >= percent * union."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs, keep = [], [], []
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                a, b = (part.column(k).to_pylist() for k in (2, 3))
                for x, y in zip(a, b, strict=True):
                    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    least, most = sorted((len(p), len(q)))
                    same = 0
                    if 100 * least >= percent * most:
                        same = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(100 * same >= percent * (len(p) + len(q) - same))
            keep = pa.array(keep, pa.bool_())
            us, vs = batch.column(0).filter(keep), batch.column(1).filter(keep)
            yield pa.record_batch([us, vs], ["u", "v"])

    left = sets.select(F.col("fp").alias("u"), F.col("hashes").alias("a"))
    right = sets.select(F.col("fp").alias("v"), F.col("hashes").alias("b"))
    joined = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")
    return joined.mapInArrow(confirm, "u binary, v binary")


def _elements(sets: DataFrame, n_sets: int) -> DataFrame:
    """(node, size, element) of sets (fp, hashes); n_sets: about so many."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "x"])

    own = sets.select("fp", "hashes").mapInArrow(unpack, "node binary, x array<bigint>")
    return spread(own, n_sets, "node").select("node", F.size("x").alias("size"), F.explode("x").alias("element"))


def classify(documents: DataFrame, n_words: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """Each row of documents as (doc_id, n_shingles, component_id, kept); other columns are not read.

    Linked: 100 * intersection >= percent * union of the shingle sets. component_id: the smallest doc_id of the
    component; kept: doc_id equals it. A null or empty text, or one without words, has no shingle and is linked with nothing
    (component_id is its own doc_id). Fewer than n_words words: the whole sequence is the only shingle. Repeated rows are copies of each other:
    they share a component, and a row that repeats the smallest doc_id is kept like it. A null doc_id sorts after all
    others: its component_id is that of the rest, else null, and it is then kept.
    An empty table gives no rows.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    signed = scratch.keep(signatures(documents, n_words), "signed")
    classes = signed.filter("n_shingles > 0").groupBy("fp", "n_shingles").agg(
        F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.min("doc_id").alias("doc_id")
    )
    classes = scratch.keep(classes, "classes")
    sketches = classes.select(F.col("fp").alias("node"), F.col("n_shingles").alias("size"), *[F.get("bits", F.lit(j)).alias(f"w{j}") for j in range(WORDS)])

    def prepare(nodes: DataFrame) -> tuple[Confirm, Elements]:
        chosen = scratch.keep(classes.select("fp", "doc_id").join(nodes, classes["fp"] == nodes["node"], "left_semi"), "chosen")
        n_chosen = chosen.count()
        ids = maybe_broadcast(chosen.select(F.col("doc_id").alias("chosen_id")).distinct(), n_chosen, 32)
        sets = _sets(documents.join(ids, documents["doc_id"].eqNullSafe(ids["chosen_id"]), "left_semi"), n_words)
        sets = sets.join(maybe_broadcast(chosen.select("fp"), n_chosen, 48), "fp", "left_semi").dropDuplicates(["fp"])
        sets = scratch.keep(sets, "sets")
        of = lambda nodes: _elements(sets.join(nodes.withColumnRenamed("node", "fp"), "fp", "left_semi"), n_chosen)
        return (lambda pairs: _linked(pairs, sets, percent)), of

    bands = classes.select(F.explode("bands").alias("key"), F.col("fp").alias("node"))
    roots = scratch.keep(link(bands, sketches, percent, prepare, scratch), "roots")
    scratch.only(signed, roots)

    rooted = signed.select("doc_id", "n_shingles", "fp").join(
        roots.select(F.col("node").alias("fp"), F.col("root")), "fp", "left"
    ).withColumn("root", F.coalesce("root", "fp"))
    low = rooted.filter("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("low"))
    own = F.col("n_shingles") == 0
    return (
        rooted.join(low, "root", "left")
        .withColumn("component_id", F.when(own, F.col("doc_id")).otherwise(F.col("low")))
        .select("doc_id", "n_shingles", "component_id", (own | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))
    )


def deduplicate(documents: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """documents with one row of each component: that of the smallest doc_id. All columns stay as they are.

    Rows without shingles all stay. Of rows that repeat a doc_id and its text one stays, whichever; rows of one doc_id and unequal texts
    are told apart by text only, so they both stay or both go.
    """
    scratch = Scratch(documents.sparkSession)
    verdict = classify(documents, n_words, percent, scratch)
    drop = verdict.filter("not kept").select(F.col("doc_id").alias("gone")).distinct()
    drop = scratch.keep(drop, "gone")
    left = documents.join(maybe_broadcast(drop, drop.count(), 16), documents["doc_id"].eqNullSafe(drop["gone"]), "left_anti")
    twice = scratch.keep(verdict.filter("kept and n_shingles > 0").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("twice")), "twice")
    scratch.only(drop, twice)
    if twice.isEmpty():
        return left
    repeated = left.join(twice, left["doc_id"].eqNullSafe(twice["twice"]), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, left["doc_id"].eqNullSafe(twice["twice"]), "left_anti").unionByName(repeated)
