"""Collocations: phrases whose words stand together far more often than apart, with exact counts.

1. Words are counted, and with them all words of each language.
2. A count-min sketch of all phrases: each task adds its part to saturating counters, which are summed by block. What
   is left is one bit a counter, whether its count reaches the threshold. A phrase whose every bit is set may reach it (the
   counters are upper bounds), any other cannot. The sketch has a fixed largest size; beyond it more phrases pass and
   are counted, and the result stays the same.
3. Texts shrink to runs: the longest stretches whose neighbouring words pass as pairs. Equal runs are summed, so a
   passage that thousands of documents share is looked at once.
4. The distinct runs are scanned in shards of a bounded number: the phrases of a shard that pass are its candidates and are compiled into an
   Aho-Corasick automaton, each between delimiters; its matches, overlapping ones included, are counted with the weights of
   their runs. Every occurrence lies in one run, so the counts of all shards add up to the exact ones, and the work is in proportion to the runs.
5. Thresholds, scores and the ranking are joins and windows over the counted phrases.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.scratch import Scratch
from siftwell.llm.wordhash import mix64, word_spans

#: Rows of the sketch, and the binary logarithms of the least and the largest number of counters in one. The largest sketch takes
#: 128 MB of a worker while it is built and 32 MB when broadcast, whatever the corpus.
ROWS, LEAST_BITS, MOST_BITS = 2, 16, 27
#: Counters that travel as one row.
COUNTERS = 1 << 16
#: Summed in two steps where there are more tasks than this.
FAN_IN = 64
#: Bytes of text that are hashed together, distinct rows that a task holds before it gives them out, runs of one automaton.
BLOCK, HELD, SHARD = 1 << 19, 400_000, 100_000
#: Counted phrases that a task sums over its shards before it gives them out.
COUNTED = 600_000
#: Longer runs are cut into overlapping parts; a phrase belongs to the part that its first word belongs to.
RUN_WORDS = 32

#: Stands between pieces: a delimiter, so it is no word.
BREAK = b" . "
_UPPER = bytes(range(65, 91))
_DELIMITERS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_UPPER + _DELIMITERS + b"\t", _UPPER.lower() + b"\n" * len(_DELIMITERS) + b" ")
_ROW = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
_NEXT = np.uint64(0xD6E8FEB86659FD93)


def _parts(text: str) -> Iterator[bytes]:
    data, at = text.encode().translate(_TABLE), 0
    while len(data) - at > 2 * BLOCK and (cut := data.find(b"\n", at + BLOCK)) >= 0:
        yield data[at:cut].replace(b"\n", BREAK)
        at = cut + 1
    yield data[at:].replace(b"\n", BREAK)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """The words of many texts of one language between spaces, BREAK between pieces and texts. batches: (lang, text)."""
    held: dict[str, list[bytes]] = {}
    size: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for part in _parts(text):
                held.setdefault(lang, []).append(part)
                size[lang] += len(part)
                if size[lang] >= BLOCK:
                    del size[lang]
                    yield lang, BREAK.join(held.pop(lang))
            if size.total() > 16 * BLOCK or len(size) > 1000:
                yield from ((k, BREAK.join(v)) for k, v in held.items())
                held, size = {}, Counter()
    yield from ((k, BREAK.join(v)) for k, v in held.items())


class Phrases(NamedTuple):
    """Where the words of a block start and end, and for 2 to n words the hash of the phrase that starts at each word and whether there is one."""

    starts: np.ndarray
    ends: np.ndarray
    of: list[tuple[np.ndarray, np.ndarray]]


def phrases_of(lang: str, data: bytes, longest: int) -> Phrases:
    import xxhash

    words, starts, ends = word_spans(data)
    own = words != word_spans(BREAK.strip())[0][0]
    words = words ^ np.uint64(xxhash.xxh64_intdigest(lang.encode()))
    value, there, out = words, own, []
    for k in range(1, longest):
        value = mix64(value[:-1] * _NEXT + words[k:])
        there = there[:-1] & own[k:]
        out.append((value, there))
    return Phrases(starts, ends, out)


def _places(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (values * _ROW[row] >> np.uint64(64 - bits)).astype(np.int64)


def _passing(phrases: list[tuple[np.ndarray, np.ndarray]], table: np.ndarray, bits: int) -> list[np.ndarray]:
    """For each length of phrase, where one starts that may reach the threshold: its own bits are set, and both shorter ones in it pass."""
    out: list[np.ndarray] = []
    for values, there in phrases:
        at = np.flatnonzero(there & (out[-1][:-1] & out[-1][1:]) if out else there)
        for row in range(ROWS):
            place = _places(values[at], row, bits)
            at = at[(table[row][place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)]
        passes = np.zeros(len(values), bool)
        passes[at] = True
        out.append(passes)
    return out


class Counters:
    """ROWS arrays of 2 ** bits counters that stop at least: two in a byte, if 4 bits are enough for each."""

    def __init__(self, bits: int, least: int):
        self.bits, self.least, self.packed = bits, least, least < 16
        self.data = np.zeros((ROWS, (1 << bits) >> self.packed), self.kind(least))

    @staticmethod
    def kind(least: int) -> type:
        return np.uint8 if least < 256 else np.uint32

    @staticmethod
    def most_bits(least: int) -> int:
        """As many as take the room of 2 ** MOST_BITS packed ones."""
        return MOST_BITS - (0 if least < 16 else 1 if least < 256 else 3)

    def add(self, row: int, at: np.ndarray, n: np.ndarray) -> None:
        """at: distinct places."""
        data = self.data[row]
        if not self.packed:
            data[at] = np.minimum(data[at] + n, self.least)
            return
        for shift in (0, 4):
            own = (at & 1) == shift >> 2
            place = at[own] >> 1
            old = data[place]
            new = np.minimum((old >> shift & 15) + n[own], self.least).astype(np.uint8)
            data[place] = old & (0xF0 >> shift) | new << shift

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """Numbers and contents of the blocks that count anything."""
        for block, part in enumerate(self.data.reshape(-1, min(COUNTERS, self.data.shape[1]))):
            if part.any():
                yield block, part.tobytes()

    @staticmethod
    def read(block: bytes, least: int) -> np.ndarray:
        data = np.frombuffer(block, Counters.kind(least))
        return np.stack([data & 15, data >> 4], 1).reshape(-1) if least < 16 else data

    @staticmethod
    def write(counts: np.ndarray, least: int) -> bytes:
        data = counts.astype(Counters.kind(least))
        return (data[0::2] | data[1::2] << 4 if least < 16 else data).tobytes()


def sketch(texts: DataFrame, longest: int, least: int, bits: int) -> np.ndarray:
    """ROWS arrays of 2 ** bits bits, packed: whether the phrases of that counter reach least together."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counters = Counters(bits, least)
        for lang, data in blocks(batches):
            for values, there in phrases_of(lang, data, longest).of:
                values, n = np.unique(values[there], return_counts=True)
                n = np.minimum(n, least)
                for row in range(ROWS):
                    at = _places(values, row, bits)
                    # Places that meet within a block count one after another, not at once.
                    order = np.argsort(at)
                    at, own = at[order], n[order]
                    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
                    own = np.add.reduceat(own, first) if len(at) else own
                    counters.add(row, at[first], own)
        task = TaskContext.get().partitionId()
        for block, part in counters.blocks():
            yield pa.record_batch([pa.array([block], pa.int32()), pa.array([task], pa.int32()), pa.array([part], pa.binary())], ["block", "task", "counts"])

    def total(frame: pd.DataFrame) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for part in frame["counts"]:
            out = np.minimum(out + Counters.read(part, least), least)
        return out

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": frame["block"].iloc[:1], "task": [0], "counts": [Counters.write(total(frame), least)]})

    def reached(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": frame["block"].iloc[:1], "bits": [np.packbits(total(frame) >= least, bitorder="little").tobytes()]})

    # A task's counters take the same room however few texts it reads, so tasks are few and large.
    n = texts.rdd.getNumPartitions()
    texts = texts.coalesce(max(1, min(n, max(2 * texts.sparkSession.sparkContext.defaultParallelism, n // 8))))
    parts = texts.mapInArrow(add, "block int, task int, counts binary")
    if n > FAN_IN:
        parts = parts.groupBy("block", F.pmod("task", F.lit(FAN_IN)).alias("part")).applyInPandas(summed, "block int, task int, counts binary")
    found = parts.groupBy("block").applyInPandas(reached, "block int, bits binary").toArrow()  # as many bytes as the table below
    table = np.zeros((ROWS, max(1, (1 << bits) >> 3)), np.uint8)
    flat = table.reshape(-1)
    for block, part in zip(found.column("block").to_pylist(), found.column("bits").to_pylist(), strict=True):
        flat[block * len(part) : (block + 1) * len(part)] = np.frombuffer(part, np.uint8)
    return table


def _text(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary()).cast(pa.string())


def words(texts: DataFrame) -> DataFrame:
    """(lang, phrase, f) for every single word; a task sums its own words first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for lang, data in blocks(batches):
            held.setdefault(lang, Counter()).update(data.split())
            if sum(map(len, held.values())) > HELD:
                yield from given(held)
                held = {}
        yield from given(held)

    def given(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, own in held.items():
            own.pop(BREAK.strip(), None)
            yield pa.record_batch([pa.array([lang] * len(own), pa.string()), _text(list(own)), pa.array(list(own.values()), pa.int64())], ["lang", "phrase", "f"])

    return texts.mapInArrow(count, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _cut_run(data: bytes, starts: np.ndarray, ends: np.ndarray, longest: int) -> Iterator[tuple[int, bytes]]:
    """The parts of a long run, by its words: (code points in which a phrase of this part may start, or 0 for all of them; the words)."""
    last = len(starts) - 1
    for at in range(0, last, RUN_WORDS):
        part = data[starts[at] : ends[min(at + RUN_WORDS + longest - 2, last)]]
        yield len(data[starts[at] : starts[at + RUN_WORDS]].decode()) if at + RUN_WORDS < last else 0, part


def runs(texts: DataFrame, table, longest: int, bits: int) -> DataFrame:
    """(lang, run, own, weight): what of the texts may hold a candidate, equal stretches summed; own as in _cut_run."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Counter, Counter]] = {}
        for lang, data in blocks(batches):
            data = b" ".join(data.split())
            starts, ends, of = phrases_of(lang, data, 2)
            edges = np.diff(np.concatenate(([0], _passing(of, table.value, bits)[0].astype(np.int8), [0])))
            i, j = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            short = j - i < RUN_WORDS + longest
            whole, parts = held.setdefault(lang, (Counter(), Counter()))
            whole.update(map(data.__getitem__, map(slice, starts[i[short]].tolist(), ends[j[short]].tolist())))
            for a, b in zip(i[~short].tolist(), j[~short].tolist(), strict=True):
                parts.update(_cut_run(data, starts[a : b + 1], ends[a : b + 1], longest))
            if sum(len(w) + len(p) for w, p in held.values()) > HELD:
                yield from given(held)
                held = {}
        yield from given(held)

    def given(held: dict[str, tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for lang, (whole, parts) in held.items():
            run = [*whole, *(r for _, r in parts)]
            own = [0] * len(whole) + [o for o, _ in parts]
            arrays = [pa.array([lang] * len(run), pa.string()), _text(run), pa.array(own, pa.int32()), pa.array([*whole.values(), *parts.values()], pa.int64())]
            yield pa.record_batch(arrays, ["lang", "run", "own", "weight"])

    cuts = texts.mapInArrow(cut, "lang string, run string, own int, weight bigint")
    return cuts.groupBy("lang", "run", "own").agg(F.sum("weight").alias("weight"))


def _candidates(lang: str, own: list[str], table: np.ndarray, longest: int, bits: int) -> list[str]:
    """The distinct phrases of the runs whose upper bounds pass."""
    data = BREAK.join(r.encode() for r in own)
    starts, ends, of = phrases_of(lang, data, longest)
    out: list[str] = []
    for k, ((values, _), passes) in enumerate(zip(of, _passing(of, table, bits), strict=True), 1):
        at = np.flatnonzero(passes)
        at = at[np.unique(values[at], return_index=True)[1]]
        out += [data[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at + k].tolist(), strict=True)]
    return out


def _scan(own: list[str], limits: np.ndarray, weights: np.ndarray, phrases: list[str]) -> np.ndarray:
    """Occurrences of each phrase in the runs, overlapping ones included; of a run with a limit, those that start within it."""
    import ahocorasick

    counts = np.zeros(len(phrases), np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, phrase in enumerate(phrases):  # between delimiters, so that no match starts or ends inside a word
        automaton.add_word(f" {phrase} ", k)
    automaton.make_automaton()
    if not phrases:
        return counts
    ends, found = np.array(list(automaton.iter(" \n ".join(["", *own, ""]))), np.int64).reshape(-1, 2).T  # no word holds a line end
    sizes = np.array([len(r) for r in own], np.int64) + 3
    first = 3 + np.cumsum(sizes) - sizes  # where each run starts
    run = np.searchsorted(first, ends, "right") - 1
    begin = ends - np.array([len(p) for p in phrases], np.int64)[found] - first[run]
    inside = (limits[run] == 0) | (begin < limits[run])
    np.add.at(counts, found[inside], weights[run[inside]])
    return counts


def counted(found: DataFrame, table, longest: int, bits: int) -> DataFrame:
    """(lang, phrase, f): the exact counts of the candidates in the runs."""
    shard = SHARD

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        sums: dict[str, Counter] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, shard):
                held.append(batch.slice(i, shard))
                if sum(b.num_rows for b in held) >= shard:
                    add(held, sums)
                    held = []
                    if sum(map(len, sums.values())) > COUNTED:
                        yield from given(sums)
                        sums = {}
        add(held, sums)
        yield from given(sums)

    def add(held: list[pa.RecordBatch], sums: dict[str, Counter]) -> None:
        """Counts one shard."""
        frame = pa.Table.from_batches(held).to_pandas() if held else pd.DataFrame({"lang": []})
        for lang, rows in frame.groupby("lang"):
            own = rows["run"].tolist()
            names = _candidates(lang, own, table.value, longest, bits)
            counts = _scan(own, rows["own"].to_numpy(np.int64), rows["weight"].to_numpy(np.int64), names)
            sums.setdefault(lang, Counter()).update(dict(zip(names, counts.tolist(), strict=True)))

    def given(sums: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, own in sums.items():
            yield pa.record_batch([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["lang", "phrase", "f"])

    return found.mapInArrow(scan, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _sub_phrases(k: Column, least: Column | int, most: Column) -> Column:
    """Places and lengths of the contiguous parts of k words that have least to most words."""
    lengths = F.sequence(F.lit(least) if isinstance(least, int) else least, most)
    return F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), k - n + 1), lambda i: F.struct(i.alias("i"), n.alias("n")))))


def scored(phrases: DataFrame, single: DataFrame, cover_percent: int) -> DataFrame:
    """Candidates that no longer one covers, with a, l, r and score of their lowest-scoring cut. phrases, single: (lang, phrase, f), all
    of which reach the threshold (so does every part of a phrase)."""
    split = phrases.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w")).withColumn("k", F.size("w"))
    known = single.unionByName(phrases)
    joined = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cut = split.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cut = cut.select("lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("left"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    # Counts below 10 ** 14 keep both products within 38 digits.
    wide = lambda name: F.col(name).cast("decimal(14,0)")
    cut = cut.withColumns({"top": wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)"), "under": wide("l") * wide("r")})
    lowest = F.min(F.struct(F.expr("top div under").alias("score"), "cut", "l", "r")).alias("x")
    best = cut.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    longer = split.filter("k > 2").withColumn("at", F.explode(_sub_phrases(F.col("k"), 2, F.col("k") - 1)))
    longer = longer.select("lang", joined(F.col("at.i"), F.col("at.n")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    covered = F.coalesce(100 * F.col("cover") >= cover_percent * F.col("a"), F.lit(False))
    return best.join(longer, ["lang", "phrase"], "left").filter(~covered).drop("cover")


def collocations(
    documents: DataFrame, longest: int = 3, least: int = 10, cover_percent: int = 50, top: int = 2000, lang: str = "lang"
) -> DataFrame:
    """Each language's best phrases of 2 to longest words: (lang, rank, phrase, a, l, r, n, score).

    A-Z are lower-cased; texts are split at . , ; : ! ? and line ends into pieces, pieces at spaces and tabs into words. a is how often
    the phrase occurs (at least `least` times), l and r how often the two sides of its worst cut do, n the words of the language, score
    floor(1000000 a a / (l r)). A phrase inside a longer candidate with at least cover_percent of its count goes. Ties in score fall by a,
    then by the phrase's bytes. A null text is empty, a null language `und`; repeated rows count each time, other columns are not read, and
    a text without a word adds nothing. No documents, or no phrase that reaches `least`: no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    texts = documents.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    single = scratch.keep(words(texts), "words")
    n_words = single.agg(F.sum("f")).first()[0] or 0
    bits = min(Counters.most_bits(least), max(LEAST_BITS, n_words.bit_length()))
    with scratch.settings():
        table = spark.sparkContext.broadcast(sketch(texts, longest, least, bits))
    # In order, so that runs that begin alike meet in one automaton: fewer patterns, and fewer counts of the same phrase from many tasks.
    found = runs(texts, table, longest, bits).repartitionByRange("lang", "run").sortWithinPartitions("lang", "run")
    found = scratch.keep(found, "runs")
    phrases = counted(found.select("lang", "run", "own", "weight"), table, longest, bits).filter(F.col("f") >= least)
    phrases = scratch.keep(phrases, "phrases", batch=10_000)
    scratch.drop(found)
    best = scored(phrases, single.filter(F.col("f") >= least), cover_percent)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = best.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    total = single.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
