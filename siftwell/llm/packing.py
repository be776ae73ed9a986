"""Packing of tokenised documents into fixed-length sequences by a grouping genetic algorithm.

1. Each text is tokenised once, in a pass without a shuffle, and leaves pieces: only a document longer than a sequence is cut.
   Pieces of full length are sequences of their own.
2. The other pieces are dealt to cells of a bounded number of items by a hash of the piece. Each cell is evolved by several
   islands, each a task: individuals are groupings of the cell's items; crossover injects whole well-filled bins of one parent
   into the other, removes the bins that now hold duplicates, and best-fits the displaced documents.
3. After each epoch the elite of an island migrates to its neighbours in the same cell; the best grouping of the last
   epoch is the answer. What stands in bins with room left is packed again with that of other cells, as long as it saves bins.
"""

from __future__ import annotations

import bisect
import contextlib
import functools
import json
import math
import os
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.scratch import Scratch, small_batches

CAPACITY = 2048
END_ID = 0
#: Items of a cell on average, islands of a cell, epochs, and crossovers of an island in one epoch.
CELL, ISLANDS, EPOCHS, CROSSOVERS = 4096, 3, 2, 48
POPULATION = 8
#: Islands that a task evolves one after another; one takes well under a second.
PER_TASK = 6
#: Pairs of items are exchanged in bins of up to so many.
PAIRED = 24
#: Times that bins with room left are packed again, with those of other cells.
AGAIN = 3


def _byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes by id, of a tokenizer file that holds a plain byte-level BPE whose ids follow its merges; else None."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    plain = plain and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
    if not plain:
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    letter = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    vocab = model["vocab"]
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [vocab.get(m, -1) for m in merged]
    if ids != list(range(256, 256 + len(ids))) or len(vocab) < 256 + len(ids):
        return None
    extra = {t["content"] for t in spec.get("added_tokens", ())}
    return {bytes(letter[c] for c in t): i for t, i in vocab.items() if t not in extra}


class Encoder:
    """Encodes texts as 32-bit ids of the tokenizer file, without special tokens around them.

    A plain byte-level BPE is encoded from the file's own vocabulary by a leaner encoder that gives the same ids (a test
    compares both for every character); texts that hold one of the file's added tokens, texts that the leaner one gives up (it backtracks
    over runs of white space, which may be too long for it), and all other tokenizers, are encoded by the file's library.
    Nothing is remembered between texts, so memory does not follow their number."""

    #: How byte-level pre-tokenisation splits a text; a fixed value of the format.
    SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        with open(path, encoding="utf-8") as f:
            ranks = _byte_ranks(json.load(f))
        self.fast = tiktoken.Encoding("file", pat_str=self.SPLIT, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(t in text for t in self.added):
            with contextlib.suppress(ValueError):
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of full length but perhaps the first."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Each document's pieces: (doc_id, piece, start, length, ids_crc32), and their token ids if with_ids."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    small_batches(documents.sparkSession)
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    end = np.array([end_id], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                rows: list[tuple] = []
                at: list[int] = []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    ids = np.append(encoder.encode(text), end) if text else end
                    for p, (start, length) in enumerate(cuts(len(ids), capacity)):
                        part = ids[start : start + length]
                        at.append(k)
                        rows.append((p, start, length, zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                arrays = [batch.column(0).take(pa.array(at, pa.int64()))] + [pa.array(c, f[1]) for c, f in zip(columns, fields, strict=False)]
                names = ["doc_id"] + [f[0] for f in fields]
                if with_ids:
                    arrays.append(pa.array(columns[4], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.record_batch(arrays, names)

    ids = ", ids array<int>" if with_ids else ""
    return documents.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint{ids}"
    )


class Bins:
    """A grouping: lists of item numbers, and the room left in each."""

    __slots__ = ("groups", "room")

    def __init__(self, groups: list[list[int]], room: list[int]):
        self.groups, self.room = groups, room


def best_fit(items: list[int], sizes: list[int], bins: Bins, capacity: int) -> Bins:
    """Adds the items, largest first, each to the bin that it leaves with the least room, else to a new one.

    The rooms in use are the bits of one integer, so the tightest room is found by a shift."""
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(bins.room):
        if r:
            by_room.setdefault(r, []).append(b)
            mask |= 1 << r
    groups, room = bins.groups, bins.room
    for i in sorted(items, key=sizes.__getitem__, reverse=True):
        need = sizes[i]
        fitting = mask >> need
        if fitting:
            r = need + (fitting & -fitting).bit_length() - 1
            own = by_room[r]
            b = own.pop()
            if not own:
                mask ^= 1 << r
            groups[b].append(i)
        else:
            b, r = len(groups), capacity
            groups.append([i])
            room.append(capacity)
        room[b] = r - need
        if r - need:
            own = by_room.setdefault(r - need, [])
            if not own:
                mask |= 1 << (r - need)
            own.append(b)
    return bins


def fitness(bins: Bins, capacity: int) -> tuple[int, int]:
    """Fewer bins first; of as many, those whose fills differ most, for one emptier bin is easier to empty."""
    return -len(bins.groups), sum((capacity - r) ** 2 for r in bins.room)


def exchange(bins: Bins, loose: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Swaps one or two items of a bin for a loose one that fills it better, while there are such; returns the loose items then. What comes out is
    smaller than what went in, so it is easier to place."""
    free = sorted((sizes[i], i) for i in loose)
    for b, group in enumerate(bins.groups):
        while (room := bins.room[b]) and free:
            best = None
            singles = [(sizes[i], (i,)) for i in group]
            pairs = [(sizes[i] + sizes[j], (i, j)) for k, i in enumerate(group) for j in group[:k]] if len(group) <= PAIRED else []
            for size, out in singles + pairs:
                at = bisect.bisect_right(free, (size + room, math.inf)) - 1
                if at >= 0 and (gain := free[at][0] - size) > 0 and (best is None or gain > best[0]):
                    best = gain, at, out
                    if gain == room:
                        break
            if best is None:
                break
            gain, at, out = best
            group[:] = [i for i in group if i not in out] + [free.pop(at)[1]]
            bins.room[b] = room - gain
            for i in out:
                bisect.insort(free, (sizes[i], i))
    return [i for _, i in free]


def crossover(receiver: Bins, giver: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """A child: well-filled bins of giver, those of receiver that share no item with them, and the displaced best-fitted, after they
    have been exchanged for smaller ones. The worst-filled bins of receiver and a few others are opened as well."""
    order = sorted(range(len(giver.groups)), key=lambda b: (giver.room[b], rng.random()))
    take = order[: max(1, int(len(order) * rng.uniform(0.1, 0.6)))]
    groups = [list(giver.groups[b]) for b in take]
    room = [giver.room[b] for b in take]
    injected = {i for g in groups for i in g}
    displaced = []
    kept = []
    for g, r in zip(receiver.groups, receiver.room, strict=True):
        if injected.isdisjoint(g):
            kept.append((g, r))
        else:
            displaced += [i for i in g if i not in injected]
    kept.sort(key=lambda x: (x[1], rng.random()))
    spare = max(1, len(kept) // 20)
    also = {rng.randrange(len(kept)) for _ in range(spare)} if kept else set()
    for k, (g, r) in enumerate(kept):
        if k >= len(kept) - spare or k in also:
            displaced += g
        else:
            groups.append(list(g))
            room.append(r)
    child = Bins(groups, room)
    return best_fit(exchange(child, displaced, sizes, capacity), sizes, child, capacity)


def _start(sizes: list[int], capacity: int, rng: random.Random, share: float) -> Bins:
    """Best fit decreasing, after a share of the items has been dealt in random order."""
    order = list(range(len(sizes)))
    rng.shuffle(order)
    k = int(len(order) * share)
    first = Bins([], [])
    for i in range(0, k, 64):
        best_fit(order[i : min(k, i + 64)], sizes, first, capacity)
    return best_fit(order[k:], sizes, first, capacity)


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[Bins], crossovers: int = CROSSOVERS, population: int = POPULATION) -> Bins:
    """The best grouping that one island finds, starting from the elites that came to it."""
    rng = random.Random(seed)
    least = -(-sum(sizes) // capacity)
    alive = elites[:population]
    if not alive or seed % ISLANDS == 0:
        alive.append(_start(sizes, capacity, rng, 0.0))
    while len(alive) < population and len(alive[0].groups) > least:
        alive.append(_start(sizes, capacity, rng, rng.uniform(0.02, 0.3)))
    ranked = sorted(((fitness(x, capacity), k, x) for k, x in enumerate(alive)), reverse=True, key=lambda t: t[:2])
    for n in range(crossovers):
        if -ranked[0][0][0] <= least:
            break
        a, b = rng.sample(range(len(ranked)), 2) if len(ranked) > 1 else (0, 0)
        child = crossover(ranked[max(a, b)][2], ranked[min(a, b)][2], sizes, capacity, rng)
        value = fitness(child, capacity)
        if any(value == known for known, _, _ in ranked):  # one that is as good stands for it: else the population would soon be copies
            continue
        ranked.append((value, population + n, child))
        ranked.sort(reverse=True, key=lambda t: t[:2])
        ranked = ranked[:population]
    return ranked[0][2]


def _encode(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for b, g in enumerate(bins.groups):
        for i in g:
            out[i] = b
    return out


def _decode(labels, sizes: list[int], capacity: int) -> Bins:
    groups: list[list[int]] = [[] for _ in range(max(labels) + 1)]
    for i, b in enumerate(labels):
        groups[b].append(i)
    return Bins(groups, [capacity - sum(sizes[i] for i in g) for g in groups])


def _assign(items: DataFrame, capacity: int, cells: int, scratch: Scratch, turn: int = 0) -> DataFrame:
    """items (uid, length) with (cell, bin), by the genetic algorithm."""
    dealt = items.withColumn("cell", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(cells)).cast("int"))
    cell = dealt.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("x"))
    cell = scratch.keep(cell.select("cell", F.col("x.uid").alias("uids"), F.col("x.length").alias("sizes")), "cells")
    state = cell.select("cell", "sizes", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")).withColumn(
        "elites", F.array().cast("array<array<int>>")
    )
    for epoch in range(EPOCHS):

        def island(frames: Iterator[pd.DataFrame], epoch=epoch) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples(index=False):
                    sizes = row.sizes.tolist()
                    elites = [_decode(e.tolist(), sizes, capacity) for e in row.elites]
                    best = evolve(sizes, capacity, (row.cell * 31 + epoch) * ISLANDS + row.island, elites)
                    yield pd.DataFrame({"cell": [row.cell], "island": [row.island], "n_bins": [len(best.groups)], "best": [_encode(best, len(sizes))]})

        tasks = max(1, min(cells * ISLANDS // PER_TASK, 4096))
        grown = state.repartition(tasks, "cell", "island").mapInPandas(island, "cell int, island int, n_bins int, best array<int>")
        grown = scratch.keep(grown, "islands")
        if epoch + 1 < EPOCHS:  # the elite goes to the next island of the ring and stays in its own
            move = grown.select("cell", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))).alias("island"), "best")
            state = move.groupBy("cell", "island").agg(F.collect_list("best").alias("elites")).join(cell.select("cell", "sizes"), "cell")
    best = grown.groupBy("cell").agg(F.min_by("best", F.struct("n_bins", "island")).alias("best"))
    found = cell.join(best, "cell").select("cell", F.explode(F.arrays_zip("uids", "sizes", "best")).alias("x"))
    return found.select(F.col("x.uids").alias("uid"), F.col("x.sizes").alias("length"), "cell", F.col("x.best").alias("bin"))


def _packed(items: DataFrame, n: int, capacity: int, scratch: Scratch) -> DataFrame:
    """items (uid, length; n rows) with (cell, bin): cells evolved apart, then what is in bins with room left once more, in fewer cells, as long
    as that saves bins."""
    done, base, bins = None, 0, None
    for turn in range(AGAIN + 1):
        cells = -(-n // CELL)
        found = _assign(items, capacity, cells, scratch, turn)
        found = scratch.keep(found.withColumn("cell", F.col("cell") + base), "placed")
        base += cells
        fill = scratch.keep(found.groupBy("cell", "bin").agg(F.sum("length").alias("fill")), "fill")
        if bins is not None and fill.count() >= bins:
            return done.unionByName(before)  # as they were
        poor = fill.filter(F.col("fill") < capacity).select("cell", "bin")
        if cells == 1 or turn == AGAIN:
            break
        before = found.join(poor, ["cell", "bin"], "left_semi").select("uid", "length", "cell", "bin")
        full = found.join(poor, ["cell", "bin"], "left_anti").select("uid", "length", "cell", "bin")
        done = full if done is None else done.unionByName(full)
        bins = poor.count()
        items = scratch.keep(before.select("uid", "length"), "leftover")
        n = items.count()
        if not n:
            return done
    found = found.select("uid", "length", "cell", "bin")
    return found if done is None else done.unionByName(found)


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of every document: (doc_id, piece, start, length, ids_crc32, sequence_id, offset), and ids if with_ids.

    A null text counts as empty and leaves the end id only; very long texts are cut, all others stay whole. Repeated rows
    are each packed. Pieces of one length are interchangeable: ties fall by the row's number. Other columns are not read.
    No documents: no rows. Sequences hold at most `capacity` ids, offsets have no gaps.
    """
    scratch = Scratch(documents.sparkSession)
    cut = pieces(documents, tokenizer, capacity, end_id, with_ids).withColumn("uid", F.monotonically_increasing_id())
    cut = scratch.keep(cut, "pieces")
    part = cut.filter(F.col("length") < capacity).select("uid", "length")
    n = part.count()
    full = cut.filter(F.col("length") == capacity).withColumns(
        {"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("bigint")}
    )
    if not n:
        return full.drop("uid")
    placed = _packed(part, n, capacity, scratch)
    before = Window.partitionBy("cell", "bin").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)  # <= capacity rows
    offsets = placed.select(
        "uid",
        (F.col("cell").cast("bigint") * (1 << 32) + F.col("bin")).alias("sequence_id"),
        F.coalesce(F.sum("length").over(before), F.lit(0).cast("bigint")).alias("offset"),
    )
    offsets = scratch.keep(offsets, "offsets")
    scratch.only(cut, offsets)
    return cut.filter(F.col("length") < capacity).join(offsets, "uid").unionByName(full).drop("uid")
