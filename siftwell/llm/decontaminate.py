"""Benchmark decontamination by a generalised suffix automaton over the words of the test items.

The automaton of all items is built once on the driver, from a benchmark whose size is checked; a larger one is cut into
blocks of items, each with an automaton of its own, and a document's hits are merged over the blocks. Documents stream through it word by word
in one pass without a shuffle: the state is the longest run of words, ending here, that occurs in some item. A run of at
least `window` words ends a window of every item below that state; items shorter than the window are matched as wholes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.scratch import Scratch, small_batches

WINDOW = 10
#: Words of items in one automaton; about 400 bytes each in memory.
BLOCK_WORDS = 200_000
#: Text is read in pieces of about this many bytes, ending after a whole word.
PIECE = 1 << 20

#: A-Z are lower-cased; every other ASCII character but 0-9 and a-z separates words.
_CLEAN = bytes(
    i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_CLEAN).split() if text else []


def _pieces(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, some at a time, so that memory does not follow the longest text."""
    if not text:
        return
    clean, at = text.translate(_CLEAN), 0
    while at < len(clean):
        end = clean.find(b" ", at + PIECE)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


class Automaton:
    """Suffix automaton of several word sequences, with what each state needs to name items.

    link, length, step: as usual. items: the items that hold the state's longest run, for states of window length and
    more only where asked. whole: (item, words) of short items that are a suffix of the state's runs.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = [name for name, _ in items]
        ends: list[tuple[int, int]] = []
        shorts: dict[int, list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._add(last, w)
                ends.append((last, k))
        for k, (_, words) in enumerate(items):
            if 0 < len(words) < window:
                shorts.setdefault(self._walk(words), []).append((k, len(words)))
        self._finish(ends, shorts)

    def _walk(self, words: list[bytes]) -> int:
        state = 0
        for w in words:
            state = self.step[state][w]
        return state

    def _new(self, length: int) -> int:
        self.step.append({})
        self.link.append(-1)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        clone = self._new(self.length[p] + 1)
        self.step[clone] = dict(self.step[q])
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, w: bytes) -> int:
        if w in self.step[last]:  # this run is known from an earlier item
            q = self.step[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        now = self._new(self.length[last] + 1)
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = now
            p = self.link[p]
        if p < 0:
            self.link[now] = 0
        else:
            q = self.step[p][w]
            self.link[now] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return now

    def _finish(self, ends: list[tuple[int, int]], shorts: dict[int, list[tuple[int, int]]]) -> None:
        n = len(self.length)
        own: list[set[int]] = [set() for _ in range(n)]
        for state, k in ends:
            while state > 0 and k not in own[state] and self.length[state] >= self.window:
                own[state].add(k)
                state = self.link[state]
        self.items = [frozenset(x) if x else None for x in own]
        # A short item is a suffix of its own state's runs, where they are long enough, and of all that extend them.
        self.whole: list[tuple[tuple[int, int], ...]] = [()] * n
        for state in sorted(range(1, n), key=self.length.__getitem__):
            self.whole[state] = tuple(shorts.get(state, ())) + self.whole[self.link[state]]

    def scan(self, pieces: Iterator[list[bytes]]) -> tuple[int, list[tuple[int, int]], set[int], int]:
        """Number of words, hit spans of word positions [start, end), item numbers, longest matching run."""
        step, link, length, items, whole, window = self.step, self.link, self.length, self.items, self.whole, self.window
        state = run = at = longest = 0
        spans: list[tuple[int, int]] = []
        found: set[int] = set()

        def hit(start: int, end: int) -> None:
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, end))

        root = step[0]
        for words in pieces:
            for w in words:
                at += 1
                nxt = step[state].get(w)
                if nxt is None:
                    if not state:
                        continue
                    if w not in root:
                        state = run = 0
                        continue
                    while state and w not in step[state]:
                        state = link[state]
                    run = length[state] + 1
                    state = step[state][w]
                else:
                    run += 1
                    state = nxt
                if run > longest:
                    longest = run
                if whole[state]:
                    for k, m in whole[state]:
                        if m <= run:
                            hit(at - m, at)
                            found.add(k)
                if run >= window:
                    hit(at - window, at)
                    s = state  # the state whose runs include the last `window` words
                    while length[link[s]] >= window:
                        s = link[s]
                    if items[s]:
                        found |= items[s]
        return at, spans, found, longest


def _items(benchmark: DataFrame) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items (id as text, words) in blocks of bounded size. Repeated and null ids stay apart rows of one name."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item"), "text").orderBy("item", "text").toLocalIterator():
        words = words_of(row["text"].encode("utf-8", "surrogatepass") if row["text"] else None)
        if words:
            block.append((row["item"] if row["item"] is not None else "", words))
            size += len(words)
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


SCAN = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>, longest bigint"


def _scan(documents: DataFrame, automaton: Automaton) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(automaton)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value
        for batch in batches:
            out = []
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for key, text in zip(part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    n, spans, found, longest = auto.scan(_pieces(text))
                    out.append((key, n, spans, sorted(auto.names[k] for k in found), longest))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            spans = [[{"start": a, "end": b} for a, b in x] for x in columns[2]]
            yield pa.record_batch(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(spans, span), pa.array(columns[3], pa.list_(pa.string())), pa.array(columns[4], pa.int64())],
                ["doc_id", "row", "n_words", "spans", "items", "longest"],
            )

    return documents.select("doc_id", "row", "text").mapInArrow(scan, f"doc_id {kind}, row bigint, {SCAN}")


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each row of documents as (doc_id, n_words, spans, items, longest).

    spans: merged runs of word positions that lie in some occurrence of a window; items: ids, as text, of the items with
    such a window, distinct and sorted; longest: the longest run of words shared with an item. Null, empty and wordless texts: no words,
    no spans. Items without words match nothing; items of fewer than `window` words match as wholes. Items of one id and
    several texts count once. Repeated documents each get their row. No items: no spans. Other columns are not read.
    """
    small_batches(documents.sparkSession)
    parts = []
    docs = documents.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    blocks = list(_items(benchmark)) if benchmark.agg(F.sum(F.length("text"))).first()[0] else []
    blocks = blocks or [[]]
    if len(blocks) > 1:  # a row is known by its place: that must be the same in each scan
        docs = Scratch(documents.sparkSession).keep(docs, "documents")
    for block in blocks:
        parts.append(_scan(docs, Automaton(block, window)))
    if len(parts) == 1:
        return parts[0].withColumn("items", F.array_distinct("items")).drop("row")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("longest").alias("longest"),
    )
    return merged.withColumn("spans", _merged(F.array_sort("spans"))).drop("row")


def _merged(spans):
    """Sorted spans with those that touch or overlap made one."""
    last = lambda acc: F.element_at(acc, -1)

    def add(acc, x):
        joined = F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end"))),
        )
        fresh = F.concat(acc, F.array(x))
        return F.when(F.size(acc) == 0, F.array(x)).when(last(acc)["end"] >= x["start"], joined).otherwise(fresh)

    return F.aggregate(spans, F.slice(spans, 1, 0), add)


def n_hit():
    """Words in the spans."""
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans, nor what separates the words inside one span."""
    import re

    words = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : words[start][0]])
        at = words[end - 1][1]
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans sorted, with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_run: int = 0, max_share: float = 0.5) -> DataFrame:
    """documents with the hit spans cut out of their texts; n_chars, where there is such a column, follows.

    A document whose longest run shared with an item is above max_run words loses its spans; one whose share of hit words
    is above max_share is dropped whole. Clean documents, null and empty texts stay untouched. Repeated rows each stay.
    """
    small_batches(documents.sparkSession)
    names = documents.columns
    blocks = list(_items(benchmark)) if benchmark.agg(F.sum(F.length("text"))).first()[0] else []
    # Every block scans the original text and hands its hits on beside it; the last one cuts and judges, once a document.
    state = T.StructType.fromDDL("_spans array<struct<start:bigint,end:bigint>>, _longest bigint")
    carried = T.StructType([*documents.schema.fields, *state.fields])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    shown = documents
    for at, block in enumerate(blocks):
        auto = documents.sparkSession.sparkContext.broadcast(Automaton(block, window))
        last = at == len(blocks) - 1

        def cut(batches, auto=auto, first=at == 0, last=last):
            for batch in batches:
                texts = batch.column("text").to_pylist()
                known = [[]] * len(texts) if first else [[(x["start"], x["end"]) for x in xs] for xs in batch.column("_spans").to_pylist()]
                longest = [0] * len(texts) if first else batch.column("_longest").to_pylist()
                keep = []
                for i, text in enumerate(texts):
                    n, spans, _, run = auto.value.scan(_pieces(text.encode("utf-8", "surrogatepass") if text else None))
                    known[i], longest[i] = joined([*known[i], *spans]), max(longest[i], run)
                    hits = sum(b - a for a, b in known[i])
                    keep.append(not last or not hits or longest[i] <= max_run or hits <= max_share * n)
                    if last and hits and longest[i] > max_run:
                        texts[i] = remove_spans(text, known[i])
                columns = {f.name: batch.column(f.name) for f in batch.schema if f.name not in state.names}
                columns["text"] = pa.array(texts, batch.schema.field("text").type)
                if not last:
                    columns["_spans"] = pa.array([[{"start": a, "end": b} for a, b in xs] for xs in known], span)
                    columns["_longest"] = pa.array(longest, pa.int64())
                yield pa.record_batch(list(columns.values()), list(columns)).filter(pa.array(keep, pa.bool_()))

        shown = shown.mapInArrow(cut, documents.schema if last else carried)
    if "n_chars" in names:
        shown = shown.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return shown.select(names)
