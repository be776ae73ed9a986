"""Encoding and decoding by a word-level BPE, through a table of distinct words.

1. Texts are split at white space by Spark and the distinct words counted; each is encoded once, by the tokenizer file's library.
   That is exact for tokenizers that drop white space and never join what stands on both sides of it (checked, see `require_words`).
2. Most words of a text are among the million most frequent ones. Their hashes and ids are broadcast (their number and length are
   bounded) and they stand for themselves as numbers. All other words travel with their position to the word table
   and their ids travel back, so no frequent word is ever shuffled. No other word has the hash of a frequent one: that is checked
   against the whole table of words, and what meets is not taken as frequent.
3. Ids are put together by position: from the number of a frequent word, else from the row that came back for that position.
4. Decoding joins ids with the table of pieces, which is as long as the vocabulary and so broadcast.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from siftwell.llm.scratch import Scratch
from siftwell.llm.wordhash import all_spans

#: White space that every splitter and normaliser of words agrees on, as a pattern and as bytes that become spaces.
SPACE, _SPACES = r"[\x20\x09-\x0D]+", bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
#: Words that are broadcast, at most, and the code points of one.
FREQUENT, FREQUENT_CHARS = 1 << 20, 64
#: Ids that are decoded at once, and texts of a batch that goes back.
IDS, TEXTS = 1 << 22, 256

_CODEC = pa.Codec("zstd", compression_level=3)


def require_words(tokenizer: str) -> None:
    """An error unless encoding a text is the same as encoding its words one by one, and decoding joins pieces by spaces."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    normal, split = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = normal.get("normalizers", [normal] if normal else [])
    splits = split.get("pretokenizers", [split] if split else [])
    local = all(s["type"] in ("NFC", "NFD", "Lowercase") or s["type"] == "Replace" and s["pattern"].get("Regex") == r"\s+" for s in steps)
    first = splits[0] if splits else {}
    drops = first.get("type") in ("Whitespace", "WhitespaceSplit") or (first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert"))
    added = all(not any(c.isspace() for c in t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", ()))
    if not (local and drops and added and spec.get("decoder") is None):
        raise ValueError("the tokenizer must drop white space, join nothing across it, and have no decoder")


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def word_table(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(word, n, hash, ids) of every distinct word of texts (text)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            found = [e.ids for e in _tokenizer(tokenizer).encode_batch_fast(words, add_special_tokens=False)]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in found])))
            flat = pa.array([i for x in found for i in x], pa.int32())
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            hashes = pa.array(all_spans(" ".join(words).encode())[0].view(np.int64))
            yield pa.record_batch([batch.column(0), batch.column(1), hashes, ids], ["word", "n", "hash", "ids"])

    found = texts.select(F.explode(F.split("text", SPACE)).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    return found.mapInArrow(encode, "word string, n bigint, hash bigint, ids array<int>")


def _frequent(table: DataFrame) -> tuple[pa.Table, DataFrame]:
    """The most frequent words (hash, ids), FREQUENT of them at most, and the rest of the table (word, ids). They are cut off by
    classes of frequency, so that no more than those wanted reach the driver."""
    short = (F.length("word") <= FREQUENT_CHARS) & (F.col("hash") != 0)
    ranked = table.withColumn("class", F.when(short, F.floor(F.log2("n") * 16).cast("int")).otherwise(-1))
    least, total = 1 << 30, 0
    for row in ranked.filter("class >= 0").groupBy("class").count().orderBy(F.desc("class")).collect():  # about 1,000 classes at most
        total += row["count"]
        if total > FREQUENT:
            break
        least = row["class"]
    often, others = ranked.filter(F.col("class") >= least), ranked.filter(F.col("class") < least)
    twice = often.groupBy("hash").count().filter("count > 1").select("hash")
    clash = [r["hash"] for r in others.select("hash").join(often.select("hash"), "hash", "left_semi").union(twice).distinct().collect()]
    keep = ~F.col("hash").isin(clash) if clash else F.lit(True)
    words = often.filter(keep).select("n", "hash", "ids").toArrow().sort_by([("n", "descending"), ("hash", "ascending")])
    return words.select(["hash", "ids"]), ranked.filter((F.col("class") < least) | ~keep).select("word", "ids")


class Frequent:
    """Numbers of the frequent words, from 1 by frequency, and their ids by number; 0 is any other word."""

    def __init__(self, table: pa.Table):
        hashes = table.column("hash").to_numpy().view(np.uint64)
        self.order = np.argsort(hashes).astype(np.uint32)
        self.sorted = hashes[self.order]
        ids = table.column("ids").combine_chunks()
        lengths = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
        self.lengths = np.concatenate(([0], lengths)).astype(np.int32)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1])).astype(np.int32)
        self.flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.zeros(len(hashes), np.uint32)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at] + np.uint32(1), np.uint32(0))


class _Shared:
    """A broadcast table of frequent words and a name by which workers know it."""

    def __init__(self, spark: SparkSession, table: pa.Table):
        self.name = uuid.uuid4().hex
        self.broadcast = spark.sparkContext.broadcast(table)


_BUILT: dict = {}


def _frequent_of(shared: _Shared) -> Frequent:
    """Built once in a worker, for as long as the broadcast is the same."""
    if _BUILT.get("of") != shared.name:
        _BUILT.clear()
        _BUILT.update({"of": shared.name, "words": Frequent(shared.broadcast.value)})
    return _BUILT["words"]


def _pack(numbers: np.ndarray) -> bytes:
    """Byte by byte of all numbers: the high ones are mostly 0, since frequent words have low numbers."""
    planes = numbers.view(np.uint8).reshape(-1, 4).T
    return len(numbers).to_bytes(8, "little") + _CODEC.compress(planes.tobytes(), asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(_CODEC.decompress(data[8:], 4 * n, asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1)


def _numbered(texts: list[str], frequent: Frequent) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts between spaces, the number of each word, where it starts and ends, and before which word each text begins."""
    coded = [t.encode().translate(_SPACES) for t in texts]
    data = b" ".join(coded)
    hashes, starts, ends = all_spans(data)
    begin = np.cumsum([0] + [len(c) + 1 for c in coded])
    return data, frequent.numbers(hashes), starts, ends, np.searchsorted(starts, begin)


def _by_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, TEXTS):
            yield whole.slice(i, TEXTS)


def _rare_words(texts: DataFrame, shared: _Shared) -> DataFrame:
    """(doc_id, same, pos, word) of the words that are not frequent."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = _frequent_of(shared)
        for batch in _by_texts(batches):
            data, numbers, starts, ends, begin = _numbered(batch.column(2).to_pylist(), frequent)
            at = np.flatnonzero(numbers == 0)
            of = np.searchsorted(begin, at, "right") - 1
            words = pa.array([data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], pa.binary()).cast(pa.string())
            rows = pa.array(of)
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array((at - begin[of]).astype(np.int32)), words]
            yield pa.record_batch(columns, ["doc_id", "same", "pos", "word"])

    return texts.mapInArrow(pick, f"doc_id {kind}, same bigint, pos int, word string")


def _coded(texts: DataFrame, shared: _Shared) -> DataFrame:
    """(doc_id, same, codes): each text as the packed numbers of its words."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = _frequent_of(shared)
        for batch in _by_texts(batches):
            _, numbers, _, _, begin = _numbered(batch.column(2).to_pylist(), frequent)
            codes = pa.array([_pack(numbers[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), codes], ["doc_id", "same", "codes"])

    return texts.mapInArrow(code, f"doc_id {kind}, same bigint, codes binary")


def _assembled(coded: list[np.ndarray], rare: pa.Array, frequent: Frequent) -> pa.ListArray:
    """The ids of each text. rare: for each text the ids by position of its other words."""
    of_text = pc.fill_null(pc.list_value_length(rare), 0).to_numpy(zero_copy_only=False)
    rows = rare.flatten()
    ids = rows.field("ids")
    begin = np.concatenate(([0], np.cumsum([len(c) for c in coded]))).astype(np.int64)
    numbers = np.concatenate(coded) if coded else np.zeros(0, np.uint32)
    lengths, starts = frequent.lengths[numbers].astype(np.int64), frequent.starts[numbers].astype(np.int64)
    at = rows.field("pos").to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(begin[:-1], of_text)
    own = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    lengths[at] = own
    starts[at] = len(frequent.flat) + np.cumsum(own) - own
    flat = np.concatenate([frequent.flat, ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)])
    before = np.cumsum(lengths) - lengths
    where = np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))
    ends = np.concatenate(([0], np.cumsum(lengths)))[begin]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[where], pa.int32()))


def encode(documents: DataFrame, tokenizer: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids): the ids that the tokenizer file's library gives for each whole text, without added, cut or padded ones; if decoded,
    with text as `decode` gives it for these ids, in the same pass.

    A null text is empty; an empty text, or one of white space only, has no ids. One row comes back for each row, repeated ones and
    those without doc_id included; other columns are not read. Very long texts and words are encoded whole. No documents: no rows.
    """
    require_words(tokenizer)
    spark = documents.sparkSession
    scratch = Scratch(spark)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Rows that agree in both have the same words at the same positions, so that their ids are looked up once.
    texts = texts.select("doc_id", F.xxhash64("text").alias("same"), "text")
    kind = texts.schema["doc_id"].dataType.simpleString()
    table = scratch.keep(word_table(texts, tokenizer), "words", codec="zstd")
    often, others = _frequent(table)
    shared = _Shared(spark, often)
    rare = _rare_words(texts, shared).join(others, "word")
    rare = rare.groupBy("doc_id", "same").agg(F.collect_set(F.struct("pos", "ids")).alias("rare"))
    rare = scratch.keep(rare, "rare", codec="zstd")
    scratch.only(rare)
    coded = _coded(texts, shared)
    same = coded["doc_id"].eqNullSafe(rare["doc_id"]) & (coded["same"] == rare["same"])
    both = coded.join(rare, same, "left").select(coded["doc_id"], "codes", "rare")

    known = spark.sparkContext.broadcast(pieces(tokenizer))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = _frequent_of(shared)
        for batch in _by_texts(batches):
            ids = _assembled([_unpack(c) for c in batch.column(1).to_pylist()], batch.column(2), frequent)
            out = pa.record_batch([batch.column(0), ids], ["doc_id", "ids"])
            yield from _with_text([out], 1, known.value) if decoded else [out]

    return both.mapInArrow(assemble, f"doc_id {kind}, ids array<int>{', text string' if decoded else ''}")


def pieces(tokenizer: str) -> pa.Array:
    """The piece of each id of the vocabulary, special ones included; null where there is none."""
    vocabulary = _tokenizer(tokenizer).get_vocab(with_added_tokens=True)
    out: list[str | None] = [None] * (max(vocabulary.values()) + 1)
    for piece, k in vocabulary.items():
        out[k] = piece
    return pa.array(out, pa.string())


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """encoded (with ids array<int>) and text, as the library's decode(ids, skip_special_tokens=False) gives it: the pieces of the
    ids, joined by spaces. Ids without a piece are left out; null ids give a null text."""
    require_words(tokenizer)
    encoded = encoded.drop("text")
    known = encoded.sparkSession.sparkContext.broadcast(pieces(tokenizer))
    place = encoded.columns.index("ids")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _with_text(batches, place, known.value)

    return encoded.mapInArrow(join, StructType([*encoded.schema.fields, StructField("text", StringType())]))


def _with_text(batches, place: int, table: pa.Array) -> Iterator[pa.RecordBatch]:
    """The batches and the text of the ids in the column at place, IDS of them at a time or one row."""
    for whole in batches:
        counts = np.cumsum(pc.fill_null(pc.list_value_length(whole.column(place)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < whole.num_rows:
            done = counts[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(counts, done + IDS, "right")))
            batch = whole.slice(at, end - at)
            at = end
            ids = batch.column(place)
            lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            flat = ids.flatten()
            inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table)))
            found = table.take(pc.if_else(inside, flat, pa.scalar(None, flat.type)))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), found)
            yield pa.record_batch([*batch.columns, _joined(lists, ids)], [*batch.schema.names, "text"])


def _joined(lists: pa.ListArray, ids: pa.Array) -> pa.Array:
    """The strings of each list, joined by spaces without the nulls; null where ids is."""
    present = lists.flatten()
    if present.null_count:
        of = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        keep = present.is_valid().to_numpy(zero_copy_only=False)
        counts = np.bincount(of[keep], minlength=len(lists))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), present.filter(pa.array(keep)))
    text = pc.binary_join(lists, " ")
    return pc.if_else(ids.is_valid(), text, pa.scalar(None, pa.string()))
