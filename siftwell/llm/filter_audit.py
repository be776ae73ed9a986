"""Audit of filters that interact: what each filter does in every order in which they can be applied.

1. Every document is judged once, by Spark expressions: a mask with one bit for each filter that it fails.
2. Documents of one part and one mask are alike for every order, so they are counted: at most 2 ** filters cells a part.
3. Each part's orders are visited by plain changes: from one to the next two neighbouring filters are swapped, so only
   the two steps at the swap are computed anew, from the cells. What a filter removes is added up along the walk; summed
   over all orders that is its Shapley value times their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.scratch import Scratch

#: Maximal runs of other characters are words.
SPACE = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"


def text_failures(text: Column, min_words: int = 50, distinct_percent: int = 65, capital_percent: int = 5, signs: str = "#$%&*|") -> dict[str, Column]:
    """Conditions on a text alone, by filter: A too few words, B too few distinct ones, C too many capitals A-Z, D one of the signs."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n < min_words,
        "B": 100 * F.size(F.array_distinct(words)) < distinct_percent * n,
        "C": 100 * capitals > capital_percent * F.length(text),
        "D": F.length(F.translate(text, signs, "")) < F.length(text),
    }


def judge(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row for each document: part, mask (bit k: it fails filter k of ABCDE), good, toxic.

    E holds where a row with a smaller doc_id has the same text, in whatever part; rows without doc_id have no smaller one. A null
    text is the empty text, a null part the empty string. Rows repeated with their doc_id are each counted, and none of them is a copy of
    the other. A document with several labels is good (toxic) if one of them says so. No documents: no rows.
    """
    scratch = Scratch(documents.sparkSession)
    text = F.coalesce("text", F.lit(""))
    failed = text_failures(F.col("text"))
    bits = [F.shiftleft(F.when(failed[f], 1).otherwise(0), k) for k, f in enumerate("ABCD")]
    whole = documents.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), text.alias("text"))
    judged = whole.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("same"), sum(bits[1:], bits[0]).alias("mask"))
    judged = scratch.keep(judged, "judged")
    named, nameless = judged.filter("doc_id IS NOT NULL"), judged.filter("doc_id IS NULL")
    # Keyed by text and id together, so that a group of copies is spread by its ids.
    first = named.groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    named = named.join(first, ["same", "doc_id"], "left").withColumn("mask", F.col("mask") + copy)
    says = lambda name: F.max(F.when(F.col(name) == 1, 1).otherwise(0)).alias(name)
    told = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(says("quality"), says("toxic"))
    named = named.join(told, "doc_id", "left")
    flag = lambda name: F.coalesce(F.col(name) == 1, F.lit(False))
    named = named.select("part", "mask", flag("quality").alias("good"), flag("toxic").alias("toxic"))
    return named.unionByName(nameless.select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def cells(judged: DataFrame) -> DataFrame:
    """(part, mask) with the number of documents, of good and of toxic ones. Partial sums leave a few rows a task."""
    count = lambda c: F.sum(F.col(c).cast("bigint")).alias(c)
    return judged.groupBy("part", "mask").agg(F.count("*").alias("n"), count("good"), count("toxic"))


def swaps(n: int) -> Iterator[int]:
    """Plain changes: places i whose swap with i + 1, one after another, leads through all orders of n things."""
    if n < 2:
        return
    inner, down = swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)  # the last thing walks through the others
        step = next(inner, None)
        if step is None:
            return
        yield step + 1 if down else step
        down = not down


@dataclass(frozen=True)
class Step:
    """What one filter does after those in the set before."""

    letter: int
    kept: int
    removed: int
    redundant: int
    good_lost: int
    toxic_lost: int


class Walk:
    """All orders of the filters over one part's cells."""

    def __init__(self, n_filters: int, mask: np.ndarray, n: np.ndarray, good: np.ndarray, toxic: np.ndarray):
        self.n_filters, self.mask, self.counts = n_filters, mask, np.stack([n, good, toxic])
        self.unique = [int(n[mask == 1 << f].sum()) for f in range(n_filters)]
        self.updates = 0

    def step(self, before: int, letter: int) -> Step:
        self.updates += 1
        failing, reached = (self.mask >> letter & 1) == 1, (self.mask & before) == 0
        removed, good, toxic = (int(x) for x in self.counts[:, failing & reached].sum(axis=1))
        kept = int(self.counts[0, reached & ~failing].sum())
        return Step(letter, kept, removed, int(self.counts[0, failing & ~reached].sum()), good, toxic)

    def orders(self) -> tuple[list[list[Step]], list[int]]:
        """Each order's steps, and what each filter removes summed over all orders."""
        order = list(range(self.n_filters))
        steps, before = [], 0
        for f in order:
            steps.append(self.step(before, f))
            before |= 1 << f
        total = [0] * self.n_filters
        since = [0] * self.n_filters  # the order from which a filter's present removals count
        seen = [list(steps)]
        for i in swaps(self.n_filters):
            ahead = sum(1 << s.letter for s in steps[:i])
            first, second = steps[i + 1].letter, steps[i].letter
            for s in steps[i : i + 2]:
                total[s.letter] += s.removed * (len(seen) - since[s.letter])
                since[s.letter] = len(seen)
            steps[i : i + 2] = [self.step(ahead, first), self.step(ahead | 1 << first, second)]
            seen.append(list(steps))
        for s in steps:
            total[s.letter] += s.removed * (len(seen) - since[s.letter])
        return seen, total


def interactions(counted: DataFrame, letters: str = FILTERS) -> DataFrame:
    """For each part, order of the letters and step: what the step's filter does. counted: (part, mask, n, good, toxic).

    One group is one part's cells, at most 2 ** len(letters) rows; n! * n rows come out, so letters are few.
    """
    if math.factorial(len(letters)) > 50_000:
        raise ValueError("too many filters to visit all orders")

    def audit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        walk = Walk(len(letters), *(frame[c].to_numpy(np.int64) for c in ("mask", "n", "good", "toxic")))
        seen, total = walk.orders()
        rows = [
            (key[0], "".join(letters[s.letter] for s in steps), k + 1, s.kept, s.removed, s.redundant, walk.unique[s.letter], s.good_lost, s.toxic_lost, total[s.letter])
            for steps in seen
            for k, s in enumerate(steps)
        ]
        return pd.DataFrame(rows, columns=names)

    schema = (
        "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
        "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    return counted.groupBy("part").applyInPandas(audit, schema)
