"""Segmentation of texts: boundary-aware chunks, semantic breakpoints, and the similarity of two segmentations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import vectors as V

#: Boundaries from the best to the worst: paragraphs, lines, sentences, words; then any character.
_LEVELS = tuple(re.compile(p) for p in (r"(?<=\n)\n+", r"(?<=\n)", r"(?<=[.?!])\s+", r"\s+"))


def split_text(text: str, capacity: int = 1500, overlap: int = 150, trim: bool = True) -> list[str]:
    """Chunks of at most `capacity` characters that end at the best boundary there is; each begins up to `overlap` characters before
    the end of the one before, at a boundary. Blank chunks and NUL characters are dropped."""
    if not 0 <= overlap < capacity:
        raise ValueError("the overlap must be smaller than the capacity")
    text = text.replace("\x00", "")
    out, at = [], 0
    while at < len(text):
        end = at + capacity
        if end >= len(text):
            end = len(text)
        else:
            for level in _LEVELS:
                ends = [m.end() for m in level.finditer(text, at + overlap + 1, end)]
                if ends:
                    end = ends[-1]
                    break
        out.append(text[at:end])
        if end == len(text):
            break
        start = max(at + 1, end - overlap)
        for level in _LEVELS[2:]:
            starts = [m.end() for m in level.finditer(text, start, end)]
            if starts:
                start = starts[0]
                break
        at = min(start, end) if overlap else end
    out = [c.strip() if trim else c for c in out]
    return [c for c in out if c.strip()]


def chunk(df: DataFrame, text: str = "text", capacity: int = 1500, overlap: int = 150) -> DataFrame:
    """One row a chunk: the other columns, chunk_no and the text."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split_text(t, capacity, overlap) if t else [])

    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(run(F.col(text))).alias("chunk_no", text))


def breakpoints(vectors: DataFrame, group: str, position: str, vector: str, kind: str = "percentile", amount: float = 95.0) -> DataFrame:
    """(group, position, distance, threshold, cut): cosine distance to the vector before, and whether it cuts.

    Thresholds of a group: percentile; mean plus `amount` standard deviations; mean plus `amount` interquartile ranges; gradient
    (the percentile is of the change of distances)."""
    by = Window.partitionBy(group).orderBy(position)
    own = Window.partitionBy(group)
    d = vectors.select(group, position, (1 - V.cosine(F.lag(vector).over(by), F.col(vector))).alias("distance"))
    value = F.col("distance")
    if kind == "gradient":
        before, after = F.lag("distance").over(by), F.lead("distance").over(by)
        d = d.withColumn("change", F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2).otherwise(F.coalesce(after, value) - F.coalesce(before, value)))
        value = F.col("change")
    at = lambda p: F.percentile(value, F.lit(p)).over(own)
    mean = F.avg(value).over(own)
    threshold = {
        "percentile": lambda: at(amount / 100),
        "gradient": lambda: at(amount / 100),
        "standard_deviation": lambda: mean + amount * F.stddev_pop(value).over(own),
        "interquartile": lambda: mean + amount * (at(0.75) - at(0.25)),
    }[kind]()
    return d.withColumn("threshold", threshold).withColumn("cut", F.coalesce(value > F.col("threshold"), F.lit(False))).select(group, position, "distance", "threshold", "cut")


def _moved(left: list[int], right: list[int], near: int) -> tuple[float, int]:
    """The cheapest way to turn the boundaries left into right, neither having one of the other's: (cost, moves). A boundary that comes
    or goes costs 1, one that moves by d < near places costs d / near; of equal costs, fewer moves. Boundaries that are
    near or more apart do not touch each other, so each cluster is solved by itself."""
    both = sorted([(p, 0) for p in left] + [(q, 1) for q in right])
    cost, moves, at = 0.0, 0, 0
    while at < len(both):
        end = at + 1
        while end < len(both) and both[end][0] - both[end - 1][0] < near:
            end += 1
        x, y = ([p for p, side in both[at:end] if side == s] for s in (0, 1))
        at = end
        # Moves never cross: of two crossing ones the straight pair costs no more.
        row = [(float(j), 0) for j in range(len(y) + 1)]
        for i, p in enumerate(x):
            new = [(i + 1.0, 0)]
            for j, q in enumerate(y):
                ways = [(row[j + 1][0] + 1, row[j + 1][1]), (new[j][0] + 1, new[j][1])]
                if abs(p - q) < near:
                    ways.append((row[j][0] + abs(p - q) / near, row[j][1] + 1))
                new.append(min(ways))
            row = new
        cost, moves = cost + row[-1][0], moves + row[-1][1]
    return cost, moves


def boundary_similarity(a: list[int], b: list[int], near: int = 2) -> float:
    """Boundary similarity of two segmentations, given by segment lengths: 1 less the cost of the fewest edits (see _moved) over the
    boundaries that are equal, move, come or go."""
    x, y = set(np.cumsum(a)[:-1].tolist()), set(np.cumsum(b)[:-1].tolist())
    same = x & y
    cost, moves = _moved(sorted(x - same), sorted(y - same), near)
    total = len(same) + len(x - same) + len(y - same) - moves
    return 1.0 if not total else 1.0 - cost / total


def compare(segmentations: DataFrame, near: int = 2) -> DataFrame:
    """Rows with lengths_a and lengths_b (arrays): adds boundary_similarity."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(boundary_similarity=[boundary_similarity(list(a), list(b), near) for a, b in zip(frame["lengths_a"], frame["lengths_b"], strict=True)])

    from pyspark.sql import types as T

    return segmentations.mapInPandas(run, T.StructType([*segmentations.schema.fields, T.StructField("boundary_similarity", T.DoubleType())]))
