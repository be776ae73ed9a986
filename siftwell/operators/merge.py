"""Merging of several result lists of a query, expansion of query texts, and set operations on lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as X
from siftwell.operators.search import PLACES


def numbered(*lists: DataFrame) -> DataFrame:
    """Result lists (qid, rank, ...) one below another, with list_idx from 0."""
    parts = [x.withColumn("list_idx", F.lit(i)) for i, x in enumerate(lists)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _first(df: DataFrame, order: list, k: int) -> DataFrame:
    by = Window.partitionBy("qid").orderBy(*order)
    return df.withColumn("new_rank", F.row_number().over(by)).filter(F.col("new_rank") <= k)


def share_of_each(top_k: int, lists: int) -> int:
    """How far each of several lists is read."""
    return 1 + top_k // lists


def interleaved(df: DataFrame, top_k: int) -> DataFrame:
    """Round-robin over the lists; a hit found by two lists counts twice."""
    return _first(df, ["rank", "list_idx"], top_k)


def by_score(df: DataFrame, top_k: int, higher_is_better: bool = True) -> DataFrame:
    s = F.round("score", PLACES)
    return _first(df, [s.desc() if higher_is_better else s.asc(), F.col("list_idx"), F.col("rank")], top_k)


def multiple_expansion(lists: list[DataFrame], top_k: int, interleave: bool = False, higher_is_better: bool = True) -> DataFrame:
    """The identity's list and one for each expansion, each read as far as share_of_each says."""
    part = share_of_each(top_k, len(lists))
    df = numbered(*lists).filter(F.col("rank") <= part)
    return interleaved(df, top_k) if interleave else by_score(df, top_k, higher_is_better)


def mixed_expansion(original: DataFrame, expanded: DataFrame, top_k: int, higher_is_better: bool = True) -> DataFrame:
    df = numbered(original, expanded).filter(F.col("rank") <= top_k // 2)
    return by_score(df, top_k, higher_is_better)


def fifty_fifty(chunks: DataFrame, contributions: DataFrame, top_k: int) -> DataFrame:
    """Strictly alternating halves of two tables' lists; a query with less than half in either is an error."""
    half = top_k // 2
    df = numbered(chunks, contributions).filter(F.col("rank") <= half)
    own = Window.partitionBy("qid")
    short = F.least(*[F.sum(F.when(F.col("list_idx") == i, 1).otherwise(0)).over(own) for i in (0, 1)]) < half
    checked = F.when(short, F.raise_error(F.lit("a list is shorter than half of top_k"))).otherwise(F.col("rank"))
    return interleaved(df.withColumn("rank", checked), top_k)


def deduplicated(df: DataFrame, key: str = "doc") -> DataFrame:
    """The first hit of each document: list after list, each by rank."""
    by = Window.partitionBy("qid", key).orderBy("list_idx", "rank")
    return df.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def interleaved_distinct(scored: DataFrame, num: int) -> DataFrame:
    """Candidates ranked for each representation (qid, rep, cid, score), read rank by rank over the representations; the
    first occurrence of a candidate counts, `num` are kept."""
    s = F.round("score", PLACES)
    ranked = scored.withColumn("r", F.row_number().over(Window.partitionBy("qid", "rep").orderBy(s.desc(), "cid")))
    first = ranked.groupBy("qid", "cid").agg(F.min(F.struct("r", "rep")).alias("at"))
    return _first(first, ["at.r", "at.rep"], num).select("qid", "new_rank", "cid")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


# Query expansion. An expander is a function of the query text and its document's columns.


def previous(sentences: Column, index: Column, n: int) -> Column:
    """The n sentences before sentence `index` (from 0), in single spaces; nothing at the start of a document."""
    begin = F.greatest(index - n, F.lit(0))
    return F.array_join(F.slice(sentences, begin + 1, F.greatest(index - begin, F.lit(0))), " ")


def with_previous(text: Column, sentences: Column, index: Column, n: int) -> Column:
    """Context, a space, the text: without context the result begins with the space."""
    return F.concat(previous(sentences, index, n), F.lit(" "), text)


def expander(headers: tuple[str, ...] = (), prev_n: int = 0, prefix: str = ""):
    """A function of (text, sentences, index, record columns by lower-cased header) to the expanded text."""

    def apply(text: Column, sentences: Column, index: Column, **record: Column) -> Column:
        out = with_previous(text, sentences, index, prev_n) if prev_n else text
        if headers:
            out = X.with_header(out, *[(h, record[h.lower()]) for h in headers])
        return F.concat(F.lit(prefix), out) if prefix else out

    return apply


EXPANDERS = {
    "identity": expander(),
    **{f"add_prev_{n}": expander(prev_n=n) for n in (1, 2, 3, 5, 7)},
    "add_title": expander(("Title",)),
    "add_abstract": expander(("Abstract",)),
    "add_title_abstract": expander(("Title", "Abstract")),
    **{f"add_title_prev_{n}": expander(("Title",), n) for n in (1, 3)},
    "add_title_abstract_prev_3": expander(("Title", "Abstract"), 3),
}


def expand(queries: DataFrame, documents: DataFrame, name: str, into: str = "query") -> DataFrame:
    """queries (source_doi, sent_no_cit, sent_idx) with the expanded text, from documents (doi, title, abstract,
    body_sentences). A query whose document is missing is an error."""
    if name not in EXPANDERS:
        raise ValueError(f"no expander {name}; there are {', '.join(EXPANDERS)}")
    d = documents.select(F.col("doi").alias("_doi"), "title", "abstract", "body_sentences")
    joined = queries.join(d, F.col("source_doi") == F.col("_doi"), "left")
    text = EXPANDERS[name](F.col("sent_no_cit"), F.col("body_sentences"), F.col("sent_idx"), title=F.col("title"), abstract=F.col("abstract"))
    strict = F.when(F.col("_doi").isNull(), F.raise_error(F.concat(F.lit("no document "), "source_doi"))).otherwise(text)
    return joined.withColumn(into, strict).select(*[c for c in queries.columns if c != into], into)
