"""Schemas of the data model, and the checks that guard them. Nothing is inferred."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


RAW_PAPER = (
    "bibcode string, title array<string>, abstract string, body string, doi array<string>, author array<string>, "
    "keyword array<string>, reference array<string>, pubdate string, citation_count bigint, doctype string"
)
PAPER = (
    "bibcode string, title string, abstract string, body string, doi string, author array<string>, keywords array<string>, "
    "reference array<string>, pubdate string, citation_count bigint, doctype string, dois array<string>, "
    "loaded_from string, body_sentences array<string>"
)
QUERY = (
    "source_doi string, sent_original string, sent_no_cit string, query string, sent_idx int, "
    "citation_dois array<string>, pubdate int, resolved_bibcodes array<string>"
)
PASSAGE = "doi string, text string, pubdate int, citation_count bigint"
VECTOR_PASSAGE = f"id bigint, {PASSAGE}, vector array<float>"
HIT = "text string, doi string, pubdate int, citation_count bigint, metric double"
CITATION_CONTEXT = (
    "masked_cit_context string, masked_token_target string, citing_title string, citing_abstract string, "
    "target_title string, target_abstract string"
)


def schema(name: str) -> T.StructType:
    """One of the schemas above, by name; SEARCH_RESULT: a query and its hits."""
    if name == "SEARCH_RESULT":
        return T.StructType([T.StructField("record", _of(QUERY)), T.StructField("results", T.ArrayType(_of(HIT)))])
    return _of(globals()[name])


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df, if it has all the columns."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def exact_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df, if these are its columns and it has no others."""
    if set(df.columns) != set(names):
        raise ValueError(f"columns are {sorted(df.columns)}, not {sorted(names)}")
    return df


def complete_rows(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Rows in which every named column has a value."""
    names = list(names)
    return require_columns(df, names).dropna(subset=names)
