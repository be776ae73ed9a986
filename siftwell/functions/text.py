"""Text expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def clean_query(c: Column) -> Column:
    """Without citation marks and the empty brackets that they leave, in single spaces."""
    return squeeze(F.regexp_replace(F.regexp_replace(c, r"\[REF\]", ""), r"\(\s*\)", ""))


MASK = "[REF]"


def mask_substrings(text: Column, parts: Column) -> Column:
    """text with each of the parts masked: as it is, else stripped, else stripped and short of its last one to three
    characters; the first form that occurs counts."""

    def one(acc: Column, part: Column) -> Column:
        bare = strip(part)
        forms = [part, bare] + [F.substring(bare, F.lit(1), F.length(bare) - n) for n in (1, 2, 3)]
        out = acc
        for form in reversed(forms):
            out = F.when((F.length(form) > 0) & F.contains(acc, form), F.replace(acc, form, F.lit(MASK))).otherwise(out)
        return out

    return F.aggregate(parts, text, one)


# The shape of an inline citation.
SURNAME = r"[A-Z][a-zA-ZÀ-ÖØ-öø-ÿ-]*(?:'[A-Z][a-zA-ZÀ-ÖØ-öø-ÿ-]*)?"
YEAR = r"\(?\s?([0-9]{4}[a-z]?)\s?\)?"
CITATION = rf"({SURNAME}(?:,?\s| and | & {SURNAME})*(?: et al.?\s?)?),?\s*{YEAR}"


def citations(c: Column) -> Column:
    """Array of (author, year) of inline citations such as "Smith & Jones (2010)" or "Smith et al. (2010a)". The author is the text before
    the year as it stands, spaces at its end included: names joined by "&" count whole, of names joined by "and" the last."""
    return F.arrays_zip(
        F.regexp_extract_all(c, F.lit(CITATION), F.lit(1)).alias("author"),
        F.regexp_extract_all(c, F.lit(CITATION), F.lit(2)).alias("year"),
    )


def year_is_numeric(year: Column) -> Column:
    return year.rlike(r"^(?:[0-9]{4}|[0-9]{2})")


def sentences(c: Column) -> Column:
    """Sentences whose concatenation is the text: cut after the white space behind an end mark, where text goes on."""
    return F.split(c, r"(?<=[.?!]\s)(?=\S)")


def merge_short(sents: Column, threshold: int = 60) -> Column:
    """Sentences gathered in a buffer as long as buffer and next sentence stay under `threshold` characters together.

    A sentence that would reach it sends the buffer out and becomes the buffer; one that fits is appended with a space behind it. So nothing
    stands between a sentence that took the buffer over and the short one after it. What goes out is stripped."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    start = F.struct(F.slice(sents, 1, 0).alias("out"), F.lit("").alias("buf"))
    sent = lambda acc: F.when(acc["buf"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(strip(acc["buf"]))))

    def step(acc: Column, s: Column) -> Column:
        fits = F.length(acc["buf"]) + F.length(s) < threshold
        kept = F.struct(acc["out"].alias("out"), F.concat(acc["buf"], s, F.lit(" ")).alias("buf"))
        return F.when(fits, kept).otherwise(F.struct(sent(acc).alias("out"), s.alias("buf")))

    return F.aggregate(sents, start, step, sent)


def normal_title(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def halves(c: Column) -> tuple[Column, Column]:
    half = F.floor(F.length(c) / 2).cast("int")
    return F.substring(c, F.lit(1), half), F.substring(c, half + 1, F.length(c))


def half_contains(a: Column, b: Column) -> Column:
    """Either half of either title occurs in the other."""
    out = F.lit(False)
    for x, y in ((a, b), (b, a)):
        for h in halves(x):
            out = out | ((F.length(h) > 0) & F.contains(y, h))
    return out


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores."""
    return F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z0-9_]+)"), F.lit(1)), F.lower)


# English words that the Robertson variant of BM25 leaves out.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such",
    "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)


def long_tokens(c: Column) -> Column:
    """Lower-case runs of two or more letters, digits and underscores of any script, without English stop words."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1)), lambda t: ~t.isin(*STOP_WORDS))


def chunk_starts(c: Column, capacity: int, overlap: int) -> Column:
    """1-based starts of chunks of `capacity` characters, each sharing `overlap` with the one before."""
    stride = capacity - overlap
    last = F.greatest(F.length(c) - overlap, F.lit(1))
    return F.sequence(F.lit(1), last, F.lit(stride))


def chunks(c: Column, capacity: int = 1500, overlap: int = 150) -> Column:
    return F.transform(chunk_starts(c, capacity, overlap), lambda s: F.substring(c, s, F.lit(capacity)))


def page_text(html: Column) -> Column:
    """Text of a page: without scripts, styles, comments and tags; hyphenated line ends rejoined; single spaces."""
    out = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    return squeeze(F.regexp_replace(out, r"-\n", ""))


def with_header(text: Column, *named: tuple[str, Column]) -> Column:
    """Query text with titled context behind it; missing context is empty."""
    parts = [F.lit("IMPORTANT:\n"), text]
    for name, value in named:
        parts += [F.lit(f"\n\n{name}\n"), F.coalesce(value, F.lit(""))]
    return F.concat(*parts)


def reranker_context(query: Column, *expansions: Column) -> Column:
    return F.concat(F.lit("Context:"), *[F.concat(F.lit("\n* "), e) for e in expansions], F.lit("\n\nQuery:\n"), query)


def format_prompt(template: str, **values: Column) -> Column:
    """A template with {name} places filled from columns."""
    out: list[Column] = []
    for literal, name in re.findall(r"([^{]*)(?:\{(\w+)\})?", template):
        if literal:
            out.append(F.lit(literal))
        if name:
            out.append(values[name].cast("string"))
    return F.concat(*out)


def without_nul(c: Column) -> Column:
    return F.translate(c, "\u0000", "")


def numbers_in(c: Column, pattern: str, *names: str) -> list[Column]:
    """Groups of a pattern as integers, null where it does not match."""
    return [F.nullif(F.regexp_extract(c, pattern, i + 1), F.lit("")).cast("int").alias(n) for i, n in enumerate(names)]
