"""Personal data by anchor expansion.

An Aho-Corasick automaton finds every anchor in one pass over a text: at-signs, schemes, plus signs, digits and identifier cues.
A deterministic parser of the anchor's kind expands it from where it stands and validates what it finds: addresses (email, IP, URL),
numbers (card, phone) and accounts (IBAN, access keys, passwords, tokens). An anchor inside a stretch that its parser has read already is passed
over, so long texts cost in proportion to their length.
"""

from __future__ import annotations

import re
import string
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.scratch import small_batches

#: Kinds in the order that breaks ties of one start. The first four are the base; the method adds the others.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "key", "password", "token")
#: Cues of the added kinds, found in any case.
CUES = {
    "iban": "iban", "password": "password", "passwd": "password", "pwd": "password", "passphrase": "password",
    "token": "token", "secret": "token", "api_key": "token", "apikey": "token", "api-key": "token", "access_key": "token", "private_key": "token", "bearer": "token",
}
SCHEMES = ("http", "https", "ftp")

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_RUN = re.compile(r"[0-9]++")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"://[^\s\"'<>()\[\]{}]+")
_IBAN = re.compile(r"[ \t:=#.-]{0,8}\b([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})\b")
_KEY = re.compile(r"AKIA[A-Z0-9]{16}(?![A-Z0-9])")
#: What stands behind a cue: an equals sign or a colon, and a value.
_BEFORE = re.compile(r"[\"']?[ \t]*[=:][ \t]*[\"']?")
_STRETCH = re.compile(r"[^\s,;\"']*")
_VALUE = re.compile(rf"{_BEFORE.pattern}([^\s,;\"']+)")
#: Values of tokens consist of these characters, at least so many, a digit among them.
_TOKEN, _TOKEN_LEAST = string.ascii_letters + string.digits + "_./+=-", 8

Found = tuple[int, int] | None


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _email(text: str, at: int, floor: int) -> tuple[int, Found]:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    m = _DOMAIN.match(text, at + 1) if start < at else None
    return (m.end(), (start, m.end())) if m else (at + 1, None)


def _ip(text: str, at: int, floor: int) -> tuple[int, Found]:
    """at: the first digit of a run, for a match that starts inside a run fails or succeeds as one from its start."""
    m = _IP.match(text, at)
    if not m:
        return _RUN.match(text, at).end(), None
    parts = [p.lstrip("0") for p in m[0].split(".")]
    return m.end(), m.span() if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts) else None


def _card(text: str, at: int, floor: int) -> tuple[int, Found]:
    m = _DIGITS.match(text, at)
    if not m:
        return at + 1, None
    ok = m.end() - m.start() <= 37 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits)
    return m.end(), m.span() if ok else None


def _phone(text: str, at: int, floor: int) -> tuple[int, Found]:
    m = _PHONE.match(text, at)
    if not m:
        return at + 1, None
    return m.end(), m.span() if 10 <= sum(c.isdigit() for c in m[0]) <= 15 else None


def _url(text: str, at: int, floor: int) -> tuple[int, Found]:
    letters = re.search(r"[A-Za-z]*$", text[max(floor, at - 7) : at - 2])[0].lower()  # at: the anchor's last slash
    scheme = max((x for x in SCHEMES if letters.endswith(x)), key=len, default=None)
    m = _URL.match(text, at - 2) if scheme else None  # only then, so that a stretch is not read again for each anchor in it
    return (m.end(), (at - 2 - len(scheme), m.start() + len(m[0].rstrip(".,;:!?")))) if m else (at + 1, None)


def _iban(text: str, at: int, floor: int) -> tuple[int, Found]:
    m = _IBAN.match(text, at + 1)
    return (m.end(), m.span(1)) if m and _iban_valid(m[1]) else (at + 1, None)


def _key(text: str, at: int, floor: int) -> tuple[int, Found]:
    m = _KEY.match(text, at - 3)
    return (m.end(), m.span()) if m else (at + 1, None)


def _password(text: str, at: int, floor: int) -> tuple[int, Found]:
    m = _VALUE.match(text, at + 1)
    return (m.end(), m.span(1)) if m else (at + 1, None)


class _Tokens:
    """The parser of token cues, for one text. A stretch is read once: what is known of it serves every cue inside it."""

    def __init__(self):
        self.end = self.clean = self.digit = -1

    def __call__(self, text: str, at: int, floor: int) -> tuple[int, Found]:
        m = _BEFORE.match(text, at + 1)
        if not m:
            return at + 1, None
        start = m.end()
        if start >= self.end:
            stretch = _STRETCH.match(text, start)[0]
            self.end = start + len(stretch)
            self.clean = start + len(stretch.rstrip(_TOKEN))  # from here on there are only characters of tokens
            self.digit = start + max(map(stretch.rfind, string.digits))
        ok = start >= self.clean and self.digit >= start and self.end - start >= _TOKEN_LEAST
        return (self.end, (start, self.end)) if ok else (at + 1, None)


#: Parsers take a text, the last character of an anchor and where the kind's last stretch ended; they return where theirs ends and the span, if valid.
PARSERS: dict[str, Callable[[str, int, int], tuple[int, Found]]] = {
    "email": _email, "ip": _ip, "card": _card, "phone": _phone, "url": _url, "iban": _iban, "key": _key, "password": _password,
}
_ORDER = {k: i for i, k in enumerate(KINDS)}


def _lowered(text: str) -> str:
    """text in lower case, character by character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


class Finder:
    def __init__(self):
        import ahocorasick

        self.anchors = ahocorasick.Automaton()
        anchors = {"@": ("email",), "+": ("phone",), "://": ("url",), "akia": ("key",)} | dict.fromkeys(string.digits, ("ip", "card"))
        anchors |= {cue: (kind,) for cue, kind in CUES.items()}
        for anchor, kinds in anchors.items():
            self.anchors.add_word(anchor, kinds)
        self.anchors.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) sorted by start, then kind as listed."""
        if not text:
            return []
        floor = dict.fromkeys(KINDS, 0)
        parsers = PARSERS | {"token": _Tokens()}
        out: list[tuple[int, int, str]] = []
        for end, kinds in self.anchors.iter(_lowered(text)):
            for kind in kinds:
                if end >= floor[kind]:
                    floor[kind], span = parsers[kind](text, end, floor[kind])
                    if span:
                        out.append((*span, kind))
        return sorted(out, key=lambda x: (x[0], _ORDER[x[2]], x[1]))


def find(documents: DataFrame) -> DataFrame:
    """documents and pii: array of (kind, start, end), code points with end exclusive, by start, then kind as in KINDS.

    Null, empty and clean texts have an empty array. Base kinds are leftmost and non-overlapping each; spans of different kinds
    may overlap. Repeated rows get equal arrays. A column named pii is replaced; an empty table gives no rows.
    """
    base = documents.drop("pii")
    small_batches(documents.sparkSession)
    at = base.columns.index("text")
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    added = "array<struct<kind:string,start:bigint,end:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                found = [[{"kind": k, "start": s, "end": e} for s, e, k in finder.find(t)] for t in batch.column(at).to_pylist()]
                yield pa.record_batch([*batch.columns, pa.array(found, span)], [*batch.schema.names, "pii"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *T.StructType.fromDDL(f"pii {added}").fields]))


def redact(documents: DataFrame) -> DataFrame:
    """documents, all columns, with every span in text replaced by its kind in brackets; of overlapping spans the first and longest counts.

    Null and empty texts stay as they are, as do texts without a span. A column named pii of the caller's stays too.
    """
    names = documents.columns
    aside = f"pii_{uuid.uuid4().hex}"
    found = find(documents.withColumnRenamed("pii", aside))
    spans = F.array_sort(F.transform("pii", lambda p: F.struct(p["start"].alias("s"), (-p["end"]).alias("e"), p["kind"].alias("k"))))
    step = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda a, p: F.when(p["s"] < a["at"], a).otherwise(
            F.struct(
                (-p["e"]).alias("at"),
                F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, p["s"] - a["at"]), F.lit("["), p["k"], F.lit("]")).alias("out"),
            )
        ),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))),
    )
    found = found.withColumn("text", F.when(F.size("pii") > 0, step).otherwise(F.col("text")))
    return found.drop("pii").withColumnRenamed(aside, "pii").select(names)
