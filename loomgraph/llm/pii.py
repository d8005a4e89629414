"""Personal data: patterns propose spans, checksums confirm them, context adjusts a score.

Base kinds (email, ip, card, phone) are fixed by their patterns: leftmost non-overlapping
matches of each kind, of which those that fail their check are dropped without a retry.
Further kinds (iban, ssn) count only if their score reaches ``ACCEPT``. Every scan is
linear in the text, also over very long runs of letters or digits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._util import arrow_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
ACCEPT = 0.5
#: Code points on either side of a span that are searched for context words.
NEAR = 48

#: Score of a span that passed its check, by kind.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
#: Words that raise the score of a kind nearby.
HINTS = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
#: Words that lower the score of any kind nearby.
DOUBTS = ("example", "version", "isbn", "serial", "order", "sample")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGITS = re.compile(r"[^0-9]")
_ANY_DIGIT = re.compile(r"[0-9]")
_WORDS = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    """The checksum of card numbers: every second digit from the right is doubled."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The checksum of account numbers: letters count 10 to 35, the remainder by 97 is 1."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Runs of local characters before each @; a match of the pattern starts at the run's start."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        last = end
        at = text.find("@", end)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _digits(text: str, a: int, b: int) -> str:
    return _DIGITS.sub("", text[a:b])


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans by kind as in ``KINDS``, then by start."""
    for a, b in _emails(text):
        yield "email", a, b
    if not _ANY_DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(text, *m.span())) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(text, *m.span())) <= 15:
                yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield "iban", *m.span()
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", *m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, raised by its hints nearby and lowered by doubts."""
    near = set(_WORDS.findall((text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()))
    s = PRIOR[kind] + 0.3 * any(w in near for w in HINTS[kind]) - 0.2 * any(w in near for w in DOUBTS)
    return round(min(1.0, max(0.0, s)), 3)


def spans_of(text: str | None) -> list[dict]:
    found = []
    for kind, a, b in proposals(text or ""):
        s = score(text, kind, a, b)
        if kind in BASE or s >= ACCEPT:
            found.append({"kind": kind, "start": a, "end": b, "score": s})
    return found


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def spans_column(text: Column) -> Column:
    @F.pandas_udf(SPANS)
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([spans_of(t) for t in texts], dtype=object)

    return of(text)


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans`` (kind, start, end, score), by kind as in
    ``KINDS`` and then by start; offsets are code points, ends exclusive.

    A null or empty text has no span (an empty list). Null or repeated doc_ids and repeated
    rows stay as they are. An empty table gives an empty result; other columns are ignored.
    """
    arrow_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), spans_column(F.col(text)).alias("spans"))


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one."""
    arrow_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t:
                parts, at = [], 0
                for s in sorted(spans_of(t), key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= at:
                        parts += [t[at : s["start"]], f"[{s['kind'].upper()}]"]
                    at = max(at, s["end"])
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, of(F.col(text)))


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of what ``find`` returns."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _of_kind(kind: str) -> Column:
    return F.filter("spans", lambda s: s["kind"] == kind)
