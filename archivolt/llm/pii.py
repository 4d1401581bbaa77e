"""Personal data: regular expressions propose, checksums confirm, context words score.

Base kinds are email, ip, card and phone. On top, the method adds kinds of its own:
``iban`` (mod-97), and ``national_phone`` and ``national_id``, whose form alone is weak and
which count only with a context word close by. Added spans never overlap base ones, save
that a confirmed IBAN stands beside a card found among its digits.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .base import columns, slices, texts

#: In this order spans of one start are listed.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national_phone", "national_id")
ORDER = {k: i for i, k in enumerate(BASE + ADDED)}
#: Score of the form alone; what a checksum or a context word adds; what a span needs.
FORM = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.7, "iban": 0.5, "national_phone": 0.35, "national_id": 0.35}
CHECKED, CONTEXT, NEEDED = 0.3, 0.3, 0.6
#: Characters before a span in which context words count.
NEAR = 40

# Context words by kind.
WORDS = {
    "email": ("mail", "email", "e-mail", "correo", "courriel", "contact"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "teléfono", "téléphone", "handy"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "national_phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "teléfono", "téléphone", "handy"),
    "national_id": ("ssn", "social security", "tax id", "passport", "dni", "nir", "steuer-id"),
}
_NEAR = {k: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, w)) + r")(?!\w)", re.I) for k, w in WORDS.items()}

# Characters of an IBAN by country, of the public register.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23,
    "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28,
    "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Digits are taken whole and never given back: what must follow them is no digit.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_IBAN_REST = re.compile(r"(?: ?[A-Z0-9]){11,30}")
_NATIONAL = re.compile(r"(?<![\w+.-])\(?0?[1-9][0-9]{1,3}\)?[ /.-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![\w.-])")
_ID = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Spans that mod-97 confirms and that end where no letter or digit follows.

    A country of the register has its length; for another each end is tried, the longest
    first. The scan goes on after a span, and after the head of what is none.
    """
    m = _IBAN.search(text)
    while m:
        at = m.end()
        rest = _IBAN_REST.match(text, at)
        if rest:
            ends = [i + 1 for i in range(at, rest.end()) if text[i] != " "]
            n = IBAN_LENGTH.get(m.group()[:2])
            ends = ends[n - 5 : n - 4] if n else ends[:9:-1]
            for end in ends:
                follows = text[end : end + 1]
                if not (follows.isascii() and follows.isalnum()) and mod97(text[m.start() : end]):
                    yield m.start(), end
                    at = end
                    break
        m = _IBAN.search(text, at)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the email pattern, found from each @ so that long runs cost no more than their length."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            # A later @ may start no earlier than after this one, which is no local character.
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", s, e) for s, e in emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def score(text: str, kind: str, start: int) -> float:
    """Of a span whose checksum, if its kind has one, holds."""
    near = _NEAR[kind].search(text, max(0, start - NEAR), start) is not None
    return min(1.0, FORM[kind] + CHECKED * (kind in ("card", "iban", "ip")) + CONTEXT * near)


class Taken:
    """Places that are taken: disjoint intervals in order, overlapping ones as one."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.start: list[int] = []
        self.end: list[int] = []
        for _, start, end in sorted(spans, key=lambda x: x[1]):
            if self.end and start < self.end[-1]:
                self.end[-1] = max(self.end[-1], end)
            else:
                self.start.append(start)
                self.end.append(end)

    def free(self, start: int, end: int) -> bool:
        i = bisect_left(self.start, end) - 1
        return i < 0 or self.end[i] <= start


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further spans that reach NEEDED; none overlaps a base span or an earlier kind, save that an IBAN may overlap a card.

    Spans of one kind never overlap, so each kind is held against the merged places of
    those before it: the time is n log n for any number of spans.
    """
    found = {
        "iban": ibans(text),
        "national_phone": (m.span() for m in _NATIONAL.finditer(text)),
        "national_id": (m.span() for m in _ID.finditer(text)),
    }
    out: list[tuple[str, int, int]] = []
    for kind, spans in found.items():
        taken = Taken([x for x in base if x[0] != "card" or kind != "iban"] + out)
        out += [(kind, s, e) for s, e in spans if taken.free(s, e) and score(text, kind, s) >= NEEDED]
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], ORDER[x[0]])))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def pii(docs: DataFrame, *, full: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row.

    The counts and base_sha256 are of base spans; spans lists all. full: also scores,
    one number per listed span, and redacted, the text with kinds in place of spans.
    Offsets are code points. Null counts as empty: no spans, the digest of nothing.
    Repeated rows and null ids stay as they are; an empty table gives an empty table.
    One narrow stage; the time for a very long text grows with its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = texts(batch)
            base = [base_spans(t) for t in found]
            every = [sorted(b + added_spans(t, b), key=lambda x: (x[1], ORDER[x[0]])) for t, b in zip(found, base, strict=True)]
            out = [batch.column("doc_id")]
            out += [pa.array([sum(s[0] == kind for s in b) for b in base], pa.int64()) for kind in BASE]
            out += [pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in base], pa.string()), pa.array([listed(x) for x in every], pa.string())]
            names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
            if full:
                out += [pa.array([[score(t, k, s) for k, s, _ in x] for t, x in zip(found, every, strict=True)], pa.list_(pa.float64())), pa.array([redacted(t, x) for t, x in zip(found, every, strict=True)], pa.string())]
                names += ["scores", "redacted"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", scores array<double>, redacted string" * full
    return columns(docs, "doc_id", "text").mapInArrow(run, schema)
