"""Text functions as Columns (§2.8): normalisers, ratios, slices, codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations of street words and the types a street name may end in.
STREET_WORDS = {
    "N": "NORTH", "S": "SOUTH", "E": "EAST", "W": "WEST", "NE": "NORTHEAST", "NW": "NORTHWEST", "SE": "SOUTHEAST", "SW": "SOUTHWEST",
    "ST": "STREET", "STR": "STREET", "AVE": "AVENUE", "AV": "AVENUE", "RD": "ROAD", "DR": "DRIVE", "BLVD": "BOULEVARD", "PL": "PLACE",
    "PLZ": "PLAZA", "CT": "COURT", "LN": "LANE", "TER": "TERRACE", "TERR": "TERRACE", "PKWY": "PARKWAY", "PKY": "PARKWAY",
    "HWY": "HIGHWAY", "SQ": "SQUARE", "CIR": "CIRCLE", "BRDG": "BRIDGE", "EXPY": "EXPRESSWAY", "SLIP": "SLIP", "WAY": "WAY",
}
STREET_TYPES = (
    "STREET", "AVENUE", "BOULEVARD", "ROAD", "DRIVE", "PLACE", "PLAZA", "COURT", "LANE", "TERRACE", "PARKWAY", "HIGHWAY", "SQUARE",
    "CIRCLE", "BRIDGE", "EXPRESSWAY", "SLIP", "WAY",
)
ORG_SUFFIXES = {
    "lab": {"LABORATORY": "Laboratory", "LABORATORIES": "Laboratory", "LABS": "Laboratory", "LAB": "Laboratory", "ANALYTICAL": "Analytical", "TESTING": "Testing"},
    "contractor": {
        "INC": "Inc.", "INCORPORATED": "Inc.", "CORP": "Corp.", "CORPORATION": "Corp.", "LLC": "LLC", "CO": "Co.", "COMPANY": "Co.",
        "ASSOCIATES": "Associates", "CONSULTANTS": "Consultants", "CONSULTING": "Consulting", "ENGINEERS": "Engineers",
        "ENGINEERING": "Engineering", "CONTRACTING": "Contracting", "CONTRACTORS": "Contractors", "CONSTRUCTION": "Construction",
    },
}


def collapsed(c: Column) -> Column:
    """White space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def slug(c: Column) -> Column:
    s = F.lower(F.trim(F.regexp_replace(c, "[^A-Za-z0-9]+", "-"), F.lit("-")))
    return F.when(s == "", "x").otherwise(s)


def alpha_ratio(c: Column) -> Column:
    """Letters (of any script) by characters; 0 for the empty text."""
    return F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.greatest(F.length(c), F.lit(1))


def page_status(text: Column, from_ocr: Column, least: int = 80, alpha: float = 0.25) -> Column:
    """Empty, ocr, junk or ok, by the collapsed text."""
    s = collapsed(F.coalesce(text, F.lit("")))
    return F.when(F.length(s) < least, "empty").when(F.coalesce(from_ocr, F.lit(False)), "ocr").when(alpha_ratio(s) < alpha, "junk").otherwise("ok")


def words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def _mapped(table: dict[str, str], w: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[w], w)


def street(c: Column) -> Column:
    """Upper case, punctuation to spaces, no ordinal endings, abbreviations spelled out; ST or STR only at the end."""
    w = F.transform(words(F.regexp_replace(F.upper(c), "[^A-Z0-9 ]+", " ")), lambda x: F.regexp_replace(x, r"^(\d+)(ST|ND|RD|TH)$", "$1"))
    last = F.size(w) - 1
    return F.array_join(F.transform(w, lambda x, i: F.when(x.isin("ST", "STR") & (i != last), x).otherwise(_mapped(STREET_WORDS, x))), " ")


def house_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(c), r"^(\d{1,4}(?:-\d{1,4})?)\s+", 1), F.lit(""))


def after_house_number(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"^\d{1,4}(?:-\d{1,4})?\s+", "")


def street_type(normal: Column) -> Column:
    last = F.element_at(F.split(normal, " "), -1)
    return F.when(last.isin(*STREET_TYPES), last)


def street_name(normal: Column) -> Column:
    return F.when(street_type(normal).isNotNull(), F.regexp_replace(normal, r" ?\S+$", "")).otherwise(normal)


def compact_address(c: Column) -> Column:
    """Upper case, types in short, letters and digits alone."""
    short = {v: k for k, v in STREET_WORDS.items() if k not in ("STR", "AV", "TERR", "PKY") and v in STREET_TYPES}
    return F.regexp_replace(F.array_join(F.transform(words(F.regexp_replace(F.upper(c), "[^A-Z0-9 ]+", " ")), lambda w: _mapped(short, w)), ""), "[^A-Z0-9]", "")


def org(c: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(c, r"[\s,]+", " "), F.lit(" ,&")))


def org_parts(c: Column, kind: str) -> tuple[Column, Column]:
    """Name without its legal or trade ending, and that ending in one spelling ('' if none); & is AND."""
    w = words(F.regexp_replace(F.regexp_replace(F.upper(c), "[.,]", ""), r"\s*&\s*", " AND "))
    last = F.when(F.size(w) > 0, F.element_at(w, -1))
    table = ORG_SUFFIXES[kind]
    ending = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[last]
    return F.array_join(F.when(ending.isNotNull(), F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))).otherwise(w), " "), F.coalesce(ending, F.lit(""))


def title_case(c: Column) -> Column:
    """First letters upper, the rest lower; numbers, single letters and initialisms (A.B.C.) stay."""
    def one(w: Column) -> Column:
        initials = w.rlike(r"['.]") & ~w.rlike(r"[^'.]{2,}")
        return F.when(w.rlike(r"^\d+$") | (F.length(w) <= 1), w).when(initials, F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))
    return F.array_join(F.transform(words(c), one), " ")


def clamp_words(c: Column, most: int = 10) -> Column:
    return F.array_join(F.slice(words(c), 1, most), " ")


def clamp_chars(c: Column, most: int = 180) -> Column:
    """At most so many characters, cut after a word."""
    cut = F.substring(c, 1, most + 1)
    return F.when(F.length(c) <= most, c).otherwise(F.regexp_replace(cut, r"\s+\S*$", ""))


def html_escaped(c: Column) -> Column:
    return reduce(lambda x, ab: F.replace(x, F.lit(ab[0]), F.lit(ab[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")), c)


def entities_decoded(c: Column) -> Column:
    """The five named entities and decimal or hexadecimal ones of ASCII; & last, so that nothing decodes twice."""
    named = reduce(lambda x, ab: F.replace(x, F.lit(ab[0]), F.lit(ab[1])), (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " ")), c)
    return F.replace(named, F.lit("&amp;"), F.lit("&"))


def html_text(c: Column) -> Column:
    """Text of a page: no scripts, styles, comments or tags; entities decoded, white space collapsed."""
    plain = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return collapsed(entities_decoded(F.regexp_replace(plain, r"(?s)<[^>]*>", " ")))


def columns_of(line: Column) -> Column:
    """Cells of a line parted by two blanks or more."""
    return F.filter(F.split(F.trim(line), r"\s{2,}"), lambda x: x != "")


def pages_of(text: Column) -> Column:
    """Pages parted by form feeds; a blank last one goes."""
    p = F.split(text, "\f")
    return F.when((F.size(p) > 1) & F.element_at(p, -1).rlike(r"^\s*$"), F.slice(p, 1, F.size(p) - 1)).otherwise(p)


def path_segment(c: Column) -> Column:
    """A value as one path segment: null as ~, '' as ~e, and dots and tildes that would mislead escaped."""
    escaped = F.replace(c, F.lit("~"), F.lit("~~"))
    return F.when(c.isNull(), "~").when(c == "", "~e").when(c == ".", "~d").when(c == "..", "~dd").otherwise(escaped)


def text_slice(c: Column, offset: int, most: int) -> tuple[Column, Column]:
    """A piece and where the next one starts; null at the end."""
    return F.substring(c, offset + 1, most), F.when(F.length(c) > offset + most, F.lit(offset + most))


def short_code(number: Column, page: Column) -> Column:
    """A number and a page in base 36, parted by a hyphen; no number, no code."""
    return F.when(number.isNotNull(), F.lower(F.concat_ws("-", F.conv(number.cast("string"), 10, 36), F.conv(page.cast("string"), 10, 36))))


def from_short_code(code: Column, width: int = 9) -> tuple[Column, Column]:
    """The digits of the number, ``width`` at least, and the page."""
    parts = F.split(F.upper(code), "-")
    digits = F.conv(F.get(parts, F.lit(0)), 36, 10)
    # lpad cuts what is longer.
    return F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0")), F.conv(F.get(parts, F.lit(1)), 36, 10).cast("int")


def redacted_names(c: Column, allowed: tuple[str, ...]) -> Column:
    """Pairs of capitalised words become [name] unless both are allowed words."""
    ok = "|".join(allowed) or "(?!)"
    return F.regexp_replace(c, rf"\b(?!(?:{ok})\s+(?:{ok})\b)[A-Z][a-z]+\s+[A-Z][a-z]+\b", "[name]")
