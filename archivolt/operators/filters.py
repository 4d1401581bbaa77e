"""Predicates (F1-F18). Each gives a Column, so that they join into one pushed filter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
# Substrings of automated readers' agents.
BOTS = (
    "bot", "crawl", "spider", "slurp", "facebookexternalhit", "whatsapp", "telegrambot", "pingdom", "uptimerobot",
    "ahrefsbot", "semrushbot", "mj12bot", "dotbot", "petalbot", "yandex", "bingpreview", "headlesschrome", "phantomjs",
    "python-requests", "curl/", "wget", "go-http-client", "scrapy", "monitor",
)


def active(status: Column, gone: str = "removed") -> Column:
    """anything but ``gone``; null is active."""
    return ~status.eqNullSafe(F.lit(gone))


def path(levels: dict[str, str | None]) -> Column:
    """each level equals its value; None asks for null, which is not the empty text."""
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(v)) for k, v in levels.items()), F.lit(True))


def optional(value: object, made) -> Column:
    """the predicate, or true where the parameter is absent."""
    return F.lit(True) if value is None else made(value)


def any_date_in(dates: Column, start: str | None, end: str | None) -> Column:
    """some ISO date of the array lies in [start, end)."""
    def one(x: Column) -> Column:
        out = x.rlike(ISO_DATE)
        out = out & (x >= start) if start else out
        return out & (x < end) if end else out
    return F.exists(dates, one)


def day_after(day: Column) -> Column:
    """the next day as ISO text; null for what is no date."""
    return F.date_format(F.date_add(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("date"), 1), "yyyy-MM-dd")


def loose(field: Column, value: str, is_array: bool = False) -> Column:
    """F8: equal, equal in upper case, or a prefix whatever the case; of arrays any element."""
    one = lambda c: (c == value) | (c == value.upper()) | F.lower(c).startswith(value.lower())
    return F.exists(field, one) if is_array else one(field)


def contains(field: Column, needle: str) -> Column:
    """as text whatever the case; % and _ are plain characters."""
    return F.lower(field).contains(needle.lower())


def initial(field: Column, letter: str) -> Column:
    """F10."""
    return F.lower(field).startswith(letter.lower())


def whole_words(field: Column, *words: str) -> Column:
    """one of the words, at word boundaries, whatever the case."""
    return field.rlike(r"(?i)\b(" + "|".join(w.replace(".", r"\.") for w in words) + r")\b")


def record_kind(has_test: Column, doc_type: Column, inspections: list[str]) -> Column:
    """test, inspection or mention."""
    return F.when(has_test, "test").when(doc_type.isin(inspections), "inspection").otherwise("mention")


def in_year(dates: Column, year: int) -> Column:
    """F13."""
    return any_date_in(dates, f"{year}-01-01", f"{year + 1}-01-01")


def restricted(df: DataFrame, ids: DataFrame, key: str, cap: int = 1000) -> DataFrame:
    """rows of at most ``cap`` listed ids, the smallest ones."""
    return df.join(ids.select(key).distinct().orderBy(key).limit(cap), key, "left_semi")


def penalised(score: Column, doc_type: Column, kind: str, shown: bool) -> tuple[Column, Column]:
    """the score, and what to keep: half the score of ``kind`` where shown, else out it goes."""
    is_kind = doc_type.eqNullSafe(F.lit(kind))
    return F.when(is_kind, score * 0.5).otherwise(score), F.lit(True) if shown else ~is_kind


def is_bot(agent: Column) -> Column:
    """no agent at all counts as one."""
    return (F.coalesce(F.trim(agent), F.lit("")) == "") | agent.rlike("(?i)" + "|".join(BOTS))
