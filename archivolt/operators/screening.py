"""Screens of text and titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapsed, title_case, words
from .extract import BLOCK_LOT

# Words that make a capitalised phrase a place or an organisation, folder words that are no names, and patterns.
PLACES = (
    "liberty", "broadway", "battery", "manhattan", "world", "trade", "center", "brooklyn", "hudson", "east", "river", "ground", "zero",
    "staten", "island", "fresh", "kills", "chambers", "vesey", "greenwich", "church", "fulton", "wall", "canal", "bowery", "trinity",
    "city", "hall", "park", "national", "september", "lower", "downtown", "financial", "district", "new", "york", "jersey",
    "west", "south", "north", "building", "tower", "plaza",
)
BODIES = (
    "street", "st", "avenue", "ave", "place", "pl", "lane", "slip", "road", "rd", "boulevard", "blvd", "drive", "way", "terrace", "square",
    "sq", "inc", "llc", "corp", "co", "company", "associates", "contracting", "environmental", "laboratory", "laboratories", "labs",
    "services", "group", "consulting", "engineering", "testing", "abatement", "construction", "industries", "industrial", "remediation",
    "systems", "partners", "office", "division", "department", "agency", "authority", "bureau", "institute", "consultants", "enterprises",
    "management", "restoration", "demolition", "inspections",
)
PLAIN = (
    "asbestos", "lead", "mold", "inspection", "permit", "permits", "correspondence", "reports", "report", "samples", "sample", "invoice",
    "invoices", "memos", "memo", "photos", "photo", "miscellaneous", "misc", "various", "unknown", "untitled", "pending", "confidential",
    "general", "notices", "notice", "contracts", "contract", "complaints", "complaint", "violations", "violation", "applications",
    "application", "forms", "form", "claims", "claim", "litigation", "settlement", "settlements", "air", "water", "dust", "debris",
    "monitoring", "results", "analysis", "analyses", "data", "field", "notes", "note", "transcripts", "transcript", "exhibits", "exhibit",
    "schedule", "schedules", "epa", "dep", "osha", "fema", "niosh", "atsdr", "cdc", "doh", "dob", "oem", "qa", "qc", "plm", "tem",
)
ACRONYMS = (
    "epa", "dep", "osha", "fema", "niosh", "atsdr", "cdc", "doh", "dohmh", "nysdec", "nysdoh", "usace", "ddc", "dcas", "fdny", "nypd",
    "dob", "oem", "doris", "lmdc", "hpd", "dsny", "wtc", "nyc", "acp", "acp7", "plm", "tem", "qa", "qc", "llc",
)
PORTAL = r"(?i)^\s*NYC\s*9[/\s]*1+1?\s*Public\s*Portal\s*Document\s*$"
PLACEHOLDER = r"(?i)^(?:untitled|document|page|scan(?:ned)?(?: document)?|n/?a|none)\W*\d*$"
DESCRIBES = r"(?i)\b(?:this (?:document|page|excerpt)|the (?:excerpt|text) (?:shows|contains))\b"
JUNK = r"[{}<>]|\\n|```"
LAST_FIRST = r"^[A-Z][A-Z.'-]{1,},?\s+[A-Z][A-Z.'-]{1,}(?:\s+[A-Z]\.?)?$"
INITIAL_NAME = r"\b[A-Z]\.\s*[A-Z][a-z]+\b"
LONE_NAME = r"^[A-Z][A-Z'.-]{1,19}$"
CAPITAL_PAIR = r"\b([A-Z][a-z]+\s+[A-Z][a-z]+)\b"
SHEET_DUST = r"(?i)MICR\w?VAC|Surface\s*Area\s*Sampled|\(ML\)"
SHEET_GROUP = r"(?i)Lab\s*[GC]r[o0]u[pD]\s*#?\s*[:;.]?\s*(\d{2,6})"
SHEET_SAMPLE = r"(?i)Lab\s*Sample\s*#?\s*[:;.]?\s*([A-Za-z0-9-]{1,10})"
TRUNCATED = r"(?:\.\.\.|…|\b(?:and|or|of|the|with|for))\s*$"


#: Three ASCII letters and more, with no letter, digit or underscore of any script beside them.
WORD = r"(?<![\p{L}\p{N}_])([a-z]{3,})(?![\p{L}\p{N}_])"


def lexical_quality(text: Column, vocabulary: Column) -> Column:
    """Struct of tokens (three letters and more), good ones (in the vocabulary, an array), unique good ones, ratio, chars."""
    low = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 1)
    good = F.filter(low, lambda w: F.array_contains(vocabulary, w))
    return F.struct(F.size(low).alias("tokens"), F.size(good).alias("good"), F.size(F.array_distinct(good)).alias("unique"), (F.size(good) / F.greatest(F.size(low), F.lit(1))).alias("ratio"), F.length(collapsed(F.coalesce(text, F.lit("")))).alias("chars"))


def lexical_rows(pages: DataFrame, keys: list[str], text: str, vocabulary: DataFrame) -> DataFrame:
    """E26 with the vocabulary as a table (word): tokens are joined with it, whatever its size."""
    low = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 1)
    base = pages.select(*keys, low.alias("w"), F.length(collapsed(F.coalesce(text, F.lit("")))).alias("chars"))
    counts = base.select(*keys, F.explode("w").alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n"))
    good = counts.join(vocabulary.select("word").distinct(), "word").groupBy(*keys).agg(F.sum("n").alias("good"), F.count("*").alias("unique"))
    out = base.select(*keys, F.size("w").alias("tokens"), "chars").join(good, keys, "left")
    return out.select(*keys, "tokens", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("unique", F.lit(0)).alias("unique"), (F.coalesce("good", F.lit(0)) / F.greatest("tokens", F.lit(1))).alias("ratio"), "chars")


def suspect(status: Column, quality: Column) -> Column:
    """Why a page should be read anew; null if it should not."""
    poor = ((quality["tokens"] >= 10) & (quality["ratio"] < 0.5)) | ((quality["chars"] > 200) & (quality["tokens"] < 10))
    return F.when(status.isin("empty", "ocr", "junk"), status).when(poor, "poor-text-layer")


def valid_overlay(overlay: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Accepted rows of an overlay count only for the file (time and size) that they were made from; others stay."""
    f = files.select(key, F.struct("mtime", "size").alias("_f"))
    same = F.struct(F.col("mtime"), F.col("size")).eqNullSafe(F.col("_f"))
    return overlay.join(f, key, "left").where(~F.coalesce("accepted", F.lit(False)) | same).drop("_f")


def grounded_share(title: Column, source: Column, allowed: tuple[str, ...] = ()) -> Column:
    """Share of the title's words that the source has: the word, its first four letters, or a word that it begins."""
    own = F.filter(F.regexp_extract_all(F.lower(title), F.lit("([a-z]{3,})"), 1), lambda w: ~w.isin("the", "and", "for", "with", "from", *allowed))
    there = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(source, F.lit(""))), F.lit("([a-z]+)"), 1))
    hit = lambda w: F.exists(there, lambda s: (s == w) | s.startswith(w) | ((F.length(w) >= 4) & (F.length(s) >= 4) & (F.substring(s, 1, 4) == F.substring(w, 1, 4))))
    return F.when(F.size(own) == 0, 1.0).otherwise(F.size(F.filter(own, hit)) / F.size(own))


def title_flags(title: Column, summary: Column, folder: Column, confidence: Column, source: Column) -> Column:
    """What is wrong with a title and summary; without a title that alone."""
    t, s, f = (F.trim(F.coalesce(c, F.lit(""))) for c in (title, summary, folder))
    n = lambda c: F.size(words(c))
    bare = F.trim(F.lower(t), F.lit(" ."))
    flag = lambda c, name: F.when(c, F.lit(name))
    out = F.array_compact(F.array(
        flag(t.rlike(PLACEHOLDER), "placeholder-title"), flag(n(t) < 3, "short-title"), flag(n(t) > 12, "long-title"),
        flag((f != "") & ((bare == F.lower(f)) | (bare == F.concat(F.lit("folder "), F.lower(f)))), "title-is-folder-label"),
        flag(t.rlike(DESCRIBES) | s.rlike(DESCRIBES), "describes-excerpt"), flag(t.rlike(JUNK) | s.rlike(JUNK), "format-junk"),
        flag(s == "", "no-summary"), flag((s != "") & (n(s) < 6), "short-summary"), flag((s != "") & (n(s) >= 6) & (F.lower(s) == F.lower(t)), "summary-repeats-title"),
        flag(s.rlike(TRUNCATED), "truncated-summary"), flag(F.coalesce(confidence, F.lit(0.0)) < 0.35, "low-confidence"), flag(grounded_share(t, source) < 0.5, "weak-grounding"),
    ))
    return F.when(t == "", F.array(F.lit("untitled"))).otherwise(out)


def names_a_person(label: Column) -> Column:
    """A label in the shape of a person's name. Rather one too many than one too few."""
    t = F.trim(F.coalesce(label, F.lit("")))
    # Each two neighbouring capitalised words, also where pairs overlap.
    pair = F.regexp_extract_all(t, F.lit(CAPITAL_PAIR), 1)
    word = lambda p, i: F.lower(F.get(F.split(p, r"\s+"), F.lit(i)))
    personal = F.exists(pair, lambda p: ~((word(p, 0).isin(*PLACES) & word(p, 1).isin(*PLACES)) | word(p, 0).isin(*BODIES, "broadway") | word(p, 1).isin(*BODIES, "broadway")))
    lone = t.rlike(LONE_NAME) & ~F.lower(t).isin(*PLACES, *BODIES, *PLAIN, *ACRONYMS)
    return (t != "") & (t.rlike(LAST_FIRST) | t.rlike(INITIAL_NAME) | personal | lone)


def is_portal_mark(label: Column) -> Column:
    """The line that the portal puts on every page, which is no title."""
    return F.coalesce(label.rlike(PORTAL), F.lit(False))


def accepted_reading(original: Column, candidates: Column, vocabulary: Column) -> Column:
    """The text of the best reading of a page that may replace its own; null if none may.

    original: text. candidates: array of (engine, text). A reading has 15 tokens or more,
    65 of 100 known, 10 different ones, and another engine has 10 of its known words. It
    has more known words than the page's own text, by 8 and by a fifth at least, or 9 of 10 of
    them and a share of known ones that is .2 higher. A text that was readable, or that has
    five decimals, loses no decimal. The best has most known words times their share; of
    equals the first.
    """
    from .windows import multiset_overlap

    known = lambda t: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(t), F.lit(WORD), 1), lambda w: F.array_contains(vocabulary, w)))
    decimals = lambda t: F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"(\d+\.\d+)"), 1)
    own, n = lexical_quality(original, vocabulary), F.size(decimals(original))
    read = F.transform(candidates, lambda c, i: F.struct(i.alias("i"), c["engine"].alias("engine"), c["text"].alias("text"), lexical_quality(c["text"], vocabulary).alias("q"), known(F.coalesce(c["text"], F.lit(""))).alias("w")))

    def may(c: Column) -> Column:
        q = c["q"]
        borne_out = F.exists(read, lambda o: (o["i"] != c["i"]) & (F.size(F.array_intersect(o["w"], c["w"])) >= 10))
        more = (q["good"] >= own["good"] + 8) & (q["good"] >= own["good"] * 1.2)
        cleaner = (q["good"] >= own["good"] * 0.9) & (q["ratio"] >= own["ratio"] + 0.2)
        strict = ((own["ratio"] >= 0.65) & (own["good"] >= 15)) | (n >= 5)
        return (q["tokens"] >= 15) & (q["ratio"] >= 0.65) & (q["unique"] >= 10) & borne_out & (more | cleaner) & (~strict | (multiset_overlap(decimals(original), decimals(c["text"])) >= n))

    best = F.array_max(F.transform(F.filter(read, may), lambda c: F.struct((c["q"]["good"] * c["q"]["ratio"]).alias("score"), (-c["i"]).alias("i"), c["text"].alias("text"))))
    return best["text"]


def excerpt_page(first: Column, second: Column, least: int = 200, most: int = 1500) -> Column:
    """Page 1 if it says enough and is no separator sheet, else page 2, else page 1."""
    one, two = F.coalesce(first, F.lit("")), F.coalesce(second, F.lit(""))
    good = (F.length(one) >= least) & ~one.rlike(BLOCK_LOT)
    return F.substring(F.when(good | (two == ""), one).otherwise(two), 1, most)


def separator_title(folder: Column) -> Column:
    """The address at the head of a separator sheet's label."""
    head = F.trim(F.regexp_replace(F.coalesce(folder, F.lit("")), "(?s)" + BLOCK_LOT + ".*$", ""), F.lit(" -–—;,"))
    return F.when(head == "", "Folder cover sheet").otherwise(F.concat(F.lit("Folder cover sheet — "), title_case(head)))


def count_sheet_title(text: Column) -> Column:
    """Medium, group and sample of a count sheet."""
    medium = F.when(F.substring(text, 1, 400).rlike(SHEET_DUST), "dust").otherwise("air")
    group = F.nullif(F.regexp_extract(text, SHEET_GROUP, 1), F.lit(""))
    sample = F.nullif(F.regexp_extract(text, SHEET_SAMPLE, 1), F.lit(""))
    tail = F.concat(F.lit(", lab group "), group, F.coalesce(F.concat(F.lit(", sample "), sample), F.lit("")))
    return F.concat(F.lit("TEM asbestos "), medium, F.lit(" count sheet"), F.coalesce(tail, F.lit("")))


def page_of_words(rows: DataFrame, page: list[str]) -> DataFrame:
    """Text and mean confidence of a page from rows of words (block, paragraph, line, n, text, conf), lines in the order in which they begin."""
    line = rows.where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy(*page, "block", "paragraph", "line").agg(
        F.min("n").alias("at"), F.sort_array(F.collect_list(F.struct("n", "text"))).alias("w"), F.sum(F.when(F.col("conf") >= 0, F.col("conf"))).alias("c"), F.count_if(F.col("conf") >= 0).alias("k"))
    made = line.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct("at", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("t")))).alias("lines"), F.sum("c").alias("c"), F.sum("k").alias("k"))
    return made.select(*page, F.array_join(F.transform("lines", lambda x: x["t"]), "\n").alias("text"), F.when(F.col("k") > 0, F.bround(F.col("c") / F.col("k"), 2)).alias("conf"))


def clipped(boxes: Column, width: Column, height: Column) -> Column:
    """Boxes (x0, y0, x1, y1, text) within the page; those without an area go."""
    to = lambda v, most: F.greatest(F.lit(0.0), F.least(most.cast("double"), v.cast("double")))
    inside = F.transform(boxes, lambda b: F.struct(to(b["x0"], width).alias("x0"), to(b["y0"], height).alias("y0"), to(b["x1"], width).alias("x1"), to(b["y1"], height).alias("y1"), b["text"].alias("text")))
    return F.filter(inside, lambda b: (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]))
