"""Full-text search (X1-X17): postings, BM25, fusion, facets, excerpts, terms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Shared

K1, B = 1.2, 0.75
# Stop words of the analyser, and the wider list for questions.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such",
    "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
NOISE_WORDS = (*STOP_WORDS, "do", "does", "did", "can", "could", "should", "would", "what", "who", "whom", "why", "how", "when", "where", "which", "like", "you", "your", "i", "me", "my", "we")
QUESTION_WORDS = (
    "do", "does", "did", "is", "are", "was", "were", "can", "could", "should", "would", "will", "what", "who", "whom", "why", "how",
    "when", "where", "which", "like", "you", "your", "i", "me", "my", "we",
)


def tokens(c: Column) -> Column:
    """Lower-case runs of two ASCII letters or digits and more."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]{2,})"), 1)


def content_terms(query: str) -> list[str]:
    """The query's words without edge punctuation and noise; empty says that there is nothing to search."""
    bare = (w.strip("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())) for w in query.split())
    return [w for w in bare if w and w.lower() not in NOISE_WORDS]


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, len) of all rows with a token."""
    t = df.select(F.col(key), tokens(F.col(text)).alias("t")).withColumn("len", F.size("t"))
    return t.select(key, "len", F.explode("t").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def bm25(df: DataFrame, key: str, text: str, query: list[str]) -> DataFrame:
    """(key, score) of rows with any of the terms; idf = ln(1 + (n - df + .5) / (df + .5)).

    One scan: what is kept of a row is its number of tokens and those of the query, a table
    that is small against the texts; totals and scores are read from it, and only one row of
    totals is shuffled. Rows without tokens count neither for n nor for the mean length.
    """
    terms = sorted({w.lower() for w in query})
    t = df.select(F.col(key), tokens(F.col(text)).alias("t"))
    hits = Shared(df.sparkSession).keep(t.select(key, F.size("t").alias("len"), F.filter("t", lambda x: x.isin(*terms)).alias("q")))
    tf = [(F.size("q") - F.size(F.array_remove("q", F.lit(w)))).alias(f"tf{i}") for i, w in enumerate(terms)]
    rows = hits.where("len > 0").select(key, "len", *tf)
    totals = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    joined = rows.where(sum((F.col(f"tf{i}") for i in range(len(terms))), F.lit(0)) > 0).crossJoin(F.broadcast(totals))
    def part(i: int) -> Column:
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        return idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return joined.select(key, sum((part(i) for i in range(len(terms))), F.lit(0.0)).alias("score"))


def best_field(arms: list[tuple[DataFrame, float]], key: str) -> DataFrame:
    """The best weighted score of several fields."""
    out = None
    for df, weight in arms:
        arm = df.select(key, (F.col("score") * weight).alias("score"))
        out = arm if out is None else out.union(arm)
    return out.groupBy(key).agg(F.max("score").alias("score"))


def ranked(df: DataFrame, key: str, pool: int) -> DataFrame:
    """The best ``pool`` rows with their rank from 1; ties by key."""
    head = df.orderBy(F.desc("score"), key).limit(pool)
    return head.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def reciprocal_ranks(arms: list[DataFrame], key: str, pool: int, k: int = 60, exact: DataFrame | None = None) -> DataFrame:
    """Sum of 1 / (k + rank) over the arms; an exact hit starts at 1."""
    out = None
    for df in arms:
        arm = ranked(df, key, pool).select(key, (1 / (k + F.col("rank"))).alias("part"))
        out = arm if out is None else out.union(arm)
    if exact is not None:
        out = out.union(exact.select(key, F.lit(1.0)))
    return out.groupBy(key).agg(F.sum("part").alias("score"))


def weighted_scores(arms: list[tuple[DataFrame, float]], key: str, pool: int) -> DataFrame:
    """Each arm's best ``pool`` scores from 0 to 1 by minimum and maximum, then the weighted mean.

    An arm without the row gives 0 and keeps its weight. An arm of equal scores gives 1.
    """
    out, total = None, sum(w for _, w in arms)
    for df, weight in arms:
        head = df.orderBy(F.desc("score"), key).limit(pool)
        ends = head.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
        part = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
        arm = head.crossJoin(F.broadcast(ends)).select(key, (part * weight / total).alias("part"))
        out = arm if out is None else out.union(arm)
    return out.groupBy(key).agg(F.sum("part").alias("score"))


def gated(semantic: DataFrame, lexical: DataFrame, bypass: bool = False) -> DataFrame:
    """The semantic arm only where the lexical one has any hit."""
    if bypass:
        return semantic
    return semantic.crossJoin(F.broadcast(lexical.limit(1).select(F.lit(1).alias("_hit")))).drop("_hit")


def facets(df: DataFrame, fields: list[str], most: int = 15) -> DataFrame:
    """X/A26, F16: (field, value, n, rank): the most frequent values of each field, ties by value; of arrays each element once a row.

    All fields are counted in one scan and one shuffle.
    """
    def values(f: str) -> Column:
        c = F.col(f)
        one = F.array_distinct(F.transform(c, lambda x: x.cast("string"))) if df.schema[f].dataType.typeName() == "array" else F.array(c.cast("string"))
        return F.transform(F.filter(one, lambda x: x.isNotNull()), lambda x: F.struct(F.lit(f).alias("field"), x.alias("value")))
    long = df.select(F.explode(F.flatten(F.array(*map(values, fields)))).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    return long.withColumn("rank", rank).where(F.col("rank") <= most)


def excerpt(text: Column, terms: list[str], size: int = 900, hits: int | None = None) -> Column:
    """X11: the window around a hit that has the most distinct terms, the earliest of equals; no hit: the start.

    All hits are looked at; ``hits`` gives the source's limit of so many, in order of the terms.
    """
    clean = [t.strip().lower() for t in terms if t.strip()]
    if not clean:
        return F.substring(text, 1, size)
    # Values that lambdas read are bound as variables, else each call makes them anew.
    bound = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))

    def best(x: Column) -> Column:
        def scored(s: Column) -> Column:
            b = F.floor((s - 1) / F.lit(size)).cast("int")
            window = F.substring(F.concat(F.get(x["blocks"], b), F.coalesce(F.get(x["blocks"], b + 1), F.lit(""))), s - b * size, F.lit(size))
            return bound(window, lambda w: F.struct((-sum((F.contains(w, F.lit(t)).cast("int") for t in clean), F.lit(0))).alias("n"), s.alias("s")))

        def over(t: str, before: Column) -> Column:
            # The text parted before each hit, overlapping ones too; no part begins at the first character but the first. Only the best window so far is kept.
            def step(a: Column, p: Column) -> Column:
                hit = (a["at"] > 1) | F.startswith(x["low"], F.lit(t))
                looked = hit if hits is None else hit & (a["seen"] < hits)
                top = F.when(looked, F.least(a["top"], bound(F.greatest(F.lit(1), a["at"] - size // 2), scored))).otherwise(a["top"])
                return F.struct((a["at"] + F.length(p)).alias("at"), (a["seen"] + hit.cast("int")).alias("seen"), top.alias("top"))
            # Starts anew at the text's first character, with what the terms before have left.
            return F.aggregate(F.split(x["low"], f"(?={re.escape(t)})", -1 if hits is None else hits + 1), before, step, lambda a: F.struct(F.lit(1).alias("at"), a["seen"].alias("seen"), a["top"].alias("top")))

        out = F.struct(F.lit(1).alias("at"), F.lit(0).alias("seen"), F.lit(None).cast("struct<n:int,s:int>").alias("top"))
        for t in clean:
            out = over(t, out)
        return out["top"]["s"]

    # Blocks of the window's size are cut once, so a window costs its own length.
    parts = lambda low: F.struct(low.alias("low"), F.regexp_extract_all(low, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("blocks"))
    return F.substring(text, F.coalesce(bound(bound(F.lower(text), parts), best), F.lit(1)), F.lit(size))


def tfidf(df: DataFrame, key: str, text: str, *, most_share: float = 0.5) -> DataFrame:
    """(key, term, weight): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), of unit length a row.

    Terms in fewer than min(3, max(1, n // 50)) rows or in more than ``most_share`` of them go.
    """
    # Written once: document frequencies, weights and lengths all read the postings.
    p = Shared(df.sparkSession).keep(postings(df, key, text).select("term", key, "tf"))
    n = df.agg(F.count("*").alias("n"))
    dfs = p.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    dfs = dfs.where((F.col("df") >= F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.col("n") / 50)))) & (F.col("df") <= most_share * F.col("n")))
    w = p.join(dfs, "term").select(key, "term", ((1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.select(key, "term", (F.col("w") / norm).alias("weight"))


def distinctive(weights: DataFrame, rows: DataFrame, key: str, group: str, most: int) -> DataFrame:
    """Per group the terms whose mean weight is most above the mean of all; absent weights are 0."""
    n = rows.groupBy(group).agg(F.count("*").alias("n_group"))
    total = rows.agg(F.count("*").alias("n_all"))
    own = weights.join(rows.select(key, group), key).groupBy(group, "term").agg(F.sum("weight").alias("s"))
    all_ = own.groupBy("term").agg(F.sum("s").alias("s_all"))
    lift = own.join(n, group).join(all_, "term").crossJoin(F.broadcast(total)).withColumn("lift", F.round(F.col("s") / F.col("n_group") - F.col("s_all") / F.col("n_all"), 9))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("lift"), "term"))
    return lift.select(group, "term", "lift").withColumn("rank", rank).where(F.col("rank") <= most)


def stems(word: Column) -> Column:
    """The word and what it may be the plural of."""
    return F.array_compact(F.array(word, F.when(word.endswith("ies"), F.concat(F.substring(word, F.lit(1), F.length(word) - 3), F.lit("y"))), F.when(word.endswith("es"), F.substring(word, F.lit(1), F.length(word) - 2)), F.when(word.endswith("s"), F.substring(word, F.lit(1), F.length(word) - 1))))


def route(query: Column) -> Column:
    """Id, keyword or model. A keyword query has 1 to 4 words, no question mark and no question word, nor one an edit away."""
    q = F.trim(query)
    bare = F.filter(F.transform(F.split(q, r"\s+"), lambda w: F.lower(F.regexp_replace(w, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))), lambda w: w != "")

    def close(w: Column) -> Column:
        def one(f: str) -> Column:
            # One edit; a swap of neighbours is two for Levenshtein, on equal letters in equal number.
            swap = (F.levenshtein(w, F.lit(f)) == 2) & F.array(*(F.lit(f[:i] + f[i + 1] + f[i] + f[i + 2 :]) for i in range(len(f) - 1))).isNotNull() & w.isin(*(f[:i] + f[i + 1] + f[i] + f[i + 2 :] for i in range(len(f) - 1)))
            return (F.levenshtein(w, F.lit(f)) <= 1) | swap
        return w.isin(*QUESTION_WORDS) | ((F.length(w) >= 3) & F.array_contains(F.array(*(one(f) for f in QUESTION_WORDS if len(f) >= 3)), True))

    keyword = ~q.contains("?") & F.size(bare).between(1, 4) & ~F.exists(bare, close)
    return F.when(q == "", "keyword").when(q.rlike(r"^\d{6,9}$"), "id").when(keyword, "keyword").otherwise("model")


def citations_hold(cited: Column, retrieved: Column) -> Column:
    """There are citations, and all are of what was retrieved."""
    return (F.size(cited) > 0) & (F.size(F.array_except(cited, retrieved)) == 0)


def lookup_first(exact: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The row of an exact id before what was found; scores of found rows are below 1e9."""
    return exact.select(key, F.lit(1e9).alias("score")).union(found.select(key, "score")).groupBy(key).agg(F.max("score").alias("score"))


def or_unfiltered(filtered: DataFrame, every: DataFrame) -> DataFrame:
    """The filtered rows, or all of them if the filters leave none."""
    some = filtered.limit(1).select(F.lit(True).alias("_some")).agg(F.count("*").alias("_n"))
    rest = every.crossJoin(F.broadcast(some)).where("_n = 0").drop("_n")
    return filtered.withColumn("relaxed", F.lit(False)).unionByName(rest.withColumn("relaxed", F.lit(True)))


def hidden_rows(matches: DataFrame, shown: Column) -> DataFrame:
    """How many matches the filters hide."""
    return matches.agg(F.count_if(~F.coalesce(shown, F.lit(False))).alias("hidden"))


def more_like(weights: DataFrame, key: str, of: object, most_terms: int = 25, most: int = 10) -> DataFrame:
    """Rows that share the heaviest terms of one row, by the dot product over these terms."""
    own = weights.where(F.col(key) == of).orderBy(F.desc("weight"), "term").limit(most_terms).select("term", F.col("weight").alias("_w"))
    scored = weights.where(F.col(key) != of).join(F.broadcast(own), "term").groupBy(key).agg(F.round(F.sum(F.col("weight") * F.col("_w")), 9).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(most)


def highlighted(text: Column, terms: list[str], size: int = 220, before: str = "<mark>", after: str = "</mark>") -> Column:
    """One excerpt with the terms marked; everything else is HTML-escaped."""
    from ..functions.text import html_escaped

    clean = sorted({t.strip() for t in terms if t.strip()}, key=lambda t: (-len(t), t))
    piece = html_escaped(excerpt(text, clean, size))
    if not clean:
        return piece
    # Java's replacement text: $0 is the whole match.
    pattern = "(?i)(?<![A-Za-z0-9&])(?:" + "|".join(re.escape(t) for t in clean) + ")(?![A-Za-z0-9])"
    return F.regexp_replace(piece, pattern, before + "$0" + after)
