"""Quality rules with adaptive thresholds, in DataFrame operations alone.

Per document a few rates; per language and source a mergeable quantile sketch of each
rate; from it a fence; then the filter joins a document with the fences of its group.

The sketch counts values in logarithmic buckets: bucket b holds (G^(b-1), G^b], so a
quantile is right within G whatever the data, a sketch has some hundred buckets, and two
merge by adding counts. Hence partial aggregation merges them before the shuffle, a hot
source is no harder than another, and the sketches of a language are the sums of those
of its sources, not another scan.

A fence is Tukey's, on the logarithms: SPREAD times the distance of the quartiles above
the upper one; that distance is known to one bucket and taken at its most. No rate has a
cutoff of its own. Shares of a text are taken as
(count + 1) / (size + 2), the rule of succession: a share of 0 in a short text says less
than in a long one, so the quartiles differ even where most counts are 0. The quartiles
of a group are weighed with those of its language, and these with those of all, by the
numbers of documents, PRIOR standing for the wider group; so a small group leans on
others and no number of rows switches anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import Shared, columns

#: Growth from bucket to bucket.
G = 1.02
#: Distances of the quartiles that a fence stands above the upper one; Tukey's bound of what is far out.
SPREAD = 3.0
#: Documents for which the quartiles of the wider group count.
PRIOR = 25
RATES = ("symbol_rate", "repeat_rate", "dup_line_rate", "word_length")
BLANK = "[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of a text; null has no words.

    The windows of three words are hashed to 64 bits; where a text has equal hashes, their
    numbers are sorted by hash and neighbours compared, so the time is n log n for any
    text, and the row never leaves its task. Equal hashes count as equal windows: in a text
    of n words two others collide with probability n^2 / 2^65.
    """
    text = F.coalesce("text", F.lit(""))
    one = columns(docs, "doc_id", "text", "lang", "source").select(
        "doc_id", "lang", "source",
        F.filter(F.split(text, BLANK + "+"), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda s: F.translate(s, " \t\n\x0b\x0c\r", "") != "").alias("lines"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    n = F.greatest(F.size("words") - 2, F.lit(0))
    two = one.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(
            F.arrays_zip(F.slice("words", 1, n).alias("a"), F.slice("words", 2, n).alias("b"), F.slice("words", 3, n).alias("c")),
            lambda x: F.xxhash64(x["a"], x["b"], x["c"]),
        ).alias("grams"),
    )
    repeats = F.size("grams") > F.size(F.array_distinct("grams"))
    three = two.withColumn("ranked", F.when(repeats, F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    m = F.size("ranked")
    pairs = F.arrays_zip(F.slice("ranked", 1, m - 1).alias("a"), F.slice("ranked", 2, m - 1).alias("b"))
    twice = F.flatten(F.transform(F.filter(pairs, lambda x: x["a"]["h"] == x["b"]["h"]), lambda x: F.array(x["a"]["i"], x["b"]["i"])))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))
    return three.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.when(F.col("ranked").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
    )


def _rates(df: DataFrame) -> DataFrame:
    """The buckets of the rates."""
    share = lambda a, b: (F.col(a) + 1) / (F.col(b) + 2)
    rates = {
        "symbol_rate": share("n_symbols", "word_chars"),
        "repeat_rate": share("n_repeat_words", "n_words"),
        "dup_line_rate": share("n_dup_lines", "n_lines"),
        "word_length": F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
    }
    # Without words there is no word length; such a text fails the base rules.
    return df.withColumns({r: F.when(x > 0, F.ceil(F.log(x) / F.log(F.lit(G)))).cast("int") for r, x in rates.items()})


def sketches(rates: DataFrame) -> DataFrame:
    """lang, source, rate, bucket and n: the sketches of every language and source."""
    long = rates.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(r).alias("rate"), F.col(r).alias("bucket")) for r in RATES))).alias("x"))
    return long.groupBy("lang", "source", "x.rate", "x.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    return sketch.groupBy(*by, "rate", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *by: str) -> DataFrame:
    """Per group and rate: rows, and the buckets of the quartiles. Windows run over the buckets of one sketch."""
    own = Window.partitionBy(*by, "rate")
    run = own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = sketch.withColumns({"upto": F.sum("n").over(run), "rows": F.sum("n").over(own)})
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("rows") * q, F.col("bucket"))).cast("double")
    return upto.groupBy(*by, "rate", "rows").agg(at(0.25).alias("q25"), at(0.75).alias("q75"))


def _weighed(own: DataFrame, wider: DataFrame, *on: str) -> DataFrame:
    """The quartiles of ``own``, by its rows, with those of ``wider``, by PRIOR."""
    o, w = own.alias("o"), wider.alias("w")
    mix = lambda q: ((F.col("rows_o") * F.col(f"o.{q}") + PRIOR * F.col(f"w.{q}")) / (F.col("rows_o") + PRIOR)).alias(q)
    same = F.col("o.rate") == F.col("w.rate")
    for c in on:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"w.{c}"))
    by = [c for c in own.columns if c not in ("rate", "rows", "q25", "q75")]
    return o.withColumnRenamed("rows", "rows_o").join(w, same).select(*(F.col(f"o.{c}") for c in by), F.col("o.rate"), F.col("rows_o").alias("rows"), mix("q25"), mix("q75"))


def fences(sketch: DataFrame) -> DataFrame:
    """g_lang, g_source and fences (rate to bucket) of every language and source."""
    every = quartiles(merged(sketch))
    lang = _weighed(quartiles(merged(sketch, "lang"), "lang"), F.broadcast(every))
    own = _weighed(quartiles(sketch, "lang", "source"), lang, "lang")
    fence = F.col("q75") + SPREAD * (F.col("q75") - F.col("q25") + 1)
    return own.groupBy(F.col("lang").alias("g_lang"), F.col("source").alias("g_source")).agg(F.map_from_entries(F.collect_list(F.struct("rate", fence.alias("fence")))).alias("fences"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept of every row.

    kept: base rules hold and no rate is above its fence. A null or empty text has no
    words and fails the base rules. Null languages and sources are groups like others.
    Repeated rows count each; null ids stay. Very long texts stay in their row. An empty
    table gives an empty table. Only the counts, some 80 bytes a row, are kept between
    the two passes; what is shuffled is a bounded sketch per group and task.
    """
    shared = Shared(docs.sparkSession)
    rows = _rates(shared.keep(measured(docs)))
    best = fences(shared.keep(sketches(rows.where(~_failed()))))
    # Sketches see rows that pass the base rules; only these need a fence.
    joined = rows.join(best, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    over = F.lit(False)
    for r in RATES:
        over = over | (F.col(r) > F.coalesce(F.col("fences")[r], F.lit(float("inf"))))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _failed().alias("base_failed"), (~_failed() & ~over).alias("kept"))


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
