"""Text, dates and distances."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from archivolt.functions import dates as D
from archivolt.functions import text as T
from archivolt.functions.distance import folded, match_tier, one_edit, osa, tier, weighted

WORD = st.text("ABCEIL1T", max_size=8)


def table_osa(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


@given(WORD, WORD)
@settings(max_examples=300, deadline=None)
def test_distance(a, b):
    assert osa(a, b) == table_osa(a, b) == osa(b, a)
    assert osa(a, b, lambda x, y: 0.0 if x == y else 0.5) <= osa(a, b)
    assert one_edit(a, b) == (table_osa(a, b) <= 1)


def test_distances_of_readings():
    assert osa("CA", "ABC") == 3
    assert folded("LAFAYETTE") == folded("LAFAYEITE") == "LAFAYETE"
    assert weighted("LABETTE", "LAFAYETTE") == 3.0
    assert tier("LABETTE", "LAFAYETTE")[0] == 2
    assert tier("WARREN", "WALKER") is None
    assert tier("EAST 45", "EAST 4") is None
    assert tier("CHAMBERS", "CHAMBRES") == (1, 1)
    assert tier("FRONT", "FRONY") is None and tier("FRONT", "FRONT") == (0, 0.0)


def test_tier_column(spark):
    df = spark.createDataFrame([("CHAMBERS", "CHAMBRES"), ("FRONT", "WATER"), (None, "X")], "a string, b string")
    got = [r["m"]["tier"] if r["m"] else None for r in df.select(match_tier("a", "b").alias("m")).collect()]
    assert got == [1, None, None]


def one(spark, value, made, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(made(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(("made", "value", "want"), [
    (T.street, "St Nicholas Ave.", "ST NICHOLAS AVENUE"), (T.street, "w. 45th st", "WEST 45 STREET"), (T.street, "", ""),
    (T.slug, "A & B, Inc.", "a-b-inc"), (T.slug, "!!!", "x"), (T.title_case, "A'B'C ASSOCIATES W 45", "A'B'C Associates W 45"),
    (T.collapsed, " a \n b ", "a b"), (T.house_number, "12-14 Front St", "12-14"), (T.after_house_number, "12-14 Front St", "Front St"),
    (T.street_type, "WEST BROADWAY", None), (T.street_name, "CHAMBERS STREET", "CHAMBERS"), (T.path_segment, None, "~"), (T.path_segment, "", "~e"),
    (T.path_segment, "..", "~dd"), (T.html_text, "<p>a&amp;lt;b<script>x</script> <b>c</b></p>", "a&lt;b c"), (T.org, "  Smith,  Jones & ", "SMITH JONES"),
    (T.html_escaped, "<a & 'b'>", "&lt;a &amp; &#39;b&#39;&gt;"), (lambda c: T.clamp_chars(c, 9), "one two three", "one two"), (lambda c: T.clamp_words(c, 2), "a b c", "a b"),
    (lambda c: T.redacted_names(c, ("North", "Tower")), "John Smith saw North Tower", "[name] saw North Tower"),
])
def test_text(spark, made, value, want):
    assert one(spark, value, made) == want


def test_orgs(spark):
    df = spark.createDataFrame([("Smith & Jones Labs.",), ("ACME",), ("",)], "v string")
    name, ending = T.org_parts(F.col("v"), "lab")
    assert [tuple(r) for r in df.select(name, ending).collect()] == [("SMITH AND JONES", "Laboratory"), ("ACME", ""), ("", "")]


@pytest.mark.parametrize(("value", "want"), [("1/2/02", "2002-01-02"), ("12/31/1999", "1999-12-31"), ("2/30/2001", None), ("1/1/51", None), ("x", None), (None, None)])
def test_us_dates(spark, value, want):
    assert one(spark, value, D.us_date) == want


def test_codes(spark):
    df = spark.createDataFrame([(58159, 12), (0, 1)], "n long, p int").withColumn("code", T.short_code(F.col("n"), F.col("p")))
    key, page = T.from_short_code(F.col("code"))
    assert [tuple(r) for r in df.select(key, page).collect()] == [("000058159", 12), ("000000000", 1)]


def test_codes_of_numbers_beyond_nine_digits(spark):
    df = spark.createDataFrame([(9502792081, 12), (7919, None), (None, 3)], "n long, p int").withColumn("code", T.short_code(F.col("n"), F.col("p")))
    key, page = T.from_short_code(F.col("code"))
    assert [tuple(r) for r in df.select(key, page).collect()] == [("9502792081", 12), ("000007919", None), (None, None)]


def test_short_codes_of_large_keys(spark, tmp_path):
    from archivolt.plans import QUERIES

    keys = [0, 126278, 126279, 1199999, 2_000_000_000_001, None]
    spark.createDataFrame([(k, i if i else None) for i, k in enumerate(keys)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["short_codes"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((k, k) for k in keys), key=str)


def test_pages_and_columns(spark):
    assert one(spark, "a\fb\f \n", T.pages_of) == ["a", "b"]
    assert one(spark, " a b   c  d ", T.columns_of) == ["a b", "c", "d"]
    df = spark.createDataFrame([("abcdef",)], "v string")
    piece, nxt = T.text_slice(F.col("v"), 2, 3)
    assert tuple(df.select(piece, nxt).first()) == ("cde", 5)
    piece, nxt = T.text_slice(F.col("v"), 3, 3)
    assert tuple(df.select(piece, nxt).first()) == ("def", None)
