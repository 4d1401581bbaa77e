"""Operators on small tables made by hand."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from archivolt.operators import aggregates as A
from archivolt.operators import extract as E
from archivolt.operators import filters as P
from archivolt.operators import joins as J
from archivolt.operators import resolve as R
from archivolt.operators import search as X
from archivolt.operators import sequences as S
from archivolt.operators import vectors as V
from archivolt.operators import versions as H
from archivolt.operators import windows as W

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- filters ----------------------------------------------------------------------


def test_predicates(spark):
    df = spark.createDataFrame([(None, ["2001-02-03", "bad"], "Mozilla"), ("removed", ["2002-01-01"], " "), ("present", [], "Googlebot/2")], "s string, d array<string>, ua string")
    assert rows(df.select(P.active(F.col("s")), P.any_date_in(F.col("d"), "2001-01-01", "2002-01-01"), P.is_bot(F.col("ua")))) == [(False, False, True), (True, False, True), (True, True, False)]
    days = spark.createDataFrame([("2001-02-28",), ("x",)], "d string")
    assert rows(days.select(P.day_after(F.col("d")))) == [("2001-03-01",), (None,)]
    words = spark.createDataFrame([("DEP",), ("deposit",), ("Dep. of x",)], "w string")
    assert rows(words.select("w", P.whole_words(F.col("w"), "dep"), P.loose(F.col("w"), "dep"))) == [("DEP", True, True), ("Dep. of x", True, True), ("deposit", False, True)]
    score, keep = P.penalised(F.col("w").substr(1, 0).cast("string").isNotNull().cast("double"), F.col("w"), "DEP", True)
    assert rows(words.select("w", score, keep))[0] == ("DEP", 0.5, True)


# -- joins ------------------------------------------------------------------------


def test_either_key_does_not_fan_out(spark):
    left = spark.createDataFrame([("p1", "bbl", "7"), ("p2", "bin", "9"), ("p3", "bin", "0")], "id string, kind string, key string")
    right = spark.createDataFrame([(7, 9, "a"), (8, 9, "b")], "bbl int, bin int, address string")
    assert rows(J.either_key(left, right, "kind", "key", {"bbl": "bbl", "bin": "bin"}, ["address"])) == [("p1", "bbl", "7", "a"), ("p2", "bin", "9", "a"), ("p3", "bin", "0", None)]


def test_nearest_takes_the_earlier_of_equals(spark):
    df = spark.createDataFrame([(100, [(90, "x"), (110, "y")]), (600, [(90, "x")]), (5, [])], "p int, c array<struct<start:int,n:string>>")
    assert [r[0] for r in df.select(J.nearest(F.col("p"), F.col("c"), 400)["n"]).collect()] == ["x", None, None]


@SLOW
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 40)), max_size=12), st.lists(st.integers(0, 340), max_size=12, unique=True))
def test_ranges(spark, spans, points):
    r = spark.createDataFrame([(i, a, a + w) for i, (a, w) in enumerate(spans)], "id int, lo long, hi long")
    p = spark.createDataFrame([(x,) for x in points], "v long")
    want = []
    for x in points:
        hit = sorted((a, a + w) for a, w in spans if a <= x <= a + w)
        want += [(x, *hit[0])] if hit else []
    assert rows(J.in_range(p, "v", r, "lo", "hi", 16).select("v", "lo", "hi")) == sorted(want, key=repr)


# -- aggregates -------------------------------------------------------------------


@SLOW
@given(st.lists(st.integers(0, 50) | st.none(), min_size=1, max_size=40))
def test_order_statistics(spark, values):
    s = sorted(v or 0 for v in values)
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = A.order_statistics(df, "v", {"m": A.lower_neighbour(0.5), "p": A.nearest_index(95)}).first()
    assert tuple(got) == (s[int(0.5 * (len(s) - 1))], s[min(len(s) - 1, int(0.95 * len(s)))])


def test_modal_prefers_what_came_first(spark):
    df = spark.createDataFrame([("g", "b", 2), ("g", "a", 3), ("g", "a", 9), ("g", "b", 8), ("g", None, 0)], "g string, v string, at int")
    assert rows(A.modal(df, ["g"], "v", "at")) == [("g", "b", 2)]
    assert rows(A.greatest_modal(df, ["g"], "v", "at")) == [("g", "a", 12)]


def test_tuple_distinct_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, 1)], "a int, b int")
    assert df.agg(F.countDistinct(F.struct("a", "b"))).first()[0] == 2


def test_coverage_and_mean(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], None), ("a", [0.0, 1.0], [1.0]), (None, [0.0, 0.0], [])], "g string, v array<double>, x array<double>")
    assert rows(A.coverage(df, "g", "x")) == [("g", 2), ("x", 1)]
    got = {r["g"]: r["v"] for r in A.mean_vector(df, ["g"], "v").collect()}
    assert got["a"] == pytest.approx([0.5**0.5] * 2) and got[None] == [0.0, 0.0]


# -- windows ----------------------------------------------------------------------


def test_slugs_pass_over_taken_numbers(spark):
    df = spark.createDataFrame([(1, "A"), (2, "a"), (3, "A!"), (4, "a-2"), (5, "b")], "k int, n string")
    got = {r["k"]: r["slug"] for r in W.slugs(df, "n", "k").collect()}
    assert got == {1: "a", 2: "a-3", 3: "a-4", 4: "a-2", 5: "b"}


def test_months(spark):
    d = dt.date
    df = spark.createDataFrame([("p", d(2001, 1, 1), 2), ("p", d(2001, 4, 1), 1), ("p", d(2003, 4, 1), 1)], "p string, month date, n long")
    got = [(str(r["month"]), r["n"], r["is_break"]) for r in W.month_series(df, ["p"]).orderBy("month").collect()]
    assert got == [("2001-01-01", 2, False), ("2001-02-01", 0, False), ("2001-03-01", 0, False), ("2001-04-01", 1, False), ("2001-05-01", None, True), ("2003-04-01", 1, False)]


def test_truncation_flag(spark):
    df = spark.range(6)
    assert {r["truncated"] for r in W.truncated(df, [F.col("id")], 5).collect()} == {True}
    assert {r["truncated"] for r in W.truncated(df, [F.col("id")], 6).collect()} == {False}


# -- versions ---------------------------------------------------------------------


def test_history(spark):
    s = lambda *r: spark.createDataFrame(list(r), "k string, f int")
    h = H.merged_history(None, s(("a", 1), ("b", 1)), "k", ["f"], "d1")
    h = H.merged_history(h, s(("a", 2)), "k", ["f"], "d2")
    h = H.merged_history(h, s(("a", 2), ("b", 1), ("c", None)), "k", ["f"], "d3")
    got = {r["k"]: r.asDict() for r in h.collect()}
    assert (got["a"]["changed_at"], got["a"]["changed_fields"], got["a"]["first_seen"]) == ("d2", ["f"], "d1")
    assert (got["b"]["status"], got["b"]["reappeared_at"], got["b"]["previously_removed_at"], got["b"]["removed_at"]) == ("present", "d3", "d2", None)
    assert (got["c"]["first_seen"], got["c"]["changed_at"]) == ("d3", None)
    gone = {r["k"]: r.asDict() for r in H.merged_history(h, s(("a", 2)), "k", ["f"], "d4").collect()}
    assert (gone["b"]["status"], gone["b"]["removed_at"], gone["b"]["last_seen"], gone["b"]["reappeared_at"]) == ("removed", "d4", "d3", "d3")


def test_diff_hides_values(spark):
    a = spark.createDataFrame([("x", 1, "s"), ("y", 1, None)], "k string, n int, secret string")
    b = spark.createDataFrame([("x", 2, "t"), ("y", 1, None), ("z", 1, "u")], "k string, n int, secret string")
    got = {r["k"]: r for r in H.diff(a, b, "k", ["n", "secret"], ["n"]).collect()}
    assert set(got) == {"x", "z"} and got["x"]["fields"] == ["n", "secret"]
    assert {k: tuple(v) for k, v in got["x"]["values"].items()} == {"n": ("1", "2")} and got["z"]["kind"] == "added"


def test_quarantine_compares_with_the_last_accepted(spark):
    df = spark.createDataFrame([("1", 100, 0), ("2", 80, 0), ("3", 95, 0), ("4", 90, 1), ("5", 0, 0), ("6", 91, 0)], "snapshot string, documents long, duplicates long")
    assert [bool(r["reasons"]) for r in sorted(H.quarantine(df).collect())] == [False, True, False, True, True, False]


# -- search -----------------------------------------------------------------------


def test_excerpt(spark):
    text = "x" * 50 + " alpha " + "y" * 100 + " alpha beta " + "z" * 50
    df = spark.createDataFrame([(text,), ("none here",), ("",)], "t string")
    got = [r[0] for r in df.select(X.excerpt(F.col("t"), ["alpha", "beta"], 40)).collect()]
    assert "alpha" in got[0] and "beta" in got[0] and len(got[0]) == 40
    assert got[1:] == ["none here", ""]


def brute_excerpt(text, terms, size, hits):
    low, starts = text.lower(), []
    clean = [t.strip().lower() for t in terms if t.strip()]
    for t in clean:
        at = low.find(t)
        while at >= 0 and len(starts) < hits:
            starts.append(at)
            at = low.find(t, at + 1)
    best, most = 0, -1
    for s in sorted(set(starts)):
        start = max(0, s - size // 2)
        n = sum(t in low[start : start + size] for t in clean)
        if n > most:
            best, most = start, n
    return text[best : best + size]


@given(st.lists(st.text("abAê.\n😀", max_size=60), min_size=1, max_size=8), st.sampled_from([["a"], ["aba", "b"], ["bb", "ê😀", "a.", "a."], ["\\E", " "]]), st.integers(1, 12), st.integers(1, 5))
@settings(max_examples=25, deadline=None)
def test_excerpt_as_by_brute_force(spark, texts, terms, size, hits):
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").coalesce(1)
    got = [r[0] for r in df.select(X.excerpt(F.col("t"), terms, size, hits)).collect()]
    assert got == [*(brute_excerpt(t, terms, size, hits) for t in texts), None]


def test_excerpt_of_long_texts_takes_time_in_proportion(spark):
    import time

    text = "lorem ipsum dolor sit amet é " * 12_000 + "alpha " + "x" * 100 + " beta alpha " + "y" * 200_000
    df = spark.createDataFrame([(text,), ("ab" * 200_000,)], "t string")
    began = time.time()
    got = [r[0] for r in df.select(X.excerpt(F.col("t"), ["alpha", "beta", "aba"], 300)).collect()]
    assert time.time() - began < 30
    assert got == [brute_excerpt(text, ["alpha", "beta", "aba"], 300, 200), ("ab" * 200_000)[:300]]


def test_excerpt_looks_at_all_hits(spark):
    import time

    # The best window lies behind 200 hits of the first term, the last term has only a hit behind 300 of the others, and hits by the hundred thousand.
    texts = ["alpha " * 300 + "- " * 50 + "alpha beta gamma end", "alpha " * 300 + "." * 90 + "gamma" + "." * 90 + "beta gamma end", "ab" * 200_000 + "alpha gamma"]
    terms = ["alpha", "aba", "beta", "gamma"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    began = time.time()
    got = [r[0] for r in df.select(X.excerpt(F.col("t"), terms, 40)).collect()]
    assert time.time() - began < 30
    assert got == [brute_excerpt(t, terms, 40, float("inf")) for t in texts]
    assert all(len({w for w in terms if w in g}) >= 2 for g in got)
    assert got[0].endswith("gamma end")


@given(st.lists(st.text("abAê.\n😀", max_size=60), min_size=1, max_size=8), st.sampled_from([["a"], ["aba", "b"], ["bb", "ê😀", "a.", "a."], ["a" * 9, "ab"]]), st.integers(1, 12))
@settings(max_examples=25, deadline=None)
def test_excerpt_of_all_hits_as_by_brute_force(spark, texts, terms, size):
    texts = [*texts, terms[0] * 201 + "." * size + "".join(texts)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = [r[0] for r in df.select(X.excerpt(F.col("t"), terms, size)).collect()]
    assert got == [brute_excerpt(t, terms, size, float("inf")) for t in texts]


@pytest.mark.parametrize(("query", "want"), [
    ("", "keyword"), ("123456", "id"), ("asbestos", "keyword"), ("fulton street air", "keyword"), ("what was found", "model"), ("wat caused it", "model"),
    ("wher testing", "model"), ("dust?", "model"), ("one two three four five", "model"), ("hwo knew", "model"), ("!!!", "model"),
])
def test_route(spark, query, want):
    assert spark.createDataFrame([(query,)], "q string").select(X.route(F.col("q"))).first()[0] == want


def test_terms_and_fusion(spark):
    assert X.content_terms("What is the dust (lead)?") == ["dust", "lead"]
    a = spark.createDataFrame([(1, 2.0), (2, 1.0)], "k int, score double")
    b = spark.createDataFrame([(2, 5.0), (3, 5.0)], "k int, score double")
    assert rows(X.weighted_scores([(a, 0.4), (b, 0.6)], "k", 10)) == [(1, 0.4), (2, 0.6), (3, 0.6)]
    got = dict(rows(X.reciprocal_ranks([a, b], "k", 10, exact=spark.createDataFrame([(9,)], "k int"))))
    assert got[9] == 1.0 and got[2] == pytest.approx(1 / 62 + 1 / 61)
    assert X.gated(b, a.limit(0)).count() == 0 and X.gated(b, a).count() == 2
    assert spark.createDataFrame([("cities",)], "w string").select(X.stems(F.col("w"))).first()[0] == ["cities", "city", "citi", "citie"]


# -- vectors ----------------------------------------------------------------------


@given(st.integers(0, 20_000))
@settings(max_examples=6, deadline=None)
def test_chunks(spark, n):
    got = [(r["start"], r["end"]) for r in V.chunks(spark.createDataFrame([("x" * n,)], "t string"), "t").orderBy("start").collect()]
    assert got[0][0] == 0 and got[-1][1] == n and all(e - s <= 3000 for s, e in got)
    assert all(b[0] == a[0] + 2700 for a, b in zip(got, got[1:], strict=False)) and (n > 3000 or len(got) == 1)


def test_related_in_blocks(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<float>")
    got = {(r["k"], r["rank"]): r["other"] for r in V.related(df, "k", "v", most=3, block=7).collect()}
    s = np.round(x.astype(np.float32).astype(float) @ x.astype(np.float32).astype(float).T, 9)
    np.fill_diagonal(s, -np.inf)
    assert got == {(i, r): int(j) for i in range(60) for r, j in enumerate(np.lexsort((np.arange(60), -s[i]))[:3])}


def test_related_with_copies_ties_and_keys_of_any_kind(spark, monkeypatch):
    """Halves, many equal vectors, repeated and absent keys; runs and blocks smaller than the table."""
    import numpy as np

    monkeypatch.setattr(V, "RUN", 16)
    rng = np.random.default_rng(2)
    some = np.concatenate([rng.integers(-32, 32, (60, 3)) / 32, np.tile([[0.5, 0.25, -0.5]], (50, 1)), np.eye(3)[rng.integers(0, 3, 20)]])
    keys = [int(x) for x in rng.permutation(130)] + [7, 7, 8]
    x = np.concatenate([some, rng.integers(-32, 32, (3, 3)) / 32])
    for name in (lambda k: k, lambda k: f"k{k}é"):
        df = spark.createDataFrame([(name(k), v.tolist()) for k, v in zip(keys, x, strict=True)] + [(None, [1.0, 0.0, 0.0])], f"k {'long' if name(1) == 1 else 'string'}, v array<float>").repartition(5)
        want = {}
        for a, v in zip(keys, x, strict=True):
            want.setdefault(name(a), []).extend((-float(np.sign(s) * np.floor(abs(s) * 1e9 + 0.5) / 1e9), name(b)) for b, s in zip(keys, x @ v, strict=True) if b != a)
        want = sorted((k, o, -s, r) for k, found in want.items() for r, (s, o) in enumerate(sorted(found)[:4]))
        assert sorted(tuple(r) for r in V.related(df, "k", "v", most=4, block=9).collect()) == want


def test_related_deals_each_row_once(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(200)], "k long, v array<float>")
    plan = V.related(df, "k", "v", most=3, block=7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Generate" not in plan


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e18])
def test_related_of_nearly_equal_vectors(spark, scale):
    """Scores that single precision cannot tell apart, and numbers whose products are beyond it."""
    import numpy as np

    x = (scale * (1 + np.random.default_rng(4).normal(size=(90, 6)) * 1e-6)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<float>")
    s = np.array([[sum(float(a) * float(b) for a, b in zip(u, v, strict=True)) for v in x] for u in x])
    s = np.round(s, 9) if scale <= 1 else s
    np.fill_diagonal(s, -np.inf)
    want = {(i, r): int(j) for i in range(90) for r, j in enumerate(np.lexsort((np.arange(90), -s[i]))[:5])}
    assert {(r["k"], r["rank"]): r["other"] for r in V.related(df, "k", "v", most=5, block=30).collect()} == want


def test_near_pairs_within_the_best_shuffle_each_row_once(spark):
    from conftest import SMALL

    from archivolt.plans import QUERIES

    plan = QUERIES["near_dupes_cosine"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Generate" not in plan


def test_related_refuses_what_is_no_vector(spark):
    for bad in (None, [1.0], [1.0, None], [1.0, float("nan")]):
        with pytest.raises(Exception, match="finite numbers and one dimension"):
            V.related(spark.createDataFrame([(1, [1.0, 0.0]), (2, bad)], "k long, v array<float>").coalesce(1), "k", "v").collect()
    assert V.related(spark.createDataFrame([], "k long, v array<float>"), "k", "v").collect() == []


def test_clusters(spark):
    df = spark.createDataFrame([(i, [float(i % 3 * 10), float(i % 2) / 9]) for i in range(30)], "k long, v array<float>")
    made, centres = V.clusters(df, "v", "k", k=3)
    assert len(centres) == 3 and made.select("cluster").distinct().count() == 3 and made.agg(F.max("distance")).first()[0] < 1
    assert len(set(V.parents([[1.0, 0], [0.9, 0.1], [0, 1.0]], 2))) <= 3


def test_a_held_out_class_is_a_leaf(spark):
    df = spark.createDataFrame([(i, [float(i % 3 * 10), 0.0], i >= 30) for i in range(30)] + [(30 + i, [20.0, 4.0 + i], True) for i in range(3)], "k long, v array<float>, h boolean")
    made, centres = V.clusters(df, "v", "k", k=3, held_out=F.col("h"))
    got = {r["k"]: (r["cluster"], r["distance"]) for r in made.collect()}
    assert len(got) == 33 and len(centres) == 4 and centres[3] == [20.0, 5.0]
    assert {got[i] for i in range(30)} == {(c, 0.0) for c in range(3)} and [got[i] for i in (30, 31, 32)] == [(3, 1.0), (3, 0.0), (3, 1.0)]
    leaves = [[10.0 * (i == j) for j in range(8)] for i in range(8)]
    near = V.parents([*leaves, leaves[7]], 8, held_out=True)
    assert near[:8] == V.parents(leaves, 8) and len(near) == 9 and near[8] in range(max(near[:8]) + 1)
    assert V.parents([[1.0, 0.0], [0.0, 1.0], [0.1, 2.0]], 2, held_out=True) == [0, 1, 1]


# -- extraction -------------------------------------------------------------------


def test_mentions():
    text = "C:\\forms\\lab.doc 01/05/99\nDate 03/04/2002 lead 0.05 f/cc near Acme Testing, EPA on March 5, 2002"
    got = [(m[2], m[4]) for m in E.mentions(text, agencies=E.one_of(("EPA",), 0))]
    assert got == [("date", "2002-03-04"), ("contaminant", "lead"), ("measurement", "f/cc"), ("lab", "ACME TESTING"), ("agency", "EPA"), ("date", "2002-03-05")]
    for s, e, _, t, _ in E.mentions(text):
        assert text[s:e] == t


def test_roles():
    got = E.roles("Reviewed by: John Smith, Chief Engineer\nFrom: The City\nTo: Ann Lee\n")
    assert [(r[2], r[3], r[4], r[6]) for r in got] == [("reviewed", "John Smith", "Chief Engineer", True), ("to", "Ann Lee", None, False)]


def test_roles_of_letters():
    """Closings, organisations of an agency or a laboratory, and what is no name."""
    text = "Very truly yours,\n\n  Jane Q. Doe\nDirector, Acme Testing Labs\n\nApproved by: Max Roe\nEPA Region 2\nRegards\nThe City\nx\nSincerely\nnot a name here\n"
    got = E.roles(text, agencies=E.mixed(("EPA",), ("health department",)))
    assert [(text[r[0] : r[1]], *r[2:]) for r in got] == [("Jane Q. Doe", "signed", "Jane Q. Doe", "Director", "DIRECTOR ACME TESTING LABS", True), ("Max Roe", "approved", "Max Roe", None, "EPA", True)]


def test_mentions_of_places_and_firms():
    text = "At 12 Warren Street, near 250 Broadway: BIN #1001234, Block: 38 Lot 17. Big Apple Contracting and Ace Environmental Services; the Health Department, not the epa."
    got = [(m[2], m[4]) for m in E.mentions(text, agencies=E.mixed(("EPA",), ("health department",)))]
    assert got == [
        ("address", "12 WARREN STREET"), ("address", "250 BROADWAY"), ("bin", "1001234"), ("block_lot", "38/17"), ("contractor", "BIG APPLE CONTRACTING"), ("contractor", "ACE ENVIRONMENTAL SERVICES"),
        ("agency", "HEALTH DEPARTMENT"),
    ]


def test_dates_of_forms_are_none():
    text = "Q:\\forms\\air 01/05/99\nRev. 02/02/2000\n7\\S 04/26/99 \\a b\\c 10/01/2001 13/40/2000 5/5/2000\nSept. 3 1999 1/1/75"
    assert [m[4] for m in E.mentions(text) if m[2] == "date"] == ["1999-04-26", "2001-10-01", "1999-09-03"]


def test_limits_near_readings(spark):
    text = "x" * 300 + " Action Level: 0.10 f/cc and lead 0.05 " + "y" * 300 + " PEL < 1,200.5 ppm"
    df = spark.createDataFrame([(text, p) for p in (330, 0, 551, 552, 700)], "t string, p int")
    got = [tuple(r[0]) for r in df.select(E.limit_near(F.col("t"), F.col("p"))).collect()]
    assert got == [(0.1, "Action Level", "f/cc"), (None, None, None), (0.1, "Action Level", "f/cc"), (1200.5, "PEL", "ppm"), (1200.5, "PEL", "ppm")]


def test_a_reading_is_accepted(spark):
    from archivolt.operators import screening as C

    words = [chr(97 + i) * 4 for i in range(24)]
    good, junk = " ".join(words), " ".join(f"zz{c}z" for c in "abcdefghijklmnopqrst")
    rows = [
        ("few words", [("a", good), ("b", good + " 1.5")], good),  # the first of equals
        ("few words", [("a", good), ("b", junk)], None),  # no other engine bears it out
        (good, [("a", good), ("b", good)], None),  # says no more
        (junk + " aaaa", [("a", good), ("b", good)], good),
        ("1.1 2.2 3.3 4.4 5.5", [("a", good), ("b", good + " 5.5 4.4 3.3 2.2 1.1")], good + " 5.5 4.4 3.3 2.2 1.1"),  # keeps the decimals
    ]
    df = spark.createDataFrame([(o, [{"engine": e, "text": t} for e, t in c]) for o, c, _ in rows], "o string, c array<struct<engine:string,text:string>>")
    vocabulary = F.array(*map(F.lit, words))
    assert [r[0] for r in df.select(C.accepted_reading(F.col("o"), F.col("c"), vocabulary)).collect()] == [w for _, _, w in rows]


def test_acronyms_and_marks_are_no_names(spark):
    from archivolt.operators import screening as C

    df = spark.createDataFrame([("NYPD",), ("FDNY",), ("DCAS",), ("SMITH",), ("NYC 9/11 Public Portal Document",)], "n string")
    assert [tuple(r) for r in df.select(C.names_a_person(F.col("n")), C.is_portal_mark(F.col("n"))).collect()] == [(False, False)] * 3 + [(True, False)] + [(True, True)]


@pytest.mark.parametrize(("text", "pages", "want"), [
    ("Block 38 Lot 17 BIN: 1001234", 1, ("cover_sheet", 0.9)), ("Block 38 Lot 17", 1, ("cover_sheet", 0.55)), ("Block 38 Lot 17", 3, ("other", 0.0)),
    ("Chain of Custody; invoice no. 3", 9, ("chain_of_custody", 0.85)), ("Laboratory Results\nLab ID: 3\nDate of analysis: x", 2, ("lab_report", 0.8)),
    ("Laboratory Results\nnothing", 2, ("other", 0.0)), ("a certificate of analysis", 2, ("lab_report", 0.45)), ("From: a\nTo: b", 1, ("memo_letter", 0.75)), ("Re: x", 1, ("memo_letter", 0.45)),
    ("1. Ab\n2. Cd\n3. Ef\n4. Gh", 1, ("form", 0.4)),
])
def test_doc_types(spark, text, pages, want):
    df = spark.createDataFrame([(text, pages)], "t string, n int")
    assert tuple(df.select(E.doc_type(F.col("t"), F.col("t"), F.col("n")).alias("x")).first()["x"]) == want


def test_text_choice(spark):
    short, long = "short", "word " * 40
    df = spark.createDataFrame([(short, long, None), (short, short, None), (long, long + "x", True), (short, long, False), (None, None, True)], "o string, c string, a boolean")
    text, ours = E.chosen_text(F.col("o"), F.col("c"), F.col("a"))
    assert [tuple(r) for r in df.select(text, ours).collect()] == [(long, True), (short, False), (long + "x", True), (short, False), ("", True)]


def test_units_and_limits(spark):
    df = spark.createDataFrame([(" F/CC ", 1.0, 2.0), ("mg/kg", 3.0, 2.0), ("x", None, 1.0)], "u string, v double, l double")
    unit = E.unit(F.col("u"))
    assert [tuple(r) for r in df.select(unit, E.sample_type(unit), E.compared(F.col("v"), F.col("l"))).collect()] == [("f/cc", "air", "below"), ("mg/kg", "soil", "above"), (None, None, None)]
    s = spark.createDataFrame([("Pb",), ("PM 10 mass",), ("gold",)], "s string")
    assert [r[0] for r in s.select(E.substance(F.col("s"))).collect()] == ["lead", "pm10", None]


# -- resolution -------------------------------------------------------------------


def test_addresses_meet_roll_and_seed(spark):
    counts = spark.createDataFrame([("5 Chambers St", 9), ("5 Chambres Street", 1), ("5 Chambers Ave", 1), ("7 Warren St.", 2), ("no number", 4), ("9 Fulton Street", 1)], "raw string, n int")
    roll = spark.createDataFrame([("9", "FULTON STREET", "1000090001", "123")], "house string, street string, lot string, building string")
    got = {r["raw"]: (r["key"], r["label"], r["confidence"], r["method"]) for r in R.canonical_addresses(counts, roll).collect()}
    assert got == {
        "5 Chambers St": ("address:5-chambers-street", "5 Chambers Street", 1.0, "exact"), "5 Chambres Street": ("address:5-chambers-street", "5 Chambers Street", 0.9, "fuzzy"),
        "5 Chambers Ave": ("address:5-chambers-avenue", "5 Chambers Avenue", 0.5, "fuzzy"), "7 Warren St.": ("address:7-warren-street", "7 Warren Street", 0.5, "fuzzy"),
        "9 Fulton Street": ("address:bbl:1000090001", "9 Fulton Street", 1.0, "exact"),
    }


def test_orgs_to_seed(spark):
    counts = spark.createDataFrame([("ACME LABS", 6), ("ACNE LABORATORY", 1), ("OTHER LAB", 1), ("ACME TESTING", 1)], "raw string, n int")
    got = {r["raw"]: (r["key"], r["confidence"]) for r in R.canonical_orgs(counts, "lab").collect()}
    assert got["ACME LABS"] == ("lab:acme-laboratory", 1.0) and got["ACNE LABORATORY"] == ("lab:acme-laboratory", 0.9)
    assert got["OTHER LAB"] == ("lab:other-laboratory", 1.0) and got["ACME TESTING"][1] == 0.5


def test_page_places(spark):
    m = [("d", 1, 5, "block_lot", "38/17", None, None), ("d", 1, 9, "bin", "1001234", None, None), ("d", 2, 5, "block_lot", "38/17", None, None), ("d", 2, 50, "contaminant", "lead", None, None), ("d", 2, 100, "measurement", "ppm", None, None),
         ("d", 3, 1, "address", "5 CHAMBERS ST", None, "organisation"), ("d", 4, 1, "address", "5 CHAMBERS ST", "Brooklyn", None), ("d", 5, 1, "address", "5 CHAMBERS ST", "Manhattan", None)]
    df = spark.createDataFrame(m, "doc string, page int, start int, label string, norm string, borough string, address_role string")
    got = {r["page"]: (r["kind"], r["key"], r["has_test"], r["confidence"]) for r in R.page_places(df, ["doc", "page"]).collect()}
    assert got == {1: ("bin", "1001234", False, 0.0), 2: ("bbl", "1000380017", True, 0.7), 5: ("address", "5 CHAMBERS STREET", False, 0.0)}


# -- sequences --------------------------------------------------------------------


@SLOW
@given(st.lists(st.integers(0, 60), max_size=25), st.integers(1, 4))
def test_rate_limit(spark, seconds, most):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("k", t0 + dt.timedelta(seconds=s)) for s in seconds], "k string, ts timestamp")
    want, reset, n = [], None, 0
    for s in sorted(seconds):
        if reset is None or reset <= s:
            reset, n = s + 10, 0
        n += 1
        want.append(n <= most)
    got = [r["ok"] for r in sorted(S.rate_limited(df, "k", "ts", most, 10).collect(), key=lambda r: (r["ts"], not r["ok"]))]
    assert sorted(got) == sorted(want) and sum(got) == sum(want)


@SLOW
@given(st.lists(st.integers(0, 12), max_size=20))
def test_packing(spark, sizes):
    want, held, shard = [], 0, 0
    for s in sizes:
        if held and held + s > 10:
            shard, held = shard + 1, 0
        held += s
        want.append(shard)
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate(sizes)], "g string, i long, s long")
    assert [r["shard"] for r in sorted(S.packed(df, "g", "i", "s", 10).collect(), key=lambda r: r["i"])] == want


def test_roots_stop_at_cycles(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (8, 9), (9, 8), (7, 99)], "n long, p long")
    got = {r["node"]: (r["root"], r["depth"]) for r in S.roots(df, "n", "p").collect()}
    assert [got[i] for i in (1, 2, 3, 4, 7)] == [(1, 0), (1, 1), (1, 2), (1, 3), (99, 1)] and got[8][1] == 25


def test_roots_of_long_chains(spark):
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(71)] + [(100 + i, 100 + (i + 1) % 3) for i in range(3)] + [(200, 100)], "n long, p long")
    got = {r["node"]: (r["root"], r["depth"]) for r in S.roots(df, "n", "p").collect()}
    assert [got[i] for i in range(71)] == [(0, i) for i in range(71)]
    assert all(got[i][1] == 25 and got[i][0] in (100, 101, 102) for i in (100, 101, 102, 200))
    capped = {r["node"]: (r["root"], r["depth"]) for r in S.roots(df, "n", "p", capped=True).collect()}
    assert [capped[i] for i in range(71)] == [(0, min(i, 25)) for i in range(71)]


def test_stage_is_all_or_nothing(spark):
    src = spark.createDataFrame([("p1", "h1"), ("p2", "new2")], "id string, text_hash string")
    cols = "id string, old_hash string, new_hash string, new_text string, policy string"
    ok = spark.createDataFrame([("p1", "h1", "new1", "t", "v1"), ("p2", "h2", "new2", "t", "v1")], cols)
    assert [r["id"] for r in S.staged(ok, src, "id", "v1").collect()] == ["p1"]
    for bad in (("p1", "other", "new1", "t", "v1"), ("p1", "h1", "new1", None, "v1"), ("p1", "h1", "new1", "t", "v0")):
        with pytest.raises(ValueError, match="refused"):
            S.staged(spark.createDataFrame([bad], cols), src, "id", "v1")


def test_queue(spark):
    work = spark.createDataFrame([("a", "f1"), ("b", "f2"), ("c", "f"), ("d", "f")], "k string, fingerprint string")
    done = spark.createDataFrame([("a", "f1", "done", 0), ("b", "old", "done", 0), ("c", "f", "error", 99)], "k string, fingerprint string, state string, retry_at int")
    assert {r["k"]: r["state"] for r in S.queue_state(work, done, "k", F.lit(5)).collect()} == {"a": "done", "b": "due", "c": "deferred", "d": "due"}


# -- readings and screens ---------------------------------------------------------


def test_column_block_takes_clean_lines_alone():
    from archivolt.operators.readings import page_readings

    text = "Location Sampled: Roof   Lobby\nSample # A1   A2\nAnalyzed: 3/4/02\nResults (%)\nChrysotile 2.5   Chrysotile ND\nAmosite 1\nGypsum 10   Gypsum TRACE\n\nLead 4   Lead 5"
    got = [(r["substance"], r["value"], r["sample_id"], r["location"], r["date"], r["confidence"]) for r in page_readings(text)]
    assert got == [("chrysotile", 2.5, "A1", "Roof", "2002-03-04", 0.85), ("gypsum", 10.0, "A1", "Roof", "2002-03-04", 0.85), ("chrysotile", None, "A2", "Lobby", "2002-03-04", 0.85), ("gypsum", None, "A2", "Lobby", "2002-03-04", 0.85)]


def test_headed_table(spark):
    from archivolt.operators.readings import borne_out, reading_rows

    text = "Analyte   Results   Units   MDL\nLead   0.5   mg/kg   1.0\nHg   <0.2   mg/kg   0.2\nGold   9   ppm   1\nZinc   7,000   mg/kg   10\nCopper   n/a   ppm   1\nComments: x\nNickel   1   ppm   2"
    df = spark.createDataFrame([("d", 1, text), ("e", 1, "nothing"), ("f", 1, None)], "doc string, page int, text string")
    out = reading_rows(df, ["doc", "page"], "text")
    assert rows(out.select("doc", "substance", "value", "unit", "limit_value", "result")) == [("d", "lead", 0.5, "mg/kg", 1.0, "below"), ("d", "mercury", 0.2, "mg/kg", 0.2, "below"), ("d", "zinc", 7000.0, "mg/kg", 10.0, "above")]
    page = F.lit(text)
    assert rows(out.select("substance", borne_out(F.col("substance"), F.col("value"), F.col("limit_value"), page))) == [("lead", True), ("mercury", True), ("zinc", False)]


def test_screens(spark):
    from archivolt.operators import screening as C

    t = spark.createDataFrame([("", "", "", 1.0, ""), ("Lead results Fulton Street", "Lead readings at one address on Fulton Street", "x", 0.9, "LEAD results for 5 Fulton Str"), ("Box 7", "short", "Box 7", 0.1, "other words")], "t string, s string, f string, c double, src string")
    got = [r[0] for r in t.select(C.title_flags(*(F.col(c) for c in ("t", "s", "f", "c", "src")))).collect()]
    assert got == [["untitled"], [], ["short-title", "title-is-folder-label", "short-summary", "low-confidence", "weak-grounding"]]
    names = spark.createDataFrame([("John Smith",), ("SMITH, JOHN",), ("E-mails M. Gilroy",), ("World Trade",), ("Chambers Street",), ("NADLERR",), ("PERMITS",), ("",), (None,)], "n string")
    assert [r[0] for r in names.select(C.names_a_person(F.col("n"))).collect()] == [True, True, True, False, False, True, False, False, False]
    v = spark.createDataFrame([("the lead was here xq zz the",)], "t string")
    q = C.lexical_quality(F.col("t"), F.array(*map(F.lit, ("the", "lead", "here"))))
    one = v.select(q.alias("q"), C.suspect(F.lit("ok"), q).alias("s")).first()
    assert (one["q"]["tokens"], one["q"]["good"], one["q"]["unique"], one["s"]) == (5, 4, 3, None)
    words = spark.createDataFrame([("the",), ("lead",), ("here",)], "word string")
    assert rows(C.lexical_rows(v.withColumn("k", F.lit(1)), ["k"], "t", words).select("tokens", "good", "unique", "ratio")) == [(5, 4, 3, 0.8)]
    s = spark.createDataFrame([("12 OAK STREET Block: 31 Lot: 4 BIN: 1000001",), (None,)], "f string")
    assert [r[0] for r in s.select(C.separator_title(F.col("f"))).collect()] == ["Folder cover sheet — 12 Oak Street", "Folder cover sheet"]
    c = spark.createDataFrame([("Lab Group # 123 Lab Sample # 4-A",), ("MICROVAC",)], "t string")
    assert [r[0] for r in c.select(C.count_sheet_title(F.col("t"))).collect()] == ["TEM asbestos air count sheet, lab group 123, sample 4-A", "TEM asbestos dust count sheet"]
    p = spark.createDataFrame([("x" * 300, "two"), ("short", "two"), ("short", None), ("Block 3 Lot 4 " + "x" * 300, "two")], "a string, b string")
    assert [r[0][:5] for r in p.select(C.excerpt_page(F.col("a"), F.col("b"))).collect()] == ["xxxxx", "two", "short", "two"]
    o = spark.createDataFrame([(1, True, 5, 9), (2, True, 5, 9), (3, None, 1, 1)], "page int, accepted boolean, mtime long, size long")
    f = spark.createDataFrame([(1, 5, 9), (2, 6, 9)], "page int, mtime long, size long")
    assert [r["page"] for r in sorted(C.valid_overlay(o, f, "page").collect())] == [1, 3]


def test_words_and_boxes(spark):
    from archivolt.operators import screening as C

    w = [("p", 1, 1, 2, 3, "c", -1.0), ("p", 1, 1, 1, 1, "a", 90.0), ("p", 1, 1, 1, 2, "b", 80.0), ("p", 1, 1, 1, 4, " ", 10.0)]
    df = spark.createDataFrame(w, "page string, block int, paragraph int, line int, n int, text string, conf double")
    assert rows(C.page_of_words(df, ["page"])) == [("p", "a b\nc", 85.0)]
    b = spark.createDataFrame([([(-2.0, 10.0, 90.0, 210.0, "w"), (5.0, 5.0, 5.0, 9.0, "z")],)], "b array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>")
    assert [tuple(x) for x in b.select(C.clipped(F.col("b"), F.lit(100), F.lit(200))).first()[0]] == [(0.0, 10.0, 90.0, 200.0, "w")]


def test_treemap_fills_the_box(spark):
    from archivolt.operators.layout import squarified, treemap

    boxes = squarified([6, 6, 4, 3, 2, 2, 1], 6, 4)
    assert sum(w * h for _, _, w, h in boxes) == pytest.approx(24) and max(max(w / h, h / w) for _, _, w, h in boxes) < 3.5
    assert boxes[0] == pytest.approx((0, 0, 3, 2))
    df = spark.createDataFrame([("g", "a", 3.0), ("g", "b", 1.0), ("g", "c", 0.0), ("h", "d", 5.0)], "g string, k string, s double")
    got = {r["k"]: (r["w"] * r["h"]) for r in treemap(df, "g", "k", "s", 10, 10).collect()}
    assert got == pytest.approx({"a": 75, "b": 25, "d": 100})


@SLOW
@given(st.lists(st.integers(0, 9), max_size=30))
def test_running_total(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long").repartition(3)
    upto, want = 0, []
    for i, v in enumerate(values):
        upto += v
        want.append((i, upto))
    assert sorted((r["i"], r["upto"]) for r in W.running_total(df, ["i"], "v").collect()) == want


def test_boroughs_folders_and_buildings(spark):
    a = spark.createDataFrame([("59-17", None, False), ("5", None, False), ("5", None, True), ("5-7", "1000380017", False), ("5", None, None)], "h string, lot string, s boolean")
    assert [r[0] for r in a.select(R.borough(F.col("h"), F.col("lot"), F.col("s"))).collect()] == ["Queens", "Outside Manhattan", "Manhattan", "Manhattan", "Manhattan"]
    roll = spark.createDataFrame([("1", "Low St", "1000100001", None), ("9", "LOW STREET", "1001950001", None), ("2", "High St", "1000100002", None), ("3", "High St", "1002500002", None)], "house string, street string, lot string, building string")
    assert rows(R.downtown_streets(roll)) == [("LOW STREET",)]
    f = spark.createDataFrame([("f1", "12 Oak St Block: 31 Lot: 4 BIN: 1000001", None), ("f2", "Ann Lee", "BIN: 1000002"), ("f3", "box", "B1ock:•38 Lol: 17"), ("f4", "1 Low St  files", None), ("f5", "5 Elsewhere", None), ("f6", None, None), ("f7", "1000003, 10 / 4", None)], "folder string, label string, sheet string")
    assert rows(R.folder_table(f, "folder", roll)) == [("f1", "bin", "1000001"), ("f3", "bbl", "1000380017"), ("f4", "bbl", "1000100001"), ("f7", "bin", "1000003")]
    text = "10 Morris Avenue letterhead\nJob Location: 75 Park Place"
    kind = "t string, b array<string>, l array<string>, a array<struct<start:int,lot:string,key:string>>"
    p = spark.createDataFrame([(text, [], [], [(0, None, "address:10"), (42, "1000120001", "address:75")]), (text, [], [], [(0, None, "address:10")]), (text, [], ["38/17"], []), (text, ["1000009"], ["38/17"], []), (text, [], [], [])], kind)
    assert [r[0] for r in p.select(R.building_key(*(F.col(c) for c in "tbla"))).collect()] == ["bbl:1000120001", "address:10", "bbl:1000380017", "bin:1000009", None]
    m = spark.createDataFrame([("LABETTE", "LAFAYETTE", 0.9), ("WARREN", "WALKER", 0.9), ("A", "A", 0.1), ("", "A", 1.0)], "a string, b string, confidence double")
    assert rows(R.accepted(m, 0.5, 0.375).select("a")) == [("LABETTE",)]


def test_scoped_pages(spark):
    every = spark.createDataFrame([("a", 1, True, 0.1), ("b", 1, False, 0.9), ("c", 1, True, 0.5)], "doc string, page int, has_test boolean, confidence double")
    hit = lambda *r: spark.createDataFrame(list(r), "doc string, page int, score double")
    got = S.scoped_pages([hit(("b", 1, 1.0)), hit(("a", 1, 9.0), ("b", 1, 5.0), ("x", 1, 99.0))], every, ["doc", "page"])
    assert [r["doc"] for r in got.collect()] == ["b", "a"]
    none = S.scoped_pages([hit(("x", 1, 1.0))], every, ["doc", "page"])
    assert [r["doc"] for r in none.collect()] == ["c", "a", "b"]


def test_more_like_page(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [1.0, 0.0]), ("b", 1, [0.9, 0.1]), ("c", 1, [0.0, 1.0]), ("d", 1, [0.8, 0.0])], "doc string, page int, v array<double>")
    got = V.more_like_page(df, "v", ["doc", "page"], {"doc": "a", "page": 1}, df.where("doc <> 'd'"), most=2)
    assert [r["doc"] for r in got.collect()] == ["b", "c"]


def test_small_steps(spark):
    from archivolt.sources.sinks import changed_files

    m = spark.createDataFrame([("d", 1, "date", "old"), ("d", 1, "lab", "x"), ("d", 2, "date", "keep")], "doc string, page int, label string, norm string")
    new = spark.createDataFrame([("d", 1, "date", "new"), ("d", 2, "date", "no"), ("d", 1, "lab", "no")], "doc string, page int, label string, norm string")
    due = spark.createDataFrame([("d", 1)], "doc string, page int")
    assert rows(R.rederived(m, new, "date", ["doc", "page"], due).select("page", "label", "norm")) == [(1, "date", "new"), (1, "lab", "x"), (2, "date", "keep")]
    foot = spark.createDataFrame([("l1", 7), ("l1", 5), ("l2", 9)], "lot string, building int")
    asked, have = spark.createDataFrame([("l1",), ("l2",)], "key string"), spark.createDataFrame([(7,), (5,)], "building int")
    assert rows(R.redirects(asked, foot, have)) == [("l1", 5)]
    t = spark.createDataFrame([("a <b> Dust & dusty lead",)], "t string")
    assert t.select(X.highlighted(F.col("t"), ["dust", "lead"])).first()[0] == "a &lt;b&gt; <mark>Dust</mark> &amp; dusty <mark>lead</mark>"
    f = spark.createDataFrame([("a", 1, 5), ("b", 2, 5)], "path string, size int, mtime int")
    assert rows(changed_files(f, f.where("path = 'a'"))) == [("b", 2, 5)]
    assert rows(R.due(t.withColumn("k", F.lit(1)), t.select(F.lit(1).alias("k"), F.sha1("t").alias("text_hash"), F.lit(2).alias("version")), ["k"], "t", 2).select("k")) == []
