"""Stages of the pipeline on odd tables."""

import pytest
from conftest import SMALL

TEXT = "a line of plain words that says one thing after another and ends well.\nand a second line that goes on in the same way, unlike the first."
SCHEMA = "doc_id long, text string, x0 int, kept string, _gone long, n_chars long, held_out double, doc_ids long"


def rows():
    """Nulls in every column, empty, very long, repeated and near equal texts; names that operators use within."""
    some = [(i, f"{TEXT} number {i} " + " ".join(f"word{i}x{j}" for j in range(30)), i, "k", i, None, 0.5, 1) for i in range(6)]
    return some + [(None, None, None, None, None, None, None, None), (7, None, 1, None, None, 3, None, None), (8, "", 1, "", 2, 0, 0.0, 4), (9, " \n\t", 1, "", 2, 0, 0.0, 4), (2, some[2][1], 2, "k", 2, None, 0.5, 1), (11, some[2][1] + " more", 1, "", 2, 0, 0.0, 4), (12, "long words " * 30_000, 0, None, 1, 1, 1.0, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_classifier_keeps_rows_as_they_are(spark, docs):
    import corpus_pipeline as C

    out = C.keep_good(spark, docs, SMALL)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got, every = key(out.collect()), key(docs.collect())
    assert got and set(got) <= set(every)
    assert got.count(next(r for r in every if r[0] == 2)) in (0, 2)


def test_lines_go_and_rows_stay(spark, docs):
    import corpus_pipeline as C

    shared = docs.union(spark.createDataFrame([(100 + i, f"own {i}\n SHARED line \nend {i}", 0, "", 0, None, 0.0, 0) for i in range(10)], SCHEMA))
    out = C.drop_lines(spark, shared, SMALL)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = {(r["doc_id"], r["x0"]): r for r in out.collect()}
    assert out.count() == len(rows()) + 10
    assert all(got[100 + i, 0]["text"] == f"own {i}\nend {i}" for i in range(10))
    assert got[7, 1]["text"] == got[None, None]["text"] == "" and all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_one_of_near_copies_stays(spark, docs):
    import corpus_pipeline as C

    out = C.keep_first(spark, docs, SMALL)
    assert out.dtypes == docs.dtypes
    assert key(out.collect()) == key(r for r in docs.collect() if r["doc_id"] != 11)


def test_leaks_go(spark, docs):
    import corpus_pipeline as C

    test = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("length(text) > 100").first()["text"]
    out = C.drop_leaks(spark, docs.union(spark.createDataFrame([(200, f"before {test} after", 0, "", 0, None, 0.0, 0)], SCHEMA)), SMALL)
    assert out.dtypes == docs.dtypes and key(out.collect()) == key(docs.collect())


def test_every_row_is_encoded(spark, docs):
    import corpus_pipeline as C

    out = C.encode(spark, docs, SMALL).collect()
    assert len(out) == len(rows()) and {r["n_tokens"] for r in out if r["doc_id"] in (7, 8)} == {0}


def test_empty_tables(spark, docs):
    import corpus_pipeline as C

    for name, stage in C.STAGES:
        assert stage(spark, docs.limit(0), SMALL).collect() == [], name


def test_text_crosses_once(spark):
    """The stages that carry rows hand each text to Python once."""
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for stage in (C.keep_good, C.drop_leaks):
        plan = stage(spark, docs, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("AS x1#") == 0 and "MapInArrow" in plan
