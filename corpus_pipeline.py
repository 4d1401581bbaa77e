"""The corpus pipeline: five stages over ``documents``, each on what the one before kept.

A stage takes (spark, docs, sf_dir). All but the last return the columns of documents, whatever
these are besides doc_id and text; what a stage returns is written as Parquet in the shared
folder and read again. Every stage gives an empty table for an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm.base import Shared, table
from archivolt.llm.decontaminate import decontaminate
from archivolt.llm.line_dedup import line_dedup
from archivolt.llm.near_dedup import near_dedup
from archivolt.llm.piece_codec import piece_digests
from archivolt.llm.quality_crf import quality

#: Not expressible in SQL: the first stage is a trained model.
ORACLE_SQL = None


def _renamed(df: DataFrame, columns: list[str]) -> DataFrame:
    """The carried columns x0, x1 and so on under their names."""
    return df.select(*(F.col(f"x{i}").alias(c) for i, c in enumerate(columns)))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier takes for good, unchanged.

    A null text is scored as the empty one, and stays null in a row that is kept. Repeated
    rows have equal scores and stay or go together.
    """
    scored = quality(docs, table(spark, sf_dir, "labels"), extra=tuple(docs.columns))
    return _renamed(scored.where("predicted = 1"), docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row without the lines that many share; n_chars is counted anew where it is there.

    No row goes: one that had text and has none left, or had a null text, has the empty
    text. Repeated rows are documents each, so enough of them lose all their lines.
    """
    made = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    extra = [c for c in docs.columns if c not in made]
    out = line_dedup(docs, full=True, extra=tuple(extra))
    return out.select(*((made[c] if c in made else F.col(f"x{extra.index(c)}")).alias(c) for c in docs.columns))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest doc_id.

    Rows of one doc_id are one document and stay or go together. Rows without doc_id, and
    documents without words (null or empty texts), are copies of nothing and stay.
    """
    gone = near_dedup(docs).where("not kept").select("doc_id").distinct()
    return docs.alias("d").join(gone.alias("g"), F.col("d.doc_id") == F.col("g.doc_id"), "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any test window of the benchmark, unchanged.

    A null or empty text has no window and stays, as all do with an empty benchmark.
    Repeated rows stay or go together.
    """
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), extra=tuple(docs.columns))
    return _renamed(found.where("not contaminated"), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every row, as digests; a null text counts as empty."""
    return piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("near dedup", keep_first),
    ("benchmark decontamination", drop_leaks),
    ("piece encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from ``documents`` on."""
    shared, docs = Shared(spark), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared.keep(docs)
    return docs
