"""The training-data pipeline over ``documents``: five stages, each one of the operators in ``tidewell.llm``.

Every stage takes ``(spark, docs, sf_dir)``, works on all documents that the one before kept, and returns a DataFrame
with the columns of ``documents``; the last returns the encoded corpus. A runner may write each stage's result and read
it back, and ``run`` does so in the shared folder, so that no plan spans two stages.

Language ID drops texts without any letter, which no language can claim. Line dedup takes repeated lines out of texts.
Near-dedup keeps one document of each group. Mixing repeats documents, or cuts word ranges out of them, until each
source has its share; documents that the mix does not draw are not in its result.

Defined cases, for each stage. Language ID: a null or empty text and one without letters is dropped, any other stays,
labelled or not. Line dedup: every row stays; lines after the first of equal or near ones go, a null text stays null, a
text all of whose lines go becomes empty. Near-dedup: of each component one row stays; rows without words all stay, and
rows without an id are grouped by their shingles. Mixing: texts without words have size 0 and are not drawn; a null
source is a source of its own. SentencePiece: a null or empty text has no ids. Nulls in other columns and extra columns
pass through all stages but the last; long texts are processed whole; ties and repeated rows are as each operator's
docstring says; an empty table gives an empty table with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import language_id, line_dedup, mixing, near_dedup, pieces
from tidewell.llm.common import materialise, shrink_heaps

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_heaps(stage: Stage) -> Stage:
    """``stage``, begun with executors whose heaps are as small as before the stages ahead of it."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shrink_heaps(spark)
        return stage(spark, docs, sf_dir)

    return begun


@in_small_heaps
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language_id.identify(docs)
    return found.filter(found["_language"]["n_letters"] > 0).select(*docs.columns)


@in_small_heaps
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(docs)


@in_small_heaps
def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


@in_small_heaps
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


@in_small_heaps
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("mixing", mix_sources),
    ("SentencePiece", encode_pieces),
]

#: Trained models, signatures and merges are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
