"""The corpus pipeline: five stages over ``documents``, each written and read again as the next one's input.

Every stage takes (spark, docs, sf_dir). All but the last return the columns
of documents: a null lang becomes the predicted one and documents whose text
has no language go (without a labelled row to learn from, those without a
letter, and lang stays), one row of each group of near-duplicates stays, contaminated documents go, and sources are
mixed to their target weights, by which a document may stand several times.
The last writes token files and returns their digest.

Nulls, empty texts, repeated rows, empty tables and further columns are
treated as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatt.llm import decontaminate, language, mixing, neardup, tokens
from tidewatt.llm.common import read_table, stage_packed
from tidewatt.session import owned_scratch, scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fitted(docs)
    return language.lettered(docs) if model is None else language.recognised(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.unique(docs, repeats=False)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.token_digests(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("tokens", write_tokens),
]

#: Tokenizing and learnt predictions are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's rows are written before the next reads them."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        path = scratch_path(spark, name)
        with owned_scratch(spark):  # what a stage has written on its way goes with it
            docs = stage_packed(step(spark, docs, sf_dir), name, path)
    return STAGES[-1][1](spark, docs, sf_dir)
