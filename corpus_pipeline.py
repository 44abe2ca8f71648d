"""From raw documents to packed token sequences, in five stages.

Each stage works on all its predecessor kept; what it returns is written and read again, so a row is named
by its file and its place there, and no stage writes the texts a second time. All stages but the last return the columns of ``documents``. Null, empty and very long texts, repeated rows, null ids
and empty tables pass through as each operator's docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import language, mixing, ngram_join, packing, pii
from sievelight.llm.common import ROW, table, with_file_rows, with_row_key
from sievelight.llm.queries import tokenizer
from sievelight.session import written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised; null texts and those without a letter go.

    Without any labelled document there is no model, and only these go.
    """
    model = language.fit(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    names = ("_lang_pred", "_lang_score", "_lang_accepted")
    return language.predict(docs, model, names).filter(names[2]).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one with the smallest doc_id.

    Of rows with that doc_id, the first stays; a row with a null doc_id stays if no row of its group has an
    id, and then the first does. Rows are told apart by their row, so different texts of one doc_id stay.
    """
    keyed = with_row_key(with_file_rows(docs))
    return keyed.join(ngram_join.surplus_rows(keyed, ROW), ROW, "left_anti").select(docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    return pii.redact(with_file_rows(docs)).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their target weights; rows are the stretches of words that the mix takes."""
    return mixing.mixed_documents(with_file_rows(docs)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack into sequences of 4096 ids; one row per piece."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), end_id=2, length=4096, digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_copies", one_of_each),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

# Token ids are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
