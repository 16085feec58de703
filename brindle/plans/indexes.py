"""Stored structures that several queries share: made once for a session and the tables that they are made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.bindings import chunk_texts, question_terms, vectors
from brindle.functions.pivots import Cells, file_under_pivots
from brindle.operators.postings import Index, build
from brindle.store import once, written

SOURCES = ("documents", "embeddings")


def _once(spark: SparkSession, sf: str, name: str, make):
    return once(spark, name, [f"{sf}/{table}.parquet" for table in SOURCES], make)


def text_index(spark: SparkSession, sf: str) -> Index:
    """The index of the chunks' texts."""
    return _once(spark, sf, "text_index", lambda: build(chunk_texts(spark, sf)))


def asked_terms(spark: SparkSession, sf: str) -> DataFrame:
    """question_terms, so that a search does not make its questions from the texts again."""
    return _once(spark, sf, "asked_terms", lambda: written(question_terms(spark, sf), "asked-terms"))


def vector_cells(spark: SparkSession, sf: str) -> Cells:
    """All vectors, filed under pivots."""
    return _once(spark, sf, "vector_cells", lambda: file_under_pivots(vectors(spark, sf)))
