"""Movie files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filmloom.operators.layout import parse_headers, read_movies


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content), one row a file."""
    return spark.read.format("binaryFile").load(path)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """Per file ``head`` and ``status``; the content itself is not kept."""
    return parse_headers(files(spark, path)).drop("content")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue entries of all well-formed files."""
    return read_movies(files(spark, path))
