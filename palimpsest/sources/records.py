"""Readers of JSON Lines and columnar records with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.abstraction import MAP_SCHEMA

COMMITS = (
    "commit string, subject string, repo_name array<string>, parent array<string>, "
    "difference array<struct<old_path:string,new_path:string,old_mode:string,new_mode:string>>"
)
FILE_CHANGES = (
    "repository string, commit_before string, commit_after string, diff_index long, "
    "file_before string, file_after string, url_before string, url_after string, "
    "row_index long, code_before string, code_after string"
)
CHANGE_ENTRIES = (
    "name string, before_code string, after_code string, before_code_normalized string, "
    f"after_code_normalized string, edit_actions array<string>, replacement_map {MAP_SCHEMA}"
)


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """Mined commits; a mode missing from the record reads as null. Gzip files
    cannot be split, so use many of them or ``session.spread``."""
    return spark.read.schema(COMMITS).json(path)


def read_file_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_CHANGES).json(path)


def read_change_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHANGE_ENTRIES).json(path)


def read_pairs(
    spark: SparkSession, path: str, source_field: str = "source", target_field: str = "target",
    fmt: str = "parquet", schema: str | None = None,
) -> DataFrame:
    """Paired records with named source and target fields."""
    reader = spark.read.format(fmt)
    rows = (reader.schema(schema) if schema else reader).load(path)
    return rows.withColumnsRenamed({source_field: "source", target_field: "target"})


def chunk_number(path: Column | str | None = None) -> Column:
    """The number behind "chunk" in a file's path."""
    file = F.col("_metadata.file_path") if path is None else (F.col(path) if isinstance(path, str) else path)
    return F.regexp_extract(file, "chunk=?([0-9]+)", 1).try_cast("int")
