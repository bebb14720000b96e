"""Readers and writers besides the fixed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_rows(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """A JSON list as typed rows; rows without a required value are dropped."""
    return spark.read.schema(schema).option("multiLine", True).json(path).dropna(subset=required)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of text files; a file's lines are numbered from 0."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\n").alias("lines"))
    return whole.select("path", F.posexplode("lines").alias("line_no", "line"))


def explode_tree(df: DataFrame, levels: list[tuple[str, str]]) -> DataFrame:
    """Nested arrays to rows: each level is (array column or path, name of its items)."""
    for path, name in levels:
        df = df.select(*[c for c in df.columns], F.posexplode(F.col(path)).alias(f"{name}_no", name))
    return df


def read_binary(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Files as rows (path, length, content), chosen by extension."""
    files = spark.read.format("binaryFile").load(path)
    if suffixes:
        files = files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(list(suffixes)))
    return files.select("path", "length", "content")


def json_field(c: Column, path: str, kind: str = "string") -> Column:
    """Typed value at a JSON path; null if the text is no JSON or the type does not fit."""
    return F.try_variant_get(F.try_parse_json(c), path, kind)


def unfence(c: Column) -> Column:
    """JSON text without a surrounding code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(json)?\s*", ""), r"\s*```$", ""))


def overwrite(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Wipe and reseed."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)

