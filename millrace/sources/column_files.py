"""Folders with one JSONL file for each field, in which line N of every file belongs to row N.

A file may also be a folder of part files, whose lines follow one another in the order of their names; that is what Spark writes.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value): the lines of a text file, or of a folder of them, with their numbers from 0.

    Lines are numbered within each block that Spark reads, and a block starts at the number of lines before it; one
    row for each block is all that is ordered in one task.
    """
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    lines = spark.read.text(path).select("value", block.alias("block"), F.monotonically_increasing_id().alias("at"))
    counts = lines.groupBy("block").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("block").alias("start_block"), before.alias("start"))
    inside = F.row_number().over(Window.partitionBy("block").orderBy("at"))
    ranked = lines.withColumn("inside", inside)
    return ranked.join(starts, F.col("block") == F.col("start_block")).select((F.col("start") + F.col("inside") - 1).alias("pos"), "value")


def write_column_files(rows: DataFrame, folder: str, fields: list[str], order: str) -> None:
    """Writes `folder`/<field>.jsonl for each field, its rows in the order of a column without repeats."""
    ranked = rows.orderBy(order)
    for name in fields:
        value = F.regexp_extract(F.to_json(F.struct(F.col(name).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
        ranked.select(F.when(F.col(name).isNull(), F.lit("null")).otherwise(value).alias("value")).write.text(f"{folder}/{name}.jsonl")


def _parsed(value: Column, ddl: str) -> Column:
    wrapped = F.concat(F.lit('{"v":'), value, F.lit("}"))
    return F.from_json(wrapped, f"v {ddl}")["v"]


def read_column_files(spark: SparkSession, folder: str, fields: Mapping[str, str], ids: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Rows put together by line number from `folder`/<field>.jsonl; fields maps each field to its DDL type.

    One shuffle for all fields. JSON null and text that isn't of the type are null. Files of unequal length are an
    error when rows are read. With `ids` (a column named as `key`), only rows with those keys stay. No lines: no rows.
    """
    parts = [numbered_lines(spark, f"{folder}/{name}.jsonl").withColumn("field", F.lit(name)) for name in fields]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    rows = union.groupBy("pos").agg(*[F.max(F.when(F.col("field") == name, F.col("value"))).alias(f"json_{i}") for i, name in enumerate(fields)])
    checked = [
        _parsed(F.when(F.col(f"json_{i}").isNull(), F.raise_error(F.concat(F.lit(f"{name}.jsonl has no line "), F.col("pos").cast("string")))).otherwise(F.col(f"json_{i}")), ddl).alias(name)
        for i, (name, ddl) in enumerate(fields.items())
    ]
    out = rows.select("pos", *checked)
    return out if ids is None else out.join(ids.select(key).distinct(), key, "left_semi")
