"""Sinks: CSV and nested JSON of records, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_csv(records: DataFrame, path: str, columns: list[str]) -> None:
    """The columns that exist, the surest records first, with a header; arrays as JSON. One sorted range for each file."""
    cols = [c for c in columns if c in records.columns]
    kinds = dict(records.dtypes)
    out = records.orderBy(F.desc_nulls_last("confidence"), "id").select(*[F.to_json(c).alias(c) if kinds[c].startswith(("array", "struct", "map")) else F.col(c) for c in cols])
    out.write.mode("overwrite").option("header", True).csv(path)


def to_json(records: DataFrame, log: DataFrame, path: str) -> None:
    """Every record with its changes nested, in order of their run and id."""
    changes = log.groupBy(F.col("scholarship_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("run_id", "change_id", "field_name", "change_type", "old_value", "new_value"))).alias("changes"))
    records.join(changes, "id", "left").write.mode("overwrite").json(path)


def append(rows: DataFrame, path: str, *partitions: str) -> None:
    """Rows added to a log of Parquet files."""
    rows.write.mode("append").partitionBy(*partitions).parquet(path)


def compact(spark: SparkSession, path: str, target: str, files: int) -> None:
    """A log's rows rewritten to `target` in few files, without a shuffle."""
    spark.read.parquet(path).coalesce(files).write.mode("overwrite").parquet(target)
