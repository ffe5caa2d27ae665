"""Versioned copies of result tables in a folder."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def record_snapshot(tables: dict[str, DataFrame], root: str, name: str = "", description: str = "", now: dt.datetime | None = None) -> str:
    """Write ``tables`` as a snapshot; returns its time stamp."""
    stamp = (now or dt.datetime.now(dt.timezone.utc)).strftime("%Y-%m-%d_%H%M%S")
    for table, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/data/{table}/snapshot={stamp}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(stamp, name, description, sorted(tables))], "stamp string, name string, description string, tables array<string>").coalesce(1).write.mode("append").parquet(f"{root}/catalog")
    return stamp


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/catalog").orderBy("stamp")


def resolve_snapshot(spark: SparkSession, root: str, key: str) -> str:
    """The time stamp of the snapshot with that name or stamp; raises if it is none or more than one."""
    found = [r.stamp for r in list_snapshots(spark, root).filter((F.col("name") == key) | (F.col("stamp") == key)).select("stamp").distinct().collect()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} snapshots match {key!r}")
    return found[0]


def read_snapshot(spark: SparkSession, root: str, table: str, key: str) -> DataFrame:
    return spark.read.parquet(f"{root}/data/{table}/snapshot={resolve_snapshot(spark, root, key)}")


def copy_snapshot(spark: SparkSession, root: str, key: str, target: str) -> None:
    stamp = resolve_snapshot(spark, root, key)
    row = list_snapshots(spark, root).filter(F.col("stamp") == stamp).first()
    for table in row.tables:
        read_snapshot(spark, root, table, stamp).write.mode("errorifexists").parquet(f"{target}/data/{table}/snapshot={stamp}")
    spark.createDataFrame([row], "stamp string, name string, description string, tables array<string>").coalesce(1).write.mode("append").parquet(f"{target}/catalog")
