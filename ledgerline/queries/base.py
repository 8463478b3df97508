"""What the queries share: tables, and derived tables whose SQL both engines read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def derived(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """``sql`` over the tables it names as {table}; milliseconds are written millis(column)."""
    names = [n for n in ("customer", "orders", "lineitem", "events", "labels", "nation", "supplier", "part", "region") if "{" + n + "}" in sql]
    sql = re.sub(r"millis\((\w+)\)", r"(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', \1) DIV 1000)", sql)
    sql = sql.replace("{", "{{").replace("}", "}}")  # braces of JSON stay; those around tables are taken back
    for n in names:
        sql = sql.replace("{{" + n + "}}", "{" + n + "}")
    return spark.sql(sql, **{n: table(spark, folder, n) for n in names})


def duck(sql: str) -> str:
    """The same SQL for the other engine."""
    sql = re.sub(r"millis\((\w+)\)", r"(epoch_us(\1) // 1000)", sql)
    for n in ("customer", "orders", "lineitem", "events", "labels", "nation", "supplier", "part", "region"):
        sql = sql.replace("{" + n + "}", n)
    return sql
