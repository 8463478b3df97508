"""Readers and writers: chains, anchors, golden outcomes, allowed tables, activity streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ACTIVITY, ANCHOR, CHAIN, GOLDEN

PAYLOAD = "event long, reason_code string, cents long, _corrupt string"


def read_chain(spark: SparkSession, path: str, payload_schema: str = PAYLOAD) -> DataFrame:
    """Stored records with the payload parsed beside its text; a payload that is no JSON is marked corrupt, not dropped."""
    rows = spark.read.schema(CHAIN).parquet(path)
    rows = rows.withColumn("parsed", F.from_json("payload", payload_schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return rows.withColumn("corrupt", F.coalesce(F.col("parsed._corrupt").isNotNull(), F.lit(True)))


def append_chain(sealed: DataFrame, path: str) -> None:
    """Appends sealed records; there is no way to update or delete them."""
    sealed.select(*[c.split()[0] for c in CHAIN.split(", ")]).write.mode("append").parquet(path)


def append_batch(sealed: DataFrame, number: int, path: str) -> None:
    """S2 for foreachBatch: a batch that is run again replaces itself."""
    sealed.write.mode("overwrite").parquet(f"{path}/batch={number}")


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """S3: anchors from JSON lines."""
    return spark.read.schema(ANCHOR).json(path)


def append_anchors(anchors: DataFrame, path: str) -> None:
    anchors.write.mode("append").json(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Expected outcomes from a JSON array."""
    return spark.read.schema(GOLDEN).option("multiLine", True).json(path)


def write_golden(rows: DataFrame, path: str, rows_in_file: int = 10_000) -> None:
    """S4, the other way: files of one JSON array each, as ``read_golden`` reads them. Rows are dealt by a hash over as many files as
    ``rows_in_file`` calls for, so a file stays small however many rows there are."""
    files = max(1, -(-rows.count() // rows_in_file))
    dealt = rows.select(F.pmod(F.xxhash64(*rows.columns), F.lit(files)).alias("_file"), F.struct("*").alias("_row"))
    arrays = dealt.groupBy("_file").agg(F.to_json(F.collect_list("_row")).alias("value"))
    # Each row is a file's whole text: a task writes its rows one after another, each to a file of its own.
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)


def read_allowed(spark: SparkSession, folder: str, role: str, relations: list[str], policy: DataFrame) -> dict[str, DataFrame]:
    """The tables that the role's list allows; an unknown role or an empty list allows none."""
    listed = policy.filter(F.col("role") == role).select(F.explode("select_whitelist").alias("relation")).filter(F.col("relation").isin(relations))
    return {r["relation"]: spark.read.parquet(f"{folder}/{r['relation']}.parquet") for r in listed.distinct().collect()}


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    """Backend samples as a stream of files."""
    return spark.readStream.schema(ACTIVITY).parquet(path)
