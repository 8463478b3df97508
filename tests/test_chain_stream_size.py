"""f6_verify_chain_stream as a query: its calls and states are groups', however many chains there are, and its rows those of the table."""

from pathlib import Path

from pyspark.sql import functions as F

from ledgerline import queries
from ledgerline.sources.shared import shared_folder


def events(spark, path, users, each):
    """Users in any order of time, each with ``each`` events."""
    rows = spark.range(users * each).withColumn("k", F.col("id") * 7919 % (users * each))
    rows = rows.select(
        F.col("k").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, k % 1000)").alias("ts"),
        (F.col("k") % users).alias("user_id"), F.when(F.col("k") % 3 == 0, "click").otherwise("view").alias("event_type"), (F.col("k") % 100 / 4).alias("value"), F.lit("{}").alias("props"),
    )
    rows.write.parquet(f"{path}/events.parquet")


def test_states_do_not_grow_with_chains(spark, tmp_path):
    events(spark, str(tmp_path), 1500, 8)
    shared = Path(shared_folder(spark))
    before = set(shared.glob("chain-*"))
    told = queries.QUERIES["f6_verify_chain_stream"](spark, str(tmp_path)).collect()
    (made,) = set(shared.glob("chain-*")) - before
    assert spark.read.format("statestore").load(f"{made}/state").count() <= 512  # was one for each chain
    of_table = queries.QUERIES["a3_chain_breaks"](spark, str(tmp_path)).select("chain_id", "kind", "seq", "expected", "found").collect()
    assert sorted(map(tuple, told), key=str) == sorted(map(tuple, of_table), key=str)
    assert {r["kind"] for r in told} == {"HASH_MISMATCH", "BAD_GENESIS", "SEQ_GAP", "BROKEN_LINK"}
