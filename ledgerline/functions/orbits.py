"""Greedy steps through time, for keys of any size: the first time of a key, then the first time at least a width later, and so on.

Each step needs the one before, so a loop over a key's times is one task's work. Here every time first finds its own next one, which
needs no order of steps; pointer doubling then joins these to steps of 2, 4, 8, and the steps from a key's first time are read off in
as many joins as the number of steps has binary digits. All joins are on (key, time), so no task holds a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versions import scratch

#: Rows of a key from which on its steps are taken by joins; a loop over fewer takes less time than the joins.
HOT_ROWS = 5_000_000


def nexts(times: DataFrame) -> DataFrame:
    """``key``, ``at``, ``next``: for distinct (key, width, at) the key's first time at or after at + width, null without one.

    Times lie in buckets of one width, so what is sought for a time in bucket b is in bucket b + 1 or begins a later one. A task
    sees a key's distinct times in two buckets; one row for each bucket that has times tells where the next one begins.
    """
    rows = times.withColumn("b", F.floor(F.col("at") / F.col("width")))
    asked = rows.select("key", (F.col("b") + 1).alias("b"), (F.col("at") + F.col("width")).alias("place"), F.lit(None).cast("long").alias("found"), F.col("at"))
    held = rows.select("key", "b", F.col("at").alias("place"), F.col("at").alias("found"), F.lit(None).cast("long").alias("at"))
    # Backwards, and a time before a question of the same place, so that it answers it.
    backwards = Window.partitionBy("key", "b").orderBy(F.desc("place"), F.col("at").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answered = asked.unionByName(held).withColumn("in_bucket", F.min("found").over(backwards)).filter("at IS NOT NULL").select("key", (F.col("b") - 1).alias("b"), "at", "in_bucket")
    heads = rows.groupBy("key", "b").agg(F.min("at").alias("head"))
    onwards = Window.partitionBy("key").orderBy("b")
    direct = F.lead("b").over(onwards) == F.col("b") + 1
    heads = heads.select("key", "b", F.when(direct, F.lead("head", 2).over(onwards)).otherwise(F.lead("head").over(onwards)).alias("later"))
    return answered.join(heads, ["key", "b"]).select("key", "at", F.coalesce("in_bucket", "later").alias("next"))


def orbits(times: DataFrame) -> DataFrame:
    """``key`` and ``at`` of every greedy step. ``times``: key (not null), width (positive, one for each key), at."""
    times = times.select("key", "width", F.col("at")).distinct()
    steps = scratch(nexts(times))
    firsts = times.groupBy("key").agg(F.min("at").alias("at"), F.max("at").alias("last"), F.first("width").alias("width"))
    firsts = scratch(firsts)
    most = firsts.agg(F.max((F.col("last") - F.col("at")) / F.col("width"))).first()[0]
    if most is None:
        return firsts.select("key", "at")
    levels = [steps.filter("next IS NOT NULL")]
    while 1 << len(levels) <= int(most) + 1:
        one = levels[-1]
        two = one.select("key", F.col("at").alias("next"), F.col("next").alias("far"))
        levels.append(scratch(one.join(two, ["key", "next"]).select("key", "at", F.col("far").alias("next"))))
    reached = firsts.select("key", "at")
    for level in reversed(levels):
        reached = reached.unionByName(reached.join(level, ["key", "at"]).select("key", F.col("next").alias("at")))
        reached = scratch(reached.distinct())
    return reached


def hot_keys(rows: DataFrame, key: str, width: str, hot_rows: int) -> DataFrame:
    """``key`` and ``width`` of the keys with ``hot_rows`` rows or more and one positive width; counted inside tasks first, and no more than one key for each ``hot_rows`` rows."""
    counted = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(width).alias("width"), F.max(width).alias("widest"))
    return counted.filter((F.col("n") >= hot_rows) & (F.col("width") == F.col("widest")) & (F.col("width") > 0)).select("key", "width")


def with_start(rows: DataFrame, starts: DataFrame, key: str, at: str) -> DataFrame:
    """``rows`` of keys (with ``width``) and the step each belongs to, as ``start``: the last one at or before it, which is less than a width before."""
    begun = starts.withColumn("b", F.floor(F.col("at") / F.col("width")))
    # A bucket holds one step at most: a row is in its own bucket's or in the one's before.
    near = begun.select("key", "b", F.col("at").alias("same"), F.lit(None).cast("long").alias("before")).unionByName(begun.select("key", (F.col("b") + 1).alias("b"), F.lit(None).cast("long").alias("same"), F.col("at").alias("before")))
    near = near.groupBy("key", "b").agg(F.max("same").alias("_same"), F.max("before").alias("_before"))
    joined = rows.withColumn("_b", F.floor(F.col(at) / F.col("width"))).join(near, (F.col(key) == F.col("key")) & (F.col("_b") == F.col("b")))
    return joined.withColumn("start", F.when(F.col("_same") <= F.col(at), F.col("_same")).otherwise(F.col("_before"))).drop("_b", "b", "_same", "_before", "key")
