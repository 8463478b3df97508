"""Running values and sequential folds over keys of any size."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versions import scratch

ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


#: Rows of one key in one span from which on the span is cut further.
HOT_SPAN = 2_000_000


def with_running(df: DataFrame, keys: list[str], order: list[str], span: int, sums: dict[str, Column], least: dict[str, Column] | None = None, hot_span: int = HOT_SPAN) -> DataFrame:
    """Adds, for each row, sums and minima over the rows of its keys up to and including it, in the order of ``order``.

    ``order`` begins with a number, such as a time in milliseconds. A task holds the rows of one key in one span of it, not a key's
    whole history; one row for each key and span carries the values on from one span to the next. A span in which a key has
    ``hot_span`` rows or more is cut once more, at bounds that Spark samples from its rows, so that it is many tasks' too. Null keys
    are a key of their own.
    """
    every = [(n, c, F.sum) for n, c in sums.items()] + [(n, c, F.min) for n, c in (least or {}).items()]
    rows = cut_in_parts(df, keys, order, span, hot_span)
    so_far = Window.partitionBy(*keys, "_part", "_sub").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_p", "_q").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.col("_sub").alias("_q")).agg(*[f(c).alias(f"_t{i}") for i, (_, c, f) in enumerate(every)])
    parts = parts.select("_p", "_q", *[f"_k{i}" for i in range(len(keys))], *[f(f"_t{i}").over(earlier).alias(f"_b{i}") for i, (_, _, f) in enumerate(every)])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_part").eqNullSafe(F.col("_p")), F.col("_sub") == F.col("_q")]
    both = rows.withColumns({f"_v{i}": f(c).over(so_far) for i, (_, c, f) in enumerate(every)}).join(parts, functools.reduce(operator.and_, same), "left")

    def total(i: int, how: Callable) -> Column:
        here, before = F.col(f"_v{i}"), F.col(f"_b{i}")
        return F.least(here, before) if how is F.min else F.coalesce(here + before, here, before)

    return both.select(*df.columns, *[total(i, f).alias(n) for i, (n, _, f) in enumerate(every)])


def cut_in_parts(df: DataFrame, keys: list[str], order: list[str], span: int, hot_span: int) -> DataFrame:
    """``df`` with ``_part``, its span, and ``_sub``, the piece of a hot span: pieces follow each other in ``order``, rows that are equal in it stay together."""
    rows = df.withColumn("_part", F.floor(F.col(order[0]) / span))
    full = rows.groupBy(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.col("_part").alias("_h")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= hot_span).drop("_n")
    full = scratch(full)  # at most one row for each hot_span rows of df
    if full.isEmpty():
        return rows.withColumn("_sub", F.lit(0))
    same = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)] + [F.col("_part").eqNullSafe(F.col("_h"))])
    hot = rows.join(full, same, "left_semi")
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once, since the sampled bounds would be others the next time.
    pieces = scratch(hot.repartitionByRange(width, *keys, "_part", *order).withColumn("_sub", F.spark_partition_id()))
    return rows.join(full, same, "left_anti").withColumn("_sub", F.lit(0)).unionByName(pieces)


def folded(rows: DataFrame, key: str, order: list[str], start: Callable[[dict], Any], step: Callable[[Any, dict], tuple | None], schema: str) -> DataFrame:
    """``step(state, row)`` for each row of a key in the order of ``order``, with the state that ``start(row)`` makes at its first row.

    Rows for which it returns None are left out. Keys are dealt over the tasks and sorted there (Spark spills the sort); Python holds
    one batch of rows and one key's state, so a long key costs time but no memory.
    """
    names, kinds = zip(*[x.split() for x in schema.split(", ")], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, state = False, None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row[key] != now:
                    begun, now, state = True, row[key], start(row)
                made = step(state, row)
                if made is not None:
                    out.append(made)
            columns = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, ARROW[k]) for c, k in zip(columns, kinds, strict=True)], list(names))

    return rows.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(run, schema)
