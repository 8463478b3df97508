"""Structured Streaming forms of metering, trust, breakers and chain verification.

Each stateful query keeps only its fold's state for a key. ``replay`` runs a streaming query over a table that is already there
and returns what it wrote; live queries are started by the caller from the same functions.
"""

from __future__ import annotations

import functools
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import meter
from ..operators.logs import ceiling
from ..schemas import TRUST, label
from ..sources.shared import shared_folder

def replay(rows: DataFrame, query: Callable[[DataFrame], DataFrame], name: str, files_per_batch: int | None = None, mode: str = "append", then: DataFrame | None = None) -> DataFrame:
    """Writes ``rows`` as files, streams them through ``query`` until all are taken, and reads back the output. ``then`` arrives after
    all of ``rows``, in a batch of its own where batches have one file."""
    spark = rows.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{base}/in")
    if then is not None:
        time.sleep(1)  # files are taken in the order of their times
        then.coalesce(1).write.mode("append").parquet(f"{base}/in")
    source = spark.readStream.schema(rows.schema)
    source = source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source
    out = query(source.parquet(f"{base}/in"))

    def keep(batch: DataFrame, number: int) -> None:
        # Named by batch: a batch that is run again after a failure replaces what it wrote before.
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    running = out.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    running.awaitTermination()
    return spark.read.schema(out.schema).parquet(*[f"{base}/out"]).drop("batch")


def window_meter(charges: DataFrame, policy: DataFrame, kill: bool = False) -> DataFrame:
    """B3/B4 on a stream of charges; the policy is a static table. Unknown roles are refused without state."""
    rows = meter.with_caps(charges, policy, meter.LIMITS)
    known = rows.filter("known_role").select("session", "id", "ts_ms", "rows", "bytes", *meter.LIMITS)
    state = "anchor long, rows long, bytes long, killed boolean"
    folded = known.groupBy("session").applyInPandasWithState(functools.partial(fold_sessions, kill=kill), meter.METERED, state, "append", "NoTimeout")
    none = F.lit(None).cast("long")
    unknown = rows.filter("not known_role").select("session", "id", "ts_ms", "rows", "bytes", F.lit("unknown_role").alias("outcome"), none.alias("anchor"), none.alias("used_rows"), none.alias("used_bytes"))
    return folded.unionByName(unknown)


def fold_sessions(key, frames, state, kill):
    """Charges come in batches that are each sorted only by themselves, so a session's micro-batch is ordered by its key columns alone;
    rows are then charged a batch at a time."""
    now = meter.WindowState(*state.get) if state.exists else meter.WindowState()
    for rows in in_order(frames, ["ts_ms", "id"]):
        yield meter.window_fold(rows, now, kill)
    state.update((now.anchor, now.rows, now.bytes, now.killed))


def in_order(frames: Iterator[pd.DataFrame], order: list[str], rows_at_once: int = 10_000) -> Iterator[pd.DataFrame]:
    """A key's rows of one micro-batch, sorted, a bounded number at a time. They are held as Arrow tables, a fraction of what frames
    take; how many one micro-batch may bring is the source's limit (maxFilesPerTrigger, maxOffsetsPerTrigger)."""
    parts = [pa.Table.from_pandas(f, preserve_index=False) for f in frames if len(f)]
    if not parts:
        return
    rows = pa.concat_tables(parts, promote_options="permissive")
    places = pc.sort_indices(rows, [(c, "ascending") for c in order])
    for i in range(0, len(places), rows_at_once):
        yield rows.take(places[i : i + rows_at_once]).to_pandas()


def trust(events: DataFrame) -> DataFrame:
    """each session's least ceiling and totals, in update mode; the newest row of a session counts."""
    rows = events.groupBy("session").agg(F.min(ceiling()).alias("r"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return rows.select("session", label(F.col("r"), TRUST).alias("trust"), "rows", "bytes", "n")
