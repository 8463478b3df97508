"""Read metering: what a capped read discloses, and anchored window budgets.

The window budget depends on the data (the first charge of a window anchors it, refused charges are not booked), so it is a fold
over a session in time order. The fold is one small kernel, WindowState, that the batch and the streaming forms share.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import folded, with_running
from ..functions.orbits import HOT_ROWS, hot_keys, orbits, with_start
from ..sources.versions import scratch

#: Milliseconds of a statement whose rows one task holds while running sums are made.
SPAN = 60_000


def with_row_bytes(df: DataFrame, name: str = "row_bytes", layout: str = "wire") -> DataFrame:
    """The size of each row: lengths of the columns' texts plus 4 for each column and 2 (``wire``), or the row's JSON (``json``)."""
    if layout == "json":
        return df.withColumn(name, F.octet_length(F.to_json(F.struct("*"))).cast("long"))
    total: Column = F.lit(4 * len(df.columns) + 2).cast("long")
    for c in df.columns:
        total = total + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    return df.withColumn(name, total)


def with_caps(df: DataFrame, policy: DataFrame, columns: list[str]) -> DataFrame:
    """The caps of each row's role; roles without a policy get none. The policy has one row for each role."""
    caps = policy.select(F.col("role").alias("_role"), *columns, F.lit(True).alias("known_role"))
    return df.join(caps, F.col("role") == F.col("_role"), "left").drop("_role").withColumn("known_role", F.coalesce("known_role", F.lit(False)))


def metered(df: DataFrame, statement: list[str], order: list[str], bytes_col: str, policy: DataFrame, span: int = SPAN) -> DataFrame:
    """Each row with its statement's running rows and bytes and whether the caps, which count inclusively, let it out. ``order``
    begins with a number; sums are made within spans of it and carried on."""
    rows = with_caps(df, policy, ["max_rows", "max_bytes"])
    rows = with_running(rows, statement, order, span, {"run_rows": F.lit(1).cast("long"), "run_bytes": F.greatest(F.col(bytes_col), F.lit(0))})
    # Both sums only grow, so what is within the caps is a prefix, and all that follows a breach is held back.
    return rows.withColumn("kept", F.col("known_role") & (F.col("run_rows") <= F.col("max_rows")) & (F.col("run_bytes") <= F.col("max_bytes")))


def cutoff(df: DataFrame, statement: list[str], order: list[str], bytes_col: str, policy: DataFrame) -> DataFrame:
    """The rows that get out."""
    return metered(df, statement, order, bytes_col, policy).filter("kept").select(df.columns)


def cutoff_report(df: DataFrame, statement: list[str], order: list[str], bytes_col: str, policy: DataFrame) -> DataFrame:
    """What each statement disclosed, what was held back, and which cap broke first (rows are checked before bytes)."""
    rows = metered(df, statement, order, bytes_col, policy)
    breach = F.when(~F.col("known_role"), "unknown_role").when(F.col("run_rows") > F.col("max_rows"), "max_rows").when(F.col("run_bytes") > F.col("max_bytes"), "max_bytes")
    return rows.groupBy(*statement).agg(
        F.count_if("kept").alias("rows_out"), F.coalesce(F.sum(F.when(F.col("kept"), F.col(bytes_col))), F.lit(0)).cast("long").alias("bytes_out"),
        F.count_if(~F.col("kept")).alias("rows_suppressed"), F.min_by(breach, F.when(breach.isNotNull(), F.col("run_rows"))).alias("breach"),
    )


@dataclass
class WindowState:
    """An anchored budget window. A charge ``window_ms`` or more after the anchor anchors a new window; a refused one changes nothing."""

    anchor: int | None = None
    rows: int = 0
    bytes: int = 0
    killed: bool = False

    def charge(self, ts: int, rows: int, size: int, window_ms: int, max_rows: int, max_bytes: int, kill: bool = False) -> str:
        if self.killed:
            return "session_killed"
        if self.anchor is None or ts - self.anchor >= window_ms:
            self.anchor, self.rows, self.bytes = ts, 0, 0
        breach = "window_rows" if self.rows + rows > max_rows else "window_bytes" if self.bytes + size > max_bytes else ""
        if breach:
            self.killed = kill
            return breach
        self.rows += rows
        self.bytes += size
        return "ok"


LIMITS = ["window_ms", "window_max_rows", "window_max_bytes"]
METERED = "session string, id long, ts_ms long, rows long, bytes long, outcome string, anchor long, used_rows long, used_bytes long"


def charged(state: WindowState, c: dict, kill: bool) -> tuple:
    """One charge and the window after it."""
    outcome = state.charge(c["ts_ms"], c["rows"], c["bytes"], *[c[x] for x in LIMITS], kill)
    return c["session"], c["id"], c["ts_ms"], c["rows"], c["bytes"], outcome, state.anchor, state.rows, state.bytes


def window_fold(charges: pd.DataFrame, state: WindowState, kill: bool) -> pd.DataFrame:
    """Charges of one session, in order of time and id."""
    out = [charged(state, c, kill) for c in charges.sort_values(["ts_ms", "id"]).to_dict("records")]
    return pd.DataFrame(out, columns=[x.split()[0] for x in METERED.split(", ")])


def window_meter(charges: DataFrame, policy: DataFrame, kill: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """B3 (and B4, with ``kill``): each charge (session, role, id, ts_ms, rows, bytes) with its outcome and the window after it.

    A session is folded in order by one task, which keeps only its window. Sessions of ``hot_rows`` charges or more, with one window
    length, are not: where windows begin depends on times alone, so these are found first (``orbits``), and each window is folded by
    itself. Charges of roles without a policy are refused as unknown_role.
    """
    rows = with_caps(charges, policy, LIMITS)
    known = rows.filter("known_role").select("session", "id", "ts_ms", "rows", "bytes", *LIMITS)

    none = F.lit(None).cast("long")
    unknown = rows.filter("not known_role").select("session", "id", "ts_ms", "rows", "bytes", F.lit("unknown_role").alias("outcome"), none.alias("anchor"), none.alias("used_rows"), none.alias("used_bytes"))
    hot = scratch(hot_keys(known, "session", "window_ms", hot_rows))
    large = not hot.isEmpty()
    rest = known.join(hot, F.col("session") == F.col("key"), "left_anti") if large else known
    made = folded(rest, "session", ["ts_ms", "id"], lambda _: WindowState(), lambda state, c: charged(state, c, kill), METERED).unionByName(unknown)
    return made.unionByName(by_window(known.join(hot, F.col("session") == F.col("key")).drop("key"), kill)) if large else made


def by_window(charges: DataFrame, kill: bool) -> DataFrame:
    """The same for sessions (not null) of any size, whose charges have a ``width``: windows first, then each window by itself."""
    charges = scratch(charges)
    times = charges.select(F.col("session").alias("key"), "width", F.col("ts_ms").alias("at"))
    starts = orbits(times).join(times.select("key", "width").distinct(), "key")
    placed = with_start(charges, starts, "session", "ts_ms").withColumn("_window", F.struct("session", "start"))
    made = folded(placed, "_window", ["ts_ms", "id"], lambda _: WindowState(), lambda state, c: charged(state, c, False), METERED)
    if not kill:
        return made
    # The session ends with its first breach; what comes later sees the window as it was then.
    made = scratch(made)
    breach = made.filter("outcome <> 'ok'").groupBy("session").agg(F.min(F.struct("ts_ms", "id", "anchor", "used_rows", "used_bytes")).alias("end")).withColumnRenamed("session", "_s")
    after = F.col("end").isNotNull() & (F.struct("ts_ms", "id") > F.struct("end.ts_ms", "end.id"))
    then = {c: F.when(after, F.col(f"end.{c}")).otherwise(F.col(c)) for c in ("anchor", "used_rows", "used_bytes")} | {"outcome": F.when(after, F.lit("session_killed")).otherwise(F.col("outcome"))}
    return made.join(breach, F.col("session") == F.col("_s"), "left").select(*[then.get(c, F.col(c)).alias(c) for c in made.columns])


def bounded_read(results: DataFrame, policy: DataFrame, kill: bool = False) -> DataFrame:
    """Rows (session, role, statement, id, ts_ms, bytes) cut per statement, then charged to the session's window; a row cut off never reaches the window."""
    kept = cutoff(results, ["session", "statement"], ["ts_ms", "id"], "bytes", policy)
    return window_meter(kept.withColumn("rows", F.lit(1).cast("long")), policy, kill)


def volume_by_window(df: DataFrame, ts: str, session: str, size: str, width: str, delay: str | None = None) -> DataFrame:
    """Rows and bytes in epoch-aligned windows, in batch or, with a watermark of ``delay``, on a stream."""
    df = df.withWatermark(ts, delay) if delay else df
    out = df.groupBy(F.window(ts, width).alias("w"), session).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"))
    return out.select("w.start", "w.end", session, "rows", "bytes")

