"""Queries over reads. A session is a user, a statement is a user's day, a row's bytes are the event's cents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import meter
from ..streaming import meter as stream
from .base import derived, duck, table

DAY = 86_400_000
POLICY = f"""
SELECT * FROM (VALUES ('reader', CAST(3 AS BIGINT), CAST(40000 AS BIGINT), CAST({DAY} AS BIGINT), CAST(12 AS BIGINT), CAST(30000 AS BIGINT)),
  ('analyst', 5, 100000, {2 * DAY}, 20, 90000), ('closed', 0, 0, {DAY}, 0, 0)) AS p(role, max_rows, max_bytes, window_ms, window_max_rows, window_max_bytes)
"""
CHARGES = f"""
SELECT CAST(user_id AS STRING) AS session, CASE user_id % 5 WHEN 0 THEN 'analyst' WHEN 1 THEN 'closed' WHEN 2 THEN 'stranger' ELSE 'reader' END AS role,
  CAST(millis(ts) // {DAY} AS STRING) AS statement, event_id AS id, millis(ts) AS ts_ms, CAST(1 + event_id % 3 AS BIGINT) AS rows, CAST(round(value * 100) AS BIGINT) AS bytes
FROM {{events}}
"""


def charges(spark: SparkSession, folder: str) -> DataFrame:
    return derived(spark, folder, CHARGES.replace(" // ", " DIV "))


def policy(spark: SparkSession, folder: str) -> DataFrame:
    return derived(spark, folder, POLICY)


BASE = f"WITH RECURSIVE p AS ({duck(POLICY)}), c AS ({duck(CHARGES)})"
RUN = (
    BASE
    + """, m AS (SELECT c.*, p.role AS known, p.max_rows, p.max_bytes, count(*) OVER w AS run_rows, sum(bytes) OVER w AS run_bytes FROM c LEFT JOIN p ON p.role = c.role
  WINDOW w AS (PARTITION BY session, statement ORDER BY ts_ms, id ROWS UNBOUNDED PRECEDING)), k AS (SELECT *, known IS NOT NULL AND run_rows <= max_rows AND run_bytes <= max_bytes AS kept FROM m)"""
)


def fold(rows: str, kill: bool) -> str:
    """The window fold as recursion over each session's charges."""
    return f""", n AS (SELECT x.session, x.id, x.ts_ms, x.rows, x.bytes, p.window_ms, p.window_max_rows AS mr, p.window_max_bytes AS mb, row_number() OVER (PARTITION BY x.session ORDER BY x.ts_ms, x.id) AS i
  FROM ({rows}) x JOIN p ON p.role = x.role), s AS (
  SELECT session, i, id, ts_ms, rows, bytes, CASE WHEN rows > mr THEN 'window_rows' WHEN bytes > mb THEN 'window_bytes' ELSE 'ok' END AS outcome, ts_ms AS anchor,
    CASE WHEN rows > mr OR bytes > mb THEN 0 ELSE rows END AS used_rows, CASE WHEN rows > mr OR bytes > mb THEN 0 ELSE bytes END AS used_bytes, {"rows > mr OR bytes > mb" if kill else "false"} AS killed
  FROM n WHERE i = 1
  UNION ALL
  SELECT session, i, id, ts_ms, rows, bytes, CASE WHEN killed THEN 'session_killed' WHEN ur + rows > mr THEN 'window_rows' WHEN ub + bytes > mb THEN 'window_bytes' ELSE 'ok' END,
    anchor, CASE WHEN killed OR ur + rows > mr OR ub + bytes > mb THEN ur ELSE ur + rows END, CASE WHEN killed OR ur + rows > mr OR ub + bytes > mb THEN ub ELSE ub + bytes END,
    {"killed OR ur + rows > mr OR ub + bytes > mb" if kill else "false"}
  FROM (SELECT n.*, s.killed, CASE WHEN NOT s.killed AND n.ts_ms - s.anchor >= window_ms THEN n.ts_ms ELSE s.anchor END AS anchor,
      CASE WHEN NOT s.killed AND n.ts_ms - s.anchor >= window_ms THEN 0 ELSE s.used_rows END AS ur, CASE WHEN NOT s.killed AND n.ts_ms - s.anchor >= window_ms THEN 0 ELSE s.used_bytes END AS ub
    FROM s JOIN n ON n.session = s.session AND n.i = s.i + 1)
) SELECT session, id, ts_ms, rows, bytes, outcome, anchor, used_rows, used_bytes FROM s
UNION ALL SELECT session, id, ts_ms, rows, bytes, 'unknown_role', NULL, NULL, NULL FROM ({rows}) x WHERE role NOT IN (SELECT role FROM p)"""


KEPT = "SELECT session, role, statement, id, ts_ms, CAST(1 AS BIGINT) AS rows, bytes FROM k WHERE kept"
KEYS = ["session", "statement"]
ORDER = ["ts_ms", "id"]


def hours(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("ts"), F.col("user_id"), F.round(F.col("value") * 100).cast("long").alias("cents"))


QUERIES = {
    "w1_cutoff": lambda s, d: meter.cutoff(charges(s, d), KEYS, ORDER, "bytes", policy(s, d)),
    "w1_cutoff_report": lambda s, d: meter.cutoff_report(charges(s, d), KEYS, ORDER, "bytes", policy(s, d)),
    "w2_row_bytes": lambda s, d: meter.with_row_bytes(table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")).select("c_custkey", "row_bytes"),
    "j5_role_caps": lambda s, d: meter.with_caps(charges(s, d).select("id", "role"), policy(s, d), ["max_rows"]),
    "b3_window_meter": lambda s, d: meter.window_meter(charges(s, d), policy(s, d)),
    "b4_window_kill": lambda s, d: meter.window_meter(charges(s, d), policy(s, d), kill=True),
    "b5_bounded_read": lambda s, d: meter.bounded_read(charges(s, d), policy(s, d)),
    "b6_volume_by_window": lambda s, d: meter.volume_by_window(hours(s, d), "ts", "user_id", "cents", "6 hours").select(
        F.floor(F.unix_micros(F.col("start").cast("timestamp")) / 3_600_000_000).alias("start_hour"), "user_id", "rows", "bytes"
    ),
    "b3_window_meter_stream": lambda s, d: stream.replay(charges(s, d), lambda rows: stream.window_meter(rows, policy(s, d)), "window-meter"),
}

ORACLES = {
    "w1_cutoff": RUN + " SELECT session, role, statement, id, ts_ms, rows, bytes FROM k WHERE kept",
    "w1_cutoff_report": RUN
    + """ SELECT session, statement, count(*) FILTER (kept) AS rows_out, CAST(coalesce(sum(bytes) FILTER (kept), 0) AS BIGINT) AS bytes_out, count(*) FILTER (NOT kept) AS rows_suppressed,
    arg_min(CASE WHEN known IS NULL THEN 'unknown_role' WHEN run_rows > max_rows THEN 'max_rows' ELSE 'max_bytes' END, run_rows) FILTER (NOT kept) AS breach FROM k GROUP BY session, statement""",
    "w2_row_bytes": """SELECT c_custkey, CAST(18 + strlen(CAST(c_custkey AS VARCHAR)) + coalesce(strlen(c_name), 0) + coalesce(strlen(CAST(c_nationkey AS VARCHAR)), 0) + coalesce(strlen(c_mktsegment), 0) AS BIGINT) AS row_bytes FROM customer""",
    "j5_role_caps": BASE + " SELECT c.id, c.role, p.max_rows, p.role IS NOT NULL AS known_role FROM c LEFT JOIN p ON p.role = c.role",
    "b3_window_meter": BASE + fold("SELECT * FROM c", False),
    "b4_window_kill": BASE + fold("SELECT * FROM c", True),
    "b5_bounded_read": RUN + fold(KEPT, False),
    "b3_window_meter_stream": BASE + fold("SELECT * FROM c", False),
    "b6_volume_by_window": "SELECT epoch_us(ts) // 21600000000 * 6 AS start_hour, user_id, count(*) AS rows, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS bytes FROM events GROUP BY ALL",
}
