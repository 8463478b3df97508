"""Queries over activity made from events (cluster: user_id % 5, tick: the hour), labelled outcomes, and approvals."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring, watch
from ..sources.shared import shared_folder
from ..streaming import watch as live
from ..streaming.meter import replay
from . import audit as chains
from .base import derived, duck, table

HOUR = 3_600_000
T = watch.Thresholds(cooldown_ms=3 * HOUR, runaways=4)
TICK = f"millis(ts) // {HOUR} * {HOUR}"
ACTIVITY = f"""SELECT user_id % 5 AS cluster_id, {TICK} AS tick, event_id AS pid, CASE WHEN event_type = 'purchase' THEN 'agent' WHEN event_type = 'signup' THEN NULL ELSE 'app' END AS usename,
  CASE WHEN event_id % 7 = 0 THEN 'proxy' END AS application_name, CASE WHEN event_id % 3 = 0 THEN 'idle' ELSE 'active' END AS state, CAST(round(value * 100) AS BIGINT) * 6 AS query_runtime_millis FROM {{events}}"""
SLOTS = f"SELECT user_id % 5 AS cluster_id, {TICK} AS tick, 'slot' || CAST(user_id AS STRING) AS slot_name, event_id AS position, CAST(round(value * 100) AS BIGINT) * 2500 AS retained_wal_bytes FROM {{events}}"
TICKS = f"SELECT user_id % 5 AS cluster_id, {TICK} AS tick, CAST(max(CASE WHEN event_id % 50 = 0 THEN value ELSE 0 END) * 2000000 AS BIGINT) AS lag_bytes, CASE WHEN max(event_id) % 6 = 0 THEN 'ok' WHEN max(event_id) % 6 = 1 THEN 'failed' END AS probe FROM {{events}} GROUP BY user_id % 5, {TICK}"


def spark_sql(sql: str) -> str:
    return sql.replace(" // ", " DIV ")


def activity(s: SparkSession, d: str) -> DataFrame:
    return derived(s, d, spark_sql(ACTIVITY))


def slots(s: SparkSession, d: str) -> DataFrame:
    return derived(s, d, spark_sql(SLOTS))


def reasons(s: SparkSession, d: str) -> DataFrame:
    ticks = derived(s, d, spark_sql(TICKS))
    return watch.trip_reasons(ticks, watch.assess_backends(activity(s, d), T), watch.slot_alarms(slots(s, d), T), T)


def probed(s: SparkSession, d: str) -> DataFrame:
    return reasons(s, d).join(derived(s, d, spark_sql(TICKS)).select("cluster_id", "tick", "probe"), ["cluster_id", "tick"])


def joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in columns})


GOLDEN = """SELECT CAST(doc_id AS STRING) AS id, CASE WHEN toxic = 1 THEN 'dangerous' ELSE 'legit' END AS class, 'v' || CAST(doc_id % 4 AS STRING) AS vector,
  CASE WHEN toxic = 0 THEN 'ALLOW' WHEN doc_id % 4 = 0 THEN 'BLOCK' WHEN doc_id % 4 = 1 THEN 'BOUND' WHEN doc_id % 4 = 2 THEN 'REVERTED' ELSE 'REFUSED' END AS expected_verdict FROM {labels}"""
OBSERVED = """SELECT id, CASE WHEN CAST(id AS BIGINT) % 17 = 3 THEN 'ALLOW' WHEN CAST(id AS BIGINT) % 23 = 5 THEN 'BLOCK' ELSE expected_verdict END AS verdict, CAST(CAST(id AS BIGINT) % 120 AS BIGINT) AS bytes_out, CAST(100 AS BIGINT) AS budget_bytes,
  CAST(CAST(id AS BIGINT) % 3 AS BIGINT) AS prod_rows_touched, CAST(id AS BIGINT) % 5 <> 0 AS reverted_with_verified_diff FROM (GOLDEN)"""
OBSERVED = OBSERVED.replace("GOLDEN", GOLDEN)
GRANTS = f"""SELECT CAST(event_id AS STRING) AS proposal_id, 'DELETE ' || CAST(event_id AS STRING) AS statement_text, CAST(user_id AS STRING) AS p1, event_type AS p2, 'agent' AS role, CAST(user_id AS STRING) AS session_id, CAST(event_id % 9 AS STRING) AS dry_run_version,
  event_id % 50 AS max_rows, event_id % 5000 AS max_bytes, 'n' || CAST(event_id // 3 AS STRING) AS nonce, millis(ts) + event_id % 4 * {HOUR} AS expiry_ms, event_id % 31 <> 0 AS signature_valid FROM {{events}}"""
REQUESTS = f"""SELECT event_id AS request_id, CAST(event_id AS STRING) AS proposal_id, CASE WHEN event_id % 37 = 0 THEN 'DELETE all' ELSE 'DELETE ' || CAST(event_id AS STRING) END AS statement_text, CAST(user_id AS STRING) AS p1, event_type AS p2, 'agent' AS role, CAST(user_id AS STRING) AS session_id, CAST(event_id % 9 AS STRING) AS dry_run_version,
  event_id % 50 + CASE WHEN event_id % 41 = 0 THEN 1 ELSE 0 END AS max_rows, event_id % 5000 AS max_bytes, 'n' || CAST(event_id // 3 AS STRING) AS nonce, millis(ts) + event_id % 4 * {HOUR} AS expiry_ms, millis(ts) + event_id % 5 * {HOUR} AS at_ms FROM {{events}}"""


def golden(s: SparkSession, d: str) -> DataFrame:
    return derived(s, d, GOLDEN)


def bound(s: SparkSession, d: str, sql: str) -> DataFrame:
    return derived(s, d, spark_sql(sql)).withColumn("params", F.array("p1", "p2"))


def scored(s: SparkSession, d: str) -> DataFrame:
    return scoring.score(derived(s, d, GOLDEN), derived(s, d, OBSERVED))


def live_records(s: SparkSession, d: str) -> DataFrame:
    k = F.col("id").cast("long")
    g = derived(s, d, GOLDEN)
    return g.filter(k % 13 != 0).withColumn("vector", F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("vector"))).unionByName(g.filter(k % 29 == 0).withColumn("id", F.concat(F.lit("new"), "id")))


def alert_stream(s: SparkSession, d: str) -> DataFrame:
    """Samples as streams of files, in two micro-batches without any order, through breakers and alerts into sealed chains; a tick a year on ends the last ones."""
    base = f"{shared_folder(s)}/watch-{uuid.uuid4().hex}"
    ticks = derived(s, d, spark_sql(TICKS))
    inputs = {"activity": activity(s, d), "slots": slots(s, d), "ticks": ticks}
    for name, df in inputs.items():
        df.repartition(2, F.xxhash64("tick", "cluster_id")).write.parquet(f"{base}/{name}")
    time.sleep(1)  # files are taken in the order of their times
    end = ticks.agg((F.max("tick") + 366 * chains.DAY).alias("tick")).select(F.lit(-1).cast("long").alias("cluster_id"), "tick", F.lit(0).cast("long").alias("lag_bytes"), F.lit(None).cast("string").alias("probe"))
    end.write.mode("append").parquet(f"{base}/ticks")
    read = lambda name: s.readStream.schema(inputs[name].schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/{name}")
    out = live.watch_stream(read("activity"), read("slots"), read("ticks"), T, "365 days")
    out.writeStream.foreachBatch(live.sealing(f"{base}/sealed")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{base}/sealed/chain").select("chain_id", "seq", "prev_hash", "record_hash", "payload", "ts_ms")


def shuffled_chain(s: SparkSession, chain: DataFrame) -> DataFrame:
    """A chain in five micro-batches without any order, then a heartbeat years later: the breaks must be those of the whole table."""
    parts = chain.repartition(5, F.xxhash64("chain_id", "seq", "payload"))
    beat = s.range(1).select(*[F.lit(None).cast(dict(chain.dtypes)[c]).alias(c) if c != "ts_ms" else F.lit(chains.NOW * 2).alias(c) for c in chain.columns])
    return replay(parts, lambda rows: live.verify_chain_stream(rows, 4000 * chains.DAY, 4000 * chains.DAY), "chain", 1, then=beat)


QUERIES = {
    "f1_assess_backends": lambda s, d: joined(watch.assess_backends(activity(s, d), T), "terminate", "spared"),
    "f2_slot_alarms": lambda s, d: watch.slot_alarms(slots(s, d), T),
    "f3_trip_reasons": reasons,
    "f4_breaker_timeline": lambda s, d: watch.breaker_timeline(probed(s, d), T),
    "f4_breaker_stream": lambda s, d: replay(probed(s, d), lambda rows: live.breaker_stream(rows, T), "breaker"),
    "f5_alerts": lambda s, d: watch.alerts(watch.breaker_timeline(probed(s, d), T), watch.assess_backends(activity(s, d), T), watch.slot_alarms(slots(s, d), T)),
    "f5_alert_chain_stream": alert_stream,
    "f6_verify_chain_stream": lambda s, d: shuffled_chain(s, chains.tampered(s, d)),
    "f6_corrupt_chain_stream": lambda s, d: shuffled_chain(s, chains.damaged(s, d)),
    "c7_audit_grants": lambda s, d: scoring.audit_grants(bound(s, d, GRANTS).filter("proposal_id NOT LIKE '%77'"), bound(s, d, REQUESTS)),
    "g1_diff_records": lambda s, d: scoring.diff_records(derived(s, d, GOLDEN), live_records(s, d), "id"),
    "g2_score": lambda s, d: scored(s, d).select("id", "verdict_matches", "predicate_ok", "catastrophic_fn", "false_positive", "clean"),
    "g4_gate_report": lambda s, d: scoring.gate_report(scored(s, d)),
    "g4_gate_report_by_vector": lambda s, d: scoring.gate_report(scored(s, d), ["vector"]),
    "g5_missing_cells": lambda s, d: scoring.missing_cells(derived(s, d, GOLDEN), {"class": ["dangerous", "legit", "unknown"], "vector": ["v0", "v1", "v9"]}),
    "g6_headline": lambda s, d: scoring.headline(scoring.gate_report(scored(s, d)), table(s, d, "labels").filter("doc_id % 50 = 0")),
}

RUNAWAY = f"state = 'active' AND query_runtime_millis > {T.runaway_ms}"
AGENT = "coalesce(usename = 'agent' OR application_name = 'proxy', false)"
BASE = f"""WITH RECURSIVE a AS ({duck(ACTIVITY)}), s AS (SELECT * FROM ({duck(SLOTS)}) WHERE retained_wal_bytes > {T.slot_bytes}), t AS ({duck(TICKS)}),
b AS (SELECT cluster_id, tick, coalesce(string_agg(CAST(pid AS VARCHAR), ',' ORDER BY pid) FILTER ({AGENT}), '') AS terminate, coalesce(string_agg(CAST(pid AS VARCHAR), ',' ORDER BY pid) FILTER (NOT {AGENT}), '') AS spared, count(*) AS runaways FROM a WHERE {RUNAWAY} GROUP BY cluster_id, tick),
f AS (SELECT cluster_id, tick, arg_min(slot_name, position) AS slot FROM s GROUP BY cluster_id, tick),
r AS (SELECT t.cluster_id, t.tick, CASE WHEN lag_bytes > {T.lag_bytes} THEN 'lag' WHEN slot IS NOT NULL THEN 'slot:' || slot WHEN runaways >= {T.runaways} THEN 'runaways' END AS reason, probe
  FROM t LEFT JOIN b ON b.cluster_id = t.cluster_id AND b.tick = t.tick LEFT JOIN f ON f.cluster_id = t.cluster_id AND f.tick = t.tick),
n AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY tick) AS i FROM r),
m AS (
  SELECT cluster_id, tick, i, CASE WHEN reason IS NULL THEN 'Closed' ELSE 'Open' END AS state, reason, CASE WHEN reason IS NOT NULL THEN tick END AS opened FROM n WHERE i = 1
  UNION ALL
  SELECT cluster_id, tick, i, CASE WHEN trip IS NOT NULL THEN 'Open' ELSE st END, CASE WHEN trip IS NOT NULL THEN trip WHEN st = 'Closed' THEN NULL ELSE was END, CASE WHEN trip IS NOT NULL AND st <> 'Open' THEN tick WHEN st = 'Closed' THEN NULL ELSE opened END
  FROM (SELECT *, coalesce(reason, CASE WHEN st = 'HalfOpen' AND probe = 'failed' THEN 'probe_failed' END) AS trip
    FROM (SELECT *, CASE WHEN half = 'HalfOpen' AND probe = 'ok' THEN 'Closed' ELSE half END AS st
      FROM (SELECT n.cluster_id, n.tick, n.i, n.reason, n.probe, m.reason AS was, m.opened, CASE WHEN m.state = 'Open' AND n.tick - m.opened >= {T.cooldown_ms} THEN 'HalfOpen' ELSE m.state END AS half
        FROM m JOIN n ON n.cluster_id = m.cluster_id AND n.i = m.i + 1))))"""
G = f"WITH g AS ({duck(GOLDEN)}), x AS (SELECT g.*, v.verdict, v.bytes_out, v.budget_bytes, v.prod_rows_touched, v.reverted_with_verified_diff FROM g JOIN ({duck(OBSERVED)}) v ON v.id = g.id), p AS (SELECT *, verdict = expected_verdict AS verdict_matches, verdict = expected_verdict AND CASE expected_verdict WHEN 'BOUND' THEN bytes_out <= budget_bytes WHEN 'REVERTED' THEN prod_rows_touched = 0 OR reverted_with_verified_diff ELSE true END AS predicate_ok FROM x), q AS (SELECT *, class = 'dangerous' AND (verdict = 'ALLOW' OR NOT predicate_ok) AS catastrophic_fn, class <> 'dangerous' AND verdict <> 'ALLOW' AS false_positive FROM p), s AS (SELECT *, verdict_matches AND predicate_ok AND NOT catastrophic_fn AND NOT false_positive AS clean FROM q)"
REPORT = "count(*) AS total, count(*) FILTER (class = 'dangerous') AS dangerous, count(*) FILTER (class <> 'dangerous') AS legit, count(*) FILTER (catastrophic_fn) AS catastrophic_fn, count(*) FILTER (false_positive) AS false_positives, count(*) FILTER (clean) AS clean, CASE WHEN count(*) FILTER (class <> 'dangerous') > 0 THEN count(*) FILTER (false_positive) / count(*) FILTER (class <> 'dangerous') ELSE 0.0 END AS fp_rate, count(*) FILTER (catastrophic_fn) = 0 AND count(*) FILTER (false_positive) = 0 AND count(*) FILTER (clean) = count(*) AS green"
ALERTS = f""", al AS (SELECT cluster_id, tick, 1 AS o, pid AS p, 'TERMINATE' AS code, CAST(pid AS VARCHAR) AS subject FROM a WHERE {RUNAWAY} AND {AGENT}
      UNION ALL SELECT cluster_id, tick, 2, position, 'SLOT_ALARM', slot_name FROM s UNION ALL SELECT cluster_id, tick, 3, 0, 'BREAKER_TRIP', NULL FROM m WHERE state = 'Open'),
  numbered AS (SELECT cluster_id, tick, row_number() OVER (PARTITION BY cluster_id, tick ORDER BY o, p) - 1 AS ordinal, code, subject FROM al)"""
ORACLES = {
    "f1_assess_backends": BASE + " SELECT * FROM b",
    "f2_slot_alarms": BASE + " SELECT * FROM s",
    "f3_trip_reasons": BASE + " SELECT cluster_id, tick, reason FROM r",
    "f4_breaker_timeline": BASE + " SELECT cluster_id, tick, state, reason, opened FROM m",
    "f4_breaker_stream": BASE + " SELECT cluster_id, tick, state, reason, opened FROM m",
    "f5_alerts": BASE + ALERTS + " SELECT cluster_id, tick, ordinal, code, subject FROM numbered",
    "f5_alert_chain_stream": BASE
    + ALERTS
    + """, entry AS (SELECT 'watch/' || cluster_id AS chain_id, tick AS ts_ms, '{"tick":' || tick || ',"reason_code":"' || code || '","subject":' || coalesce('"' || subject || '"', 'null') || '}' AS payload,
        row_number() OVER (PARTITION BY cluster_id ORDER BY tick, ordinal) - 1 AS seq FROM numbered), chain AS (
      SELECT chain_id, seq, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || payload) AS record_hash, payload, ts_ms FROM entry WHERE seq = 0
      UNION ALL SELECT e.chain_id, e.seq, c.record_hash, sha256(c.record_hash || e.payload), e.payload, e.ts_ms FROM chain c JOIN entry e ON e.chain_id = c.chain_id AND e.seq = c.seq + 1)
      SELECT chain_id, seq, prev_hash, record_hash, payload, ts_ms FROM chain""",
    "f6_verify_chain_stream": chains.TAMPERED + " SELECT chain_id, kind, seq, expected, found FROM breaks",
    "f6_corrupt_chain_stream": chains.DAMAGED + " SELECT chain_id, kind, seq, expected, found FROM worse",
    "c7_audit_grants": f"""WITH g AS (SELECT * FROM ({duck(GRANTS)}) WHERE proposal_id NOT LIKE '%77'), x AS (
      SELECT r.request_id, r.proposal_id, r.at_ms, g.nonce, CASE WHEN g.proposal_id IS NULL THEN 'NO_GRANT' WHEN r.statement_text <> g.statement_text OR r.max_rows <> g.max_rows THEN 'BINDING_MISMATCH' WHEN NOT g.signature_valid THEN 'BAD_SIGNATURE' WHEN r.at_ms >= g.expiry_ms THEN 'EXPIRED' END AS early
      FROM ({duck(REQUESTS)}) r LEFT JOIN g ON g.proposal_id = r.proposal_id)
      SELECT request_id, proposal_id, CASE WHEN early IS NULL AND row_number() OVER (PARTITION BY nonce, early IS NULL ORDER BY at_ms, request_id) > 1 THEN 'REPLAYED_NONCE' ELSE early END AS refused FROM x""",
    "g1_diff_records": f"WITH g AS ({duck(GOLDEN)}) SELECT id, CASE WHEN CAST(id AS BIGINT) % 13 = 0 THEN 'ONLY_IN_GOLDEN' ELSE 'CHANGED' END AS kind FROM g WHERE CAST(id AS BIGINT) % 13 = 0 OR CAST(id AS BIGINT) % 11 = 0 UNION ALL SELECT 'new' || id, 'ONLY_IN_LIVE' FROM g WHERE CAST(id AS BIGINT) % 29 = 0",
    "g2_score": G + " SELECT id, verdict_matches, predicate_ok, catastrophic_fn, false_positive, clean FROM s",
    "g4_gate_report": G + f" SELECT {REPORT} FROM s",
    "g4_gate_report_by_vector": G + f" SELECT vector, {REPORT} FROM s GROUP BY vector",
    "g5_missing_cells": f"WITH g AS ({duck(GOLDEN)}) SELECT c.class, v.vector FROM (VALUES ('dangerous'), ('legit'), ('unknown')) AS c(class), (VALUES ('v0'), ('v1'), ('v9')) AS v(vector) WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.class = c.class AND g.vector = v.vector)",
    "g6_headline": G + ", h AS (SELECT count(*) FILTER (catastrophic_fn) AS fn, (SELECT count(*) FROM labels WHERE doc_id % 50 = 0) AS known FROM s) SELECT fn + known AS headline_fn, fn AS catastrophic_fn, known FROM h",
}
