"""Queries over audit chains. A chain is a user; its records are the user's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from .base import derived, duck

LOG = """
SELECT CAST(user_id AS STRING) AS chain_id, millis(ts) AS ts_ms, event_id,
  '{"event":' || CAST(event_id AS STRING) || ',"reason_code":"' || event_type || '","cents":' || CAST(CAST(round(value * 100) AS BIGINT) AS STRING) || '}' AS payload
FROM {events}
"""
KEYS = {"k1": b"an example key", "k2": b"another example key"}
NOW, DAY = 1_900_000_000_000, 86_400_000


def log(spark: SparkSession, folder: str) -> DataFrame:
    return derived(spark, folder, LOG)


def sealed(spark: SparkSession, folder: str) -> DataFrame:
    return audit.seal(log(spark, folder), ["ts_ms", "event_id"])


#: Chains by remainder: 1 loses a record, 2 has an edited payload, 3 an edited link, 4 a bad genesis; the others are whole.
def tampered(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("chain_id").cast("long") % 9
    rows = sealed(spark, folder).filter(~((k == 1) & (F.col("seq") == 5)))
    payload = F.when((k == 2) & (F.col("seq") % 20 == 7), F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))
    prev = F.when((k == 3) & (F.col("seq") == 3), F.lit("f" * 64)).when((k == 4) & (F.col("seq") == 0), F.lit("1" * 64)).otherwise(F.col("prev_hash"))
    relinked = F.when((k == 4) & (F.col("seq") == 0) | (k == 3) & (F.col("seq") == 3), F.sha2(F.concat(prev, payload), 256)).otherwise(F.col("record_hash"))
    return rows.select("chain_id", "seq", prev.alias("prev_hash"), relinked.alias("record_hash"), payload.alias("payload"), "ts_ms")


def damaged(spark: SparkSession, folder: str) -> DataFrame:
    """Tampered chains, some of whose records lack a payload, number, hash, link or chain."""
    k, seq = F.col("chain_id").cast("long") % 9, F.col("seq")
    gone = {"payload": (k == 5) & (seq % 20 == 3), "seq": (k == 6) & (seq % 30 == 4), "record_hash": (k == 7) & (seq == 2), "prev_hash": (k == 8) & (seq == 1), "chain_id": (k == 0) & (seq % 40 == 11)}
    rows = tampered(spark, folder)
    return rows.select(*[F.when(~gone[c], F.col(c)).alias(c) if c in gone else F.col(c) for c in rows.columns])


def anchored(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors over each chain's first half; some with an unknown key, some over another hash; every seventh chain has none."""
    k = F.col("chain_id").cast("long")
    chain = sealed(spark, folder)
    half = chain.groupBy("chain_id").agg(F.max("seq").alias("top")).withColumn("at", F.when(k % 5 == 0, F.col("top")).otherwise(F.floor(F.col("top") / 2)))
    heads = chain.join(half, "chain_id").filter((F.col("seq") == F.col("at")) & (k % 7 != 0)).select("chain_id", F.col("record_hash").alias("head_hash"), "seq", "ts_ms")
    a = audit.make_anchors(heads, "k1", KEYS)
    return a.withColumn("signature", F.when(k % 11 == 3, F.lit("00")).otherwise(F.col("signature"))).withColumn("key_id", F.when(k % 13 == 4, "lost").otherwise(F.col("key_id")))


SEALED = f"""
WITH RECURSIVE log AS ({duck(LOG)}), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY ts_ms, event_id) - 1 AS seq FROM log
), chain AS (
  SELECT chain_id, seq, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || payload) AS record_hash, payload, ts_ms FROM numbered WHERE seq = 0
  UNION ALL
  SELECT n.chain_id, n.seq, c.record_hash, sha256(c.record_hash || n.payload), n.payload, n.ts_ms
  FROM chain c JOIN numbered n ON n.chain_id = c.chain_id AND n.seq = c.seq + 1
)"""
TAMPERED = (
    SEALED
    + """, marked AS (SELECT *, CAST(chain_id AS BIGINT) % 9 AS k FROM chain), edited AS (
  SELECT chain_id, seq, k, record_hash AS old_hash, ts_ms,
    CASE WHEN k = 2 AND seq % 20 = 7 THEN payload || ' ' ELSE payload END AS payload,
    CASE WHEN k = 3 AND seq = 3 THEN repeat('f', 64) WHEN k = 4 AND seq = 0 THEN repeat('1', 64) ELSE prev_hash END AS prev_hash
  FROM marked WHERE NOT (k = 1 AND seq = 5)
), t AS (
  SELECT chain_id, seq, prev_hash, CASE WHEN k = 4 AND seq = 0 OR k = 3 AND seq = 3 THEN sha256(prev_hash || payload) ELSE old_hash END AS record_hash, payload, ts_ms FROM edited
), w AS (
  SELECT *, sha256(prev_hash || payload) AS expected_hash, lag(seq) OVER o AS prev_seq, lag(record_hash) OVER o AS prev_record_hash, row_number() OVER o - 1 AS index
  FROM t WINDOW o AS (PARTITION BY chain_id ORDER BY seq, record_hash)
), b AS (
  SELECT *, CASE WHEN expected_hash <> record_hash THEN 'HASH_MISMATCH' WHEN prev_seq IS NULL AND prev_hash <> repeat('0', 64) THEN 'BAD_GENESIS'
    WHEN prev_seq IS NOT NULL AND seq <> prev_seq + 1 THEN 'SEQ_GAP' WHEN prev_seq IS NOT NULL AND prev_hash <> prev_record_hash THEN 'BROKEN_LINK' END AS kind FROM w
), breaks AS (
  SELECT chain_id, kind, index, seq,
    CASE kind WHEN 'HASH_MISMATCH' THEN expected_hash WHEN 'BAD_GENESIS' THEN repeat('0', 64) WHEN 'SEQ_GAP' THEN CAST(prev_seq + 1 AS VARCHAR) ELSE prev_record_hash END AS expected,
    CASE kind WHEN 'HASH_MISMATCH' THEN record_hash WHEN 'SEQ_GAP' THEN CAST(seq AS VARCHAR) ELSE prev_hash END AS found
  FROM b WHERE kind IS NOT NULL
), first AS (
  SELECT c.chain_id, f.chain_id IS NULL AS ok, f.kind, f.index, f.seq, f.expected, f.found
  FROM (SELECT DISTINCT chain_id FROM t) c LEFT JOIN (SELECT * FROM breaks QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY index) = 1) f ON f.chain_id = c.chain_id
)"""
)
DAMAGED = (
    TAMPERED
    + """, d AS (
  SELECT CASE WHEN NOT (m = 0 AND s % 40 = 11) THEN chain_id END AS chain_id, CASE WHEN NOT (m = 6 AND s % 30 = 4) THEN s END AS seq, CASE WHEN NOT (m = 8 AND s = 1) THEN prev_hash END AS prev_hash,
    CASE WHEN NOT (m = 7 AND s = 2) THEN record_hash END AS record_hash, CASE WHEN NOT (m = 5 AND s % 20 = 3) THEN payload END AS payload
  FROM (SELECT *, seq AS s, CAST(chain_id AS BIGINT) % 9 AS m FROM t)
), placed AS (
  SELECT *, sha256(prev_hash || payload) AS expected_hash, lag(seq) OVER o AS prev_seq, lag(record_hash) OVER o AS prev_record_hash, row_number() OVER o - 1 AS index
  FROM d WHERE chain_id IS NOT NULL AND seq IS NOT NULL AND record_hash IS NOT NULL WINDOW o AS (PARTITION BY chain_id ORDER BY seq, record_hash)
), worse AS (
  SELECT chain_id, kind, index, seq,
    CASE kind WHEN 'HASH_MISMATCH' THEN expected_hash WHEN 'BAD_GENESIS' THEN repeat('0', 64) WHEN 'SEQ_GAP' THEN CAST(prev_seq + 1 AS VARCHAR) WHEN 'BROKEN_LINK' THEN prev_record_hash END AS expected,
    CASE kind WHEN 'CORRUPT' THEN lacks WHEN 'HASH_MISMATCH' THEN record_hash WHEN 'SEQ_GAP' THEN CAST(seq AS VARCHAR) ELSE prev_hash END AS found
  FROM (SELECT *, CASE WHEN lacks <> '' THEN 'CORRUPT' WHEN expected_hash <> record_hash THEN 'HASH_MISMATCH' WHEN prev_seq IS NULL AND prev_hash <> repeat('0', 64) THEN 'BAD_GENESIS'
      WHEN prev_seq IS NOT NULL AND seq <> prev_seq + 1 THEN 'SEQ_GAP' WHEN prev_seq IS NOT NULL AND prev_hash <> prev_record_hash THEN 'BROKEN_LINK' END AS kind
    FROM (SELECT *, concat_ws(',', CASE WHEN prev_hash IS NULL THEN 'prev_hash' END, CASE WHEN payload IS NULL THEN 'payload' END) AS lacks FROM placed)) WHERE kind IS NOT NULL
  UNION ALL
  SELECT chain_id, 'CORRUPT', NULL, seq, NULL, concat_ws(',', CASE WHEN chain_id IS NULL THEN 'chain_id' END, CASE WHEN seq IS NULL THEN 'seq' END, CASE WHEN prev_hash IS NULL THEN 'prev_hash' END,
    CASE WHEN record_hash IS NULL THEN 'record_hash' END, CASE WHEN payload IS NULL THEN 'payload' END) FROM d WHERE chain_id IS NULL OR seq IS NULL OR record_hash IS NULL
)"""
)
REASONED = ", r AS (SELECT *, json_extract_string(payload, '$.reason_code') AS reason_code FROM t)"

QUERIES = {
    "a1_check_record_hash": lambda s, d: audit.check_record_hash(tampered(s, d)).select("chain_id", "seq", "expected_hash", "hash_ok"),
    "a2_verify_chain": lambda s, d: audit.verify_chain(tampered(s, d), 16),
    "a3_chain_breaks": lambda s, d: audit.chain_breaks(tampered(s, d), 16),
    "a2_verify_damaged_chain": lambda s, d: audit.verify_chain(damaged(s, d), 16),
    "a3_corrupt_records": lambda s, d: audit.chain_breaks(damaged(s, d), 16),
    "a4_chain_summary": lambda s, d: audit.chain_summary(tampered(s, d), 16),
    "a5_chain_heads": lambda s, d: audit.chain_heads(sealed(s, d)),
    "a6_verify_anchors": lambda s, d: audit.verify_anchors(sealed(s, d), anchored(s, d), KEYS),
    "a6b_verify_anchor_prefix": lambda s, d: audit.verify_anchors(sealed(s, d), anchored(s, d), KEYS, prefix=True),
    "a7_seal": lambda s, d: sealed(s, d),
    "a8_due_anchors": lambda s, d: audit.due_anchors(log(s, d), 5 * DAY),
    "a9_audit_tail": lambda s, d: audit.audit_tail(sealed(s, d), 10).select("chain_id", "seq", "record_hash", F.col("back").cast("long").alias("back")),
    "a10_chain_constraints": lambda s, d: audit.chain_constraints(doubled(s, d)),
    "a18_decision_rollup": lambda s, d: audit.decision_rollup(log(s, d).withColumn("reason_code", audit.reason_code()), ["chain_id", "reason_code"]),
    "a19_verify_then_anchor": lambda s, d: audit.verify_then_anchor(tampered(s, d), anchored(s, d), KEYS, "k2", NOW).drop("signature"),
    "p11_rejections": lambda s, d: audit.rejections(decisions(s, d)),
    "w6_latest_anchors": lambda s, d: audit.latest_anchors(audit.make_anchors(sealed(s, d).filter("seq % 10 = 0").select("chain_id", F.col("record_hash").alias("head_hash"), "seq", "ts_ms"), "k1", KEYS)).drop("signature"),
}


def doubled(spark: SparkSession, folder: str) -> DataFrame:
    """A chain with repeated records, negative numbers and repeated hashes."""
    chain = sealed(spark, folder)
    again = chain.filter("seq % 50 = 3").withColumn("seq", F.when(F.col("chain_id").cast("long") % 2 == 0, -F.col("seq")).otherwise(F.col("seq")))
    return chain.unionByName(again)


DECISIONS = "SELECT event_id, CASE event_type WHEN 'error' THEN 'BLOCK' WHEN 'signup' THEN 'HOLD' ELSE 'ALLOW' END AS decision FROM {events}"


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    return derived(spark, folder, DECISIONS)


ORACLES = {
    "a1_check_record_hash": TAMPERED + " SELECT chain_id, seq, expected_hash, expected_hash = record_hash AS hash_ok FROM w",
    "a2_verify_chain": TAMPERED + " SELECT * FROM first",
    "a3_chain_breaks": TAMPERED + " SELECT * FROM breaks",
    "a2_verify_damaged_chain": DAMAGED
    + """ SELECT c.chain_id, f.kind IS NULL AS ok, f.kind, f.index, f.seq, f.expected, f.found FROM (SELECT DISTINCT chain_id FROM d) c
    LEFT JOIN (SELECT * FROM worse QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY index NULLS LAST, kind, seq NULLS FIRST, expected, found) = 1) f ON f.chain_id IS NOT DISTINCT FROM c.chain_id""",
    "a3_corrupt_records": DAMAGED + " SELECT * FROM worse",
    "a4_chain_summary": TAMPERED
    + REASONED
    + """ SELECT r.chain_id, any_value(h.length) AS length, any_value(h.head_hash) AS head_hash, r.reason_code, count(*) AS n FROM r
    JOIN (SELECT chain_id, count(*) AS length, arg_max(record_hash, seq) AS head_hash FROM t GROUP BY chain_id) h ON h.chain_id = r.chain_id
    JOIN first ON first.chain_id = r.chain_id AND first.ok GROUP BY r.chain_id, r.reason_code""",
    "a5_chain_heads": SEALED + " SELECT chain_id, arg_max(record_hash, seq) AS head_hash, max(seq) AS seq, arg_max(ts_ms, seq) AS ts_ms FROM chain GROUP BY chain_id",
    "a6_verify_anchors": SEALED
    + """ SELECT chain_id, CASE WHEN CAST(chain_id AS BIGINT) % 7 = 0 THEN 'NO_ANCHOR' WHEN CAST(chain_id AS BIGINT) % 11 = 3 OR CAST(chain_id AS BIGINT) % 13 = 4 THEN 'BAD_SIGNATURE'
    WHEN CAST(chain_id AS BIGINT) % 5 = 0 OR max(seq) = 0 THEN 'VERIFIED' ELSE 'HEAD_MISMATCH' END AS status,
    CASE WHEN CAST(chain_id AS BIGINT) % 7 = 0 THEN NULL WHEN CAST(chain_id AS BIGINT) % 5 = 0 THEN max(seq) ELSE max(seq) // 2 END AS anchored_seq FROM chain GROUP BY chain_id""",
    "a6b_verify_anchor_prefix": SEALED
    + """ SELECT chain_id, CASE WHEN CAST(chain_id AS BIGINT) % 7 = 0 THEN 'NO_ANCHOR' WHEN CAST(chain_id AS BIGINT) % 11 = 3 OR CAST(chain_id AS BIGINT) % 13 = 4 THEN 'BAD_SIGNATURE' ELSE 'VERIFIED' END AS status,
    CASE WHEN CAST(chain_id AS BIGINT) % 7 = 0 THEN NULL WHEN CAST(chain_id AS BIGINT) % 5 = 0 THEN max(seq) ELSE max(seq) // 2 END AS anchored_seq FROM chain GROUP BY chain_id""",
    "a19_verify_then_anchor": TAMPERED
    + f""", a AS (SELECT c.chain_id, c.record_hash AS anchored, c.seq AS at, c.ts_ms AS last_ms, CAST(c.chain_id AS BIGINT) AS i FROM chain c
      JOIN (SELECT chain_id, CASE WHEN CAST(chain_id AS BIGINT) % 5 = 0 THEN max(seq) ELSE max(seq) // 2 END AS at FROM chain GROUP BY chain_id) m ON m.chain_id = c.chain_id AND m.at = c.seq WHERE CAST(c.chain_id AS BIGINT) % 7 <> 0),
    h AS (SELECT chain_id, arg_max(record_hash, seq) AS head_hash, max(seq) AS seq FROM t GROUP BY chain_id)
    SELECT h.chain_id, h.head_hash, h.seq, CAST({NOW} AS BIGINT) AS ts_ms, 'k2' AS key_id FROM h JOIN first ON first.chain_id = h.chain_id AND first.ok LEFT JOIN a ON a.chain_id = h.chain_id
    LEFT JOIN t ON t.chain_id = a.chain_id AND t.seq = a.at WHERE a.chain_id IS NULL OR (t.record_hash = a.anchored AND i % 11 <> 3 AND i % 13 <> 4 AND {NOW} - last_ms >= 0)""",
    "a7_seal": SEALED + " SELECT chain_id, seq, prev_hash, record_hash, payload, ts_ms FROM chain",
    "a8_due_anchors": f"""WITH RECURSIVE log AS ({duck(LOG)}), due AS (
      SELECT chain_id, min(ts_ms) AS ts_ms FROM log GROUP BY chain_id
      UNION ALL SELECT d.chain_id, (SELECT min(l.ts_ms) FROM log l WHERE l.chain_id = d.chain_id AND l.ts_ms >= d.ts_ms + {5 * DAY}) FROM due d WHERE d.ts_ms IS NOT NULL
    ) SELECT chain_id, ts_ms FROM due WHERE ts_ms IS NOT NULL""",
    "a9_audit_tail": SEALED + " SELECT chain_id, seq, record_hash, row_number() OVER (PARTITION BY chain_id ORDER BY seq DESC) AS back FROM chain QUALIFY back <= 10",
    "a10_chain_constraints": SEALED
    + """, d AS (SELECT * FROM chain UNION ALL SELECT chain_id, CASE WHEN CAST(chain_id AS BIGINT) % 2 = 0 THEN -seq ELSE seq END, prev_hash, record_hash, payload, ts_ms FROM chain WHERE seq % 50 = 3)
    SELECT chain_id, 'DUPLICATE_SEQ' AS violation, CAST(seq AS VARCHAR) AS value, count(*) AS n FROM d GROUP BY chain_id, seq HAVING count(*) > 1
    UNION ALL SELECT chain_id, 'DUPLICATE_RECORD_HASH', record_hash, count(*) FROM d GROUP BY chain_id, record_hash HAVING count(*) > 1
    UNION ALL SELECT chain_id, 'NEGATIVE_SEQ', CAST(seq AS VARCHAR), count(*) FROM d WHERE seq < 0 GROUP BY chain_id, seq""",
    "a18_decision_rollup": f"WITH log AS ({duck(LOG)}), r AS (SELECT chain_id, json_extract_string(payload, '$.reason_code') AS reason_code FROM log) SELECT chain_id, reason_code, count(*) AS n, CAST(grouping(chain_id, reason_code) AS BIGINT) AS level FROM r GROUP BY ROLLUP (chain_id, reason_code)",
    "p11_rejections": f"SELECT * FROM ({duck(DECISIONS)}) WHERE decision <> 'ALLOW'",
    "w6_latest_anchors": SEALED + " SELECT chain_id, arg_max(record_hash, seq) AS head_hash, max(seq) AS seq, arg_max(ts_ms, seq) AS ts_ms, 'k1' AS key_id FROM chain WHERE seq % 10 = 0 GROUP BY chain_id",
}
