"""Queries through the sources and sinks: what is written to the shared folder is what is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, scoring, watch
from ..sources import tables, versions
from ..sources.shared import shared_folder
from . import audit as chains
from . import watch as fleet
from . import writes
from .base import duck


def folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def chain_files(s: SparkSession, d: str) -> DataFrame:
    path = folder(s, "chain")
    sealed = chains.sealed(s, d)
    tables.append_chain(sealed.filter("seq % 2 = 0"), path)
    tables.append_chain(sealed.filter("seq % 2 = 1"), path)
    return tables.read_chain(s, path).select("chain_id", "seq", "record_hash", "corrupt", F.col("parsed.cents").alias("cents"))


def corrupt_files(s: SparkSession, d: str) -> DataFrame:
    """Stored records, a hundredth of which hold payloads that are no JSON: breaks, as any other."""
    path = folder(s, "chain")
    bad = F.col("seq") % 100 == 13
    tables.append_chain(chains.sealed(s, d).withColumn("payload", F.when(bad, F.concat(F.lit("{cut off "), F.col("seq").cast("string"))).otherwise(F.col("payload"))), path)
    return audit.chain_breaks(tables.read_chain(s, path), 16)


def anchor_files(s: SparkSession, d: str) -> DataFrame:
    path = folder(s, "anchors")
    tables.append_anchors(audit.make_anchors(audit.chain_heads(chains.sealed(s, d)), "k1", chains.KEYS), path)
    return tables.read_anchors(s, path).drop("signature")


def allowed(s: SparkSession, d: str) -> DataFrame:
    policy = s.sql("SELECT 'reader' AS role, array('orders', 'customer') AS select_whitelist")
    found = tables.read_allowed(s, d, "reader", ["customer", "lineitem", "orders"], policy)
    return writes.counts_of(dict(sorted(found.items())))


def golden_files(s: SparkSession, d: str) -> DataFrame:
    """Expected outcomes of the labels, written as files of one JSON array each and read back."""
    path = folder(s, "golden")
    tables.write_golden(fleet.golden(s, d), path, 500)
    return tables.read_golden(s, path).select("id", "class", "vector", "expected_verdict")


def activity_stream(s: SparkSession, d: str) -> DataFrame:
    """Backend samples written as files, streamed, and counted once all are taken."""
    path = folder(s, "samples")
    fleet.activity(s, d).write.parquet(f"{path}/in")
    stream = tables.read_activity(s, f"{path}/in").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    return s.read.parquet(f"{path}/out").groupBy("cluster_id", "tick").agg(F.count(F.lit(1)).alias("n"), F.max("query_runtime_millis").alias("longest"))


def published(s: SparkSession, d: str) -> DataFrame:
    base = folder(s, "published")
    t = writes.tables(s, d, "customer", "orders")
    versions.publish(t, base)
    versions.publish({"orders": writes.second(t["orders"])}, base)
    return writes.counts_of({n: versions.read(s, base, n) for n in ("customer", "orders")})


QUERIES = {
    "s1_chain_files": chain_files,
    "s1_corrupt_files": corrupt_files,
    "s3_anchor_files": anchor_files,
    "s4_golden_files": golden_files,
    "s5_read_allowed": allowed,
    "s6_activity_stream": activity_stream,
    "s7_published_versions": published,
    "w5_predecessor": lambda s, d: audit.with_predecessor(chains.sealed(s, d), 16).select("chain_id", "seq", "prev_seq", "prev_record_hash", "index"),
    "p12_agent_tagged": lambda s, d: fleet.activity(s, d).filter(watch.tagged(fleet.T)).select("pid"),
    "j6_binding": lambda s, d: fleet.bound(s, d, fleet.GRANTS).select("proposal_id", scoring.binding().alias("binding")),
}
FIELD = "CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || {0}"
BOUND = " || ".join("'2#' || " + FIELD.format("p1") + " || " + FIELD.format("p2") if c == "params" else FIELD.format(c) for c in scoring.BOUND_FIELDS)
ORACLES = {
    "s1_chain_files": chains.SEALED + " SELECT chain_id, seq, record_hash, false AS corrupt, CAST(json_extract(payload, '$.cents') AS BIGINT) AS cents FROM chain",
    "s1_corrupt_files": chains.SEALED + " SELECT chain_id, 'CORRUPT' AS kind, seq AS index, seq, CAST(NULL AS VARCHAR) AS expected, 'payload' AS found FROM chain WHERE seq % 100 = 13",
    "s3_anchor_files": chains.SEALED + " SELECT chain_id, arg_max(record_hash, seq) AS head_hash, max(seq) AS seq, arg_max(ts_ms, seq) AS ts_ms, 'k1' AS key_id FROM chain GROUP BY chain_id",
    "s4_golden_files": f"SELECT id, class, vector, expected_verdict FROM ({duck(fleet.GOLDEN)})",
    "s6_activity_stream": f"SELECT cluster_id, tick, count(*) AS n, max(query_runtime_millis) AS longest FROM ({duck(fleet.ACTIVITY)}) GROUP BY cluster_id, tick",
    "s5_read_allowed": "SELECT 'customer' AS relation, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders",
    "s7_published_versions": writes.BASE + " SELECT 'customer' AS relation, count(*) AS n FROM c UNION ALL SELECT 'orders', count(*) FROM o2",
    "w5_predecessor": chains.SEALED + " SELECT chain_id, seq, lag(seq) OVER w AS prev_seq, lag(record_hash) OVER w AS prev_record_hash, row_number() OVER w - 1 AS index FROM chain WINDOW w AS (PARTITION BY chain_id ORDER BY seq)",
    "p12_agent_tagged": f"SELECT pid FROM ({duck(fleet.ACTIVITY)}) WHERE usename = 'agent' OR application_name = 'proxy'",
    "j6_binding": f"SELECT proposal_id, sha256('{scoring.BINDING_DOMAIN}' || {BOUND}) AS binding FROM ({duck(fleet.GRANTS)})",
}
