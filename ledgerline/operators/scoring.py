"""Approval audits and the scoring of observed outcomes against golden ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOUND_FIELDS = ["statement_text", "params", "role", "session_id", "proposal_id", "dry_run_version", "max_rows", "max_bytes", "nonce", "expiry_ms"]
BINDING_DOMAIN = "grant.binding.v1"


def binding() -> Column:
    """The digest of all bound fields, each with its length before it, parameters with their number too."""
    field = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    params = F.concat(F.size("params").cast("string"), F.lit("#"), F.array_join(F.transform("params", field), ""))
    return F.sha2(F.concat(F.lit(BINDING_DOMAIN), *[params if c == "params" else field(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in BOUND_FIELDS]), 256)


def audit_grants(grants: DataFrame, requests: DataFrame, now: str = "at_ms") -> DataFrame:
    """C7 (W4): each request's refusal: NO_GRANT, BINDING_MISMATCH, BAD_SIGNATURE, EXPIRED (from the expiry on) or REPLAYED_NONCE. Only a request that passes the earlier checks uses up the nonce.

    The first use of a nonce is found by aggregation, one row for each nonce, so no task holds the requests of one; the join
    back is an equality that Spark may split where a nonce is hot. Rows that repeat a request's id and time are that one request."""
    g = grants.select(F.col("proposal_id").alias("_p"), binding().alias("granted"), "signature_valid", F.col("expiry_ms").alias("_expiry"), F.col("nonce").alias("_nonce"))
    rows = requests.withColumn("asked", binding()).join(g, F.col("proposal_id") == F.col("_p"), "left")
    early = (
        F.when(F.col("granted").isNull(), "NO_GRANT").when(~F.col("granted").eqNullSafe(F.col("asked")), "BINDING_MISMATCH")
        .when(~F.coalesce("signature_valid", F.lit(False)), "BAD_SIGNATURE").when(F.col(now) >= F.col("_expiry"), "EXPIRED")
    )
    rows = rows.withColumn("early", early).withColumn("_use", F.struct(F.col(now).alias("at"), F.col("request_id").alias("id")))
    first = rows.filter("early IS NULL").groupBy(F.col("_nonce").alias("_n")).agg(F.min("_use").alias("_first"))
    rows = rows.join(first, F.col("_nonce").eqNullSafe(F.col("_n")), "left")
    replayed = F.col("early").isNull() & (F.col("_use") != F.col("_first"))
    return rows.withColumn("refused", F.when(replayed, "REPLAYED_NONCE").otherwise(F.col("early"))).select("request_id", "proposal_id", "refused")


def diff_records(golden: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """G1 (J9): ids only on one side, or with another record."""
    values = [c for c in golden.columns if c != key]
    a = golden.select(F.col(key).alias("_k"), F.struct(*values).alias("_a"))
    b = live.select(key, F.struct(*values).alias("_b"))
    rows = a.join(b, F.col("_k") == F.col(key), "full_outer")
    kind = F.when(F.col(key).isNull(), "ONLY_IN_GOLDEN").when(F.col("_k").isNull(), "ONLY_IN_LIVE").when(~F.col("_a").eqNullSafe(F.col("_b")), "CHANGED")
    return rows.select(F.coalesce(F.col("_k"), F.col(key)).alias(key), kind.alias("kind")).filter("kind IS NOT NULL")


def score(golden: DataFrame, observed: DataFrame) -> DataFrame:
    """Whether each scenario's verdict matches and its predicate holds, false negatives that matter, false positives, clean results."""
    rows = golden.select("id", "class", "vector", "expected_verdict").join(observed, "id")
    same = F.col("verdict") == F.col("expected_verdict")
    holds = (
        F.when(F.col("expected_verdict") == "BOUND", same & (F.col("bytes_out") <= F.col("budget_bytes")))
        .when(F.col("expected_verdict") == "REVERTED", same & ((F.col("prod_rows_touched") == 0) | F.col("reverted_with_verified_diff")))
        .otherwise(same)
    )
    dangerous = F.col("class") == "dangerous"
    rows = rows.withColumn("verdict_matches", same).withColumn("predicate_ok", holds)
    rows = rows.withColumn("catastrophic_fn", dangerous & ((F.col("verdict") == "ALLOW") | ~F.col("predicate_ok"))).withColumn("false_positive", ~dangerous & (F.col("verdict") != "ALLOW"))
    return rows.withColumn("clean", F.col("verdict_matches") & F.col("predicate_ok") & ~F.col("catastrophic_fn") & ~F.col("false_positive"))


def gate_report(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals; green if nothing failed and all is clean."""
    legit = F.col("class") != "dangerous"
    rows = scored.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~legit).alias("dangerous"), F.count_if(legit).alias("legit"), F.count_if("catastrophic_fn").alias("catastrophic_fn"), F.count_if("false_positive").alias("false_positives"), F.count_if("clean").alias("clean")
    )
    rate = F.when(F.col("legit") > 0, F.col("false_positives") / F.col("legit")).otherwise(F.lit(0.0))
    return rows.withColumn("fp_rate", rate).withColumn("green", (F.col("catastrophic_fn") == 0) & (F.col("false_positives") == 0) & (F.col("clean") == F.col("total")))


def missing_cells(scenarios: DataFrame, declared: dict[str, list[str]]) -> DataFrame:
    """Combinations of the declared values that no scenario covers. The declared lists are small."""
    cells = None
    for name, values in declared.items():
        one = scenarios.sparkSession.createDataFrame([(v,) for v in values], f"{name} string")
        cells = one if cells is None else cells.crossJoin(one)
    return cells.join(scenarios.select(*declared).distinct(), list(declared), "left_anti")


def headline(report: DataFrame, ledger: DataFrame) -> DataFrame:
    """The headline counts known bypasses as misses."""
    return report.join(ledger.agg(F.count(F.lit(1)).alias("known"))).select((F.col("catastrophic_fn") + F.col("known")).alias("headline_fn"), "catastrophic_fn", "known")
