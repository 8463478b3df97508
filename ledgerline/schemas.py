"""Declared schemas and ordered enumerations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHAIN = "chain_id string, seq long, prev_hash string, record_hash string, payload string, ts_ms long"
ANCHOR = "chain_id string, head_hash string, seq long, ts_ms long, key_id string, signature string"
ROLE_POLICY = (
    "role string, select_whitelist array<string>, max_bytes long, max_rows long, max_plan_cost double, max_plan_rows long, "
    "window_ms long, window_max_bytes long, window_max_rows long"
)
GOLDEN = "id string, class string, payload string, vector string, expected_verdict string, defense_layer string, revert_diff_expected boolean"
ACTIVITY = "cluster_id long, tick long, pid long, usename string, application_name string, state string, query_runtime_millis long"
GENESIS = "0" * 64

#: Orders of the enumerations, lowest first.
VERDICTS = ["ALLOW", "ESCALATE", "HOLD", "BLOCK"]
TRUST = ["Untrusted", "Agent", "Operator"]
LOCKS = [
    "AccessShare", "RowShare", "RowExclusive", "ShareUpdateExclusive", "Share", "ShareRowExclusive", "Exclusive", "AccessExclusive",
]
#: The highest trust each event allows, and each level's budget in basis points.
TRUST_CEILING = {
    "BenignRead": "Operator", "BenignWrite": "Operator", "SuspiciousPattern": "Agent", "FloorTripped": "Untrusted",
    "SlowDripSuspected": "Untrusted", "OperatorQuarantine": "Untrusted",
}
BUDGET_BP = {"Untrusted": 1_000, "Agent": 5_000, "Operator": 10_000}


def rank(column: Column | str, order: list[str]) -> Column:
    """The place of a label in its order, null for labels outside it."""
    c = F.col(column) if isinstance(column, str) else column
    place = F.array_position(F.lit(order), c)
    return F.when(place > 0, place.cast("int") - 1)


def label(place: Column, order: list[str]) -> Column:
    return F.get(F.lit(order), place)
