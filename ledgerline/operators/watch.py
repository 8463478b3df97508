"""Watching fleets: runaway backends, slot alarms, trip reasons, circuit breakers and alerts, by cluster and tick."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import folded


@dataclass(frozen=True)
class Thresholds:
    """The defaults."""

    runaway_ms: int = 60_000
    slot_bytes: int = 64 << 20
    lag_bytes: int = 128 << 20
    runaways: int = 3
    cooldown_ms: int = 30_000
    agent_role: str = "agent"
    proxy_tag: str = "proxy"


def tagged(t: Thresholds) -> Column:
    """Whether a backend belongs to an agent."""
    return F.coalesce((F.col("usename") == t.agent_role) | (F.col("application_name") == t.proxy_tag), F.lit(False))


def runaway(t: Thresholds) -> Column:
    return F.coalesce((F.col("state") == "active") & (F.col("query_runtime_millis") > t.runaway_ms), F.lit(False))


def assess_backends(activity: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """for each cluster and tick with runaways, the pids to terminate (agents') and those spared, and how many there are."""
    rows = activity.filter(runaway(t)).withColumn("_agent", tagged(t))
    pids = lambda own: F.array_sort(F.collect_list(F.when(F.col("_agent") == own, F.col("pid"))))
    return rows.groupBy("cluster_id", "tick").agg(pids(True).alias("terminate"), pids(False).alias("spared"), F.count(F.lit(1)).alias("runaways"))


def slot_alarms(slots: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """slots that retain more than the ceiling."""
    return slots.filter(F.col("retained_wal_bytes") > t.slot_bytes)


def reason(t: Thresholds, slot: Column) -> Column:
    """why a tick trips, given lag_bytes, its first offending slot and runaways; null if it doesn't."""
    return F.when(F.col("lag_bytes") > t.lag_bytes, "lag").when(slot.isNotNull(), F.concat(F.lit("slot:"), slot)).when(F.col("runaways") >= t.runaways, "runaways")


def trip_reasons(ticks: DataFrame, backends: DataFrame, alarms: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """F3 (and L4): each tick's reason to trip, lag before slots before runaways; the first offending slot, in order of ``position``, is named. ``ticks``: cluster_id, tick, lag_bytes."""
    first = alarms.groupBy("cluster_id", "tick").agg(F.min_by("slot_name", "position").alias("slot"))
    rows = ticks.join(backends.select("cluster_id", "tick", "runaways"), ["cluster_id", "tick"], "left").join(first, ["cluster_id", "tick"], "left")
    return rows.select("cluster_id", "tick", reason(t, F.col("slot")).alias("reason"))


@dataclass
class Breaker:
    """Closed, Open or HalfOpen, with the time it opened and why."""

    state: str = "Closed"
    opened: int | None = None
    reason: str | None = None

    def tick(self, now: int, reason: str | None, probe: str | None, cooldown_ms: int) -> None:
        if self.state == "Open" and now - self.opened >= cooldown_ms:
            self.state = "HalfOpen"
        if self.state == "HalfOpen" and probe == "ok":
            self.state, self.opened, self.reason = "Closed", None, None
        if reason is None and self.state == "HalfOpen" and probe == "failed":
            reason = "probe_failed"
        if reason is not None:
            if self.state != "Open":  # a trip while open only refreshes the reason
                self.state, self.opened = "Open", now
            self.reason = reason


TIMELINE = "cluster_id long, tick long, state string, reason string, opened long"


def breaker_fold(ticks: pd.DataFrame, breaker: Breaker, cooldown_ms: int) -> pd.DataFrame:
    out = []
    for row in ticks.sort_values("tick").itertuples(index=False):
        text = lambda x: x if isinstance(x, str) else None
        breaker.tick(row.tick, text(row.reason), text(row.probe), cooldown_ms)
        out.append((row.cluster_id, row.tick, breaker.state, breaker.reason, breaker.opened))
    frame = pd.DataFrame(out, columns=[x.split()[0] for x in TIMELINE.split(", ")])
    return frame.astype({"opened": "Int64"})


def breaker_timeline(ticks: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """the breaker after each tick (cluster_id, tick, reason, probe). A cluster's ticks are folded in order by one task, which keeps only the breaker."""

    def step(breaker: Breaker, row: dict) -> tuple:
        breaker.tick(row["tick"], row["reason"], row["probe"], t.cooldown_ms)
        return row["cluster_id"], row["tick"], breaker.state, breaker.reason, breaker.opened

    return folded(ticks.select("cluster_id", "tick", "reason", "probe"), "cluster_id", ["tick"], lambda _: Breaker(), step, TIMELINE)


def alert_list(pids: Column, slots: Column, state: Column) -> Column:
    """a tick's alerts in order, each a code and a subject: terminations, slot alarms (structs with slot_name), then BREAKER_TRIP while the breaker is open."""
    none = F.array().cast("array<struct<code:string,subject:string>>")
    kill = F.transform(pids, lambda p: F.struct(F.lit("TERMINATE").alias("code"), p.cast("string").alias("subject")))
    alarm = F.transform(slots, lambda s: F.struct(F.lit("SLOT_ALARM").alias("code"), s["slot_name"].alias("subject")))
    trip = F.when(state == "Open", F.array(F.struct(F.lit("BREAKER_TRIP").alias("code"), F.lit(None).cast("string").alias("subject")))).otherwise(none)
    return F.concat(F.coalesce(kill, none), F.coalesce(alarm, none), trip)


def alert_rows(rows: DataFrame, all_: Column) -> DataFrame:
    return rows.select("cluster_id", "tick", F.posexplode(all_).alias("ordinal", "a")).select("cluster_id", "tick", F.col("ordinal").cast("long").alias("ordinal"), "a.code", "a.subject")


def alerts(timeline: DataFrame, backends: DataFrame, alarms: DataFrame) -> DataFrame:
    """for each tick its terminations, then slot alarms, then BREAKER_TRIP while the breaker is open, numbered in this order. Spared backends and idle ticks give none."""
    slots = alarms.groupBy("cluster_id", "tick").agg(F.array_sort(F.collect_list(F.struct("position", "slot_name"))).alias("slots"))
    rows = timeline.join(backends.select("cluster_id", "tick", "terminate"), ["cluster_id", "tick"], "left").join(slots, ["cluster_id", "tick"], "left")
    return alert_rows(rows, alert_list(F.col("terminate"), F.col("slots"), F.col("state")))


def alert_log(alerts: DataFrame) -> DataFrame:
    """Alerts as entries of audit chains, one for each cluster, to be sealed in the order of ts_ms and ordinal."""
    subject = F.coalesce(F.concat(F.lit('"'), F.regexp_replace("subject", r'(["\\])', r"\\$1"), F.lit('"')), F.lit("null"))
    payload = F.concat(F.lit('{"tick":'), F.col("tick").cast("string"), F.lit(',"reason_code":"'), F.col("code"), F.lit('","subject":'), subject, F.lit("}"))
    return alerts.select(F.concat(F.lit("watch/"), F.col("cluster_id").cast("string")).alias("chain_id"), F.col("tick").alias("ts_ms"), "ordinal", payload.alias("payload"))
