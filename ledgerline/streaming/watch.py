"""Streaming breakers and chain verification."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import audit, watch
from ..schemas import GENESIS
from ..sources.tables import append_batch
from ..sources.versions import scratch
from .meter import in_order

STEPPED = "cluster_id long, tick long, state string, terminate array<long>, slots array<struct<position:long,slot_name:string>>"


def watch_stream(activity: DataFrame, slots: DataFrame, ticks: DataFrame, t: watch.Thresholds = watch.Thresholds(), delay: str = "1 minute") -> DataFrame:
    """F1, F2, F3, F4 and F5 on streams of samples: the alerts of each tick (cluster_id, tick, ordinal, code, subject), told once the
    watermark has passed it by ``delay``.

    What matters of the three streams (runaways, slots over the ceiling, ticks) is one stream, kept by cluster until no sample of a
    tick can come any more; so ticks reach the breaker whole and in order, whatever order samples came in. Samples later than
    ``delay`` are dropped by the watermark, and by nothing else; ticks without a row of their own in ``ticks`` give nothing. The
    state of a cluster is its breaker and the runaways and alarms of its open ticks.
    """
    kinds = {"lag_bytes": "long", "probe": "string", "pid": "long", "agent": "boolean", "position": "long", "slot_name": "string"}

    def sample(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
        rest = [columns.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]
        return df.select(F.col("cluster_id").cast("long").alias("cluster_id"), F.timestamp_millis("tick").alias("at"), F.col("tick").cast("long").alias("tick"), *rest, F.lit(kind).alias("kind"))

    ran = sample(activity.filter(watch.runaway(t)), "backend", pid=F.col("pid"), agent=watch.tagged(t))
    alarms = sample(watch.slot_alarms(slots, t), "slot", position=F.col("position"), slot_name=F.col("slot_name"))
    beats = sample(ticks, "tick", lag_bytes=F.col("lag_bytes"), probe=F.col("probe"))
    every = beats.unionByName(ran).unionByName(alarms).withWatermark("at", delay)
    step = functools.partial(watch_step, t=t)
    stepped = every.groupBy("cluster_id").applyInPandasWithState(step, STEPPED, "state string, opened long, reason string, open string", "append", "EventTimeTimeout")
    return watch.alert_rows(stepped, watch.alert_list(F.col("terminate"), F.col("slots"), F.col("state")))


def watch_step(key, frames, state, t):
    *breaker, text = state.get if state.exists else (*watch.Breaker().__dict__.values(), "{}")
    now, open_ = watch.Breaker(*breaker), {int(k): v for k, v in json.loads(text).items()}
    for f in frames:
        f = f[["tick", "kind", "lag_bytes", "probe", "pid", "agent", "position", "slot_name"]].astype({"lag_bytes": "Int64", "pid": "Int64", "position": "Int64"}).astype(object)
        for tick, kind, lag, probe, pid, agent, position, slot in f.where(f.notna(), None).itertuples(index=False):
            held = open_.setdefault(tick, {"told": False, "lag": None, "probe": None, "kill": [], "spared": 0, "slots": []})
            if kind == "tick":
                held["told"], held["lag"], held["probe"] = True, lag, probe
            elif kind == "slot":
                held["slots"].append([position, slot])
            elif agent:
                held["kill"].append(pid)
            else:
                held["spared"] += 1
    passed, out = state.getCurrentWatermarkMs(), []
    for tick in sorted(k for k in open_ if k <= passed):
        held = open_.pop(tick)
        if not held["told"]:
            continue
        held["slots"].sort(key=lambda s: (s[0] is not None, s))
        slot = held["slots"][0][1] if held["slots"] else None
        busy = len(held["kill"]) + held["spared"]
        reason = "lag" if held["lag"] is not None and held["lag"] > t.lag_bytes else f"slot:{slot}" if slot is not None else "runaways" if busy >= t.runaways else None
        now.tick(tick, reason, held["probe"], t.cooldown_ms)
        pids = sorted(p for p in held["kill"] if p is not None)
        out.append((key[0], tick, now.state, pids, [{"position": p, "slot_name": s} for p, s in held["slots"]]))
    state.update((now.state, now.opened, now.reason, json.dumps(open_)))
    if open_:
        state.setTimeoutTimestamp(max(min(open_), passed + 1))
    yield pd.DataFrame(out, columns=["cluster_id", "tick", "state", "terminate", "slots"])


def sealing(path: str) -> Callable[[DataFrame, int], None]:
    """A7 for foreachBatch: seals each batch of alerts onto the chains below ``path`` and keeps their heads beside them, one row for
    each chain. A batch that is run again begins from the heads before it and replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        heads = None
        if number:
            try:
                known = spark.read.parquet(f"{path}/heads").filter(F.col("batch") < number)
                last = known.agg(F.max("batch")).first()[0]
                heads = known.filter(F.col("batch") == last).drop("batch") if last is not None else None
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        log = scratch(watch.alert_log(batch))
        append_batch(audit.seal(log, ["ts_ms", "ordinal"], heads), number, f"{path}/chain")
        made = audit.chain_heads(spark.read.parquet(f"{path}/chain/batch={number}"))
        kept = heads.join(made, "chain_id", "left_anti").unionByName(made) if heads is not None else made
        kept.write.mode("overwrite").parquet(f"{path}/heads/batch={number}")

    return write


BREAKS = "chain_id string, kind string, seq long, expected string, found string"


def breaker_stream(ticks: DataFrame, t: watch.Thresholds = watch.Thresholds()) -> DataFrame:
    """F4 on a stream of ticks; a cluster's state is its breaker."""
    rows = ticks.select("cluster_id", "tick", "reason", "probe")
    step = functools.partial(breaker_step, cooldown_ms=t.cooldown_ms)
    return rows.groupBy("cluster_id").applyInPandasWithState(step, watch.TIMELINE, "state string, opened long, reason string", "append", "NoTimeout")


def breaker_step(key, frames, state, cooldown_ms):
    now = watch.Breaker(*state.get) if state.exists else watch.Breaker()
    for rows in in_order(frames, ["tick"]):
        yield watch.breaker_fold(rows, now, cooldown_ms)
    state.update((now.state, now.opened, now.reason))


#: Groups that chains are dealt over. A group is one call of ``chains_step`` in a micro-batch, and one state.
GROUPS = 512
UNTIMED = -(1 << 63)


def verify_chain_stream(chain: DataFrame, hold_ms: int = 600_000, keep_ms: int = 86_400_000, first_seq: int = 0, groups: int = GROUPS) -> DataFrame:
    """breaks as records arrive, in any order.

    A record that follows the chain's last one is compared with it at once. One that comes before its predecessor waits; the gap is
    believed, and shows as SEQ_GAP, only when some record of the stream is ``hold_ms`` younger (by ``ts_ms``) than the waiting one. A
    chain begins with number ``first_seq``, or else with its lowest number once that has waited so long. What comes after its number
    has been passed is LATE_RECORD; only what is ``keep_ms`` older than the youngest record is dropped, by the watermark, and counted
    there. CORRUPT records are told at once; those with a chain, number and hash still count as predecessors. A row that holds nothing
    but ``ts_ms`` is a heartbeat: it only moves time on.

    Chains are dealt over ``groups``, and all chains of a group are gone through at once, as columns. A group's state is the last
    number and hash of each of its chains, and their records that wait. A micro-batch writes anew the states of the groups that its
    records fall in, so very many chains call for more groups; a stream keeps the number that its checkpoint began with.
    """
    if keep_ms < hold_ms:
        raise ValueError("records must be kept as long as gaps are held")
    keys = ["chain_id", "seq", "prev_hash", "record_hash", "payload"]
    # Rows without a time are never late, and none is at the epoch, where the watermark begins.
    at = F.when(F.col("ts_ms").isNotNull(), F.timestamp_millis(F.greatest("ts_ms", F.lit(0)) + 1))
    rows = chain.withColumn("_at", at).withWatermark("_at", f"{keep_ms} milliseconds")
    placed, lacks, expected = audit.linkable(), F.nullif(audit.corruption(chain), F.lit("")), audit.record_hash()
    group = F.pmod(F.when(placed, F.xxhash64("chain_id")).otherwise(F.xxhash64(*keys)), F.lit(groups)).cast("int")
    rows = rows.select(
        group.alias("group"), placed.alias("placed"), F.col("seq").isNotNull().alias("numbered"), "chain_id", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), "record_hash", "prev_hash",
        F.when(expected != F.col("record_hash"), expected).alias("expected"), lacks.alias("corruption"), F.coalesce("ts_ms", F.lit(UNTIMED)).cast("long").alias("ts_ms"), "_at",
    )
    step = functools.partial(chains_step, hold_ms=hold_ms, keep_ms=keep_ms, first_seq=first_seq)
    return rows.groupBy("group").applyInPandasWithState(step, BREAKS, "heads binary, waiting binary", "append", "EventTimeTimeout")


EMPTY = "chain_id,seq,prev_hash,record_hash,payload"
HEADS = pa.schema([("chain_id", pa.large_string()), ("seq", pa.int64()), ("record_hash", pa.large_string())])
#: A record: ``expected`` is null where the hash is right, ``corruption`` where nothing is lacking.
WAITING = pa.schema([*HEADS, ("prev_hash", pa.large_string()), ("expected", pa.large_string()), ("corruption", pa.large_string()), ("ts_ms", pa.int64())])
BROKEN = pa.schema([("chain_id", pa.large_string()), ("kind", pa.large_string()), ("seq", pa.int64()), ("expected", pa.large_string()), ("found", pa.large_string())])


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    with pa.ipc.open_stream(pa.py_buffer(bytes(data))) as stream:
        return stream.read_all()


def chains_step(key, frames, state, hold_ms, keep_ms, first_seq):
    """One group's records of a micro-batch, or its time that has come: every chain is gone through up to the first record that must wait."""
    came, astray = [WAITING.empty_table()], []
    for f in frames:
        lost = f[~f["placed"]]
        astray.append(BROKEN.empty_table() if lost.empty else strays(lost))
        came.append(pa.Table.from_pandas(f.loc[f["placed"], WAITING.names], schema=WAITING, preserve_index=False))
    told = pa.concat_tables([BROKEN.empty_table(), *astray])
    new = pa.concat_tables(came)
    if not state.exists and not new.num_rows:  # records without a place: no state
        yield broken(told)
        return
    heads, waiting = (unpacked(x) for x in state.get) if state.exists else (HEADS.empty_table(), WAITING.empty_table())
    rows = pa.concat_tables([waiting, new]).combine_chunks()
    passed, first = state.getCurrentWatermarkMs(), None
    if rows.num_rows:
        more, heads, rows = walked(rows, heads, passed, hold_ms, keep_ms, first_seq)
        told = pa.concat_tables([told, more])
        first = first_waiting(rows)
    state.update((packed(heads), packed(rows)))
    if first is not None:
        state.setTimeoutTimestamp(max(first + hold_ms - keep_ms, passed + 1, 1))
    yield broken(told)


def strays(lost: pd.DataFrame) -> pa.Table:
    """Breaks of records without a place; heartbeats are none."""
    lost = lost[lost["corruption"] != EMPTY]
    seq = pa.array(lost["seq"].to_numpy("int64"), mask=~lost["numbered"].to_numpy(bool))
    text = lambda c: pa.array(lost[c], pa.large_string(), from_pandas=True)
    return pa.table([text("chain_id"), pa.array(["CORRUPT"] * len(lost), pa.large_string()), seq, pa.nulls(len(lost), pa.large_string()), text("corruption")], BROKEN)


def chain_starts(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of rows that are sorted by chain: each row's chain, counted from 0, and the first row of each chain."""
    chain = rows["chain_id"].combine_chunks()
    begins = np.ones(len(chain), bool)
    begins[1:] = pc.not_equal(chain[1:], chain[:-1]).to_numpy(zero_copy_only=False)
    return np.cumsum(begins) - 1, np.flatnonzero(begins)


def first_waiting(rows: pa.Table) -> int | None:
    """The earliest time of a record that is the first to wait in its chain."""
    return int(rows["ts_ms"].to_numpy()[chain_starts(rows)[1]].min()) if rows.num_rows else None


def walked(rows: pa.Table, heads: pa.Table, passed: int, hold_ms: int, keep_ms: int, first_seq: int) -> tuple[pa.Table, pa.Table, pa.Table]:
    """Breaks, new heads, and the records that wait, of records after ``heads``.

    A record's predecessor is the one before it in the order of number and hash, or the chain's head. Only the first record with a
    number counts as a predecessor; others with that number, and those that the head has passed, are late.
    """
    rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("chain_id", "seq", "record_hash")])).combine_chunks()
    chain, starts = chain_starts(rows)
    seq, ts = rows["seq"].to_numpy(), rows["ts_ms"].to_numpy()
    # The watermark is keep_ms behind the youngest record. A record without a time counts as that young.
    now = np.maximum(np.maximum.reduceat(ts, starts), passed + keep_ms)
    ts = np.where(ts == UNTIMED, now[chain], ts)
    rows = rows.set_column(WAITING.get_field_index("ts_ms"), "ts_ms", pa.array(ts))
    head = pc.index_in(rows["chain_id"].take(pa.array(starts)), value_set=heads["chain_id"]).combine_chunks()
    headed, head = head.is_valid().to_numpy(zero_copy_only=False), head.fill_null(0).to_numpy()
    head_seq = np.where(headed, heads["seq"].to_numpy()[head], 0) if heads.num_rows else np.zeros(len(starts), "int64")
    late = headed[chain] & (seq <= head_seq[chain])
    repeated = np.zeros(len(seq), bool)
    repeated[1:] = (chain[1:] == chain[:-1]) & (seq[1:] == seq[:-1])
    p = np.flatnonzero(~late & ~repeated)  # those that can be predecessors
    of, number = chain[p], seq[p]
    opens = np.ones(len(p), bool)
    opens[1:] = of[1:] != of[:-1]
    before = np.where(opens, head_seq[of], np.concatenate([[0], number[:-1]])[: len(p)])
    follows = ~opens | headed[of]  # has a predecessor
    blocked = (number != np.where(follows, before + 1, first_seq)) & ((passed <= 0) | (passed + keep_ms < ts[p] + hold_ms))
    many = np.cumsum(blocked)
    stopped = many > np.maximum.accumulate(np.where(opens, many - blocked, 0))
    rank = np.cumsum(~late & ~repeated) - 1
    waits = ~late & np.append(stopped, False)[rank]

    record_hash, prev_hash = rows["record_hash"].combine_chunks(), rows["prev_hash"].combine_chunks()
    inner = record_hash.take(pa.array(np.concatenate([[0], p[:-1]])[: len(p)], mask=opens))
    from_head = heads["record_hash"].combine_chunks().take(pa.array(head[of].astype("int64"), mask=~(opens & headed[of])))
    last = pc.coalesce(inner, from_head)
    ok = np.flatnonzero(~stopped)
    at = pa.array(p[ok])
    broken_rows = judged(rows.take(at), last.take(pa.array(ok)), pa.array(before[ok]), follows[ok])
    over = np.flatnonzero((late | repeated) & ~waits)
    after = np.where(late, head_seq[chain], seq)[over] + 1
    texts = [pa.array(x).cast(pa.large_string()) for x in (after, seq[over])]
    too_late = pa.table([rows["chain_id"].take(pa.array(over)), pa.array(["LATE_RECORD"] * len(over), pa.large_string()), pa.array(seq[over]), *texts], BROKEN)

    ends = np.ones(len(ok), bool)
    ends[:-1] = of[ok][1:] != of[ok][:-1]
    moved = rows.select(HEADS.names).take(pa.array(p[ok][ends]))
    stay = heads.filter(pc.invert(pc.is_in(heads["chain_id"], value_set=moved["chain_id"])))
    return pa.concat_tables([broken_rows, too_late]), pa.concat_tables([stay, moved]).combine_chunks(), rows.filter(pa.array(waits)).combine_chunks()


def judged(rows: pa.Table, last: pa.Array, before: pa.Array, follows: np.ndarray) -> pa.Table:
    """What is wrong with records after predecessors with the hashes ``last`` and the numbers ``before``; where not ``follows``, they are a chain's first."""
    follows, prev, found, seq = pa.array(follows), rows["prev_hash"], rows["record_hash"], rows["seq"]
    genesis, none = pa.scalar(GENESIS, pa.large_string()), pa.scalar(None, pa.large_string())
    unlike = lambda a, b: pc.fill_null(pc.not_equal(a, b), True)
    due = pc.add(before, 1)
    cases = [  # the first that holds
        ("CORRUPT", rows["corruption"].is_valid(), none, rows["corruption"]),
        ("HASH_MISMATCH", rows["expected"].is_valid(), rows["expected"], found),
        ("BAD_GENESIS", pc.and_(pc.invert(follows), unlike(prev, genesis)), genesis, prev),
        ("SEQ_GAP", pc.and_(follows, pc.not_equal(seq, due)), due.cast(pa.large_string()), seq.cast(pa.large_string())),
        ("BROKEN_LINK", pc.and_(follows, unlike(prev, last)), last, prev),
    ]
    whether = pc.make_struct(*[c for _, c, _, _ in cases], field_names=[k for k, *_ in cases])
    pick = lambda values: pc.case_when(whether, *values, none)
    kind = pick([pa.scalar(k, pa.large_string()) for k, *_ in cases])
    table = pa.table([rows["chain_id"], kind, seq, pick([e for _, _, e, _ in cases]), pick([f for *_, f in cases])], BROKEN)
    return table.filter(table["kind"].is_valid())


def broken(told: pa.Table) -> pd.DataFrame:
    return told.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
