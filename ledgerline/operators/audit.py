"""Hash-chained audit logs: sealing, verification, anchors and reports over many chains at once.

A record's hash is sha256 of the previous record's hash and the payload, both as text. Chains are tables with the columns of
schemas.CHAIN; a decision's reason is read from the payload's JSON. A record that lacks a field, or whose payload ``read_chain`` could
not parse, is a finding (CORRUPT), never left out.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import folded
from ..functions.orbits import HOT_ROWS, hot_keys, orbits
from ..schemas import ANCHOR, CHAIN, GENESIS
from ..sources.versions import scratch

BUCKET = 65_536
ANCHOR_DOMAIN = b"audit-anchor:v1\0"


def record_hash(prev: str = "prev_hash", payload: str = "payload") -> Column:
    return F.sha2(F.concat(F.col(prev), F.col(payload)), 256)


def check_record_hash(chain: DataFrame) -> DataFrame:
    """A1: each record with what its hash should be and whether it is that."""
    return chain.withColumn("expected_hash", record_hash()).withColumn("hash_ok", F.col("expected_hash").eqNullSafe(F.col("record_hash")))


def linkable() -> Column:
    """Whether a record can be placed in its chain and be another's predecessor."""
    return F.col("chain_id").isNotNull() & F.col("seq").isNotNull() & F.col("record_hash").isNotNull()


def corruption(chain: DataFrame) -> Column:
    """The names of the fields that a record lacks, and ``payload`` where it is marked ``corrupt``, joined by commas; empty for sound records."""
    unparsed = F.coalesce(F.col("corrupt"), F.lit(False)) if "corrupt" in chain.columns else F.lit(False)
    lacking = lambda c: F.col(c).isNull() | (unparsed if c == "payload" else F.lit(False))
    return F.array_join(F.array(*[F.when(lacking(c), F.lit(c)) for c in ("chain_id", "seq", "prev_hash", "record_hash", "payload")]), ",")


def with_predecessor(chain: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Adds prev_seq, prev_record_hash and the record's index in its chain; all null for a record without a place in one.

    A window over a whole chain is one task, so records are windowed in buckets of ``bucket`` sequence numbers; the last record of
    each bucket, a table of one row for each bucket, supplies the first record of the next. Records without a place are spread.
    """
    astray = F.lit(-(1 << 62)) - F.pmod(F.xxhash64("seq", "record_hash", "payload"), F.lit(4096))
    rows = chain.withColumn("_linked", linkable()).withColumn("_b", F.when(F.col("_linked"), F.floor(F.col("seq") / bucket)).otherwise(astray))
    order = Window.partitionBy("chain_id", "_b").orderBy("seq", "record_hash")
    rows = rows.withColumn("_at", F.row_number().over(order)).withColumn("_prev", F.lag(F.struct("seq", "record_hash")).over(order))
    tails = rows.filter("_linked").groupBy(F.col("chain_id").alias("_chain"), F.col("_b").alias("_bucket")).agg(F.max(F.struct("seq", "record_hash")).alias("_tail"), F.count(F.lit(1)).alias("_n"))
    across = Window.partitionBy("_chain").orderBy("_bucket")
    tails = tails.select("_chain", "_bucket", F.lag("_tail").over(across).alias("_before"), (F.sum("_n").over(across) - F.col("_n")).alias("_offset"))
    joined = rows.join(tails, F.col("chain_id").eqNullSafe(F.col("_chain")) & (F.col("_b") == F.col("_bucket")), "left")
    previous = F.when(F.col("_linked"), F.coalesce("_prev", F.when(F.col("_at") == 1, F.col("_before"))))
    index = F.when(F.col("_linked"), (F.col("_at") - 1 + F.col("_offset")).cast("long"))
    return joined.withColumn("_previous", previous).select(*chain.columns, F.col("_previous.seq").alias("prev_seq"), F.col("_previous.record_hash").alias("prev_record_hash"), index.alias("index"))


def with_breaks(chain: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Every record with the kind of break at it, null where there is none, and what was expected and found there."""
    rows = with_predecessor(check_record_hash(chain).withColumn("corruption", corruption(chain)), bucket)
    first = F.col("prev_seq").isNull()
    kind = (
        F.when(F.col("corruption") != "", "CORRUPT")
        .when(~F.col("hash_ok"), "HASH_MISMATCH")
        .when(first & ~F.col("prev_hash").eqNullSafe(F.lit(GENESIS)), "BAD_GENESIS")
        .when(~first & (F.col("seq") != F.col("prev_seq") + 1), "SEQ_GAP")
        .when(~first & ~F.col("prev_hash").eqNullSafe(F.col("prev_record_hash")), "BROKEN_LINK")
    )
    told = {
        "CORRUPT": (F.lit(None).cast("string"), "corruption"),
        "HASH_MISMATCH": ("expected_hash", "record_hash"),
        "BAD_GENESIS": (F.lit(GENESIS), "prev_hash"),
        "SEQ_GAP": ((F.col("prev_seq") + 1).cast("string"), F.col("seq").cast("string")),
        "BROKEN_LINK": ("prev_record_hash", "prev_hash"),
    }
    expected, found = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (e, f) in told.items():
        expected = F.when(F.col("kind") == k, e if isinstance(e, Column) else F.col(e)).otherwise(expected)
        found = F.when(F.col("kind") == k, f if isinstance(f, Column) else F.col(f)).otherwise(found)
    return rows.withColumn("kind", kind).select("chain_id", "kind", "index", "seq", expected.alias("expected"), found.alias("found"))


def chain_breaks(chain: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """A3: every break. The first record's own sequence number is not checked. A CORRUPT record that has a place keeps it, so that those after it are not broken too."""
    return with_breaks(chain, bucket).filter("kind IS NOT NULL")


def verify_chain(chain: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """A2: one row for each chain, and one for records without a chain, with its first break, if it has one; records without a place come last."""
    place = F.coalesce(F.col("index"), F.lit((1 << 63) - 1))
    first = F.min(F.when(F.col("kind").isNotNull(), F.struct(place.alias("place"), "index", "kind", "seq", "expected", "found")))
    return with_breaks(chain, bucket).groupBy("chain_id").agg(first.alias("b")).select("chain_id", F.col("b").isNull().alias("ok"), "b.kind", "b.index", "b.seq", "b.expected", "b.found")


def chain_heads(chain: DataFrame) -> DataFrame:
    """A5: the hash, sequence number and time of each chain's last record."""
    head = F.max(F.struct("seq", "record_hash", "ts_ms"))
    return chain.groupBy("chain_id").agg(head.alias("h")).select("chain_id", F.col("h.record_hash").alias("head_hash"), F.col("h.seq").alias("seq"), F.col("h.ts_ms").alias("ts_ms"))


def reason_code() -> Column:
    return F.get_json_object("payload", "$.reason_code")


def chain_summary(chain: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """A4: length, head and records for each reason, of chains that verify."""
    good = verify_chain(chain, bucket).filter("ok").select("chain_id")
    counts = chain.groupBy("chain_id", reason_code().alias("reason_code")).agg(F.count(F.lit(1)).alias("n"))
    heads = chain.groupBy("chain_id").agg(F.count(F.lit(1)).alias("length"), F.max_by("record_hash", "seq").alias("head_hash"))
    return counts.join(heads, "chain_id").join(good, "chain_id", "left_semi").select("chain_id", "length", "head_hash", "reason_code", "n")


def chain_constraints(chain: DataFrame) -> DataFrame:
    """A10: violations of a stored chain's constraints: repeated seq, repeated record_hash, negative seq, payload of another predecessor."""
    twice = [
        chain.groupBy("chain_id", F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("violation", F.lit(f"DUPLICATE_{c.upper()}"))
        for c in ("seq", "record_hash")
    ]
    said = F.get_json_object("payload", "$.prev_hash")
    one = lambda broken, name, value: F.when(broken, F.struct(F.lit(name).alias("violation"), F.col(value).cast("string").alias("value")))
    both = F.array_compact(F.array(one(F.col("seq") < 0, "NEGATIVE_SEQ", "seq"), one(said != F.col("prev_hash"), "PAYLOAD_PREV_HASH", "prev_hash")))
    wrong = chain.select("chain_id", F.inline(both))
    rest = wrong.groupBy("chain_id", "value", "violation").agg(F.count(F.lit(1)).alias("n"))
    return union_all([*twice, rest]).select("chain_id", "violation", "value", "n")


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    first, *rest = frames
    for f in rest:
        first = first.unionByName(f)
    return first


def audit_tail(chain: DataFrame, n: int = 0) -> DataFrame:
    """The last n records of each chain, oldest first within it; 0 means 50, and more than 1000 means 1000."""
    n = 50 if n == 0 else min(n, 1000)
    newest = Window.partitionBy("chain_id").orderBy(F.desc("seq"), F.desc("record_hash"))
    return chain.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= n).orderBy("chain_id", F.desc("back"))


def decision_rollup(log: DataFrame, by: list[str]) -> DataFrame:
    """Counts by all prefixes of the columns, totals included."""
    return log.rollup(*by).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


def rejections(log: DataFrame, decision: str = "decision") -> DataFrame:
    """Every decision but ALLOW."""
    return log.filter(F.col(decision) != "ALLOW")


def seal(log: DataFrame, order: list[str], heads: DataFrame | None = None) -> DataFrame:
    """Seq, prev_hash and record_hash of each chain's payloads, in the order of ``order``, going on from ``heads`` (chain_id, head_hash, seq).

    Sealing a chain is sequential; chains are sealed in parallel, and a task keeps only the last hash and number of the chain it is at.
    A null payload is sealed as the text null, which is JSON too.
    """
    rows = log.select("chain_id", "payload", "ts_ms", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    if heads is None:
        rows = rows.withColumn("_head", F.lit(GENESIS)).withColumn("_seq", F.lit(-1).cast("long"))
    else:
        known = heads.select("chain_id", F.col("head_hash").alias("_head"), F.col("seq").alias("_seq"))
        rows = rows.join(known, "chain_id", "left").withColumn("_head", F.coalesce("_head", F.lit(GENESIS))).withColumn("_seq", F.coalesce("_seq", F.lit(-1)))

    def link(head: dict, row: dict) -> tuple:
        before, payload = head["hash"], "null" if row["payload"] is None else row["payload"]
        head["hash"], head["seq"] = hashlib.sha256((before + payload).encode()).hexdigest(), head["seq"] + 1
        return row["chain_id"], head["seq"], before, head["hash"], payload, row["ts_ms"]

    return folded(rows, "chain_id", [f"_o{i}" for i in range(len(order))], lambda row: {"hash": row["_head"], "seq": row["_seq"]}, link, CHAIN)


def due_anchors(ticks: DataFrame, interval_ms: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The (chain_id, ts_ms) ticks at which an anchor is due: at most one in each interval, a chain's first always. Chains of
    ``hot_rows`` ticks or more are not gone through in one task (``orbits``). Ticks without a time are none."""
    ticks = ticks.select("chain_id", "ts_ms").filter("ts_ms IS NOT NULL")

    def pick(last: dict, row: dict) -> tuple | None:
        if "ms" in last and row["ts_ms"] - last["ms"] < interval_ms:
            return None
        last["ms"] = row["ts_ms"]
        return row["chain_id"], row["ts_ms"]

    timed = ticks.withColumn("width", F.lit(interval_ms).cast("long"))
    hot = scratch(hot_keys(timed, "chain_id", "width", hot_rows))
    large = not hot.isEmpty()
    rest = ticks.join(hot, F.col("chain_id") == F.col("key"), "left_anti") if large else ticks
    made = folded(rest, "chain_id", ["ts_ms"], lambda _: {}, pick, "chain_id string, ts_ms long")
    if not large:
        return made
    of_hot = ticks.join(hot, F.col("chain_id") == F.col("key")).select("key", "width", F.col("ts_ms").alias("at"))
    return made.unionByName(orbits(of_hot).select(F.col("key").alias("chain_id"), F.col("at").alias("ts_ms")))


def anchor_message(head: str, seq: int, ts_ms: int) -> bytes:
    """What an anchor's signature covers; the length keeps neighbouring fields apart."""
    return ANCHOR_DOMAIN + len(head).to_bytes(8, "big") + head.encode() + seq.to_bytes(8, "big") + ts_ms.to_bytes(8, "big")


def signature(keys: dict[str, bytes], key_id: Column, head: Column, seq: Column, ts_ms: Column) -> Column:
    """HMAC-SHA256 by key; null for unknown keys. The keys travel with the function, not in the plan."""

    @F.pandas_udf("string")
    def sign(k: pd.Series, h: pd.Series, s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([hmac.new(keys[a], anchor_message(b, int(c), int(d)), hashlib.sha256).hexdigest() if a in keys else None for a, b, c, d in zip(k, h, s, t, strict=True)], dtype=object)

    return sign(key_id, head, seq, ts_ms)


def make_anchors(heads: DataFrame, key_id: str, keys: dict[str, bytes]) -> DataFrame:
    c = [F.lit(key_id), F.col("head_hash"), F.col("seq"), F.col("ts_ms")]
    return heads.select("chain_id", "head_hash", "seq", "ts_ms", F.lit(key_id).alias("key_id"), signature(keys, *c).alias("signature"))


def latest_anchors(anchors: DataFrame) -> DataFrame:
    """The anchor with the highest sequence number, then the latest, of each chain."""
    best = anchors.groupBy("chain_id").agg(F.max(F.struct("seq", "ts_ms", "head_hash", "key_id", "signature")).alias("a"))
    return best.select("chain_id", *[F.col(f"a.{x.split()[0]}").alias(x.split()[0]) for x in ANCHOR.split(", ")[1:]])


def verify_anchors(chain: DataFrame, anchors: DataFrame, keys: dict[str, bytes], prefix: bool = False) -> DataFrame:
    """NO_ANCHOR, BAD_SIGNATURE, VERIFIED or HEAD_MISMATCH for each chain. A6b (``prefix``): the record at the anchored place must carry the anchored hash, so a chain may have grown."""
    a = latest_anchors(anchors).select("chain_id", F.col("head_hash").alias("anchored"), F.col("seq").alias("at"), F.col("ts_ms").alias("anchored_ms"), "key_id", "signature")
    joined = chain_heads(chain).select("chain_id", "head_hash").join(a, "chain_id", "left")
    if prefix:
        held = chain.select("chain_id", F.col("seq").alias("at"), F.col("record_hash").alias("held"))
        joined = joined.join(held, ["chain_id", "at"], "left")
    else:
        joined = joined.withColumn("held", F.col("head_hash"))
    good = F.col("signature") == signature(keys, F.col("key_id"), F.col("anchored"), F.col("at"), F.col("anchored_ms"))
    signed = joined.filter("anchored IS NOT NULL").withColumn("good", F.coalesce(good, F.lit(False)))
    status = F.when(~F.col("good"), "BAD_SIGNATURE").when(F.col("held").eqNullSafe(F.col("anchored")), "VERIFIED").otherwise("HEAD_MISMATCH")
    none = joined.filter("anchored IS NULL").select("chain_id", F.lit("NO_ANCHOR").alias("status"), F.lit(None).cast("long").alias("anchored_seq"))
    return signed.select("chain_id", status.alias("status"), F.col("at").alias("anchored_seq")).unionByName(none)


def verify_then_anchor(chain: DataFrame, anchors: DataFrame, keys: dict[str, bytes], key_id: str, now_ms: int, interval_ms: int = 0, strict: bool = False) -> DataFrame:
    """New anchors, at ``now_ms``, of chains that verify and match their last anchor (or have none), where one is due."""
    sound = verify_chain(chain).filter("ok").select("chain_id")
    matched = verify_anchors(chain, anchors, keys, prefix=not strict).filter("status IN ('VERIFIED', 'NO_ANCHOR')").select("chain_id")
    last = latest_anchors(anchors).select("chain_id", F.col("ts_ms").alias("last_ms"))
    due = F.col("last_ms").isNull() | (F.lit(now_ms) - F.col("last_ms") >= interval_ms)
    heads = chain_heads(chain).join(sound, "chain_id", "left_semi").join(matched, "chain_id", "left_semi").join(last, "chain_id", "left").filter(due)
    return make_anchors(heads.select("chain_id", "head_hash", "seq", F.lit(now_ms).cast("long").alias("ts_ms")), key_id, keys)
