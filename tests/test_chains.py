"""Chains with records that lack fields, arrive in any order, or never come."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import audit
from ledgerline.streaming import watch as live

MINUTE = 60_000
BEGIN = 10**12


def sealed(spark, n=30, chains=("a", "b", None)):
    log = spark.createDataFrame([(c, BEGIN + i * MINUTE, f'{{"n":{i}}}') for c in chains for i in range(n)], "chain_id string, ts_ms long, payload string")
    return audit.seal(log, ["ts_ms"])


def brute_breaks(rows):
    """All breaks of records (chain_id, seq, prev_hash, record_hash, payload), as plain loops tell them."""
    import hashlib

    names = ["chain_id", "seq", "prev_hash", "record_hash", "payload"]
    out, chains = [], {}
    for r in rows:
        if r[0] is None or r[1] is None or r[3] is None:
            out.append((r[0], "CORRUPT", None, r[1], None, ",".join(n for n, v in zip(names, r) if v is None)))
        else:
            chains.setdefault(r[0], []).append(r)
    for chain, records in chains.items():
        last = None
        for i, r in enumerate(sorted(records, key=lambda r: (r[1], r[3]))):
            _, seq, prev, found, payload = r
            want = hashlib.sha256((prev + payload).encode()).hexdigest() if prev is not None and payload is not None else None
            lacks = ",".join(n for n, v in zip(names, r) if v is None)
            if lacks:
                out.append((chain, "CORRUPT", i, seq, None, lacks))
            elif want != found:
                out.append((chain, "HASH_MISMATCH", i, seq, want, found))
            elif last is None:
                if prev != "0" * 64:
                    out.append((chain, "BAD_GENESIS", i, seq, "0" * 64, prev))
            elif seq != last[0] + 1:
                out.append((chain, "SEQ_GAP", i, seq, str(last[0] + 1), str(seq)))
            elif prev != last[1]:
                out.append((chain, "BROKEN_LINK", i, seq, last[1], prev))
            last = (seq, found)
    return sorted(out, key=str)


def mangled(spark, seed, n=120):
    """Records of which some are lost, some edited and some lack a field."""
    r = random.Random(seed)
    rows = [list(x) for x in sealed(spark, n, ("a", "b", "c")).select("chain_id", "seq", "prev_hash", "record_hash", "payload", "ts_ms").collect()]
    out = []
    for x in rows:
        at = r.random()
        if at < 0.05:
            continue
        if at < 0.15:
            x[r.randrange(5)] = None
        elif at < 0.2:
            x[r.choice([2, 3, 4])] = "edited"
        out.append(tuple(x))
    return out


SHAPE = "chain_id string, seq long, prev_hash string, record_hash string, payload string, ts_ms long"


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("bucket", [1, 7, 65_536])
def test_no_record_vanishes(spark, seed, bucket):
    rows = mangled(spark, seed)
    df = spark.createDataFrame(rows, SHAPE)
    want = brute_breaks([x[:5] for x in rows])
    assert sorted([tuple(x) for x in audit.chain_breaks(df, bucket).collect()], key=str) == want
    assert audit.with_predecessor(df, bucket).count() == len(rows)
    got = {x["chain_id"]: x["ok"] for x in audit.verify_chain(df, bucket).collect()}
    assert got == {c: c not in {w[0] for w in want} for c in {x[0] for x in rows}}


def test_null_payloads_are_sealed_and_verify(spark):
    log = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 3, None)], "chain_id string, ts_ms long, payload string")
    chain = audit.seal(log, ["ts_ms"])
    assert [x["payload"] for x in chain.orderBy("seq").collect()] == ["null", "x", "null"]
    assert audit.verify_chain(chain).first()["ok"]


def test_unparsed_payloads_are_breaks_but_predecessors(spark):
    chain = sealed(spark, 10, ("a",)).withColumn("corrupt", F.col("seq") == 4)
    assert [(x["kind"], x["seq"], x["found"]) for x in audit.chain_breaks(chain).collect()] == [("CORRUPT", 4, "payload")]


class Files:
    """A stream that is fed file by file and stopped and begun again on one checkpoint."""

    def __init__(self, spark, path, **options):
        self.spark, self.path, self.options = spark, path, options
        self.n = 0

    def feed(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        source = self.spark.readStream.schema(SHAPE).parquet(f"{self.path}/in")
        out = live.verify_chain_stream(source, **self.options)
        made = []
        keep = lambda df, _: made.extend(tuple(x) for x in df.collect())
        out.writeStream.foreachBatch(keep).option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start().awaitTermination()
        return made


def test_a_gap_waits_for_its_time_and_nothing_is_told_twice(spark, tmp_path):
    chain = [tuple(x) for x in sealed(spark, 12, ("a",)).orderBy("seq").select("chain_id", "seq", "prev_hash", "record_hash", "payload", "ts_ms").collect()]
    beat = lambda minutes: (None, None, None, None, None, BEGIN + minutes * MINUTE)
    stream = Files(spark, str(tmp_path), hold_ms=5 * MINUTE, keep_ms=60 * MINUTE)
    assert stream.feed([chain[0], chain[2], chain[1]]) == []  # out of order within a batch
    assert stream.feed([chain[4]]) == []  # before its predecessor: it waits
    assert stream.feed([chain[3], chain[5]]) == []  # the gap fills
    assert stream.feed([chain[7], chain[8]]) == []  # 6 is missing, but not yet for long
    told = stream.feed([beat(30)]) + stream.feed([beat(30)])
    assert told == [("a", "SEQ_GAP", 7, "6", "7")]
    assert stream.feed([chain[6]]) == [("a", "LATE_RECORD", 6, "9", "6")]  # too late, and told
    assert stream.feed([chain[9], chain[10]]) == [] and stream.feed([beat(40)]) == []
    broken = list(chain[11])
    broken[4] = "edited"
    assert sorted(x[1] for x in stream.feed([tuple(broken), ("a", None, "p", "h", "x", BEGIN + 41 * MINUTE), ("z", 0, "0" * 64, None, "x", BEGIN + 41 * MINUTE)])) == ["CORRUPT", "CORRUPT", "HASH_MISMATCH"]


@pytest.mark.parametrize("seed", [3, 4])
def test_any_order_over_micro_batches_gives_the_breaks_of_the_table(spark, tmp_path, seed):
    rows = mangled(spark, seed, 60)
    r = random.Random(seed)
    r.shuffle(rows)
    rows = [(*x[:5], None) if i % 9 == 0 else x for i, x in enumerate(rows)]  # some without a time
    stream = Files(spark, str(tmp_path), hold_ms=10**6 * MINUTE, keep_ms=10**6 * MINUTE)
    told = []
    for i in range(5):
        told += stream.feed(rows[i::5])
    told += stream.feed([(None, None, None, None, None, BEGIN * 3)])
    want = [(c, k, s, e, f) for c, k, _, s, e, f in brute_breaks([x[:5] for x in rows])]
    assert sorted(told, key=str) == sorted(want, key=str)
