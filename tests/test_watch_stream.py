"""The watch loop on streams: samples, breakers, alerts and sealed records, against the batch form."""

import random

from ledgerline.operators import audit, watch
from ledgerline.sources.tables import append_batch
from ledgerline.streaming import watch as live

MINUTE, BEGIN = 60_000, 10**12
T = watch.Thresholds(runaways=2, cooldown_ms=3 * MINUTE)
ACTIVITY = "cluster_id long, tick long, pid long, usename string, application_name string, state string, query_runtime_millis long"
SLOTS = "cluster_id long, tick long, slot_name string, position long, retained_wal_bytes long"
TICKS = "cluster_id long, tick long, lag_bytes long, probe string"


def samples(seed, n=40):
    r = random.Random(seed)
    at = lambda i: BEGIN + i * MINUTE
    activity = [(c, at(i), r.randrange(1000), r.choice(["agent", "app", None]), r.choice(["proxy", None]), r.choice(["active", "idle"]), r.choice([1, 10**6])) for c in range(3) for i in range(n) for _ in range(r.randint(0, 4))]
    slots = [(c, at(i), f"s{p}", p, r.choice([0, 0, 0, 1 << 40])) for c in range(3) for i in range(n) for p in range(2)]
    ticks = [(c, at(i), r.choice([0] * 9 + [1 << 40]), r.choice([None, "ok", "failed"])) for c in range(3) for i in range(n) if r.random() < 0.9]
    return activity, slots, ticks


class Loop:
    def __init__(self, spark, path, delay):
        self.spark, self.path, self.delay = spark, path, delay

    def feed(self, activity, slots, ticks):
        for name, rows, shape in (("a", activity, ACTIVITY), ("s", slots, SLOTS), ("t", ticks, TICKS)):
            self.spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")
        read = lambda name, shape: self.spark.readStream.schema(shape).parquet(f"{self.path}/{name}")
        out = live.watch_stream(read("a", ACTIVITY), read("s", SLOTS), read("t", TICKS), T, self.delay)
        out.writeStream.foreachBatch(live.sealing(f"{self.path}/sealed")).option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start().awaitTermination()

    def chain(self):
        return self.spark.read.parquet(f"{self.path}/sealed/chain").drop("batch")


def batch(spark, activity, slots, ticks):
    a, s, k = spark.createDataFrame(activity, ACTIVITY), spark.createDataFrame(slots, SLOTS), spark.createDataFrame(ticks, TICKS)
    backends, alarms = watch.assess_backends(a, T), watch.slot_alarms(s, T)
    reasons = watch.trip_reasons(k, backends, alarms, T).join(k.select("cluster_id", "tick", "probe"), ["cluster_id", "tick"])
    log = watch.alert_log(watch.alerts(watch.breaker_timeline(reasons, T), backends, alarms))
    return audit.seal(log, ["ts_ms", "ordinal"])


END = ([], [], [(-1, BEGIN * 2, 0, None)])


def test_streamed_alerts_are_the_batch_ones(spark, tmp_path):
    """Samples of all ticks in four batches without order; the loop is stopped and begun again between them."""
    every = samples(1)
    loop, r = Loop(spark, str(tmp_path), "1000 days"), random.Random(2)
    for x in every:
        r.shuffle(x)
    for i in range(4):
        loop.feed(*[x[i::4] for x in every])
    loop.feed(*END)
    want = sorted(map(str, batch(spark, *every).collect()))
    assert sorted(map(str, loop.chain().select(*batch(spark, *every).columns).collect())) == want and len(want) > 50
    assert all(x["ok"] for x in audit.verify_chain(loop.chain()).collect())


def test_only_late_samples_are_dropped(spark, tmp_path):
    """Ticks come in order; a sample that comes within the delay counts, one that comes after it doesn't."""
    at = lambda i: BEGIN + i * MINUTE
    loop = Loop(spark, str(tmp_path), "5 minutes")
    kill = lambda i, pid: (1, at(i), pid, "agent", None, "active", 10**6)
    tick = lambda i: (1, at(i), 0, None)
    loop.feed([kill(0, 10)], [], [tick(0), tick(1)])
    loop.feed([kill(1, 11)], [], [tick(2), tick(3)])  # tick 1's backend is two minutes late
    loop.feed([], [], [tick(20)])
    loop.feed([kill(2, 12)], [], [tick(21)])  # tick 2 is closed
    loop.feed(*END)
    told = [(x["ts_ms"], x["payload"]) for x in loop.chain().filter("chain_id = 'watch/1'").orderBy("seq").collect()]
    assert [t for t, _ in told] == [at(0), at(1)] and [p.split('"subject":')[1] for _, p in told] == ['"10"}', '"11"}']


def test_a_batch_that_is_sealed_again_replaces_itself(spark, tmp_path):
    write = live.sealing(str(tmp_path))
    alerts = lambda *ticks: spark.createDataFrame([(1, t, 0, "TERMINATE", "7") for t in ticks], "cluster_id long, tick long, ordinal long, code string, subject string")
    write(alerts(1, 2), 0)
    write(alerts(3), 1)
    write(alerts(3, 4), 2)
    write(alerts(3, 4), 2)
    write(alerts(5), 4)  # a number may be passed over
    chain = spark.read.parquet(f"{tmp_path}/chain")
    assert [x["seq"] for x in chain.orderBy("seq").collect()] == list(range(6)) and audit.verify_chain(chain).first()["ok"]
    append_batch(chain.drop("batch").limit(0), 9, f"{tmp_path}/chain")
    assert audit.verify_chain(spark.read.parquet(f"{tmp_path}/chain")).first()["ok"]


def test_subjects_with_quotes(spark):
    rows = spark.createDataFrame([(1, 2, 0, "SLOT_ALARM", 'a"b\\c')], "cluster_id long, tick long, ordinal long, code string, subject string")
    assert watch.alert_log(rows).first()["payload"] == '{"tick":2,"reason_code":"SLOT_ALARM","subject":"a\\"b\\\\c"}'
