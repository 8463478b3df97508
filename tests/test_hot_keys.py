"""Keys of any size: the same rows whether a key is gone through by one task or by joins."""

import random

import pytest

from ledgerline.functions.orbits import orbits
from ledgerline.operators import audit, meter

CAPS = "role string, max_rows long, max_bytes long, window_ms long, window_max_rows long, window_max_bytes long"


def greedy(times, width):
    out = []
    for t in sorted(set(times)):
        if not out or t - out[-1] >= width:
            out.append(t)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_orbits(spark, seed):
    r = random.Random(seed)
    keys = {}
    for k in range(6):
        width = r.choice([1, 2, 7, 50])
        spread = r.choice([30, 400])
        keys[f"k{k}"] = (width, [r.choice([1, 1, 5]) * r.randrange(-spread, spread) for _ in range(r.randint(1, 120))])
    rows = [(k, w, t) for k, (w, ts) in keys.items() for t in ts]
    got = sorted(tuple(x) for x in orbits(spark.createDataFrame(rows, "key string, width long, at long")).collect())
    assert got == sorted((k, t) for k, (w, ts) in keys.items() for t in greedy(ts, w))


def test_orbits_of_nothing(spark):
    assert orbits(spark.createDataFrame([], "key string, width long, at long")).collect() == []


def charges(spark, n=260, seed=4):
    r = random.Random(seed)
    # s0 holds most; s3 changes its role, and with it the window; a session and a role are unknown.
    of = lambda: r.choice(["s0"] * 6 + ["s1", "s2", "s3", None])
    rows = [(s, r.choice(["r", "q"]) if s == "s3" else "none" if s == "s2" else "r", i, r.randrange(900), r.randint(0, 3), r.randrange(40)) for i in range(n) for s in [of()]]
    return spark.createDataFrame(rows, "session string, role string, id long, ts_ms long, rows long, bytes long")


@pytest.mark.parametrize("kill", [False, True])
def test_window_meter_of_hot_sessions(spark, kill):
    policy = spark.createDataFrame([("r", 9, 9, 60, 9, 150), ("q", 9, 9, 25, 4, 60)], CAPS)
    rows = charges(spark)
    tell = lambda hot: sorted(map(str, meter.window_meter(rows, policy, kill, hot).collect()))
    assert tell(1) == tell(10**9) == tell(50)


def test_due_anchors_of_hot_chains(spark):
    r = random.Random(6)
    ticks = spark.createDataFrame([(r.choice(["a"] * 5 + ["b", None]), r.choice([None, *range(500)])) for _ in range(400)], "chain_id string, ts_ms long")
    tell = lambda hot: sorted(map(str, audit.due_anchors(ticks, 17, hot).collect()))
    assert tell(1) == tell(10**9) and len(tell(1)) > 40
