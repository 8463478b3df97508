"""Versions compared by the digests of their leaves: the same answers as by rows."""

import random

import pytest

from ledgerline.operators import snapshot

SHAPE = "a long, b string, x string, y double"


def versions(spark, seed, n=300):
    r = random.Random(seed)
    old = {(i, r.choice(["p", "q"])): (r.choice([None, "u", "v"]), r.choice([None, 0.5, float(i)])) for i in range(n)}
    new = dict(old)
    for key in r.sample(sorted(old), n // 10):
        at = r.random()
        if at < 0.3:
            del new[key]
        elif at < 0.6:
            new[key] = (r.choice([None, "w"]), new[key][1])
        else:
            new[(key[0] + n, key[1])] = ("z", None)
    frame = lambda rows: spark.createDataFrame([(*k, *v) for k, v in rows.items()], SHAPE)
    return old, new, frame(old), frame(new)


@pytest.mark.parametrize("leaves", [1, 8, 4096])
def test_changed_rows(spark, monkeypatch, leaves):
    monkeypatch.setattr(snapshot, "LEAVES", leaves)
    old, new, a, b = versions(spark, leaves)
    got = {(x["a"], x["b"]): x["change"] for x in snapshot.changed_rows(a, b, ["a", "b"]).collect()}
    want = {k: "INSERT" for k in new if k not in old} | {k: "DELETE" for k in old if k not in new} | {k: "UPDATE" for k in old if k in new and old[k] != new[k]}
    assert got == want and snapshot.changed_rows(a, a, ["a", "b"]).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_changes_beside_the_meant_keys_are_counted(spark, share):
    """However much of what changed was meant, the counts are those of the whole comparison."""
    old, new, a, b = versions(spark, 5)
    changed = sorted({k for k in {*old, *new} if old.get(k) != new.get(k)})
    meant = spark.createDataFrame([*changed[: int(share * len(changed))], *list(old)[:20]], "a long, b string")
    got = snapshot.counted_changes(a, b, ["a", "b"], meant, "t").first()
    assert got == snapshot.op_counts(snapshot.snapshot_diff(a, b, ["a", "b"]), "t").first()


def test_digests_tell_nulls_and_swapped_columns(spark):
    one = spark.createDataFrame([(1, "p", None, 1.0), (2, "p", "u", None)], SHAPE)
    for other in ([(1, "p", "", 1.0), (2, "p", "u", None)], [(1, "p", None, 1.0), (2, "p", None, None)], [(1, "p", None, None), (2, "p", "u", 1.0)]):
        assert snapshot.changed_rows(one, spark.createDataFrame(other, SHAPE), ["a", "b"]).count() > 0
