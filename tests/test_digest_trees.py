"""Digests of tables are trees over one shuffle, equal to what plain loops give."""

import collections
import hashlib
import itertools

import pytest

from ledgerline.functions.encode import digest_of_set, tree
from ledgerline.operators import snapshot


def by(texts, n):
    return [(k, list(v)) for k, v in itertools.groupby(sorted(texts), key=lambda x: x[0][:n])]


def brute(digests, algorithm, times, comma):
    of = lambda texts: hashlib.new(algorithm, comma.join(texts).encode()).hexdigest()
    counts = collections.Counter(digests).items()
    sixes = [(k, of([f"{h}{times}{n}" for h, n in v]), sum(n for _, n in v)) for k, v in by(counts, 6)]
    return [(k, of([d for _, d, _ in v]), sum(n for *_, n in v)) for k, v in by(sixes, 3)]


@pytest.mark.parametrize("batch", [1, 7, 10_000])
@pytest.mark.parametrize("algorithm, times, comma", [("md5", "x", ","), ("sha256", "*", "")])
def test_trees(spark, batch, algorithm, times, comma):
    """Repeated digests, and some that share six digits or three, whatever the batches."""
    own = [hashlib.new(algorithm, str(i % 170).encode()).hexdigest() for i in range(400)]
    digests = own + [h[:6] + "0" * (len(h) - 6) for h in own[:50]] + [h[:3] + "f" * (len(h) - 3) for h in own[:60]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        made = tree(spark.createDataFrame([(h,) for h in digests], "h string").repartition(3), algorithm, times, comma).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r) for r in made) == brute(digests, algorithm, times, comma)
    assert tree(spark.createDataFrame([], "h string"), algorithm, times, comma).count() == 0


def test_a_fingerprint_shuffles_rows_once(spark):
    """Digests were shuffled by themselves, then by six and by three digits; only 4096 rows more go to the last task."""
    df = spark.createDataFrame([(i % 9, f"a|b\\{i % 3}") for i in range(50)], "a long, b string")
    for made in (snapshot.fingerprint(df, "t"), digest_of_set(df, ["a", "b"])):
        assert made._jdf.queryExecution().sparkPlan().toString().count("Exchange") + made._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 3
    parts = brute([hashlib.md5(f"={i % 9}|=a\\|b\\\\{i % 3}".encode()).hexdigest() for i in range(50)], "md5", "x", ",")
    assert snapshot.fingerprint(df, "t").first()["digest"] == hashlib.md5(",".join(d for _, d, _ in parts).encode()).hexdigest()
