"""Comparing snapshots: parity, keyed differences, staleness, and table fingerprints made independently of the key digests."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encode import tree
from ..sources.versions import scratch


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b lacks (missing) and the reverse (extra); order and repetition do not count."""
    return a.subtract(b).withColumn("side", F.lit("missing")).unionByName(b.subtract(a).withColumn("side", F.lit("extra")))


def is_parity(a: DataFrame, b: DataFrame) -> DataFrame:
    return parity(a, b).agg(F.count_if(F.col("side") == "missing").alias("missing"), F.count_if(F.col("side") == "extra").alias("extra")).withColumn("is_parity", (F.col("missing") == 0) & (F.col("extra") == 0))


def row_text(df: DataFrame) -> Column:
    """A row's values with bars between them; backslashes and bars inside are escaped and nulls are told from texts."""
    plain = {c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")}  # no text of theirs has a bar
    text = lambda c: F.col(c).cast("string") if c in plain else F.regexp_replace(F.col(c).cast("string"), r"([\\|])", r"\\$1")
    one = lambda c: F.coalesce(F.concat(F.lit("="), text(c)), F.lit("~"))
    return F.concat_ws("|", *[one(c) for c in df.columns])


def fingerprint(df: DataFrame, relation: str) -> DataFrame:
    """(relation, digest, n_rows) of whole rows, whatever their order. Equal rows are counted first; groups by six, then by three
    hex digits of the row's digest keep every list short."""
    parts = tree(df.select(F.md5(row_text(df)).alias("h")), "md5", "x", ",").withColumnRenamed("b", "p")
    whole = parts.agg(F.md5(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]))).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    return whole.select(F.lit(relation).alias("relation"), "digest", "n_rows")


def restore_verdict(golden: DataFrame, restored: DataFrame) -> DataFrame:
    """Fingerprints compared by relation; one that is missing on either side is not restored."""
    r = restored.select("relation", F.col("digest").alias("_d"), F.col("n_rows").alias("_n"))
    rows = golden.join(r, "relation", "full_outer")
    return rows.select("relation", F.coalesce((F.col("digest") == F.col("_d")) & (F.col("n_rows") == F.col("_n")), F.lit(False)).alias("restored"))


def snapshot_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Key, change (INSERT, UPDATE, DELETE, SAME) and the names of changed columns, by a null-safe comparison."""
    values = [c for c in a.columns if c not in keys]
    left = a.select(*keys, F.struct(*values, F.lit(1).alias("_in")).alias("_a"))
    right = b.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*values, F.lit(1).alias("_in")).alias("_b"))
    same = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    rows = left.join(right, same, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in values])) if values else F.array().cast("array<string>")
    here, there = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    change = F.when(~here, "INSERT").when(~there, "DELETE").when(F.size(changed) > 0, "UPDATE").otherwise("SAME")
    return rows.select(*[F.coalesce(F.col(k), F.col(f"_k{i}")).alias(k) for i, k in enumerate(keys)], change.alias("change"), F.when(here & there, changed).otherwise(F.array().cast("array<string>")).alias("changed"))


#: Leaves of a table's digests; a comparison reads again what lies in leaves that differ.
LEAVES = 4_096


def leaf(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(LEAVES)).cast("int")


def leaf_digests(df: DataFrame, keys: list[str], sign: int = 1) -> DataFrame:
    """leaf, n, d0 to d3: for each leaf of the key space the rows in it and the sums of their 128-bit digests, in quarters.

    Sums of digests do not depend on order, count repeated rows, and can be taken from each other (``sign``). Tasks add up before
    anything is shuffled: some thousand rows each.
    """
    columns = [F.xxhash64(F.lit(seed), *[F.col(c) for c in sorted(df.columns)], *[F.col(c).isNull() for c in sorted(df.columns)]) for seed in (1, 2)]
    rows = df.select(leaf(keys).alias("leaf"), *[c.alias(f"h{i}") for i, c in enumerate(columns)])
    half = [x for i in range(2) for x in (F.col(f"h{i}").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(f"h{i}", 32))]
    return rows.groupBy("leaf").agg((F.count(F.lit(1)) * sign).alias("n"), *[(F.sum(x) * sign).alias(f"d{i}") for i, x in enumerate(half)])


def differing_leaves(a: list[DataFrame], b: list[DataFrame], keys: list[str]) -> list[int]:
    """The leaves whose digests differ between two versions: at most ``LEAVES`` numbers. Each version is a table, and tables of rows
    that are to be taken away from it."""
    names = ["n", *[f"d{i}" for i in range(4)]]
    signed = [(df, sign if i == 0 else -sign) for version, sign in ((a, 1), (b, -1)) for i, df in enumerate(version)]
    every = functools.reduce(DataFrame.unionByName, [leaf_digests(df, keys, sign) for df, sign in signed])
    total = every.groupBy("leaf").agg(*[F.sum(c).alias(c) for c in names])
    return [r["leaf"] for r in total.filter(functools.reduce(operator.or_, [F.col(c) != 0 for c in names])).select("leaf").collect()]


def changed_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """E4 without the rows that are the same: digests are compared first, and only rows in leaves that differ are joined."""
    b = b.select(a.columns)
    dirty = leaf(keys).isin(differing_leaves([a], [b], keys))
    return snapshot_diff(a.filter(dirty), b.filter(dirty), keys).filter("change <> 'SAME'")


def counted_changes(a: DataFrame, b: DataFrame, keys: list[str], touched: DataFrame, relation: str) -> DataFrame:
    """E5 of two versions, given the keys that a write was meant to touch: those are compared row by row, all others by their leaves'
    digests (a version's, less those of its meant rows), and where these differ, the leaf's rows are compared too. So nothing that was
    written beside the meant keys is missed, and where nothing was, no table is joined with the other."""
    b, meant = b.select(a.columns), touched.select(*keys)
    hit = [scratch(x.join(meant, keys, "left_semi").select(a.columns)) for x in (a, b)]
    counts = op_counts(snapshot_diff(*hit, keys), relation)
    dirty = differing_leaves([a, hit[0]], [b, hit[1]], keys)
    if not dirty:
        return counts
    beside = [x.filter(leaf(keys).isin(dirty)).join(meant, keys, "left_anti").select(a.columns) for x in (a, b)]
    more = op_counts(snapshot_diff(*beside, keys), relation)
    return counts.unionByName(more).groupBy("relation").agg(*[F.sum(c).alias(c) for c in ("ins", "upd", "del")])


def op_counts(diff: DataFrame, relation: str) -> DataFrame:
    """E5: operations of a difference; an update that changes nothing counts as none."""
    n = lambda c: F.count_if(F.col("change") == c)
    return diff.agg(n("INSERT").alias("ins"), n("UPDATE").alias("upd"), n("DELETE").alias("del")).select(F.lit(relation).alias("relation"), "ins", "upd", "del")


def staleness(snapshot: DataFrame, live: DataFrame, measure: str, ceiling: int) -> DataFrame:
    """How far the snapshot's highest measure lags behind; rejected if that is over the ceiling."""
    both = snapshot.agg(F.max(measure).alias("s")).join(live.agg(F.max(measure).alias("l")))
    lag = F.col("l") - F.coalesce("s", F.lit(0))
    return both.select(lag.alias("lag"), (lag > ceiling).alias("rejected"))
