"""Canonical encodings of keys: a type tag, the length and the text of each value, so that no two key tuples share a text."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tag(kind: T.DataType) -> str:
    """All integers are tagged alike; floating-point keys are refused."""
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "I"
    if isinstance(kind, T.StringType):
        return "T"
    if isinstance(kind, T.BinaryType):
        return "B"
    if isinstance(kind, T.FloatType | T.DoubleType):
        raise ValueError("floating-point columns cannot be keys")
    return "O"


def encoded(df: DataFrame, keys: list[str]) -> Column:
    """The key tuple of a row as one text."""
    if not keys:
        raise ValueError("a key needs columns")

    def one(name: str) -> Column:
        kind = df.schema[name].dataType
        text = F.hex(name) if isinstance(kind, T.BinaryType) else F.col(name).cast("string")
        return F.when(F.col(name).isNull(), F.lit("N0:")).otherwise(F.concat(F.lit(tag(kind)), F.length(text).cast("string"), F.lit(":"), text))

    return functools.reduce(F.concat, [one(k) for k in keys])


def tree(rows: DataFrame, algorithm: str, times: str, comma: str) -> DataFrame:
    """b, d, n: for each first three hex digits of the digests ``h``, the digest over those of its groups by six, and the number of rows.

    Equal digests are counted in each batch first. Then they are dealt by three digits and sorted, the only shuffle, and a task goes
    through them in order: it holds one group by six (``h`` ``times`` count, joined by ``comma``) and up to 4096 digests of such groups.
    """
    made_by = getattr(hashlib, algorithm)

    def digest(texts: list[str]) -> str:
        return made_by(comma.join(texts).encode(), usedforsecurity=False).hexdigest()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = pa.Table.from_batches([batch]).group_by("h").aggregate([("h", "count")]).combine_chunks()
            yield from some.select(["h", "h_count"]).rename_columns(["h", "n"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, leaves, groups, total, made = "", 0, [], [], 0, []
        for batch in batches:
            for h, n in zip(batch["h"].to_pylist(), batch["n"].to_pylist(), strict=True):
                if h == last:
                    count += n
                else:
                    if count:
                        leaves.append(f"{last}{times}{count}")
                        if h[:6] != last[:6]:
                            groups.append(digest(leaves))
                            leaves = []
                        if h[:3] != last[:3]:
                            made.append((last[:3], digest(groups), total))
                            groups, total = [], 0
                    last, count = h, n
                total += n
            yield arrow(made)
            made = []
        if count:
            groups.append(digest([*leaves, f"{last}{times}{count}"]))
            yield arrow([(last[:3], digest(groups), total)])

    def arrow(made: list[tuple[str, str, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip("bdn", m, strict=True)) for m in made], pa.schema([("b", pa.string()), ("d", pa.string()), ("n", pa.int64())]))

    return rows.select("h").mapInArrow(counted, "h string, n long").repartition(F.substring("h", 1, 3)).sortWithinPartitions("h").mapInArrow(run, "b string, d string, n long")


def digest_of_set(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row (digest, n): a digest of the multiset of key tuples that does not depend on their order.

    A tree of digests (``tree``): equal keys are counted first, then gathered by six hex digits of their digest, those groups by
    three, and these all. A list holds one sixteen-millionth of the distinct keys on average, so it stays small for 10 ** 12 of them.
    """
    high = tree(df.select(F.sha2(encoded(df, keys), 256).alias("h")), "sha256", "*", "")
    total = high.agg(F.array_sort(F.collect_list(F.struct("b", "d"))).alias("all"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return total.select(F.sha2(F.concat(F.array_join(F.transform("all", lambda x: x["d"]), ""), F.lit("#"), F.col("n").cast("string")), 256).alias("digest"), "n")
