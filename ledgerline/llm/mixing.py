"""Mixing sources to target weights by a low-discrepancy schedule.

A document's size is its number of words. Targets share the total of all sizes by weight and stop at ``most`` times a source's
size; what is over goes to the others by weight. A source's documents, in an order by hash, form one stream, cut into blocks of
equal size (give or take a word): about ``block`` words each, and at least 64 blocks, or one for each word of a source that has fewer.
A source's slots are as many of its blocks as come nearest to its target, so what it takes is within half a block of it: half a
word for a source of up to 64 words. Slots are dealt by golden-ratio points through the cumulative numbers of slots: the n-th
point is the fraction of n times the golden ratio, so every source's share of any run of slots is close to its weight; what the
points leave a source short of follows at the end. Its r-th slot takes block r mod blocks, and no block is taken more than
``most`` times. A document's words taken are those of its parts of the taken blocks.

Ranks and running sums are made in two levels (within chunks or hash ranges, as many as the number of rows calls for, then over
these), so no source meets in one task. Only the table of sources, one row each, is ordered in one task: a few hundred bytes for
each source, so a million of them would do, and a table with a source for each of its documents would not.
Null texts have size 0; documents of size 0 are never taken. A null source is a source of its own, the last in order. Repeated
rows are documents of their own. Very long texts are counted whole and cut by blocks like others. Ties of the hash are ordered by id and
size. Without any words all targets are 0. An empty table gives an empty result. Extra columns are ignored; the same rows give
the same mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

GOLDEN = 0.6180339887498949
SLOTS, LEAST_BLOCK, MOST_BLOCK, CELLS, CHUNK = 1 << 16, 16, 4096, 4096, 4096
#: Blocks that a source is cut into at least, and rows that a hash range holds on average at most.
FINE, RANGE_ROWS = 64, 100_000
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """(source, source_size) with weight and target. In order of their cap per weight, the sources that reach their cap come first."""
    every = Window.partitionBy()
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    table = F.array(*[F.lit(w) for w in weights])
    rows = sources.withColumn("weight", F.get(table, (F.row_number().over(by_name) - 1) % len(weights))).withColumn("cap", F.col("source_size") * F.lit(most))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    rows = rows.withColumn("total", F.sum("source_size").over(every))
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("total") - before) / left).withColumn("capped", F.col("level") > F.col("cap") / F.col("weight"))
    level = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * level)))
    return rows.select("source", "source_size", "weight", "target")


def running(df: DataFrame, keys: list[str], part: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """The sum of ``value`` over the rows before each one, by keys, in order of part and ``order``; parts bound what a task sorts."""
    df = df.withColumn("_part", part)
    sums = df.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    sums = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_sum")).drop("_sum")
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.withColumn(name, F.sum(value).over(within) - value)
    return local.join(sums, [*keys, "_part"]).withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def with_blocks(sources: DataFrame, block: int, most: int) -> DataFrame:
    """The number of each source's blocks, of which the first ``longer`` have a word more than ``words``, and of its slots."""
    size = F.col("source_size")
    rows = sources.withColumn("blocks", F.greatest(F.ceil(size / F.lit(block)), F.least(size, F.lit(FINE)), F.lit(1)).cast("long"))
    rows = rows.withColumn("words", F.floor(size / F.col("blocks"))).withColumn("longer", size - F.col("words") * F.col("blocks"))
    need = F.round(F.col("target") * F.col("blocks") / F.greatest(size, F.lit(1))).cast("long")
    return rows.withColumn("slots", F.coalesce(F.least(need, most * F.col("blocks")), F.lit(0).cast("long")))


def block_at(word: Column) -> Column:
    """The block in which a source's word lies, by its place in the stream."""
    edge = F.col("longer") * (F.col("words") + 1)
    return F.when(word < edge, F.floor(word / (F.col("words") + 1))).otherwise(F.col("longer") + F.floor((word - edge) / F.col("words")))


def block_begin(block_no: Column) -> Column:
    return block_no * F.col("words") + F.least(block_no, F.col("longer"))


def schedule(shares: DataFrame) -> DataFrame:
    """(slot, key, block_no, epoch) of every slot, from (key, blocks, slots)."""
    spark = shares.sparkSession
    by_key = Window.orderBy("key")
    total = shares.agg(F.sum("slots")).first()[0] or 0
    rows = shares.filter("slots > 0").withColumn("high", F.sum("slots").over(by_key) / F.lit(total)).withColumn("low", F.coalesce(F.lag("high").over(by_key), F.lit(0.0)))
    # The last source reaches beyond 1, and neighbours share a bound: every point has one source. Points and sources meet by cells of the unit interval.
    rows = rows.withColumn("high", F.when(F.row_number().over(Window.orderBy(F.desc("key"))) == 1, F.lit(2.0)).otherwise(F.col("high")))
    last = F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS)).cast("int")
    cells = rows.select("key", "low", "high", "blocks", "slots", F.explode(F.sequence(F.floor(F.col("low") * CELLS).cast("int"), last)).alias("cell"))
    turn = (F.col("id") + 1) * F.lit(GOLDEN)
    points = spark.range(total).select(F.col("id").alias("slot"), (turn - F.floor(turn)).alias("point")).withColumn("cell", F.floor(F.col("point") * CELLS).cast("int"))
    dealt = points.join(cells, "cell").filter((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))).select("slot", "key", "blocks", "slots")
    ranked = running(dealt, ["key"], F.floor(F.col("slot") / CHUNK), [F.col("slot")], F.lit(1).cast("long"), "rank")
    counts = dealt.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    short = shares.join(counts, F.col("key") == F.col("k"), "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n < slots")
    short = short.select("key", "blocks", "slots", F.explode(F.sequence("n", F.col("slots") - 1)).alias("rank")).withColumn("slot", F.lit(total) + F.col("rank"))
    every = ranked.filter("rank < slots").unionByName(short)
    return every.select("slot", "key", (F.col("rank") % F.col("blocks")).alias("block_no"), F.floor(F.col("rank") / F.col("blocks")).alias("epoch"))


def mix(documents: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each document."""
    size = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORDS))).cast("long")
    docs = saved(documents.select("doc_id", "source", size.alias("size")), "sizes")
    rows = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    rows = saved(rows, "sources")
    total, n = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    block = max(LEAST_BLOCK, min(MOST_BLOCK, total // SLOTS))
    goals = targets(rows.drop("n"), weights, most)
    goals = with_blocks(goals.withColumn("key", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))).cast("long")), block, most)
    goals = saved(goals, "targets")
    times = schedule(goals.select("key", "blocks", "slots")).groupBy("key", "block_no").agg(F.count(F.lit(1)).alias("times"))

    known = docs.alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select("doc_id", "d.source", "size", "source_size", "target", "key", "words", "longer")
    spread = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))
    worded = known.filter("size > 0").withColumn("_h", spread)
    digits = max(2, math.ceil(math.log(max(n, 1) / RANGE_ROWS, 16)))
    placed = running(worded, ["key"], F.substring("_h", 1, digits), [F.col("_h"), F.col("doc_id"), F.col("size")], F.col("size"), "at")
    first, last = block_at(F.col("at")), block_at(F.col("at") + F.col("size") - 1)
    parts = placed.withColumn("block_no", F.explode(F.sequence(first, last)))
    inside = F.least(F.col("at") + F.col("size"), block_begin(F.col("block_no") + 1)) - F.greatest(F.col("at"), block_begin(F.col("block_no")))
    taken = parts.join(times, ["key", "block_no"], "left").withColumn("words", inside * F.coalesce("times", F.lit(0)))
    result = ["doc_id", "source", "size", "source_size", "target"]
    # A place in the stream belongs to one document only.
    summed = taken.groupBy("key", "at", *result).agg(F.sum("words").cast("long").alias("taken")).select(*result, "taken")
    return summed.unionByName(known.filter("size = 0").select(*result, F.lit(0).cast("long").alias("taken")))


def mixed_documents(documents: DataFrame, small_rows: int = 1_000_000, **options) -> DataFrame:
    """Each document as often as the mix takes it, whole: its words taken divided by its size, rounded half up; none for 0."""
    times = F.avg(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("copies")
    copies = mix(documents, **options).filter("size > 0").groupBy(F.col("doc_id").alias("id"), F.col("source").alias("origin"), F.col("size").alias("words")).agg(times)
    copies = saved(copies.filter("copies > 0"), "copies")
    copies = F.broadcast(copies) if copies.count() <= small_rows else copies
    size = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORDS))).cast("long")
    rows = documents.select(F.struct("*").alias("row"), size.alias("n"))
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & F.col("row.source").eqNullSafe(F.col("origin")) & (F.col("n") == F.col("words"))
    repeated = rows.join(copies, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return repeated.select("row.*")
