"""Exact top-k inner products by a three-phase uniform threshold.

Vectors are cut into ``lists`` blocks of components; a block's inner products with a query are one local score list, and a
candidate's score is the sum over the lists. Phase one gathers each list's k best entries; their exact scores give a safe
cutoff t, the k-th best among them. Phase two collects every entry of at least t / lists: a candidate of score t or more has
one such entry, since lower ones could not add up to t. Phase three drops candidates whose known scores and the cutoff for
the unknown ones cannot reach the k-th best known score, and resolves the rest exactly.

Queries and vectors meet in blocks (never all pairs in one task), and equal vectors are held once: of them only the k + 1
smallest ids can be among any query's k best. Components are turned into floor(scale * x).

Vectors that are null, hold a null or non-finite component, or have a null id take no part; vectors of different lengths are
not compared; an empty vector scores 0 with other empty ones. Repeated rows of one id and vector count once. Ties go to the
smaller id. Queries without any candidate give no row, and so does an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

VECTORS_IN_BLOCK, QUERIES_IN_BLOCK, PRODUCTS_AT_ONCE = 16_384, 2_048, 4_000_000


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where every partial sum is below 2 ** 53, else in 64-bit integers."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    if most < 2**53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


def stacked(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), -1)


def exact_top_k(vectors: DataFrame, is_query: str = "vec_id % 100 = 0", k: int = 10, lists: int = 2, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for every query row."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    rows = saved(clean.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), F.expr(is_query).alias("asks")), "vectors")
    queries = rows.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.size("v").alias("dim")).distinct()
    # Equal vectors: only the k + 1 smallest ids matter. The first limit holds in each map task, so a very common vector shuffles little.
    same = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.select("vec_id", "v").distinct().withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1)
    held = saved(kept.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("vid", F.element_at("ids", 1)).withColumn("dim", F.size("v")), "distinct")
    n_vectors, n_queries = held.count(), queries.count()
    if not n_vectors or not n_queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chunks, blocks = -(-n_vectors // VECTORS_IN_BLOCK), -(-n_queries // QUERIES_IN_BLOCK)

    def part(v: str, j: Column) -> Column:
        """The j-th block of components."""
        step = F.ceil(F.size(v) / F.lit(lists)).cast("int")
        return F.slice(v, j.cast("int") * step + 1, F.greatest(step, F.lit(0)))

    all_lists = F.explode(F.sequence(F.lit(0), F.lit(lists - 1))).alias("list")
    each_list = held.select("vid", "v", "dim", F.pmod(F.xxhash64("vid"), F.lit(chunks)).alias("chunk"), all_lists)
    by_list = each_list.select("vid", "dim", "chunk", "list", part("v", F.col("list")).alias("part"))
    left = by_list.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")) if blocks > 1 else by_list.withColumn("block", F.lit(0))

    def asked(q: DataFrame) -> DataFrame:
        q = q.select("*", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), all_lists, F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<long>").alias("chunks"))
        q = q.withColumn("chunk", F.explode("chunks")).drop("chunks")
        return q.withColumn("part", part("q", F.col("list"))).drop("q")

    keys, shape = ["list", "chunk", "block", "dim"], "query_id long, vid long, list int, local long"

    def scan(one: pd.DataFrame, other: pd.DataFrame, choose) -> pd.DataFrame:
        out = []
        if len(one) and len(other):
            vids, matrix, asks = one["vid"].to_numpy(), stacked(one["part"]), stacked(other["part"])
            step = max(1, PRODUCTS_AT_ONCE // len(vids))
            for i in range(0, len(other), step):
                score = products(asks[i : i + step], matrix)
                r, c = choose(score, other.iloc[i : i + step])
                out.append(pd.DataFrame({"query_id": other["query_id"].to_numpy()[i + r], "vid": vids[c], "list": one["list"].iloc[0], "local": score[r, c]}))
        return pd.concat(out) if out else pd.DataFrame({x.split()[0]: [] for x in shape.split(", ")}, dtype="int64")

    def best(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        def choose(score: np.ndarray, _: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            n = min(k + 1, score.shape[1])
            c = np.argpartition(-score, n - 1, axis=1)[:, :n]
            return np.repeat(np.arange(len(c)), n), c.ravel()

        return scan(one, other, choose)

    def above(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        return scan(one, other, lambda score, rows: np.nonzero(score * lists >= rows["cutoff"].to_numpy()[:, None]))

    def meet(q: DataFrame, choose) -> DataFrame:
        return left.groupBy(*keys).cogroup(asked(q).groupBy(*keys)).applyInPandas(choose, shape)

    def resolved(pairs: DataFrame) -> DataFrame:
        """Exact scores of (query_id, vid) pairs, one row for each id of the vector but the query's own."""
        both = pairs.join(held.select("vid", "v", "ids"), "vid").join(queries.select("query_id", "q"), "query_id")
        dot = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
        one = both.select("query_id", "vid", dot.alias("score"), "ids")
        return one.select("query_id", "vid", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")

    # Phase one: the best of every list, merged over the chunks; the k-th best of their exact scores is a safe cutoff.
    per_list = Window.partitionBy("query_id", "list").orderBy(F.desc("local"), "vid")
    gathered = meet(queries, best).withColumn("place", F.row_number().over(per_list)).filter(F.col("place") <= k + 1)
    first = saved(resolved(gathered.select("query_id", "vid").distinct()), "first")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("cutoff"))
    # Fewer than k entries can only mean that there are no more candidates in all lists: then everything is let through.
    cut = saved(queries.join(kth, "query_id", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(-(2**62)))), "cutoffs")
    # Phase two: all entries that can matter. An unknown list holds less than cutoff / lists.
    entries = meet(cut, above).groupBy("query_id", "vid").agg(F.sum("local").alias("known"), F.count(F.lit(1)).alias("lists_known"))
    bound = F.col("known") + (F.lit(lists) - F.col("lists_known")) * F.ceil(F.col("cutoff") / F.lit(lists))
    able = entries.join(cut.select("query_id", "cutoff"), "query_id").filter((F.col("lists_known") == lists) & (F.col("known") >= F.col("cutoff")) | (F.col("lists_known") < lists) & (bound >= F.col("cutoff")))
    # Phase three: exact scores of what is left.
    final = resolved(able.select("query_id", "vid")).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return final.select("query_id", "rank", "vec_id", "score")
