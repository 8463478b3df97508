"""Product codes of vectors: each part of a vector becomes the number of its nearest codebook entry, in exact integers.

The nearest entry is found by a geometric near-neighbour access tree over the entries of a part's codebook. A node holds split
points; every other entry goes to its nearest split point's child, and the node keeps, for each split point and each child, the
range of distances between them. A query's distances to the split points then rule out whole children: where they show, by the
triangle inequality, that all of a child is farther than the best entry so far, the child is never opened. Distances in these
bounds are rounded so that they can only keep too much, and only strictly worse children go; what is left is compared by squared
integer distances, ties to the lower entry.

Codebooks begin with the parts of the ``entries`` rows of smallest id. A round assigns all parts and moves every entry to the
componentwise floor of its parts' mean; entries that no part takes stay. Tasks return sums for each entry, never vectors.

Rows whose vector is null or holds a null or non-finite component go. Components are floor(scale x). Vectors shorter than the
longest, and a length that the number of parts doesn't divide, are filled up with zeros at the end. Components so large that a
squared distance might leave 64 bits are held at the largest that can't. Ids may repeat (rows are then ordered by vector) or be
null (ordered last). An empty table gives an empty result; fewer rows than entries give as many entries; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, saved

#: Split points of a node, and entries below which a node is a leaf.
SPLITS, LEAF = 8, 8
#: Bounds are moved by this share, far more than square roots and differences of doubles are off.
SLACK = 2.0**-46
#: Vectors searched at a time.
ROWS = 8_192
#: Labels up to which their sums are broadcast; beyond it the join shuffles.
SMALL_LABELS = 200_000


@dataclass
class Node:
    """``ids`` are the split points, or the entries of a leaf. low[i, j] to high[i, j] holds the distances of child j to split point i."""

    ids: np.ndarray
    points: np.ndarray
    children: list[Node | None]
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all of ``b``."""
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for k in range(a.shape[1]):
        d = a[:, k, None] - b[None, :, k]
        out += d * d
    return out


def grown(points: np.ndarray, ids: np.ndarray) -> Node:
    """The tree of the entries ``ids``. Split points are taken far apart: each is the entry farthest from those before it."""
    if len(ids) <= LEAF:
        return Node(ids, points[ids], [])
    chosen = [0]
    nearest = squared(points[ids], points[ids[:1]])[:, 0]
    while len(chosen) < SPLITS:
        far = int(np.argmax(nearest))
        if nearest[far] == 0:  # all are copies of split points
            break
        chosen.append(far)
        nearest = np.minimum(nearest, squared(points[ids], points[ids[far : far + 1]])[:, 0])
    if len(chosen) == 1:
        return Node(ids, points[ids], [])
    splits, rest = ids[chosen], np.delete(ids, chosen)
    apart = squared(points[rest], points[splits])
    home = np.argmin(apart, axis=1)
    children: list[Node | None] = []
    low, high = np.zeros((len(splits), len(splits))), np.zeros((len(splits), len(splits)))
    for j in range(len(splits)):
        mine = home == j
        children.append(grown(points, rest[mine]) if mine.any() else None)
        if mine.any():
            low[:, j], high[:, j] = np.sqrt(apart[mine].min(axis=0)) * (1 - SLACK), np.sqrt(apart[mine].max(axis=0)) * (1 + SLACK)
    return Node(splits, points[splits], children, low, high)


def look(node: Node, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, entry: np.ndarray) -> int:
    """Improves ``best`` (squared distance) and ``entry`` of the queries ``rows`` by the node; returns how many distances it took."""
    apart = squared(queries[rows], node.points)
    least = apart.min(axis=1)
    # Of equally near entries the lowest number, whatever their order in the node.
    lowest = np.where(apart == least[:, None], node.ids[None, :], np.iinfo(np.int64).max).min(axis=1)
    better = (least < best[rows]) | (least == best[rows]) & (lowest < entry[rows])
    best[rows[better]], entry[rows[better]] = least[better], lowest[better]
    took = apart.size
    if not node.children:
        return took
    away = np.sqrt(apart)
    for j, child in enumerate(node.children):
        if child is None:
            continue
        reach = np.sqrt(best[rows]) * (1 + SLACK)
        beyond = (away * (1 - SLACK) - node.high[:, j] > reach[:, None] * (1 + SLACK)) | (node.low[:, j] - away * (1 + SLACK) > reach[:, None] * (1 + SLACK))
        open_ = ~beyond.any(axis=1)
        if open_.any():
            took += look(child, queries, rows[open_], best, entry)
    return took


def nearest(tree: Node, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each query the nearest entry, ties to the lower, its squared distance, and how many distances were worked out in all."""
    best, entry = np.full(len(queries), np.iinfo(np.int64).max), np.full(len(queries), np.iinfo(np.int64).max)
    return entry, best, look(tree, queries, np.arange(len(queries)), best, entry) if len(queries) else 0


def component_bound(width: int) -> int:
    """Components up to this keep the squared distance of two vectors below 2 ** 62."""
    return 1 << max(0, (62 - max(1, width).bit_length()) // 2 - 1)


def matrix(vectors: pa.ListArray, width: int, scale: int) -> np.ndarray:
    """The vectors as rows of floor(scale x), filled up with zeros to ``width``."""
    values = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    sizes = np.diff(vectors.offsets.to_numpy())
    bound = component_bound(width)
    whole = np.clip(np.floor(values * scale), -bound, bound).astype(np.int64)
    if len(whole) == len(sizes) * width:
        return whole.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(whole)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = whole
    return out


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def assigned(vectors: np.ndarray, trees: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each vector's parts."""
    step = vectors.shape[1] // len(trees)
    both = [nearest(t, vectors[:, i * step : (i + 1) * step])[:2] for i, t in enumerate(trees)]
    return np.stack([e for e, _ in both], axis=1), np.stack([d for _, d in both], axis=1)


def forest(books: np.ndarray) -> list[Node]:
    """A tree for each part of ``books`` (part, entry, component)."""
    return [grown(b, np.arange(len(b))) for b in books]


def moved(rows: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """The codebooks after one round. Each task returns one row of sums for each part and entry it used."""
    parts, entries, step = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = forest(books)
        sums, counts = np.zeros((parts, entries, step), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)

        def done() -> pa.RecordBatch:
            p, e = np.nonzero(counts)
            made = pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])
            sums[:], counts[:] = 0, 0
            return made

        # 64 bits hold the sum of so many components at least.
        most, held = max(1, (1 << 62) // component_bound(parts * step)), 0
        for batch in pieces(batches):
            vectors = matrix(batch.column(0), parts * step, scale)
            entry, _ = assigned(vectors, trees)
            for p in range(parts):
                np.add.at(sums[p], entry[:, p], vectors[:, p * step : (p + 1) * step])
                counts[p] += np.bincount(entry[:, p], minlength=entries)
            held += len(vectors)
            if held + ROWS > most:
                yield done()
                held = 0
        yield done()

    totals = rows.select("embedding").mapInArrow(add, "part long, entry long, n long, total array<long>")
    at = F.posexplode_outer("total").alias("place", "x")  # an entry without components keeps its count
    each = totals.select("part", "entry", "n", at).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = books.copy()
    for r in each.collect():  # at most one row for each component of the codebooks
        if r["place"] is not None:
            out[r["part"], r["entry"], r["place"]] = int(r["x"]) // r["n"]
    return out


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """vec_id, code (two hex digits for each part), error, label_error, codebooks_sha256 for every vector kept. ``entries`` is at most 256."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number must fit two hex digits")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("embedding").isNotNull()).filter(finite)
    rows = saved(rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")), "vectors")
    longest = rows.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    width = -(-longest // parts) * parts
    head = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()
    start = matrix(pa.array([r["embedding"] for r in head], pa.list_(pa.float64())), width, scale)
    books = np.ascontiguousarray(start.reshape(len(head), parts, width // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        books = moved(rows, books, scale)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = forest(books)
        for batch in pieces(batches):
            entry, apart = assigned(matrix(batch.column(2), width, scale), trees)
            text = entry.astype(np.uint8).tobytes().hex()
            codes = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(apart.sum(axis=1))], ["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    coded = saved(rows.mapInArrow(encode, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "codes")
    # A null label is one of its own: keys are texts with a mark before them.
    key = F.concat(F.lit("="), F.col("label").cast("string"))
    coded = coded.withColumn("_label", F.coalesce(key, F.lit("-")))
    sums = coded.groupBy("_label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    few = sums.limit(SMALL_LABELS + 1).count() <= SMALL_LABELS
    both = coded.join(F.broadcast(sums), "_label") if few else salted_join(coded, sums, "_label", "code", "inner")
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
