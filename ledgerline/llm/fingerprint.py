"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its sentences and lines, cut after six words; the j-th copy of a paragraph has a digest of its own. A
sketch is a table of cells (count, sum of digests, sum of checks); each digest lies in three of them. Two sketches of one
size subtract, and peeling cells that hold a single digest recovers the digests that differ. When peeling stops early, both
texts are sketched again with four times the cells. The likeness is 2 * common / (paragraphs of both), 1 for two empty texts.
The printed fingerprint is the number of paragraphs and the smallest sketch, so equal texts print alike.

Null texts count as empty. With one document, the next document is itself. Of rows with equal ids the one with the smaller
text comes first; null ids come before all others. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, shuffle_width, small_batches

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
PARAGRAPH = re.compile(r"\s*(?:[^\s.!?]+[^\S\n]*){1,6}[.!?]*|\s*[.!?]+")
CELLS, HASHES, GROWTH, MOST_CELLS, BATCH = 30, 3, 4, 3_000_000, 256


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The paragraph digests of all texts, one after the other, and where each text's begin and the last one's end."""
    cut = [PARAGRAPH.findall(t.rstrip()) for t in texts]  # white space at the end belongs to no paragraph, and would be tried again from each place in it
    ends = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)
    flat = np.fromiter((xxhash.xxh3_64_intdigest(p.strip()) for c in cut for p in c), dtype=np.uint64, count=int(ends[-1]))
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    order = np.lexsort((flat, owner))
    flat = flat[order]
    same = np.zeros(len(flat), dtype=bool)
    same[1:] = (flat[1:] == flat[:-1]) & (owner[1:] == owner[:-1])
    begins = np.flatnonzero(~same)
    nth = np.arange(len(flat)) - np.repeat(begins, np.diff(np.append(begins, len(flat))))
    with np.errstate(over="ignore"):
        return mix64(flat + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), ends


def cells_of(keys: np.ndarray, cells: int) -> np.ndarray:
    """The cells of each digest: one in each third of the table."""
    third = np.uint64(cells // HASHES)
    return np.stack([mix64(keys + np.uint64(j + 1)) % third + np.uint64(j) * third for j in range(HASHES)]).astype(np.int64)


def sketch(keys: np.ndarray, owner: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n tables of cells: counts, digest sums, check sums."""
    at = cells_of(keys, cells) + owner * cells
    counts = np.bincount(at.ravel(), minlength=n * cells).astype(np.int64)
    sums, checks, check = np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64), mix64(~keys)
    for row in at:
        np.add.at(sums, row, keys)
        np.add.at(checks, row, check)
    return counts, sums, checks


def peel(counts: np.ndarray, sums: np.ndarray, checks: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests recovered from n subtracted tables, and whether each table was emptied."""
    found = np.zeros(n, dtype=np.int64)
    while True:
        one = np.flatnonzero(np.abs(counts) == 1)
        sign = counts[one]
        with np.errstate(over="ignore"):
            keys = np.where(sign == 1, sums[one], np.uint64(0) - sums[one])
            wanted = np.where(sign == 1, checks[one], np.uint64(0) - checks[one])
        pure = mix64(~keys) == wanted
        if not pure.any():
            break
        one, sign, keys = one[pure], sign[pure], keys[pure]
        owner = one // cells
        first = np.unique(np.stack([owner.astype(np.uint64), keys]), axis=1, return_index=True)[1]
        owner, sign, keys = owner[first], sign[first], keys[first]
        found += np.bincount(owner, minlength=n)
        check = mix64(~keys)
        with np.errstate(over="ignore"):
            less, less_check = np.where(sign == 1, np.uint64(0) - keys, keys), np.where(sign == 1, np.uint64(0) - check, check)
            for row in cells_of(keys, cells) + owner * cells:
                np.add.at(counts, row, -sign)
                np.add.at(sums, row, less)
                np.add.at(checks, row, less_check)
    left = (counts != 0) | (sums != 0) | (checks != 0)
    return found, ~left.reshape(n, cells).any(axis=1)


def take(keys: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digests of some of the texts, with their positions in ``which`` as owners."""
    sizes = ends[which + 1] - ends[which]
    owner = np.repeat(np.arange(len(which)), sizes)
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return keys[np.repeat(ends[which], sizes) + within], owner


def likeness(keys: np.ndarray, ends: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Likeness of the texts left[i] and right[i], from subtracted and peeled sketches, larger ones where peeling fails."""
    sizes = np.diff(ends)
    total = sizes[left] + sizes[right]
    differ, open_, cells = np.zeros(len(left), np.int64), np.arange(len(left)), CELLS
    while len(open_):
        again = []
        step = max(1, MOST_CELLS // cells)
        for i in range(0, len(open_), step):
            part = open_[i : i + step]
            a, b = (sketch(*take(keys, ends, side[part]), len(part), cells) for side in (left, right))
            with np.errstate(over="ignore"):
                found, done = peel(*(x - y for x, y in zip(a, b, strict=True)), len(part), cells)
            differ[part] = found
            again.append(part[~done])
        open_, cells = np.concatenate(again), cells * GROWTH
    return np.where(total > 0, (total - differ) / np.maximum(total, 1), 1.0)


def printed(keys: np.ndarray, ends: np.ndarray) -> list[str]:
    n = len(ends) - 1
    counts, sums, checks = sketch(keys, np.repeat(np.arange(n), np.diff(ends)), n, CELLS)
    whole = np.zeros((n, CELLS), dtype=[("count", "<u4"), ("sum", "<u8"), ("check", "<u4")])
    whole["count"], whole["sum"], whole["check"] = counts.reshape(n, -1), sums.reshape(n, -1), checks.reshape(n, -1) & np.uint64(0xFFFFFFFF)
    return [f"{size}:{base64.b64encode(row.tobytes()).decode()}" for size, row in zip(np.diff(ends).tolist(), whole, strict=True)]


def compare(ids: list, texts: list[str]) -> pd.DataFrame:
    """Rows for all texts but the last, which is only the one after."""
    n = len(ids)
    edited = []
    for text, after in zip(texts, texts[1:], strict=False):
        half = len(text) // 2
        edited.append(text[: len(text) - half] + after[:half])
    keys, ends = digests(texts + edited)
    prints = printed(keys, ends)
    each = np.arange(n)
    return pd.DataFrame({
        "doc_id": pd.array(ids, dtype="Int64"), "n_chars": [len(t) for t in texts[:n]], "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
        "fingerprint": prints[:n], "edited_fingerprint": prints[n + 1 :], "near_edited": likeness(keys, ends, each, each + n + 1), "near_next": likeness(keys, ends, each, each + 1),
    })


def fingerprints(documents: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how near they, and the next document's, are.

    Documents are dealt by ranges of ids, with the first document of the range after as a guest at each range's end, so that
    every next document is at hand. The bounds (one id for each range) are all that passes through the driver.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    width = shuffle_width(spark)
    ranges = ranges or min(8 * width, 20_000)
    bounds = sorted(set(docs.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [i / ranges for i in range(1, ranges)], 0.2 / ranges)))
    inf, bounds = float("inf"), bounds or [0.0]
    dealt = Bucketizer(splits=[-inf, *bounds, inf], inputCol="x", outputCol="range", handleInvalid="keep").transform(docs.withColumn("x", F.coalesce(F.col("doc_id").cast("double"), F.lit(-inf))))
    dealt = dealt.select("doc_id", "text", F.col("range").cast("int").alias("range"))
    heads = dealt.groupBy("range").agg(F.min("doc_id").alias("head"), F.max(F.col("doc_id").isNull()).alias("unnamed")).orderBy("range").collect()
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    before = [heads[-1], *heads[:-1]]
    size = heads[-1]["range"] + 1
    guest, head = [None] * size, [None] * size
    for h, b in zip(heads, before, strict=True):
        guest[h["range"]], head[h["range"]] = b["range"], None if h["unnamed"] else h["head"]
    guest_of, head_of = F.lit(guest).cast("array<int>"), F.lit(head).cast("array<long>")
    is_head = F.col("doc_id").eqNullSafe(head_of[F.col("range")])
    places = F.when(is_head, F.array(F.struct("range", F.lit(False).alias("guest")), F.struct(guest_of[F.col("range")].alias("range"), F.lit(True).alias("guest"))))
    placed = dealt.select("doc_id", "text", F.explode(F.coalesce(places, F.array(F.struct("range", F.lit(False).alias("guest"))))).alias("p"))
    ordered = placed.select("doc_id", "text", "p.range", "p.guest").repartition(width, "range").sortWithinPartitions("range", "guest", F.asc_nulls_first("doc_id"), "text")

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        texts: list[str] = []
        now, over = None, False

        def done() -> pd.DataFrame:
            nonlocal ids, texts
            out = compare(ids[: len(texts) - 1], texts)
            ids, texts = ids[len(texts) - 1 :], texts[-1:]
            return out

        for frame in frames:
            for doc_id, text, part, guest in zip(frame["doc_id"], frame["text"], frame["range"], frame["guest"], strict=True):
                if part != now:
                    ids, texts, now, over = [], [], part, False
                if over:  # more guests with the same id
                    continue
                texts.append(text)
                if guest:
                    over = True
                    yield done()
                    continue
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                if len(texts) > BATCH:
                    yield done()

    return ordered.mapInPandas(batches, SCHEMA)
