"""Language-model scores by deleted interpolation.

A document's tokens are its words (runs without ASCII white space, A-Z lower-cased) and one end token. The model mixes the
bigram, unigram and uniform estimates; the weights depend on how often the context was seen and are learned by
expectation-maximisation on a held-out fold of the training documents, whose counts are deleted from the estimates for that
purpose. The end token is the context of a text's first word.

How it runs: documents are coded in chunks (a bounded number of tokens each, with the chunk's own vocabulary). Every chunk
asks once for each distinct unigram and bigram: the requests, packed as sorted arrays, are dealt by the hash of the n-gram,
their owners add up the counts of all chunks and answer each chunk in the order it asked. So a frequent n-gram is summed in
each chunk before anything is shuffled, and no table of counts is broadcast or held whole anywhere. There are as many owners
as the bytes of text call for. Words are told apart by 64-bit hashes, bigrams by 56-bit ones: of 10^9 distinct bigrams about
seven pairs share one, whose counts are then added.

Null texts count as empty: one end token. A null id counts as the empty text in the choice of folds. Without training documents
N and V are 0 and every estimate is uniform, so scores are 0. Very long texts are coded whole, in a chunk of their own where they fill one. Repeated rows are counted and scored as often as they occur. An empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, resident, saved, slices, small_batches, text_bytes, trim

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
CODED = "chunk long, deleted boolean, ids binary, marks binary, lengths binary, codes binary, vocabulary binary"
ANSWERS = "chunk long, deleted boolean, kind int, bucket int, total binary, held binary, tokens long, held_tokens long, types long"
END = xxhash.xxh64_intdigest(b" ")  # no word is a blank
#: Tokens in a chunk; bytes of text whose n-grams an owner counts.
CHUNK_TOKENS, OWNED_BYTES = 1_000_000, 8 << 20
#: Folds of a document: 0 trains, 1 trains and is deleted for learning the weights, 2 takes no part. Documents of fold 1 have chunks of their own.
TRAIN, DELETED, OUT = 0, 1, 2
BUCKETS = 24
BINS, BIN = 240, 0.1  # log10 bins of probabilities, for the counts that expectation-maximisation reads


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def unpack(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=kind)


def fold_of(doc_id: int | None, folds: int, out: int, deleted: int) -> int:
    crc = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if crc % folds == out:
        return OUT
    return DELETED if crc // folds % deleted == 0 else TRAIN


def bigram_keys(codes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """The hash of each token with its context. Every document ends with code 0, which is also the context of its first word."""
    v = vocabulary[codes]
    before = np.concatenate([vocabulary[:1], v[:-1]])
    with np.errstate(over="ignore"):
        return mix64(mix64(before) * np.uint64(3) + v) >> np.uint64(64 - BITS[1])


BITS = (64, 56)  # of a unigram's and a bigram's key
STEP = np.uint64(1 << 40)


def put_keys(keys: np.ndarray, base: int) -> bytes:
    """Ascending keys as differences of five bytes; the few larger ones are listed apart."""
    steps = np.diff(keys, prepend=np.uint64(base))
    large = np.flatnonzero(steps >= STEP)
    head = np.array([len(large), *large], dtype="<u4").tobytes() + steps[large].astype("<u8").tobytes()
    return head + steps.astype("<u8").view("u1").reshape(-1, 8)[:, :5].tobytes()


def get_keys(data: bytes, base: int) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    large, values = np.frombuffer(data, "<u4", n, 4), np.frombuffer(data, "<u8", n, 4 + 4 * n)
    five = np.frombuffer(data, "u1", offset=4 + 12 * n).reshape(-1, 5)
    steps = np.zeros((len(five), 8), "u1")
    steps[:, :5] = five
    steps = steps.view("<u8").ravel().copy()
    steps[large] = values
    return np.cumsum(steps, dtype=np.uint64) + np.uint64(base)


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, ascending, how often they train, and the place of each token's key."""
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(place[counts], minlength=len(distinct)).astype(np.uint32), place


def code(documents: DataFrame, folds: int, out: int, deleted: int) -> DataFrame:
    """Chunks of coded documents, one row each; documents of the deleted fold are in chunks of their own."""

    def chunks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CODED.split(", ")]
        kinds = [pa.int64(), pa.bool_()] + [pa.binary()] * 5
        task, serial = TaskContext.get().partitionId(), itertools.count()

        class Open:
            def __init__(self):
                self.words: defaultdict[bytes, int] = defaultdict(itertools.count(1).__next__)
                self.ids, self.marks, self.lengths, self.codes, self.held = [], [], [], [], 0

            def row(self, held: bool) -> pa.RecordBatch:
                vocabulary = np.array([END, *map(xxhash.xxh64_intdigest, self.words)], dtype=np.uint64)
                marks = np.array(self.marks, "u1") | (np.array([x is None for x in self.ids]).astype("u1") << 7)
                cells = [np.array([x or 0 for x in self.ids], "<i8"), marks, np.array(self.lengths, "<u4"), np.concatenate(self.codes).astype("<u4"), vocabulary]
                values = ((task << 32) | next(serial), held, *map(pack, cells))
                return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        resident("none", dict)
        parts = {False: Open(), True: Open()}
        for ids, raws in slices(rows):
            for doc_id, raw in zip(ids, raws, strict=True):
                tokens = raw.lower().split()
                fold = fold_of(doc_id, folds, out, deleted)
                part = parts[fold == DELETED]
                row = np.zeros(len(tokens) + 1, dtype=np.int64)
                row[:-1] = np.fromiter(map(part.words.__getitem__, tokens), dtype=np.int64, count=len(tokens))
                part.ids.append(doc_id)
                part.marks.append(fold)
                part.lengths.append(len(row))
                part.codes.append(row.astype(np.uint32))
                part.held += len(row)
                if part.held >= CHUNK_TOKENS:
                    yield part.row(fold == DELETED)
                    parts[fold == DELETED] = Open()
        for held, part in parts.items():
            if part.held:
                yield part.row(held)
        parts.clear()
        trim()

    return documents.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(chunks, CODED)


def asked(chunk) -> dict:
    """What a chunk asks for: under 0 its unigrams and under 1 its bigrams."""
    vocabulary, lengths = unpack(chunk.vocabulary, "<u8"), unpack(chunk.lengths, "<u4").astype(np.int64)
    codes, marks, ids = unpack(chunk.codes, "<u4"), unpack(chunk.marks, "u1"), unpack(chunk.ids, "<i8")
    trains = np.repeat((marks & 0x7F) != OUT, lengths)
    # Codes tell unigrams apart already: only the vocabulary is sorted.
    order = np.argsort(vocabulary)
    place = np.empty(len(vocabulary), np.int64)
    place[order] = np.arange(len(vocabulary))
    counts = np.bincount(codes[trains], minlength=len(vocabulary)).astype(np.uint32)[order]
    return {
        "ids": [None if m & 0x80 else int(i) for i, m in zip(ids, marks, strict=True)], "marks": marks & 0x7F, "lengths": lengths,
        0: (vocabulary[order], counts, place[codes]), 1: counted(bigram_keys(codes, vocabulary), trains), "end": place[0],
    }


def edges(kind: int, buckets: int) -> list[int]:
    """Buckets are ranges of hashes."""
    return [(i << BITS[kind]) // buckets for i in range(buckets)]


def requests(coded: DataFrame, buckets: int) -> DataFrame:
    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chunk in frame.itertuples(index=False):
                found, out = asked(chunk), []
                for kind in (0, 1):
                    keys, counts, _ = found[kind]
                    lows = edges(kind, buckets)
                    cut = [*np.searchsorted(keys, np.array(lows, dtype=np.uint64)), len(keys)]
                    for b, (i, j) in enumerate(itertools.pairwise(cut)):
                        if j > i:
                            out.append((int(chunk.chunk), bool(chunk.deleted), kind, b, put_keys(keys[i:j], lows[b]), pack(counts[i:j])))
                yield pd.DataFrame(out, columns=["chunk", "deleted", "kind", "bucket", "keys", "counts"])
        trim()

    return coded.mapInPandas(ask, "chunk long, deleted boolean, kind int, bucket int, keys binary, counts binary")


def answers(asking: DataFrame, buckets: int) -> DataFrame:
    """Owners add up what all chunks have counted and answer each in its own order."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        base = edges(int(rows["kind"].iloc[0]), buckets)[int(rows["bucket"].iloc[0])]
        keys = [get_keys(k, base) for k in rows["keys"]]
        ends = np.cumsum([0, *map(len, keys)])
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        n = int(place.max(initial=-1)) + 1
        counts = np.concatenate([unpack(x, "<u4") for x in rows["counts"]])
        held = counts * np.repeat(rows["deleted"].to_numpy(), np.diff(ends))
        total, held = (np.bincount(place, weights=x, minlength=n).astype(np.int64) for x in (counts, held))
        out = rows[["chunk", "deleted", "kind", "bucket"]].copy()
        out["total"] = [pack(total[place[i:j]].astype("<i8")) for i, j in itertools.pairwise(ends)]
        # Only the deleted fold's own chunks ever need the counts without it.
        out["held"] = [pack(held[place[i:j]].astype("<i8")) if d else b"" for d, (i, j) in zip(rows["deleted"], itertools.pairwise(ends), strict=True)]
        first = np.arange(len(out)) == 0  # the bucket's sums, told once
        out["tokens"], out["held_tokens"], out["types"] = (np.where(first, x, 0) for x in (total.sum(), held.sum(), (total > 0).sum()))
        return out

    return asking.groupBy("kind", "bucket").applyInPandas(add, ANSWERS)


def told(replies: pd.DataFrame, column: str) -> dict[int, np.ndarray]:
    return {int(kind): np.concatenate([unpack(x, "<i8") for x in rows[column]]) for kind, rows in replies.sort_values("bucket").groupby("kind")}


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, then one bucket for each doubling."""
    return np.where(count > 0, np.minimum(np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, BUCKETS - 1), 0)


def shares(top: np.ndarray, bottom: np.ndarray | float) -> np.ndarray:
    return np.divide(top, bottom, out=np.zeros(len(top)), where=np.asarray(bottom) > 0)


def bin_of(p: np.ndarray) -> np.ndarray:
    """Bin 0 for probability 0, then bins of log10 from 1 downwards."""
    return np.where(p > 0, np.clip(np.floor(-np.log10(np.maximum(p, 1e-300)) / BIN).astype(np.int64) + 1, 1, BINS - 1), 0)


def contexts(found: dict) -> np.ndarray:
    """The place, among the chunk's unigrams, of each token's context; the end token is the first token's."""
    return np.concatenate([[found["end"]], found[0][2][:-1]])


def held_counts(coded: DataFrame, replies: DataFrame, totals: dict) -> DataFrame:
    """Held-out tokens, counted by context bucket and by the bins of their deleted estimates. Only the deleted fold's chunks are read."""
    n = totals["tokens"] - totals["held"]

    def count(chunk: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        found, total, held = asked(chunk.iloc[0]), told(reply, "total"), told(reply, "held")
        one, two = total[0] - held[0], total[1] - held[1]
        context = one[contexts(found)]
        p2, p1 = shares(two[found[1][2]], context), shares(one[found[0][2]], float(n))
        cell = (context_bucket(context) * BINS + bin_of(p2)) * BINS + bin_of(p1)
        cells, counts = np.unique(cell, return_counts=True)
        return pd.DataFrame({"context": cells // BINS**2, "bin2": cells // BINS % BINS, "bin1": cells % BINS, "n": counts})

    shape = "context long, bin2 long, bin1 long, n long"
    mine = replies.filter("deleted").select("chunk", "kind", "bucket", "total", "held")
    counted_cells = coded.filter("deleted").groupBy("chunk").cogroup(mine.groupBy("chunk")).applyInPandas(count, shape)
    return counted_cells.groupBy("context", "bin2", "bin1").agg(F.sum("n").alias("n"))


def learn_weights(counts: pd.DataFrame, uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each context bucket. Buckets without held-out tokens take the weights of all together."""

    def middle(b: np.ndarray) -> np.ndarray:
        return np.where(b > 0, 10.0 ** (-(b - 0.5) * BIN), 0.0)

    def fit(rows: pd.DataFrame, bigram: bool) -> np.ndarray:
        p = np.stack([middle(rows["bin2"].to_numpy()), middle(rows["bin1"].to_numpy()), np.full(len(rows), uniform)])
        n, w = rows["n"].to_numpy(dtype=float), np.array([0.4, 0.4, 0.2]) if bigram else np.array([0.0, 0.8, 0.2])
        for _ in range(rounds):
            share = w[:, None] * p
            share /= share.sum(axis=0)
            w = (share * n).sum(axis=1) / n.sum()
        w = np.maximum(w, [0.0, 0.0, 1e-4])
        return w / w.sum()

    together = fit(counts, True) if len(counts) else np.array([0.4, 0.4, 0.2])
    out = np.tile(together, (BUCKETS, 1))
    out[0] = [0.0, 1 - 1e-2, 1e-2]
    for context, rows in counts.groupby("context"):
        out[int(context)] = fit(rows, context > 0)
    return out


def score(documents: DataFrame, folds: int = 7, out: int = 2, deleted: int = 10, buckets: int | None = None) -> DataFrame:
    """One row for each document. Those with crc32(doc_id) mod ``folds`` = ``out`` teach nothing; one in ``deleted`` of the rest is held out for the weights."""
    small_batches(documents.sparkSession)
    n_bytes = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets or max(4, n_bytes // OWNED_BYTES)  # an owner's keys take about as many bytes as the text they come from
    coded = saved(code(documents, folds, out, deleted), "coded")
    replies = saved(answers(requests(coded, buckets), buckets), "counts")
    sums = replies.filter("kind = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "held_tokens", "types")]).first()
    totals = {"tokens": sums["tokens"], "held": sums["held_tokens"], "types": sums["types"]}
    n, v = totals["tokens"], totals["types"]
    # At most BUCKETS * BINS * BINS rows reach the driver, whatever the input.
    weights = learn_weights(held_counts(coded, replies, totals).toPandas(), 1 / (v + 1))
    if not n:  # nothing was learned: every estimate is uniform
        weights = np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))

    def rate(chunk: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        found, total = asked(chunk.iloc[0]), told(reply, "total")
        one, two = total[0], total[1]
        starts = np.cumsum(found["lengths"]) - found["lengths"]
        c, context = one[found[0][2]], one[contexts(found)]
        w = weights[context_bucket(context)]
        p = w[:, 0] * shares(two[found[1][2]], context) + w[:, 1] * shares(c, float(n)) + w[:, 2] / (v + 1)
        add = lambda x: np.add.reduceat(x, starts)
        return pd.DataFrame({
            "doc_id": pd.array(found["ids"], dtype="Int64"), "held_out": found["marks"] == OUT, "n_tokens": found["lengths"], "n_known": add((c > 0).astype(np.int64)), "train_tokens": n,
            "base_score": add(np.log10((c + 1) / (n + v + 1))), "score": add(np.log10(p)),
        })

    return coded.groupBy("chunk").cogroup(replies.select("chunk", "kind", "bucket", "total").groupBy("chunk")).applyInPandas(rate, SCORES)
