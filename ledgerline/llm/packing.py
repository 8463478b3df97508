"""Harmonic packing of documents into fixed-length sequences.

A sequence holds ``capacity`` (C) tokens. Class k holds pieces of exactly C // k tokens, k of them to a sequence, so each
class's sequences are filled by counting alone. A document gives whole sequences of C first; what remains, of length r, is
cut by the class of the smallest k with C // k <= r, again and again, until at most ``tail`` tokens are left; those form one
last piece, which joins the class of its own length r with C // r pieces to a sequence. Workers number the pieces of each
class that they meet; counts by worker and class, summed, place every worker's run of pieces without moving the pieces.
Only the last, partly filled sequence of each class needs more: its pieces (bounded by the number of classes and C, whatever
the input) are put together by first fit, longest first.

Null and empty texts are one end token long. Repeated rows are packed as often as they occur. Order of rows within a worker
follows the input. An empty table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import resident, saved, slices, small_batches, text_bytes, trim
from .token_count import byte_letters

CAPACITY, TAIL, END_ID = 4096, 64, 2
#: Bytes of coded runs that a worker remembers, and the longest run kept. An entry costs about ENTRY bytes beside its text and ids.
KEPT_BYTES, LONGEST_KEPT, ENTRY = 32 << 20, 64, 240
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, worker int, nth long"


def cut_lengths(n: int, capacity: int = CAPACITY, tail: int = TAIL) -> list[int]:
    """The lengths of a document's pieces, in order."""
    out = [capacity] * (n // capacity)
    r = n % capacity
    while r > tail:
        k = -(-capacity // r)
        while capacity // k > r:
            k += 1
        out.append(capacity // k)
        r -= capacity // k
    return [*out, r] if r else out


#: Runs of these letters, then of these marks, are cut between the two and need no normalising but lower case.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]*)")

MARKS = rb"""!"#$%&()*+,-./:;=>?@[\]^_`{|}~"""


class Known(dict):
    """Coded runs that are kept, and beside them the long ones of the texts at hand."""

    def __init__(self):
        self.long: dict[bytes, bytes] = {}

    def __missing__(self, run: bytes) -> bytes:
        return self.long[run]


class IdTable:
    """Token ids, as little-endian bytes, of runs between ASCII white space (which the vocabulary drops).

    What has been coded is kept in a table of bounded bytes; a full table stays for one more round, so frequent runs stay known.
    """

    def __init__(self, path: str, kept: int = KEPT_BYTES):
        from tokenizers import Tokenizer, pre_tokenizers

        self.kept = kept
        self.tokenizer = Tokenizer.from_file(path)
        self.merging = Tokenizer(self.tokenizer.model)  # for words that are normalised already
        self.merging.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = {byte: letter for letter, byte in byte_letters().items()}
        self.known, self.old, self.held = Known(), Known(), 0
        self.words: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def code_whole(self, texts: list[str]) -> list[bytes]:
        """By the whole tokenizer, normaliser and special tokens included."""
        return [np.array(c.ids, dtype="<u4").tobytes() for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def code_words(self, words: list[str], at_once: int = 32) -> list[bytes]:
        """Plain lower-case words, many in each call."""
        spelled = [w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in words]
        out: list[bytes] = []
        for c in self.merging.encode_batch([" ".join(spelled[i : i + at_once]) for i in range(0, len(spelled), at_once)], add_special_tokens=False):
            ids, owner = np.array(c.ids, dtype="<u4").tobytes(), c.word_ids
            begins = [0, *(i for i in range(1, len(owner)) if owner[i] != owner[i - 1]), len(owner)]
            out += [ids[4 * i : 4 * j] for i, j in itertools.pairwise(begins)]
        return out

    def learn(self, runs: set[bytes]) -> None:
        known, old = self.known, self.old
        again = runs & old.keys()
        known.update((run, old[run]) for run in again)
        self.held += sum(ENTRY + len(run) + len(old[run]) for run in again)
        new: list[tuple[bytes, str, str]] = []
        odd: list[bytes] = []
        long: list[bytes] = []
        for run in runs - again:
            if len(run) > LONGEST_KEPT:
                long.append(run)
                continue
            core = run.rstrip(MARKS)
            if core.isalpha():  # ASCII letters only
                new.append((run, core.lower().decode(), run[len(core) :].decode()))
            elif m := PLAIN.fullmatch(run.decode("utf-8", "replace")):
                new.append((run, m[1].lower(), m[2]))
            else:
                odd.append(run)
        coded = dict(zip(odd + long, self.code_whole([r.decode("utf-8", "replace") for r in odd + long]), strict=True))
        known.long = {r: coded.pop(r) for r in long}
        words, marks = self.words, self.marks
        missing = list({w for _, w, _ in new if w not in words})
        words.update(zip(missing, self.code_words(missing), strict=True))
        missing = list({m for _, _, m in new if m not in marks})
        marks.update(zip(missing, self.code_whole(missing), strict=True))
        coded.update((run, words[w] + marks[m]) for run, w, m in new)
        self.held += sum(ENTRY + len(run) + len(ids) for run, ids in coded.items())
        known.update(coded)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if self.held > self.kept // 2:  # the table and the one before it
            self.old, self.known, self.held = self.known, Known(), 0
            self.words.clear()
            self.marks = {"": b""}
        runs = [t.split() for t in texts]
        self.learn(set().union(*runs) - self.known.keys())
        look = self.known.__getitem__
        return [b"".join(map(look, ws)) for ws in runs]


def pieces(documents: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, kept_bytes: int = KEPT_BYTES) -> DataFrame:
    """Each document's pieces with the crc32 of their ids, numbered by worker and length. Each Python worker remembers about ``kept_bytes``."""
    end = np.array([END_ID], dtype="<u4").tobytes()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        table, worker = resident(f"{path} {kept_bytes}", lambda: IdTable(path, kept_bytes)), TaskContext.get().partitionId()
        met: dict[int, int] = defaultdict(int)
        fields = [x.split()[0] for x in PIECES.split(", ")]
        for ids, texts in slices(rows):
            out = {f: array("q") for f in fields[1:]}
            owners: list[int | None] = []
            add = [out[f].append for f in fields[1:]]
            for doc_id, coded in zip(ids, table.encode(texts), strict=True):
                view, start = memoryview(coded + end), 0
                total = len(view) // 4
                for length in cut_lengths(total, capacity):
                    owners.append(doc_id)
                    for put, x in zip(add, (start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), total, worker, met[length]), strict=True):
                        put(x)
                    met[length] += 1
                    start += length
            columns = [pa.array(owners, pa.int64())] + [pa.array(np.frombuffer(x, "<i8")) for x in out.values()]
            yield pa.RecordBatch.from_arrays([c.cast(pa.int32()) if f == "worker" else c for f, c in zip(fields, columns, strict=True)], names=fields)
        trim()

    small_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(batches, PIECES)


def pack(documents: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, kept_bytes: int = KEPT_BYTES) -> DataFrame:
    """One row for each piece, with the sequence and the offset it lies at; offsets have no gaps."""
    cut = saved(pieces(documents, vocabulary, capacity, kept_bytes), "pieces")
    # A row for each worker and length: at most some dozens of lengths for each worker.
    counts = cut.groupBy("length", "worker").agg(F.count(F.lit(1)).alias("n"))
    by_length = W.Window.partitionBy("length")
    before = counts.select(
        "length", "worker", (F.sum("n").over(by_length.orderBy("worker")) - F.col("n")).alias("before"), F.sum("n").over(by_length).alias("in_class")
    )
    per = F.floor(F.lit(capacity) / F.col("length"))
    placed = (
        cut.join(before, ["length", "worker"])
        .withColumn("place", F.col("before") + F.col("nth"))
        .withColumn("bin", F.floor(F.col("place") / per))
        .withColumn("full", F.col("bin") < F.floor(F.col("in_class") / per))
    )
    result = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    # Sequence ids: the class's length tells classes apart, the bin counts on within the class; 0 to capacity - 1 stay free.
    full = placed.filter("full").withColumn("sequence_id", (F.col("bin") + 1) * (capacity + 1) + F.col("length")).withColumn("offset", F.pmod(F.col("place"), per) * F.col("length"))

    # Each length up to the tail, and each of the about 2 * sqrt(C) lengths C // k, leaves less than one sequence: C // length - 1 pieces.
    lengths = {*range(1, TAIL + 1), *(capacity // k for k in range(1, capacity + 1))}
    most_left = sum(capacity // n - 1 for n in lengths)

    def first_fit(rest: pd.DataFrame) -> pd.DataFrame:
        if len(rest) > most_left:
            raise RuntimeError(f"{len(rest)} pieces in last sequences, where {most_left} are the most there can be")
        rest = rest.sort_values(["length", "place"], ascending=[False, True])
        used: list[int] = []
        sequence, offset = [], []
        first: dict[int, int] = defaultdict(int)
        for length in rest["length"].tolist():
            at = first[length]  # room only shrinks: a shorter or equal length need not look before this bin again
            while at < len(used) and used[at] + length > capacity:
                at += 1
            first[length] = at
            if at == len(used):
                used.append(0)
            sequence.append(at)
            offset.append(used[at])
            used[at] += length
        return rest.assign(sequence_id=sequence, offset=offset)[result]

    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    rest = placed.filter("not full").select(*result[:5], "place").groupBy().applyInPandas(first_fit, shape)
    return full.select(result).unionByName(rest)
