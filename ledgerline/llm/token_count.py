"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens; the distinct pre-tokens of a batch are held as one ragged array of symbols, and in each
round every pre-token merges all places of its own lowest-rank pair. What survives is the number of tokens, the same as
the byte-level BPE library gives. Counts of pre-token runs are kept in a bounded table for each Python worker.

Nulls count as empty texts (0 tokens). Texts of any length are processed whole; equal rows give equal counts; an empty
table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident, slices, small_batches, text_bytes, trim

SCHEMA = "doc_id long, n_bytes long, n_tokens long"
#: The white space of Unicode.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Bytes of counted runs that a worker remembers, an entry costing about ENTRY beside its text; longer runs than LONGEST_KEPT letters are not kept,
#: and pre-tokens of more than LONG bytes are merged one by one, from a list of open places for each rank.
KEPT_BYTES, ENTRY, LONGEST_KEPT, LONG = 64 << 20, 120, 64, 512


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable letter: printable ones as themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTable:
    """Ranks of symbol pairs, and the counting of pre-tokens by synchronous merging."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        letters = byte_letters()
        self.first = np.zeros(256, dtype=np.int64)
        for letter, byte in letters.items():
            self.first[byte] = vocabulary[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        codes = np.array([(vocabulary[a] << 32) | vocabulary[b] for a, b in pairs], dtype=np.int64)
        results = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.ranks, self.results = codes[order], order.astype(np.int64), results[order]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.cut_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pre_tokens = regex.compile(PRE_TOKEN)
        self.twice = regex.compile(rf"[{SPACE}][{SPACE}]|^[{SPACE}]|[{SPACE}]$")
        self.known: dict[str, int] = {}
        self.known_runs: dict[str, int] = {}
        self.held = 0

    def rank_of(self, a: int, b: int) -> tuple[int, int] | None:
        """The rank of a pair and the symbol it merges into, if it merges."""
        code = (a << 32) | b
        at = int(np.searchsorted(self.codes, code))
        return (int(self.ranks[at]), int(self.results[at])) if at < len(self.codes) and self.codes[at] == code else None

    def count_long(self, pre_token: bytes) -> int:
        """The same for one long pre-token: places wait under their pair's rank, and a rank's places merge together, left to right.
        A merge makes pairs of higher ranks only, so no rank comes back; the work is the number of places, not of rounds times places."""
        symbols = self.first[np.frombuffer(pre_token, dtype=np.uint8)].tolist()
        following, preceding = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)]
        rank_of, left = functools.cache(self.rank_of), len(symbols)
        places: dict[int, list[int]] = {}
        ranks: list[int] = []

        def wait(i: int) -> None:
            if i >= 0 and following[i] >= 0 and (found := rank_of(symbols[i], symbols[following[i]])):
                if found[0] not in places:
                    places[found[0]] = []
                    heapq.heappush(ranks, found[0])
                places[found[0]].append(i)

        for i in range(len(symbols)):
            wait(i)
        while ranks:
            rank = heapq.heappop(ranks)
            for i in sorted(places.pop(rank)):
                j = following[i]
                if symbols[i] < 0 or j < 0 or (found := rank_of(symbols[i], symbols[j])) is None or found[0] != rank:
                    continue  # merged meanwhile
                symbols[i], symbols[j], following[i] = found[1], -1, following[j]
                if following[i] >= 0:
                    preceding[following[i]] = i
                left -= 1
                wait(preceding[i])
                wait(i)
        return left

    def count(self, pre_tokens: list[bytes]) -> np.ndarray:
        """Symbols that survive merging, for each of the pre-tokens (all of one byte or more)."""
        lengths = np.fromiter(map(len, pre_tokens), dtype=np.int64, count=len(pre_tokens))
        symbols = self.first[np.frombuffer(b"".join(pre_tokens), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pre_tokens)), lengths)
        counts = lengths.copy()
        nothing = len(self.codes)
        while len(symbols) > 1:
            code = (symbols[:-1] << 32) | symbols[1:]
            at = np.minimum(np.searchsorted(self.codes, code), nothing - 1)
            found = (self.codes[at] == code) & (owner[:-1] == owner[1:])
            if not found.any():
                break
            rank = np.where(found, self.ranks[at], nothing)
            lowest = np.full(len(pre_tokens), nothing, dtype=np.int64)
            np.minimum.at(lowest, owner[:-1][found], rank[found])
            chosen = found & (rank == lowest[owner[:-1]])
            # Where chosen places overlap (a run of equal symbols), take every other one from the left.
            places = np.flatnonzero(chosen)
            begins = np.flatnonzero(np.diff(places, prepend=-2) != 1)
            in_run = np.arange(len(places)) - np.repeat(begins, np.diff(np.append(begins, len(places))))
            places = places[in_run % 2 == 0]
            symbols[places] = self.results[at[places]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[places + 1] = False
            counts -= np.bincount(owner[places], minlength=len(pre_tokens))
            # Sequences without a mergeable pair are done.
            keep &= lowest[owner] < nothing
            symbols, owner = symbols[keep], owner[keep]
        return counts

    def learn(self, pre_tokens: Iterable[str]) -> dict[str, int]:
        """Counts pre-tokens that are not known yet; long ones are handed back rather than kept."""
        new = {t for t in pre_tokens if t not in self.known}
        coded = {t: t.encode() for t in new if len(t) <= LONG // 4 or len(t.encode()) <= LONG}
        found = dict(zip(coded, self.count(list(coded.values())).tolist(), strict=True)) if coded else {}
        found |= {t: self.count_long(t.encode()) for t in new - coded.keys()}
        short = {t: n for t, n in found.items() if len(t) <= LONGEST_KEPT}
        self.held += sum(ENTRY + len(t) for t in short)
        self.known.update(short)
        return {t: n for t, n in found.items() if t not in short}

    def count_pieces(self, pieces: list[str]) -> list[int]:
        """Tokens of strings without special tokens, each standing alone."""
        cut = [self.pre_tokens.findall(p) for p in pieces]
        long = self.learn(t for tokens in cut for t in tokens)
        known = self.known
        if not long:
            look = known.__getitem__
            return [sum(map(look, tokens)) for tokens in cut]
        return [sum(known[t] if t in known else long[t] for t in tokens) for tokens in cut]

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts. Runs between single spaces can be counted alone; other texts are cut as a whole."""
        if self.held > KEPT_BYTES:
            self.known_runs.clear()
            self.known.clear()
            self.held = 0
        out, runs, plain = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if (self.cut_special and self.cut_special.search(text)) or self.twice.search(text):
                parts = self.cut_special.split(text) if self.cut_special else [text]
                out[i] = len(parts) - 1 + sum(self.count_pieces([p for p in parts if p]))
            else:
                words = text.split(" ")
                plain.append(i)
                runs.append((words[0], words[1:]))
        known = self.known_runs
        new = list({w for _, words in runs for w in words if w not in known})
        counted = dict(zip(new, self.count_pieces([f" {w}" for w in new]), strict=True))
        long = {w: n for w, n in counted.items() if len(w) > LONGEST_KEPT}
        self.held += sum(ENTRY + len(w) for w in counted)
        known.update(counted)
        heads = self.count_pieces([head for head, _ in runs])
        for i, head, (_, words) in zip(plain, heads, runs, strict=True):
            out[i] = head + sum(map(known.__getitem__, words))
        for w in long:
            del known[w]
        return out


def count_tokens(documents: DataFrame, vocabulary: str | None = None, max_tokens: int = 512) -> DataFrame:
    """Bytes and tokens of each row's whole text; ``vocabulary`` is the path of a byte-level BPE file that all workers can open."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        table = resident(path, lambda: MergeTable(path))
        for ids, raw in slices(rows):
            tokens = table.count_texts([x.decode("utf-8", "replace") for x in raw])
            columns = [pa.array(x, pa.int64()) for x in (ids, [len(x) for x in raw], tokens)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens"])
        trim()

    small_batches(documents.sparkSession)
    counted = documents.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(batches, SCHEMA)
    return counted.withColumn("over_limit", F.col("n_tokens") > max_tokens)
