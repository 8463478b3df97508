"""N-gram Jaccard join by a token-group matrix.

A document's set is its distinct word shingles (64-bit hashes; 3 words by default); two documents link when
100 * |A and B| >= percent * |A or B|, and the result names each document's connected component. Documents with equal sets are
one class from the start.

1. Frequencies. Workers cut documents into chunks and send each chunk's tokens, dealt by ranges of hashes and shortened to 40 bits
   below the range, to be counted; what comes back is one byte a token. A set can link only if ``percent`` of it is held
   elsewhere too, so most documents leave here. Shortened hashes can only make a token look more frequent, never lose it.
2. Candidates. The classes that are left order their tokens by frequency, rarest first. Two linked sets share a token among
   the first |A| - ceil(percent of |A|) + 1 of each (prefix filter), so classes that share such a token are candidates, and
   classes that candidates connect are a family. A token's place bounds what two sets that meet there first can share (positional
   filter): each class has, at each token, a reach, the size of the largest set that it can link with there. Rows whose reach is
   below every size at their token, or whose size is above every reach, leave. So texts of one template, each with its own words
   in it, that share tokens but cannot link are no family.
3. Groups. A family is split, by hash, into groups of a bounded number of sets and bytes; the members of a group are compared
   exactly, by products of their token incidence. One member of each component found goes on to the next round, until a
   round ends in one group or joins little. A family of near copies shrinks by the group's size in each round.
4. The matrix. Candidates that still lie in different components are put into groups again: large components by themselves, the
   rest of a family by the rarest token that each shares, so that similar sets lie together. Groups that share a prefix token, with
   members of like size within each other's reach there, are a pair, whatever rounds joined before; a member's overlap with the other group's token union bounds its overlap with every
   member there, and only members that reach ``percent`` of their own size open the group and are compared exactly.
5. Components, by alternating star contraction on a spanning forest of the links, written out after each round.

Null and empty texts have an empty set and link with nothing, repeated rows of them included; texts with fewer words than a shingle
have one, the sequence. Very long texts are processed whole. Repeated rows, also of one id with different texts, are classes like
other copies, each row with the component of its own text. Rows with a null id take no part in links and are their own component
(null). An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, resident, salted_join, saved, slices, small_batches, text_bytes, trim

GROUP_MEMBERS, COLUMNS = 48, 1 << 16
#: Words whose hashes a worker remembers, and the longest such word in bytes.
KEPT, LONGEST_KEPT = 150_000, 64
#: Tokens and documents in a chunk (ordinals take two bytes); bytes of tokens in a hash range, in a group and in a slot.
CHUNK, CHUNK_DOCUMENTS, RANGE_BYTES, GROUP_BYTES, SLOT_BYTES = 500_000, 60_000, 8 << 20, 8 << 20, 4 << 20
#: Rounds end when more than this share of the members of split families is left after one.
LEAST_PROGRESS = 0.8
#: Bands of sizes, each as wide as linked sizes may lie apart, are cut into so many steps where reaches are compared.
STEPS = 6
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
PARTS = "chunk long, part int, tokens binary, owners binary, classes binary, unnamed binary"


class Words(dict):
    """64-bit hashes of words, looked up once each."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= LONGEST_KEPT:
            self[word] = h
        return h


def shingle_sets(raws: list[bytes], width: int) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    words = resident("words", Words)
    if len(words) > KEPT:
        words.clear()
    cut = [raw.lower().split() for raw in raws]
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    ends = np.cumsum(sizes)
    h = np.fromiter(map(words.__getitem__, itertools.chain.from_iterable(cut)), np.uint64, int(ends[-1]) if len(cut) else 0)
    if len(h) >= width:
        with np.errstate(over="ignore"):
            sums = np.zeros(len(h) - width + 1, np.uint64)
            for j in range(width):
                sums = sums * MULTIPLIER + h[j : len(h) - width + 1 + j]
            sums = mix64(sums)
    out = []
    for n, end in zip(sizes.tolist(), ends.tolist(), strict=True):
        if n >= width:
            found = np.sort(sums[end - n : end - width + 1])
            out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        elif n:
            out.append(np.array([xxhash.xxh64_intdigest(h[end - n : end].tobytes())], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def class_of(tokens: np.ndarray) -> int:
    """A signed 64-bit name of the set; classes also carry the set's size."""
    return xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63)


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a set of n shares with a linked one, at least."""
    return -(-percent * n // 100)


def reach(percent: int) -> Column:
    """The size of the largest set that a set of ``n_shingles`` tokens can link with, if the first token that both hold is the one at
    ``place`` (from 0, rarest first) here: that many tokens from it on are the most that they share."""
    return F.expr(f"(({100 + percent} * (n_shingles - place)) div {percent}) - n_shingles")


def ranges_of(tokens: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash range of each token, and 40 bits that tell it from others there."""
    k = np.uint64(ranges)
    high, low = tokens >> np.uint64(32), tokens & np.uint64(0xFFFFFFFF)
    with np.errstate(over="ignore"):
        return ((high * k + (low * k >> np.uint64(32))) >> np.uint64(32)).astype(np.int64), (tokens * k) >> np.uint64(24)


def packed40(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpacked40(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


def chunks(documents: DataFrame, width: int, ranges: int) -> DataFrame:
    """Chunks of documents, one row for each hash range with the tokens and their owners, and a head (part -1) with the documents' ids, sizes and classes."""

    def flush(ids: list, sets: list[np.ndarray]) -> Iterator[tuple]:
        classes = np.fromiter(map(class_of, sets), np.int64, len(sets))
        able = np.array([i for i, x in enumerate(ids) if x is not None and len(sets[i])], np.int64)
        first = np.sort(able[np.unique(classes[able], return_index=True)[1]]).tolist()  # copies within a chunk count once
        tokens = np.concatenate([np.empty(0, np.uint64), *[sets[i] for i in first]])
        owner = np.repeat(np.array(first, np.int64), np.array([len(sets[i]) for i in first], np.int64))
        # The name holds a digest of the content, so answers to a chunk that was made otherwise are never taken for this one's.
        chunk = xxhash.xxh64_intdigest(tokens.tobytes() + classes.tobytes(), TaskContext.get().partitionId()) - (1 << 63)
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        unnamed = np.array([x is None for x in ids], np.uint8)
        yield chunk, -1, np.array([x or 0 for x in ids], "<i8").tobytes(), sizes.tobytes(), classes.tobytes(), unnamed.tobytes()
        at, short = ranges_of(tokens, ranges)
        order = np.argsort(at, kind="stable")  # owners stay in order within a range
        short, owner = short[order], owner[order]
        parts, begins = np.unique(at[order], return_index=True)
        for p, i, j in zip(parts.tolist(), begins.tolist(), [*begins[1:].tolist(), len(at)], strict=bool(len(at))):
            yield chunk, p, packed40(short[i:j]), np.diff(owner[i:j], prepend=0).astype("<u2").tobytes(), None, None

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        sets: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            columns = zip(*flush(ids, sets), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["chunk", "part", "tokens", "owners", "classes", "unnamed"])

        for names, raws in slices(rows):
            found = shingle_sets(raws, width)
            for x, tokens in zip(names, found, strict=True):
                ids.append(x)
                sets.append(tokens)
                held += len(tokens)
                if held >= CHUNK or len(ids) >= CHUNK_DOCUMENTS:
                    yield out()
                    ids, sets, held = [], [], 0
        if ids:
            yield out()
        ids, sets = [], []
        trim()

    return documents.mapInArrow(batches, PARTS)


def code_of(n: np.ndarray) -> np.ndarray:
    """A frequency in one byte, exact up to 64, in eighths of a doubling above."""
    return np.where(n <= 64, n, np.minimum(64 + 8 * np.log2(np.maximum(n, 64) / 64), 255)).astype(np.uint8)


def count_range(key: tuple, table: pa.Table) -> pa.Table:
    """How many chunks' first holders have each token: a byte a token, in the order they came. Heads pass."""
    if key[0].as_py() < 0:
        return table.drop_columns(["deal"])
    raw = table.column("tokens").to_pylist()
    tokens = np.concatenate([unpacked40(x) for x in raw])
    _, place, n = np.unique(tokens, return_inverse=True, return_counts=True)
    codes = code_of(n)[place]
    cut = np.cumsum([0, *[len(x) // 5 for x in raw]])
    answers = pa.array([codes[i:j].tobytes() for i, j in itertools.pairwise(cut)], pa.binary())
    return table.set_column(table.column_names.index("tokens"), "tokens", answers).drop_columns(["deal"])


def frequencies(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, class_id, and for documents that may link the frequency codes of their tokens, ascending by token."""
    n_bytes = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, 3 * n_bytes // RANGE_BYTES)  # five bytes for each token, and a token for two bytes of text at most
    # Heads need no counting: they go where their chunk's name sends them.
    sent = chunks(documents, width, ranges).withColumn("deal", F.when(F.col("part") < 0, -1 - F.pmod("chunk", F.lit(ranges))).otherwise(F.col("part")).cast("long"))
    answers = saved(sent.groupBy("deal").applyInArrow(count_range, PARTS), "counted")

    def gather(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        head, rest = rows[0], rows[1:]
        ids, sizes, classes = (np.frombuffer(head[c], "<i8") for c in ("tokens", "owners", "classes"))
        unnamed = np.frombuffer(head["unnamed"], np.uint8).astype(bool)
        codes = np.concatenate([np.empty(0, np.uint8), *[np.frombuffer(r["tokens"], np.uint8) for r in rest]])
        owner = np.concatenate([np.empty(0, np.int64), *[np.cumsum(np.frombuffer(r["owners"], "<u2"), dtype=np.int64) for r in rest]])
        answered = np.bincount(owner, minlength=len(ids))
        elsewhere = np.bincount(owner[codes > 1], minlength=len(ids))
        codes = codes[np.argsort(owner, kind="stable")]
        ends = np.cumsum(answered)
        asked = answered > 0
        if head["part"] != -1 or (answered[asked] != sizes[asked]).any():
            raise RuntimeError("a chunk and the answers to it differ")
        may = asked & (100 * elsewhere >= percent * sizes)
        df = [codes[e - n : e].tobytes() if m else None for e, n, m in zip(ends.tolist(), sizes.tolist(), may.tolist(), strict=True)]
        columns = [pa.array(ids, pa.int64(), mask=unnamed), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(df, pa.binary())]
        return pa.table(columns, names=["doc_id", "n_shingles", "class_id", "codes"])

    return answers.groupBy("chunk").applyInArrow(gather, "doc_id long, n_shingles long, class_id long, codes binary")


def incidence(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(columns)), np.float32)
    for row, tokens in enumerate(sets):
        near = tokens[np.searchsorted(tokens, columns[0]) : np.searchsorted(tokens, columns[-1], side="right")]
        at = np.searchsorted(columns, near)
        out[row, at[columns[at] == near]] = 1
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """The pairs of one set of each side that link; a side compared with itself pairs sets with themselves too."""
    both = np.zeros((len(left), len(right)), np.int64)
    one, n = np.unique(np.concatenate(left), return_counts=True)
    universe = one[n > 1] if left is right else np.intersect1d(one, np.concatenate(right))
    for i in range(0, len(universe), COLUMNS):
        columns = universe[i : i + COLUMNS]
        both += np.rint(incidence(left, columns) @ incidence(right, columns).T).astype(np.int64)
    a, b = (np.array([len(s) for s in side]) for side in (left, right))
    # Tokens that one set alone holds are left out; on the diagonal that understates, which nobody reads.
    return [(int(i), int(j)) for i, j in np.argwhere(100 * both >= percent * (a[:, None] + b[None, :] - both))]


def links_between(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between two groups' members; members that cannot reach the threshold with the other group's union stay closed."""

    def opened(one: list[np.ndarray], other: list[np.ndarray]) -> list[int]:
        union = np.unique(np.concatenate(other))
        return [i for i, tokens in enumerate(one) if 100 * int(np.isin(tokens, union, assume_unique=True).sum()) >= percent * len(tokens)]

    a, b = opened(left, right), opened(right, left)
    if not a or not b:
        return []
    return [(a[i], b[j]) for i, j in linked([left[i] for i in a], [right[j] for j in b], percent)]


def forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(member, smallest member of its component) of all members that are not the smallest."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in pairs:
        i, j = find(x), find(y)
        if i != j:
            root[max(i, j)] = min(i, j)
    return [(x, find(x)) for x in root if find(x) != x]


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of all linked nodes; a component is named by its smallest node. Alternates large and small stars until the
    links no longer change. Only nodes that move their neighbours are joined, salted, so a star's centre is no hot key."""
    edges = saved(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        # Large star: larger neighbours of a node go to its smallest neighbour, where that is smaller than the node.
        least = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("least"))
        large = salted_join(edges, least, "v", "u", "left").select("u", F.coalesce("least", "v").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        small = large.groupBy("u").agg(F.min("v").alias("least"), F.max("v").alias("most"))
        moved = salted_join(large, small.filter("least < most").select("u", "least"), "u", "v", "inner").filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        edges = saved(small.select("u", F.col("least").alias("v")).unionByName(moved).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("links did not contract")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def arrays(tokens: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(t, "<u8") for t in tokens]


def compare_rounds(members: DataFrame, families: DataFrame, percent: int) -> DataFrame:
    """Links found inside groups, round by round."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        names, sets = rows["class_id"].tolist(), arrays(rows["tokens"])
        leads = dict(forest([(names[i], names[j]) for i, j in linked(sets, sets, percent) if names[i] < names[j]]))
        return pd.DataFrame({"family": rows["family"], "x": names, "y": [leads.get(x, x) for x in names], "whole": rows["whole"]})

    found, left, n = None, families, None
    for turn in itertools.count():
        sizes = left.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("tokens"))
        sizes = sizes.filter("n > 1").select("family", F.greatest(F.ceil(F.col("n") / GROUP_MEMBERS), F.ceil(8 * F.col("tokens") / GROUP_BYTES)).alias("split"))
        dealt = salted_join(left, sizes, "family", "class_id", "inner")
        dealt = dealt.select("class_id", "family", (F.col("split") == 1).alias("whole"), F.xxhash64("family", F.pmod(F.xxhash64("class_id", F.lit(turn)), "split")).alias("group"))
        done = saved(members.select("class_id", "tokens").join(dealt, "class_id").groupBy("group").applyInPandas(compare, "family long, x long, y long, whole boolean"), "round")
        links = done.filter("x <> y").select("x", "y")
        found = links if found is None else found.unionByName(links)
        # One member of each component goes on, where the family did not fit one group.
        rest = done.filter("not whole").agg(F.count(F.lit(1)), F.count_if(F.col("x") == F.col("y"))).first()
        if not rest[0] or rest[1] > LEAST_PROGRESS * rest[0]:
            return found
        left = done.filter("not whole and x = y").select(F.col("x").alias("class_id"), "family").join(members.select("class_id", "n_shingles"), "class_id")


def compare_pairs(members: DataFrame, shared: DataFrame, families: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """Links between candidates that ``joined`` leaves in different components, by the token-group matrix."""
    placed = shared.join(joined, F.col("class_id") == F.col("node"), "left").select("token", "class_id", "n_shingles", "reach", "n", F.coalesce("component", "class_id").alias("component"))
    open_ = placed.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b").select("token")
    live = saved(salted_join(placed, open_, "token", "class_id", "inner"), "live")
    # Linked sizes lie in one band or in neighbouring ones; a class's rarest shared token, its anchor, brings it beside similar ones.
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(100 / percent)).cast("int")
    each = live.groupBy("class_id", "component", "n_shingles", band.alias("band")).agg(F.min(F.struct("n", "token"))["token"].alias("anchor"))
    each = saved(each.join(families.select("class_id", "family"), "class_id"), "each")
    # Large components have groups of their own, which need not meet each other; what is left of a family is grouped by anchors.
    large = each.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= GROUP_MEMBERS).select("component", F.lit(True).alias("own"))
    each = salted_join(each, large, "component", "class_id", "left")
    spread = each.filter("own is null").groupBy("family", "band").agg(F.ceil(F.count(F.lit(1)) / GROUP_MEMBERS).alias("wide"))
    each = each.join(spread, ["family", "band"], "left")
    kin = F.when(F.col("own"), F.xxhash64("component", "band")).otherwise(F.xxhash64("family", "band", F.pmod(F.xxhash64("anchor"), "wide")))
    each = each.withColumn("kin", kin)
    sizes = each.groupBy("kin").agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_MEMBERS), F.ceil(8 * F.sum("n_shingles") / GROUP_BYTES)).alias("split"))
    groups = salted_join(each, sizes, "kin", "class_id", "inner").select("class_id", "component", "band", F.xxhash64("kin", F.pmod(F.xxhash64("class_id"), "split")).alias("group"))
    groups = saved(groups, "groups")
    whole = groups.groupBy("group", "band").agg(F.min("component").alias("a"), F.max("component").alias("b")).select("group", "band", F.when(F.col("a") == F.col("b"), F.col("a")).alias("only"))
    step = F.floor(STEPS * F.log(F.col("n_shingles").cast("double")) / math.log(100 / percent))
    met = live.select("token", "class_id", "n_shingles", "reach", step.alias("step")).join(groups.select("class_id", "group"), "class_id")
    met = met.groupBy("token", "group", "step").agg(F.min("n_shingles").alias("size"), F.max("reach").alias("reach")).drop("step")
    met = saved(met.join(whole, "group"), "met")
    a, b = met.alias("a"), met.alias("b")
    apart = F.col("a.only").isNull() | F.col("b.only").isNull() | (F.col("a.only") != F.col("b.only"))
    near = (F.abs(F.col("a.band") - F.col("b.band")) <= 1) & (F.col("a.size") <= F.col("b.reach")) & (F.col("b.size") <= F.col("a.reach"))
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.group") < F.col("b.group")) & apart & near)
    pairs = pairs.select(F.col("a.group").alias("one"), F.col("b.group").alias("two")).distinct()
    pairs = saved(pairs.unionByName(whole.filter("only is null").select(F.col("group").alias("one"), F.col("group").alias("two"))), "pairs")
    held = saved(members.join(groups, "class_id").select("group", "class_id", "tokens"), "held")
    # Pairs are compared some at a time, as many as make about SLOT_BYTES of tokens.
    weights = held.groupBy("group").agg(F.sum(F.octet_length("tokens")).alias("w"))
    one, two = (weights.select(F.col("group").alias(side), F.col("w").alias(f"w_{side}")) for side in ("one", "two"))
    weight = pairs.join(one, "one").join(two, "two").agg(F.sum(F.col("w_one") + F.col("w_two"))).first()[0] or 0
    slots = max(1, weight // SLOT_BYTES)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        rights = right.groupby(["one", "two"]).indices
        for key, at in left.groupby(["one", "two"]).indices.items():
            a, b = left.iloc[at].sort_values("class_id"), right.iloc[rights[key]].sort_values("class_id")
            x, y = a["class_id"].tolist(), b["class_id"].tolist()
            sets, others = arrays(a["tokens"]), arrays(b["tokens"])
            found = linked(sets, sets, percent) if key[0] == key[1] else links_between(sets, others, percent)
            out += forest([(x[i], y[j]) for i, j in found if x[i] != y[j]])
        return pd.DataFrame(out, columns=["x", "y"], dtype="int64")

    columns = ["slot", "one", "two", "class_id", "tokens"]
    dealt = pairs.withColumn("slot", F.pmod(F.xxhash64("one", "two"), F.lit(slots)))
    sides = [dealt.join(held, F.col(side) == F.col("group")).select(columns).toDF(*columns) for side in ("one", "two")]
    return saved(sides[0].groupBy("slot").cogroup(sides[1].groupBy("slot")).applyInPandas(compare, "x long, y long"), "crossing")


def join(documents: DataFrame, width: int = 3, percent: int = 90, small_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of each document."""
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    sets = saved(frequencies(docs, width, percent), "sets")

    # One document of each class that may link; its tokens are made again from its text rather than kept for all documents.
    may = sets.filter("codes is not null")
    chosen = may.groupBy("class_id", "n_shingles").agg(F.min("doc_id").alias("doc_id"))
    wanted = saved(may.join(chosen, ["class_id", "n_shingles", "doc_id"]).dropDuplicates(["class_id", "doc_id"]), "wanted")
    wanted = F.broadcast(wanted) if (wanted.agg(F.sum(F.octet_length("codes") + 24)).first()[0] or 0) <= small_bytes else wanted

    def again(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, raws, codes in slices(rows):
            out = []
            for name, tokens, code in zip(names, shingle_sets(raws, width), codes, strict=True):
                if class_of(tokens) == name:  # another row of this id may have another text
                    frequency = np.frombuffer(code, np.uint8)
                    first = np.lexsort((tokens, frequency))[: len(tokens) - int(least_overlap(len(tokens), percent)) + 1]
                    places = np.flatnonzero(frequency[first] > 1)
                    out.append((name, len(tokens), tokens.tobytes(), tokens[first[places]].view(np.int64).tolist(), places.tolist()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["class_id", "n_shingles", "tokens", "prefix", "places"])
        trim()

    texts = docs.join(wanted, "doc_id").select("class_id", "text", "codes")
    members = texts.mapInArrow(again, "class_id long, n_shingles long, tokens binary, prefix array<long>, places array<int>")
    members = saved(members.dropDuplicates(["class_id"]), "members")  # repeated rows of one id

    held = members.select(F.explode(F.arrays_zip("prefix", "places")).alias("at"), "class_id", "n_shingles")
    held = held.select(F.col("at.prefix").alias("token"), "class_id", "n_shingles", F.col("at.places").alias("place")).select("token", "class_id", "n_shingles", reach(percent).alias("reach"))
    several = held.groupBy("token").agg(F.min("class_id").alias("least"), F.count(F.lit(1)).alias("n"), F.min("n_shingles").alias("low"), F.max("reach").alias("far")).filter("n > 1 and far >= low")
    shared = salted_join(held, several, "token", "class_id", "inner").filter("reach >= low and n_shingles <= far")
    shared = saved(shared.select("token", "class_id", "n_shingles", "reach", "least", "n"), "shared")
    families = components(shared.select(F.col("class_id").alias("x"), F.col("least").alias("y")).filter("x <> y").distinct())
    first = members.select("class_id", "n_shingles").join(families.unionByName(families.select(F.col("component").alias("node"), "component")).distinct(), F.col("class_id") == F.col("node"))
    families = saved(first.select("class_id", "n_shingles", F.col("component").alias("family")), "families")
    links = compare_rounds(members, families, percent)
    joined = components(links)
    crossing = compare_pairs(members, shared.drop("least"), families, joined, percent)
    if not crossing.isEmpty():
        joined = components(links.unionByName(crossing))

    # Classes of one document that link with nothing keep their own id and need no join; the others are salted against hot classes.
    of_class = sets.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("class_id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    placed = of_class.join(joined, F.col("class_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "class_id"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.sum("n").alias("all")).filter(F.col("all") > 1)
    of_each = placed.join(least, "component").select("class_id", "component_id")
    out = salted_join(sets.drop("codes"), of_each, "class_id", "doc_id", "left")
    named = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component_id"))
    return out.select("doc_id", "n_shingles", F.coalesce(named, "doc_id").alias("component_id"))
