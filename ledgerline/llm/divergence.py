"""How far the sources of a language are from each other, and by which terms, in exact integers.

Gustavson's row accumulation: the counts become a term-major index (each kept term with its sources), and every source, as a row,
scatters the index entries of its own terms into a dense accumulator with one cell for each peer. No pair of postings is ever
emitted: a task gives back accumulators only, and Spark sums these. A term that one or both sources lack has a count of zero there,
which smoothing turns into a baseline p0 that isn't zero. So the accumulators hold only what a shared term adds to the baselines, and

    value(g, h) = V f(p0g, p0h) + sum over g's terms of (f(p, p0h) - f(p0g, p0h)) + the same of h's terms + accumulator(g, h)

where the two middle sums need no terms, only how many terms of a source have each p.

Terms are runs of letters A-Z in either case (made lower-case) and of characters beyond ASCII. A language keeps the terms of at
least ``least_docs`` of its documents. With count occurrences of a kept term in a group and N of all kept terms there,
p = 1 + floor(scale (count + 2) / (N + 2 V)); f = floor((p - q)^2 / (p + q)).

Null text, lang and source count as empty ones. Empty texts have no terms but make their group known; a language without kept terms
gives its pairs a value of 0. Long texts are counted whole; repeated rows count each; ties go to the smaller item by its bytes. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, slices, text_bytes

#: Bytes that stand in terms: letters, in lower case, and all of characters beyond ASCII; others part them.
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Counters that a task holds before it passes them on, and bytes of text that it reads meanwhile.
ENTRIES_HELD, TEXT_HELD = 200_000, 64 << 20
#: Cells of dense accumulators that a task holds, and index entries scattered at a time.
CELLS_HELD, SCATTERED = 4_000_000, 1_000_000
#: Groups up to which the table of groups is broadcast; beyond it the join shuffles.
SMALL_GROUPS = 200_000
COUNTS = "lang string, source string, term string, n long, docs long"
SUMS = "lang string, g int, h int, value long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (lang, text, source) batches: occurrences and documents of each term in each group, added up inside the task. The empty term stands for the group itself."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    read = 0

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for i in range(0, len(terms), 20_000):
                part = terms[i : i + 20_000]
                columns = [[lang] * len(part), [source] * len(part), [t.decode("utf-8", "replace") for t in part], [n[t] for t in part], [docs[t] for t in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.int64()] * 2, strict=True)], [x.split()[0] for x in COUNTS.split(", ")])
        held.clear()

    for langs, texts, sources in slices(rows):
        for lang, text, source in zip(langs, texts, sources, strict=True):
            n, docs = held.setdefault((lang, source), (Counter({b"": 0}), Counter()))
            terms = terms_of(text)
            n.update(terms)
            docs.update(set(terms))
            read += len(text)
        if read > TEXT_HELD or sum(len(n) for n, _ in held.values()) > ENTRIES_HELD:
            yield from passed_on()
            read = 0
    yield from passed_on()


def share(count: str, n: str, v: str, scale: int) -> Column:
    """p of a count: exact beyond 64 bits on the way."""
    return F.expr(f"1 + (CAST({scale} AS DECIMAL(12, 0)) * CAST({count} + 2 AS DECIMAL(20, 0))) div ({n} + 2 * {v})")


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def scatter(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of terms (lang, peers, posts of (g, p, p0)): for each group the sums of what shared terms add to the baselines, by peer."""
    held: dict[tuple[str, int, int], np.ndarray] = {}
    schema = pa.schema([("lang", pa.string()), ("g", pa.int32()), ("h", pa.int32()), ("value", pa.int64())])

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, first, _), cells in held.items():
            g, h = np.nonzero(cells)
            for i in range(0, len(g), 100_000):
                a, b = g[i : i + 100_000], h[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a)), pa.array(a + first, pa.int32()), pa.array(b, pa.int32()), pa.array(cells[a, b])], schema=schema)
        held.clear()

    for batch in rows:
        langs, peers, posts = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2)
        first = posts.offsets.to_numpy()
        entry = posts.values.flatten()
        g, p, p0 = (e.to_numpy().astype(np.int64) for e in entry)
        for lang in dict.fromkeys(langs):
            terms = np.array([i for i, x in enumerate(langs) if x == lang])
            size, n = int(peers[terms[0]]), np.diff(first)[terms]
            # The language's part of the index, term by term: where a term's postings begin, and each posting's term.
            at = np.repeat(first[terms] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            ends = np.cumsum(n)
            begins, term = ends - n, np.repeat(np.arange(len(terms)), n)
            lg, lp, lp0 = g[at], p[at], p0[at]
            order = np.argsort(lg, kind="stable")
            wide = max(1, CELLS_HELD // max(1, size))
            for row in np.split(order, np.flatnonzero(np.diff(lg[order])) + 1):
                block = int(lg[row[0]]) // wide * wide
                tall = min(wide, size - block)
                key = (lang, block, size)
                if key not in held and sum(c.size for c in held.values()) + tall * size > CELLS_HELD:
                    yield from passed_on()
                cells = held.setdefault(key, np.zeros((tall, size), dtype=np.int64))[lg[row[0]] - block]
                # The row's entries in slices of bounded expansion; a single term's postings are never cut.
                opened = np.cumsum(n[term[row]])
                cuts = np.searchsorted(opened, np.arange(SCATTERED, opened[-1], SCATTERED), side="right")
                for part in np.split(row, np.unique(cuts)):
                    if not len(part):
                        continue
                    m = n[term[part]]
                    to = np.repeat(begins[term[part]] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
                    mine, mine0 = np.repeat(lp[part], m), np.repeat(lp0[part], m)
                    theirs, theirs0 = lp[to], lp0[to]
                    more = distance(mine, theirs) - distance(mine, theirs0) - distance(mine0, theirs) + distance(mine0, theirs0)
                    np.add.at(cells, lg[to], more)
    yield from passed_on()


def baselines(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of groups (lang, g, v, p0, seen of (p, how many terms), zeros: each peer's p0): both baseline sums, for every peer."""
    for batch in rows:
        for r in batch.to_pylist():
            zeros = np.array(r["zeros"], dtype=np.int64)
            p = np.array([x["p"] for x in r["seen"] or []], dtype=np.int64)
            n = np.array([x["n"] for x in r["seen"] or []], dtype=np.int64)
            none = distance(np.int64(r["p0"]), zeros) if r["v"] else np.zeros_like(zeros)
            own = np.zeros_like(zeros)
            step = max(1, SCATTERED // max(1, len(zeros)))
            for i in range(0, len(p), step):
                own += (n[i : i + step, None] * (distance(p[i : i + step, None], zeros[None, :]) - none[None, :])).sum(axis=0)
            others = np.flatnonzero(np.arange(len(zeros)) != r["g"])
            for i in range(0, len(others), 50_000):
                h = others[i : i + 50_000]
                mine = np.full(len(h), r["g"])
                g2, h2 = np.concatenate([mine, h]), np.concatenate([h, mine])
                value = np.concatenate([r["v"] * none[h] + own[h], own[h]])
                yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(g2)), pa.array(g2, pa.int32()), pa.array(h2, pa.int32()), pa.array(value)], ["lang", "g", "h", "value"])


def audit(documents: DataFrame, least_docs: int = 10, top: int = 10, scale: int = 1_000_000_000) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows rank all other sources of the language by their distance, ``term`` rows the ``top`` terms that a group has more of than its language."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = documents.select(blank("lang").alias("lang"), text_bytes().alias("text"), blank("source").alias("source"))
    # One shuffle, by language and term: a term's groups and its documents are added up where it lands.
    dealt = rows.mapInArrow(counted, COUNTS).repartition("lang", "term")
    by_group = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_group.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("posts"))
    index = saved(by_term.filter((F.col("docs") >= least_docs) | (F.col("term") == "")), "index")

    # The groups, numbered within their language, with N and V.
    posts = index.select("lang", "term", "all", F.inline("posts"))
    groups = posts.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    langs = index.groupBy("lang").agg(F.sum("all").alias("n_lang"), F.count_if(F.col("term") != "").alias("v"))
    by_lang = Window.partitionBy("lang")
    groups = groups.join(langs, "lang").select(
        "lang", "source", "n_group", "n_lang", "v", (F.row_number().over(by_lang.orderBy("source")) - 1).alias("g"), F.count(F.lit(1)).over(by_lang).cast("int").alias("peers"),
        F.when(F.col("v") > 0, share("0", "n_group", "v", scale)).otherwise(F.lit(0).cast("long")).alias("p0"),
    )
    groups = saved(groups, "groups")
    small = groups.count() <= SMALL_GROUPS
    held = lambda df: F.broadcast(df) if small else df

    entries = posts.filter("term <> ''").join(held(groups), ["lang", "source"])
    entries = entries.select("lang", "source", "term", "g", "peers", "p0", share("n", "n_group", "v", scale).alias("p"), share("all", "n_lang", "v", scale).alias("q"))
    entries = saved(entries, "entries")

    # Pairs: accumulators of shared terms and both baselines, added up.
    by_terms = entries.groupBy("lang", "term", "peers").agg(F.collect_list(F.struct("g", "p", "p0")).alias("posts")).select("lang", "peers", "posts")
    seen = entries.groupBy("lang", "g", "p").agg(F.count(F.lit(1)).alias("n")).groupBy("lang", "g").agg(F.collect_list(F.struct("p", "n")).alias("seen"))
    zeros = groups.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "p0"))), lambda x: x["p0"]).alias("zeros"))
    ready = groups.select("lang", "g", "v", "p0").join(seen, ["lang", "g"], "left").join(zeros, "lang").select("lang", "g", "v", "p0", "seen", "zeros")
    sums = by_terms.mapInArrow(scatter, SUMS).filter("g <> h").unionByName(ready.mapInArrow(baselines, SUMS))
    values = sums.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    named = groups.select("lang", "g", "source")
    values = values.join(held(named), ["lang", "g"]).join(held(named.select("lang", F.col("g").alias("h"), F.col("source").alias("item"))), ["lang", "h"])
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    shape = ["lang", "source", "part", "item", "value", "rank"]
    pairs = values.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(best)).select(shape)

    # Terms: the limit is kept in every map task first, so that a group with many terms shuffles few.
    more = entries.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    return pairs.unionByName(more.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select(shape))
