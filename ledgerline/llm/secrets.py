"""Secret scans, in SQL functions only: fixed kinds by pattern, and strings of high sliding-window entropy.

Kinds found by pattern, leftmost and without overlap for each: assign (a keyword, an assignment mark and a value of 6 or more
characters), access (AKIA and capitals or digits, 20 or more), hex (24 or more hex digits). The method's own kind, entropy:
candidate strings of each character class are scanned with a window whose character counts are updated as it slides; a
candidate is kept when some window's Shannon entropy reaches its class's threshold, unless it is on the allow list or overlaps
a span found by pattern. Spans are code points, end exclusive.

Nulls count as empty texts, which have no spans. Long texts are scanned whole; repeated rows give equal rows; an empty table
gives an empty result; extra columns are ignored unless ``keep`` names them.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns, in the order in which kinds are listed.
KINDS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
LEAST_VALUE = 6
#: One of these is in every text, in lower case, that has an assignment.
KEYWORDS = ["passw", "secret", "token", "api"]
ORDER = [*KINDS, "entropy"]
#: Candidates of the method, by character class: pattern, window, least entropy in bits. One may follow '=', as in NAME=value.
CLASSES = {
    "hexadecimal": (r"(?<![A-Za-z0-9+/_-])[0-9A-Fa-f]{20,}(?![A-Za-z0-9+/_=-])", 20, 3.0),
    "upper": (r"(?<![A-Za-z0-9+/_-])[A-Z0-9]{20,}(?![A-Za-z0-9+/_=-])", 20, 3.4),
    "lower": (r"(?<![A-Za-z0-9+/_-])[a-z0-9]{20,}(?![A-Za-z0-9+/_=-])", 20, 3.4),
    "base64": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", 20, 3.7),
}
#: A candidate that matches is no secret: no digit or one case only without digits, identifiers and paths of words, examples, runs.
ALLOWED = "|".join(
    [
        r"^[A-Za-z/_=+-]*$",
        r"^[0-9/_=+-]*$",
        r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
        r"(?i:example|sample|dummy|placeholder|changeme|your[_-]?key|redacted)",
        r"(?i:abcdefgh|12345678|01234567|qwerty|deadbeef)",
        r"(.)\1{5}",
        r"^(?:[a-z]+[/_-])+[a-z]*[0-9]{0,4}$",
    ]
)
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
WORDED = "array<struct<start:bigint,kind:int,end:bigint,word:string>>"
#: Elements that are gone through at a time: lists grow by copying, so they are made in blocks and joined.
BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_blocks(items: Column) -> Column:
    """An array of structs ``part`` of at most BLOCK items each."""
    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / BLOCK) - 1, F.lit(0)).cast("int"))
    return F.transform(blocks, lambda b: F.struct(F.slice(items, b * BLOCK + 1, F.lit(BLOCK)).alias("part")))


def spans(text: Column, pattern: str, kind: int, value_group: int = 0, least: int = 0, gate: Column | None = None) -> Column:
    """Where the pattern matches, and the words: the pieces between matches and the matches, in turn, give the positions by adding lengths."""
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("value")
    )
    length = lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["gap"])
        end = acc["at"] + length(p)
        one = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), p["hit"].alias("word")))
        return F.struct(end.alias("at"), F.when(p["hit"].isNotNull() & (F.length(p["value"]) >= least), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def of_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b["part"], F.lit(0).cast("bigint"), lambda n, p: n + length(p)))

        def with_sums(sums: Column) -> Column:
            def of_block(b: Column, i: Column) -> Column:
                before = F.aggregate(F.slice(sums, F.lit(1), i), F.lit(0).cast("bigint"), lambda n, x: n + x)
                return F.aggregate(b["part"], F.struct(before.alias("at"), F.array().cast(WORDED).alias("out")), step, lambda acc: acc["out"])

            return F.flatten(F.transform(blocks, of_block))

        return let(sums, with_sums)

    found = let(pieces, lambda ps: let(in_blocks(ps), of_blocks))
    there = text.rlike(pattern)
    return F.when(there if gate is None else F.when(gate, there), found).otherwise(F.array().cast(WORDED))


def wordless(found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def peak_entropy(candidate: Column, window: int) -> Column:
    """The highest Shannon entropy, in bits, of any window of the candidate. The state is the window's count of each character
    code and the sum of c * log2(c) over them; a step adds the entering character and takes the leaving one off."""
    slots, first = 80, 43  # '+' to 'z'

    def gain(c: Column) -> Column:
        return F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))

    codes = F.transform(F.split(candidate, ""), lambda x: F.ascii(x) - first)
    letters = F.arrays_zip(codes.alias("enters"), F.concat(F.array_repeat(F.lit(-1), window), codes).alias("leaves"))
    # The second array is longer by one window; its tail has no entering character.
    pairs = F.filter(letters, lambda p: p["enters"].isNotNull() & (p["enters"] >= 0))
    begin = F.struct(F.array_repeat(F.lit(0), slots).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0.0).alias("best"))

    def step(acc: Column, p: Column) -> Column:
        full = p["leaves"] >= 0
        c_in = F.get(acc["counts"], p["enters"])
        c_out = F.get(acc["counts"], p["leaves"])
        # A character that enters while an equal one leaves changes nothing.
        change = F.when(p["enters"] == p["leaves"], F.lit(0.0)).otherwise(
            gain(c_in + 1) - gain(c_in) + F.when(full, gain(c_out - 1) - gain(c_out)).otherwise(F.lit(0.0))
        )
        total, n = acc["sum"] + change, F.least(acc["n"] + 1, F.lit(window))
        counts = F.transform(acc["counts"], lambda c, j: c + F.when(j == p["enters"], 1).otherwise(0) - F.when(j == p["leaves"], 1).otherwise(0))
        best = F.when(n == window, F.greatest(acc["best"], F.log2(F.lit(float(window))) - total / window)).otherwise(acc["best"])
        return F.struct(counts.alias("counts"), total.alias("sum"), n.alias("n"), best.alias("best"))

    return F.aggregate(pairs, begin, step, lambda acc: acc["best"])


def is_secret(window: int, least: float) -> Callable[[Column], Column]:
    def test(s: Column) -> Column:
        allowed = s["word"].rlike(ALLOWED)
        return ~allowed & (peak_entropy(F.when(~allowed, s["word"]).otherwise(F.lit("")), window) >= least)

    return test


def entropy_spans(text: Column, base: Column) -> Column:
    """Candidates of high entropy that are neither allowed nor overlap a base span. ``base`` is in order of start, so its blocks lie one after the other."""
    reach = F.transform(in_blocks(base), lambda b: F.struct(b["part"].alias("part"), F.array_min(F.transform(b["part"], lambda s: s["start"])).alias("low"), F.array_max(F.transform(b["part"], lambda s: s["end"])).alias("high")))
    over = lambda s, low, high: (low < s["end"]) & (s["start"] < high)
    taken = lambda s, blocks: F.exists(blocks, lambda b: over(s, b["low"], b["high"]) & F.exists(b["part"], lambda t: over(s, t["start"], t["end"])))

    def beside_base(found: Column) -> Column:
        return let(reach, lambda blocks: F.filter(found, lambda s: ~taken(s, blocks)))

    out = []
    for pattern, window, least in CLASSES.values():
        free = beside_base(spans(text, pattern, ORDER.index("entropy")))
        out.append(F.when(text.rlike(pattern), wordless(F.filter(free, is_secret(window, least)))).otherwise(F.array().cast(SPAN)))
    return F.array_distinct(F.concat(*out))


def with_spans(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` as a struct ``row``, the text as ``_text`` (null as empty), and the spans, in order of start, kind, end: base_spans by pattern, all_spans with the method's."""
    rows = documents.select(F.struct(*keep).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    low = F.lower("_text")
    gate = functools.reduce(operator.or_, [F.contains(low, F.lit(w)) for w in KEYWORDS])
    found = [spans(F.col("_text"), p, i, 2, LEAST_VALUE, gate) if k == "assign" else spans(F.col("_text"), p, i) for i, (k, p) in enumerate(KINDS.items())]
    rows = rows.withColumn("base_spans", F.array_sort(wordless(F.concat(*found))))
    return rows.withColumn("all_spans", F.array_sort(F.concat("base_spans", entropy_spans(F.col("_text"), F.col("base_spans")))))


def listed(column: str) -> Column:
    names = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy for each document."""
    rows = with_spans(documents, ["doc_id"])

    def n(kind: str) -> Column:
        return F.size(F.filter("all_spans", lambda s: s["kind"] == ORDER.index(kind))).cast("long").alias(f"n_{kind}")

    return rows.select("row.doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed("base_spans").cast("binary"), 256).alias("base_sha256"), listed("all_spans").alias("spans"), n("entropy"))


def redact(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mark``; overlapping spans are replaced together. Other columns stay; n_chars, if there, is counted again."""
    kept = documents.columns
    rows = with_spans(documents, kept)
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring("_text", (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("all_spans", begin, step, lambda acc: F.concat(acc["out"], F.substring(F.col("_text"), (acc["at"] + 1).cast("int"), F.length("_text"))))
    whole = F.col("row.text").isNull() | (F.size("all_spans") == 0)
    text = F.when(whole, F.col("row.text")).otherwise(clean)
    again = {"text": text}
    if "n_chars" in kept:
        again["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(F.length(clean).cast(documents.schema["n_chars"].dataType))
    return rows.select(*[again.get(c, F.col("row")[c]).alias(c) for c in kept])
