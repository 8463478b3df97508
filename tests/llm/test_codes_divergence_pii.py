"""Vector codes, source divergence and personal data against brute force, and on awkward inputs."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from ledgerline.llm import codes, divergence, pii

VECTORS = "vec_id long, embedding array<float>, label int, code string, _label int, part int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, posts int, g int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, x, "c", 1, 2) for i, v, x in rows], VECTORS)


def brute_codes(rows, parts=16, entries=64, rounds=2):
    ok = [(i, v, x) for i, v, x in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    if not ok:
        return {}, ""
    width = -(-max(len(v) for _, v, _ in ok) // parts) * parts
    whole = [[math.floor(256 * float(np.float32(c))) for c in v] + [0] * (width - len(v)) for _, v, _ in ok]
    order = sorted(range(len(ok)), key=lambda r: (ok[r][0] is None, ok[r][0] or 0, [float(np.float32(c)) for c in ok[r][1]]))
    step = width // parts
    cut = [[w[p * step : (p + 1) * step] for p in range(parts)] for w in whole]
    books = [[cut[r][p] for r in order[:entries]] for p in range(parts)]

    def near(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        fresh = []
        for p in range(parts):
            mine = collections.defaultdict(list)
            for c in cut:
                mine[near(p, c[p])[1]].append(c[p])
            fresh.append([[sum(col) // len(mine[k]) for col in zip(*mine[k])] if k in mine else e for k, e in enumerate(books[p])])
        books = fresh
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], collections.Counter()
    for (i, _, x), c in zip(ok, cut):
        found = [near(p, c[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), x))
        by_label[x] += out[-1][2]
    return collections.Counter((i, c, e, by_label[x]) for i, c, e, x in out), digest


def test_codes(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([-0.5, 0.0, 0.25, r.gauss(0, 0.3)]) for _ in range(32)], r.choice([1, 2, None])) for i in range(150)]
    rows += [(200, None, 1), (201, [None] * 32, 1), (202, [float("nan")] * 32, 1), (203, [float("inf")] * 32, 2), (3, rows[3][1], 1), (3, rows[3][1], 1), (7, rows[9][1], 2), (None, rows[1][1], 1), (300, [0.5] * 20, None), (301, [], 2)]
    want, digest = brute_codes(rows)
    got = codes.compress(vectors(spark, rows)).collect()
    assert collections.Counter((x["vec_id"], x["code"], x["error"], x["label_error"]) for x in got) == want
    assert {x["codebooks_sha256"] for x in got} == {digest}


def test_codes_of_few_and_no_vectors(spark):
    rows = [(5, [0.1] * 16, 1), (2, [0.3] * 16, 1), (9, [0.11] * 16, None)]
    want, digest = brute_codes(rows)
    got = codes.compress(vectors(spark, rows)).collect()
    assert collections.Counter((x["vec_id"], x["code"], x["error"], x["label_error"]) for x in got) == want and {x["codebooks_sha256"] for x in got} == {digest}
    none = codes.compress(vectors(spark, [(1, None, 1)]))
    assert none.collect() == [] and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    huge = codes.compress(vectors(spark, [(1, [3e38] * 64, 1), (2, [-3e38] * 64, 1), (3, [0.0] * 64, 1)])).collect()
    assert all(x["error"] >= 0 for x in huge)


@pytest.mark.parametrize("spread", [2, 12, 4000])
def test_tree_equals_brute_force_with_ties(spread):
    r = np.random.default_rng(spread)
    for size, d in itertools.product([1, 5, 64, 256], [1, 4, 9]):
        points = r.integers(-spread, spread + 1, (size, d))
        queries = np.concatenate([r.integers(-spread, spread + 1, (300, d)), points])
        entry, apart, _ = codes.nearest(codes.grown(points, np.arange(size)), queries)
        every = codes.squared(queries, points)
        assert (entry == every.argmin(axis=1)).all() and (apart == every.min(axis=1)).all()


def test_tree_leaves_subtrees_closed():
    r = np.random.default_rng(1)
    centres = r.integers(-4000, 4000, (16, 4))
    points = (centres[:, None, :] + r.integers(-20, 21, (16, 16, 4))).reshape(-1, 4)
    took = codes.nearest(codes.grown(points, np.arange(256)), points)[2]
    assert took < 0.25 * 256 * 256


def brute_divergence(rows, least=10, top=10):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, by = collections.Counter(), collections.defaultdict(collections.Counter)
        for one, source, words in docs:
            if one == lang:
                by[source].update(words)
                df.update(set(words))
        kept = [t for t in df if df[t] >= least]
        counts = {s: {t: c[t] for t in kept} for s, c in by.items()}

        def p(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        ps = {s: p(c) for s, c in counts.items()}
        q = p({t: sum(c[t] for c in counts.values()) for t in kept})
        for s in ps:
            pairs = [(o, sum((ps[s][t] - ps[o][t]) ** 2 // (ps[s][t] + ps[o][t]) for t in kept)) for o in ps if o != s]
            terms = [(t, (ps[s][t] - q[t]) ** 2 // (ps[s][t] + q[t])) for t in kept if counts[s][t] and ps[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, i, v, n) for n, (i, v) in enumerate(ranked, 1)]
    return sorted(out)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 1, "x", 1, 2) for i, (lang, source, t) in enumerate(rows)], DOCS)


def test_divergence(spark):
    r = random.Random(2)
    words = [w for w in "alpha BETA gamma Äpfel über naïve x y zeta the the the".split()]
    rows = [(r.choice(["en", "de", None]), r.choice(["a", "b", "c", None, ""]), " ".join(r.choice(words[: r.randint(3, len(words))]) for _ in range(r.randint(0, 40)))) for _ in range(160)]
    rows += [("fr", "only", "rare words"), ("it", "a", ""), ("it", "b", None), ("en", "long", "long " * 20_000), ("en", "a", "w" * 50_000)] + [("en", "b", "same same text")] * 12
    want = brute_divergence(rows)
    shape = ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(x[c] for c in shape) for x in divergence.audit(docs(spark, rows)).collect()) == want
    assert {x[0] for x in want} >= {"it", ""}  # fr has one source and keeps no term: no rows
    assert divergence.audit(docs(spark, [])).collect() == []


def test_scatter_in_small_blocks(monkeypatch):
    """Blocks of rows, slices of entries and flushed accumulators add up to the same sums."""
    import pyarrow as pa

    r = random.Random(3)
    posts = [[{"g": g, "p": r.randint(1, 10**9), "p0": 5 + g} for g in sorted(r.sample(range(7), r.randint(1, 7)))] for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * 20 + ["y"] * 20), pa.array([7] * 40, pa.int32()), pa.array(posts)], ["lang", "peers", "posts"])

    def sums():
        out = collections.Counter()
        for b in divergence.scatter(iter([batch, batch])):
            for x in b.to_pylist():
                out[x["lang"], x["g"], x["h"]] += x["value"]
        return out

    whole = sums()
    monkeypatch.setattr(divergence, "CELLS_HELD", 15)
    monkeypatch.setattr(divergence, "SCATTERED", 5)
    assert sums() == whole and len(whole) > 50


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_pii(x):
    digits = lambda s: re.sub("[^0-9]", "", s)
    good = {
        "email": lambda s: True,
        "ip": lambda s: all(int(v) <= 255 for v in s.split(".")),
        "card": lambda s: 14 <= len(digits(s)) <= 19 and pii.luhn(digits(s)),
        "phone": lambda s: 10 <= len(digits(s)) <= 15,
    }
    return sorted((m.start(), k, m.end()) for k, name in enumerate(BASE) for m in BASE[name].finditer(x) if good[name](m.group()))


def random_marks(n, seed):
    r = random.Random(seed)
    pieces = ["a@b.c", "x.y%z@d-e.fr.", "@", "@q", "a@b", "1.2.3.4", "256.1.1.1", "01.02.3.0004", "4111111111111111", "4111-1111 1111-1111", "5", " ", "-", "+", "+1 (886) 555-9674", "+49", ".", "word", "é", "12 34", "٣", "\n"]
    return ["".join(r.choice(pieces) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_patterns():
    for x in random_marks(4000, 1) + ["9" * 20_000, "a" * 20_000 + "@", "1." * 5000, "+" * 1000 + "1" * 40, "a@b.c@d.e f@g.h", ""]:
        assert pii.base_spans(x) == brute_pii(x), x[:80]


def test_patterns_are_linear():
    import time

    begin = time.time()
    for x in ["9" * 1_000_000, "a" * 1_000_000, "a@" * 300_000, "1." * 400_000, "+1 " * 300_000, "+1(((" * 200_000, "x1 " * 100_000]:
        graph = pii.Graph()
        pii.add(graph, 0, x, pii.base_spans(x))
    assert time.time() - begin < 60


def graph_of(labels_known, edges, n, seed):
    r = random.Random(seed)
    g = pii.Graph()
    for i in range(n):
        g.owner.append(0), g.start.append(i), g.end.append(i + 1), g.plus.append(False)
        g.features.append(tuple(r.randrange(s) for s in pii.SIZES))
        g.label.append(labels_known.get(i, 0))
    g.edges = edges
    return g


@pytest.mark.parametrize("edges, near", [([(0, 1, 0), (1, 2, 0), (2, 5, 1), (3, 4, 2), (0, 3, 1)], 1e-4), ([(0, 1, 0), (1, 2, 0), (2, 3, 0), (0, 3, 1), (3, 4, 0), (1, 4, 2)], 0.15)])
def test_marginals_equal_enumeration(edges, near):
    """Exact where the graph is a tree (messages reach everywhere), near where skip edges close loops."""
    r = np.random.default_rng(4)
    model = pii.Model(r.normal(0, 0.3, (sum(pii.SIZES), pii.LABELS)), r.normal(0, 0.7, (pii.LABELS,) * 2), r.normal(0, 0.5, (2, pii.LABELS)), np.array([1.0, 0.7]))
    g = graph_of({4: 2}, edges, 6, 9)
    got = pii.marginals(g, model, rounds=60)
    want = np.zeros_like(got)
    has_left, has_right = {b for _, b, k in edges if k == 0}, {a for a, _, k in edges if k == 0}
    for y in itertools.product(range(pii.LABELS), repeat=6):
        if y[4] != 2:
            continue
        score = sum(model.features[np.array(g.features[i]) + pii.OFFSETS, y[i]].sum() for i in range(6) if i != 4)
        score += sum(model.ends[0][y[i]] for i in range(6) if i not in has_left and i != 4) + sum(model.ends[1][y[i]] for i in range(6) if i not in has_right and i != 4)
        score += sum(model.potential(k)[y[a], y[b]] for a, b, k in edges)
        want[range(6), y] += np.exp(score)
    want /= want.sum(axis=1, keepdims=True)
    assert np.abs(got - want).max() < near


def people(n, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abdeginorst") for _ in range(r.randint(2, 8)))
    out = []
    for i in range(n):
        words = [word() for _ in range(30)]
        things = [f"{word()}.{r.randint(10, 99)}@mail{r.randint(0, 9)}.example.com", f"+1 ({r.randint(200, 989)}) 555-{r.randint(1000, 9999)}", ".".join(str(r.randint(1, 250)) for _ in range(4)), card(r)]
        others = [str(r.randint(1990, 2030)), f"v{r.randint(1, 9)}.{r.randint(0, 20)}", f"{r.randint(1, 99)}%", f"2021-0{r.randint(1, 9)}-{r.randint(10, 28)}", str(r.randint(10**9, 10**10))]
        for x in r.sample(things, r.randint(0, 3)) + r.sample(others, 2):
            words.insert(r.randrange(len(words)), x)
        out.append(" ".join(words))
    return out


def card(r):
    head = "4" + "".join(str(r.randint(0, 9)) for _ in range(14))
    return next(head + d for d in "0123456789" if pii.luhn(head + d))


def test_random_field_adds_what_patterns_miss(spark):
    texts = people(400)
    special = [
        "write to jane.doe7@mail.example.com today because jane.doe7 is away and nobody else answers",
        "it was said that jane.doe7 is away and nobody else answers",
        "call +1 (555) 555-1234 or later 555-1234 if need be",
        "call me +1 (415) 555-2671 4111111111111111 thanks",
        "release 1.2.3 of 2020-01-02 costs 300 and weighs 12 kg, see page 7",
        None,
        "",
        "plain words only",
    ]
    rows = [("en", "s", t) for t in texts + special]
    got = {x["doc_id"]: x for x in pii.scan(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, (_, _, t) in enumerate(rows):
        base = brute_pii(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert set(filter(None, pii.listed(base).split(","))) <= set(got[i]["spans"].split(","))
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(b[1] == k for b in base) for k in range(4)]

    def added(i):
        return {(s.split(":")[0], (special[i])[int(s.split(":")[1]) : int(s.split(":")[2])]) for s in got[len(texts) + i]["spans"].split(",") if s.startswith("like")}

    assert added(0) == {("like_email", "jane.doe7")}
    assert added(1) == set()
    assert ("like_phone", "555-1234") in added(2)
    assert added(3) == {("like_phone", "+1 (415) 555-2671"), ("like_card", "4111111111111111")}
    assert all(added(i) == set() for i in (4, 7)) and got[len(texts) + 5]["spans"] == got[len(texts) + 6]["spans"] == ""
    assert sum(got[i]["n_added"] for i in range(len(texts))) <= 0.02 * len(texts)
    assert pii.scan(docs(spark, [])).collect() == []


def test_random_field_on_held_out_documents():
    """With no label observed, tokens of other documents get the labels that the patterns give."""
    counts = collections.Counter()
    for i, t in enumerate(people(500, 2)):
        g = pii.Graph()
        pii.add(g, i, t, pii.base_spans(t))
        counts.update(pii.contexts(g))
    model = pii.fit(list(counts.items()))
    right = total = 0
    for i, t in enumerate(people(200, 3)):
        g = pii.Graph()
        pii.add(g, i, t, pii.base_spans(t))
        if g.start:
            best = pii.marginals(g, model, observe=False).argmax(axis=1)
            right, total = right + (best == np.array(g.label)).sum(), total + len(g.label)
    assert right >= 0.97 * total  # patterns miss a number beside another, the field does not


def test_equal_tokens_agree():
    """A token that is undecided by itself takes the label of an observed equal one far away; without the edge it doesn't."""
    model = pii.Model(np.zeros((sum(pii.SIZES), pii.LABELS)), np.zeros((pii.LABELS,) * 2), np.zeros((2, pii.LABELS)), np.array([3.0, 3.0]))
    model.ends[0, 0] = 1.0
    g = graph_of({0: 3}, [(0, 1, 1), (1, 2, 1)], 3, 1)
    assert (pii.marginals(g, model)[1:].argmax(axis=1) == 3).all()
    g.edges = []
    assert (pii.marginals(g, model)[1:].argmax(axis=1) == 0).all()


def test_nothing_to_learn_from_adds_nothing(spark):
    got = pii.scan(docs(spark, [("en", "s", "numbers 12 and 555-1234"), ("en", "s", "numbers 12 and 555-1234")])).collect()
    assert [x["spans"] for x in got] == ["", ""]
