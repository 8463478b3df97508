"""Personal data by pattern, and what a skip-chain conditional random field adds to it.

Patterns find e-mail addresses, IP addresses, card numbers (Luhn's sum must hold) and telephone numbers, leftmost and without
overlap for each kind; these spans are never changed. The random field then labels what the patterns left: a number whose country
code is missing, an address's name used by itself. Its nodes are the text's tokens that can be personal data at all (they hold a
digit or an '@', or repeat the name before an '@'); all other words are plain. Neighbours share a potential, as in a linear chain.
Distant tokens share one as well where they repeat each other's text (``repeat``) or are alike (``similar``: the last seven digits,
or an address and its name). Each token is tied to the one before it with the same key, so a key with n tokens has n - 1 edges.
Tokens inside a pattern's span are observed; loopy belief propagation gives the others' marginals, and those of at least ``least``
become spans of the kinds like_email, like_ip, like_card and like_phone. So a token that says little by itself takes the label of
its likes, wherever in the document they are.

Weights are learned by pseudo-likelihood on at most about ``fit_documents`` distinct documents, chosen by a hash, labelled by the
patterns alone: tasks return counts of distinct contexts, not texts. A token that the patterns leave out but that is tied to one
they label is neither a positive nor a negative case, and is left out of learning; since patterns never label a bare name
or a number's end, each address and each long number gives a case of that part by itself, tied to the whole. The ties' weights have a prior at ``EDGE_PRIOR``, for texts that
show few ties. Messages travel ``ROUNDS`` tokens far.

Null texts count as empty, which have no spans. Long texts are read whole, and all matching is linear in a text's length. Repeated
rows give equal rows; spans of equal start are in the order of kinds. Where the patterns find nothing to learn from, nothing is
added. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

KINDS = ["email", "ip", "card", "phone"]
ORDER = [*KINDS, *[f"like_{k}" for k in KINDS]]
#: What the patterns are made of. Each is written so that a search is linear; ``base_spans`` says why the matches are the same.
LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){13,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
WORD = re.compile(r"\S+")
EDGES_OFF = ".,;:!?\"'<>[]{}"
LEAST_NAME, TAIL_DIGITS = 4, 7
#: Words before a token that tell what it is, by kind.
CUES = {
    1: {"mail", "email", "e-mail", "contact", "write", "user", "username"},
    2: {"ip", "host", "server", "address", "from"},
    3: {"card", "visa", "mastercard", "amex", "credit", "debit"},
    4: {"phone", "tel", "telephone", "mobile", "cell", "fax", "call", "whatsapp"},
}
#: Values of each feature of a token, in order: '@', letters, digits, dots, dashes, plus sign and brackets, dotted quad, Luhn, cue, other signs.
SIZES = [3, 3, 17, 5, 5, 4, 3, 3, 5, 2]
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)[:-1]])
DIGIT_STEPS = [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 20]
LABELS = 1 + len(KINDS)
NONE = LABELS  # a neighbour that is not there or is plain
CHAIN, REPEAT, SIMILAR = 0, 1, 2
EDGE_PRIOR, ROUNDS, DAMPING = 3.0, 20, 0.3
FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find.

    E-mail: a name can only begin where its run of name characters does or the last match ended, so the run before each '@' is
    measured backwards. IP: a number that fails from its first digit fails from the others too. Card: a match always takes a whole
    run of digits, so runs of fewer than 14 need not be matched. Parts and digits are checked after matching, and failing matches
    are dropped.
    """
    out = []
    done = 0
    at = text.find("@")
    while at >= 0:
        name = text[done:at]
        size = len(name) - len(name.rstrip(LOCAL))
        domain = DOMAIN.match(text, at) if size else None
        if domain:
            out.append((at - size, 0, domain.end()))
        done = domain.end() if domain else at + 1
        at = text.find("@", done)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


DIGIT = re.compile("[0-9]")


@dataclass
class Graph:
    """Tokens of some documents: their places, features, labels where observed (else 0), edges (one node, other node, type), and
    views: parts of observed tokens as they would stand elsewhere (features, label, type of the tie to the token)."""

    owner: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    features: list[tuple[int, ...]] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    plus: list[bool] = field(default_factory=list)
    views: list[tuple[tuple[int, ...], int, int]] = field(default_factory=list)
    edges: list[tuple[int, int, int]] = field(default_factory=list)


def described(word: str, before: str) -> tuple[int, ...]:
    """The features of a token, given the text just before it."""
    digits = [c for c in word if "0" <= c <= "9"]
    letters = {c.lower() for c in word if c.isalpha()}
    at = word.find("@")
    quad = word.split(".")
    numeric = len(quad) == 4 and all(x and len(x) <= 9 and x.isascii() and x.isdigit() for x in quad)
    carded = 14 <= len(digits) <= 19 and not letters
    cue = before.split()[-1:]
    cue = cue[0].strip(EDGES_OFF + "()").lower() if cue else ""
    return (
        0 if at < 0 else 2 if "." in word[at:] else 1,
        0 if not letters else 1 if letters <= set("abcdef") else 2,
        next(i for i in range(len(DIGIT_STEPS) - 1, -1, -1) if len(digits) >= DIGIT_STEPS[i]),
        min(4, word.count(".")),
        min(4, word.count("-")),
        (1 if word[:1] == "+" else 0) + (2 if "(" in word or ")" in word else 0),
        0 if not numeric else 1 if all(int(x) <= 255 for x in quad) else 2,
        0 if not carded else 1 if luhn("".join(digits)) else 2,
        next((k for k, words in CUES.items() if cue in words), 0),
        int(any(not c.isalnum() and c not in ".-+()@ " for c in word)),
    )


def add(graph: Graph, owner: int, text: str, base: list[tuple[int, int, int]]) -> None:
    """Puts a document's tokens and their edges into the graph."""
    places = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    names = {text[s : text.find("@", s, e)].lower() for s, k, e in base if k == 0}
    names = {n for n in names if len(n) >= LEAST_NAME}
    bare = {n for n in names if not DIGIT.search(n)}
    if bare:
        places += [(m.start(), m.end()) for m in WORD.finditer(text) if m.group().strip(EDGES_OFF).lower() in bare]
        places.sort()
    last: dict[tuple[str, str], int] = {}
    spans, upto = sorted(base), 0
    open_: list[tuple[int, int, int]] = []
    for s, e in places:
        word = text[s:e]
        kept = word.strip(EDGES_OFF)
        if not kept:
            continue
        begin = s + len(word) - len(word.lstrip(EDGES_OFF))
        node = len(graph.start)
        while upto < len(spans) and spans[upto][0] < e:
            open_.append(spans[upto])
            upto += 1
        open_ = [x for x in open_ if x[2] > s]
        graph.owner.append(owner)
        graph.start.append(begin)
        graph.end.append(begin + len(kept))
        graph.features.append(described(kept, text[max(0, s - 24) : s]))
        graph.label.append(1 + open_[0][1] if open_ else 0)
        graph.plus.append(kept[0] == "+")
        if node and graph.owner[node - 1] == owner and s - (ended := graph.end[node - 1]) <= 4 and not text[ended:s].strip(EDGES_OFF + " \t\r\n"):
            graph.edges.append((node - 1, node, CHAIN))
        lower = kept.lower()
        keys = [("text", lower)] if len(lower) >= LEAST_NAME else []
        # An address is alike to its name, and a number to others that end in the same digits.
        name = lower.partition("@")[0] if "@" in lower else lower
        if name in names:
            keys.append(("name", name))
            if "@" in lower:
                graph.views.append((described(kept.partition("@")[0], ""), 1, SIMILAR))
        digits = "".join(DIGIT.findall(lower)) if not any(c.isalpha() for c in lower) and lower.count(".") < 3 else ""
        if TAIL_DIGITS <= len(digits) <= 19:
            keys.append(("tail", digits[-TAIL_DIGITS:]))
            if graph.label[node]:
                graph.views.append((described(kept, ""), graph.label[node], REPEAT))
        tied = set()
        for key in keys:
            other = last.get(key)
            if other is not None and other not in tied:
                graph.edges.append((other, node, REPEAT if key[0] == "text" else SIMILAR))
                tied.add(other)
            last[key] = node


def contexts(graph: Graph) -> Counter:
    """How often each token context occurs: features, label, labels of the neighbours, and how many tied tokens have each label."""
    out: Counter = Counter()
    n = len(graph.start)
    left, right = [NONE] * n, [NONE] * n
    ties = np.zeros((n, 2, LABELS), dtype=np.int64)
    for a, b, kind in graph.edges:
        if kind == CHAIN:
            left[b], right[a] = graph.label[a], graph.label[b]
        else:
            ties[a, kind - 1, graph.label[b]] += 1
            ties[b, kind - 1, graph.label[a]] += 1
    for i in range(n):
        if graph.label[i] or not ties[i, :, 1:].any():
            out[(*graph.features[i], graph.label[i], left[i], right[i], *ties[i].ravel().tolist())] += 1
    # Patterns never label a bare name, nor a number's end: a case is made of each, by itself and tied to the whole.
    for features, label, kind in graph.views:
        tied = np.zeros((2, LABELS), dtype=np.int64)
        tied[kind - 1, label] = 1
        out[(*features, label, NONE, NONE, *tied.ravel().tolist())] += 1
    return out


@dataclass
class Model:
    """Log potentials: of features, of neighbours, of a missing neighbour on either side, and of equal labels over each kind of tie."""

    features: np.ndarray
    chain: np.ndarray
    ends: np.ndarray
    ties: np.ndarray

    def potential(self, kind: int) -> np.ndarray:
        return self.chain if kind == CHAIN else np.eye(LABELS) * self.ties[kind - 1]


def fit(counts: list[tuple[tuple[int, ...], int]], steps: int = 400, rate: float = 0.1) -> Model:
    """The pseudo-likelihood's maximum, with normal priors, by gradient steps with momentum and scaling."""
    model = Model(np.zeros((sum(SIZES), LABELS)), np.zeros((LABELS, LABELS)), np.zeros((2, LABELS)), np.full(2, EDGE_PRIOR))
    if not counts:
        return model
    table = np.array([c for c, _ in sorted(counts)], dtype=np.int64)
    weight = np.array([n for _, n in sorted(counts)], dtype=np.float64)
    f = len(SIZES)
    x, y, left, right = table[:, :f] + OFFSETS, table[:, f], table[:, f + 1], table[:, f + 2]
    ties = table[:, f + 3 :].reshape(-1, 2, LABELS).astype(np.float64)
    weight = weight / weight.sum() * min(weight.sum(), 1e6)
    params = [model.features, model.chain, model.ends, model.ties]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    has_left, has_right, rows = left < NONE, right < NONE, np.arange(len(y))
    for step in range(1, steps + 1):
        score = model.features[x].sum(axis=1) + np.einsum("ckl,k->cl", ties, model.ties)
        score += np.where(has_left[:, None], model.chain[np.minimum(left, LABELS - 1)], model.ends[0])
        score += np.where(has_right[:, None], model.chain.T[np.minimum(right, LABELS - 1)], model.ends[1])
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[rows, y] -= 1
        p *= weight[:, None]
        d = [np.zeros_like(q) for q in params]
        np.add.at(d[0], x.ravel(), np.repeat(p, f, axis=0))
        np.add.at(d[1], left[has_left], p[has_left])
        np.add.at(d[1].T, right[has_right], p[has_right])
        d[2][0], d[2][1] = p[~has_left].sum(axis=0), p[~has_right].sum(axis=0)
        d[3][:] = np.einsum("ckl,cl->k", ties, p)
        for q, g, prior, strength in zip(params, d, [0.0, 0.0, 0.0, EDGE_PRIOR], [1.0, 1.0, 1.0, 5.0], strict=True):
            g += strength * (q - prior)
        for i, (q, g) in enumerate(zip(params, d, strict=True)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            q -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-9)
    model.ties[:] = np.maximum(model.ties, 0.0)
    return model


def marginals(graph: Graph, model: Model, rounds: int = ROUNDS, observe: bool = True) -> np.ndarray:
    """Each token's probabilities of the labels by loopy belief propagation: all messages at once, a fixed number of rounds.

    A round costs the same for each edge and documents share none, so many documents are passed through together."""
    n = len(graph.start)
    unary = model.features[np.array(graph.features, dtype=np.int64).reshape(n, len(SIZES)) + OFFSETS].sum(axis=1)
    edges = np.array(graph.edges, dtype=np.int64).reshape(-1, 3)
    chain = edges[edges[:, 2] == CHAIN]
    alone = np.ones((2, n), dtype=bool)
    alone[0, chain[:, 1]], alone[1, chain[:, 0]] = False, False
    unary += alone[0][:, None] * model.ends[0] + alone[1][:, None] * model.ends[1]
    if observe:
        seen = np.flatnonzero(np.array(graph.label, dtype=np.int64))
        known = np.full((len(seen), LABELS), -1e6)
        known[np.arange(len(seen)), np.array(graph.label)[seen]] = 0.0
        unary[seen] = known
    # Each edge carries a message either way; back[i] is the message that runs against message i.
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    tables = np.stack([model.potential(k) for k in (CHAIN, REPEAT, SIMILAR)])
    pair = np.concatenate([tables[edges[:, 2]], tables[edges[:, 2]].transpose(0, 2, 1)])
    message = np.zeros((2 * len(edges), LABELS))
    belief = unary.copy()
    for _ in range(rounds if len(edges) else 0):
        leaving = (belief[source] - message[back])[:, :, None] + pair
        top = leaving.max(axis=1, keepdims=True)
        new = np.log(np.exp(leaving - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        message = DAMPING * message + (1 - DAMPING) * new
        belief = unary.copy()
        np.add.at(belief, target, message)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(graph: Graph, model: Model, least: float) -> dict[int, list[tuple[int, int, int]]]:
    """The method's own spans (start, place in ORDER, end) by document. Neighbours of one kind are one span, but for a new '+', address or IP."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    if not graph.start:
        return out
    p = marginals(graph, model)
    best = p[:, 1:].argmax(axis=1)
    sure = (p[:, 1:].max(axis=1) >= least) & (np.array(graph.label) == 0)
    follows = {b for a, b, kind in graph.edges if kind == CHAIN and sure[a] and sure[b] and best[a] == best[b] and best[b] >= 2 and not graph.plus[b]}
    for i in np.flatnonzero(sure).tolist():
        mine = out.setdefault(graph.owner[i], [])
        if i in follows:
            mine[-1] = (*mine[-1][:2], graph.end[i])
        else:
            mine.append((graph.start[i], len(KINDS) + int(best[i]), graph.end[i]))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ORDER[k]}:{s}:{e}" for s, k, e in sorted(spans))


def learned(documents: DataFrame, fit_documents: int) -> Model:
    """The model, from counts of token contexts over about ``fit_documents`` distinct documents."""
    rows = documents.select(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").alias("key"), text_bytes().alias("text"))
    total = documents.count()
    share = 1.0 if total <= fit_documents else fit_documents / total
    chosen = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # A row that repeats is one case, however often it occurs.
    chosen = chosen.groupBy("key").agg(F.first("text").alias("text")).select("key", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def done() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([list(c) for c in seen], pa.list_(pa.int64())), pa.array(list(seen.values()), pa.int64())], ["context", "n"])
            seen.clear()
            return made

        for _, texts in slices(batches):
            graph = Graph()
            for i, text in enumerate(texts):
                text = text.decode("utf-8", "replace")
                add(graph, i, text, base_spans(text))
            seen.update(contexts(graph))
            if len(seen) > 100_000:
                yield done()
        yield done()

    counts = chosen.mapInArrow(count, "context array<long>, n long").groupBy("context").agg(F.sum("n").alias("n"))
    return fit([(tuple(r["context"]), r["n"]) for r in counts.collect()])  # bounded by the chosen documents' tokens


def scan(documents: DataFrame, least: float = 0.8, fit_documents: int = 20_000) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (by pattern), base_sha256, spans, n_added for each document."""
    model = learned(documents, fit_documents)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            graph, found = Graph(), []
            for i, text in enumerate(texts):
                text = text.decode("utf-8", "replace")
                found.append(base_spans(text))
                add(graph, i, text, found[-1])
            more = added_spans(graph, model, least)
            digests = [hashlib.sha256(listed(base).encode()).hexdigest() for base in found]
            counts = [[sum(k == kind for _, k, _ in base) for base in found] for kind in range(len(KINDS))]
            columns = [*[pa.array(c, pa.int64()) for c in [ids, *counts]], pa.array(digests), pa.array([listed(base + more.get(i, [])) for i, base in enumerate(found)]), pa.array([len(more.get(i, [])) for i in range(len(found))], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FOUND.split(", ")])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(find, FOUND)
