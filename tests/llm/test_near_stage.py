"""The near_duplicates stage against brute force at five words and 0.8."""

import random

import numpy as np

import corpus_pipeline
from ledgerline.llm import jaccard

from .test_llm import ODD, frame, random_texts


def brute_kept(texts, width=5, percent=80):
    sets = []
    for x in texts:
        w = (x or "").encode().lower().split()
        sets.append({tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in range(len(texts)) if find(i) == i}


def test_near_duplicates_stage(spark):
    r = random.Random(11)
    base = [[f"w{r.randrange(900)}" for _ in range(200)] for _ in range(6)]
    texts = [" ".join(b) for b in base]
    for i, b in enumerate(base):
        texts.append(" ".join(b[: 170 - i]))  # 15 to 17.5 % cut: below 0.9, above 0.8
        texts.append(" ".join(b + [f"v{r.randrange(900)}" for _ in range(35)]))
        edited = list(b)
        for at in (20, 70, 120):  # scattered edits
            edited[at] = "x"
        texts.append(" ".join(edited))
        texts.append(" ".join(b[: 150 - i]))  # below 0.8 of the whole, but near the cut copy
    texts += ODD + random_texts(60, 5)
    got = {x["doc_id"] for x in corpus_pipeline.near_duplicates_stage(spark, frame(spark, texts), "").collect()}
    want = brute_kept(texts)
    assert want != brute_kept(texts, 3, 90)  # the cases tell the two rules apart
    assert got == want


