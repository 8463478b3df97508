"""Texts of one template, each with words of its own: those that cannot link are never compared, those that can are linked; and the bound of the labelled sample."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import jaccard, toxicity

from .test_llm import brute_components, frame, rows
from .test_near_stage import brute_kept


def templates(n, seed=3, lengths=(42,)):
    """Texts that share all words but one, in their middle: 37 of 43 shingles in common, at 42 words, so none link at 0.9."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(max(lengths))]
    out = []
    for i in range(n):
        words = base[: r.choice(lengths)]
        words[r.randrange(5, len(words) - 5)] = f"only{i}"
        out.append(" ".join(words))
    return out


def counted(spark, texts, monkeypatch, **options):
    """The join's rows, and how many rows its intermediate tables had."""
    counts = {}
    saved = jaccard.saved

    def counting(df, label):
        out = saved(df, label)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(jaccard, "saved", counting)
    got = rows(jaccard.join(frame(spark, texts), **options))
    monkeypatch.setattr(jaccard, "saved", saved)
    return {x["doc_id"]: x["component_id"] for x in got}, counts


def test_templates_that_cannot_link_are_no_candidates(spark, monkeypatch):
    for n in (240, 480):
        got, counts = counted(spark, templates(n), monkeypatch)
        assert counts["members"] == n  # the frequency filter alone keeps them all
        assert counts["shared"] == 0 and counts["pairs"] == 0
        assert got == {i: i for i in range(n)}


def test_templates_of_several_lengths(spark, monkeypatch):
    texts = templates(300, lengths=(40, 41, 42, 43, 44))
    texts += [x + " tail" for x in texts[:40]] + [x.replace("w0 ", "head ") for x in texts[40:60]]
    got, counts = counted(spark, texts, monkeypatch)
    want, _ = brute_components(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert counts["pairs"] <= len(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_edited_copies_at_any_place(spark, seed):
    """Near the threshold on either side, edits at both ends and in the middle, short and long texts of one vocabulary."""
    r = random.Random(seed)
    texts = []
    for _ in range(12):
        base = [f"w{r.randrange(60)}" for _ in range(r.choice([12, 30, 60, 150]))]
        for _ in range(10):
            words = list(base)
            for _ in range(r.randint(0, 3)):
                words[r.choice([0, 1, len(words) - 1, r.randrange(len(words))])] = f"v{r.randrange(30)}"
            cut = r.randint(0, max(1, len(words) // 12))
            texts.append(" ".join(words[cut:] if r.random() < 0.5 else words[: len(words) - cut]))
    got = {x["doc_id"]: x["component_id"] for x in rows(jaccard.join(frame(spark, texts)))}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)[0]
    loose = {x["doc_id"]: x["component_id"] for x in rows(jaccard.join(frame(spark, texts), 5, 80))}
    assert {i for i, c in loose.items() if i == c} == brute_kept(texts)


def test_labelled_sample_is_bounded_by_ids_not_rows(spark, monkeypatch):
    ids = [*range(60), *[7] * 3000]
    texts = [f"you are an idiot {i}" if i % 3 == 0 else f"a calm text {i}" for i in range(len(ids))]
    docs = frame(spark, texts, ids=ids)
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(60)] + [(7, True)], "doc_id long, toxic boolean")
    sizes = {}
    saved = toxicity.saved

    def counting(df, label):
        out = saved(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(toxicity, "saved", counting)
    got = toxicity.score(docs, labels, max_labelled=1000)
    assert sizes["labelled"] <= 61
    assert got.count() == len(ids)
    one = got.filter("doc_id = 7").join(docs.filter("doc_id = 7").select("doc_id").distinct(), "doc_id")
    assert one.filter(F.col("score").isNull()).count() == 0
