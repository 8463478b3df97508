"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of lexicon words (fixed lists of insults, and a weighted lexicon of words and word stems that
the labelled sample shows to mark the label), hits close to a second person, shares of capitals, punctuation marks and symbols, and hits that only appear when
look-alike characters are undone. The trees are fitted on one part of the sample and calibrated on the rest.

The sample holds at most about ``max_labelled`` labelled rows, chosen by a hash of the id; of an id's rows it takes one for each
label, the one whose text has the smallest hash. Each document is scored.
Null and empty texts have zero features and get the score that these have. With no labelled rows the score is 0; with one
class only, it is that class. Labels that are null or belong to no document are left out; repeated rows are scored alike; a
document with labels of both kinds counts for each of them. Extra columns are ignored.
"""

from __future__ import annotations

import math
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_crc, resident, saved, small_batches, text_bytes

INSULTS = frozenset(
    b"""idiot idiots moron morons stupid loser losers scum trash clown clowns pathetic worthless disgusting dumb fool fools
    garbage filth vermin ugly imbecile cretin dimwit halfwit jerk creep coward pig rat weasel parasite liar freak
    dummkopf abschaum versager trottel arschloch connard imbecile ordure salaud minable idiota estupido imbecil basura
    escoria payaso asqueroso""".split()
)
ATTACKS = frozenset(b"hate kill die shut destroy hurt despise burn choke drown crush beat".split())
SECOND_PERSON = frozenset(b"you your yours youre u ur du dich dein deine ihr tu te toi ton ta vous votre usted tus ti vosotros".split())
#: Look-alikes, undone; the marks in HIDING are dropped inside words.
LOOKS, MEANT, HIDING = b"@430!1$57", b"aaeoiisst", b"*._-'`"
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
TO_WORDS = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))
_other = bytes(b for b in PUNCTUATION if b not in LOOKS + HIDING)
UNDONE = bytes.maketrans(LOOKS + _other, MEANT + b" " * len(_other))
NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
NOT_LETTER = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128))
NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
NOT_PUNCTUATION = bytes(b for b in range(256) if b not in PUNCTUATION)
NAMES = "log_words insults insult_hits attacks learned learned_hits learned_weight learned_most near_you near_you_hits capitals punctuation exclamations digits obfuscated mean_word".split()


STEM, LONGEST = 4, 8


def features_of(raw: bytes, learned: dict[bytes, float], stems: frozenset[bytes]) -> list[float]:
    low = raw.lower() if raw.isascii() else raw.decode("utf-8", "replace").lower().encode()

    def weight_of(w: bytes) -> float:
        # A term is a whole word or its beginning; beginnings are bytes here, so one cut inside a letter finds nothing.
        return max((learned.get(w[:k], 0.0) for k in range(STEM, min(len(w), 4 * LONGEST) + 1)), default=0.0) if w[:STEM] in stems else 0.0

    words = low.translate(TO_WORDS).split()
    n = max(1, len(words))
    hits = [i for i, w in enumerate(words) if w in INSULTS]
    marks: list[int] = []
    weights: list[float] = []
    if stems:
        for i, w in enumerate(words):
            if weight := weight_of(w):
                marks.append(i)
                weights.append(weight)
    attacks = sum(map(ATTACKS.__contains__, words))
    both = {*hits, *marks}
    near = sum(any(w in SECOND_PERSON for w in words[max(0, i - 5) : i + 6]) for i in both)
    undone = sum(w in INSULTS or weight_of(w) > 0 for w in low.translate(UNDONE, HIDING).split())
    letters, size = len(raw.translate(None, NOT_LETTER)), max(1, len(raw))
    return [
        math.log1p(len(words)), len(hits) / n, float(len(hits)), attacks / n, len(marks) / n, float(len(marks)), sum(weights) / n, max(weights, default=0.0),
        near / n, float(near), len(raw.translate(None, NOT_UPPER)) / max(1, letters), len(raw.translate(None, NOT_PUNCTUATION)) / size, raw.count(b"!") / n,
        len(raw.translate(None, NOT_DIGIT)) / size, max(0, undone - len(both)) / n, letters / n,
    ]


def features(text: Column, learned: dict[str, float]) -> Column:
    """The dense features of a text column, as an array of doubles named by NAMES."""
    terms = {t.encode(): w for t, w in learned.items()}
    stems = frozenset(t[:STEM] for t in terms)

    @F.pandas_udf("array<double>")
    def dense(texts: pd.Series) -> pd.Series:
        resident("none", dict)
        return pd.Series([features_of(bytes(x), terms, stems) for x in texts], dtype=object)

    return dense(text_bytes(text))


def learn_terms(sample: DataFrame, most: int = 500, least_ratio: float = 8.0, least: int = 6) -> dict[str, float]:
    """Words and beginnings of words (4 to 8 letters) that labelled texts have far more often than others, with the log of
    the ratio; at most ``most``, the most frequent ones, each in ``least`` labelled texts and one in 200 of them."""
    whole = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")), lambda w: F.length(w) >= STEM)
    longer = lambda k: lambda w: F.when(F.length(w) >= k, F.substring(w, 1, k))
    terms = F.array_distinct(F.concat(whole, *[F.transform(whole, longer(k)) for k in range(STEM, LONGEST + 1)]))
    found = sample.select("label", F.explode(terms).alias("term")).filter(F.col("term").isNotNull() & (F.length("term") <= 3 * LONGEST))
    totals = sample.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    bad, good = (totals[0] or 0), (totals[1] or 0)
    rate = (F.col("bad") + 0.5) / (bad + 1) / ((F.col("good") + 0.5) / (good + 1))
    kept = (
        found.groupBy("term")
        .agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
        .filter((F.col("bad") >= max(least, 0.005 * bad)) & (rate >= least_ratio))
        .select("term", "bad", F.log(rate).alias("weight"))
        .orderBy(F.desc("bad"), "term")
        .limit(most)
        .collect()
    )
    return {r["term"]: r["weight"] for r in kept}


def score(
    documents: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = 10_000, folds: int = 5, held: int = 0,
    trees: int = 20, depth: int = 4, seed: int = 7,
) -> DataFrame:
    """doc_id, held_out, score and predicted for each document; rows with crc32(doc_id) mod ``folds`` = ``held`` teach nothing."""
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("fold", id_crc() % folds)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
    marked = marked.filter(F.col("label").isin(0.0, 1.0) & (id_crc() % folds != held)).distinct()  # two rows an id at most
    share = min(1.0, max_labelled / max(1, marked.count()))
    marked = marked.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    # One row for each id and label, however many rows an id has, so the sample is no larger than the marks.
    named = docs.join(F.broadcast(marked), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = saved(named.select("label", "text", "doc_id"), "labelled")
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    held_out = (F.col("fold") == held).alias("held_out")
    if len(counts) < 2:
        constant = F.lit(float(next(iter(counts), 0.0)))
        return docs.select("doc_id", held_out, constant.alias("score"), (constant >= 0.5).cast("int").alias("predicted"))
    sample = sample.withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(4)) == 0)
    classes = sample.groupBy("calibrates").agg(F.count_distinct("label").alias("n")).collect()
    split = len(classes) == 2 and all(r["n"] == 2 for r in classes)  # too few rows: fit and calibrate on all
    # Neither terms nor trees see the rows that calibrate.
    terms = learn_terms(sample.filter("not calibrates") if split else sample)
    rows = saved(sample.select("label", features(F.col("text"), terms).alias("dense"), "calibrates").coalesce(4), "features").select("label", "calibrates", array_to_vector("dense").alias("features"))
    fitted = rows.filter("not calibrates") if split else rows
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=4, seed=seed).fit(fitted)

    def raw_score(df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("raw", vector_to_array("probability")[1])

    iso = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(raw_score(rows.filter("calibrates") if split else rows).select("raw", "label"))
    dense = docs.select("doc_id", held_out, array_to_vector(features(F.col("text"), terms)).alias("features"))
    # A little of the raw score keeps the order inside the calibration's steps.
    calibrated = iso.transform(raw_score(dense)).withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.98 * F.col("calibrated") + 0.02 * F.col("raw"))))
    return calibrated.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
