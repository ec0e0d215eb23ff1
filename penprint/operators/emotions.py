"""Emotions by a classifier that is fitted on labelled texts: multinomial naive Bayes over words.

``label_by_terms`` labels texts by a few listed terms, for corpora without labels of their own; ``fit_emotions`` counts
words by label in one aggregation; ``emotion_probabilities`` joins the words of texts to those counts. Everything is
joins and sums of built-in functions. Only the labels themselves (``MOST_LABELS`` at most) reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.functions import text as tx
from penprint.plans.keys import explode, first_k, join_on
from penprint.session import stored

SMOOTHING = 1.0
MOST_LABELS = 1000


@dataclass
class EmotionModel:
    """``words``: per known word the gains of the labels that hold it. ``labels``: name, log prior, log-probability of a word it never held."""

    words: DataFrame
    labels: list[tuple[str, float, float]]


def word_rows(df: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep, word``: a row per word of every text. They are counted where they are needed, not per text."""
    words = tx.words(F.coalesce(F.col(text), F.lit("")))
    return explode(df.select(*keep, text), keep, words, "word")


def label_by_terms(df: DataFrame, lexicon: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """``keys, label``: texts whose listed terms all have the same emotion. ``lexicon`` has ``term, emotion``, one row per term."""
    terms = lexicon.where(F.col("emotion").isNotNull()).select(F.col("term").alias("word"), "emotion")
    words = F.array_distinct(tx.words(F.coalesce(F.col(text), F.lit(""))))
    hits = join_on(explode(df.select(*keys, text), keys, words, "word"), terms, ["word"])
    found = hits.groupBy(*keys).agg(F.min("emotion").alias("label"), F.max("emotion").alias("other"))
    return found.where(F.col("label") == F.col("other")).drop("other")


def label_counts(df: DataFrame, labels: DataFrame, keys: Sequence[str], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``label, texts, words`` and ``word, label, n`` over the labelled texts; ``labels`` has one row per key.

    Texts meet their labels before they are split, so a word moves as part of a count by label. Labels and counts are
    written once, since all that is fitted reads them several times.
    """
    known = stored(labels.where(F.col("label").isNotNull()).select(*keys, "label"), "emotion-labels")
    rows = word_rows(join_on(df.select(*keys, text), known, keys), ["label"], text)
    counts = stored(rows.groupBy("word", "label").agg(F.count(F.lit(1)).alias("n")), "emotion-counts")
    sizes = counts.groupBy("label").agg(F.sum("n").alias("words"))
    return join_on(known.groupBy("label").agg(F.count(F.lit(1)).alias("texts")), sizes, ["label"], "left"), counts


def fit_emotions(df: DataFrame, labels: DataFrame, keys: Sequence[str], text: str = "text", smoothing: float = SMOOTHING) -> EmotionModel:
    """A model from texts and one label per key; labels without words count by their prior alone."""
    per_label, counts = label_counts(df, labels, keys, text)
    found = per_label.orderBy("label").limit(MOST_LABELS + 1).collect()
    if not found or len(found) > MOST_LABELS:
        raise ValueError(f"1 to {MOST_LABELS} labels are needed")
    vocabulary = counts.select("word").distinct().count()
    texts = sum(r.texts for r in found)
    base = lambda words: math.log(smoothing / ((words or 0) + smoothing * max(vocabulary, 1)))
    gain = F.log1p(F.col("n") / F.lit(smoothing))
    words = counts.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("label", gain.alias("gain")))).alias("gains"))
    return EmotionModel(words, [(r.label, math.log(r.texts / texts), base(r.words)) for r in found])


def emotion_probabilities(df: DataFrame, model: EmotionModel, keys: Sequence[str], text: str = "text") -> DataFrame:
    """``keys, label, probability`` for every label; words the model does not know say nothing.

    Texts of equal keys are judged as one; texts without known words get the priors.
    """
    gain = lambda name: F.coalesce(F.get(F.map_values(F.map_filter("gains", lambda k, _: k == name)), F.lit(0)), F.lit(0.0))
    gains = [f"gain{i}" for i in range(len(model.labels))]
    words = model.words.select("word", *[gain(name).alias(g) for g, (name, _, _) in zip(gains, model.labels)])
    hits = join_on(word_rows(df, keys, text), words, ["word"])
    sums = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("known"), *[F.sum(g).alias(g) for g in gains])
    rows = join_on(df.select(*keys).distinct(), sums, keys, "left")

    def score(i: int, prior: float, unseen: float) -> Column:
        return F.lit(prior) + F.coalesce("known", F.lit(0)) * F.lit(unseen) + F.coalesce(f"gain{i}", F.lit(0.0))

    scores = F.array(*[score(i, prior, unseen) for i, (_, prior, unseen) in enumerate(model.labels)])
    rows = rows.select(*keys, scores.alias("s")).select(*keys, F.transform("s", lambda x: F.exp(x - F.array_max("s"))).alias("e"))
    rows = rows.withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    names = F.array(*[F.lit(name) for name, _, _ in model.labels])
    shares = explode(rows, keys, F.transform("e", lambda x, i: F.struct(F.get(names, i).alias("label"), (x / F.col("total")).alias("probability"))), "x")
    return shares.select(*keys, "x.label", "x.probability")


def fitted_emotions(probabilities: DataFrame, author: str = "author", k: int = 5) -> DataFrame:
    """``author, rank, label, share``: the ``k`` labels with the highest mean probability over an author's texts."""
    per_label = probabilities.groupBy(author, "label").agg(F.avg("probability").alias("share"))
    return first_k(per_label, [author], [F.col("share").desc(), F.col("label")], k).select(author, "rank", "label", "share")
