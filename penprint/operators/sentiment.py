"""Polarity, valence and emotion from a term table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penprint import lexicons as lx
from penprint.functions import text as tx
from penprint.operators import scan as sc
from penprint.plans.keys import first_k, join_on

MICRO = 1_000_000
# Published rule weights in millionths: an intensifier one, two or three words back (damped by .95
# and .9), and the factor a negation within three words applies.
STEPS = [293_000, 278_350, 263_700]
NEGATION_PERCENT = -74


def scored_vocabulary(vocabulary: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Vocabulary rows of the lexicon's terms. The lexicon has one row per term."""
    return vocabulary.join(lexicon, vocabulary["word"] == lexicon["term"], "inner").drop("term")


def valence_counters(df: DataFrame, lexicon: DataFrame, author: str = "author", text: str = "text") -> DataFrame:
    """Valence sums in millionths, with intensifiers and negations among the three words before.

    Tasks count each word by what its surroundings do to it, so that only distinct ones meet the lexicon (one row per
    term), whatever its size.
    """
    terms = lexicon.select("term", "valence")
    hits = surroundings(df, author, text).join(terms, F.col("word") == F.col("term"), "inner")
    step, negated, n = F.col("step"), F.col("negated"), F.col("n")
    v = F.col("valence") * (MICRO // 10)
    boosted = F.when(v == 0, F.lit(0)).when(v > 0, v + step).otherwise(v - step).cast("bigint")
    turned = F.when(negated, F.expr(f"({NEGATION_PERCENT}) * boosted div 100")).otherwise(F.col("boosted"))
    scored = hits.withColumn("boosted", boosted).select(author, turned.alias("value"), "n")
    value = F.col("value")
    return scored.groupBy(author).agg(
        F.sum(n * value).alias("valence_sum"),
        F.sum(F.when(value > 0, n * (value + MICRO)).otherwise(0)).alias("positive_sum"),
        F.sum(F.when(value < 0, n * (-value + MICRO)).otherwise(0)).alias("negative_sum"),
        F.sum(F.when(value != 0, n).otherwise(0)).alias("n_charged"),
    )


def surroundings(df: DataFrame, author: str, text: str) -> DataFrame:
    """``(author, word, step, negated, n)``: words by what intensifiers and negations among the three words before add."""
    borders = sc.classes(df.sparkSession)["word"]
    # Three digits, one per word before: 0 none, 1 an intensifier, 2 its opposite.
    steps = np.array([sum((0, w, -w)[code // 3**d % 3] for d, w in enumerate(STEPS)) for code in range(27)])

    def work(part: pa.RecordBatch, texts: list[str]) -> Iterator[list]:
        _, _, number, authors = sc.grouped_by_author(part, texts, 0)
        chunk = sc.Chunk(texts, borders)
        starts, ends = chunk.words()
        ids, distinct = sc.coded_words(chunk, starts, ends)
        size, of = max(len(distinct), 1), chunk.text_of(starts)
        among = lambda words: pc.is_in(distinct, pa.array(words, distinct.type)).to_numpy(zero_copy_only=False)
        kind, no = np.where(among(lx.BOOSTERS), 1, np.where(among(lx.DAMPENERS), 2, 0)), among(lx.NEGATIONS)
        code, negated = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        for d in range(len(STEPS)):
            at = np.flatnonzero(of[d + 1 :] == of[: -d - 1]) + d + 1
            code[at] += kind[ids[at - d - 1]] * 3**d
            negated[at] |= no[ids[at - d - 1]]
        keys, n, _, _ = sc.tally(((number[of] * size + ids) * 27 + code) * 2 + negated, len(authors) * size * 54)
        word = keys // 54
        yield [sc.taken(authors, word // size), sc.taken(distinct, word % size), steps[keys // 2 % 27], keys % 2 > 0, n]

    schema = T.StructType([
        df.schema[author], T.StructField("word", T.StringType()), T.StructField("step", T.LongType()),
        T.StructField("negated", T.BooleanType()), T.StructField("n", T.LongType()),
    ])
    return sc.counted(df.select(author, F.lower(F.col(text)).alias("__low")), "__low", schema, work)


def valence_fields(valence_sum: Column, positive: Column, negative: Column, charged: Column, words: Column) -> dict[str, Column]:
    x = valence_sum.cast("double") / MICRO
    neutral = (words - charged) * MICRO
    total = positive + negative + neutral
    return {
        "vader_positive": tx.ratio(positive, total),
        "vader_negative": tx.ratio(negative, total),
        "vader_neutral": tx.ratio(neutral, total),
        "vader_compound": x / F.sqrt(x * x + 15.0),
    }


def emotion_shares(vocabulary: DataFrame, lexicon: DataFrame, author: str = "author", k: int = 5) -> DataFrame:
    """``(author, rank, label, share)``: the ``k`` most frequent emotions among the matched words."""
    per_label = (
        scored_vocabulary(vocabulary, lexicon)
        .where(F.col("emotion").isNotNull())
        .groupBy(author, F.col("emotion").alias("label"))
        .agg(F.sum("n").alias("n"))
    )
    totals = per_label.groupBy(author).agg(F.sum("n").alias("total"))
    ranked = first_k(join_on(per_label, totals, [author]), [author], [F.col("n").desc(), F.col("label")], k)
    return ranked.select(author, "rank", "label", tx.ratio(F.col("n"), F.col("total")).alias("share"))
