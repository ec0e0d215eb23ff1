"""Fills for masked spans by a bigram model with Kneser-Ney back-off, kept as tables.

``kneser_ney`` turns counts of neighbouring words into three tables: seen pairs with their probability, what a context
leaves to unseen words, and how likely a word is there, judged by the number of contexts it follows. ``fill_spans``
walks from the word before a sentinel over likely successors to the word behind it, by joins alone, and scores
every way. Its proposals go where ``greedy_refine`` takes supplied ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.functions import text as tx
from penprint.plans.keys import explode, first_k, join_on

SENTINEL = "<extra_id_0>"
DISCOUNT = 0.75
# Successors that are tried after a word, and the probability of a word the model has never seen.
BEAM, FLOOR = 8, 1e-12
EDGE = ""


@dataclass
class BigramModel:
    """``pairs``: before, word, p. ``contexts``: before, rest. ``words``: word, p. The edge of a text is the empty word."""

    pairs: DataFrame
    contexts: DataFrame
    words: DataFrame


def pieces(text: Column) -> Column:
    return F.filter(F.split(text, f"{tx.SPACE}+"), lambda t: t != "")


def bigram_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``before, word, n`` over lower-cased pieces between white space; texts begin and end with the edge."""
    words = pieces(F.lower(F.coalesce(F.col(text), F.lit(""))))
    edged = df.select(F.concat(F.array(F.lit(EDGE)), words, F.array(F.lit(EDGE))).alias("w"))
    pairs = F.transform(F.slice("w", 2, F.size("w") - 1), lambda x, i: F.struct(F.get("w", i).alias("before"), x.alias("word")))
    return explode(edged, [], pairs, "p").groupBy("p.before", "p.word").agg(F.count(F.lit(1)).alias("n"))


def kneser_ney(counts: DataFrame, discount: float = DISCOUNT) -> BigramModel:
    """Interpolated Kneser-Ney: for every known context the probabilities of all known words sum to one."""
    kinds = counts.groupBy("word").agg(F.count(F.lit(1)).alias("contexts"))
    total = kinds.agg(F.sum("contexts").alias("total")).select("total", F.lit(0).alias("one"))
    words = kinds.withColumn("one", F.lit(0)).join(total, "one").select("word", (F.col("contexts") / F.col("total")).alias("p"))
    sums = counts.groupBy("before").agg(F.sum("n").alias("seen"), F.count(F.lit(1)).alias("kinds"))
    contexts = sums.select("before", "seen", (F.lit(discount) * F.col("kinds") / F.col("seen")).alias("rest"))
    pairs = join_on(join_on(counts, contexts, ["before"]), words, ["word"])
    own = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("seen")
    return BigramModel(pairs.select("before", "word", (own + F.col("rest") * F.col("p")).alias("p")), contexts.drop("seen"), words)


def with_probability(rows: DataFrame, model: BigramModel, before: str, word: str, out: str) -> DataFrame:
    """Adds the probability of ``word`` after ``before``; unknown contexts leave all to the words, unknown words get ``FLOOR``."""
    seen = model.pairs.select(F.col("before").alias(before), F.col("word").alias(word), F.col("p").alias("__pair"))
    rest = model.contexts.select(F.col("before").alias(before), F.col("rest").alias("__rest"))
    alone = model.words.select(F.col("word").alias(word), F.col("p").alias("__alone"))
    met = join_on(join_on(join_on(rows, seen, [before, word], "left"), rest, [before], "left"), alone, [word], "left")
    back = F.coalesce("__rest", F.lit(1.0)) * F.col("__alone")
    return met.withColumn(out, F.coalesce("__pair", back, F.lit(FLOOR))).drop("__pair", "__rest", "__alone")


def fill_spans(
    df: DataFrame, model: BigramModel, keys: Sequence[str], masked: str = "masked", best: int = 1, beam: int = BEAM, sentinel: str = SENTINEL
) -> DataFrame:
    """``keys, step, proposal, fill, score``: the ``best`` two-word fills of every text's first sentinel, from step 0.

    ``beam`` successors are tried after each word; the score is the sum of the logarithms of three probabilities.
    Texts without a sentinel, or whose word before it the model has never seen, get no proposal. Keys name one text.
    """
    t = pieces(F.col(masked))
    cut = df.select(*keys, t.alias("t")).withColumn("at", F.array_position("t", sentinel).cast("int")).where("at > 0")
    near = cut.select(
        *keys,
        F.lower(F.when(F.col("at") > 1, F.get("t", F.col("at") - 2)).otherwise(EDGE)).alias("left"),
        F.lower(F.coalesce(F.get("t", F.col("at")), F.lit(EDGE))).alias("right"),
    )
    likely = first_k(model.pairs.where(F.col("word") != EDGE), ["before"], [F.col("p").desc(), F.col("word")], beam).drop("rank")
    one = join_on(near, likely.select(F.col("before").alias("left"), F.col("word").alias("first"), F.col("p").alias("p1")), ["left"])
    two = join_on(one, likely.select(F.col("before").alias("first"), F.col("word").alias("second"), F.col("p").alias("p2")), ["first"])
    rated = with_probability(two, model, "second", "right", "p3")
    rated = rated.withColumn("score", F.log("p1") + F.log("p2") + F.log("p3"))
    top = first_k(rated, keys, [F.round("score", 9).desc(), F.col("first"), F.col("second")], best)
    filled = join_on(top.select(*keys, "rank", "first", "second", "score"), cut, keys)
    fill = F.concat_ws(" ", "first", "second")
    rest = F.slice("t", F.col("at") + 1, F.size("t"))
    proposal = F.array_join(F.concat(F.slice("t", F.lit(1), F.col("at") - 1), F.array(fill), rest), " ")
    return filled.select(*keys, (F.col("rank") - 1).alias("step"), proposal.alias("proposal"), fill.alias("fill"), "score")
