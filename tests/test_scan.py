"""Counting on arrays says what the JVM's expressions say, and n-grams that are ruled out could not have been among the first."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from penprint import lexicons as lx
from penprint.functions import text as tx
from penprint.operators import counters as ct
from penprint.operators import grams as gr
from penprint.operators import scan as sc
from penprint.operators import tokens as tk

PIECES = [
    "The", "WAS", "was", "painted", "ED", "Ed", "red", "will", " ", "\n", " ", "\x85", ".", "...", "?", "!", "?!", ",", ";", " - ", "- ", " -", "–", "…", "'",
    "don't", "a'b'c", "why ", "HOW could", "(", '"', "é", "İ", "ΟΔΟΣ", "\U0001d400", "\U0001f600", "日本", "٣", "_", "\0", "and", "AND", "because", "band", "very",
    "not", "good", "never", "kinda", "would you", "however", "quickly", "running", "12", "ABC", "Abc", "A",
]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        text = "".join(rng.choice(PIECES) + rng.choice(["", " "]) for _ in range(rng.choice([0, 1, 3, 8, 40])))
        rows.append((rng.choice(["a", "b", None]), rng.choice([i, i // 2, None]), None if i % 31 == 0 else text))
    return spark.createDataFrame(rows, "author string, seq long, text string").repartition(5).cache()


def counted(df):
    return sorted(map(str, df.collect()))


def test_counters_equal_the_expressions(odd):
    t = F.col("text")
    plain = {**ct.mark_counts(t), **ct.pattern_counts(t, F.lower(t))}
    bits = {f"{n}_bits": sum((F.when(F.contains(F.lower(t), F.lit(m)), 1 << i).otherwise(0) for i, m in enumerate(terms)), F.lit(0)) for n, terms in ct.MARKER_LISTS.items()}
    want = odd.select("author", *[c.cast("bigint").alias(n) for n, c in {**plain, **bits}.items()])
    assert counted(ct.text_counters(odd)) == counted(want)


@pytest.mark.parametrize("compat", [False, True])
def test_sentences_equal_the_expressions(odd, compat):
    s = F.col("s")
    rows = odd.select("author", F.explode(tx.fragments(F.col("text"))).alias("s")).where(s.rlike(tx.NON_SPACE))
    typed = rows.select("author", tx.word_count(s).cast("bigint").alias("n"), tx.sentence_type(s, compat).alias("type"))
    want = typed.groupBy("author").agg(*ct._sentence_aggregates(F.col("n"), F.col("type")))
    assert counted(ct.sentence_counters(odd, scope="document", compat=compat)) == counted(want)


def test_words_and_depths_equal_the_expressions(odd):
    words = odd.select("author", F.explode(tx.words(F.col("text"))).alias("word")).groupBy("author", "word").agg(F.count(F.lit(1)).alias("n"))
    assert counted(gr.vocabulary(odd)) == counted(words)
    sents = tk.split_rows(odd, "text")
    tags = F.transform(F.regexp_extract_all(F.lower(F.col("sentence")), F.lit(tk.TOKEN), F.lit(0)), tx.pos_tag)
    want = sents.select("author", "seq", "sent_id", tags.alias("tags")).select("author", "seq", "sent_id", tk.tree_depth(tk.rule_heads(F.col("tags"))).cast("bigint").alias("depth"))
    assert counted(tk.rule_depths(odd)) == counted(want)
    assert lx.ATTACH_RIGHT


@pytest.mark.parametrize("scope", ["corpus", "document"])
def test_ruled_out_terms_are_not_among_the_first(spark, odd, scope, monkeypatch):
    want = counted(gr.top_terms(gr.gram_counts(odd, gr.PROFILE_KINDS, scope=scope), gr.PROFILE_KINDS))
    monkeypatch.setattr(gr, "LARGE", 0)
    pruned = gr.gram_counts(odd, gr.PROFILE_KINDS, scope=scope, top=True)
    assert counted(gr.top_terms(pruned, gr.PROFILE_KINDS)) == want
    monkeypatch.setattr(gr, "TERMS", 3)
    assert counted(gr.top_terms(gr.gram_counts(odd, gr.PROFILE_KINDS, scope=scope, top=True), gr.PROFILE_KINDS)) == want


def test_rare_terms_of_a_large_table_are_ruled_out(spark):
    rows = [("a", i, "of the sea " * 20 + f"word{i} other{i} third{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "author string, seq long, text string").repartition(2)
    choice = gr._candidates(docs, [gr.Kind("t", "word", 3, 2)], "author", "seq", "text", True, None)
    assert choice.terms is not None and "of the sea" in choice.terms[0] and not any("word" in t and "third" in t for t in choice.terms[0])


def test_long_keys_are_counted_like_short_ones():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 50, 1000)
    small, large = sc.tally(keys, 50), sc.tally(keys, 2**62)
    assert all(np.array_equal(a, b) for a, b in zip(small, large))
    assert sc.numbered(keys * 10**15, 50 * 10**15)[1] == len(set(keys.tolist()))
