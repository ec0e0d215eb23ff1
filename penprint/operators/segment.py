"""Cleaning, splitting and selecting text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.functions import text as tx
from penprint.plans.keys import explode, first_k, join_on, running_totals


def clean_text(df: DataFrame, text: str = "text", out: str | None = None, any_case: bool = False) -> DataFrame:
    return df.withColumn(out or text, tx.clean(F.col(text), any_case))


def merge_posts(df: DataFrame, author: str = "author", seq: str = "seq", text: str = "text") -> DataFrame:
    """Each author's posts as one text, in pieces.

    The merged text is the posts joined by one space in ``seq`` order. It is kept as rows
    ``(author, seq, start, text)`` with the place of each piece in the whole, so that an author of
    any size stays spread over the cluster. Joining the pieces in order gives the one string. Posts
    without an order come last, posts of equal order follow each other by their text.
    """
    pieces = df.select(author, seq, F.coalesce(F.col(text), F.lit("")).alias(text))
    sized = pieces.withColumn("__len", F.length(text) + 1)
    return running_totals(sized, author, seq, {"start": "__len"}, ties=[text]).select(author, seq, "start", text)


def head_chars(
    df: DataFrame, limit: int | None, author: str = "author", seq: str = "seq", text: str = "text"
) -> DataFrame:
    """The posts cut to the first ``limit`` characters of each author's merged text.

    ``None`` leaves the texts whole.
    """
    if limit is None:
        return df.select(author, seq, text)
    pieces = merge_posts(df, author, seq, text).where(F.col("start") < limit)
    kept = F.expr(f"substring({text}, 1, int({limit} - start))")
    return pieces.select(author, seq, kept.alias(text))


def split_sentences(df: DataFrame, text: str = "text", keep_end: bool = False) -> DataFrame:
    """One row per sentence: every other column plus ``sent_id`` (from 0) and ``sentence``."""
    pieces = tx.sentences_with_end(F.col(text)) if keep_end else tx.sentences(F.col(text))
    rest = [c for c in df.columns if c != text]
    return explode(df, rest, pieces, "sentence", "sent_id")


def tokenize_words(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per lower-cased word with its position from 0."""
    rest = [c for c in df.columns if c != text]
    return explode(df, rest, tx.words(F.col(text)), "word", "pos")


def long_sentences(pieces: Column, more_than: int) -> Column:
    return F.filter(pieces, lambda s: tx.word_count_ws(s) > more_than)


def filter_short_sentences(df: DataFrame, text: str = "text", more_than: int = 5) -> DataFrame:
    """Sentence rows with more than ``more_than`` whitespace-separated words."""
    return split_sentences(df, text, keep_end=True).where(tx.word_count_ws(F.col("sentence")) > more_than)


def author_sentences(
    df: DataFrame,
    author: str = "author",
    seq: str = "seq",
    text: str = "text",
    wanted: int = 50,
    more_than: int = 5,
) -> DataFrame:
    """``(author_id, num_sentences, sentences)``: the first ``wanted`` long sentences per author.

    Authors with fewer long sentences than that are left out. Every task cuts its share to
    ``wanted`` rows per author before anything moves, and an author's array holds exactly
    ``wanted`` entries.
    """
    rows = filter_short_sentences(df.select(author, seq, text), text, more_than)
    first = first_k(rows, [author], [F.col(seq), F.col("sent_id")], wanted)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "sentence")))
    return (
        first.groupBy(F.col(author).cast("string").alias("author_id"))
        .agg(ordered.alias("s"))
        .where(F.size("s") == wanted)
        .select("author_id", F.size("s").alias("num_sentences"), F.col("s.sentence").alias("sentences"))
    )


def segment_request(df: DataFrame, text: str = "text", fewest: int = 5) -> DataFrame:
    """Segments of each request: its lines, or its sentences if there are fewer than ``fewest`` lines."""
    by_line = tx.lines(F.col(text))
    pieces = F.when(F.size(by_line) < fewest, tx.sentences(F.col(text))).otherwise(by_line)
    rest = [c for c in df.columns if c != text]
    return explode(df, rest, pieces, "segment", "seg_id")


def select_encoder_sentences(df: DataFrame, text: str = "text", limit: int = 5, more_than: int = 3) -> DataFrame:
    """``sentences``: the first ``limit`` long sentences of a text, or the whole text if it has none."""
    kept = F.slice(long_sentences(tx.sentences_with_end(F.col(text)), more_than), 1, limit)
    return df.withColumn("sentences", kept).withColumn(
        "sentences", F.when(F.size("sentences") == 0, F.array(F.col(text))).otherwise(F.col("sentences"))
    )


def select_user_sentences(
    df: DataFrame,
    author: str = "author",
    seq: str = "seq",
    sentence: str = "sentence",
    limit: int = 50,
    fewest: int = 5,
    more_than: int = 3,
) -> DataFrame:
    """A user's first ``limit`` usable sentences, one per row, with a ``status`` per user.

    Users with fewer than ``fewest`` keep their rows and are marked ``too_few_sentences``.
    """
    usable = df.where(tx.word_count_ws(F.col(sentence)) > more_than).withColumn(sentence, tx.strip(F.col(sentence)))
    first = first_k(usable.select(author, seq, sentence), [author], [F.col(seq)], limit)
    counts = usable.groupBy(author).agg(F.count(F.lit(1)).alias("usable"))
    status = F.when(F.coalesce(F.col("usable"), F.lit(0)) < fewest, "too_few_sentences").otherwise("ok")
    users = join_on(df.select(author).distinct(), counts, [author], "left").select(author, status.alias("status"))
    return join_on(users, first, [author], "left").select(author, "status", "rank", sentence)


def sample_caps(
    df: DataFrame, caps: dict[str, int | None], author: str = "author", seq: str = "seq", text: str = "text"
) -> DataFrame:
    """How much of each author's merged text a set of character caps lets through."""
    sizes = df.select(author, seq, F.length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("__size"))
    placed = running_totals(sizes.withColumn("__len", F.col("__size") + 1), author, seq, {"start": "__len"}, ties=["__size"])
    through = [
        F.sum(
            F.col("__size") if cap is None else F.least(F.col("__size"), F.greatest(F.lit(0), F.lit(cap) - F.col("start")))
        ).alias(name)
        for name, cap in caps.items()
    ]
    return placed.groupBy(author).agg(*through)


def strip_prompt_echo(df: DataFrame, output: str = "output", prompt: str = "prompt", out: str = "answer") -> DataFrame:
    return df.withColumn(out, tx.strip(F.replace(F.col(output), F.col(prompt), F.lit(""))))
