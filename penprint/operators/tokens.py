"""Annotated tokens: tags, tenses and head links by rule, or supplied by the user."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penprint import lexicons as lx
from penprint.functions import text as tx
from penprint.operators import scan as sc
from penprint.plans.keys import explode, first_k

TOKEN = f"{tx.WORD}|[^{tx.WORD_CLASS}{tx.SPACE_CHARS}]"
POS_FIELDS = {
    "adjective_ratio": "ADJ",
    "adverb_ratio": "ADV",
    "noun_ratio": "NOUN",
    "verb_ratio": "VERB",
    "pronoun_ratio": "PRON",
    "determiner_ratio": "DET",
    "preposition_ratio": "ADP",
}


def annotate_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per word or mark: ``sent_id, tok_id`` (from 1), ``word, pos, tense``."""
    sents = split_rows(df, text)
    rest = [c for c in sents.columns if c != "sentence"]
    tokens = F.regexp_extract_all(F.lower(F.col("sentence")), F.lit(TOKEN), F.lit(0))
    rows = explode(sents, rest, tokens, "word", "tok_id")
    tagged = rows.withColumn("tok_id", F.col("tok_id") + 1).withColumn("pos", tx.pos_tag(F.col("word")))
    return tagged.withColumn("tense", tx.verb_tense(F.col("word"), F.col("pos")))


def split_rows(df: DataFrame, text: str) -> DataFrame:
    rest = [c for c in df.columns if c != text]
    return explode(df, rest, tx.sentences_with_end(F.col(text)), "sentence", "sent_id")


def rule_heads(tags: Column) -> Column:
    """Head places (from 0) of a sentence by rule, from its tags.

    The first verb is the root, else the first noun, else the first token. Determiners, adjectives,
    numbers, prepositions, auxiliaries, adverbs and particles hang on their right neighbour, all
    other tokens on the root.
    """
    verb, noun = F.array_position(tags, "VERB"), F.array_position(tags, "NOUN")
    root = (F.when(verb > 0, verb).when(noun > 0, noun).otherwise(F.lit(1)) - 1).cast("int")
    found = F.struct(tags.alias("tags"), root.alias("root"), (F.size(tags) - 1).alias("last"))
    return _once(
        found,
        lambda s: F.transform(
            s["tags"],
            lambda tag, i: F.when(i == s["root"], s["root"])
            .when(tag.isin(lx.ATTACH_RIGHT) & (i < s["last"]), i + 1)
            .otherwise(s["root"]),
        ),
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``; a lambda over an array of one entry, since lambdas work out outer columns for every entry anew."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tree_depth(heads: Column) -> Column:
    """Edges from the first root to its deepest descendant, for an array of head places (from 0).

    A root is its own head. Links are followed by doubling: each round every token jumps to its
    ancestor's ancestor, so a sentence of n tokens needs about log2(n) rounds.
    """
    start = F.transform(
        heads, lambda h, i: F.struct(h.cast("int").alias("up"), F.when(h == i, 0).otherwise(1).alias("far"))
    )
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.size(heads) + 1)).cast("int")))

    def jump(links, _):
        return F.transform(
            links,
            lambda x: F.struct(
                F.get(links, x["up"])["up"].alias("up"), (x["far"] + F.get(links, x["up"])["far"]).alias("far")
            ),
        )

    linked = F.aggregate(rounds, start, jump)
    roots = F.filter(F.transform(heads, lambda h, i: F.when(h == i, i)), lambda r: r.isNotNull())
    return _once(
        F.get(roots, F.lit(0)),
        lambda root: F.array_max(F.transform(F.filter(linked, lambda x: x["up"] == root), lambda x: x["far"])),
    )


def sentence_depths(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Depth per sentence of a token table with ``tok_id`` and ``head_id`` from 1.

    ``keys`` name one sentence. Its tokens are gathered into one array, which is never larger than
    the text the sentence came from.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col("tok_id").cast("int").alias("tok_id"), F.col("head_id").cast("int").alias("head_id"))))
    heads = F.transform("t", lambda x: x["head_id"] - 1)
    return (
        tokens.groupBy(*keys).agg(ordered.alias("t")).select(*keys, tree_depth(heads).cast("bigint").alias("depth"))
    )


_LISTED = {w: tag for tag, words in lx.POS_WORDS.items() for w in words}


@lru_cache(maxsize=200_000)
def word_tag(word: str, numbers: bytes) -> str:
    """``tx.pos_tag`` of a word."""
    if word in _LISTED:
        return _LISTED[word]
    for name, before, endings in lx.POS_ENDINGS:
        if any(word.endswith(e) and len(word) >= len(e) + before for e in endings):
            return name
    return "NUM" if sc.members(numbers)[[ord(c) for c in word]].all() else "NOUN"


def lowered(text: Column) -> Column:
    """Lower-cased text that splits into the lower-cased sentences of the text.

    How a sigma at the end of a word is written depends on what follows, so sentences with one are lower-cased alone.
    """
    alone = F.concat_ws("", F.transform(tx.sentences_with_end(text), lambda s: F.concat(F.lit(" "), F.lower(s))))
    return F.when(F.contains(text, F.lit("\u03a3")), alone).otherwise(F.lower(text))


@dataclass
class Laid:
    """The sentences of some texts, their tokens laid end to end."""

    # The text of every sentence, and its number there.
    of: np.ndarray
    sent_id: np.ndarray
    # Where the tokens of each sentence begin, and the end of the last.
    offsets: np.ndarray
    # Tokens as places in the list of distinct ones; marks come behind the words.
    ids: np.ndarray
    words: pa.Array
    marks: list[str]

    @property
    def sentence(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of)), np.diff(self.offsets))

    def tags(self, numbers: bytes) -> np.ndarray:
        """``tx.pos_tag`` of every token."""
        found = [word_tag(w, numbers) for w in self.words.to_pylist()] + ["PUNCT"] * len(self.marks)
        return np.array(found, object)[self.ids] if len(self.ids) else np.empty(0, object)

    def roots(self, tags: np.ndarray) -> np.ndarray:
        """The first verb of every sentence, else its first noun, else its first token."""

        def first(tag: str) -> np.ndarray:
            places = np.append(np.flatnonzero(tags == tag), len(tags))
            return places[np.searchsorted(places, self.offsets[:-1])]

        verb, noun, end = first("VERB"), first("NOUN"), self.offsets[1:]
        return np.where(verb < end, verb, np.where(noun < end, noun, self.offsets[:-1]))


def lay_out(texts: list[str], borders: bytes) -> Laid:
    """The sentences and tokens of lower-cased texts."""
    chunk = sc.Chunk(texts, borders)
    starts, ends = chunk.words()
    ids, distinct = sc.coded_words(chunk, starts, ends)
    other = (chunk.kind != sc.WORD) & (chunk.kind != sc.SPACE)
    other[chunk.ends] = False
    places = np.flatnonzero(other)
    marks, number = np.unique(chunk.codes[places], return_inverse=True)
    at = np.concatenate([starts, places])
    order = np.argsort(at, kind="stable")
    at, ids = at[order], np.concatenate([ids, number + len(distinct)])[order]
    # A sentence is a piece that is not empty with the stops behind it.
    begin, end, of = chunk.fragments()
    till = np.where(np.append(of[1:] == of[:-1], False), np.append(begin[1:], 0), chunk.ends[of]) if len(of) else end
    head, tail = np.searchsorted(at, begin), np.searchsorted(at, till)
    some = (end > begin) & (tail > head)
    head, tail, of = head[some], tail[some], of[some]
    offsets = np.concatenate([[0], np.cumsum(tail - head)])
    kept = np.arange(offsets[-1]) + np.repeat(head - offsets[:-1], tail - head)
    return Laid(of, np.arange(len(of)) - np.searchsorted(of, of), offsets, ids[kept], distinct, [chr(c) for c in marks])


def rule_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per word or mark with tag and head by rule: the other columns, ``sent_id, tok_id, word, pos, head_id``."""
    found = sc.classes(df.sparkSession)
    rest = [c for c in df.columns if c != text]

    def work(part: pa.RecordBatch, texts: list[str]) -> Iterator[list]:
        laid = lay_out(texts, found["word"])
        tags, sentence = laid.tags(found["number"]), laid.sentence
        root, last = laid.roots(tags)[sentence], laid.offsets[1:][sentence] - 1
        place, first = np.arange(len(tags)), laid.offsets[:-1][sentence]
        hangs = np.isin(tags.astype(str), lx.ATTACH_RIGHT) & (place != root) & (place < last)
        names = pa.concat_arrays([laid.words, pa.array(laid.marks, laid.words.type)])
        columns = [laid.sent_id[sentence], place - first + 1, sc.taken(names, laid.ids), pa.array(tags, pa.string()), np.where(hangs, place + 1, root) - first + 1]
        yield [*(c.take(pa.array(laid.of[sentence])) for c in part.columns[:-1]), *columns]

    numbers = [T.StructField(n, T.IntegerType()) for n in ("sent_id", "tok_id")]
    made = [*numbers, T.StructField("word", T.StringType()), T.StructField("pos", T.StringType()), T.StructField("head_id", T.IntegerType())]
    schema = T.StructType([*(df.schema[c] for c in rest), *made])
    return sc.counted(df.select(*rest, lowered(F.col(text)).alias("__low")), "__low", schema, work, sums=[], merge=False)


def rule_depths(
    df: DataFrame, text: str = "text", first: int | None = None, author: str = "author", seq: str = "seq"
) -> DataFrame:
    """Depth per sentence by the attachment rule, without moving any token.

    With ``first`` only an author's first so many sentences are measured.

    Under that rule only runs of right-hanging tokens make a tree deeper: a run ending in the root is as deep as it is
    long, a run ending in any other token one deeper.
    """
    if first is not None:
        sents = first_k(split_rows(df, text), [author], [F.col(seq), F.col("sent_id")], first)
        df, text = sents.withColumnRenamed("sentence", "__sentence"), "__sentence"
    found = sc.classes(df.sparkSession)
    rest = [c for c in df.columns if c != text]

    def work(part: pa.RecordBatch, texts: list[str]) -> list:
        laid = lay_out(texts, found["word"])
        return [*(c.take(pa.array(laid.of)) for c in part.columns[:-1]), *([laid.sent_id] if first is None else []), _depths(laid, found["number"])]

    numbered = [T.StructField("sent_id", T.IntegerType())] if first is None else []
    schema = T.StructType([*(df.schema[c] for c in rest), *numbered, T.StructField("depth", T.LongType())])
    return sc.mapped(df.select(*rest, lowered(F.col(text)).alias("__low")), "__low", schema, work)


def _depths(laid: Laid, numbers: bytes) -> np.ndarray:
    if not len(laid.of):
        return np.empty(0, np.int64)
    tags = laid.tags(numbers)
    right = np.isin(tags.astype(str), lx.ATTACH_RIGHT)
    right[laid.offsets[1:] - 1] = False
    root = laid.roots(tags)
    right[root] = False
    # How many right-hanging tokens stand before each other token of its sentence.
    held = np.flatnonzero(~right)
    sentence = np.searchsorted(laid.offsets, held, "right") - 1
    before = np.concatenate([[-1], held[:-1]])
    depth = held - np.maximum(before, laid.offsets[sentence] - 1) - 1 + 1
    depth[np.searchsorted(held, root)] -= 1
    return np.maximum.reduceat(depth, np.flatnonzero(np.diff(sentence, prepend=-1)))


def depth_fields(depths: DataFrame, author: str = "author") -> DataFrame:
    return depths.groupBy(author).agg(
        F.sum("depth").alias("depth_sum"), F.count("depth").alias("n_trees"), F.max("depth").alias("depth_max")
    )


def pos_ratios(tokens: DataFrame, author: str = "author") -> DataFrame:
    """Shares of seven tags among all tokens, marks included."""
    return tokens.groupBy(author).agg(
        *[
            tx.ratio(F.sum((F.col("pos") == tag).cast("int")), F.count(F.lit(1))).alias(name)
            for name, tag in POS_FIELDS.items()
        ]
    )


def tense_ratios(tokens: DataFrame, author: str = "author") -> DataFrame:
    """Present and past shares among the verbs that have a tense."""
    timed = F.sum(F.when((F.col("pos") == "VERB") & F.col("tense").isNotNull(), 1).otherwise(0))

    def share(name: str) -> Column:
        hit = (F.col("pos") == "VERB") & F.col("tense").contains(name)
        return tx.ratio(F.sum(F.when(hit, 1).otherwise(0)), timed)

    return tokens.groupBy(author).agg(
        share("Pres").alias("present_tense_ratio"), share("Past").alias("past_tense_ratio")
    )


def concreteness(tokens: DataFrame, author: str = "author") -> DataFrame:
    def count(*tags: str) -> Column:
        return F.sum(F.when(F.col("pos").isin(list(tags)), 1).otherwise(0))

    counts = tokens.groupBy(author).agg(
        count("NOUN", "PROPN", "NUM").alias("c"), count("ADJ", "ADV").alias("a"), F.count(F.lit(1)).alias("n")
    )
    return counts.select(author, concreteness_value(F.col("c"), F.col("a"), F.col("n")).alias("concreteness_score"))


def concreteness_value(concrete: Column, abstract: Column, tokens: Column) -> Column:
    c, a = tx.ratio(concrete, tokens), tx.ratio(abstract, tokens)
    return F.when(tokens == 0, 0.5).otherwise(F.least(c / (c + a + 0.1), F.lit(1.0)))
