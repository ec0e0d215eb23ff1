"""Word counts, n-gram counts and ranked top-k lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penprint import lexicons as lx
from penprint.functions import text as tx
from penprint.operators import scan as sc
from penprint.operators.edges import place_edges, text_edges
from penprint.plans.keys import explode, first_k
from penprint.session import stored

POS_BITS = 31
# From so many characters on, what cannot be among the first k is found out before anything is sent.
LARGE = 8_000_000
# So many authors, and terms, are sent to every task at most.
AUTHORS, TERMS = 5_000, 500_000


@dataclass(frozen=True)
class Kind:
    """One sort of n-gram: ``unit`` is ``word`` or ``char``."""

    name: str
    unit: str
    n: int
    k: int


CONTENT_WORDS = Kind("top_words", "word", 1, 20)
BIGRAMS = Kind("top_bigrams", "word", 2, 15)
TRIGRAMS = Kind("top_trigrams", "word", 3, 10)
CHAR_TRIGRAMS = Kind("top_char_trigrams", "char", 3, 10)
CHAR_FOURGRAMS = Kind("top_char_fourgrams", "char", 4, 10)
PROFILE_KINDS = [CONTENT_WORDS, BIGRAMS, TRIGRAMS, CHAR_TRIGRAMS, CHAR_FOURGRAMS]


def vocabulary(df: DataFrame, author: str = "author", text: str = "text") -> DataFrame:
    """``(author, word, n)``. Tasks count their own words first, so only distinct words move."""
    borders = sc.classes(df.sparkSession)["word"]

    def work(part: pa.RecordBatch, texts: list[str]) -> Iterator[list]:
        _, _, number, authors = sc.grouped_by_author(part, texts, 0)
        chunk = sc.Chunk(texts, borders)
        starts, ends = chunk.words()
        ids, distinct = sc.coded_words(chunk, starts, ends)
        size = max(len(distinct), 1)
        keys, n, _, _ = sc.tally(number[chunk.text_of(starts)] * size + ids, len(authors) * size)
        yield [sc.taken(authors, keys // size), sc.taken(distinct, keys % size), n]

    schema = T.StructType([df.schema[author], T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    low = df.select(author, F.lower(F.col(text)).alias("__low"))
    return sc.counted(low, "__low", schema, work).groupBy(author, "word").agg(F.sum("n").alias("n"))


def is_content_word(word: Column) -> Column:
    return ~word.isin(lx.STOP_WORDS) & (F.length(word) > 3)


def content_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Word rows that are longer than three characters and no stop words."""
    rest = [c for c in df.columns if c != text]
    rows = explode(df, rest, tx.words(F.col(text)), "word")
    return rows.where(is_content_word(F.col("word")))


def _is_narrow(df: DataFrame, seq: str) -> bool:
    """Whether every order and a place in a text fit into one long integer together. Reads that column alone."""
    if df.isStreaming or df.schema[seq].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return False
    low, high = df.agg(F.min(seq), F.max(seq)).first()
    return low is None or (low >= 0 and high < 1 << POS_BITS)


def _is_large(df: DataFrame, text: str) -> bool:
    return not df.isStreaming and (df.agg(F.sum(F.length(text))).first()[0] or 0) >= LARGE


def _place(seq: str, pos: Column, narrow: bool = False) -> Column:
    """Order of first occurrence in one number, so that the aggregation stays a hash aggregation.

    Any order fits, and a place in an array is below ``2**POS_BITS``. Texts without an order come last. Decimals cost
    several times as much as long integers, which do where orders are ``narrow``.
    """
    if narrow:
        return F.shiftleft(F.coalesce(F.col(seq).cast("bigint"), F.lit(1 << POS_BITS)), POS_BITS) + pos
    s = F.coalesce(F.col(seq).cast("decimal(20,0)"), F.lit(str(2**63)).cast("decimal(20,0)"))
    return (s * F.lit(1 << POS_BITS).cast("decimal(10,0)") + pos.cast("decimal(10,0)")).cast("decimal(32,0)")


@dataclass(frozen=True)
class Choice:
    """Which of its counted n-grams a part of the texts sends; all of them by default."""

    # The most frequent ones, so many per author and kind.
    best: int = 0
    # ``(author, place of the kind) -> n``: those that the part holds so often.
    least: dict | None = None
    # Per kind the terms to be counted, for all authors.
    terms: list[list[str]] | None = None

    def numbers(self, authors: list, kinds: int) -> np.ndarray | None:
        return None if self.least is None else np.array([[self.least.get((a, k), 1) for k in range(kinds)] for a in authors]).reshape(-1, kinds)


def _grams(df: DataFrame, kinds: list[Kind], author: str, seq: str, text: str, narrow: bool, choice: Choice = Choice()) -> DataFrame:
    """Every n-gram that lies within one text: ``(author, kind, term, n, first)``, counted by every task for itself.

    ``kind`` is a place in the list of kinds. Of characters only the longest n-grams are counted from the text; a shorter
    one is the beginning of a longer one or of the rest at the end of a text. Where ``choice`` is by frequency, rows of
    kind -1 say in how many parts an author is met.
    """
    borders = sc.classes(df.sparkSession)["word"]
    words = sorted((kind.n, i) for i, kind in enumerate(kinds) if kind.unit == "word")
    chars = sorted((kind.n, i) for i, kind in enumerate(kinds) if kind.unit == "char")
    shared = df.sparkSession.sparkContext.broadcast(choice)

    def work(part: pa.RecordBatch, texts: list[str]) -> Iterator[list]:
        part, texts, number, authors = sc.grouped_by_author(part, texts, 0, order=2)
        chunk, choice = sc.Chunk(texts, borders), shared.value
        order = part.column(2).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        fresh = np.concatenate([[True], (np.diff(number) != 0) | (np.diff(order) != 0)])
        # Texts of an author with equal orders share a rank, and then the first place need not be the least one.
        rank, ranked, tied = np.cumsum(fresh) - 1, np.flatnonzero(fresh), not fresh.all()
        least = choice.numbers(authors.to_pylist(), len(kinds))

        def rows(kind: int, place: np.ndarray, n: np.ndarray, terms: Callable[[np.ndarray], pa.Array]) -> list:
            by = number[ranked[place >> POS_BITS]]
            kept = np.arange(len(n))
            if choice.best:
                kept = np.lexsort((-n, by))
                begin = np.flatnonzero(np.diff(by[kept], prepend=-1))
                kept = kept[np.arange(len(kept)) - np.repeat(begin, np.diff(begin, append=len(kept))) < choice.best]
            elif least is not None:
                kept = np.flatnonzero(n >= least[by, kind])
            shown = terms(kept)
            if choice.terms is not None:
                hit = np.flatnonzero(pc.is_in(shown, pa.array(choice.terms[kind], shown.type)).to_numpy(zero_copy_only=False))
                kept, shown = kept[hit], shown.take(pa.array(hit))
            at, pos = ranked[place[kept] >> POS_BITS], place[kept] & ((1 << POS_BITS) - 1)
            places = [part.column(1).take(pa.array(at)), pos] if not narrow else [(part.column(1).to_numpy()[at] << POS_BITS) + pos]
            return [sc.taken(authors, by[kept]), np.full(len(kept), kind, np.int32), shown, n[kept], *places]

        if words:
            yield from _word_rows(chunk, number, len(authors), rank, tied, words, rows, choice, least)
        if chars:
            yield from _char_rows(chunk, number, len(authors), rank, tied, chars, rows)
        if choice.best or least is not None:
            met = len(authors)
            places = [np.zeros(met, np.int64)] if narrow else [pa.nulls(met, part.column(1).type), np.zeros(met, np.int64)]
            yield [authors, np.full(met, -1, np.int32), pa.array([""] * met), np.ones(met, np.int64), *places]

    order = F.coalesce(F.col(seq).cast("bigint"), F.lit(1 << POS_BITS)) if narrow else F.col(seq)
    low = df.select(author, order.alias("__seq"), (order if narrow else order.cast("decimal(20,0)")).alias("__order"), F.lower(F.col(text)).alias("__low"))
    places = [T.StructField("first", T.LongType())] if narrow else [T.StructField("__seq", low.schema["__seq"].dataType), T.StructField("__pos", T.LongType())]
    schema = T.StructType([
        df.schema[author], T.StructField("kind", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), *places
    ])
    found = sc.counted(low, "__low", schema, work, least=["first"], merge=narrow)
    return found if narrow else found.select(author, "kind", "term", "n", _place("__seq", F.col("__pos")).alias("first"))


def _least(place: np.ndarray, at: np.ndarray, n: np.ndarray, order: np.ndarray, tied: bool) -> np.ndarray:
    """The least place of every group of a ``tally``; that of its first entry unless orders are tied."""
    if not tied or not len(n):
        return place[at]
    return np.minimum.reduceat(place[order], np.cumsum(n) - n)


def _word_rows(chunk, number, authors, rank, tied, kinds, rows, choice, least) -> Iterator[list]:
    starts, ends = chunk.words()
    ids, distinct = sc.coded_words(chunk, starts, ends)
    size = max(len(distinct), 1)
    of = chunk.text_of(starts)
    by = number[of]
    place = (rank[of] << POS_BITS) + np.arange(len(of)) - np.searchsorted(starts, chunk.starts)[of]
    among = lambda words: pc.is_in(distinct, pa.array(words, distinct.type)).to_numpy(zero_copy_only=False)
    if least is not None:
        # No n-gram comes more often than its words do.
        number_of, many = sc.numbered(by * size + ids, authors * size)
        often = np.bincount(number_of, minlength=many)[number_of]
    for n, kind in kinds:
        fits = np.flatnonzero(of[n - 1 :] == of[: len(of) - n + 1]) if len(of) >= n else np.empty(0, np.int64)
        for k in range(n):
            if n == 1:
                shown = pc.and_(pc.greater(pc.utf8_length(distinct), 3), pc.invert(pc.is_in(distinct, pa.array(lx.STOP_WORDS, distinct.type))))
                fits = fits[shown.to_numpy(zero_copy_only=False)[ids[fits]]]
            if least is not None:
                fits = fits[often[fits + k] >= least[by[fits], kind]]
            if choice.terms is not None:
                fits = fits[among(list({t.split(" ")[k] for t in choice.terms[kind]}))[ids[fits + k]]]
        keys, most = by[fits], authors
        for k in range(n):
            if most * size >= 1 << 40:
                keys, most = sc.numbered(keys, most)
            keys, most = keys * size + ids[fits + k], most * size
        _, many, first, order = sc.tally(keys, most)

        def terms(kept: np.ndarray) -> pa.Array:
            parts = [sc.taken(distinct, ids[fits[first[kept]] + k]) for k in range(n)]
            return parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", distinct.type))

        yield rows(kind, _least(place[fits], first, many, order, tied), many, terms)


def _char_rows(chunk, number, authors, rank, tied, kinds, rows) -> Iterator[list]:
    longest, shortest = kinds[-1][0], kinds[0][0]
    kept = chunk.kind != sc.SPACE
    kept[chunk.ends] = False
    codes = chunk.codes[kept]
    before = np.concatenate([[0], np.cumsum(kept)])
    sizes = before[chunk.ends] - before[chunk.starts]
    of = np.repeat(np.arange(len(sizes)), sizes)
    pos = np.arange(len(codes)) - before[chunk.starts][of]
    # Characters by number, from 1; 0 stands behind the end of a text.
    member = np.zeros(int(codes.max()) + 2 if len(codes) else 1, bool)
    member[codes] = True
    ids = np.concatenate([np.cumsum(member)[codes], np.zeros(longest, np.int64)])
    size = int(member.sum()) + 1
    left = sizes[of] - pos
    at = np.flatnonzero(left >= shortest)
    keys, most = number[of[at]], authors
    for k in range(longest):
        if most * size >= 1 << 62:
            keys, most = sc.numbered(keys, most)
        following = ids[at + k] if k < shortest else np.where(left[at] > k, ids[at + k], 0)
        keys, most = keys * size + following, most * size
    _, many, first, order = sc.tally(keys, most)
    least = _least((rank[of[at]] << POS_BITS) + pos[at], first, many, order, tied)
    i = at[first]
    by = number[of[i]]
    # The longest n-grams are in order, so that those of one beginning are neighbours.
    for n, kind in kinds:
        long_enough = np.flatnonzero(left[i] >= n)
        j = i[long_enough]
        if not len(j):
            continue
        fresh = by[long_enough][1:] != by[long_enough][:-1]
        for k in range(n):
            fresh |= ids[j[1:] + k] != ids[j[:-1] + k]
        begin = np.concatenate([[0], np.flatnonzero(fresh) + 1])
        first_places, totals = np.minimum.reduceat(least[long_enough], begin), np.add.reduceat(many[long_enough], begin)
        yield rows(kind, first_places, totals, lambda kept: sc.to_strings(codes[j[begin[kept]][:, None] + np.arange(n)].ravel(), np.full(len(kept), n)))


def _across(placed: DataFrame, kinds: list[Kind], author: str, seq: str, narrow: bool) -> DataFrame:
    """n-grams that reach over the seam between an author's texts: ``(author, kind, term, n, first)``.

    Each text sends its last items to the places in the author's item sequence where they start
    an n-gram, and its first items to the n-1 places before it. The grouping key is the place, so
    a group holds at most n pieces and no author is gathered in one task. Only the longest n per
    unit is sent; shorter n-grams are beginnings of it.
    """
    longest = {u: max(k.n for k in kinds if k.unit == u) for u in sorted({k.unit for k in kinds if k.n > 1})}

    def piece(unit: str, start: Column, size: Column, text_piece: Column, local: Column) -> Column:
        return F.struct(
            F.lit(unit).alias("unit"),
            start.cast("bigint").alias("start"),
            size.cast("int").alias("size"),
            local.cast("bigint").alias("local"),
            text_piece.alias("piece"),
        )

    entries = []
    for u, n in longest.items():
        size, offset = F.col(f"{u}_size"), F.col(f"{u}_offset")
        for d in range(1, n):
            entries.append(
                F.when(
                    (size > 0) & (offset >= d),
                    piece(u, offset - d, F.least(size, F.lit(n - d)), F.get(f"{u}_first", F.lit(n - d - 1)), F.lit(None)),
                )
            )
            entries.append(
                F.when(size >= d, piece(u, offset + size - d, F.lit(d), F.get(f"{u}_last", F.lit(d - 1)), size - d))
            )
    sent = placed.select(author, seq, F.explode_outer(F.array(*entries)).alias("e")).where(F.col("e").isNotNull())
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).isNull().alias("late"), F.col(seq).alias("seq"), "e.local", "e.size", "e.piece")))
    grouped = sent.groupBy(author, "e.unit", "e.start").agg(ordered.alias("p"), F.sum("e.size").alias("have"))
    opened = grouped.where(F.size("p") > 1).select(
        author,
        "unit",
        "have",
        F.get("p", F.lit(0))["size"].alias("opening"),
        F.when(F.col("unit") == "word", F.array_join(F.col("p.piece"), " "))
        .otherwise(F.array_join(F.col("p.piece"), ""))
        .alias("joined"),
        F.get("p", F.lit(0))["seq"].alias("__seq"),
        F.get("p", F.lit(0))["local"].alias("__local"),
    )
    wanted = [(i, k) for i, k in enumerate(kinds) if k.n > 1]
    kind_rows = F.array(
        *[F.struct(F.lit(i).alias("kind"), F.lit(k.unit).alias("of"), F.lit(k.n).alias("size")) for i, k in wanted]
    )
    rows = opened.select("*", F.inline(kind_rows)).where(
        (F.col("unit") == F.col("of")) & (F.col("have") >= F.col("size")) & (F.col("opening") < F.col("size"))
    )
    term = F.when(F.col("unit") == "char", F.left("joined", F.col("size")))
    for _, k in wanted:
        if k.unit == "word":
            term = term.when(F.col("size") == k.n, F.substring_index("joined", " ", k.n))
    return rows.select(
        author,
        "kind",
        term.alias("term"),
        F.lit(1).cast("bigint").alias("n"),
        _place("__seq", F.col("__local"), narrow).alias("first"),
    )


def gram_counts(
    df: DataFrame,
    kinds: list[Kind],
    author: str = "author",
    seq: str = "seq",
    text: str = "text",
    scope: str = "corpus",
    placed: DataFrame | None = None,
    top: bool = False,
) -> DataFrame:
    """``(author, kind, term, n, first)`` for all kinds, with one shuffle of counted terms.

    ``first`` orders terms by first occurrence, as a long integer if all orders allow it. With ``scope='corpus'`` n-grams also run over the
    seams between an author's texts, as if the texts were joined by a space; with ``'document'``
    they stay within a text. ``placed`` are the texts' edges where they are at hand already. With ``top`` the counts are
    exact for all terms that can be among the first ``k`` of their kind, and others may be missing or too low.
    """
    narrow = _is_narrow(df, seq)
    seams = None
    if scope == "corpus" and any(kind.n > 1 for kind in kinds):
        placed = place_edges(text_edges(df, author, seq, text), author, seq) if placed is None else placed
        seams = _across(placed, kinds, author, seq, narrow)
    choice = Choice()
    if top and df.schema[author].dataType.typeName() in ("string", "byte", "short", "integer", "long") and _is_large(df, text):
        if seams is not None:
            seams = stored(_summed(seams, author), "seams")
        choice = _candidates(df, kinds, author, seq, text, narrow, seams)
    parts = [_grams(df, kinds, author, seq, text, narrow, choice), *([] if seams is None else [seams])]
    names = F.array(*[F.lit(kind.name) for kind in kinds])
    return _summed(reduce(DataFrame.unionByName, parts), author).withColumn("kind", F.get(names, F.col("kind")))


def _summed(counts: DataFrame, author: str) -> DataFrame:
    return counts.groupBy(author, "kind", "term").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def _candidates(df: DataFrame, kinds: list[Kind], author: str, seq: str, text: str, narrow: bool, seams: DataFrame | None) -> Choice:
    """The terms that can be among the first ``k``, or every term if that rules out too few.

    The texts are read in parts. Sums of each part's most frequent terms give a count that the ``k``-th term of an author
    reaches at least. A term that comes less often than an equal share of it in every part stays below that count
    (Cao and Wang 2004); the seams are one more part.
    """
    most = max(kind.k for kind in kinds)
    best = _summed(_grams(df, kinds, author, seq, text, narrow, Choice(best=4 * most)), author)
    ranked = first_k(best, [author, "kind"], [F.col("n").desc()], most)
    kth = F.col("kind") == -1
    for i, kind in enumerate(kinds):
        kth = kth | ((F.col("kind") == i) & (F.col("rank") == kind.k))
    bounds = ranked.where(kth).limit(AUTHORS * (len(kinds) + 1) + 1).collect()
    parts = {r[author]: r["n"] for r in bounds if r["kind"] == -1}
    if len(parts) > AUTHORS or len(bounds) > AUTHORS * (len(kinds) + 1):
        return Choice()
    least = {(r[author], r["kind"]): -(-r["n"] // (parts[r[author]] + 1)) for r in bounds if r["kind"] >= 0}
    sent = stored(_grams(df, kinds, author, seq, text, narrow, Choice(least=least)).select(author, "kind", "term", "n"), "often")
    met = sent.where("kind = -1").groupBy(author).agg(F.sum("n").alias("n")).collect()
    if any(r["n"] > parts.get(r[author], 0) for r in met):
        return Choice()  # the texts came in other parts
    found = sent.where("kind >= 0").select("kind", "term")
    if seams is not None:
        rows = [(a, k, n) for (a, k), n in least.items()]
        schema = T.StructType([T.StructField("__a", df.schema[author].dataType), T.StructField("__k", T.IntegerType()), T.StructField("__n", T.LongType())])
        bound = F.broadcast(df.sparkSession.createDataFrame(rows, schema))
        near = seams.join(bound, seams[author].eqNullSafe(bound["__a"]) & (seams["kind"] == bound["__k"]), "left")
        found = found.union(near.where(F.col("n") >= F.coalesce("__n", F.lit(1))).select("kind", "term"))
    terms = found.distinct().limit(TERMS + 1).collect()
    if len(terms) > TERMS:
        return Choice()
    return Choice(terms=[[r["term"] for r in terms if r["kind"] == i] for i in range(len(kinds))])


def top_terms(counts: DataFrame, kinds: list[Kind], author: str = "author") -> DataFrame:
    """``(author, kind, rank, term, n)``: most frequent first, ties by first occurrence."""
    limit = max(kind.k for kind in kinds)
    ranked = first_k(counts, [author, "kind"], [F.col("n").desc(), F.col("first")], limit)
    per_kind = F.lit(False)
    for kind in kinds:
        per_kind = per_kind | ((F.col("kind") == kind.name) & (F.col("rank") <= kind.k))
    return ranked.where(per_kind).select(author, "kind", "rank", "term", "n")


def vocabulary_with_first(df: DataFrame, author: str = "author", seq: str = "seq", text: str = "text") -> DataFrame:
    """``(author, term, n, first)``: the vocabulary with the order of first occurrence."""
    rows = explode(df, [author, seq], tx.words(F.col(text)), "term", "pos")
    return (
        rows.select(author, "term", _place(seq, F.col("pos"), _is_narrow(df, seq)).alias("first"))
        .groupBy(author, "term")
        .agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
    )


def approximate_richness(df: DataFrame, author: str = "author", text: str = "text", error: float = 0.01) -> DataFrame:
    """Distinct words over words with a sketch of the distinct count: one small sketch per author moves."""
    rows = explode(df, [author], tx.words(F.col(text)), "word")
    counted = rows.groupBy(author).agg(
        F.approx_count_distinct("word", error).alias("d"), F.count(F.lit(1)).alias("n")
    )
    return counted.select(author, tx.ratio(F.col("d"), F.col("n")).alias("vocabulary_richness"))
