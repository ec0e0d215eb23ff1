"""Additive integer counters per text. Sums of them give an author's ratios exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penprint import lexicons as lx
from penprint.functions import text as tx
from penprint.operators import scan as sc
from penprint.operators.edges import AUXILIARIES, place_edges, text_edges
from penprint.plans.keys import explode, first_k, join_on

# counter -> the literals whose occurrences it adds up
MARKS = {
    "n_comma": [","],
    "n_semicolon": [";"],
    "n_colon": [":"],
    "n_dash": ["—", "–", " - "],
    "n_ellipsis": ["...", "…"],
    "n_paren": ["("],
    "n_quote": ['"', "'"],
    "n_double_quote": ['"'],
    "n_exclamation": ["!"],
    "n_question": ["?"],
    # Every character of the fixed class  , ; : — – - ! ? . ( ) " '
    "n_punct": [",", ";", ":", "—", "–", "-", "!", "?", ".", "(", ")", '"', "'"],
}

SENTENCE_COUNTERS = ["n_sentences", "sent_words", "sent_words_sq", "n_simple", "n_compound", "n_complex"]
PASSIVE = f"(?i)(?=[bw]){tx.NOT_AFTER_WORD}({'|'.join(AUXILIARIES)}){tx.SPACE}+{tx.WORD}ed{tx.NOT_BEFORE_WORD}"
ALL_CAPS = f"(?=[A-Z]){tx.NOT_AFTER_WORD}[A-Z]{{2,}}{tx.NOT_BEFORE_WORD}"
TITLE_CASE = f"(?=[A-Z]){tx.NOT_AFTER_WORD}[A-Z][a-z]+{tx.NOT_BEFORE_WORD}"
CONTRACTION = f"{tx.WORD}'{tx.WORD}"
ASKING_SENTENCE = r"[^.!?]+[.!]*\?[.!?]*"


def mark_counts(text: Column) -> dict[str, Column]:
    """Counts of punctuation marks."""
    out = {}
    for name, pieces in MARKS.items():
        total = tx.count_of(text, pieces[0])
        for piece in pieces[1:]:
            total = total + tx.count_of(text, piece)
        out[name] = total
    return out


def pattern_counts(text: Column, low: Column) -> dict[str, Column]:
    """Counts of voice, tense, case and question patterns; ``low`` is the lower-cased text."""
    asking = F.filter(
        F.regexp_extract_all(text, F.lit(ASKING_SENTENCE), F.lit(0)),
        lambda s: s.rlike(tx.any_of(lx.RHETORICAL)),
    )
    return {
        "n_passive": F.regexp_count(text, F.lit(PASSIVE)),
        "n_will": tx.count_of(low, "will "),
        "n_contractions": F.when(F.contains(text, F.lit("'")), F.regexp_count(text, F.lit(CONTRACTION))).otherwise(0),
        "n_all_caps": F.regexp_count(text, F.lit(ALL_CAPS)),
        "n_title_case": F.regexp_count(text, F.lit(TITLE_CASE)),
        "n_other_tokens": F.regexp_count(text, F.lit(f"[^{tx.WORD_CLASS}{tx.SPACE_CHARS}]")),
        "n_rhetorical": F.when(F.contains(text, F.lit("?")), F.size(asking)).otherwise(0),
    }


def _sentence_sums(df: DataFrame, author: str, text: str, compat: bool, inner: bool) -> DataFrame:
    """Sentence counters per author, of the sentences that lie wholly within a text or of all."""
    borders = sc.classes(df.sparkSession)["word"]

    def work(part: pa.RecordBatch, texts: list[str]) -> list:
        chunk = sc.Chunk(texts, borders)
        begin, end, of = chunk.fragments()
        real, n, conj, sub, pause = sentence_marks(chunk, begin, end, compat)
        if inner:
            ends = np.concatenate([[True], of[1:] != of[:-1]])
            real &= ~(ends | np.concatenate([ends[1:], [True]]))
        complex_ = sub | (conj & pause) if compat else sub
        compound = conj & pause & ~complex_
        kept = {"simple": real & ~complex_ & ~compound, "compound": real & compound, "complex": real & complex_}
        add = lambda flags, values=None: np.bincount(of[flags], None if values is None else values[flags], len(texts)).astype(np.int64)
        # Squares are added as whole numbers.
        squares = np.concatenate([[0], np.cumsum(np.where(real, n * n, 0))])
        first = np.searchsorted(of, np.arange(len(texts) + 1))
        sums = [add(real), add(real, n), squares[first[1:]] - squares[first[:-1]], *map(add, kept.values())]
        some = np.flatnonzero(sums[0])
        return [part.column(0).take(pa.array(some)), *(x[some] for x in sums)]

    schema = T.StructType([df.schema[author], *(T.StructField(n, T.LongType()) for n in SENTENCE_COUNTERS)])
    return _sum_by(sc.mapped(df.select(author, text), text, schema, work), author, SENTENCE_COUNTERS)


def sentence_marks(chunk: sc.Chunk, begin: np.ndarray, end: np.ndarray, compat: bool) -> tuple[np.ndarray, ...]:
    """Of pieces of the texts: has more than white space, number of words, has conjunction, subordinator, comma or semicolon."""
    starts, ends = chunk.words()
    nonspace = chunk.nonspace()
    low, whole = sc.ascii_lower(chunk.codes), chunk.last_parts(starts, ends)

    def has(terms: list[str]) -> np.ndarray:
        if not compat:
            return sc.between(starts[sc.listed(low, whole, ends, terms)], begin, end) > 0
        return np.any([sc.between(sc.find(low, t), begin, np.maximum(end - len(t) + 1, begin)) > 0 for t in terms], axis=0)

    pauses = np.flatnonzero((chunk.codes == ord(",")) | (chunk.codes == ord(";")))
    return (
        nonspace[end] > nonspace[begin], sc.between(starts, begin, end), has(lx.CONJUNCTIONS), has(lx.SUBORDINATORS),
        sc.between(pauses, begin, end) > 0,
    )


def _sentence_aggregates(n: Column, kind: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_sentences"),
        F.sum(n).alias("sent_words"),
        F.sum(n * n).alias("sent_words_sq"),
        *[F.count(F.when(kind == t, 1)).alias(f"n_{t}") for t in ("simple", "compound", "complex")],
    ]


def _as_bigint(columns: dict[str, Column]) -> list[Column]:
    return [c.cast("bigint").alias(name) for name, c in columns.items()]


def _sum_by(df: DataFrame, author: str, names: list[str]) -> DataFrame:
    return df.groupBy(author).agg(*[F.sum(n).alias(n) for n in names])


def text_counters(df: DataFrame, author: str = "author", text: str = "text") -> DataFrame:
    """One row per text with mark, pattern and marker counters.

    The markers that occur anywhere in the text are kept as one bit each.
    """
    borders = sc.classes(df.sparkSession)["word"]
    t = F.col(text)
    # Without a text most counters are null.
    known = [*(n for n in _PATTERNS if n in ("n_contractions", "n_rhetorical")), *(f"{name}_bits" for name in MARKER_LISTS)]
    names = [*MARKS, *_PATTERNS, *(f"{name}_bits" for name in MARKER_LISTS)]

    def work(part: pa.RecordBatch, texts: list[str]) -> list:
        low = sc.strings(part.column(2))
        found = {**_mark_counts(sc.Chunk(texts, borders)), **_pattern_counts(sc.Chunk(texts, borders), sc.Chunk(low, borders))}
        for name, terms in MARKER_LISTS.items():
            found[f"{name}_bits"] = np.array([sum(1 << i for i, m in enumerate(terms) if m in x) for x in low], np.int64)
        void = part.column(1).is_null().to_numpy(zero_copy_only=False)
        return [part.column(0), *(pa.array(found[n].astype(np.int64), mask=None if n in known else void) for n in names)]

    both = df.select(author, text, F.lower(t).alias("__low"))
    schema = T.StructType([df.schema[author], *(T.StructField(n, T.LongType()) for n in names)])
    return sc.mapped(both, text, schema, work)


_PATTERNS = ["n_passive", "n_will", "n_contractions", "n_all_caps", "n_title_case", "n_other_tokens", "n_rhetorical"]
_SINGLE = sorted({piece for pieces in MARKS.values() for piece in pieces if len(piece) == 1})


def _mark_counts(chunk: sc.Chunk) -> dict[str, np.ndarray]:
    """``mark_counts`` of every text."""
    table = np.zeros(max(int(chunk.codes.max()), *map(ord, _SINGLE)) + 1, bool)
    table[[ord(c) for c in _SINGLE]] = True
    marked = np.flatnonzero(table[chunk.codes])
    codes = chunk.codes[marked]
    single = {c: chunk.per_text(marked[codes == ord(c)]) for c in _SINGLE}
    dots = sc.find(chunk.codes, ".")
    dashes = sc.find(chunk.codes, " - ")
    found = {**single, "...": _runs_of(chunk, dots, 1, 3), " - ": _runs_of(chunk, dashes, 2, 2)}
    return {name: sum(found[p] for p in pieces) for name, pieces in MARKS.items()}


def _runs_of(chunk: sc.Chunk, at: np.ndarray, step: int, size: int) -> np.ndarray:
    """Per text, matches without overlap among places that follow each other by ``step``.

    With a step of 1, ``size`` places make one match; otherwise matches overlap with the next one only.
    """
    fresh = np.flatnonzero(np.diff(at, prepend=-9) != step)
    runs = np.diff(fresh, append=len(at))
    matches = runs // size if step == 1 else (runs + 1) // 2
    return np.bincount(chunk.text_of(at[fresh]), matches, len(chunk.texts)).astype(np.int64)


def _pattern_counts(chunk: sc.Chunk, low: sc.Chunk) -> dict[str, np.ndarray]:
    """``pattern_counts`` of every text."""
    codes, small = chunk.codes, sc.ascii_lower(chunk.codes)
    starts, ends = chunk.words()
    whole, nonspace = chunk.last_parts(starts, ends), chunk.nonspace()
    # A passive is an auxiliary, white space only, and a word that ends in "ed".
    auxiliary = np.flatnonzero(sc.listed(small, whole, ends, AUXILIARIES)[:-1])
    gap = nonspace[starts[auxiliary + 1]] == nonspace[ends[auxiliary]]
    auxiliary = auxiliary[gap & (ends[auxiliary + 1] - starts[auxiliary + 1] > 2)]
    last = ends[auxiliary + 1] - 1
    passive = starts[auxiliary[(small[last] == ord("d")) & (small[last - 1] == ord("e"))]]
    # Apostrophes between words; a match takes the words on both sides of one.
    quotes = np.flatnonzero(codes == ord("'"))
    quotes = quotes[quotes > 0]
    quotes = quotes[(chunk.kind[quotes - 1] == sc.WORD) & (chunk.kind[quotes + 1] == sc.WORD)]
    after = ends[np.searchsorted(starts, quotes + 1)] if len(quotes) else quotes
    fresh = np.flatnonzero(np.concatenate([[True], after[:-1] != quotes[1:]])) if len(quotes) else quotes
    chains = np.diff(fresh, append=len(quotes))
    contractions = np.bincount(chunk.text_of(quotes[fresh]), (chains + 1) // 2, len(chunk.texts))
    capital = np.concatenate([[0], np.cumsum((codes >= 65) & (codes <= 90))])
    little = np.concatenate([[0], np.cumsum((codes >= 97) & (codes <= 122))])
    size, capitals = ends - whole, capital[ends] - capital[whole]
    titled = (size > 1) & (capitals == 1) & (capital[whole + 1] > capital[whole]) & (little[ends] - little[whole] == size - 1)
    other = np.concatenate([[0], np.cumsum((chunk.kind != sc.WORD) & (chunk.kind != sc.SPACE))])
    # A question asks by its words if a listed one is in it, whatever marks stand around its question mark.
    begin, end, of = chunk.fragments()
    asks = sc.find(codes, "?")
    following = np.where(np.append(of[1:] == of[:-1], False), np.append(begin[1:], 0), chunk.ends[of])
    question = np.flatnonzero((end > begin) & (sc.between(asks, end, following) > 0))
    begin, end, of = begin[question], end[question], of[question]
    rhetorical = np.zeros(len(question), bool)
    for term in lx.RHETORICAL:
        rhetorical |= sc.between(sc.find(small, term), begin, np.maximum(end - len(term) + 1, begin)) > 0
    return {
        "n_passive": chunk.per_text(passive),
        "n_will": low.per_text(sc.find(low.codes, "will ")),
        "n_contractions": contractions,
        "n_all_caps": chunk.per_text(starts[(size > 1) & (capitals == size)]),
        "n_title_case": chunk.per_text(starts[titled]),
        "n_other_tokens": other[chunk.ends] - other[chunk.starts],
        "n_rhetorical": np.bincount(of[rhetorical], minlength=len(chunk.texts)),
    }


MARKER_LISTS = {"discourse": lx.DISCOURSE, "politeness": lx.POLITENESS}


def _sql_text(term: str) -> str:
    return "'" + term.replace("'", "\\'") + "'"


def _from_bits(bits: str, terms: list[str]) -> Column:
    """The terms whose bits are set, sorted."""
    present = ", ".join(f"IF({bits} & {1 << i}L != 0, {_sql_text(t)}, NULL)" for i, t in enumerate(terms))
    return F.expr(f"array_sort(filter(array({present}), t -> t IS NOT NULL))")


def author_text_counters(df: DataFrame, author: str = "author", text: str = "text") -> DataFrame:
    """Mark and pattern counters summed per author, and the markers that occur at all.

    ``discourse_found`` and ``politeness_found`` are sorted arrays no longer than the lists.
    """
    counters = text_counters(df, author, text)
    sums = [c for c in counters.columns if c != author and not c.endswith("_bits")]
    grouped = counters.groupBy(author).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.bit_or(f"{m}_bits").alias(f"{m}_bits") for m in MARKER_LISTS]
    )
    found = [_from_bits(f"{m}_bits", terms).alias(f"{m}_found") for m, terms in MARKER_LISTS.items()]
    return grouped.select(author, *sums, *found)


def sentence_counters(
    df: DataFrame,
    author: str = "author",
    seq: str = "seq",
    text: str = "text",
    scope: str = "corpus",
    compat: bool = False,
    placed: DataFrame | None = None,
) -> DataFrame:
    """Sentence counters per author.

    With ``scope='document'`` a text ends its last sentence. With ``'corpus'`` the texts of an
    author count as joined by a space, so a text without a final stop runs on into the next one.
    Sentences inside a text are counted where they are; only the first and last fragment of each
    text move, keyed by the number of the sentence they belong to.
    """
    if scope == "document":
        return _sentence_sums(df, author, text, compat, inner=False)
    inside = _sentence_sums(df, author, text, compat, inner=True)
    placed = place_edges(text_edges(df, author, seq, text), author, seq) if placed is None else placed
    seams = _edge_sentences(placed, author, compat).groupBy(author).agg(
        *_sentence_aggregates(F.col("n"), F.col("type"))
    )
    return _sum_by(inside.unionByName(seams), author, SENTENCE_COUNTERS)


def _edge_sentences(placed: DataFrame, author: str, compat: bool) -> DataFrame:
    """Sentences with a part at the edge of a text: ``(author, number, n, type)``.

    ``number`` counts the runs of stops that come before in the author's texts.
    """
    joined = (
        placed.select(author, "stop_offset", F.inline_outer("fragments"))
        .groupBy(author, (F.col("stop_offset") + F.col("number")).alias("number"))
        .agg(F.sum("n").alias("n"), *[F.max(f).alias(f) for f in ("real", "conj", "sub", "conj_any", "sub_any", "pause")])
        .where(F.col("real") == 1)
    )
    conj, sub = ("conj_any", "sub_any") if compat else ("conj", "sub")
    kind = tx.type_from_flags(F.col(conj) == 1, F.col(sub) == 1, F.col("pause") == 1, compat)
    return joined.select(author, "number", "n", kind.alias("type"))


def first_sentence_types(
    df: DataFrame,
    limit: int,
    author: str = "author",
    seq: str = "seq",
    text: str = "text",
    compat: bool = False,
    placed: DataFrame | None = None,
) -> DataFrame:
    """``n_simple, n_compound, n_complex`` among an author's first ``limit`` sentences in corpus scope.

    Texts with ``limit`` whole sentences before them cannot matter and are left out before the
    others meet their places.
    """
    placed = place_edges(text_edges(df, author, seq, text), author, seq) if placed is None else placed
    early = placed.where(F.col("inner_offset") < limit).select(author, seq, "stop_offset")
    texts = join_on(df.select(author, seq, tx.fragments(F.col(text)).alias("__f")), early, [author, seq])
    inner = (
        explode(texts, [author, "stop_offset", F.size("__f").alias("__size")], "__f", "s", "pos")
        .where((F.col("pos") > 0) & (F.col("pos") < F.col("__size") - 1) & F.col("s").rlike(tx.NON_SPACE))
        .select(
            author,
            (F.col("stop_offset") + F.col("pos")).alias("number"),
            tx.sentence_type(F.col("s"), compat).alias("type"),
        )
    )
    edge = _edge_sentences(placed, author, compat).select(author, "number", "type")
    first = first_k(inner.unionByName(edge), [author], [F.col("number")], limit)
    return first.groupBy(author).agg(
        *[F.count(F.when(F.col("type") == t, 1)).alias(f"n_{t}") for t in ("simple", "compound", "complex")]
    )


WORD_LISTS = {
    "intensifier": lx.INTENSIFIERS,
    "slang": lx.SLANG,
    "modal": lx.MODALS,
    "formal": lx.FORMAL,
    "narrative": lx.NARRATIVE,
    "analytical": lx.ANALYTICAL,
}
SETS = {"modal_verbs_used": lx.MODALS, "archaic_words": lx.ARCHAIC, "formal_words": lx.FORMAL}
COUNTED_TAGS = ["ADJ", "ADV", "NOUN", "VERB", "PRON", "DET", "ADP", "NUM"]


def word_counters(vocabulary: DataFrame, lexicon: DataFrame | None = None, author: str = "author") -> DataFrame:
    """Word-level counters per author from ``(author, word, n)``.

    Lengths, syllables, tags and list membership are worked out once per distinct word. With a
    sentiment lexicon (one row per term) the scored words and ``emotions``, an array of
    ``(n, label)`` no longer than the lexicon's labels, come along in the same pass.
    """
    w, n = F.col("word"), F.col("n")
    if lexicon is not None:
        terms = lexicon.select("term", "polarity", "subjectivity", "emotion")
        vocabulary = vocabulary.join(terms, vocabulary["word"] == terms["term"], "left")
        scored = F.col("term").isNotNull()
    else:
        empty = {"polarity": "bigint", "subjectivity": "bigint", "emotion": "string"}
        vocabulary = vocabulary.select(author, "word", "n", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])
        scored = F.lit(False)
    tagged = vocabulary.select(
        author,
        "word",
        "n",
        "polarity",
        "subjectivity",
        "emotion",
        scored.alias("__scored"),
        F.length(w).alias("__len"),
        tx.syllables(w).alias("__syl"),
        tx.pos_tag(w).alias("__pos"),
    ).withColumn("__tense", tx.verb_tense(w, F.col("__pos")))

    def times(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    sums = {
        "n_words": F.sum(n),
        "word_chars": F.sum(n * F.col("__len")),
        "n_distinct": F.count(F.lit(1)),
        "n_once": F.count(F.when(n == 1, 1)),
        "n_syllables": F.sum(n * F.col("__syl")),
        "n_polysyllables": times(F.col("__syl") >= 3),
        **{f"n_{name}": times(F.expr(_is_in("word", terms))) for name, terms in WORD_LISTS.items()},
        **{f"n_pos_{tag.lower()}": times(F.col("__pos") == tag) for tag in COUNTED_TAGS},
        "n_present": times(F.col("__tense") == "Pres"),
        "n_past": times(F.col("__tense") == "Past"),
        "n_scored": times(F.col("__scored")),
        "polarity_sum": F.sum(F.coalesce(n * F.col("polarity"), F.lit(0))),
        "subjectivity_sum": F.sum(F.coalesce(n * F.col("subjectivity"), F.lit(0))),
    }
    per_label = tagged.groupBy(author, "emotion").agg(
        *[c.alias(name) for name, c in sums.items()],
        *[F.bit_or(_member_bit("word", terms)).alias(name) for name, terms in SETS.items()],
    )
    label = F.struct(F.col("n_words").alias("n"), F.col("emotion").alias("label"))
    per_author = per_label.groupBy(author).agg(
        *[F.sum(name).alias(name) for name in sums],
        *[F.bit_or(name).alias(name) for name in SETS],
        F.collect_list(F.when(F.col("emotion").isNotNull(), label)).alias("emotions"),
    )
    return per_author.select(
        author, *sums, *[_from_bits(name, terms).alias(name) for name, terms in SETS.items()], "emotions"
    )


def _is_in(column: str, terms: list[str]) -> str:
    return f"{column} IN ({', '.join(map(_sql_text, terms))})"


def _member_bit(word: str, terms: list[str]) -> Column:
    bits = " ".join(f"WHEN {_sql_text(t)} THEN {1 << i}L" for i, t in enumerate(terms))
    return F.expr(f"IF({_is_in(word, terms)}, CASE {word} {bits} END, 0L)")


SEAM_COUNTERS = ["will", "dash", "passive"]


def seam_counters(placed: DataFrame, author: str = "author") -> DataFrame:
    """What joining an author's texts by a space adds to their per-text counters.

    ``extra_will``, ``extra_dash`` and ``extra_passive`` count matches that reach over a seam;
    ``seam_phrases`` lists the politeness phrases that do. Each text that is not blank meets its
    successor under the key ``(author, place of the seam)``. Not followed up are a dash text made of
    nothing but dashes, and a phrase spread over three texts.
    """
    phrases = [m for m in lx.POLITENESS if " " in m]
    sides = F.array(
        F.struct(F.col("text_offset").alias("seam"), F.lit(0).alias("side"), F.col("closing").alias("e")),
        F.struct((F.col("text_offset") - 1).alias("seam"), F.lit(1).alias("side"), F.col("opening").alias("e")),
    )
    sent = placed.where(F.col("real_text") == 1).select(author, F.inline_outer(sides)).where(F.col("seam") >= 0)

    def side(i: int, name: str) -> Column:
        return F.max(F.when(F.col("side") == i, F.col(f"e.{name}")))

    seams = (
        sent.groupBy(author, "seam")
        .agg(
            side(0, "will").alias("will"),
            F.when(side(0, "dash") > 0, side(0, "dash")).otherwise(side(1, "dash")).alias("dash"),
            (side(0, "passive") & side(1, "passive")).alias("passive"),
            side(0, "near").alias("a"),
            side(1, "near").alias("b"),
        )
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
    )
    both = F.concat_ws(" ", "a", "b")
    counted = seams.groupBy(author).agg(
        *[F.sum(F.col(c).cast("bigint")).alias(f"extra_{c}") for c in SEAM_COUNTERS],
        *[F.max(F.contains(both, F.lit(p))).alias(f"__p{i}") for i, p in enumerate(phrases)],
    )
    found = F.filter(
        F.array(*[F.when(F.col(f"__p{i}"), F.lit(p)) for i, p in enumerate(phrases)]), lambda p: p.isNotNull()
    )
    return counted.select(author, *[f"extra_{c}" for c in SEAM_COUNTERS], found.alias("seam_phrases"))
