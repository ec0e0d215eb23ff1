"""The style profile: 72 fields, one row per author."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint import lexicons as lx
from penprint.functions.text import ratio
from penprint.operators import counters as ct
from penprint.operators import grams as gr
from penprint.operators import sentiment as se
from penprint.operators import tokens as tk
from penprint.operators.edges import GRAMS, stored_edges
from penprint.operators.segment import head_chars
from penprint.plans.keys import join_on

# Field -> decimals it is shown with; None marks the fields that are never rounded.
FIELDS: dict[str, int | None] = {
    "avg_word_length": 2,
    "avg_sentence_length": 2,
    "vocabulary_richness": 3,
    "rare_word_frequency": 3,
    "hapax_legomena_ratio": 3,
    "top_char_trigrams": None,
    "top_char_fourgrams": None,
    "intensifier_frequency": 4,
    "slang_frequency": 4,
    "avg_words_per_sentence": 2,
    "sentence_length_std": 2,
    "simple_sentence_ratio": 3,
    "compound_sentence_ratio": 3,
    "complex_sentence_ratio": 3,
    "question_ratio": 3,
    "exclamation_ratio": 3,
    "avg_parse_tree_depth": 2,
    "max_parse_tree_depth": None,
    "passive_voice_ratio": 3,
    "active_voice_ratio": 3,
    "present_tense_ratio": 3,
    "past_tense_ratio": 3,
    "future_tense_ratio": 3,
    "modal_verb_frequency": 3,
    "modal_verbs_used": None,
    "sentiment_polarity": 3,
    "sentiment_subjectivity": 3,
    "vader_positive": 3,
    "vader_negative": 3,
    "vader_neutral": 3,
    "vader_compound": 3,
    "top_emotions": None,
    "formality_score": 3,
    "politeness_score": 3,
    "concreteness_score": 3,
    "flesch_reading_ease": 2,
    "flesch_kincaid_grade": 2,
    "gunning_fog_index": 2,
    "coleman_liau_index": 2,
    "smog_index": 2,
    "sentence_length_variance": 2,
    "rhythm_score": 3,
    "adjective_ratio": 3,
    "adverb_ratio": 3,
    "noun_ratio": 3,
    "verb_ratio": 3,
    "pronoun_ratio": 3,
    "determiner_ratio": 3,
    "preposition_ratio": 3,
    "punctuation_density": 3,
    "comma_frequency": 3,
    "semicolon_frequency": 4,
    "colon_frequency": 4,
    "dash_frequency": 4,
    "ellipsis_frequency": 4,
    "parentheses_frequency": 4,
    "quote_frequency": 3,
    "exclamation_frequency": 4,
    "question_mark_frequency": 4,
    "all_caps_frequency": 4,
    "title_case_frequency": 3,
    "discourse_marker_frequency": 3,
    "discourse_markers_used": None,
    "rhetorical_question_ratio": 4,
    "dialogue_ratio": 3,
    "narrative_score": 3,
    "analytical_score": 3,
    "top_words": None,
    "top_bigrams": None,
    "top_trigrams": None,
    "archaic_words": None,
    "formal_words": None,
}
LIST_FIELDS = [
    "top_char_trigrams", "top_char_fourgrams", "modal_verbs_used", "discourse_markers_used",
    "top_words", "top_bigrams", "top_trigrams", "archaic_words", "formal_words",
]
SCALAR_FIELDS = [f for f in FIELDS if f not in LIST_FIELDS and f not in ("top_emotions", "max_parse_tree_depth")]


@dataclass(frozen=True)
class Caps:
    """Limits on how much of an author is read for some fields; ``None`` reads all of it.

    The first four count characters of the merged text, the last two sentences.
    """

    sentiment: int | None = None
    emotion: int | None = None
    readability: int | None = None
    annotation: int | None = None
    sentence_types: int | None = None
    trees: int | None = None


VALENCE_FIELDS = {"vader_positive", "vader_negative", "vader_neutral", "vader_compound"}
TYPE_FIELDS = {"simple_sentence_ratio", "compound_sentence_ratio", "complex_sentence_ratio"}
ORIGINAL_CAPS = Caps(
    sentiment=5000, emotion=1000, readability=5000, annotation=1_000_000, sentence_types=500, trees=100
)


# Fields as expressions over counters ----------------------------------------------------------


def c(name: str) -> Column:
    return F.col(name)


def lexical_fields() -> dict[str, Column]:
    return {
        "avg_word_length": ratio(c("word_chars"), c("n_words")),
        "avg_sentence_length": ratio(c("n_words"), c("n_sentences")),
        "vocabulary_richness": ratio(c("n_distinct"), c("n_words")),
        "rare_word_frequency": ratio(c("n_once"), c("n_words")),
        "hapax_legomena_ratio": ratio(c("n_once"), c("n_distinct")),
        "intensifier_frequency": ratio(c("n_intensifier"), c("n_words")),
        "slang_frequency": ratio(c("n_slang"), c("n_words")),
    }


def _spread() -> Column:
    """n * sum of squares - (sum)^2 of the sentence lengths: exact, in integers."""
    wide = "decimal(38,0)"
    return (
        c("n_sentences").cast(wide) * c("sent_words_sq") - c("sent_words").cast(wide) * c("sent_words")
    ).cast("double")


def sentence_fields() -> dict[str, Column]:
    n = c("n_sentences")
    std = ratio(F.sqrt(_spread()), n)
    mean = ratio(c("sent_words"), n)
    return {
        "avg_words_per_sentence": mean,
        "sentence_length_std": std,
        "sentence_length_variance": ratio(_spread(), n.cast("double") * n),
        "rhythm_score": F.when((n < 2) | (c("sent_words") == 0), 0.0).otherwise(
            F.least(F.try_divide(std, mean), F.lit(2.0))
        ),
        "simple_sentence_ratio": ratio(c("n_simple"), n),
        "compound_sentence_ratio": ratio(c("n_compound"), n),
        "complex_sentence_ratio": ratio(c("n_complex"), n),
    }


def pattern_fields() -> dict[str, Column]:
    s, w = c("n_sentences"), c("n_words")
    passive = ratio(c("n_passive"), s)
    return {
        "question_ratio": ratio(c("n_question"), s),
        "exclamation_ratio": ratio(c("n_exclamation"), s),
        "passive_voice_ratio": passive,
        "active_voice_ratio": 1.0 - F.least(passive, F.lit(1.0)),
        "future_tense_ratio": ratio(c("n_will"), w),
        "modal_verb_frequency": ratio(c("n_modal"), w),
    }


def mark_fields() -> dict[str, Column]:
    counted = {
        "punctuation_density": "n_punct",
        "comma_frequency": "n_comma",
        "semicolon_frequency": "n_semicolon",
        "colon_frequency": "n_colon",
        "dash_frequency": "n_dash",
        "ellipsis_frequency": "n_ellipsis",
        "parentheses_frequency": "n_paren",
        "quote_frequency": "n_quote",
        "exclamation_frequency": "n_exclamation",
        "question_mark_frequency": "n_question",
        "all_caps_frequency": "n_all_caps",
        "title_case_frequency": "n_title_case",
    }
    return {field: ratio(c(n), c("n_words")) for field, n in counted.items()}


def tag_fields() -> dict[str, Column]:
    tokens = c("n_tagged")
    return {
        **{name: ratio(c(f"n_pos_{tag.lower()}"), tokens) for name, tag in tk.POS_FIELDS.items()},
        "present_tense_ratio": ratio(c("n_present"), c("n_present") + c("n_past")),
        "past_tense_ratio": ratio(c("n_past"), c("n_present") + c("n_past")),
        "concreteness_score": tk.concreteness_value(
            c("n_pos_noun") + c("n_pos_num"), c("n_pos_adj") + c("n_pos_adv"), tokens
        ),
    }


def formality(noun: Column, tokens: Column, formal: Column, contractions: Column, words: Column, compat: bool) -> Column:
    """Noun share up to .4, formal words up to .3, and .3 less five times the contraction share.

    ``compat`` keeps two slips of the original: the formal part may reach 3 and contractions are
    looked for in words without apostrophes, so none is ever found.
    """
    formal_part = (
        F.least(ratio(formal, words), F.lit(0.3)) * 10 if compat else F.least(ratio(formal, words) * 10, F.lit(0.3))
    )
    plain = F.greatest(F.lit(0.0), 0.3 - ratio(F.lit(0) if compat else contractions, words) * 5)
    parts = F.least(ratio(noun, tokens), F.lit(0.4)) + F.when(words > 0, formal_part + plain).otherwise(0.0)
    return F.least(parts, F.lit(1.0))


def discourse_fields(compat: bool) -> dict[str, Column]:
    s = c("n_sentences")
    told, argued = c("n_narrative"), c("n_analytical")
    return {
        "discourse_marker_frequency": ratio(F.size("discourse_found"), s),
        "politeness_score": F.least(ratio(F.size("politeness_found"), s), F.lit(1.0)),
        "rhetorical_question_ratio": F.lit(0.0) if compat else ratio(c("n_rhetorical"), s),
        "dialogue_ratio": F.least(ratio(c("n_double_quote") / 2, s), F.lit(1.0)),
        "narrative_score": ratio(told, told + argued, 0.5),
        "analytical_score": ratio(argued, told + argued, 0.5),
    }


def readability_fields() -> dict[str, Column]:
    """The published formulas over words, sentences, syllables and letters; 0 for empty texts."""
    w, s = c("n_words"), c("n_sentences")
    per_sentence, per_word = ratio(w, s), ratio(c("n_syllables"), w)
    poly = c("n_polysyllables")
    fields = {
        "flesch_reading_ease": 206.835 - 1.015 * per_sentence - 84.6 * per_word,
        "flesch_kincaid_grade": 0.39 * per_sentence + 11.8 * per_word - 15.59,
        "gunning_fog_index": 0.4 * (per_sentence + 100.0 * ratio(poly, w)),
        "coleman_liau_index": 0.0588 * (100.0 * ratio(c("word_chars"), w)) - 0.296 * (100.0 * ratio(s, w)) - 15.8,
    }
    fields = {name: F.when((w > 0) & (s > 0), f).otherwise(0.0) for name, f in fields.items()}
    fields["smog_index"] = F.when(s >= 3, 1.043 * F.sqrt(ratio(30 * poly, s)) + 3.1291).otherwise(0.0)
    return fields


def sentiment_fields() -> dict[str, Column]:
    return {
        "sentiment_polarity": ratio(c("polarity_sum"), c("n_scored") * 100),
        "sentiment_subjectivity": ratio(c("subjectivity_sum"), c("n_scored") * 100),
    }


def emotion_struct(k: int = 5) -> Column:
    """The ``k`` most frequent labels with their shares, most frequent first."""
    total = F.aggregate("emotions", F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])
    ordered = F.array_sort(F.transform("emotions", lambda x: F.struct((-x["n"]).alias("n"), x["label"].alias("label"))))
    return F.transform(
        F.slice(ordered, 1, k), lambda x: F.struct(x["label"].alias("label"), ratio(-x["n"], total).alias("score"))
    )


# Plan -----------------------------------------------------------------------------------------


def text_part(docs: DataFrame, placed: DataFrame | None) -> DataFrame:
    """Mark, pattern and marker counters; with placed edges also what reaches over the seams."""
    counters = ct.author_text_counters(docs)
    if placed is None:
        return counters
    both = join_on(counters, ct.seam_counters(placed), ["author"], "left")
    found = F.array_sort(
        F.array_union("politeness_found", F.coalesce("seam_phrases", F.array().cast("array<string>")))
    )
    added = {f"n_{e}": F.col(f"n_{e}") + F.coalesce(F.col(f"extra_{e}"), F.lit(0)) for e in ct.SEAM_COUNTERS}
    return both.withColumns({**added, "politeness_found": found}).select(*counters.columns)


PARTS = ("text", "sentences", "words")


def author_counters(
    docs: DataFrame,
    lexicon: DataFrame,
    scope: str = "corpus",
    compat: bool = False,
    placed: DataFrame | None = None,
    parts: Sequence[str] = PARTS,
) -> DataFrame:
    """The counters of ``(author, seq, text)``, one row per author; ``parts`` says which kinds of them."""
    joined = text_part(docs, placed) if "text" in parts else docs.select("author").distinct()
    if "sentences" in parts:
        joined = join_on(joined, ct.sentence_counters(docs, scope=scope, compat=compat, placed=placed), ["author"], "left")
    if "words" in parts:
        joined = join_on(joined, ct.word_counters(gr.vocabulary(docs), lexicon), ["author"], "left")
    return _no_nulls(joined)


def _parts_of(fields: dict[str, Column], columns: dict[str, list[str]]) -> list[str]:
    """The parts whose columns the fields read."""
    read = set(re.findall(r"\w+", " ".join(map(str, fields.values()))))
    return [part for part, names in columns.items() if read & set(names)]


def _no_nulls(df: DataFrame) -> DataFrame:
    """Zero for missing counters and empty arrays for missing lists."""
    lists = {
        f.name: F.coalesce(f.name, F.array().cast(f.dataType))
        for f in df.schema.fields
        if f.dataType.typeName() == "array"
    }
    return df.fillna(0).withColumns(lists) if lists else df.fillna(0)


def top_lists(docs: DataFrame, scope: str, placed: DataFrame | None = None, kinds: list[gr.Kind] = gr.PROFILE_KINDS) -> DataFrame:
    """Ranked lists per author as arrays."""
    top = gr.top_terms(gr.gram_counts(docs, kinds, scope=scope, placed=placed, top=True), kinds)
    arrays = []
    for kind in kinds:
        entry = F.when(F.col("kind") == kind.name, F.struct("rank", "term"))
        arrays.append(F.array_sort(F.collect_list(entry))["term"].alias(kind.name))
    return top.groupBy("author").agg(*arrays)


def style_profile(
    docs: DataFrame,
    author: str = "author",
    seq: str = "seq",
    text: str = "text",
    lexicon: DataFrame | None = None,
    depths: DataFrame | None = None,
    scope: str = "corpus",
    compat: bool = False,
    caps: Caps = Caps(),
    only: Sequence[str] = tuple(FIELDS),
) -> DataFrame:
    """Measure each author's texts: 72 unrounded fields in the order of ``FIELDS``.

    ``scope='corpus'`` treats an author's texts as one text joined by spaces in ``seq`` order,
    ``'document'`` keeps every text to itself. ``depths(author, depth)`` replaces the rule-made
    sentence trees. ``compat`` reproduces the original's known slips, ``caps`` its text limits.
    With ``only`` the parts of the plan that none of the named fields needs are left out.
    """
    wanted = set(only)
    unknown = wanted - set(FIELDS)
    if unknown:
        raise ValueError(f"no such fields: {sorted(unknown)}")
    docs = docs.select(
        F.col(author).alias("author"),
        F.col(seq).cast("bigint").alias("seq"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    if lexicon is None:
        lexicon = lx.sentiment_table(docs.sparkSession)
    fields = {
        **lexical_fields(),
        **sentence_fields(),
        **pattern_fields(),
        **mark_fields(),
        **tag_fields(),
        **discourse_fields(compat),
        "formality_score": formality(
            c("n_pos_noun"), c("n_tagged"), c("n_formal"), c("n_contractions"), c("n_words"), compat
        ),
    }
    # Only what the wanted fields read is counted.
    needed = {name: f for name, f in {**fields, **readability_fields(), **sentiment_fields()}.items() if name in wanted}
    needed.update({name: c(name) for name in ("modal_verbs_used", "archaic_words", "formal_words") if name in wanted})
    if "discourse_markers_used" in wanted:
        needed["discourse_markers_used"] = c("discourse_found")
    if wanted & {"top_emotions", *VALENCE_FIELDS}:
        needed["top_emotions"] = c("emotions") + c("n_words")
    columns = {
        "text": ct.author_text_counters(docs).columns,
        "sentences": ct.sentence_counters(docs, scope="document", compat=compat).columns,
        "words": ct.word_counters(gr.vocabulary(docs), lexicon).columns,
    }
    columns = {part: [n for n in names if n != "author"] for part, names in columns.items()}
    parts = _parts_of(needed, columns)
    if "n_tagged" in " ".join(map(str, needed.values())):
        parts = [p for p in PARTS if p in parts or p in ("text", "words")]
    kinds = [kind for kind in gr.PROFILE_KINDS if kind.name in wanted]
    seams = set(parts) & {"text", "sentences"} or caps.sentence_types is not None or any(kind.n > 1 for kind in kinds)
    unread = [*(() if any(kind.n > 1 for kind in kinds) else GRAMS), *(() if caps.sentence_types is not None else ("inner",))]
    placed = stored_edges(docs, without=unread) if scope == "corpus" and seams else None
    base = author_counters(docs, lexicon, scope, compat, placed, parts)
    # Columns of parts that no wanted field reads stand in as nothing.
    empty_list = F.array().cast("array<string>")
    for part in set(PARTS) - set(parts):
        lists = ("modal_verbs_used", "archaic_words", "formal_words", "discourse_found", "politeness_found", "emotions")
        base = base.withColumns({n: empty_list if n in lists else F.lit(0).cast("bigint") for n in columns[part] if n not in base.columns})
    base = base.withColumn("n_tagged", c("n_words") + c("n_other_tokens"))
    fields = {name: f for name, f in fields.items() if name in wanted}
    if caps.annotation is not None and wanted & {*tag_fields(), "formality_score"}:
        base = _with_capped_tags(base, docs, caps.annotation)
    if caps.sentence_types is not None and wanted & TYPE_FIELDS:
        if scope != "corpus":
            raise ValueError("the limit on sentence types is defined on an author's texts as one")
        types = ct.first_sentence_types(docs, caps.sentence_types, compat=compat, placed=placed)
        base = join_on(base.drop("n_simple", "n_compound", "n_complex"), types, ["author"], "left").fillna(0)
        classified = c("n_simple") + c("n_compound") + c("n_complex")
        fields.update({f"{t}_sentence_ratio": ratio(c(f"n_{t}"), classified) for t in ("simple", "compound", "complex")})
    kept = [name for name in ("modal_verbs_used", "archaic_words", "formal_words") if name in wanted]
    if caps.readability is None:
        fields.update({name: f for name, f in readability_fields().items() if name in wanted})
    if caps.sentiment is None:
        fields.update({name: f for name, f in sentiment_fields().items() if name in wanted})
    if caps.emotion is None and "top_emotions" in wanted:
        fields["top_emotions"] = emotion_struct()
    valence = se.valence_counters(head_chars(docs, caps.sentiment), lexicon)
    if caps.sentiment is None and wanted & VALENCE_FIELDS:
        base = join_on(base, valence, ["author"], "left")
        sums = [F.coalesce(F.col(n), F.lit(0)) for n in ("valence_sum", "positive_sum", "negative_sum", "n_charged")]
        fields.update(se.valence_fields(*sums, c("n_words")))
    markers = [F.col("discourse_found").alias("discourse_markers_used")] if "discourse_markers_used" in wanted else []
    profile = base.select("author", *kept, *markers, *[f.alias(name) for name, f in fields.items()])

    if caps.readability is not None and wanted & set(readability_fields()):
        profile = join_on(profile, _capped(docs, caps.readability, lexicon, scope, readability_fields()), ["author"], "left")
    if caps.sentiment is not None and wanted & (VALENCE_FIELDS | set(sentiment_fields())):
        profile = join_on(profile, _capped_sentiment(docs, caps.sentiment, lexicon, valence), ["author"], "left")
    if caps.emotion is not None and "top_emotions" in wanted:
        profile = join_on(
            profile, _capped(docs, caps.emotion, lexicon, scope, {"top_emotions": emotion_struct()}), ["author"], "left"
        )
    if wanted & {"avg_parse_tree_depth", "max_parse_tree_depth"}:
        if depths is None:
            ordered = docs if caps.trees is not None else docs.select("author", "text")
            depths = tk.rule_depths(ordered, first=caps.trees)
        trees = tk.depth_fields(depths)
        profile = join_on(profile, trees, ["author"], "left").withColumns(
            {
                "avg_parse_tree_depth": ratio(c("depth_sum"), c("n_trees")),
                "max_parse_tree_depth": F.coalesce(c("depth_max"), F.lit(0)).cast("int"),
            }
        )
    if kinds:
        profile = join_on(profile, top_lists(docs, scope, placed, kinds), ["author"], "left")
        empty = F.array().cast("array<string>")
        profile = profile.withColumns({kind.name: F.coalesce(kind.name, empty) for kind in kinds})
    return profile.select("author", *[f for f in FIELDS if f in wanted])


def _with_capped_tags(base: DataFrame, docs: DataFrame, limit: int) -> DataFrame:
    """Replace the tag and tense counters by those of each author's first ``limit`` characters."""
    head = head_chars(docs, limit)
    words = ct.word_counters(gr.vocabulary(head))
    marks = ct.text_counters(head).groupBy("author").agg(F.sum("n_other_tokens").alias("marks"))
    counted = [f"n_pos_{tag.lower()}" for tag in ct.COUNTED_TAGS] + ["n_present", "n_past"]
    both = _no_nulls(join_on(marks, words, ["author"], "left")).select(
        "author", *counted, (c("n_words") + c("marks")).alias("n_tagged")
    )
    return join_on(base.drop(*counted, "n_tagged"), both, ["author"], "left").fillna(0)


def _capped(docs: DataFrame, limit: int, lexicon: DataFrame, scope: str, fields: dict[str, Column]) -> DataFrame:
    head = head_chars(docs, limit)
    words = ct.word_counters(gr.vocabulary(head), lexicon)
    both = join_on(ct.sentence_counters(head, scope=scope), words, ["author"], "left")
    return _no_nulls(both).select("author", *[f.alias(name) for name, f in fields.items()])


def _capped_sentiment(docs: DataFrame, limit: int, lexicon: DataFrame, valence: DataFrame) -> DataFrame:
    words = ct.word_counters(gr.vocabulary(head_chars(docs, limit)), lexicon)
    both = _no_nulls(join_on(words, valence, ["author"], "left"))
    fields = {
        **sentiment_fields(),
        **se.valence_fields(c("valence_sum"), c("positive_sum"), c("negative_sum"), c("n_charged"), c("n_words")),
    }
    return both.select("author", *[f.alias(name) for name, f in fields.items()])
