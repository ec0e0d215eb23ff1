"""Views of a finished profile: rounding, summary, cards, listing and chart values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.plans.profile import FIELDS, LIST_FIELDS, SCALAR_FIELDS


def round_profile(profile: DataFrame) -> DataFrame:
    """Round every field to its shown decimals; lists, emotions and the largest depth stay."""
    return profile.select(
        "author", *[F.col(f) if d is None else F.round(f, d).alias(f) for f, d in FIELDS.items()]
    )


SUMMARY_FIELDS = [
    "avg_word_length", "avg_words_per_sentence", "vocabulary_richness", "formality_score", "sentiment_polarity",
    "flesch_kincaid_grade", "top_words",
]


def profile_summary(profile: DataFrame) -> DataFrame:
    """Six scalars and ten words. ``avg_sentence_length`` holds the words per sentence."""
    return profile.select(
        "author",
        F.round("avg_word_length", 2).alias("avg_word_length"),
        F.round("avg_words_per_sentence", 2).alias("avg_sentence_length"),
        F.round("vocabulary_richness", 3).alias("vocabulary_richness"),
        F.round("formality_score", 3).alias("formality_score"),
        F.round("sentiment_polarity", 3).alias("sentiment_polarity"),
        F.round("flesch_kincaid_grade", 1).alias("flesch_kincaid_grade"),
        F.slice("top_words", 1, 10).alias("top_words"),
    )


def profile_cards(summary: DataFrame) -> DataFrame:
    """The summary as display text, one row per card: ``(author, place, label, value)``."""
    polarity = F.col("sentiment_polarity")
    mood = F.when(polarity > 0, "😊").when(polarity < 0, "😔").otherwise("😐")
    cards = [
        ("Avg Word Length", F.format_string("%.2f chars", "avg_word_length")),
        ("Sentence Length", F.format_string("%.1f words", "avg_sentence_length")),
        ("Vocabulary Richness", F.format_string("%.1f%%", F.col("vocabulary_richness") * 100)),
        ("Formality", F.format_string("%.0f%%", F.col("formality_score") * 100)),
        ("Sentiment", F.concat_ws(" ", mood, F.format_string("%.2f", polarity))),
        ("Reading Level", F.format_string("Grade %.1f", "flesch_kincaid_grade")),
        ("Top Words", F.array_join("top_words", ", ")),
    ]
    rows = [
        F.struct(F.lit(i).cast("bigint").alias("place"), F.lit(label).alias("label"), value.alias("value"))
        for i, (label, value) in enumerate(cards)
    ]
    shown = (F.col("label") != "Top Words") | (F.col("value") != "")
    return summary.select("author", F.inline(F.array(*rows))).where(shown)


# Category -> (field, format) as shown in the long listing.
LISTING = {
    "lexical": [
        ("avg_words_per_sentence", "%.1f"),
        ("sentence_length_std", "%.1f"),
        ("avg_word_length", "%.2f"),
        ("vocabulary_richness", "%.3f"),
        ("hapax_legomena_ratio", "%.3f"),
        ("intensifier_frequency", "%.4f"),
        ("slang_frequency", "%.4f"),
    ],
    "syntactic": [
        ("simple_sentence_ratio", "%.1f%%"),
        ("compound_sentence_ratio", "%.1f%%"),
        ("complex_sentence_ratio", "%.1f%%"),
        ("avg_parse_tree_depth", "%.2f"),
        ("active_voice_ratio", "%.1f%%"),
        ("passive_voice_ratio", "%.1f%%"),
        ("present_tense_ratio", "%.1f%%"),
        ("past_tense_ratio", "%.1f%%"),
        ("modal_verb_frequency", "%.3f"),
    ],
    "sentiment": [
        ("vader_compound", "%.3f"),
        ("sentiment_polarity", "%.3f"),
        ("sentiment_subjectivity", "%.3f"),
    ],
    "readability": [
        ("flesch_reading_ease", "%.1f"),
        ("flesch_kincaid_grade", "%.1f"),
        ("gunning_fog_index", "%.1f"),
        ("coleman_liau_index", "%.1f"),
        ("smog_index", "%.1f"),
        ("rhythm_score", "%.3f"),
    ],
    "characteristics": [
        ("formality_score", "%.3f"),
        ("politeness_score", "%.3f"),
        ("concreteness_score", "%.3f"),
        ("narrative_score", "%.3f"),
        ("analytical_score", "%.3f"),
    ],
    "punctuation": [
        ("comma_frequency", "%.3f"),
        ("semicolon_frequency", "%.4f"),
        ("dash_frequency", "%.4f"),
        ("ellipsis_frequency", "%.4f"),
        ("quote_frequency", "%.3f"),
    ],
    "discourse": [
        ("discourse_marker_frequency", "%.3f"),
        ("rhetorical_question_ratio", "%.4f"),
        ("dialogue_ratio", "%.3f"),
    ],
}
# Category -> (field, entries shown).
LISTED_LISTS = {
    "sentiment": [("top_emotions", 3)],
    "discourse": [("discourse_markers_used", 5)],
    "vocabulary": [("top_words", 8), ("top_bigrams", 3), ("archaic_words", 5), ("formal_words", 5)],
}


def profile_report(profile: DataFrame) -> DataFrame:
    """The long listing: ``(author, category, metric, value, shown)``.

    ``value`` is the number behind a metric and null for lists, ``shown`` its display text.
    """

    def row(category: str, metric: str, value: Column, shown: Column) -> Column:
        return F.struct(
            F.lit(category).alias("category"),
            F.lit(metric).alias("metric"),
            value.cast("double").alias("value"),
            shown.alias("shown"),
        )

    rows = []
    for category, metrics in LISTING.items():
        for field, form in metrics:
            shown = F.col(field) * 100 if form.endswith("%%") else F.col(field)
            rows.append(row(category, field, F.col(field), F.format_string(form, shown)))
    for category, lists in LISTED_LISTS.items():
        for field, k in lists:
            entries = F.slice(field, 1, k)
            if field == "top_emotions":
                entries = F.transform(entries, lambda e: F.format_string("%s(%.2f)", e["label"], e["score"]))
            rows.append(row(category, field, F.lit(None), F.array_join(entries, ", ")))
    return profile.select("author", F.inline(F.array(*rows)))


PANEL_FIELDS = {
    "lexical": ["avg_word_length", "vocabulary_richness", "rare_word_frequency", "hapax_legomena_ratio"],
    "sentence_structure": ["simple_sentence_ratio", "compound_sentence_ratio", "complex_sentence_ratio"],
    "voice_tense": ["active_voice_ratio", "passive_voice_ratio", "present_tense_ratio", "past_tense_ratio"],
    "part_of_speech": [
        "noun_ratio", "verb_ratio", "adjective_ratio", "adverb_ratio", "pronoun_ratio", "preposition_ratio",
    ],
    "readability": ["flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog_index", "coleman_liau_index"],
    "sentiment": ["vader_compound", "sentiment_polarity", "sentiment_subjectivity"],
    "punctuation": [
        "comma_frequency", "semicolon_frequency", "dash_frequency", "ellipsis_frequency", "quote_frequency",
        "parentheses_frequency",
    ],
    "characteristics": ["formality_score", "politeness_score", "concreteness_score", "rhythm_score"],
    "discourse": [
        "avg_parse_tree_depth", "avg_words_per_sentence", "sentence_length_std", "modal_verb_frequency",
        "discourse_marker_frequency", "narrative_score", "analytical_score", "dialogue_ratio",
        "intensifier_frequency",
    ],
}
# Chart units where they are not the field's own.
SCALED = {
    "avg_word_length": lambda x: x / 10,
    "rare_word_frequency": lambda x: x * 10,
    "flesch_reading_ease": lambda x: F.least(x / 100.0, F.lit(1.0)),
    "flesch_kincaid_grade": lambda x: F.least(x / 20.0, F.lit(1.0)),
    "gunning_fog_index": lambda x: F.least(x / 20.0, F.lit(1.0)),
    "coleman_liau_index": lambda x: F.least(x / 20.0, F.lit(1.0)),
    "comma_frequency": lambda x: x * 10,
    "semicolon_frequency": lambda x: x * 100,
    "dash_frequency": lambda x: x * 100,
    "ellipsis_frequency": lambda x: x * 100,
    "quote_frequency": lambda x: x * 10,
    "parentheses_frequency": lambda x: x * 100,
    "rhythm_score": lambda x: F.least(x / 2.0, F.lit(1.0)),
}


def profile_chart_values(profile: DataFrame) -> DataFrame:
    """``(author, panel, label, value)`` for nine chart panels."""
    rows = [
        F.struct(
            F.lit(panel).alias("panel"),
            F.lit(field).alias("label"),
            SCALED.get(field, lambda x: x)(F.col(field)).cast("double").alias("value"),
        )
        for panel, fields in PANEL_FIELDS.items()
        for field in fields
    ]
    return profile.select("author", F.inline(F.array(*rows)))


def profile_field_counts(profile: DataFrame) -> DataFrame:
    """Per profile, the number of all, numeric and list or map fields that hold a value."""
    numeric = [*SCALAR_FIELDS, "max_parse_tree_depth"]
    lists = [*LIST_FIELDS, "top_emotions"]

    def held(fields: list[str]) -> Column:
        total = F.lit(0)
        for f in fields:
            total = total + F.when(F.col(f).isNotNull(), 1).otherwise(0)
        return total.cast("bigint")

    return profile.select(
        "author",
        held(numeric + lists).alias("total_features"),
        held(numeric).alias("numeric_features"),
        held(lists).alias("pattern_features"),
    )
