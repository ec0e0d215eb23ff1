"""Prompts for a rewriting model and checks of its answers, one row per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.functions import text as tx
from penprint.plans.keys import join_on

EXPANSION = 1.5
TOKENS_PER_WORD, MOST_TOKENS = 3, 512
OVERLONG = 2.5
LABEL_FIELDS = [
    "semicolon_frequency", "dash_frequency", "ellipsis_frequency", "archaic_words", "formal_words",
    "discourse_markers_used", "top_emotions",
]


def length_budget(df: DataFrame, text: str = "original_text") -> DataFrame:
    """Word count (10 for an empty text), the most words allowed, and the token limit."""
    words = tx.word_count_ws(F.coalesce(F.col(text), F.lit("")))
    counted = F.when(F.length(F.coalesce(F.col(text), F.lit(""))) == 0, 10).otherwise(words).cast("bigint")
    return df.withColumns(
        {
            "original_words": counted,
            "max_words": F.floor(counted * EXPANSION).cast("bigint"),
            "max_tokens": F.least(F.lit(MOST_TOKENS), words * TOKENS_PER_WORD).cast("bigint"),
        }
    )


def _joined(items: str, k: int, none: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.slice(items, 1, k), ", ")).otherwise(none)


def frequency_labels(profile: DataFrame) -> DataFrame:
    """Words for how often a mark is used, and list texts with their stand-ins for empty lists."""
    emotions = F.transform(
        F.slice("top_emotions", 1, 3), lambda e: F.format_string("%s (%.2f)", e["label"], e["score"])
    )
    return profile.withColumns(
        {
            "semicolon_label": F.when(F.col("semicolon_frequency") > 0.01, "frequent").otherwise("rare"),
            "dash_label": F.when(F.col("dash_frequency") > 0.01, "frequent").otherwise("occasional"),
            "ellipsis_label": F.when(F.col("ellipsis_frequency") > 0.005, "uses suspense").otherwise("rare"),
            "archaic_label": _joined("archaic_words", 5, "none"),
            "formal_label": _joined("formal_words", 5, "minimal"),
            "marker_label": _joined("discourse_markers_used", 8, "minimal"),
            "emotion_label": F.when(F.size("top_emotions") > 0, F.array_join(emotions, ", ")).otherwise("neutral"),
            "mark_list": F.concat_ws(
                ", ",
                F.when(F.col("semicolon_frequency") > 0.01, "semicolons"),
                F.when(F.col("dash_frequency") > 0.01, "dashes"),
                F.lit("commas"),
            ),
        }
    )


def style_card(profile: DataFrame) -> DataFrame:
    """The part of the prompt that depends on the style alone, rendered once per style as ``card``."""
    p = lambda field: F.col(field) * 100
    words15 = F.array_join(F.slice("top_words", 1, 15), ", ")
    lines: list[tuple[str, list]] = [
        ("[Sentences]", []),
        ("- mean length %.1f words, give or take %.1f", [F.col("avg_words_per_sentence"), F.col("sentence_length_std")]),
        (
            "- make-up: %.0f%% simple, %.0f%% compound, %.0f%% complex",
            [p("simple_sentence_ratio"), p("compound_sentence_ratio"), p("complex_sentence_ratio")],
        ),
        ("- tree depth %.1f, rhythm %.2f", [F.col("avg_parse_tree_depth"), F.col("rhythm_score")]),
        ("[Vocabulary]", []),
        ("- word length %.1f letters, distinct share %.3f", [F.col("avg_word_length"), F.col("vocabulary_richness")]),
        ("- favoured words: %s", [words15]),
        ("- frequent phrases: %s", [F.array_join(F.slice("top_bigrams", 1, 8), ", ")]),
        ("- archaic words: %s; formal words: %s", [F.col("archaic_label"), F.col("formal_label")]),
        ("[Grammar]", []),
        ("- voice: %.0f%% active, %.0f%% passive", [p("active_voice_ratio"), p("passive_voice_ratio")]),
        ("- tense: %.0f%% present, %.0f%% past", [p("present_tense_ratio"), p("past_tense_ratio")]),
        ("- modal verbs per word %.3f", [F.col("modal_verb_frequency")]),
        (
            "- nouns %.1f%%, verbs %.1f%%, adjectives %.1f%%, adverbs %.1f%%",
            [p("noun_ratio"), p("verb_ratio"), p("adjective_ratio"), p("adverb_ratio")],
        ),
        ("[Punctuation per word]", []),
        ("- commas %.3f", [F.col("comma_frequency")]),
        ("- semicolons %.4f (%s)", [F.col("semicolon_frequency"), F.col("semicolon_label")]),
        ("- dashes %.4f (%s)", [F.col("dash_frequency"), F.col("dash_label")]),
        ("- exclamation marks %.4f, question marks %.4f", [F.col("exclamation_frequency"), F.col("question_mark_frequency")]),
        ("- ellipses %.4f (%s)", [F.col("ellipsis_frequency"), F.col("ellipsis_label")]),
        ("[Tone]", []),
        ("- polarity %.2f from -1 to 1, subjectivity %.2f", [F.col("sentiment_polarity"), F.col("sentiment_subjectivity")]),
        ("- emotions: %s", [F.col("emotion_label")]),
        ("- formality %.2f, concreteness %.2f", [F.col("formality_score"), F.col("concreteness_score")]),
        ("[Readability]", []),
        (
            "- ease %.1f, grade %.1f, fog %.1f",
            [F.col("flesch_reading_ease"), F.col("flesch_kincaid_grade"), F.col("gunning_fog_index")],
        ),
        ("[Discourse]", []),
        ("- connectives: %s", [F.col("marker_label")]),
        (
            "- narrative %.1f%%, analytical %.1f%%, dialogue %.2f",
            [p("narrative_score"), p("analytical_score"), F.col("dialogue_ratio")],
        ),
        ("[Above all]", []),
        ("- about %.0f words per sentence", [F.col("avg_words_per_sentence")]),
        ("- prefer these words: %s", [F.array_join(F.slice("top_words", 1, 8), ", ")]),
        ("- %.0f%% active voice; marks: %s", [p("active_voice_ratio"), F.col("mark_list")]),
        ("- polarity %.1f, formality %.1f", [F.col("sentiment_polarity"), F.col("formality_score")]),
    ]
    form = "\n".join(f for f, _ in lines)
    values = [v for _, vs in lines for v in vs]
    return frequency_labels(profile).select(F.col("author").alias("style_name"), F.format_string(form, *values).alias("card"))


def style_prompt(requests: DataFrame, cards: DataFrame, row_id: str = "request_id") -> DataFrame:
    """One prompt per request: rules and length, the card of its style, then the text.

    ``cards`` has one row per style, rendered before the join.
    """
    budgeted = length_budget(requests)
    both = join_on(budgeted, cards, ["style_name"], "left")
    head = F.format_string(
        "Rewrite the text at the end the way %s writes. Keep every fact and event, add and drop "
        "nothing, change only the wording.\nThe text has about %d words; answer with %d to %d words "
        "and nothing but the rewritten text.\n\nHOW %s WRITES",
        F.col("author_name"),
        F.col("original_words"),
        F.col("original_words"),
        F.col("max_words"),
        F.upper("author_name"),
    )
    foot = F.format_string("Text to rewrite, about %d words:", F.col("original_words"))
    prompt = F.when(
        F.col("card").isNotNull(), F.concat_ws("\n\n", head, F.col("card"), foot, F.col("original_text"))
    )
    return both.withColumn("prompt", prompt).drop("card")


def overlong_check(df: DataFrame, text: str = "original_text", answer: str = "answer") -> DataFrame:
    """Flag answers with more than 2.5 times the words of the text, and put a note before them."""
    before, after = tx.word_count_ws(F.col(text)), tx.word_count_ws(F.col(answer))
    flagged = df.withColumn("is_overlong", after > before * OVERLONG)
    note = F.format_string("[Note: the answer may be too long: %d words for %d]\n\n", after, before)
    return flagged.withColumn("styled", F.when(F.col("is_overlong"), F.concat(note, F.col(answer))).otherwise(F.col(answer)))
