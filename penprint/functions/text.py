"""Column expressions over one text. All of them run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from penprint import lexicons as lx

# Every character Python's str.isspace() accepts, for use inside a character class.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same characters one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{SPACE_CHARS}]"
NON_SPACE = f"[^{SPACE_CHARS}]"
# Explicit classes, since the meaning of \w and \b varies with engine and Java version.
WORD_CLASS = r"\p{L}\p{N}_"
WORD = f"[{WORD_CLASS}]+"
NOT_AFTER_WORD = f"(?<![{WORD_CLASS}])"
NOT_BEFORE_WORD = f"(?![{WORD_CLASS}])"
NUMBER = r"^\p{N}+$"
TERMINATORS = "[.!?]+"
SENTENCE_WITH_END = "[^.!?]+[.!?]*"


def ratio(num: Column, den: Column, empty: float = 0.0) -> Column:
    """``num / den`` as a double, or ``empty`` where the denominator is zero."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(empty))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def whole_word(terms: list[str]) -> str:
    """A pattern matching any of the terms as whole words, ignoring ASCII case.

    The look at the first letter comes first because it settles most positions cheaply.
    """
    first = "".join(sorted({t[0] for t in terms}))
    return f"(?i)(?=[{first}]){NOT_AFTER_WORD}({'|'.join(terms)}){NOT_BEFORE_WORD}"


def any_of(terms: list[str]) -> str:
    """A pattern matching any of the terms anywhere, ignoring ASCII case."""
    return f"(?i)({'|'.join(terms)})"


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def word_count_ws(text: Column) -> Column:
    """Number of whitespace-separated pieces: one more than the runs of white space between them."""
    inner = strip(text)
    return F.when(inner == "", 0).otherwise(F.regexp_count(inner, F.lit(f"{SPACE}+")) + 1)


def fragments(text: Column) -> Column:
    """The pieces between runs of ``.!?``; blank ones and the open last one included."""
    return F.split(text, TERMINATORS)


def sentences(text: Column) -> Column:
    """Stripped non-blank pieces between runs of ``.!?``."""
    return stripped(fragments(text))


def stripped(pieces: Column) -> Column:
    """Stripped pieces without the blank ones."""
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def sentences_with_end(text: Column) -> Column:
    """Stripped sentences that keep their closing marks."""
    return stripped(F.regexp_extract_all(text, F.lit(SENTENCE_WITH_END), F.lit(0)))


def lines(text: Column) -> Column:
    """Stripped non-blank lines."""
    return stripped(F.split(text, "\n"))


def clean(text: Column, any_case: bool = False) -> Column:
    """Drop link placeholders, URLs and tags closed on their line, then squeeze white space.

    The placeholder is dropped in lower case only unless ``any_case``.
    """
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(t, "(?i)urllink", " ") if any_case else F.replace(t, F.lit("urllink"), F.lit(" "))
    t = F.regexp_replace(t, f"http{NON_SPACE}+", " ")
    t = F.regexp_replace(t, r"<[^>\n]*>", " ")
    t = F.regexp_replace(t, f"{SPACE}+", " ")
    return F.trim(t)


def count_of(text: Column, piece: str) -> Column:
    """Non-overlapping occurrences of a literal, by the bytes that removing it saves."""
    saved = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(piece), F.lit("")))
    width = len(piece.encode())
    return saved if width == 1 else (saved / width).cast("int")


def sentence_type(sentence: Column, compat: bool = False) -> Column:
    """``simple``, ``compound`` or ``complex``.

    ``compat`` matches the listed words anywhere, also inside other words, and lets any
    conjunction next to a comma make the sentence complex, so that nothing is ever compound.
    """
    conj, sub, pause = sentence_flags(sentence, compat)
    return type_from_flags(conj, sub, pause, compat)


def sentence_flags(sentence: Column, compat: bool = False) -> tuple[Column, Column, Column]:
    """Has a conjunction, has a subordinator, has a comma or semicolon."""
    pattern = any_of if compat else whole_word
    return (
        sentence.rlike(pattern(lx.CONJUNCTIONS)),
        sentence.rlike(pattern(lx.SUBORDINATORS)),
        sentence.contains(",") | sentence.contains(";"),
    )


def type_from_flags(conj: Column, sub: Column, pause: Column, compat: bool = False) -> Column:
    both = conj & pause
    return (
        F.when(sub | both if compat else sub, F.lit("complex"))
        .when(both, F.lit("compound"))
        .otherwise(F.lit("simple"))
    )


def syllables(word: Column) -> Column:
    """Vowel groups less a silent final e, at least one. Our own estimate."""
    groups = F.regexp_count(word, F.lit("[aeiouyàâäáèéêëìíîïòóôöùúûü]+"))
    silent = F.when(word.rlike("[^aeiouyàâäáèéêëìíîïòóôöùúûül]e$"), 1).otherwise(0)
    return F.greatest(F.lit(1), groups - silent)


def has_ending(word: Column, before: int, endings: list[str]) -> Column:
    """The word ends in one of the endings with at least ``before`` characters in front."""
    hits = [word.endswith(e) & (F.length(word) >= len(e) + before) for e in endings]
    return reduce(lambda a, b: a | b, hits)


def closed_class(word: Column) -> Column:
    return word.isin([w for words in lx.POS_WORDS.values() for w in words])


def pos_tag(word: Column) -> Column:
    """Tag of a lower-cased word: closed classes first, then numbers and endings, else a noun."""
    listed = None
    for name, terms in lx.POS_WORDS.items():
        listed = F.when(word.isin(terms), name) if listed is None else listed.when(word.isin(terms), name)
    tag = F.when(closed_class(word), listed)
    for name, before, endings in lx.POS_ENDINGS:
        tag = tag.when(has_ending(word, before, endings), name)
    return tag.when(word.rlike(NUMBER), "NUM").when(~word.rlike(WORD), "PUNCT").otherwise("NOUN")


def verb_tense(word: Column, pos: Column) -> Column:
    """``Past``, ``Pres`` or null, for verbs only."""
    return F.when(
        pos == "VERB",
        F.when(word.isin(lx.PAST_VERBS) | word.endswith("ed"), "Past").when(
            word.isin(lx.PRESENT_VERBS) | word.endswith("ing"), "Pres"
        ),
    )


def squeezed(text: Column) -> Column:
    """Lower-cased text without white space."""
    return F.regexp_replace(F.lower(text), f"{SPACE}+", "")


def char_list(text: Column) -> Column:
    """The characters of a text; none for the empty text."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))
