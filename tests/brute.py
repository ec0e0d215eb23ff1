"""Straightforward single-machine measures of one text, to compare with."""

from __future__ import annotations

import math
import re
from collections import Counter

from penprint import lexicons as lx


def words_of(text):
    return re.findall(r"\b\w+\b", text.lower())


def sentences_of(text):
    return [s.strip() for s in re.split(r"[.!?]+", text) if s.strip()]


def char_grams(text, n):
    t = re.sub(r"\s+", "", text.lower())
    return [t[i : i + n] for i in range(len(t) - n + 1)]


def top(items, k):
    return [x for x, _ in Counter(items).most_common(k)]


def kind_of(sentence, compat):
    low = sentence.lower()
    if compat:
        has = lambda terms: any(t in low for t in terms)
    else:
        has = lambda terms: bool(set(re.findall(r"\w+", low)) & set(terms))
    conj, sub, pause = has(lx.CONJUNCTIONS), has(lx.SUBORDINATORS), "," in sentence or ";" in sentence
    if sub or (compat and conj and pause):
        return "complex"
    return "compound" if conj and pause else "simple"


def div(a, b, empty=0.0):
    return a / b if b else empty


def measures(texts, compat=False):
    """Fields of the profile of an ordered list of texts, read as one text."""
    t = " ".join(texts)
    w, sents = words_of(t), sentences_of(t)
    counts = Counter(w)
    once = sum(1 for n in counts.values() if n == 1)
    lengths = [len(re.findall(r"\b\w+\b", s)) for s in sents]
    n, s = len(w), len(sents)
    mean = div(sum(lengths), s)
    variance = div(sum((x - mean) ** 2 for x in lengths), s)
    kinds = Counter(kind_of(x, compat) for x in sents)
    passive = len(re.findall(r"\b(was|were|been|being)\s+\w+ed\b", t, re.IGNORECASE))
    told = sum(x in lx.NARRATIVE for x in w)
    argued = sum(x in lx.ANALYTICAL for x in w)
    content = [x for x in w if x not in lx.STOP_WORDS and len(x) > 3]
    return {
        "avg_word_length": div(sum(map(len, w)), n),
        "avg_sentence_length": div(n, s),
        "vocabulary_richness": div(len(counts), n),
        "rare_word_frequency": div(once, n),
        "hapax_legomena_ratio": div(once, len(counts)),
        "avg_words_per_sentence": mean,
        "sentence_length_std": math.sqrt(variance),
        "sentence_length_variance": variance,
        "rhythm_score": min(math.sqrt(variance) / mean, 2.0) if s >= 2 and mean else 0.0,
        "simple_sentence_ratio": div(kinds["simple"], s),
        "compound_sentence_ratio": div(kinds["compound"], s),
        "complex_sentence_ratio": div(kinds["complex"], s),
        "question_ratio": div(t.count("?"), s),
        "exclamation_ratio": div(t.count("!"), s),
        "passive_voice_ratio": div(passive, s),
        "active_voice_ratio": 1.0 - min(div(passive, s), 1.0),
        "future_tense_ratio": div(t.lower().count("will "), n),
        "modal_verb_frequency": div(sum(x in lx.MODALS for x in w), n),
        "modal_verbs_used": sorted({x for x in w if x in lx.MODALS}),
        "intensifier_frequency": div(sum(x in lx.INTENSIFIERS for x in w), n),
        "slang_frequency": div(sum(x in lx.SLANG for x in w), n),
        "politeness_score": min(div(sum(m in t.lower() for m in lx.POLITENESS), s), 1.0),
        "discourse_marker_frequency": div(sum(m in t.lower() for m in lx.DISCOURSE), s),
        "discourse_markers_used": sorted(m for m in lx.DISCOURSE if m in t.lower())[:15],
        "dialogue_ratio": min(div(t.count('"') / 2, s), 1.0),
        "narrative_score": div(told, told + argued, 0.5),
        "analytical_score": div(argued, told + argued, 0.5),
        "comma_frequency": div(t.count(","), n),
        "semicolon_frequency": div(t.count(";"), n),
        "colon_frequency": div(t.count(":"), n),
        "dash_frequency": div(t.count("—") + t.count("–") + t.count(" - "), n),
        "ellipsis_frequency": div(t.count("...") + t.count("…"), n),
        "parentheses_frequency": div(t.count("("), n),
        "quote_frequency": div(t.count('"') + t.count("'"), n),
        "exclamation_frequency": div(t.count("!"), n),
        "question_mark_frequency": div(t.count("?"), n),
        "punctuation_density": div(len(re.findall(r'[,;:—–\-!?.()"\']', t)), n),
        "all_caps_frequency": div(len(re.findall(r"\b[A-Z]{2,}\b", t)), n),
        "title_case_frequency": div(len(re.findall(r"\b[A-Z][a-z]+\b", t)), n),
        "archaic_words": sorted({x for x in w if x in lx.ARCHAIC}),
        "formal_words": sorted({x for x in w if x in lx.FORMAL}),
        "top_words": top(content, 20),
        "top_bigrams": top([" ".join(p) for p in zip(w, w[1:])], 15),
        "top_trigrams": top([" ".join(p) for p in zip(w, w[1:], w[2:])], 10),
        "top_char_trigrams": top(char_grams(t, 3), 10),
        "top_char_fourgrams": top(char_grams(t, 4), 10),
    }
