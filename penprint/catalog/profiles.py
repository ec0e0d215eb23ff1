"""Queries on the fields of the style profile and on the profile as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from penprint import lexicons as lx
from penprint.catalog import texts as _texts  # noqa: F401  its queries are used by name below
from penprint.catalog.base import (
    CORPUS, DOCS, MARKED, NON_SPACE, QUERIES, SENTS, SPACE, SSUM, VOCAB, WORD, WORDS, WSUM,
    count_sql, documents, in_list, marked, marked_once, quote, register, with_ctes,
)
from penprint.functions import text as tx
from penprint.operators import counters as ct
from penprint.operators import edges as ed
from penprint.operators import grams as gr
from penprint.operators import sentiment as se
from penprint.operators import tokens as tk
from penprint.plans import profile as pr
from penprint.plans import reports as rp
from penprint.plans.keys import join_on
from penprint.session import scratch_path
from penprint.sources import tables as st

# Parts of the plan, each with only what a field needs ------------------------------------------


def lexicon(spark):
    return lx.sentiment_table(spark)


def word_part(spark, sf, scored=False, docs=None):
    docs = marked(spark, sf) if docs is None else docs
    return ct.word_counters(gr.vocabulary(docs), lexicon(spark) if scored else None)


def sentence_part(spark, sf, docs=None, placed=None):
    return ct.sentence_counters(marked(spark, sf) if docs is None else docs, placed=placed)


def text_part(spark, sf, seams=False, docs=None, placed=None):
    docs = marked(spark, sf) if docs is None else docs
    if seams and placed is None:
        placed = ed.place_edges(ed.text_edges(docs))
    return pr.text_part(docs, placed if seams else None)


def shared(spark, sf):
    """The marked texts and their placed edges for all parts of a query, each written once."""
    docs = marked_once(spark, sf)
    return {"docs": docs, "placed": ed.stored_edges(docs, without=(*ed.GRAMS, "inner"))}


def joined(*parts):
    first, *rest = parts
    for part in rest:
        first = join_on(first, part, ["author"], "left")
    return first


def pick(fields, *names):
    return [fields[n].alias(n) for n in names]


# SQL fragments over ``corpus`` (the joined text of an author) ----------------------------------

# Vowel groups less a silent final e, at least one.
VOWELS = "aeiouyàâäáèéêëìíîïòóôöùúûü"
SYL = f"greatest(1, len(regexp_extract_all(w, '[{VOWELS}]+')) - CASE WHEN regexp_matches(w, '[^{VOWELS}l]e$') THEN 1 ELSE 0 END)"


def _pos_sql(word: str) -> str:
    cases = [f"WHEN {word} IN {in_list(terms)} THEN '{tag}'" for tag, terms in lx.POS_WORDS.items()]
    for tag, before, endings in lx.POS_ENDINGS:
        cases.append(f"WHEN regexp_full_match({word}, '.{{{before},}}({'|'.join(endings)})') THEN '{tag}'")
    cases.append(f"WHEN regexp_full_match({word}, '\\p{{N}}+') THEN 'NUM'")
    cases.append(f"WHEN NOT regexp_matches({word}, {WORD}) THEN 'PUNCT'")
    return "CASE " + " ".join(cases) + " ELSE 'NOUN' END"


def _tense_sql(word: str, pos: str) -> str:
    return f"""CASE WHEN {pos} = 'VERB' THEN CASE WHEN {word} IN {in_list(lx.PAST_VERBS)} OR ends_with({word}, 'ed') THEN 'Past'
      WHEN {word} IN {in_list(lx.PRESENT_VERBS)} OR ends_with({word}, 'ing') THEN 'Pres' END END"""


VOCAB2 = f"vocab2 AS (SELECT *, {SYL} AS syl, {_pos_sql('w')} AS pos FROM vocab)"
VOCAB3 = f"vocab3 AS (SELECT *, {_tense_sql('w', 'pos')} AS tense FROM vocab2)"
WORD_CTES = (MARKED, CORPUS, WORDS, VOCAB)


def d(x: str) -> str:
    return f"({x})::DOUBLE"


def div(num: str, den: str, empty: str = "0.0") -> str:
    return f"CASE WHEN ({den}) = 0 THEN {empty} ELSE {d(num)} / {d(den)} END"


def hits(terms: list[str]) -> str:
    return f"coalesce(sum(n) FILTER (WHERE w IN {in_list(terms)}), 0)"


RAW_TOKENS = f"regexp_extract_all(t, {WORD})"
# Runs of words parted by white space only; a passive is an auxiliary next to a word in -ed.
WORD_RUNS = f"regexp_extract_all(lower(t), {quote(tx.WORD + '(?:' + SPACE + '+' + tx.WORD + ')*')})"
PASSIVES = f"""list_sum(list_transform({WORD_RUNS}, lambda r: len(list_filter(
   list_zip(regexp_extract_all(r, {WORD}), list_concat(regexp_extract_all(r, {WORD})[2:], [''])),
   lambda p: p[1] IN ('was', 'were', 'been', 'being') AND regexp_full_match(p[2], '.+ed')))))"""
MARK_SQL = {
    "n_comma": count_sql("t", ","),
    "n_semicolon": count_sql("t", ";"),
    "n_colon": count_sql("t", ":"),
    "n_dash": f"({count_sql('t', '—')} + {count_sql('t', '–')} + {count_sql('t', ' - ')})",
    "n_ellipsis": f"({count_sql('t', '...')} + {count_sql('t', '…')})",
    "n_paren": count_sql("t", "("),
    "n_quote": f"({count_sql('t', chr(34))} + {count_sql('t', chr(39))})",
    "n_exclamation": count_sql("t", "!"),
    "n_question": count_sql("t", "?"),
    "n_punct": "len(regexp_extract_all(t, '[,;:—–\\-!?.()\"'']'))",
    "n_all_caps": f"len(list_filter({RAW_TOKENS}, lambda x: regexp_full_match(x, '[A-Z]{{2,}}')))",
    "n_title_case": f"len(list_filter({RAW_TOKENS}, lambda x: regexp_full_match(x, '[A-Z][a-z]+')))",
}
TEXT_SQL = {
    "n_will": count_sql("lower(t)", "will "),
    "n_passive": PASSIVES,
    "n_double_quote": count_sql("t", '"'),
    "n_contractions": f"len(regexp_extract_all(t, {quote(tx.WORD + chr(39) + tx.WORD)}))",
    "n_other": f"len(regexp_extract_all(t, {quote('[^' + tx.WORD_CLASS + tx.SPACE_CHARS + ']')}))",
    "discourse": "len(list_filter([" + ", ".join(map(quote, lx.DISCOURSE)) + "], lambda m: contains(lower(t), m)))",
    "politeness": "len(list_filter([" + ", ".join(map(quote, lx.POLITENESS)) + "], lambda m: contains(lower(t), m)))",
}


def text_cte(*names: str) -> str:
    every = {**MARK_SQL, **TEXT_SQL}
    return "cnt AS (SELECT author, " + ", ".join(f"({every[n]})::BIGINT AS {n}" for n in names) + " FROM corpus)"


# Lexical fields -------------------------------------------------------------------------------

_W = (*WORD_CTES, WSUM)
_LEXICAL = {
    "avg_word_length": div("word_chars", "n_words"),
    "vocabulary_richness": div("n_distinct", "n_words"),
    "rare_word_frequency": div("n_once", "n_words"),
    "hapax_legomena_ratio": div("n_once", "n_distinct"),
}
for _field, _sql in _LEXICAL.items():
    register(
        _field,
        lambda spark, sf, f=_field: word_part(spark, sf).select("author", *pick(pr.lexical_fields(), f)),
        with_ctes(*_W, f"SELECT author, {_sql} AS {_field} FROM wsum"),
    )


def _approx_richness(spark, sf):
    """The exact value next to whether the sketch lies within five of its standard errors of it."""
    sketch = gr.approximate_richness(marked(spark, sf), error=0.01).withColumnRenamed("vocabulary_richness", "sketched")
    exact = word_part(spark, sf).select("author", *pick(pr.lexical_fields(), "vocabulary_richness"))
    close = F.abs(F.col("sketched") - F.col("vocabulary_richness")) <= 0.05 * F.col("vocabulary_richness")
    return exact.join(sketch, "author").select("author", "vocabulary_richness", close.alias("within_bound"))


register(
    "vocabulary_richness_approx",
    _approx_richness,
    with_ctes(*_W, f"SELECT author, {_LEXICAL['vocabulary_richness']} AS vocabulary_richness, true AS within_bound FROM wsum"),
)
register(
    "avg_sentence_length",
    lambda spark, sf: joined(sentence_part(spark, sf), word_part(spark, sf)).select(
        "author", *pick(pr.lexical_fields(), "avg_sentence_length")
    ),
    with_ctes(*_W, SENTS, SSUM, f"SELECT author, {div('n_words', 's')} AS avg_sentence_length FROM wsum JOIN ssum USING (author)"),
)
for _field, _terms in (("intensifier_frequency", lx.INTENSIFIERS), ("slang_frequency", lx.SLANG)):
    register(
        _field,
        lambda spark, sf, f=_field: word_part(spark, sf).select("author", *pick(pr.lexical_fields(), f)),
        with_ctes(*WORD_CTES, f"SELECT author, {div(hits(_terms), 'sum(n)')} AS {_field} FROM vocab GROUP BY author"),
    )

# Sentence fields ------------------------------------------------------------------------------

_SPREAD = "sqrt((s::HUGEINT * sq - sw::HUGEINT * sw)::DOUBLE)"
_S = (MARKED, CORPUS, SENTS, SSUM)
_SENTENCE = {
    "avg_words_per_sentence": div("sw", "s"),
    "sentence_length_std": f"{_SPREAD} / s::DOUBLE",
    "sentence_length_variance": "(s::HUGEINT * sq - sw::HUGEINT * sw)::DOUBLE / (s::DOUBLE * s)",
    "rhythm_score": f"CASE WHEN s < 2 OR sw = 0 THEN 0.0 ELSE least(({_SPREAD} / s::DOUBLE) / (sw::DOUBLE / s::DOUBLE), 2.0) END",
}
for _field, _sql in _SENTENCE.items():
    register(
        _field,
        lambda spark, sf, f=_field: sentence_part(spark, sf).select("author", *pick(pr.sentence_fields(), f)),
        with_ctes(*_S, f"SELECT author, {_sql} AS {_field} FROM ssum"),
    )
_TYPED = f"""typed AS (SELECT author, idx,
   list_has_any(regexp_extract_all(lower(s), {WORD}), {lx.CONJUNCTIONS}) AS conj,
   list_has_any(regexp_extract_all(lower(s), {WORD}), {lx.SUBORDINATORS}) AS sub,
   regexp_matches(lower(s), '{'|'.join(lx.CONJUNCTIONS)}') AS conj_any,
   regexp_matches(lower(s), '{'|'.join(lx.SUBORDINATORS)}') AS sub_any,
   contains(s, ',') OR contains(s, ';') AS pause FROM sents)"""
_TYPES = """types AS (SELECT author,
   CASE WHEN sub THEN 'complex' WHEN conj AND pause THEN 'compound' ELSE 'simple' END AS type,
   CASE WHEN sub_any OR (pause AND conj_any) THEN 'complex' ELSE 'simple' END AS type_compat FROM typed)"""
for _kind in ("simple", "compound", "complex"):
    register(
        f"{_kind}_sentence_ratio",
        lambda spark, sf, f=f"{_kind}_sentence_ratio": sentence_part(spark, sf).select("author", *pick(pr.sentence_fields(), f)),
        with_ctes(
            MARKED, CORPUS, SENTS, _TYPED, _TYPES,
            f"SELECT author, count(*) FILTER (WHERE type = '{_kind}')::DOUBLE / count(*)::DOUBLE AS {_kind}_sentence_ratio FROM types GROUP BY author",
        ),
    )
register(
    "sentence_type_ratios_compat",
    lambda spark, sf: ct.sentence_counters(marked(spark, sf), compat=True).select(
        "author", *pick(pr.sentence_fields(), "simple_sentence_ratio", "compound_sentence_ratio", "complex_sentence_ratio")
    ),
    with_ctes(
        MARKED, CORPUS, SENTS, _TYPED, _TYPES,
        """SELECT author, count(*) FILTER (WHERE type_compat = 'simple')::DOUBLE / count(*)::DOUBLE AS simple_sentence_ratio,
           0.0::DOUBLE AS compound_sentence_ratio,
           count(*) FILTER (WHERE type_compat = 'complex')::DOUBLE / count(*)::DOUBLE AS complex_sentence_ratio FROM types GROUP BY author""",
    ),
)

# Pattern, mark and discourse fields -----------------------------------------------------------

_TS = {
    "question_ratio": ("n_question", div("n_question", "s"), False),
    "exclamation_ratio": ("n_exclamation", div("n_exclamation", "s"), False),
    "passive_voice_ratio": ("n_passive", div("n_passive", "s"), True),
    "active_voice_ratio": ("n_passive", f"1.0 - least({div('n_passive', 's')}, 1.0)", True),
}


def _text_and_sentences(spark, sf, seams):
    both = shared(spark, sf)
    return joined(text_part(spark, sf, seams, **both), sentence_part(spark, sf, **both))


for _field, (_count, _sql, _seams) in _TS.items():
    register(
        _field,
        lambda spark, sf, f=_field, seams=_seams: _text_and_sentences(spark, sf, seams)
        .withColumns({"n_words": F.lit(1), "n_modal": F.lit(0)})
        .select("author", *pick(pr.pattern_fields(), f)),
        with_ctes(*_S, text_cte(_count), f"SELECT author, {_sql} AS {_field} FROM cnt JOIN ssum USING (author)"),
    )


def _future(spark, sf):
    both = shared(spark, sf)
    parts = joined(text_part(spark, sf, True, **both), word_part(spark, sf, docs=both["docs"]), sentence_part(spark, sf, **both))
    return parts.select("author", *pick(pr.pattern_fields(), "future_tense_ratio"))


register(
    "future_tense_ratio",
    _future,
    with_ctes(*_W, text_cte("n_will"), f"SELECT author, {div('n_will', 'n_words')} AS future_tense_ratio FROM cnt JOIN wsum USING (author)"),
)
register(
    "modal_verb_frequency",
    lambda spark, sf: word_part(spark, sf).withColumns(
        {n: F.lit(1) for n in ("n_sentences", "n_question", "n_exclamation", "n_passive", "n_will")}
    ).select("author", *pick(pr.pattern_fields(), "modal_verb_frequency")),
    with_ctes(*WORD_CTES, f"SELECT author, {div(hits(lx.MODALS), 'sum(n)')} AS modal_verb_frequency FROM vocab GROUP BY author"),
)
_MARKS = {
    "punctuation_density": "n_punct", "comma_frequency": "n_comma", "semicolon_frequency": "n_semicolon",
    "colon_frequency": "n_colon", "dash_frequency": "n_dash", "ellipsis_frequency": "n_ellipsis",
    "parentheses_frequency": "n_paren", "quote_frequency": "n_quote", "exclamation_frequency": "n_exclamation",
    "question_mark_frequency": "n_question", "all_caps_frequency": "n_all_caps", "title_case_frequency": "n_title_case",
}
for _field, _count in _MARKS.items():
    register(
        _field,
        lambda spark, sf, f=_field: joined(text_part(spark, sf, f == "dash_frequency"), word_part(spark, sf)).select(
            "author", *pick(pr.mark_fields(), f)
        ),
        with_ctes(*_W, text_cte(_count), f"SELECT author, {div(_count, 'n_words')} AS {_field} FROM cnt JOIN wsum USING (author)"),
    )


def _discourse(spark, sf, field, compat=False):
    parts = _text_and_sentences(spark, sf, field == "politeness_score")
    return parts.withColumns({"n_narrative": F.lit(0), "n_analytical": F.lit(0)}).select(
        "author", *pick(pr.discourse_fields(compat), field)
    )


register(
    "discourse_marker_frequency",
    lambda spark, sf: _discourse(spark, sf, "discourse_marker_frequency"),
    with_ctes(*_S, text_cte("discourse"), f"SELECT author, {div('discourse', 's')} AS discourse_marker_frequency FROM cnt JOIN ssum USING (author)"),
)
register(
    "politeness_score",
    lambda spark, sf: _discourse(spark, sf, "politeness_score"),
    with_ctes(*_S, text_cte("politeness"), f"SELECT author, least({div('politeness', 's')}, 1.0) AS politeness_score FROM cnt JOIN ssum USING (author)"),
)
register(
    "dialogue_ratio",
    lambda spark, sf: _discourse(spark, sf, "dialogue_ratio"),
    with_ctes(
        *_S, text_cte("n_double_quote"),
        "SELECT author, least((n_double_quote::DOUBLE / 2) / s::DOUBLE, 1.0) AS dialogue_ratio FROM cnt JOIN ssum USING (author)",
    ),
)
_ASKING = f"""asking AS (SELECT author, sum(len(list_filter(regexp_extract_all(text, '[^.!?]+[.!?]*'),
   lambda s: contains(s, '?') AND (contains(lower(s), 'why ') OR contains(lower(s), 'how could') OR contains(lower(s), 'who knows')
     OR contains(lower(s), 'what if') OR contains(lower(s), 'isn''t it')))))::BIGINT AS asked FROM docs GROUP BY author)"""
register(
    "rhetorical_question_ratio",
    lambda spark, sf: _discourse(spark, sf, "rhetorical_question_ratio"),
    with_ctes(*_S, _ASKING, f"SELECT author, {div('asked', 's')} AS rhetorical_question_ratio FROM asking JOIN ssum USING (author)"),
)
register(
    "discourse_markers_used",
    lambda spark, sf: text_part(spark, sf).select("author", F.explode("discourse_found").alias("marker")),
    with_ctes(
        MARKED, CORPUS,
        "found AS (SELECT author, unnest(list_sort(list_filter([" + ", ".join(map(quote, lx.DISCOURSE)) + "], lambda m: contains(lower(t), m)))) AS marker FROM corpus)",
        "SELECT author, marker FROM found",
    ),
)
for _field, _top in (("narrative_score", "told"), ("analytical_score", "argued")):
    register(
        _field,
        lambda spark, sf, f=_field: word_part(spark, sf)
        .withColumns({"n_sentences": F.lit(1), "n_rhetorical": F.lit(0), "n_double_quote": F.lit(0)})
        .withColumns({"discourse_found": F.array(), "politeness_found": F.array()})
        .select("author", *pick(pr.discourse_fields(False), f)),
        with_ctes(
            *WORD_CTES,
            f"h AS (SELECT author, {hits(lx.NARRATIVE)} AS told, {hits(lx.ANALYTICAL)} AS argued FROM vocab GROUP BY author)",
            f"SELECT author, {div(_top, 'told + argued', '0.5')} AS {_field} FROM h",
        ),
    )

# Sentiment ------------------------------------------------------------------------------------

_LEX = "lex(term, valence, polarity, subjectivity, emotion) AS (VALUES " + ", ".join(
    f"({quote(t)}, {v}, {p}, {s}, {quote(e)})" for t, v, p, s, e in lx.SENTIMENT
) + ")"
register(
    "sentiment_polarity_subjectivity",
    lambda spark, sf: word_part(spark, sf, scored=True).select("author", *[f.alias(n) for n, f in pr.sentiment_fields().items()]),
    with_ctes(
        *WORD_CTES, _LEX,
        f"""SELECT author, {div('coalesce(sum(n * polarity), 0)', 'count(term) * 0 + coalesce(sum(n) FILTER (WHERE term IS NOT NULL), 0) * 100')} AS sentiment_polarity,
            {div('coalesce(sum(n * subjectivity), 0)', 'coalesce(sum(n) FILTER (WHERE term IS NOT NULL), 0) * 100')} AS sentiment_subjectivity
            FROM vocab LEFT JOIN lex ON w = term GROUP BY author""",
    ),
)


def _valence(spark, sf):
    docs = marked(spark, sf)
    both = joined(ct.word_counters(gr.vocabulary(docs)), se.valence_counters(docs, lexicon(spark)))
    sums = [F.coalesce(F.col(n), F.lit(0)) for n in ("valence_sum", "positive_sum", "negative_sum", "n_charged")]
    fields = se.valence_fields(*sums, F.col("n_words"))
    return both.select("author", *[f.alias(n) for n, f in fields.items()])


_BACK = ", ".join(f"lag(w, {i}) OVER a AS p{i}" for i in (1, 2, 3))
_STEP = " + ".join(
    f"CASE WHEN p{i} IN {in_list(lx.BOOSTERS)} THEN {step} WHEN p{i} IN {in_list(lx.DAMPENERS)} THEN -{step} ELSE 0 END"
    for i, step in zip((1, 2, 3), se.STEPS)
)
_NEG = " OR ".join(f"coalesce(p{i} IN {in_list(lx.NEGATIONS)}, false)" for i in (1, 2, 3))
register(
    "vader_scores",
    _valence,
    with_ctes(
        MARKED, CORPUS, WORDS, VOCAB, WSUM, _LEX,
        f"""dw AS (SELECT author, seq, unnest(l) AS w, unnest(range(len(l))) AS pos
             FROM (SELECT author, seq, regexp_extract_all(lower(text), {WORD}) AS l FROM docs))""",
        f"ctx AS (SELECT author, w, {_BACK} FROM dw WINDOW a AS (PARTITION BY author, seq ORDER BY pos))",
        f"hit AS (SELECT author, valence * 100000 AS v, {_STEP} AS step, {_NEG} AS neg FROM ctx JOIN lex ON w = term)",
        "b AS (SELECT author, neg, CASE WHEN v = 0 THEN 0 WHEN v > 0 THEN v + step ELSE v - step END AS b FROM hit)",
        "x AS (SELECT author, CASE WHEN neg THEN (-74 * b) // 100 ELSE b END AS x FROM b)",
        """z AS (SELECT author, sum(x)::BIGINT AS x, coalesce(sum(x + 1000000) FILTER (WHERE x > 0), 0)::BIGINT AS p,
             coalesce(sum(-x + 1000000) FILTER (WHERE x < 0), 0)::BIGINT AS q, count(*) FILTER (WHERE x <> 0) AS c FROM x GROUP BY author)""",
        "y AS (SELECT author, coalesce(x, 0) AS x, coalesce(p, 0) AS p, coalesce(q, 0) AS q, (n_words - coalesce(c, 0)) * 1000000 AS u FROM wsum LEFT JOIN z USING (author))",
        """SELECT author, p::DOUBLE / (p + q + u)::DOUBLE AS vader_positive, q::DOUBLE / (p + q + u)::DOUBLE AS vader_negative,
             u::DOUBLE / (p + q + u)::DOUBLE AS vader_neutral,
             (x::DOUBLE / 1000000) / sqrt((x::DOUBLE / 1000000) * (x::DOUBLE / 1000000) + 15.0) AS vader_compound FROM y""",
    ),
)
register(
    "top_emotions",
    lambda spark, sf: se.emotion_shares(gr.vocabulary(marked(spark, sf)), lexicon(spark)),
    with_ctes(
        *WORD_CTES, _LEX,
        "e AS (SELECT author, emotion AS label, sum(n)::BIGINT AS n FROM vocab JOIN lex ON w = term GROUP BY 1, 2)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY n DESC, label) AS rank, sum(n) OVER (PARTITION BY author) AS total FROM e)",
        "SELECT author, rank, label, n::DOUBLE / total::DOUBLE AS share FROM r WHERE rank <= 5",
    ),
)


def _formality(spark, sf, compat=False):
    both = joined(text_part(spark, sf), word_part(spark, sf))
    c = pr.c
    value = pr.formality(
        c("n_pos_noun"), c("n_words") + c("n_other_tokens"), c("n_formal"), c("n_contractions"), c("n_words"), compat
    )
    return both.select("author", value.alias("formality_score"))


def _formality_sql(compat: bool) -> str:
    formal = f"least({div('formal', 'n_words')}, 0.3::DOUBLE) * 10" if compat else f"least({div('formal', 'n_words')} * 10, 0.3::DOUBLE)"
    plain = "0.3::DOUBLE" if compat else f"greatest(0.0::DOUBLE, 0.3::DOUBLE - ({div('n_contractions', 'n_words')}) * 5)"
    return with_ctes(
        *WORD_CTES, VOCAB2, text_cte("n_contractions", "n_other"),
        f"h AS (SELECT author, sum(n) AS n_words, coalesce(sum(n) FILTER (WHERE pos = 'NOUN'), 0) AS nouns, {hits(lx.FORMAL)} AS formal FROM vocab2 GROUP BY author)",
        f"""SELECT author, least(least({div('nouns', 'n_words + n_other')}, 0.4::DOUBLE) + ({formal} + {plain}), 1.0::DOUBLE) AS formality_score
            FROM h JOIN cnt USING (author)""",
    )


register("formality_score", _formality, _formality_sql(False))
register("formality_score_compat", lambda spark, sf: _formality(spark, sf, True), _formality_sql(True))

# Tags, tenses, trees --------------------------------------------------------------------------

TOKENS_SQL = (
    MARKED,
    f"""es AS (SELECT author, seq, unnest(l) AS s, unnest(range(len(l))) AS sent_id FROM
         (SELECT author, seq, list_filter(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: regexp_matches(x, {NON_SPACE})) AS l FROM docs))""",
    f"""tok AS (SELECT author, seq, sent_id, unnest(range(1, len(l) + 1)) AS tok_id, unnest(l) AS word FROM
         (SELECT author, seq, sent_id, regexp_extract_all(lower(s), {quote(tk.TOKEN)}) AS l FROM es))""",
    f"tokens AS (SELECT *, {_pos_sql('word')} AS pos FROM tok)",
)


def _tokens(spark, sf):
    return tk.annotate_tokens(marked(spark, sf))


register(
    "annotate_tokens",
    lambda spark, sf: _tokens(spark, sf).groupBy("author", "word", "pos", "tense").agg(
        F.count(F.lit(1)).alias("n"), F.max("tok_id").cast("bigint").alias("last_tok_id")
    ),
    with_ctes(
        *TOKENS_SQL,
        f"SELECT author, word, pos, {_tense_sql('word', 'pos')} AS tense, count(*) AS n, max(tok_id)::BIGINT AS last_tok_id FROM tokens GROUP BY ALL",
    ),
)
_SHARES = ", ".join(f"count(*) FILTER (WHERE pos = '{tag}')::DOUBLE / count(*)::DOUBLE AS {name}" for name, tag in tk.POS_FIELDS.items())
register("pos_ratios", lambda spark, sf: tk.pos_ratios(_tokens(spark, sf)), with_ctes(*TOKENS_SQL, f"SELECT author, {_SHARES} FROM tokens GROUP BY author"))
register(
    "tense_ratios",
    lambda spark, sf: tk.tense_ratios(_tokens(spark, sf)),
    with_ctes(
        *TOKENS_SQL,
        f"t AS (SELECT author, {_tense_sql('word', 'pos')} AS tense FROM tokens)",
        f"""SELECT author, {div("count(*) FILTER (WHERE tense = 'Pres')", "count(tense)")} AS present_tense_ratio,
            {div("count(*) FILTER (WHERE tense = 'Past')", "count(tense)")} AS past_tense_ratio FROM t GROUP BY author""",
    ),
)
register(
    "concreteness_score",
    lambda spark, sf: tk.concreteness(_tokens(spark, sf)),
    with_ctes(
        *TOKENS_SQL,
        """k AS (SELECT author, count(*) FILTER (WHERE pos IN ('NOUN', 'PROPN', 'NUM'))::DOUBLE / count(*)::DOUBLE AS c,
             count(*) FILTER (WHERE pos IN ('ADJ', 'ADV'))::DOUBLE / count(*)::DOUBLE AS a FROM tokens GROUP BY author)""",
        "SELECT author, least(c / (c + a + 0.1::DOUBLE), 1.0::DOUBLE) AS concreteness_score FROM k",
    ),
)
# Every token hangs on its right neighbour or on the root, so its depth is the way to the next
# token that does not hang rightwards.
_DEPTHS = (
    *TOKENS_SQL,
    f"""roots AS (SELECT author, seq, sent_id, max(tok_id) AS last,
         coalesce(min(tok_id) FILTER (WHERE pos = 'VERB'), min(tok_id) FILTER (WHERE pos = 'NOUN'), 1) AS root
         FROM tokens GROUP BY author, seq, sent_id)""",
    f"""stops AS (SELECT t.*, root, (tok_id = root OR tok_id = last OR pos NOT IN {in_list(lx.ATTACH_RIGHT)}) AS stop
         FROM tokens t JOIN roots USING (author, seq, sent_id))""",
    """ways AS (SELECT author, seq, sent_id, tok_id, root, min(CASE WHEN stop THEN tok_id END) OVER (
         PARTITION BY author, seq, sent_id ORDER BY tok_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS till FROM stops)""",
    "depths AS (SELECT author, seq, sent_id, max(till - tok_id + CASE WHEN till = root THEN 0 ELSE 1 END)::BIGINT AS depth FROM ways GROUP BY author, seq, sent_id)",
)
register(
    "parse_tree_depth",
    lambda spark, sf: tk.depth_fields(tk.rule_depths(marked(spark, sf).select("author", "text"))).select(
        "author", tx.ratio(F.col("depth_sum"), F.col("n_trees")).alias("avg_parse_tree_depth"), F.col("depth_max").alias("max_parse_tree_depth")
    ),
    with_ctes(
        *_DEPTHS,
        "SELECT author, sum(depth)::DOUBLE / count(*)::DOUBLE AS avg_parse_tree_depth, max(depth) AS max_parse_tree_depth FROM depths GROUP BY author",
    ),
)


def _linked_depths(spark, sf):
    """The same trees as explicit head links, followed by doubling."""
    sents = tk.split_rows(documents(spark, sf), "text")
    tags = F.transform(F.regexp_extract_all(F.lower(F.col("sentence")), F.lit(tk.TOKEN), F.lit(0)), tx.pos_tag)
    heads = sents.select("author", "seq", "sent_id", tags.alias("tags")).select(
        "author", "seq", "sent_id", F.posexplode(tk.rule_heads(F.col("tags"))).alias("p", "h")
    )
    tokens = heads.select("author", "seq", "sent_id", (F.col("p") + 1).alias("tok_id"), (F.col("h") + 1).alias("head_id"))
    return tk.sentence_depths(tokens, ["author", "seq", "sent_id"]).withColumn("sent_id", F.col("sent_id").cast("bigint"))


register(
    "parse_tree_depth_links",
    _linked_depths,
    with_ctes(
        "docs AS (SELECT source AS author, doc_id AS seq, text FROM documents)",
        *_DEPTHS[1:],
        "SELECT author, seq, sent_id::BIGINT AS sent_id, depth FROM depths",
    ),
)

# Readability ----------------------------------------------------------------------------------

_READ = {
    "flesch_reading_ease": "206.835::DOUBLE - 1.015::DOUBLE * (w / s) - 84.6::DOUBLE * (syl / w)",
    "flesch_kincaid_grade": "0.39::DOUBLE * (w / s) + 11.8::DOUBLE * (syl / w) - 15.59::DOUBLE",
    "gunning_fog_index": "0.4::DOUBLE * ((w / s) + 100.0::DOUBLE * (poly / w))",
    "coleman_liau_index": "0.0588::DOUBLE * (100.0::DOUBLE * (chars / w)) - 0.296::DOUBLE * (100.0::DOUBLE * (s / w)) - 15.8::DOUBLE",
    "smog_index": "CASE WHEN s >= 3 THEN 1.043::DOUBLE * sqrt((30 * poly) / s) + 3.1291::DOUBLE ELSE 0.0::DOUBLE END",
}
_READ_CTE = """r AS (SELECT author, sum(n)::DOUBLE AS w, any_value(ssum.s)::DOUBLE AS s, sum(n * syl)::DOUBLE AS syl,
   coalesce(sum(n) FILTER (WHERE syl >= 3), 0)::DOUBLE AS poly, sum(n * length(w))::DOUBLE AS chars
   FROM vocab2 JOIN ssum USING (author) GROUP BY author)"""
for _field, _sql in _READ.items():
    register(
        _field,
        lambda spark, sf, f=_field: joined(sentence_part(spark, sf), word_part(spark, sf)).select(
            "author", *pick(pr.readability_fields(), f)
        ),
        with_ctes(*WORD_CTES, VOCAB2, SENTS, SSUM, _READ_CTE, f"SELECT author, {_sql} AS {_field} FROM r"),
    )

# The whole profile ----------------------------------------------------------------------------


def profile(spark, sf, **options):
    return pr.style_profile(marked_once(spark, sf), **options)


_PROFILE_CTES = (
    *WORD_CTES, VOCAB2, VOCAB3, WSUM, SENTS, SSUM, _TYPED, _TYPES,
    "ty AS (SELECT author, count(*) FILTER (WHERE type = 'simple') AS simple, count(*) FILTER (WHERE type = 'compound') AS compound, count(*) FILTER (WHERE type = 'complex') AS complex FROM types GROUP BY author)",
    text_cte(*MARK_SQL, *TEXT_SQL), _ASKING,
    "tags AS (SELECT author, " + ", ".join(
        f"coalesce(sum(n) FILTER (WHERE pos = '{t}'), 0)::BIGINT AS {t.lower()}" for t in ct.COUNTED_TAGS
    ) + """, coalesce(sum(n) FILTER (WHERE tense = 'Pres'), 0)::BIGINT AS pres, coalesce(sum(n) FILTER (WHERE tense = 'Past'), 0)::BIGINT AS past,
      sum(n * syl)::BIGINT AS syl, coalesce(sum(n) FILTER (WHERE syl >= 3), 0)::BIGINT AS poly,
      """ + ", ".join(f"{hits(terms)}::BIGINT AS l_{name}" for name, terms in ct.WORD_LISTS.items()) + " FROM vocab3 GROUP BY author)",
)
_A = "(n_words + n_other)"
_PROFILE_SQL = {
    **_LEXICAL,
    "avg_sentence_length": div("n_words", "s"),
    "intensifier_frequency": div("l_intensifier", "n_words"),
    "slang_frequency": div("l_slang", "n_words"),
    **_SENTENCE,
    "simple_sentence_ratio": div("simple", "s"),
    "compound_sentence_ratio": div("compound", "s"),
    "complex_sentence_ratio": div("complex", "s"),
    **{f: sql for f, (_, sql, _) in _TS.items()},
    "present_tense_ratio": div("pres", "pres + past"),
    "past_tense_ratio": div("past", "pres + past"),
    "future_tense_ratio": div("n_will", "n_words"),
    "modal_verb_frequency": div("l_modal", "n_words"),
    **{name: div(tag.lower(), _A) for name, tag in tk.POS_FIELDS.items()},
    **{f: div(n, "n_words") for f, n in _MARKS.items()},
    "discourse_marker_frequency": div("discourse", "s"),
    "politeness_score": f"least({div('politeness', 's')}, 1.0::DOUBLE)",
    "rhetorical_question_ratio": div("asked", "s"),
    "dialogue_ratio": "least((n_double_quote::DOUBLE / 2) / s::DOUBLE, 1.0::DOUBLE)",
    "narrative_score": div("l_narrative", "l_narrative + l_analytical", "0.5"),
    "analytical_score": div("l_analytical", "l_narrative + l_analytical", "0.5"),
    **{
        f: sql.replace("(w / s)", "(n_words::DOUBLE / s::DOUBLE)").replace("(syl / w)", "(syl::DOUBLE / n_words::DOUBLE)")
        .replace("(poly / w)", "(poly::DOUBLE / n_words::DOUBLE)").replace("(chars / w)", "(word_chars::DOUBLE / n_words::DOUBLE)")
        .replace("(s / w)", "(s::DOUBLE / n_words::DOUBLE)").replace("(30 * poly) / s", "(30 * poly)::DOUBLE / s::DOUBLE")
        for f, sql in _READ.items()
    },
}


def _profile_sql(fields: dict[str, str], rounded: bool = False) -> str:
    def value(name, sql):
        return f"round({sql}, {pr.FIELDS[name]})" if rounded else sql

    columns = ", ".join(f"{value(n, sql)} AS {n}" for n, sql in fields.items())
    return with_ctes(
        *_PROFILE_CTES,
        f"SELECT author, {columns} FROM wsum JOIN ssum USING (author) JOIN ty USING (author) JOIN cnt USING (author) JOIN tags USING (author) JOIN asking USING (author)",
    )


PROFILE_FIELDS = list(_PROFILE_SQL)
register("style_profile", lambda spark, sf: profile(spark, sf, only=PROFILE_FIELDS).select("author", *PROFILE_FIELDS), _profile_sql(_PROFILE_SQL))


def _whole_profile(docs):
    """All 72 fields in long form: numbers as they are, lists as joined text."""
    p = pr.style_profile(docs)
    rows = [F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value"), F.lit(None).cast("string").alias("terms"))
            for f in [*pr.SCALAR_FIELDS, "max_parse_tree_depth"]]
    rows += [F.struct(F.lit(f).alias("field"), F.lit(None).cast("double").alias("value"), F.array_join(f, "|").alias("terms")) for f in pr.LIST_FIELDS]
    rows.append(F.struct(F.lit("top_emotions").alias("field"), F.lit(None).cast("double").alias("value"),
                         F.array_join(F.col("top_emotions.label"), "|").alias("terms")))
    return p.select("author", F.inline(F.array(*rows)))


_DOC_FIELDS = ["avg_words_per_sentence", "comma_frequency", "passive_voice_ratio", "hapax_legomena_ratio"]
register(
    "style_profile_document_scope",
    lambda spark, sf: profile(spark, sf, scope="document", only=_DOC_FIELDS).select("author", *_DOC_FIELDS),
    with_ctes(
        *WORD_CTES, WSUM,
        f"""ds AS (SELECT author, count(*) AS s, sum(len(regexp_extract_all(x, {WORD})))::BIGINT AS sw FROM (SELECT author,
             unnest(list_filter(string_split_regex(text, '[.!?]+'), lambda x: regexp_matches(x, {NON_SPACE}))) AS x FROM docs) GROUP BY author)""",
        "dc AS (SELECT author, sum(p)::BIGINT AS p, sum(c)::BIGINT AS c FROM (SELECT author, " + f"{PASSIVES.replace('lower(t)', 'lower(text)')} AS p, {count_sql('text', ',')} AS c FROM docs) GROUP BY author)",
        f"""SELECT author, {div('sw', 's')} AS avg_words_per_sentence, {div('c', 'n_words')} AS comma_frequency, {div('p', 's')} AS passive_voice_ratio,
            {div('n_once', 'n_distinct')} AS hapax_legomena_ratio FROM wsum JOIN ds USING (author) JOIN dc USING (author)""",
    ),
)
_ROUNDED = [
    "avg_word_length", "vocabulary_richness", "hapax_legomena_ratio", "avg_words_per_sentence", "comma_frequency",
    "dash_frequency", "flesch_reading_ease", "smog_index", "politeness_score", "noun_ratio",
]
register(
    "round_profile",
    lambda spark, sf: rp.round_profile(profile(spark, sf)).select("author", *_ROUNDED),
    _profile_sql({f: _PROFILE_SQL[f] for f in _ROUNDED}, rounded=True),
)
_TOP10 = f"""tw AS (SELECT author, string_agg(w, '|' ORDER BY r) AS top_words FROM (SELECT author, w,
   row_number() OVER (PARTITION BY author ORDER BY n DESC, first) AS r FROM vocab WHERE length(w) > 3 AND w NOT IN {in_list(lx.STOP_WORDS)}) WHERE r <= 10 GROUP BY author)"""
register(
    "profile_summary",
    lambda spark, sf: rp.profile_summary(profile(spark, sf, only=rp.SUMMARY_FIELDS)).select(
        "author", "avg_word_length", "avg_sentence_length", "vocabulary_richness", "flesch_kincaid_grade", F.array_join("top_words", "|").alias("top_words")
    ),
    with_ctes(
        *WORD_CTES, VOCAB2, WSUM, SENTS, SSUM, _READ_CTE, _TOP10,
        f"g AS (SELECT author, {_READ['flesch_kincaid_grade']} AS grade FROM r)",
        f"""SELECT author, round({_LEXICAL['avg_word_length']}, 2) AS avg_word_length, round({_SENTENCE['avg_words_per_sentence']}, 2) AS avg_sentence_length,
            round({_LEXICAL['vocabulary_richness']}, 3) AS vocabulary_richness, round(grade, 1) AS flesch_kincaid_grade, top_words
            FROM wsum JOIN ssum USING (author) JOIN g USING (author) JOIN tw USING (author)""",
    ),
)
# As Java prints: halves go up, by the digits that are shown.
_SHOWN_POLARITY = "CASE WHEN p < 0 THEN '-' ELSE '' END || printf('%.2f', round(abs(p)::DECIMAL(18, 3), 2)::DOUBLE)"
register(
    "profile_cards",
    lambda spark, sf: rp.profile_cards(rp.profile_summary(profile(spark, sf, only=rp.SUMMARY_FIELDS))).select("author", "label", "value"),
    with_ctes(
        *WORD_CTES, VOCAB2, WSUM, SENTS, SSUM, _READ_CTE, _TOP10,
        f"v AS (SELECT author, round({_LEXICAL['avg_word_length']}, 2) AS a, round({_SENTENCE['avg_words_per_sentence']}, 2) AS b, round({_LEXICAL['vocabulary_richness']}, 3) AS c FROM wsum JOIN ssum USING (author))",
        f"fs AS (SELECT author, round(formality_score, 3) AS f FROM ({QUERIES['formality_score'].sql}))",
        f"ps AS (SELECT author, round(sentiment_polarity, 3) AS p FROM ({QUERIES['sentiment_polarity_subjectivity'].sql}))",
        f"gs AS (SELECT author, round({_READ['flesch_kincaid_grade']}, 1) AS g FROM r)",
        f"""SELECT author, 'Avg Word Length' AS label, printf('%.2f chars', a) AS value FROM v
           UNION ALL SELECT author, 'Sentence Length', printf('%.1f words', round(b, 1)) FROM v
           UNION ALL SELECT author, 'Vocabulary Richness', printf('%.1f%%', c * 100) FROM v
           UNION ALL SELECT author, 'Formality', printf('%.0f%%', round(f * 100)) FROM fs
           UNION ALL SELECT author, 'Sentiment', CASE WHEN p > 0 THEN '😊' WHEN p < 0 THEN '😔' ELSE '😐' END || ' ' || {_SHOWN_POLARITY} FROM ps
           UNION ALL SELECT author, 'Reading Level', printf('Grade %.1f', CASE WHEN g = 0 THEN 0.0::DOUBLE ELSE g END) FROM gs
           UNION ALL SELECT author, 'Top Words', replace(top_words, '|', ', ') FROM tw""",
    ),
)
_LISTED = [(cat, f) for cat, entries in rp.LISTING.items() for f, _ in entries if f in _PROFILE_SQL]


def _long_sql(rows: list[tuple[str, str, str]], names: tuple[str, str, str]) -> str:
    """Profile fields in long form; ``rows`` are (first name, second name, expression)."""
    fields = {f"x{i}": sql for i, (_, _, sql) in enumerate(rows)}
    inner = _profile_sql_raw(fields)
    parts = " UNION ALL ".join(
        f"SELECT author, '{a}' AS {names[0]}, '{b}' AS {names[1]}, x{i}::DOUBLE AS {names[2]} FROM p" for i, (a, b, _) in enumerate(rows)
    )
    return inner + parts


def _profile_sql_raw(fields: dict[str, str]) -> str:
    columns = ", ".join(f"{sql} AS {n}" for n, sql in fields.items())
    p = f"p AS MATERIALIZED (SELECT author, {columns} FROM wsum JOIN ssum USING (author) JOIN ty USING (author) JOIN cnt USING (author) JOIN tags USING (author) JOIN asking USING (author))"
    return "WITH " + ",\n".join((*_PROFILE_CTES, p)) + "\n"


register(
    "profile_report",
    lambda spark, sf: rp.profile_report(profile(spark, sf)).where(F.col("metric").isin([f for _, f in _LISTED])).select("author", "category", "metric", "value"),
    _long_sql([(cat, f, _PROFILE_SQL[f]) for cat, f in _LISTED], ("category", "metric", "value")),
)
_SCALES = {
    "avg_word_length": "({}) / 10", "rare_word_frequency": "({}) * 10", "flesch_reading_ease": "least(({}) / 100.0::DOUBLE, 1.0::DOUBLE)",
    "flesch_kincaid_grade": "least(({}) / 20.0::DOUBLE, 1.0::DOUBLE)", "gunning_fog_index": "least(({}) / 20.0::DOUBLE, 1.0::DOUBLE)",
    "coleman_liau_index": "least(({}) / 20.0::DOUBLE, 1.0::DOUBLE)", "comma_frequency": "({}) * 10", "semicolon_frequency": "({}) * 100",
    "dash_frequency": "({}) * 100", "ellipsis_frequency": "({}) * 100", "quote_frequency": "({}) * 10", "parentheses_frequency": "({}) * 100",
    "rhythm_score": "least(({}) / 2.0::DOUBLE, 1.0::DOUBLE)",
}
_CHARTED = [(panel, f) for panel, fields in rp.PANEL_FIELDS.items() for f in fields if f in _PROFILE_SQL]
register(
    "profile_chart_values",
    lambda spark, sf: rp.profile_chart_values(profile(spark, sf)).where(F.col("label").isin([f for _, f in _CHARTED])),
    _long_sql([(p, f, _SCALES.get(f, "{}").format(_PROFILE_SQL[f])) for p, f in _CHARTED], ("panel", "label", "value")),
)
register(
    "profile_field_counts",
    lambda spark, sf: rp.profile_field_counts(profile(spark, sf)),
    "SELECT source AS author, 72::BIGINT AS total_features, 62::BIGINT AS numeric_features, 10::BIGINT AS pattern_features FROM documents GROUP BY source",
)


def _sink_json(spark, sf):
    path = scratch_path(spark, "profiles")
    p = profile(spark, sf)
    st.sink_profile_json(p, path)
    back = spark.read.schema(p.schema).json(path)
    return back.select("author", *_LEXICAL)


register(
    "sink_profile_json",
    _sink_json,
    with_ctes(*_W, "SELECT author, " + ", ".join(f"{sql} AS {f}" for f, sql in _LEXICAL.items()) + " FROM wsum"),
)


# All 72 fields at once, put together from the queries above.

_SOURCES = {
    "sentiment_polarity": "sentiment_polarity_subjectivity", "sentiment_subjectivity": "sentiment_polarity_subjectivity",
    **{f: "vader_scores" for f in ("vader_positive", "vader_negative", "vader_neutral", "vader_compound")},
    "formality_score": "formality_score", "concreteness_score": "concreteness_score",
    "avg_parse_tree_depth": "parse_tree_depth", "max_parse_tree_depth": "parse_tree_depth",
}


def _all_fields_sql() -> str:
    selects = [
        f"SELECT author, '{field}' AS field, {field}::DOUBLE AS value, NULL::VARCHAR AS terms FROM p" for field in _PROFILE_SQL
    ]
    selects += [f"SELECT author, '{field}', {field}::DOUBLE, NULL FROM ({QUERIES[source].sql})" for field, source in _SOURCES.items()]
    for field in ("top_words", "top_bigrams", "top_trigrams", "top_char_trigrams", "top_char_fourgrams"):
        sql = QUERIES[field].sql.replace(DOCS, MARKED)
        selects.append(f"SELECT author, '{field}', NULL, string_agg(term, '|' ORDER BY rank) FROM ({sql}) GROUP BY author")
    every_author = "(SELECT DISTINCT source AS author FROM documents)"
    for field, column in (("archaic_words", "word"), ("formal_words", "word"), ("modal_verbs_used", "word"), ("discourse_markers_used", "marker")):
        selects.append(
            f"SELECT author, '{field}', NULL, coalesce(string_agg({column}, '|' ORDER BY {column}), '') FROM {every_author} LEFT JOIN ({QUERIES[field].sql}) USING (author) GROUP BY author"
        )
    selects.append(
        f"SELECT author, 'top_emotions', NULL, coalesce(string_agg(label, '|' ORDER BY rank), '') FROM {every_author} LEFT JOIN ({QUERIES['top_emotions'].sql}) USING (author) GROUP BY author"
    )
    return _profile_sql_raw(_PROFILE_SQL) + "\nUNION ALL ".join(selects)


register("style_profile_all_fields", lambda spark, sf: _whole_profile(marked_once(spark, sf)), _all_fields_sql())
register(
    "style_profile_raw_documents",
    lambda spark, sf: _whole_profile(documents(spark, sf)),
    _all_fields_sql().replace(MARKED, DOCS),
)

# The original's caps: readability and sentiment see the first 5,000 characters of an author.

_CAPPED = {
    "flesch_reading_ease": "flesch_reading_ease",
    "smog_index": "smog_index",
    "vader_compound": "vader_scores",
    "sentiment_polarity": "sentiment_polarity_subjectivity",
}
_CUT = (
    MARKED.replace("docs AS", "whole AS", 1)
    + """, begun AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY author ORDER BY seq
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM whole),
       docs AS (SELECT author, seq, left(text, (5000 - start)::BIGINT) AS text FROM begun WHERE start < 5000)"""
)


_FIRST_TYPES_SQL = with_ctes(
    MARKED, CORPUS, SENTS, _TYPED, _TYPES.replace("SELECT author,", "SELECT author, idx,"),
    """SELECT author, count(*) FILTER (WHERE type_compat = 'simple')::DOUBLE / count(*)::DOUBLE AS simple_sentence_ratio,
       count(*) FILTER (WHERE type_compat = 'complex')::DOUBLE / count(*)::DOUBLE AS complex_sentence_ratio
       FROM types WHERE idx < 500 GROUP BY author""",
)


def _first_types(spark, sf):
    counted = ct.first_sentence_types(marked(spark, sf), 500, compat=True)
    n = F.col("n_simple") + F.col("n_compound") + F.col("n_complex")
    return counted.select(
        "author", tx.ratio(F.col("n_simple"), n).alias("simple_sentence_ratio"), tx.ratio(F.col("n_complex"), n).alias("complex_sentence_ratio")
    )


register("sentence_type_ratios_first_500", _first_types, _FIRST_TYPES_SQL)


def _capped_profile(spark, sf):
    fields = [*_CAPPED, "simple_sentence_ratio", "complex_sentence_ratio"]
    return profile(spark, sf, compat=True, caps=pr.ORIGINAL_CAPS, only=fields).select("author", *fields)


register(
    "style_profile_original_caps",
    _capped_profile,
    f"SELECT author, {', '.join(_CAPPED)}, simple_sentence_ratio, complex_sentence_ratio FROM ({_FIRST_TYPES_SQL})"
    + "".join(f" JOIN (SELECT author, {f} FROM ({QUERIES[q].sql.replace(MARKED, _CUT)})) USING (author)" for f, q in _CAPPED.items()),
)
