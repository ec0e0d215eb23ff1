"""Queries on sentence splitting that learns its abbreviations, with SQL for learning and for splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from penprint.catalog.base import quote, register, table, with_ctes
from penprint.functions import text as tx
from penprint.operators import punkt as pk

# The given texts have no abbreviations: frequent words of each language give way to some. Every document takes part.
ABBREVIATED = [
    (" it ", " Dr. Miller "),
    (" that ", ", e.g. the "),
    (" was ", " (approx. 5. May) "),
    (" with ", " J. Brown "),
    (" this ", " etc. and "),
    (" die ", " z. B. die "),
    (" und ", " bzw. Prof. Meier "),
    (" que ", " env. 3.5 km... que "),
    (" les ", " M. Dupont "),
    (" el ", " Sr. García "),
    (" los ", " pág. 7, "),
]


def _texts(spark, sf):
    text = F.col("text")
    for old, new in ABBREVIATED:
        text = F.replace(text, F.lit(old), F.lit(new))
    return table(spark, sf, "documents").select("lang", "doc_id", text.alias("text"))


def _model(texts):
    return pk.punkt_model(pk.punkt_counts(texts, by=["lang"]), ["lang"])


def _types(spark, sf):
    types = pk.punkt_types(pk.punkt_counts(_texts(spark, sf), by=["lang"]), ["lang"])
    return types.select("lang", "typ", "with_period", "without", F.round("score", 4).alias("score"), "is_abbr")


def _starters(spark, sf):
    words, _ = _model(_texts(spark, sf))
    return words


def _collocations(spark, sf):
    return _model(_texts(spark, sf))[1]


def _sentences(spark, sf):
    texts = _texts(spark, sf)
    found = pk.punkt_sentences(texts, *_model(texts), keys=["doc_id"], by=["lang"])
    return found.select("lang", "doc_id", F.col("sent_id").cast("bigint").alias("sent_id"), "sentence")


def _abbreviated_sql() -> str:
    text = "text"
    for old, new in ABBREVIATED:
        text = f"replace({text}, {quote(old)}, {quote(new)})"
    return text


def _term(count: str, share: str) -> str:
    return f"(CASE WHEN {count} = 0 THEN 0.0 ELSE ({count}) * ln(greatest({share}, 1e-300::DOUBLE)) END)"


def _binomial(hits: str, trials: str, share: str) -> str:
    return f"({_term(hits, share)} + {_term(f'({trials} - {hits})', f'(1 - {share})')})"


def _association(first: str, second: str, both: str, total: str) -> str:
    rest, others = f"({second} - {both})", f"({total} - {first})"
    share = f"({second}::DOUBLE / {total})"
    apart = f"{_binomial(both, first, share)} + {_binomial(rest, others, share)}"
    tied = f"{_binomial(both, first, f'({both}::DOUBLE / {first})')} + {_binomial(rest, others, f'({rest}::DOUBLE / greatest({others}, 1))')}"
    return f"(-2 * ({apart} - ({tied})))"


_SEEN = "(with_period + without)"
_INNER = "(length(typ) - length(replace(typ, '.', '')))"
_LETTERS = f"(length(typ) - {_INNER})::DOUBLE"
_SCORE = f"""CASE WHEN regexp_matches(typ, '\\p{{L}}') AND typ <> '{pk.NUMBER}' AND with_period > 0 THEN
    -2 * ({_binomial('with_period', _SEEN, '(periods::DOUBLE / total)')} - {_binomial('with_period', _SEEN, f'{pk.CERTAIN}::DOUBLE')})
    * exp(-{_LETTERS}) * ({_INNER} + 1) * pow({_LETTERS}, -(without::DOUBLE)) END"""

_LEARNED = [
    f"texts AS (SELECT lang, doc_id, {_abbreviated_sql()} AS t FROM documents)",
    f"pieces AS (SELECT lang, doc_id, t, unnest(l) AS raw, unnest(range(len(l))) AS place FROM (SELECT *, regexp_extract_all(t, {quote(pk.PIECE)}) AS l FROM texts))",
    f"cut AS (SELECT *, regexp_extract(raw, {quote(pk.TAIL)}) AS tail FROM pieces)",
    f"""parted AS (SELECT *, regexp_extract(left(raw, length(raw) - length(tail)), {quote(pk.MARKS)}) AS marks,
      regexp_replace(regexp_replace(left(raw, length(raw) - length(tail)), {quote(pk.MARKS)}, ''), {quote(f'^[^{pk.LETTERS}]+|[^{pk.LETTERS}]+$')}, '', 'g') AS word FROM cut)""",
    f"""tokens AS (SELECT lang, doc_id, place, raw,
      CASE WHEN regexp_matches(word, {quote(pk.IS_NUMBER)}) THEN '{pk.NUMBER}' ELSE lower(word) END AS typ,
      CASE WHEN regexp_matches(word, '^\\p{{Lu}}') THEN 'u' WHEN regexp_matches(word, '^\\p{{Ll}}') THEN 'l' ELSE 'o' END AS letter,
      CASE WHEN marks = '' THEN '' WHEN NOT regexp_matches(tail, {quote(pk.CLOSED)}) THEN CASE WHEN marks = '.' THEN ',' ELSE '' END
           WHEN marks = '.' THEN '.' WHEN regexp_matches(marks, '[!?]') THEN '!' ELSE '…' END AS mark FROM parted)""",
    """near AS (SELECT *, lag(typ) OVER w AS typ0, lag(mark) OVER w AS mark0, lead(typ) OVER w AS typ1, lead(letter) OVER w AS letter1
      FROM tokens WINDOW w AS (PARTITION BY lang, doc_id ORDER BY place))""",
    """counts AS (SELECT lang, CASE WHEN mark0 IN ('.', '…') THEN typ0 ELSE '' END AS before,
      CASE WHEN mark0 IS NULL OR mark0 = '!' THEN 'start' WHEN mark0 IN ('.', '…') THEN mark0 ELSE 'mid' END AS context,
      typ, letter, mark, count(*) AS n FROM near GROUP BY ALL)""",
    "totals AS (SELECT lang, sum(n) FILTER (mark IN ('.', ',')) AS periods, sum(n) AS total FROM counts GROUP BY lang)",
    f"""types AS (SELECT *, coalesce(score >= {pk.ABBREVIATION}, false) AS is_abbr FROM (
      SELECT lang, typ, with_period, without, total, {_SCORE} AS score FROM (
        SELECT lang, typ, coalesce(sum(n) FILTER (mark IN ('.', ',')), 0)::BIGINT AS with_period, coalesce(sum(n) FILTER (mark NOT IN ('.', ',')), 0)::BIGINT AS without
        FROM counts WHERE typ <> '' GROUP BY lang, typ) JOIN totals USING (lang)))""",
]
_LOOSE = f"(before = '{pk.NUMBER}' OR regexp_matches(before, {quote(pk.INITIAL)}))"
_MODEL = _LEARNED + [
    """placed AS (SELECT c.*, coalesce(a.is_abbr, false) AS abbr_before, context = '.' AND NOT coalesce(a.is_abbr, false) AS broken
      FROM counts c LEFT JOIN types a ON a.lang = c.lang AND a.typ = c.before)""",
    f"""flags AS (SELECT lang, typ, coalesce(sum(n) FILTER (letter = 'u' AND context = 'mid'), 0) AS large_inside, coalesce(sum(n) FILTER (letter = 'u'), 0) AS large,
      coalesce(sum(n) FILTER (letter = 'l'), 0) AS small, coalesce(sum(n) FILTER (letter = 'l' AND (broken OR context = 'start')), 0) AS small_starts,
      coalesce(sum(n) FILTER (broken AND NOT {_LOOSE}), 0)::BIGINT AS at_break FROM placed WHERE typ <> '' GROUP BY lang, typ)""",
    """breaks AS (SELECT c.lang, coalesce(sum(n) FILTER (mark = '.' AND NOT coalesce(is_abbr, false)), 0)::BIGINT AS breaks
      FROM counts c LEFT JOIN types t ON t.lang = c.lang AND t.typ = c.typ GROUP BY c.lang)""",
    f"""words AS (SELECT lang, typ, is_abbr,
      at_break > 0 AND typ <> '{pk.NUMBER}' AND at_break * total > {_SEEN} * breaks AND {_association('breaks', _SEEN, 'at_break', 'total')} >= {pk.STARTER} AS is_starter,
      small > 0 AND large_inside = 0 AS opens, small_starts > 0 AND large = 0 AS small_start, small > 0 AS ever_small, {_SEEN} AS seen, total
      FROM types JOIN flags USING (lang, typ) JOIN breaks USING (lang))""",
    f"""pairs AS (SELECT lang, before, typ, sum(n)::BIGINT AS n_both FROM placed
      WHERE context = '.' AND typ <> '' AND typ <> '{pk.NUMBER}' AND (abbr_before OR {_LOOSE}) GROUP BY ALL HAVING sum(n) > 1)""",
    f"""tied AS (SELECT p.lang, before, p.typ FROM pairs p JOIN words a ON a.lang = p.lang AND a.typ = before JOIN words b ON b.lang = p.lang AND b.typ = p.typ
      WHERE NOT b.is_starter AND n_both * a.total > a.seen * b.seen AND {_association('a.seen', 'b.seen', 'n_both', 'a.total')} >= {pk.COLLOCATION})""",
]
_SPLIT = _MODEL + [
    """joined AS (SELECT near.*, coalesce(a.is_abbr, false) AS abbr, coalesce(b.is_starter, false) AS starter, coalesce(b.opens, false) AS opens,
        coalesce(b.small_start, false) AS small_start, coalesce(b.ever_small, false) AS ever_small, tied.typ IS NOT NULL AS is_tied
      FROM near LEFT JOIN words a ON a.lang = near.lang AND a.typ = near.typ LEFT JOIN words b ON b.lang = near.lang AND b.typ = typ1
      LEFT JOIN tied ON tied.lang = near.lang AND tied.before = near.typ AND tied.typ = typ1)""",
    f"""ended AS (SELECT lang, doc_id, place, raw, CASE
        WHEN typ1 IS NULL THEN true WHEN mark IN ('', ',') THEN false WHEN mark = '!' THEN true
        WHEN is_tied AND mark = '.' THEN false
        WHEN (mark = '…' OR abbr) AND NOT (mark = '.' AND regexp_matches(typ, {quote(pk.INITIAL)})) THEN letter1 = 'u' AND (opens OR starter)
        WHEN (regexp_matches(typ, {quote(pk.INITIAL)}) OR typ = '{pk.NUMBER}') AND letter1 = 'l' AND NOT small_start THEN false
        WHEN regexp_matches(typ, {quote(pk.INITIAL)}) AND letter1 = 'u' AND NOT opens AND NOT ever_small THEN false
        ELSE (letter1 = 'u' AND opens) OR NOT abbr END AS ends FROM joined)""",
    """numbered AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY lang, doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sent_id FROM ended)""",
    f"""SELECT lang, doc_id, sent_id, regexp_replace(string_agg(raw, '' ORDER BY place), '{tx.SPACE}+$', '') AS sentence FROM numbered GROUP BY lang, doc_id, sent_id""",
]

register(
    "punkt_types",
    _types,
    with_ctes(*_LEARNED, "SELECT lang, typ, with_period, without, round(score, 4) AS score, is_abbr FROM types"),
)
register("punkt_words", _starters, with_ctes(*_MODEL, "SELECT lang, typ, is_abbr, is_starter, opens, small_start, ever_small FROM words"))
register("punkt_collocations", _collocations, with_ctes(*_MODEL, "SELECT lang, before, typ FROM tied"))
register("sentences_punkt_learned", _sentences, with_ctes(*_SPLIT))
