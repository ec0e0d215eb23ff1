"""Queries on the bigram model and on fills for masked spans, with SQL for both."""

from __future__ import annotations

from pyspark.sql import functions as F

from penprint.catalog.base import SPACE, ascii_only, quote, register, table, with_ctes
from penprint.operators import fill as fl
from penprint.operators import rerank as rr


def _turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", ascii_only("text").alias("text"))


def _model(spark, sf):
    return fl.kneser_ney(fl.bigram_counts(_turns(spark, sf)))


def _fills(spark, sf):
    """Every turn with two words masked, filled by a model of all turns."""
    masked = rr.span_mask(_turns(spark, sf), F.col("conv_id") * 31 + F.col("turn") * 7)
    found = fl.fill_spans(masked, _model(spark, sf), ["conv_id", "turn"])
    return found.select("conv_id", "turn", "proposal", "fill", F.round("score", 6).alias("score"))


_SPACES = quote(f"{SPACE}+")
_COUNTS = [
    "turns AS (SELECT conv_id, turn, regexp_replace(text, '[^\\x01-\\x7f]', '?', 'g') AS text FROM conversations)",
    f"spelled AS (SELECT [''] || list_filter(string_split_regex(lower(text), {_SPACES}), lambda x: x <> '') || [''] AS w FROM turns)",
    "counts AS (SELECT p[1] AS before, p[2] AS word, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])) AS p FROM spelled) GROUP BY ALL)",
]
_MODEL = _COUNTS + [
    "words AS (SELECT word, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM counts GROUP BY word)",
    f"contexts AS (SELECT before, sum(n) AS seen, {fl.DISCOUNT}::DOUBLE * count(*) / sum(n) AS rest FROM counts GROUP BY before)",
    f"""pairs AS (SELECT before, word, greatest(n - {fl.DISCOUNT}::DOUBLE, 0) / seen + rest * p AS p
        FROM counts JOIN contexts USING (before) JOIN words USING (word))""",
]
_FILLS = _MODEL + [
    "split AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS l, (conv_id * 31 + turn * 7) AS r FROM turns)",
    "placed AS (SELECT *, r % greatest(len(l) - 2, 1) AS i FROM split WHERE len(l) >= 6)",
    "near AS (SELECT *, lower(CASE WHEN i > 0 THEN l[i] ELSE '' END) AS a, lower(coalesce(l[i + 3], '')) AS z FROM placed)",
    f"""likely AS (SELECT before, word, p FROM (SELECT *, row_number() OVER (PARTITION BY before ORDER BY p DESC, word) AS k FROM pairs WHERE word <> '')
        WHERE k <= {fl.BEAM})""",
    f"""ways AS (SELECT n.*, f.word AS first, s.word AS second, ln(f.p) + ln(s.p) + ln(coalesce(b.p, coalesce(c.rest, 1) * u.p, {fl.FLOOR})) AS score
        FROM near n JOIN likely f ON f.before = a JOIN likely s ON s.before = f.word LEFT JOIN pairs b ON b.before = s.word AND b.word = z
        LEFT JOIN contexts c ON c.before = s.word LEFT JOIN words u ON u.word = z)""",
    """top AS (SELECT *, first || ' ' || second AS fill FROM ways
        QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(score, 9) DESC, first, second) = 1)""",
]

register("bigram_counts", lambda spark, sf: fl.bigram_counts(_turns(spark, sf)), with_ctes(*_COUNTS, "SELECT before, word, n FROM counts"))
register(
    "kneser_ney_pairs",
    lambda spark, sf: _model(spark, sf).pairs.select("before", "word", F.round("p", 9).alias("p")),
    with_ctes(*_MODEL, "SELECT before, word, round(p, 9) AS p FROM pairs"),
)
register(
    "kneser_ney_contexts",
    lambda spark, sf: _model(spark, sf).contexts.select("before", F.round("rest", 9).alias("rest")),
    with_ctes(*_MODEL, "SELECT before, round(rest, 9) AS rest FROM contexts"),
)
register(
    "fill_spans",
    _fills,
    with_ctes(
        *_FILLS,
        "SELECT conv_id, turn, array_to_string(l[1:i] || [fill] || l[i + 3:], ' ') AS proposal, fill, round(score, 6) AS score FROM top",
    ),
)
