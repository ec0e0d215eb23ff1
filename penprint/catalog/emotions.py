"""Queries on emotions by naive Bayes, fitted on texts that the term table labels, with SQL for all of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from penprint import lexicons as lx
from penprint.catalog.base import MARKED, WORD, marked, register, with_ctes
from penprint.operators import emotions as em
from penprint.operators.tokens import split_rows

KEYS = ["author", "seq", "sent_id"]


def _sentences(spark, sf):
    return split_rows(marked(spark, sf), "text").select(*KEYS, F.col("sentence").alias("text"))


def _labels(spark, sf):
    return em.label_by_terms(_sentences(spark, sf), lx.sentiment_table(spark), KEYS)


def _counts(spark, sf):
    return em.label_counts(_sentences(spark, sf), _labels(spark, sf), KEYS)


def _probabilities(spark, sf):
    """Of whole documents, by a model of their labelled sentences."""
    model = em.fit_emotions(_sentences(spark, sf), _labels(spark, sf), KEYS)
    return em.emotion_probabilities(marked(spark, sf), model, ["author", "seq"])


_TERMS = ", ".join(f"('{term}', '{emotion}')" for term, *_, emotion in lx.SENTIMENT)
_LABELS = [
    MARKED,
    f"terms(word, emotion) AS (VALUES {_TERMS})",
    """sents AS (SELECT author, seq, unnest(l) AS s, unnest(range(len(l)))::INT AS sent_id FROM (
        SELECT author, seq, list_filter(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: regexp_matches(x, '\\S')) AS l FROM docs))""",
    f"tok AS (SELECT author, seq, sent_id, unnest(regexp_extract_all(lower(s), {WORD})) AS word FROM sents)",
    """labels AS (SELECT author, seq, sent_id, min(emotion) AS label FROM tok JOIN terms USING (word) GROUP BY author, seq, sent_id HAVING min(emotion) = max(emotion))""",
    "counts AS (SELECT word, label, count(*) AS n FROM tok JOIN labels USING (author, seq, sent_id) GROUP BY word, label)",
    """sizes AS (SELECT label, texts, words FROM (SELECT label, count(*) AS texts FROM labels GROUP BY label)
        JOIN (SELECT label, sum(n)::BIGINT AS words FROM counts GROUP BY label) USING (label))""",
]
_PROBABILITIES = _LABELS + [
    f"""model AS (SELECT label, ln(texts::DOUBLE / sum(texts) OVER ()) AS prior,
        ln({em.SMOOTHING} / (words + {em.SMOOTHING} * (SELECT count(DISTINCT word) FROM counts))) AS unseen FROM sizes)""",
    f"spelled AS (SELECT author, seq, word, count(*) AS times FROM (SELECT author, seq, unnest(regexp_extract_all(lower(text), {WORD})) AS word FROM docs) GROUP BY ALL)",
    "held AS (SELECT author, seq, sum(times) AS known FROM spelled WHERE word IN (SELECT word FROM counts) GROUP BY author, seq)",
    f"gained AS (SELECT author, seq, label, sum(times * ln(1 + n / {em.SMOOTHING}::DOUBLE)) AS gain FROM spelled JOIN counts USING (word) GROUP BY author, seq, label)",
    """scores AS (SELECT d.author, d.seq, m.label, prior + coalesce(known, 0) * unseen + coalesce(gain, 0) AS s
        FROM docs d CROSS JOIN model m LEFT JOIN held h ON h.author = d.author AND h.seq = d.seq
        LEFT JOIN gained g ON g.author = d.author AND g.seq = d.seq AND g.label = m.label)""",
    """raised AS (SELECT author, seq, label, exp(s - max(s) OVER (PARTITION BY author, seq)) AS e FROM scores)""",
    """shares AS (SELECT author, seq, label, e / sum(e) OVER (PARTITION BY author, seq) AS probability FROM raised)""",
]

register("emotion_labels", _labels, with_ctes(*_LABELS, "SELECT author, seq, sent_id, label FROM labels"))
register("emotion_label_sizes", lambda spark, sf: _counts(spark, sf)[0], with_ctes(*_LABELS, "SELECT label, texts, words FROM sizes"))
register("emotion_word_counts", lambda spark, sf: _counts(spark, sf)[1], with_ctes(*_LABELS, "SELECT word, label, n FROM counts"))
register(
    "emotion_probabilities",
    lambda spark, sf: _probabilities(spark, sf).withColumn("probability", F.round("probability", 6)),
    with_ctes(*_PROBABILITIES, "SELECT author, seq, label, round(probability, 6) AS probability FROM shares"),
)
register(
    "fitted_emotions",
    lambda spark, sf: em.fitted_emotions(_probabilities(spark, sf)).withColumn("share", F.round("share", 6)),
    with_ctes(
        *_PROBABILITIES,
        "means AS (SELECT author, label, avg(probability) AS share FROM shares GROUP BY author, label)",
        """SELECT author, rank, label, round(share, 6) AS share FROM (
             SELECT *, row_number() OVER (PARTITION BY author ORDER BY share DESC, label) AS rank FROM means) WHERE rank <= 5""",
    ),
)
