"""Tables behind the registered queries, and the same tables as SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.functions import text as tx
from penprint.session import stored
from penprint.sources.tables import scan_parquet, spread

# Frequent words of the given documents are replaced by what they lack: question marks, dashes,
# quotes, and words of the lists. Every document takes part, in Spark and in SQL alike.
MARKS = [
    (" it ", "? Why would you "),
    (" that ", "? However, "),
    (" was ", " was painted "),
    (" for ", " because "),
    (" on ", " will "),
    (" with ", " very good "),
    (" by ", " not bad "),
    (" this ", " gonna "),
    (" are ", " said "),
    (" from ", " therefore "),
    (" at ", " - "),
    (" be ", "... "),
    (" as ", " don't "),
    (" to ", "; "),
    (" die ", " happy "),
    (" que ", " afraid "),
    (" le ", ": "),
    (" en ", " thus (herein) "),
    (" un ", " – "),
    (" les ", " please "),
    (" des ", ' "said" '),
    (" und ", " or so, "),
    (" el ", "… "),
]


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = Query(run, sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(scan_parquet(spark, f"{sf_dir}/{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(author, seq, text)``."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("author"), F.col("doc_id").alias("seq"), "text"
    )


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    for old, new in MARKS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return documents(spark, sf_dir).withColumn("text", text)


def marked_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marked texts, written once for queries that read them several times."""
    return stored(marked(spark, sf_dir), "marked")


def ascii_only(column: str):
    return F.regexp_replace(column, "[^\\x01-\\x7f]", "?")


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(terms: list[str]) -> str:
    return "(" + ", ".join(map(quote, terms)) + ")"


def _marked_sql() -> str:
    text = "text"
    for old, new in MARKS:
        text = f"replace({text}, {quote(old)}, {quote(new)})"
    return text


WORD, SPACE, NON_SPACE = quote(tx.WORD), tx.SPACE, quote(tx.NON_SPACE)
STRIP = quote(f"^{tx.SPACE}+|{tx.SPACE}+$")

# Building blocks of the SQL side. ``corpus`` joins an author's texts to the one text that all
# author-level measures are defined on.
DOCS = "docs AS (SELECT source AS author, doc_id AS seq, text FROM documents)"
MARKED = f"docs AS (SELECT source AS author, doc_id AS seq, {_marked_sql()} AS text FROM documents)"
CORPUS = "corpus AS (SELECT author, string_agg(text, ' ' ORDER BY seq) AS t FROM docs GROUP BY author)"
WORDS = f"""words AS (
  SELECT author, unnest(l) AS w, unnest(range(len(l))) AS pos
  FROM (SELECT author, regexp_extract_all(lower(t), {WORD}) AS l FROM corpus))"""
VOCAB = "vocab AS (SELECT author, w, count(*) AS n, min(pos) AS first FROM words GROUP BY author, w)"
SENTS = f"""sents AS (
  SELECT author, idx, s, len(regexp_extract_all(s, {WORD})) AS n
  FROM (SELECT author, unnest(l) AS s, unnest(range(len(l))) AS idx
        FROM (SELECT author, list_filter(string_split_regex(t, '[.!?]+'), lambda x: regexp_matches(x, {NON_SPACE})) AS l
              FROM corpus)))"""
WSUM = """wsum AS (
  SELECT author, sum(n)::BIGINT AS n_words, sum(n * length(w))::BIGINT AS word_chars,
         count(*) AS n_distinct, count(*) FILTER (WHERE n = 1) AS n_once
  FROM vocab GROUP BY author)"""
SSUM = """ssum AS (
  SELECT author, count(*) AS s, sum(n)::BIGINT AS sw, sum(n * n)::BIGINT AS sq FROM sents GROUP BY author)"""


def with_ctes(*parts: str) -> str:
    """A query from CTEs and, last, its SELECT."""
    *ctes, final = parts
    return "WITH " + ",\n".join(ctes) + "\n" + final


def count_sql(text: str, piece: str) -> str:
    """Non-overlapping occurrences of a literal."""
    return f"(len(string_split({text}, {quote(piece)})) - 1)"
