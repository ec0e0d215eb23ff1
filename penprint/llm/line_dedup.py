"""Cross-site line dedup: lines that many sites share stay in one document only.

Every line that holds a word is known by a hash of its trimmed text. One HyperLogLog sketch of the
sites per line merges by aggregation, on each task before the shuffle. Lines whose estimate lies
within ``MARGIN`` of the threshold get an exact distinct count; for the others the estimate decides,
which is more than five standard errors away. A line on ``min_sites`` sites or more is boilerplate and
is removed everywhere but at its first place, which is the lowest ``doc_id``, then the highest line.

Defined results: a null text stays null and has no lines; a null source counts as the site with the
empty name; a null ``doc_id`` comes first; rows that repeat both id and text are treated alike, so
each keeps a first place; blank lines are never removed; an empty table gives an empty table; other
columns pass through, helper columns start with two underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.llm.common import same, table

MIN_SITES = 8
LOG_REGISTERS = 10
# Five standard errors of a sketch with 2**LOG_REGISTERS registers: 5 * 1.04 / sqrt(1024).
MARGIN = 0.17
# Spelled out for trimming: ASCII white space without the line feed.
BLANKS = " \t\x0b\x0c\r"
KEY = ["__line", "__check"]


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line with a word: document key, place, site and a 96-bit key of the line."""
    at = docs.select(
        F.col("doc_id").alias("__id"),
        F.xxhash64("text").alias("__text"),
        F.coalesce(F.col("source"), F.lit("")).alias("__site"),
        F.posexplode_outer(F.split("text", "\n", -1)).alias("__place", "__body"),
    )
    body = F.btrim(F.col("__body"), F.lit(BLANKS))
    return at.where(F.length(body) > 0).select(
        "__id", "__text", "__site", "__place", F.xxhash64(body).alias("__line"), F.hash(body).alias("__check")
    )


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``__line, __check, __first`` of the lines that stand on ``min_sites`` sites or more."""
    lines = _lines(docs)
    spread = (
        lines.groupBy(*KEY)
        .agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("__site", F.lit(LOG_REGISTERS))).alias("__sites"),
            F.min(F.struct("__id", "__text", "__place")).alias("__first"),
            F.count(F.lit(1)).alias("__rows"),
        )
        # No line is on more sites than it has rows.
        .where((F.col("__rows") >= min_sites) & (F.col("__sites") >= min_sites * (1 - MARGIN)))
        .drop("__rows")
    )
    near = spread.where(F.col("__sites") <= min_sites * (1 + MARGIN)).select(*KEY)
    exact = (
        lines.select(*KEY, "__site")
        .join(near, KEY, "left_semi")
        .groupBy(*KEY)
        .agg(F.count_distinct("__site").alias("__exact"))
    )
    decided = F.coalesce(F.col("__exact"), F.col("__sites")) >= min_sites
    return spread.join(exact, KEY, "left").where(decided).select(*KEY, "__first")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, counts: bool = False) -> DataFrame:
    """``docs`` with ``text`` cleaned, on request with ``n_lines`` before and ``n_removed``."""
    removed = (
        _lines(docs)
        .join(boilerplate(docs, min_sites), KEY)
        .where(F.struct("__id", "__text", "__place") != F.col("__first"))
        .groupBy("__id", "__text")
        .agg(F.collect_set("__place").alias("__removed"))
    )
    keyed = docs.withColumns({"__id": F.col("doc_id"), "__text": F.xxhash64("text")})
    joined = keyed.join(removed, same(keyed, removed, ["__id", "__text"]), "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda line, i: ~F.array_contains("__removed", i))
    cleaned = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    reported = [
        F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("__removed"), F.lit(0)).cast("bigint").alias("n_removed"),
    ]
    return joined.select(
        *[cleaned.alias(c) if c == "text" else keyed[c] for c in docs.columns], *(reported if counts else [])
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return dedup_lines(docs, counts=True).select("doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("n_chars"), "text")


SQL = f"""WITH line AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(l) AS body, unnest(range(len(l))) AS place
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)),
named AS (
  SELECT doc_id, site, place, body, trim(body, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM line),
boiler AS (SELECT t FROM named WHERE t <> '' GROUP BY t HAVING count(DISTINCT site) >= {MIN_SITES}),
marked AS (
  SELECT n.*, t <> '' AND b.t IS NOT NULL
         AND row_number() OVER (PARTITION BY n.t ORDER BY doc_id, place) > 1 AS gone
  FROM named n LEFT JOIN boiler b USING (t))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       length(coalesce(string_agg(body, chr(10) ORDER BY place) FILTER (WHERE NOT gone), ''))::BIGINT AS n_chars,
       coalesce(string_agg(body, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text
FROM marked GROUP BY doc_id"""
