"""Line-first cleaning: lines are judged first, then documents by how much text they lost.

Every rule is a built-in expression over one document; nothing is shuffled.

Defined results: a null text is the empty text, which has no words and so fails the base rule;
a null ``doc_id`` and repeated rows pass through as rows of their own; an empty table gives an empty
table; further columns of the input are kept by ``clean_documents`` and cannot clash, since all
helper columns start with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.llm.common import SPACE, ascii_words, table

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MAX_LOST_PERCENT = 50

# Marks counted as symbols.
SYMBOLS = r"[#*$%&|<>]"
# A line fails when runs of these come with more than every fifth word, and at least three times.
RUNS = {
    "symbols": r"[#*$%&|<>]+",
    "navigation": r"[|»›•·]+",
    "punctuation": r"[!?]{2,}",
}
LEAST_RUNS, RUN_PERCENT = 3, 20
# A line of fewer words than this fails when no mark ends it: a menu entry, not a sentence.
SHORT_LINE = 4
LINE_END = "[.!?:;,…。！？\"'”’»)\\]}][\\x20\\x09-\\x0D]*$"
# A line of at most MAX_BOILERPLATE_WORDS words fails when it holds one of these (lower case).
BOILERPLATE = [
    "all rights reserved",
    "accept all cookies",
    "we use cookies",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "enable javascript",
    "javascript is disabled",
    "subscribe to our newsletter",
    "sign up for our newsletter",
    "share on facebook",
    "follow us on",
    "skip to content",
    "back to top",
]
MAX_BOILERPLATE_WORDS = 30
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text"]


def _repeat_words(words: str) -> list[tuple[str, Column]]:
    """Steps that end in ``__repeat``: words in windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash. Equal ones become neighbours by sorting, so the work
    grows with n log n also in a text that repeats one word ten thousand times, and texts without a
    repeated window skip all of it.
    """
    size = F.size(words)
    starts = F.sequence(F.lit(0), size - F.lit(WINDOW))
    windows = F.when(
        size >= WINDOW,
        # Single entries, since a slice taken inside a lambda copies the whole array each time.
        F.transform(starts, lambda i: F.xxhash64(*[F.get("__hashes", i + F.lit(k)) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.when(
        repeats,
        F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )

    def has_twin(x: Column, i: Column) -> Column:
        before, after = F.get("__placed", i - F.lit(1)), F.get("__placed", i + F.lit(1))
        return F.coalesce(before["h"] == x["h"], F.lit(False)) | F.coalesce(after["h"] == x["h"], F.lit(False))

    twins = F.sort_array(F.transform(F.filter("__placed", has_twin), lambda x: x["i"]))
    covered = F.aggregate(
        "__twins",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct(
            (p + F.lit(WINDOW)).alias("end"), (a["n"] + p + F.lit(WINDOW) - F.greatest(p, a["end"])).alias("n")
        ),
        lambda a: a["n"],
    )
    return [
        ("__hashes", F.transform(words, lambda w: F.xxhash64(w))),
        ("__windows", windows),
        ("__placed", placed),
        ("__twins", twins),
        ("__repeat", F.coalesce(covered, F.lit(0)).cast("bigint")),
    ]


def line_fails(line: Column) -> Column:
    """Whether a line is navigation, boilerplate or mere marks. Blank lines never fail."""
    words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    fails = F.lit(False)
    for pattern in RUNS.values():
        runs = F.regexp_count(line, F.lit(pattern))
        fails = fails | ((runs >= LEAST_RUNS) & (runs * 100 > words * RUN_PERCENT))
    menu = (words < SHORT_LINE) & ~line.rlike(LINE_END)
    phrase = (words <= MAX_BOILERPLATE_WORDS) & F.lower(line).rlike("|".join(BOILERPLATE))
    return (words > 0) & (fails | menu | phrase)


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base counts, ``base_failed``, ``kept`` and ``clean_text``, in place of columns of these names."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__words", ascii_words(body))
    for name, step in _repeat_words("__words"):
        out = out.withColumn(name, step)
    lines = F.split(body, "\n", -1)
    out = out.withColumn("__lines", F.transform(lines, lambda x: F.struct(x.alias("t"), line_fails(x).alias("f"))))
    worded = F.transform(F.filter("__lines", lambda x: x["t"].rlike(r"[^\x20\x09-\x0D]")), lambda x: x["t"])
    out = out.withColumn("__worded", worded)
    lost = F.aggregate(
        "__lines", F.lit(0), lambda n, x: n + F.when(x["f"], F.length(x["t"])).otherwise(F.lit(0))
    )
    total = F.aggregate("__worded", F.lit(0), lambda n, x: n + F.length(x))
    n_words = F.size("__words").cast("bigint")
    base_failed = (n_words < MIN_WORDS) | (F.col("__repeat") * 100 > n_words * MAX_REPEAT_PERCENT)
    clean = F.array_join(F.transform(F.filter("__lines", lambda x: ~x["f"]), lambda x: x["t"]), "\n")
    return out.select(
        *[c for c in docs.columns if c not in RESULTS],
        n_words.alias("n_words"),
        F.length(F.array_join("__words", "")).cast("bigint").alias("word_chars"),
        (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("__worded") - F.size(F.array_distinct("__worded"))).cast("bigint").alias("n_dup_lines"),
        F.col("__repeat").alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        (~base_failed & (lost * 100 <= total * MAX_LOST_PERCENT)).alias("kept"),
        clean.alias("clean_text"),
    )


def clean_documents(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The kept documents with their failed lines removed, in the columns of ``docs``."""
    judged = judge(docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).alias("__text")), "__text")
    out = []
    for column in docs.columns:
        value = F.col("__row")[column]
        if column == text:
            value = F.when(F.col("__text").isNotNull(), F.col("clean_text"))
        elif column == length:
            value = F.when(F.col("__text").isNotNull(), F.length("clean_text").cast(docs.schema[column].dataType))
        out.append(value.alias(column))
    # One entry per row: a filter on generated columns stays above, where a plain one would be pushed
    # below the steps of judge() and work each of them out again inside the next.
    rows = judged.select(F.explode_outer(F.array(F.struct("kept", *[c.alias(f"__{i}") for i, c in enumerate(out)]))).alias("r"))
    return rows.where("r.kept").select(*[F.col(f"r.__{i}").alias(c) for i, c in enumerate(docs.columns)])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).drop("text", "clean_text")


def _sql() -> str:
    words = r"[^\x20\x09-\x0D]+"
    count = lambda pattern: f"len(regexp_extract_all(l, '{pattern}'))"
    fails = [
        f"({count(p)} >= {LEAST_RUNS} AND {count(p)} * 100 > {count(words)} * {RUN_PERCENT})" for p in RUNS.values()
    ]
    end = LINE_END.replace("'", "''")
    fails.append(f"({count(words)} < {SHORT_LINE} AND NOT regexp_matches(l, '{end}'))")
    fails.append(f"({count(words)} <= {MAX_BOILERPLATE_WORDS} AND regexp_matches(lower(l), '{'|'.join(BOILERPLATE)}'))")
    return f"""WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS ws
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d)),
twin AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM twin) GROUP BY doc_id),
line AS (
  SELECT doc_id, l, length(l) AS n, {count(words)} > 0 AND ({' OR '.join(fails)}) AS f, {count(words)} > 0 AS worded
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)),
per AS (
  SELECT doc_id, count(*) FILTER (WHERE worded) - count(DISTINCT l) FILTER (WHERE worded) AS dup,
         coalesce(sum(n) FILTER (WHERE worded), 0) AS total, coalesce(sum(n) FILTER (WHERE f), 0) AS lost
  FROM line GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
       len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines,
       coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
       len(ws) < {MIN_WORDS} OR coalesce(rep.n, 0) * 100 > len(ws) * {MAX_REPEAT_PERCENT} AS base_failed,
       NOT (len(ws) < {MIN_WORDS} OR coalesce(rep.n, 0) * 100 > len(ws) * {MAX_REPEAT_PERCENT})
         AND lost * 100 <= total * {MAX_LOST_PERCENT} AS kept
FROM d JOIN per USING (doc_id) LEFT JOIN rep USING (doc_id)"""


SQL = _sql()
