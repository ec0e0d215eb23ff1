"""Queries on prompts, the style registry, requests and their streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from penprint.catalog.base import (
    CORPUS, MARKED, VOCAB, WORD, WORDS, count_sql, in_list, marked, register, table, with_ctes,
)
from penprint.catalog.profiles import div, profile, text_cte
from penprint.catalog.texts import strip_sql, words_ws
from penprint import lexicons as lx
from penprint.operators import prompts as pm
from penprint.operators import registry as rg
from penprint.session import scratch_path
from penprint.streaming import jobs


def requests(spark, sf):
    """Turns as requests: two of 22 styles are unknown, some names and texts are missing."""
    turns = table(spark, sf, "conversations")
    k = F.col("conv_id") * 7 + F.col("turn")
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("src"), (k % 22).cast("string"))).alias("style_name"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("role")).alias("author_name"),
        F.when(k % 13 == 0, F.lit("")).when(k % 17 == 0, F.lit(None)).otherwise(F.col("text")).alias("original_text"),
    )


REQUESTS = """req AS (SELECT conv_id * 1000 + turn AS request_id, CASE WHEN k % 11 = 0 THEN NULL ELSE 'src' || (k % 22)::VARCHAR END AS style_name,
   CASE WHEN k % 5 = 0 THEN NULL ELSE role END AS author_name,
   CASE WHEN k % 13 = 0 THEN '' WHEN k % 17 = 0 THEN NULL ELSE text END AS original_text
   FROM (SELECT *, conv_id * 7 + turn AS k FROM conversations))"""
FILLED = """filled AS (SELECT request_id, coalesce(style_name, 'custom_style') AS style_name, coalesce(author_name, 'the target style') AS author_name,
   coalesce(original_text, '') AS original_text FROM req)"""


def style_rows(spark, sf):
    """Stored styles and changes to them: the documents of a source, newest id last."""
    rows = table(spark, sf, "documents").select(F.col("source").alias("style_name"), F.col("doc_id").alias("ts"), "lang", F.col("n_chars").alias("v"))
    return rows.where(F.col("lang") == "en"), rows.where(F.col("lang") != "en")


def registry(spark, sf):
    return rg.style_upsert(*style_rows(spark, sf))


REGISTRY = "reg AS (SELECT source AS style_name, max(doc_id) AS ts, arg_max(lang, doc_id) AS lang, arg_max(n_chars, doc_id) AS v FROM documents GROUP BY source)"

# Prompts and checks ---------------------------------------------------------------------------

register(
    "length_budget",
    lambda spark, sf: pm.length_budget(requests(spark, sf)).select("request_id", "original_words", "max_words", "max_tokens"),
    with_ctes(
        REQUESTS,
        f"w AS (SELECT request_id, coalesce(original_text, '') AS t, {words_ws(chr(39) * 2 + ' || coalesce(original_text, ' + chr(39) * 2 + ')')}::BIGINT AS n FROM req)",
        "c AS (SELECT *, CASE WHEN length(t) = 0 THEN 10 ELSE n END AS m FROM w)",
        "SELECT request_id, m AS original_words, floor(m * 1.5::DOUBLE)::BIGINT AS max_words, least(512, n * 3)::BIGINT AS max_tokens FROM c",
    ),
)


def _labels(spark, sf):
    p = profile(spark, sf, only=pm.LABEL_FIELDS)
    return pm.frequency_labels(p).select(
        "author", "semicolon_label", "dash_label", "ellipsis_label", "archaic_label", "formal_label", "mark_list"
    )


def _terms_sql(name: str, terms: list[str]) -> str:
    return f"{name} AS (SELECT author, array_to_string(list(w ORDER BY w)[1:5], ', ') AS {name} FROM vocab WHERE w IN {in_list(terms)} GROUP BY author)"


register(
    "frequency_labels",
    _labels,
    with_ctes(
        MARKED, CORPUS, WORDS, VOCAB,
        "ws AS (SELECT author, sum(n)::BIGINT AS n_words FROM vocab GROUP BY author)",
        text_cte("n_semicolon", "n_dash", "n_ellipsis"), _terms_sql("arc", lx.ARCHAIC), _terms_sql("frm", lx.FORMAL),
        f"f AS (SELECT author, {div('n_semicolon', 'n_words')} AS s, {div('n_dash', 'n_words')} AS d, {div('n_ellipsis', 'n_words')} AS e FROM ws JOIN cnt USING (author))",
        """SELECT author, CASE WHEN s > 0.01 THEN 'frequent' ELSE 'rare' END AS semicolon_label, CASE WHEN d > 0.01 THEN 'frequent' ELSE 'occasional' END AS dash_label,
             CASE WHEN e > 0.005 THEN 'uses suspense' ELSE 'rare' END AS ellipsis_label, coalesce(arc, 'none') AS archaic_label, coalesce(frm, 'minimal') AS formal_label,
             CASE WHEN s > 0.01 THEN 'semicolons, ' ELSE '' END || CASE WHEN d > 0.01 THEN 'dashes, ' ELSE '' END || 'commas' AS mark_list
           FROM f LEFT JOIN arc USING (author) LEFT JOIN frm USING (author)""",
    ),
)


def cards(spark, sf):
    return pm.style_card(profile(spark, sf))


register(
    "style_prompt",
    lambda spark, sf: pm.style_prompt(rg.request_defaults(requests(spark, sf)), cards(spark, sf)).select("request_id", "style_name", "prompt"),
)


def _answers(spark, sf):
    """The next turn of a conversation as the answer to a turn."""
    turns = table(spark, sf, "conversations")
    text = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.col("text").alias("original_text"))
    nxt = turns.where(F.col("turn") > 0).select((F.col("conv_id") * 1000 + F.col("turn") - 1).alias("request_id"), F.col("text").alias("answer"))
    return text.join(nxt, "request_id")


register(
    "overlong_check",
    lambda spark, sf: pm.overlong_check(_answers(spark, sf)).select("request_id", "is_overlong", "styled"),
    with_ctes(
        f"""p AS (SELECT a.conv_id * 1000 + a.turn AS request_id, b.text AS answer, {words_ws('a.text')} AS n, {words_ws('b.text')} AS m
             FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)""",
        """SELECT request_id, m > n * 2.5::DOUBLE AS is_overlong, CASE WHEN m > n * 2.5::DOUBLE THEN '[Note: the answer may be too long: ' || m || ' words for ' || n || ']' || chr(10) || chr(10) || answer
             ELSE answer END AS styled FROM p""",
    ),
)


def _transfer(spark, sf):
    outputs = _answers(spark, sf).select("request_id", F.concat(F.lit("  "), "answer", F.lit("\n")).alias("output"))
    stored = cards(spark, sf)
    done = rg.transfer_batch(requests(spark, sf), stored.select("style_name"), stored, outputs)
    return done.select("request_id", "style_name", "status", F.col("prompt").isNotNull().alias("has_prompt"), "answer", "is_overlong")


register(
    "transfer_batch",
    _transfer,
    with_ctes(
        REQUESTS, FILLED,
        f"""o AS (SELECT a.conv_id * 1000 + a.turn AS request_id, {strip_sql('b.text')} AS answer
             FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)""",
        "known AS (SELECT DISTINCT source AS style_name, true AS known FROM documents)",
        """st AS (SELECT f.*, CASE WHEN length(original_text) = 0 THEN 'missing_text' WHEN known IS NULL THEN 'unknown_style' ELSE 'ok' END AS status
             FROM filled f LEFT JOIN known USING (style_name))""",
        f"""SELECT request_id, style_name, status, status = 'ok' AS has_prompt, answer,
              {words_ws('answer')} > {words_ws('original_text')} * 2.5::DOUBLE AS is_overlong FROM st LEFT JOIN o USING (request_id)""",
    ),
)

# Registry and requests ------------------------------------------------------------------------

register(
    "style_upsert",
    lambda spark, sf: registry(spark, sf),
    with_ctes(REGISTRY, "SELECT style_name, ts, lang, v FROM reg"),
)
register(
    "style_lookup",
    lambda spark, sf: rg.style_lookup(rg.request_defaults(requests(spark, sf)), registry(spark, sf)).select("request_id", "style_name", "ts", "v"),
    with_ctes(REQUESTS, FILLED, REGISTRY, "SELECT request_id, style_name, ts, v FROM filled JOIN reg USING (style_name)"),
)
register(
    "unknown_styles",
    lambda spark, sf: rg.unknown_styles(rg.request_defaults(requests(spark, sf)), registry(spark, sf)).select("request_id", "style_name"),
    with_ctes(REQUESTS, FILLED, REGISTRY, "SELECT request_id, style_name FROM filled WHERE style_name NOT IN (SELECT style_name FROM reg)"),
)
register("list_styles", lambda spark, sf: rg.list_styles(registry(spark, sf)), "SELECT DISTINCT source AS style_name FROM documents")
register(
    "request_defaults",
    lambda spark, sf: rg.request_defaults(requests(spark, sf)),
    with_ctes(REQUESTS, FILLED, "SELECT * FROM filled"),
)
register(
    "request_status",
    lambda spark, sf: rg.request_status(
        rg.request_defaults(requests(spark, sf)).withColumn(
            "failure",
            F.when(F.col("request_id") % 19 == 0, "Connection refused").when(F.col("request_id") % 23 == 0, "out of memory"),
        ),
        registry(spark, sf),
    ).select("request_id", "status", "http_code"),
    with_ctes(
        REQUESTS, FILLED, REGISTRY,
        """s AS (SELECT request_id, CASE WHEN length(original_text) = 0 THEN 'missing_text' WHEN ts IS NULL THEN 'unknown_style'
             WHEN request_id % 19 = 0 THEN 'no_connection' WHEN request_id % 23 = 0 THEN 'failed' ELSE 'ok' END AS status
             FROM filled LEFT JOIN reg USING (style_name))""",
        """SELECT request_id, status, CASE status WHEN 'missing_text' THEN 400 WHEN 'unknown_style' THEN 400 WHEN 'no_connection' THEN 503
             WHEN 'failed' THEN 500 ELSE 200 END::BIGINT AS http_code FROM s""",
    ),
)

# Streams: the tables are laid out as several files and read one file per micro-batch.


def _as_stream(spark, df, name, files=3):
    path = scratch_path(spark, name)
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _stream_counters(spark, sf):
    texts = marked(spark, sf).select(F.col("author").alias("style_name"), "text")
    out = scratch_path(spark, "running")
    jobs.stream_profile_counters(_as_stream(spark, texts, "texts"), out, scratch_path(spark, "running-log")).awaitTermination()
    return jobs.read_registry(spark, out, order=None)


_RUNNING = {
    "n_words": f"sum(len(regexp_extract_all(lower(text), {WORD})))",
    "word_chars": f"sum(length(array_to_string(regexp_extract_all(lower(text), {WORD}), '')))",
    "n_comma": f"sum({count_sql('text', ',')})",
    "n_exclamation": f"sum({count_sql('text', '!')})",
    "n_punct": "sum(len(regexp_extract_all(text, '[,;:—–\\-!?.()\"'']')))",
}
register(
    "stream_profile_counters",
    lambda spark, sf: _stream_counters(spark, sf).select("style_name", *_RUNNING),
    with_ctes(MARKED, "SELECT author AS style_name, " + ", ".join(f"coalesce({s}, 0)::BIGINT AS {n}" for n, s in _RUNNING.items()) + " FROM docs GROUP BY author"),
)


def _stream_requests(spark, sf):
    known = rg.list_styles(registry(spark, sf)).withColumn("card", F.concat(F.lit("style "), "style_name"))
    stream = jobs.stream_transfer_requests(_as_stream(spark, requests(spark, sf), "requests"), known)
    out = scratch_path(spark, "answered")
    jobs.write_stream(stream, out, scratch_path(spark, "answered-log")).awaitTermination()
    return spark.read.parquet(out)


register(
    "stream_transfer_requests",
    lambda spark, sf: _stream_requests(spark, sf).select("request_id", "style_name", "author_name", "status"),
    with_ctes(
        REQUESTS, FILLED, REGISTRY,
        """SELECT request_id, style_name, author_name, CASE WHEN length(original_text) = 0 THEN 'missing_text' WHEN ts IS NULL THEN 'unknown_style' ELSE 'ok' END AS status
           FROM filled LEFT JOIN reg USING (style_name)""",
    ),
)


def _stream_registry(spark, sf):
    old, new = style_rows(spark, sf)
    out = scratch_path(spark, "registry")
    jobs.stream_registry_upsert(_as_stream(spark, old.unionByName(new), "changes"), out, scratch_path(spark, "registry-log")).awaitTermination()
    return jobs.read_registry(spark, out)


register("stream_registry_upsert", _stream_registry, with_ctes(REGISTRY, "SELECT style_name, ts, lang, v FROM reg"))
