"""Queries on reading, cleaning, splitting and counting text."""

from __future__ import annotations

from pyspark.sql import functions as F

from penprint.catalog.base import (
    CORPUS, DOCS, MARKED, NON_SPACE, SPACE, STRIP, VOCAB, WORD, WORDS,
    documents, in_list, marked, quote, register, table, with_ctes,
)
from penprint import lexicons as lx
from penprint.functions import text as tx
from penprint.operators import grams as gr
from penprint.operators import segment as sg
from penprint.sources import tables as st
from penprint.session import scratch_path

NS_RUN = quote(f"{tx.NON_SPACE}+")


def words_ws(text: str) -> str:
    return f"len(regexp_extract_all({text}, {NS_RUN}))"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, {STRIP}, '', 'g')"


# Sources and sinks ----------------------------------------------------------------------------


def _posts(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(
        F.col("source").alias("blogger_id"),
        F.lit("n/a").alias("gender"),
        F.col("n_chars").cast("int").alias("age"),
        F.col("lang").alias("industry"),
        F.lit("none").alias("zodiac"),
        F.col("doc_id").cast("string").alias("date"),
        F.col("text"),
    )


def _scan_posts_csv(spark, sf):
    path = scratch_path(spark, "posts")
    _posts(spark, sf).write.option("header", False).option("quoteAll", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    posts = st.scan_posts_csv(spark, path)
    return posts.select("blogger_id", "gender", "age", "industry", "zodiac", "date", F.length("text").cast("bigint").alias("chars"))


register(
    "scan_posts_csv",
    _scan_posts_csv,
    """SELECT source AS blogger_id, 'n/a' AS gender, n_chars::INT AS age, lang AS industry, 'none' AS zodiac,
       doc_id::VARCHAR AS date, length(text)::BIGINT AS chars FROM documents""",
)
register(
    "scan_parquet",
    lambda spark, sf: st.scan_parquet(spark, f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", F.md5("text").alias("digest")),
    "SELECT doc_id, source, lang, n_chars, md5(text) AS digest FROM documents",
)


def _scan_lines(spark, sf):
    path = scratch_path(spark, "lines")
    table(spark, sf, "documents").select("text").write.text(path)
    return st.scan_lines(spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


register(
    "scan_lines",
    _scan_lines,
    f"""SELECT line, count(*) AS n
        FROM (SELECT {strip_sql('x')} AS line FROM (SELECT unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS x FROM documents))
        WHERE line <> '' GROUP BY line""",
)


def _sink_parquet(spark, sf):
    path = scratch_path(spark, "authors")
    st.sink_parquet(sg.author_sentences(documents(spark, sf)), path)
    return spark.read.parquet(path).select("author_id", "num_sentences", F.posexplode("sentences").alias("place", "sentence")).select(
        "author_id", F.col("num_sentences").cast("bigint").alias("num_sentences"), (F.col("place") + 1).cast("bigint").alias("rank"), "sentence"
    )


_ENDED = f"""ended AS (
  SELECT author, seq, unnest(l) AS sentence, unnest(range(len(l))) AS sent_id
  FROM (SELECT author, seq, list_transform(
          list_filter(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: regexp_matches(x, {NON_SPACE})),
          lambda x: {strip_sql('x')}) AS l FROM docs))"""
_AUTHOR_SENTENCES = with_ctes(
    DOCS,
    _ENDED,
    f"""long AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY seq, sent_id) AS rank,
                 count(*) OVER (PARTITION BY author) AS have FROM ended WHERE {words_ws('sentence')} > 5)""",
    "SELECT author AS author_id, 50::BIGINT AS num_sentences, rank, sentence FROM long WHERE have >= 50 AND rank <= 50",
)
register("sink_parquet", _sink_parquet, _AUTHOR_SENTENCES)
register(
    "preview",
    lambda spark, sf: st.preview(table(spark, sf, "documents")),
    """SELECT 0::BIGINT AS place, 'doc_id' AS "column", 'bigint' AS type, count(*) AS rows, count(*) FILTER (WHERE doc_id IS NULL) AS nulls, NULL::BIGINT AS total_size FROM documents
       UNION ALL SELECT 1, 'text', 'string', count(*), count(*) FILTER (WHERE text IS NULL), sum(length(text))::BIGINT FROM documents
       UNION ALL SELECT 2, 'lang', 'string', count(*), count(*) FILTER (WHERE lang IS NULL), sum(length(lang))::BIGINT FROM documents
       UNION ALL SELECT 3, 'source', 'string', count(*), count(*) FILTER (WHERE source IS NULL), sum(length(source))::BIGINT FROM documents
       UNION ALL SELECT 4, 'n_chars', 'bigint', count(*), count(*) FILTER (WHERE n_chars IS NULL), NULL FROM documents""",
)


def _prefixes(spark, sf):
    """Code points of the first word of each document as JSON bytes, whole word or not."""
    word = F.get(tx.words(F.col("text")), F.lit(0))
    lengths = F.transform(tx.words(F.col("text")), lambda w: F.length(w).cast("string"))
    return documents(spark, sf).select("seq", F.concat(F.lit("["), F.array_join(lengths, ", "), F.lit("]")).alias("prefix_ids"), word.alias("word"))


def _decode(spark, sf):
    rows = _prefixes(spark, sf)
    as_text = st.decode_prefix_json(rows).select("seq", F.col("prefix_ids").alias("a"))
    as_bytes = st.decode_prefix_json(rows.withColumn("prefix_ids", F.col("prefix_ids").cast("binary"))).select(
        "seq", F.col("prefix_ids").alias("a")
    )
    total = F.aggregate("a", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    both = as_text.withColumn("kind", F.lit("text")).unionByName(as_bytes.withColumn("kind", F.lit("bytes")))
    return both.select("seq", "kind", F.size("a").cast("bigint").alias("n"), total.alias("total"), F.get("a", F.lit(0)).alias("head"))


register(
    "decode_prefix_json",
    _decode,
    f"""WITH l AS (SELECT doc_id AS seq, list_transform(regexp_extract_all(lower(text), {WORD}), lambda w: length(w)) AS a FROM documents)
        SELECT seq, kind, len(a)::BIGINT AS n, coalesce(list_sum(a), 0)::BIGINT AS total, a[1]::BIGINT AS head
        FROM l CROSS JOIN (VALUES ('text'), ('bytes')) AS k(kind)""",
)
register(
    "coerce_float_vector",
    lambda spark, sf: st.coerce_float_vector(table(spark, sf, "embeddings"), "embedding").select(
        "vec_id", F.posexplode("embedding").alias("dim", "x")
    ).select("vec_id", F.col("dim").cast("bigint").alias("dim"), "x"),
    "SELECT vec_id, unnest(range(len(embedding)))::BIGINT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings",
)
register(
    "coerce_id_string",
    lambda spark, sf: st.coerce_id_string(table(spark, sf, "embeddings").withColumnRenamed("label", "author_id")).groupBy("author_id").agg(F.count(F.lit(1)).alias("n")),
    "SELECT label::VARCHAR AS author_id, count(*) AS n FROM embeddings GROUP BY 1",
)

# Cleaning and splitting -----------------------------------------------------------------------


def _clean_sql(text: str) -> str:
    t = f"replace(coalesce({text}, ''), 'urllink', ' ')"
    t = f"regexp_replace({t}, {quote('http' + tx.NON_SPACE + '+')}, ' ', 'g')"
    t = f"regexp_replace({t}, '<[^\\n]*?>', ' ', 'g')"
    t = f"regexp_replace({t}, {quote(SPACE + '+')}, ' ', 'g')"
    return f"trim({t}, ' ')"


register(
    "clean_text",
    lambda spark, sf: sg.clean_text(
        table(spark, sf, "pages").select("page_id", F.concat_ws(" ", F.lit("urllink"), "url", "html").alias("text"))
    ),
    f"SELECT page_id, {_clean_sql('text')} AS text FROM (SELECT page_id, 'urllink ' || url || ' ' || html AS text FROM pages)",
)
register(
    "merge_posts",
    lambda spark, sf: sg.merge_posts(documents(spark, sf)).select("author", "seq", "start", F.md5("text").alias("digest")),
    with_ctes(
        DOCS,
        """SELECT author, seq, coalesce(sum(length(text) + 1) OVER (PARTITION BY author ORDER BY seq
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, md5(text) AS digest FROM docs""",
    ),
)
register(
    "sentences_punkt",
    lambda spark, sf: sg.split_sentences(documents(spark, sf), keep_end=True).select(
        "author", "seq", F.col("sent_id").cast("bigint").alias("sent_id"), "sentence"
    ),
    with_ctes(DOCS, _ENDED, "SELECT author, seq, sent_id, sentence FROM ended"),
)
register(
    "filter_short_sentences",
    lambda spark, sf: sg.filter_short_sentences(documents(spark, sf)).select(
        "author", "seq", F.col("sent_id").cast("bigint").alias("sent_id"), "sentence"
    ),
    with_ctes(DOCS, _ENDED, f"SELECT author, seq, sent_id, sentence FROM ended WHERE {words_ws('sentence')} > 5"),
)
register(
    "author_sentences",
    lambda spark, sf: sg.author_sentences(documents(spark, sf))
    .select("author_id", "num_sentences", F.posexplode("sentences").alias("place", "sentence"))
    .select("author_id", F.col("num_sentences").cast("bigint").alias("num_sentences"), (F.col("place") + 1).cast("bigint").alias("rank"), "sentence"),
    _AUTHOR_SENTENCES,
)
register(
    "author_sentences_skip_small",
    lambda spark, sf: sg.author_sentences(documents(spark, sf).withColumn("author", F.col("seq").cast("string")), wanted=10)
    .select("author_id", F.col("num_sentences").cast("bigint").alias("num_sentences"), F.array_join("sentences", "|").alias("sentences")),
    with_ctes(
        "docs AS (SELECT doc_id::VARCHAR AS author, doc_id AS seq, text FROM documents)",
        _ENDED,
        f"""long AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY seq, sent_id) AS rank
             FROM ended WHERE {words_ws('sentence')} > 5)""",
        """SELECT author AS author_id, count(*) AS num_sentences, string_agg(sentence, '|' ORDER BY rank) AS sentences
           FROM long WHERE rank <= 10 GROUP BY author HAVING count(*) = 10""",
    ),
)
register(
    "split_sentences",
    lambda spark, sf: sg.split_sentences(documents(spark, sf)).select(
        "author", "seq", F.col("sent_id").cast("bigint").alias("sent_id"), "sentence"
    ),
    with_ctes(
        DOCS,
        f"""l AS (SELECT author, seq, list_filter(string_split_regex(text, '[.!?]+'), lambda x: regexp_matches(x, {NON_SPACE})) AS l FROM docs)""",
        f"""SELECT author, seq, sent_id, {strip_sql('s')} AS sentence
            FROM (SELECT author, seq, unnest(l) AS s, unnest(range(len(l))) AS sent_id FROM l)""",
    ),
)
register(
    "tokenize_words",
    lambda spark, sf: sg.tokenize_words(documents(spark, sf)).select("author", "seq", F.col("pos").cast("bigint").alias("pos"), "word"),
    with_ctes(
        DOCS,
        f"l AS (SELECT author, seq, regexp_extract_all(lower(text), {WORD}) AS l FROM docs)",
        "SELECT author, seq, unnest(range(len(l))) AS pos, unnest(l) AS word FROM l",
    ),
)
_LINES = f"""lines AS (SELECT *, list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {NON_SPACE})), lambda x: {strip_sql('x')}) AS ls FROM docs)"""
register(
    "segment_request",
    lambda spark, sf: sg.segment_request(documents(spark, sf)).select("author", "seq", F.col("seg_id").cast("bigint").alias("seg_id"), "segment"),
    with_ctes(
        DOCS,
        _LINES,
        f"""segs AS (SELECT author, seq, CASE WHEN len(ls) < 5 THEN list_transform(
              list_filter(string_split_regex(text, '[.!?]+'), lambda x: regexp_matches(x, {NON_SPACE})), lambda x: {strip_sql('x')})
              ELSE ls END AS l FROM lines)""",
        "SELECT author, seq, unnest(range(len(l))) AS seg_id, unnest(l) AS segment FROM segs",
    ),
)


def _encoder_sql(limit: int) -> str:
    return with_ctes(
        DOCS,
        f"""l AS (SELECT seq, text, list_transform(list_filter(regexp_extract_all(text, '[^.!?]+[.!?]*'),
             lambda x: regexp_matches(x, {NON_SPACE})), lambda x: {strip_sql('x')}) AS l FROM docs)""",
        f"k AS (SELECT seq, text, list_filter(l, lambda s: {words_ws('s')} > 3)[1:{limit}] AS k FROM l)",
        """SELECT seq, unnest(range(len(k))) AS place, unnest(k) AS sentence
           FROM (SELECT seq, CASE WHEN len(k) = 0 THEN [text] ELSE k END AS k FROM k)""",
    )


for _limit, _name in ((5, "select_encoder_sentences"), (8, "select_encoder_sentences_8")):
    register(
        _name,
        lambda spark, sf, limit=_limit: sg.select_encoder_sentences(documents(spark, sf).select("seq", "text"), limit=limit)
        .select("seq", F.posexplode("sentences").alias("place", "sentence"))
        .select("seq", F.col("place").cast("bigint").alias("place"), "sentence"),
        _encoder_sql(_limit),
    )


def _user_sentences(spark, sf):
    """Sentences of each document's author-less pages of talk: one user per conversation and role."""
    turns = table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "role").alias("author"), F.col("turn").alias("t"), "text"
    )
    rows = sg.split_sentences(turns).withColumn("seq", F.col("t") * 1_000_000 + F.col("sent_id"))
    return sg.select_user_sentences(rows.select("author", "seq", "sentence"))


register(
    "select_user_sentences",
    _user_sentences,
    with_ctes(
        f"""s AS (SELECT author, t, unnest(l) AS s, unnest(range(len(l))) AS sent_id FROM
             (SELECT conv_id::VARCHAR || '-' || role AS author, turn AS t,
                     list_filter(string_split_regex(text, '[.!?]+'), lambda x: regexp_matches(x, {NON_SPACE})) AS l FROM conversations))""",
        f"u AS (SELECT author, {strip_sql('s')} AS sentence, row_number() OVER (PARTITION BY author ORDER BY t, sent_id) AS rank FROM s WHERE {words_ws('s')} > 3)",
        "c AS (SELECT author, count(*) AS n FROM u GROUP BY author)",
        """SELECT a.author, CASE WHEN coalesce(c.n, 0) < 5 THEN 'too_few_sentences' ELSE 'ok' END AS status, u.rank, u.sentence
           FROM (SELECT DISTINCT author FROM s) a LEFT JOIN c USING (author) LEFT JOIN (SELECT * FROM u WHERE rank <= 50) u USING (author)""",
    ),
)
register(
    "sample_caps",
    lambda spark, sf: sg.sample_caps(
        documents(spark, sf), {"emotion_chars": 1000, "sentiment_chars": 5000, "annotation_chars": 1_000_000, "all_chars": None}
    ),
    with_ctes(
        DOCS,
        """p AS (SELECT author, length(text) AS len, coalesce(sum(length(text) + 1) OVER (PARTITION BY author ORDER BY seq
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM docs)""",
        """SELECT author, sum(least(len, greatest(0, 1000 - start)))::BIGINT AS emotion_chars,
             sum(least(len, greatest(0, 5000 - start)))::BIGINT AS sentiment_chars,
             sum(least(len, greatest(0, 1000000 - start)))::BIGINT AS annotation_chars,
             sum(len)::BIGINT AS all_chars FROM p GROUP BY author""",
    ),
)


def _echo(spark, sf):
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("Rewrite: "), "role", F.lit(":")).alias("prompt"), "text"
    )
    rows = rows.withColumn("output", F.concat("prompt", F.lit(" \n"), "text"))
    return sg.strip_prompt_echo(rows).select("conv_id", "turn", "answer")


register(
    "strip_prompt_echo",
    _echo,
    f"SELECT conv_id, turn, {strip_sql('text')} AS answer FROM conversations",
)
register(
    "word_count_ws",
    lambda spark, sf: documents(spark, sf).select("author", "seq", tx.word_count_ws(F.col("text")).cast("bigint").alias("words")),
    with_ctes(DOCS, f"SELECT author, seq, {words_ws('text')}::BIGINT AS words FROM docs"),
)

# Ranked lists ---------------------------------------------------------------------------------


def _top(kind, scope="corpus"):
    def run(spark, sf):
        counts = gr.gram_counts(documents(spark, sf), [kind], scope=scope)
        return gr.top_terms(counts, [kind]).select("author", "rank", "term", "n")

    return run


def _ranked_sql(counts: str, k: int, *ctes: str) -> str:
    return with_ctes(
        *ctes,
        f"counts AS ({counts})",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY n DESC, first) AS rank FROM counts)",
        f"SELECT author, rank, term, n FROM ranked WHERE rank <= {k}",
    )


def _char_sql(n: int, k: int) -> str:
    return _ranked_sql(
        "SELECT author, term, count(*) AS n, min(pos) AS first FROM grams GROUP BY author, term",
        k,
        DOCS,
        CORPUS,
        f"""chars AS (SELECT author, string_split(regexp_replace(lower(t), {quote(SPACE + '+')}, '', 'g'), '') AS c FROM corpus)""",
        f"""grams AS (SELECT author, pos, {' || '.join(f'c[pos + {i}]' for i in range(1, n + 1))} AS term
             FROM (SELECT author, c, unnest(range(len(c) - {n - 1})) AS pos FROM chars))""",
    )


_WORD_LEADS = """lead(w, 1) OVER a AS w1, lead(w, 2) OVER a AS w2 FROM words WINDOW a AS (PARTITION BY author ORDER BY pos)"""


def _gram_sql(n: int, k: int) -> str:
    term = "w || ' ' || w1" if n == 2 else "w || ' ' || w1 || ' ' || w2"
    last = "w1" if n == 2 else "w2"
    return _ranked_sql(
        f"SELECT author, {term} AS term, count(*) AS n, min(pos) AS first FROM l WHERE {last} IS NOT NULL GROUP BY 1, 2",
        k,
        DOCS,
        CORPUS,
        WORDS,
        f"l AS (SELECT author, pos, w, {_WORD_LEADS})",
    )


_STOP = in_list(lx.STOP_WORDS)
_TOP_WORDS_SQL = _ranked_sql(
    f"SELECT author, w AS term, n, first FROM vocab WHERE length(w) > 3 AND w NOT IN {_STOP}", 20, DOCS, CORPUS, WORDS, VOCAB
)
register("top_words", _top(gr.CONTENT_WORDS), _TOP_WORDS_SQL)
register(
    "ranked_topk",
    lambda spark, sf: gr.top_terms(
        gr.vocabulary_with_first(documents(spark, sf)).withColumn("kind", F.lit("w")), [gr.Kind("w", "word", 1, 20)]
    ).select("author", "rank", "term", "n"),
    _ranked_sql("SELECT author, w AS term, n, first FROM vocab", 20, DOCS, CORPUS, WORDS, VOCAB),
)
register("top_bigrams", _top(gr.BIGRAMS), _gram_sql(2, 15))
register("top_trigrams", _top(gr.TRIGRAMS), _gram_sql(3, 10))
register("top_char_trigrams", _top(gr.CHAR_TRIGRAMS), _char_sql(3, 10))
register("top_char_fourgrams", _top(gr.CHAR_FOURGRAMS), _char_sql(4, 10))
register(
    "top_bigrams_document",
    _top(gr.BIGRAMS, "document"),
    _ranked_sql(
        "SELECT author, w || ' ' || w1 AS term, count(*) AS n, min((seq, pos)) AS first FROM l WHERE w1 IS NOT NULL GROUP BY 1, 2",
        15,
        DOCS,
        f"""dw AS (SELECT author, seq, unnest(l) AS w, unnest(range(len(l))) AS pos
             FROM (SELECT author, seq, regexp_extract_all(lower(text), {WORD}) AS l FROM docs))""",
        "l AS (SELECT author, seq, pos, w, lead(w, 1) OVER (PARTITION BY author, seq ORDER BY pos) AS w1 FROM dw)",
    ),
)
register(
    "content_words",
    lambda spark, sf: gr.content_words(documents(spark, sf)).groupBy("author", "word").agg(F.count(F.lit(1)).alias("n")),
    with_ctes(
        DOCS, CORPUS, WORDS, VOCAB, f"SELECT author, w AS word, n FROM vocab WHERE length(w) > 3 AND w NOT IN {_STOP}"
    ),
)
for _name, _terms in (("archaic_words", lx.ARCHAIC), ("formal_words", lx.FORMAL), ("modal_verbs_used", lx.MODALS)):
    register(
        _name,
        lambda spark, sf, terms=_terms: gr.vocabulary(marked(spark, sf)).where(F.col("word").isin(terms)).select("author", "word"),
        with_ctes(MARKED, CORPUS, WORDS, VOCAB, f"SELECT author, w AS word FROM vocab WHERE w IN {in_list(_terms)}"),
    )
register(
    "sentence_type",
    lambda spark, sf: sg.split_sentences(marked(spark, sf)).select(
        "author", "seq", F.col("sent_id").cast("bigint").alias("sent_id"),
        tx.sentence_type(F.col("sentence")).alias("type"), tx.sentence_type(F.col("sentence"), compat=True).alias("type_compat"),
    ),
    with_ctes(
        MARKED,
        f"""l AS (SELECT author, seq, list_filter(string_split_regex(text, '[.!?]+'), lambda x: regexp_matches(x, {NON_SPACE})) AS l FROM docs)""",
        "s AS (SELECT author, seq, unnest(l) AS s, unnest(range(len(l))) AS sent_id FROM l)",
        f"""f AS (SELECT author, seq, sent_id,
             list_has_any(regexp_extract_all(lower(s), {WORD}), {lx.CONJUNCTIONS}) AS conj,
             list_has_any(regexp_extract_all(lower(s), {WORD}), {lx.SUBORDINATORS}) AS sub,
             regexp_matches(lower(s), '{'|'.join(lx.CONJUNCTIONS)}') AS conj_c,
             regexp_matches(lower(s), '{'|'.join(lx.SUBORDINATORS)}') AS sub_c,
             contains(s, ',') OR contains(s, ';') AS pause FROM s)""",
        """SELECT author, seq, sent_id, CASE WHEN sub THEN 'complex' WHEN conj AND pause THEN 'compound' ELSE 'simple' END AS type,
             CASE WHEN sub_c OR (pause AND conj_c) THEN 'complex' ELSE 'simple' END AS type_compat FROM f""",
    ),
)
