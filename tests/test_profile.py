import math
import random

import pytest
from pyspark.sql import functions as F

from penprint import style_profile
from penprint.catalog import all_queries
from penprint.functions import text as tx
from penprint.operators import counters as ct
from penprint.operators import edges as ed
from penprint.plans import profile as pr
from penprint.plans import reports as rp

from brute import kind_of, measures, sentences_of

FIXED = [
    ("a", 1, "Why would you say that? Who knows."),
    ("a", 2, "I will go; however, it was painted red - twice... Truly!"),
    ("a", 3, '"Don\'t," she said, "please."'),
    ("a", 4, "No final stop here"),
    ("a", 5, "because we analysis thus (so) — yes – no …"),
    ("b", 1, "gonna be very very good lol"),
    ("c", 1, "!!! ..."),
    ("d", 1, ""),
    ("e", 1, "Le café était très agréable. ÉCOLE Émile NASA Paris."),
]
# Pieces that make seams matter: open sentences, split phrases, one-word and blank texts.
PIECES = [
    "It was", "painted red.", "walked home", "I will", "will", "would", "you come?", "may", "I ask", "a -", "- b", "yes - no",
    "Hello there.", "...", "!", "", "  ", "so, and", "if", "The End", "NASA", "über, café; x", "one", "x", "ab", "were", "Being asked",
    "was   ended", "thou hath herein", "because", "said \"so\"", "don't", "(thus)", "therefore…", "q?r!s", "a b c d e f g", "\n", "tail ",
]


def random_rows(seed, authors=6, texts=12):
    rng = random.Random(seed)
    rows = []
    for a in range(authors):
        for seq in range(rng.randint(1, texts)):
            text = rng.choice([" ", "  ", "\n", ". "]).join(rng.choices(PIECES, k=rng.randint(0, 4)))
            rows.append((f"r{seed}-{a}", seq * 3 + 1, text))
    return rows


def close(a, b):
    if isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return list(a) == list(b)


def compare(rows, result, compat=False):
    by_author = {}
    for author, seq, text in sorted(rows):
        by_author.setdefault(author, []).append(text)
    assert {r["author"] for r in result} == set(by_author)
    for r in result:
        texts = by_author[r["author"]]
        expected = measures(texts, compat)
        for field, value in expected.items():
            assert close(r[field], value), (field, r[field], value, texts)


@pytest.fixture(scope="module")
def rows():
    return FIXED + [row for seed in range(12) for row in random_rows(seed)]


def test_corpus_scope_equals_the_joined_text(spark, rows):
    docs = spark.createDataFrame(rows, "author string, seq bigint, text string").repartition(5)
    compare(rows, style_profile(docs).collect())


def test_original_slips_on_request(spark):
    docs = spark.createDataFrame(FIXED, "author string, seq bigint, text string")
    got = style_profile(docs, compat=True)
    result = got.collect()
    compare(FIXED, result, compat=True)
    assert all(r["rhetorical_question_ratio"] == 0.0 and r["compound_sentence_ratio"] == 0.0 for r in result)


def test_document_scope_on_single_texts_equals_corpus_scope(spark, rows):
    single = [(f"{a}-{s}", s, t) for a, s, t in rows]
    docs = spark.createDataFrame(single, "author string, seq bigint, text string")
    fields = [f for f in pr.FIELDS if f != "top_emotions"]
    a = {r["author"]: r for r in style_profile(docs, scope="document", only=fields).collect()}
    b = {r["author"]: r for r in style_profile(docs, scope="corpus", only=fields).collect()}
    assert a == b


def test_blocks_do_not_change_seams(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "author string, seq bigint, text string")
    whole = {r["author"]: r for r in ct.sentence_counters(docs).collect()}
    small = ed.running_totals
    monkeypatch.setattr(ed, "running_totals", lambda *a: small(*a, block_bits=1))
    assert {r["author"]: r for r in ct.sentence_counters(docs).collect()} == whole


def test_every_field_is_there_and_shares_add_up(spark):
    docs = spark.createDataFrame(FIXED, "author string, seq bigint, text string")
    profile = style_profile(docs)
    assert profile.columns == ["author", *pr.FIELDS] and len(pr.FIELDS) == 72
    for r in profile.collect():
        if r["avg_words_per_sentence"]:
            assert math.isclose(r["simple_sentence_ratio"] + r["compound_sentence_ratio"] + r["complex_sentence_ratio"], 1.0)
        assert math.isclose(r["narrative_score"] + r["analytical_score"], 1.0)
        assert math.isclose(r["hapax_legomena_ratio"] * r["vocabulary_richness"], r["rare_word_frequency"], abs_tol=1e-12)
        assert math.isclose(r["sentence_length_variance"], r["sentence_length_std"] ** 2, abs_tol=1e-9)
    counts = rp.profile_field_counts(profile).first()
    assert (counts["total_features"], counts["numeric_features"], counts["pattern_features"]) == (72, 62, 10)


def test_rhetorical_needs_the_question_mark(spark):
    docs = spark.createDataFrame(FIXED, "author string, seq bigint, text string")
    got = {r["author"]: r["rhetorical_question_ratio"] for r in style_profile(docs, only=["rhetorical_question_ratio"]).collect()}
    assert got["a"] > 0 and got["b"] == 0


def test_caps_read_only_the_head(spark):
    rows = [("a", 1, "One two three. Four five six. Seven eight."), ("a", 2, "incomprehensibility " * 300)]
    docs = spark.createDataFrame(rows, "author string, seq bigint, text string")
    caps = pr.Caps(readability=42)
    capped = style_profile(docs, caps=caps, only=["smog_index", "flesch_reading_ease"]).first()
    alone = style_profile(docs.where("seq = 1"), only=["smog_index", "flesch_reading_ease"]).first()
    assert capped["smog_index"] == alone["smog_index"] and capped["flesch_reading_ease"] == alone["flesch_reading_ease"]


@pytest.mark.parametrize("compat", [False, True])
def test_first_sentences_only(spark, rows, compat):
    docs = spark.createDataFrame(rows, "author string, seq bigint, text string").repartition(5)
    for limit in (1, 3, 8):
        got = {r["author"]: r for r in ct.first_sentence_types(docs, limit, compat=compat).collect()}
        by = {}
        for a, _, t in sorted(rows):
            by.setdefault(a, []).append(t)
        for author, texts in by.items():
            kinds = [kind_of(x, compat) for x in sentences_of(" ".join(texts))[:limit]]
            r = got.get(author)
            have = (r["n_simple"], r["n_compound"], r["n_complex"]) if r else (0, 0, 0)
            assert have == tuple(kinds.count(k) for k in ("simple", "compound", "complex")), (author, limit, texts)


def test_all_caps_at_once(spark):
    rows = [("a", i, f"The happy dog number {i} was painted, and it quickly walked home. Why would you go?") for i in range(200)]
    docs = spark.createDataFrame(rows, "author string, seq bigint, text string")
    caps = pr.Caps(sentiment=100, emotion=100, readability=100, annotation=100, sentence_types=4, trees=4)
    head = " ".join(t for _, _, t in rows)[:100]
    alone = spark.createDataFrame([("a", 1, head)], "author string, seq bigint, text string")
    a, b = style_profile(docs, caps=caps).first(), style_profile(alone).first()
    for f in ("noun_ratio", "verb_ratio", "present_tense_ratio", "concreteness_score", "flesch_reading_ease", "vader_compound"):
        assert a[f] == b[f], f
    assert a["complex_sentence_ratio"] == 0.0 and a["compound_sentence_ratio"] == 0.5
    assert a["comma_frequency"] == style_profile(docs, only=["comma_frequency"]).first()[0 + 1]


def test_reports(spark):
    docs = spark.createDataFrame(FIXED, "author string, seq bigint, text string")
    profile = style_profile(docs).cache()
    a = {r["metric"]: r for r in rp.profile_report(profile).where("author = 'a'").collect()}
    assert a["comma_frequency"]["shown"] == "%.3f" % a["comma_frequency"]["value"]
    assert a["active_voice_ratio"]["shown"].endswith("%")
    cards = {r["label"]: r["value"] for r in rp.profile_cards(rp.profile_summary(profile)).where("author = 'a'").collect()}
    assert cards["Avg Word Length"].endswith(" chars") and cards["Reading Level"].startswith("Grade ")
    assert rp.profile_cards(rp.profile_summary(profile)).where("author = 'd' AND label = 'Top Words'").count() == 0
    charts = rp.profile_chart_values(profile).where(F.col("value") > 1).where("panel = 'readability'")
    assert charts.count() == 0
    rounded = rp.round_profile(profile).where("author = 'a'").first()
    assert rounded["avg_word_length"] == round(rounded["avg_word_length"], 2)


def test_only_leaves_out_what_no_field_reads(spark):
    docs = spark.createDataFrame([("a", 1, "One two. Three four!"), ("b", 1, None)], "author string, seq bigint, text string")

    def plan(*fields):
        return style_profile(docs, only=fields)._jdf.queryExecution().optimizedPlan().toString()

    assert "n_sentences" not in plan("top_words") and "n_comma" not in plan("top_words")
    assert "n_sentences" not in plan("avg_word_length", "archaic_words")
    whole = style_profile(docs).orderBy("author").collect()
    for field in [*list(pr.FIELDS)[::10], "formality_score", "top_emotions", "vader_compound"]:
        alone = style_profile(docs, only=[field]).orderBy("author").collect()
        assert [r[field] for r in alone] == [r[field] for r in whole], field


@pytest.mark.parametrize("name", ["future_tense_ratio", "passive_voice_ratio", "politeness_score", "profile_cards", "style_profile_original_caps"])
def test_marked_texts_are_made_once(spark, sf, name):
    plan = all_queries()[name].run(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Why would you" not in plan


def test_edges_leave_out_what_is_not_read(spark):
    docs = spark.createDataFrame([("a", 1, "one. two")], "author string, seq long, text string")
    placed = ed.stored_edges(docs, without=(*ed.GRAMS, "inner"))
    assert not {*ed.GRAMS, "inner", "word_offset", "char_offset", "inner_offset"} & set(placed.columns)
    assert {"stop_offset", "text_offset"} <= set(placed.columns)


def test_ends_of_texts_equal_a_search_of_the_whole_text(spark):
    ends = ["was", "was ", "WERE\n", "xwas", "_was", "ébeen", " been\u2028\r\n ", "was.", "being\x0b", "\U0001d400was", "a -", "a - -", "- -", "-", " - ", "- a - ", " -", "", " "]
    texts = sorted({*ends, *(f"{a} {b}" for a in ends for b in ends), *(f"{a}{b}" for a in ends for b in ends)})
    docs = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)], "author string, seq long, text string")
    t = F.col("text")
    passive = t.rlike(f"(?i){tx.NOT_AFTER_WORD}({'|'.join(ed.AUXILIARIES)}){tx.SPACE}*$")
    dashes = [tx.count_of(c, " - ") - tx.count_of(t, " - ") for c in (F.concat(t, F.lit(" ")), F.concat(F.lit(" "), t))]
    want = {r[0]: tuple(r[1:]) for r in docs.select("seq", passive, *dashes).collect()}
    edges = ed.text_edges(docs).select("seq", "closing.passive", "closing.dash", F.col("opening.dash"))
    assert {r[0]: tuple(r[1:]) for r in edges.collect()} == want


def test_the_query_shows_every_card(spark, sf):
    labels = {r["label"]: r["n"] for r in all_queries()["profile_cards"].run(spark, sf).groupBy("label").agg(F.count("value").alias("n")).collect()}
    assert set(labels) == {"Avg Word Length", "Sentence Length", "Vocabulary Richness", "Formality", "Sentiment", "Reading Level", "Top Words"}
    assert len(set(labels.values())) == 1
