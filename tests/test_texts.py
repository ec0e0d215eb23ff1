import re

from pyspark.sql import functions as F

from penprint.functions import text as tx
from penprint.operators import segment as sg
from penprint.operators import tokens as tk
from penprint.session import scratch_path
from penprint.sources import tables as st

CLEAN = [
    (1, "see urllink now", "see now"),
    (2, "see urlLink now", "see urlLink now"),
    (3, "go http://x.y/z?q=1 there", "go there"),
    (4, "<b>bold</b>  and <i", "bold and <i"),
    (5, "a <b\n> c", "a <b > c"),
    (6, None, ""),
    (7, "  non breaking space ", "non breaking space"),
]


def test_clean_text(spark):
    df = spark.createDataFrame([(i, t) for i, t, _ in CLEAN], "id int, text string")
    assert {r["id"]: r["text"] for r in sg.clean_text(df).collect()} == {i: want for i, _, want in CLEAN}


def test_words_and_counts_equal_python(spark):
    texts = ["Le café était là_bas 12½", "a-b c's ñandú", "", "…", "x y z", "日本語 text", "Straße ÀÉ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", tx.words(F.col("t")).alias("w"), tx.word_count_ws(F.col("t")).alias("n")).collect():
        assert r["w"] == re.findall(r"\b\w+\b", r["t"].lower())
        assert r["n"] == len(r["t"].split())


def test_literal_counts_do_not_overlap(spark):
    df = spark.createDataFrame([("..... — —, - - -",)], "t string")
    t = F.col("t")
    got = df.select(*[tx.count_of(t, p).alias(str(i)) for i, p in enumerate(["...", "—", " - ", ","])]).first()
    want = "..... — —, - - -"
    assert list(got) == [want.count(p) for p in ["...", "—", " - ", ","]]


def test_author_sentences(spark):
    rows = [("a", i, f"This is sentence number {i} of author a. Too short.") for i in range(60)]
    rows += [("b", i, f"This is sentence number {i} of author b.") for i in range(49)]
    df = spark.createDataFrame(rows, "author string, seq bigint, text string").repartition(7)
    got = sg.author_sentences(df).collect()
    assert len(got) == 1 and got[0]["author_id"] == "a" and got[0]["num_sentences"] == 50
    assert got[0]["sentences"] == [f"This is sentence number {i} of author a." for i in range(50)]


def test_merge_posts_pieces_make_the_whole(spark):
    rows = [("a", 5, "two"), ("a", 1, "one"), ("a", 9, None), ("a", 12, "end"), ("b", 1, "x")]
    df = spark.createDataFrame(rows, "author string, seq bigint, text string")
    pieces = sorted((r["author"], r["start"], r["text"]) for r in sg.merge_posts(df).collect())
    whole = "one two  end"
    for author, start, text in pieces:
        if author == "a":
            assert whole[start : start + len(text)] == text
    heads = {r["seq"]: r["text"] for r in sg.head_chars(df, 6).where("author = 'a'").collect()}
    assert heads == {1: "one", 5: "tw"}


def test_segments_fall_back_to_sentences(spark):
    df = spark.createDataFrame([(1, "a\nb\n\nc\nd\ne"), (2, "One. Two!\nThree")], "id int, text string")
    got = {}
    for r in sg.segment_request(df).orderBy("id", "seg_id").collect():
        got.setdefault(r["id"], []).append(r["segment"])
    assert got == {1: ["a", "b", "c", "d", "e"], 2: ["One", "Two", "Three"]}


def test_encoder_sentences(spark):
    df = spark.createDataFrame([("A b c d. E f. G h i j k!",), ("Too short.",)], "text string")
    assert [r["sentences"] for r in sg.select_encoder_sentences(df).collect()] == [["A b c d.", "G h i j k!"], ["Too short."]]


def test_user_sentences_status(spark):
    rows = [("u", i, f"a usable sentence number {i}") for i in range(60)] + [("v", 1, "only this one here"), ("w", 1, "no")]
    got = sg.select_user_sentences(spark.createDataFrame(rows, "author string, seq bigint, sentence string")).collect()
    by = {}
    for r in got:
        by.setdefault((r["author"], r["status"]), []).append(r["rank"])
    assert sorted(by) == [("u", "ok"), ("v", "too_few_sentences"), ("w", "too_few_sentences")]
    assert sorted(by["u", "ok"]) == list(range(1, 51)) and by["w", "too_few_sentences"] == [None]


def test_prefixes(spark):
    df = spark.createDataFrame([("[1,2,3]",), ("[]",)], "prefix_ids string")
    assert [r[0] for r in st.decode_prefix_json(df).collect()] == [[1, 2, 3], []]
    as_bytes = df.select(F.col("prefix_ids").cast("binary").alias("prefix_ids"))
    assert [r[0] for r in st.decode_prefix_json(as_bytes).collect()] == [[1, 2, 3], []]
    arrays = spark.createDataFrame([([4, 5],)], "prefix_ids array<int>")
    assert st.decode_prefix_json(arrays).first()[0] == [4, 5]


def test_posts_csv_with_quotes_and_newlines(spark):
    path = scratch_path(spark, "csv")
    rows = [("1", "male", 15, "Student", "Leo", "14,May,2004", 'He said "hi",\nthen left'), ("2", "f", None, "x", "y", "z", "plain")]
    df = spark.createDataFrame(rows, st.POSTS_SCHEMA)
    df.write.option("header", False).option("escape", '"').option("quoteAll", True).csv(path)
    assert sorted(st.scan_posts_csv(spark, path).collect()) == sorted(df.collect())


def test_tree_depth_of_given_links(spark):
    rows = [(1, 1, 2), (1, 2, 2), (1, 3, 5), (1, 4, 5), (1, 5, 2), (2, 1, 1)]
    tokens = spark.createDataFrame(rows, "sent_id int, tok_id int, head_id int")
    assert {r["sent_id"]: r["depth"] for r in tk.sentence_depths(tokens, ["sent_id"]).collect()} == {1: 2, 2: 0}
    chain = spark.createDataFrame([(1, i, max(i - 1, 1)) for i in range(1, 41)], "sent_id int, tok_id int, head_id int")
    assert tk.sentence_depths(chain, ["sent_id"]).first()["depth"] == 39


def test_given_tokens_give_tense_shares(spark):
    tokens = spark.createDataFrame(
        [("a", "VERB", "Past"), ("a", "VERB", "Pres"), ("a", "VERB", "Past"), ("a", "VERB", None), ("a", "NOUN", "Past"), ("b", "NOUN", None)],
        "author string, pos string, tense string",
    )
    got = {r["author"]: (r["present_tense_ratio"], r["past_tense_ratio"]) for r in tk.tense_ratios(tokens).collect()}
    assert got == {"a": (1 / 3, 2 / 3), "b": (0.0, 0.0)}


def test_prompt_echo(spark):
    df = spark.createDataFrame([("Say: hello Say: ", "Say:")], "output string, prompt string")
    assert sg.strip_prompt_echo(df).first()["answer"] == "hello"
