from penprint.operators import grams as gr


def test_sketched_richness_is_close(spark):
    rows = [("a", 1, " ".join(f"w{i % 700}" for i in range(5000))), ("b", 1, "one one one two")]
    docs = spark.createDataFrame(rows, "author string, seq bigint, text string")
    got = {r["author"]: r["vocabulary_richness"] for r in gr.approximate_richness(docs).collect()}
    assert abs(got["a"] - 700 / 5000) < 0.05 * 700 / 5000 and got["b"] == 0.5
