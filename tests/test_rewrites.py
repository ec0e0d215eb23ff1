import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from penprint.functions import vectors as vx
from penprint.operators import fit
from penprint.operators import prompts as pm
from penprint.operators import registry as rg
from penprint.operators import rerank as rr
from penprint.operators import vectors as vec
from penprint.plans.profile import style_profile
from penprint.session import scratch_path
from penprint.streaming import jobs


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def copy_of(a, b):
    longer = max(len(a), len(b))
    return 1.0 - levenshtein(a, b) / longer if longer else 1.0


def test_edit_terms(spark):
    pairs = [("kitten", "sitting"), ("", "abc"), ("", ""), ("same", "same"), ("café", "cafe")]
    df = spark.createDataFrame(pairs, "candidate string, input_text string")
    for r in rr.with_copy_ratio(df).withColumn("e4", rr.edit_penalty(F.col("candidate"), F.col("input_text"))).collect():
        a, b = r["candidate"], r["input_text"]
        assert r["copy_ratio"] == copy_of(a, b) and r["e4"] == levenshtein(a, b) / max(len(b), 1)


def test_near_copies_are_dropped_but_never_all(spark):
    base = "abcdefghijklmnopqrst"
    rows = [
        (1, 1, "xyz" + base[3:], base),  # similarity exactly .85: dropped
        (1, 2, "xyzw" + base[4:], base),
        (2, 1, base, base),
        (2, 2, base + "!", base),
    ]
    df = spark.createDataFrame(rows, "input_id int, cand_id int, candidate string, input_text string")
    kept = sorted((r["input_id"], r["cand_id"]) for r in rr.drop_near_copies(df).collect())
    assert kept == [(1, 2), (2, 1), (2, 2)]


def test_selection_equals_filter_then_choice(spark):
    rng = np.random.default_rng(5)
    rows = [
        (int(rng.integers(1, 40)) if i % 3 else 0, i, f"c{i}", *map(float, rng.random(4)), float(rng.choice([0.2, 0.85, 0.9])))
        for i in range(600)
    ]
    df = spark.createDataFrame(
        rows, "input_id int, cand_id int, candidate string, e1 double, e2 double, e3 double, e4 double, copy_ratio double"
    )
    got = {r["input_id"]: r["cand_id"] for r in rr.select_rewrite(df).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        mine = [r for r in mine if r[7] < 0.85] or mine
        want[key] = min(mine, key=lambda r: (r[3] + 2 * r[4] + 2 * r[5] + r[6] + 3 * r[7], r[1]))[1]
    assert got == want


def test_gaussian_terms(spark):
    rows = [([0.0, 0.0], [1.0, 1.0], [0.0, 0.0]), ([1.0, 2.0], [0.5, 2.0], [0.0, 0.0])]
    df = spark.createDataFrame(rows, "mu array<double>, sigma array<double>, target array<double>")
    both = fit.gaussian_nll(fit.gaussian_logprob(df)).collect()
    assert math.isclose(both[0]["e1"], 0.9189385, abs_tol=1e-6) and abs(both[0]["nll"]) < 1e-6
    m, s = np.array([1.0, 2.0]), np.array([0.5, 2.0])
    assert math.isclose(both[1]["e1"], float(np.mean(m**2 / (2 * s**2) + np.log(s) + 0.5 * np.log(2 * np.pi))))
    var = s**2 + 1e-6
    assert math.isclose(both[1]["nll"], float(0.5 * np.mean(m**2 / var + np.log(var))))


@pytest.mark.parametrize("compat", [False, True])
def test_refinement_equals_a_loop(spark, compat):
    rng = np.random.default_rng(11)
    words = "the old house stood on a hill and fell down".split()
    starts, proposals = [], []
    for key in range(12):
        text = " ".join(rng.choice(words, 7))
        starts.append((key, text, " ".join(rng.choice(words, 6)), *map(float, rng.random(3))))
        for step in rng.permutation(20):
            if step != 4:
                proposals.append((key, int(step), " ".join(rng.choice(words, 6)), *map(float, rng.random(3))))
    s = spark.createDataFrame(starts, "input_id int, text string, current string, e1 double, e2 double, e3 double")
    p = spark.createDataFrame(proposals, "input_id int, step int, proposal string, e1 double, e2 double, e3 double").repartition(5)
    got = {r["input_id"]: (r["refined"], r["last_step"]) for r in rr.greedy_refine(s, p, steps=15, compat=compat).collect()}

    def energy(model, cand, against):
        e1, e2, e3 = model
        return e1 + 2 * e2 + 2 * e3 + levenshtein(cand, against) / max(len(against), 1) + 3 * copy_of(cand, against)

    for key, text, current, *model in starts:
        best, last = energy(model, current, current if compat else text), -1
        for _, step, cand, *m in sorted(x for x in proposals if x[0] == key and x[1] < 15):
            e = energy(m, cand, current if compat else text)
            if e < best:
                best, current, last = e, cand, step
        assert got[key] == (current, last)


def test_span_mask(spark):
    df = spark.createDataFrame([(0, "a b c d e f"), (3, "a b c d e f"), (9, "a b c d e f"), (1, "too few words")], "i int, text string")
    got = [r["masked"] for r in rr.span_mask(df, F.col("i")).orderBy("i").collect()]
    assert got == ["<extra_id_0> c d e f", "too few words", "a b c <extra_id_0> f", "a <extra_id_0> d e f"]


def test_vectors(spark):
    df = spark.createDataFrame([("a", [3.0, 4.0]), ("a", [0.0, 2.0]), ("b", [0.0, 0.0])], "author string, vector array<double>")
    c = {r["author"]: r["style_vector"] for r in vec.style_centroid(df).collect()}
    assert np.allclose(c["a"], [0.3, 0.9]) and np.allclose(c["b"], [0, 0])
    u = {r["author"]: r["style_vector"] for r in vec.user_style_vector(df).collect()}
    assert math.isclose(float(np.linalg.norm(u["a"])), 1.0)
    masked = vec.mean_pool(df.withColumn("real", F.get("vector", F.lit(0)) > 0), ["author"], keep="real").collect()
    assert [(r["author"], r["pooled"]) for r in masked] == [("a", [3.0, 4.0])]


def test_linear_head_recovers_a_line(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    w = np.array([[1.0, -2.0], [0.5, 0.0], [0.0, 3.0]])
    y = x @ w + np.array([0.25, -1.0]) + rng.normal(scale=0.1, size=(400, 2))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "features array<double>, target array<double>").repartition(7)
    head = fit.fit_linear_gaussian(df).orderBy("dim").collect()
    design = np.hstack([x, np.ones((400, 1))])
    exact, *_ = np.linalg.lstsq(design, y, rcond=None)
    assert np.allclose([h["weights"] for h in head], exact[:-1].T, atol=1e-6)
    assert np.allclose([h["bias"] for h in head], exact[-1], atol=1e-6)
    assert np.allclose([h["sigma"] for h in head], np.sqrt(((y - design @ exact) ** 2).mean(0)), atol=1e-6)
    mu = fit.apply_linear_gaussian(df, fit.fit_linear_gaussian(df)).select("mu", "target").collect()
    assert np.mean([np.abs(np.array(r["mu"]) - np.array(r["target"])).max() for r in mu]) < 0.3


def test_batches_are_full_and_padded(spark):
    df = spark.range(100).select("id", F.expr("transform(sequence(1, 1 + cast(id % 7 as int)), i -> cast(i as bigint))").alias("prefix_ids"))
    batched = fit.shuffle_batches(df, F.expr("(id * 1103515245 + 7) % 2147483648"), "id")
    sizes = {r["batch"]: r["count"] for r in batched.groupBy("batch").count().collect()}
    assert sizes == {**{i: 12 for i in range(8)}, 8: 4}
    for r in fit.pad_sequences(batched, row_id="id").groupBy("batch").agg(F.collect_set(F.size("prefix_ids")).alias("s")).collect():
        assert len(r["s"]) == 1
    assert batched.where("place = id").count() < 20


def test_registry_and_status(spark):
    styles = spark.createDataFrame([("poe", 1, 10), ("poe", 2, 20), ("bly", 1, 5)], "style_name string, ts bigint, v int")
    newest = rg.style_upsert(styles.where("ts = 1"), styles.where("ts = 2"))
    assert {(r["style_name"], r["v"]) for r in newest.collect()} == {("poe", 20), ("bly", 5)}
    requests = spark.createDataFrame(
        [(1, "poe", None, "x", None), (2, "bly", "B", "y", "Connection reset"), (3, "none", None, "z", None), (4, None, None, "t", None), (5, "poe", None, "", None), (6, "poe", None, "u", "boom")],
        "request_id int, style_name string, author_name string, original_text string, failure string",
    )
    got = {r["request_id"]: (r["status"], r["http_code"]) for r in rg.request_status(rg.request_defaults(requests), newest).collect()}
    assert got == {1: ("ok", 200), 2: ("no_connection", 503), 3: ("unknown_style", 400), 4: ("unknown_style", 400), 5: ("missing_text", 400), 6: ("failed", 500)}
    assert {r["request_id"] for r in rg.unknown_styles(rg.request_defaults(requests), newest).collect()} == {3, 4}


def test_prompts_carry_the_profile(spark):
    docs = spark.createDataFrame([("poe", 1, "Thou hath seen; thus it was painted. Truly, however, the ravens said nothing!")], "author string, seq bigint, text string")
    profile = style_profile(docs)
    cards = pm.style_card(profile)
    requests = spark.createDataFrame([(1, "poe", "Poe", "one two three"), (2, "nobody", "N", "x")], "request_id int, style_name string, author_name string, original_text string")
    by = {r["request_id"]: r for r in pm.style_prompt(requests, cards).collect()}
    prompt, p = by[1]["prompt"], profile.first()
    assert by[2]["prompt"] is None
    assert "HOW POE WRITES" in prompt and "3 to 4 words" in prompt and prompt.endswith("one two three")
    assert f"commas {p['comma_frequency']:.3f}" in prompt and "archaic words: hath, thou" in prompt and "semicolons" in prompt


def test_overlong_answers_get_a_note(spark):
    df = spark.createDataFrame([("a b", "1 2 3 4 5"), ("a b", "1 2 3 4 5 6")], "original_text string, answer string")
    got = pm.overlong_check(df).collect()
    assert [r["is_overlong"] for r in got] == [False, True]
    assert got[0]["styled"] == "1 2 3 4 5" and got[1]["styled"].startswith("[Note") and got[1]["styled"].endswith("1 2 3 4 5 6")


def test_stream_equals_batch(spark):
    texts = spark.range(200).select(F.concat(F.lit("s"), F.col("id") % 3).alias("style_name"), F.concat(F.lit("Well, text number "), "id", F.lit("! And so on.")).alias("text"))
    source, table = scratch_path(spark, "s"), scratch_path(spark, "t")
    texts.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.stream_profile_counters(stream, table, scratch_path(spark, "c")).awaitTermination()
    streamed = jobs.read_registry(spark, table, order=None)
    batch = jobs.running_counters(texts)
    assert sorted(streamed.select(batch.columns).collect()) == sorted(batch.collect())
    compacted = scratch_path(spark, "compact")
    jobs.compact_registry(spark, table, compacted, order=None)
    assert sorted(jobs.read_registry(spark, compacted, order=None).select(batch.columns).collect()) == sorted(batch.collect())


def test_newest_style_wins_whatever_the_batch(spark):
    table = scratch_path(spark, "log")
    spark.createDataFrame([("poe", 5, 1), ("bly", 1, 2)], "style_name string, ts bigint, x int").selectExpr("*", "1L log_time").write.parquet(f"{table}/log_stream=a/log_batch=0")
    spark.createDataFrame([("poe", 3, 3), ("bly", 1, 4)], "style_name string, ts bigint, x int").selectExpr("*", "2L log_time").write.parquet(f"{table}/log_stream=a/log_batch=1")
    got = {r["style_name"]: r["x"] for r in jobs.read_registry(spark, table).collect()}
    assert got == {"poe": 1, "bly": 4}


def test_unit_vector_is_unit(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0],)], "v array<float>")
    assert df.select(vx.norm(vx.unit(F.col("v")))).first()[0] == pytest.approx(1.0)


def test_order_columns_of_any_size(spark):
    """Row ids of many partitions and microseconds are orders too; texts without one come last."""
    from penprint.operators import grams

    texts = ["one fine morning came", "then came another morning", "fine words came later"]
    small = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)], "author string, seq bigint, text string")
    orders = {
        "row ids": small.repartition(20, "seq").withColumn("seq", F.col("seq") + F.lit(19 << 33)),
        "microseconds": small.withColumn("seq", F.col("seq") * 1_000_000 + 1_790_000_000_000_000),
        "negative": small.withColumn("seq", F.col("seq") - (1 << 62)),
        "last unknown": small.withColumn("seq", F.when(F.col("seq") < 2, F.col("seq"))),
    }
    kinds = [grams.CONTENT_WORDS, grams.TRIGRAMS, grams.CHAR_FOURGRAMS]

    def top(df):
        return sorted(map(tuple, grams.top_terms(grams.gram_counts(df, kinds), kinds).collect()))

    want = top(small)
    for name, df in orders.items():
        assert top(df) == want, name


def test_small_orders_are_counted_in_long_integers(spark):
    from penprint.operators import grams

    kinds = [grams.TRIGRAMS, grams.CHAR_TRIGRAMS]
    schema = "author string, seq bigint, text string"
    for seqs, kind in (([0, 2**31 - 1, None], "long"), ([0, 2**31], "decimal"), ([-1, 3], "decimal"), ([None], "long"), ([], "long")):
        df = spark.createDataFrame([("a", seq, "one two three four") for seq in seqs], schema)
        counts = grams.gram_counts(df, kinds)
        assert counts.schema["first"].dataType.typeName() == kind
        assert grams.vocabulary_with_first(df).schema["first"].dataType.typeName() == kind
        if None in seqs and len(seqs) > 1:
            lone = df.where("seq IS NULL")
            last = grams.vocabulary_with_first(df.where("seq > 0")).agg(F.max("first")).first()[0]
            assert grams.vocabulary_with_first(df.where("seq > 0").union(lone.withColumn("text", F.lit("new")))).where("term = 'new'").first()["first"] > last


def test_candidates_without_energy_lose(spark):
    schema = "input_id int, cand_id int, candidate string, copy_ratio double, energy double"
    rows = [(1, 1, "x", 0.1, None), (1, 2, "y", 0.2, 0.1), (2, 5, "z", 0.3, None)]
    df = spark.createDataFrame(rows, schema)
    assert {r["input_id"]: r["cand_id"] for r in rr.best_candidate(df).collect()} == {1: 2, 2: 5}
    terms = df.withColumns({"e1": F.col("energy"), "e2": F.lit(0.0), "e3": F.lit(0.0), "e4": F.lit(0.0)}).drop("energy")
    assert {r["input_id"]: r["cand_id"] for r in rr.select_rewrite(terms).collect()} == {1: 2, 2: 5}


def test_a_deviation_of_zero_has_a_density(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0], [0.0, 1.0])], "t array<double>, mu array<double>, sigma array<double>")
    got = df.select(vx.neg_log_density(F.col("t"), F.col("mu"), F.col("sigma"))).first()[0]
    want = (math.log(1e-6) + math.log(1.0) + math.log(2 * math.pi)) / 2
    assert abs(got - want) < 1e-9


def test_all_supplied_proposals_take_part(spark):
    starts = spark.createDataFrame([(1, "abc def", "abc xyz", 5.0, 0.0, 0.0)], "input_id int, text string, current string, e1 double, e2 double, e3 double")
    late = spark.createDataFrame([(1, 20, "uvw", 0.0, 0.0, 0.0)], "input_id int, step int, proposal string, e1 double, e2 double, e3 double")
    for compat in (False, True):
        assert rr.greedy_refine(starts, late, compat=compat).first()["refined"] == "uvw"
        assert rr.greedy_refine(starts, late, compat=compat, steps=15).first()["refined"] == "abc xyz"


def test_upsert_at_equal_times_takes_the_change(spark):
    schema = "style_name string, ts bigint, v int"
    old = spark.createDataFrame([("poe", 2, 9), ("bly", None, 1)], schema)
    new = spark.createDataFrame([("poe", 2, 3), ("poe", 2, 4), ("bly", 1, 2)], schema)
    assert {r["style_name"]: r["v"] for r in rg.style_upsert(old, new).collect()} == {"poe": 4, "bly": 2}


def test_two_checkpoints_keep_both_styles(spark):
    out = scratch_path(spark, "two")
    for name in ("poe", "bly"):
        path = scratch_path(spark, name)
        changes = spark.createDataFrame([(name, 1)], "style_name string, ts bigint")
        changes.write.parquet(path)
        stream = spark.readStream.schema(changes.schema).parquet(path)
        jobs.stream_registry_upsert(stream, out, scratch_path(spark, f"{name}-log")).awaitTermination()
    assert sorted(r["style_name"] for r in jobs.read_registry(spark, out).collect()) == ["bly", "poe"]


def test_fit_survives_a_large_offset(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2)) + 1e7
    y = x @ np.array([[0.5], [-2.0]]) + 3.0 + rng.normal(scale=0.01, size=(400, 1))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "features array<double>, target array<double>")
    head = fit.fit_linear_gaussian(df, ridge=0.0).first()
    assert np.allclose(head["weights"], [0.5, -2.0], atol=1e-2) and abs(head["sigma"] - 0.01) < 2e-3


def test_moving_text_is_compared_once_a_step(spark):
    starts = spark.createDataFrame([(1, "abc", "abd", 1.0, 0.0, 0.0), (2, None, None, 1.0, 0.0, 0.0)], "input_id long, text string, current string, e1 double, e2 double, e3 double")
    proposals = spark.createDataFrame([(1, 0, "abcd", 0.1, 0.0, 0.0), (1, 1, None, 0.0, 0.0, 0.0), (2, 0, "x", 0.0, 0.0, 0.0)], "input_id long, step int, proposal string, e1 double, e2 double, e3 double")
    refined = rr.greedy_refine(starts, proposals, compat=True)
    assert refined._jdf.queryExecution().optimizedPlan().toString().count("levenshtein(") == 1
    got = {r.input_id: (r.refined, r.last_step) for r in refined.collect()}
    assert got == {1: ("abcd", 0), 2: (None, -1)}
