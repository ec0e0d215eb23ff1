import random

from pyspark.sql import functions as F

from penprint.plans.keys import explode, first_k, join_on, running_totals


def test_running_totals_match_a_loop(spark):
    rng = random.Random(3)
    # One author owns most rows; one author is null; order values are far apart.
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), s, rng.randint(0, 9)) for s in rng.sample(range(10**7), 400)]
    df = spark.createDataFrame(rows, "a string, s bigint, v int").repartition(6)
    for bits in (3, 14, 20):
        got = {(r["a"], r["s"]): r["t"] for r in running_totals(df, "a", "s", {"t": "v"}, block_bits=bits).collect()}
        want, sums = {}, {}
        for a, s, v in sorted(rows, key=lambda r: r[1]):
            want[a, s] = sums.get(a, 0)
            sums[a] = sums.get(a, 0) + v
        assert got == want


def test_running_totals_keep_rows_without_or_with_equal_order(spark):
    rows = [("a", 5, 1), ("a", None, 2), ("a", 5, 4), ("a", -3, 8), ("a", 1 << 60, 16), ("a", None, 32)]
    df = spark.createDataFrame(rows, "a string, s bigint, v int")
    got = sorted((r["t"], r["v"]) for r in running_totals(df, "a", "s", {"t": "v"}, ties=["v"]).collect())
    assert got == [(0, 8), (8, 1), (9, 4), (13, 16), (29, 2), (31, 32)]


def test_join_on_lets_null_keys_meet(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 3)], "k string, b int")
    assert sorted(map(str, join_on(a, b, ["k"], "left").collect())) == sorted(
        ["Row(k=None, a=1, b=3)", "Row(k='x', a=2, b=None)"]
    )


def test_first_k_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), "id")
    top = first_k(df, ["g"], [F.col("id").desc()], 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["g"], r["rank"], r["id"]) for r in top.collect()) == [(0, 1, 998), (0, 2, 996), (0, 3, 994), (1, 1, 999), (1, 2, 997), (1, 3, 995)]


def test_explode_drops_empty_arrays(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "i int, xs array<string>")
    assert [tuple(r) for r in explode(df, ["i"], "xs", "x", "p").collect()] == [(1, 0, "a"), (1, 1, "b")]
