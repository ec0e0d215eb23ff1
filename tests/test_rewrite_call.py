import random

from pyspark.sql import functions as F

from penprint.operators import rerank as rr


def rows(seed=1):
    rng = random.Random(seed)
    out = []
    for key in [*range(40), None]:
        for cand in range(rng.randrange(1, 6)):
            terms = [None if rng.random() < 0.1 else rng.randrange(8) / 4 for _ in range(4)]
            out.append((key, cand if rng.random() < 0.8 else None, cand if rng.random() < 0.7 else None, f"text {key} {cand}", *terms, rng.choice([0.2, 0.84, 0.85, 1.0])))
    return out


def energy(r):
    w = rr.Weights()
    return None if None in r[4:8] else w.e1 * r[4] + w.e2 * r[5] + w.e3 * r[6] + w.e4 * r[7] + w.copy_ratio * r[8]


def plain(table, steps=None):
    out = {}
    for key in {r[0] for r in table}:
        mine = [(r, energy(r)) for r in table if r[0] == key]
        candidates = [(r, e) for r, e in mine if r[1] is not None]
        if not candidates:
            continue
        first, e = min(candidates, key=lambda x: (x[0][8] >= 0.85, x[1] is None, x[1] or 0, x[0][1]))
        best = (first[3], e, first[3], -1)
        proposals = [(r, e) for r, e in mine if r[2] is not None and e is not None and (steps is None or r[2] < steps)]
        if proposals:
            p, pe = min(proposals, key=lambda x: (x[1], x[0][2]))
            if e is None or pe < e:
                best = (p[3], pe, first[3], p[2])
        out[key] = best
    return out


def test_one_call_against_plain_python(spark):
    schema = "input_id int, cand_id int, step int, candidate string, e1 double, e2 double, e3 double, e4 double, copy_ratio double"
    for seed in range(4):
        frame = spark.createDataFrame(rows(seed), schema).withColumns({c: F.lit(1) for c in ("c", "p", "text")}).repartition(3)
        for steps in (None, 2):
            got = {r.input_id: tuple(r)[1:] for r in rr.rewrite_in_style(frame, steps=steps).collect()}
            want = plain(rows(seed), steps)
            assert got.keys() == want.keys()
            for key, (text, e, chosen, step) in want.items():
                assert (got[key][0], got[key][2], got[key][3]) == (text, chosen, step), key
                assert (got[key][1] is None) == (e is None) and (e is None or abs(got[key][1] - e) < 1e-9)


def test_one_shuffle_and_empty(spark):
    frame = spark.createDataFrame([], "input_id int, cand_id int, step int, candidate string, e1 double, e2 double, e3 double, e4 double, copy_ratio double")
    out = rr.rewrite_in_style(frame)
    assert out.collect() == []
    plan = rr.rewrite_in_style(spark.range(9).selectExpr("id % 3 AS input_id", "id AS cand_id", "id AS step", "'x' AS candidate", *(f"1D AS {t}" for t in rr.TERMS)))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
