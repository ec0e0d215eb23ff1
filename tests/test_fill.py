import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from penprint.operators import fill as fl

TEXTS = [
    "the cat sat on the mat", "the dog sat on the log", "a cat ran to the dog", "The dog ran on a mat", "on the mat a cat sat",
    "", None, "  one ", "the cat saw the dog and the dog saw the cat",
]


class Plain:
    def __init__(self, texts):
        self.n = Counter()
        for t in texts:
            words = ["", *(t or "").lower().split(), ""]
            self.n.update(zip(words, words[1:]))
        self.seen, self.kinds, follows = Counter(), Counter(), Counter()
        for (a, b), n in self.n.items():
            self.seen[a] += n
            self.kinds[a] += 1
            follows[b] += 1
        self.alone = {b: k / len(self.n) for b, k in follows.items()}

    def p(self, a, b):
        if b not in self.alone:
            return fl.FLOOR
        if a not in self.seen:
            return self.alone[b]
        own = max(self.n[a, b] - fl.DISCOUNT, 0) / self.seen[a] if self.n[a, b] else 0
        return own + fl.DISCOUNT * self.kinds[a] / self.seen[a] * self.alone[b]

    def after(self, a, beam):
        return sorted((b for x, b in self.n if x == a and b), key=lambda b: (-self.p(a, b), b))[:beam]

    def fills(self, left, right, beam):
        ways = [
            (math.log(self.p(left, x)) + math.log(self.p(x, y)) + math.log(self.p(y, right)), x, y)
            for x in self.after(left, beam) for y in self.after(x, beam)
        ]
        return sorted(ways, key=lambda w: (-round(w[0], 9), w[1], w[2]))


@pytest.fixture(scope="module")
def model(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS], "text string").withColumn("word", F.lit("x")).repartition(3)
    return fl.kneser_ney(fl.bigram_counts(frame))


def test_probabilities_sum_to_one_and_equal_plain_python(spark, model):
    plain = Plain(TEXTS)
    words = sorted(plain.alone)
    rows = [(a, b) for a in [*plain.seen, "never"] for b in [*words, "unknown"]]
    got = {(r.a, r.b): r.p for r in fl.with_probability(spark.createDataFrame(rows, "a string, b string"), model, "a", "b", "p").collect()}
    sums = defaultdict(float)
    for (a, b), p in got.items():
        assert math.isclose(p, plain.p(a, b), rel_tol=1e-12)
        sums[a] += p if b in plain.alone else 0
    assert all(math.isclose(total, 1) for total in sums.values())


@pytest.mark.parametrize("beam", [2, 8])
def test_fills_are_the_best_of_all_ways(spark, model, beam):
    plain = Plain(TEXTS)
    rows = [
        (1, "the cat <extra_id_0> the mat"), (2, "<extra_id_0> sat"), (3, "The dog <extra_id_0>"), (4, "no sentinel here"),
        (5, "unheard <extra_id_0> x"), (6, "a <extra_id_0> unheard"), (7, None), (8, "the <extra_id_0> on <extra_id_0> end"),
    ]
    frame = spark.createDataFrame(rows, "id int, masked string")
    got = defaultdict(list)
    for r in fl.fill_spans(frame, model, ["id"], best=3, beam=beam).orderBy("id", "step").collect():
        got[r.id].append(r)
    sides = {1: ("cat", "the"), 2: ("", "sat"), 3: ("dog", ""), 6: ("a", "unheard"), 8: ("the", "on")}
    assert got.keys() == sides.keys()
    for i, (left, right) in sides.items():
        want = plain.fills(left, right, beam)[:3]
        assert [(r.step, r.fill) for r in got[i]] == [(s, f"{x} {y}") for s, (_, x, y) in enumerate(want)]
        assert all(math.isclose(r.score, w[0], rel_tol=1e-9) for r, w in zip(got[i], want))
        assert got[i][0].proposal == dict(rows)[i].replace("<extra_id_0>", got[i][0].fill, 1)


def test_empty(spark):
    none = spark.createDataFrame([], "text string")
    model = fl.kneser_ney(fl.bigram_counts(none))
    assert fl.fill_spans(spark.createDataFrame([(1, "a <extra_id_0> b")], "id int, masked string"), model, ["id"]).collect() == []
