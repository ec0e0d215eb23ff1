import numpy as np
import pytest
from pyspark.sql import functions as F

from penprint.operators import permute


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 12, 16, 17, 255, 256, 257, 1000, 65537])
def test_every_size_is_a_bijection(n):
    for seed in (0, 7):
        assert sorted(permute.permuted(np.arange(n), n, seed)) == list(range(n))


def test_places_look_random_and_follow_the_seed():
    n = 20_000
    a, b = (permute.permuted(np.arange(n), n, seed) for seed in (1, 2))
    assert (a != b).mean() > 0.99
    assert abs(np.corrcoef(np.arange(n), a)[0, 1]) < 0.03 and abs(np.corrcoef(a[:-1], a[1:])[0, 1]) < 0.03
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.03
    big = 2**40
    some = np.arange(0, big, big // 1000)
    assert len(set(permute.permuted(some, big, 3))) == len(some)


def test_batches_without_a_shuffle(spark):
    frame = spark.range(1003).withColumn("place0", F.lit(1)).repartition(7)
    out = permute.permuted_batches(frame, "id", 1003, 5, size=10)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the repartition above
    sizes = [r["count"] for r in out.groupBy("batch").count().orderBy("batch").collect()]
    assert sizes == [10] * 100 + [3]


def test_wrong_numbers_end_in_an_error(spark):
    with pytest.raises(Exception, match="numbers from 0"):
        permute.permuted_batches(spark.createDataFrame([(None,), (0,)], "id bigint"), "id", 2, 1).collect()
    with pytest.raises(ValueError):
        permute.half_bits(2**50)
