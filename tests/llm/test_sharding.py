import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from penprint.llm import sharding


def least_capacity(sizes, shards):
    """Brute force over all cuts."""
    ends = [0, *np.cumsum(sizes)]
    places = range(1, len(sizes))
    best = ends[-1]
    for n in range(min(shards, len(sizes))):
        for cut in combinations(places, n):
            at = [0, *cut, len(sizes)]
            best = min(best, max(ends[b] - ends[a] for a, b in zip(at, at[1:], strict=False)))
    return best


def test_smallest_capacity_against_all_cuts(spark):
    rng = random.Random(2)
    for _ in range(4):
        sizes = [rng.choice([1, 5, 30, 200]) for _ in range(9)]
        rows = spark.createDataFrame([(int(i - 4) << 59, s) for i, s in enumerate(sizes)], "group bigint, size bigint")
        cuts = sharding.minimax_cuts(rows, 4)
        keys = [int(i - 4) << 59 for i in range(9)]
        shard = [sum(k >= c for c in cuts if c is not None) for k in keys]
        sums = [sum(s for s, x in zip(sizes, shard, strict=True) if x == j) for j in range(4)]
        assert max(sums) == least_capacity(sizes, 4)


@pytest.mark.parametrize("first_bits", [2, 16])
def test_ranges_are_split_until_the_answer_is_exact(spark, monkeypatch, first_bits):
    monkeypatch.setattr(sharding, "FIRST_BITS", first_bits)
    rng = random.Random(7)
    keys = sorted(rng.sample(range(-(2**63), 2**63, 2**20), 400))
    sizes = [rng.randrange(1, 100) for _ in keys]
    rows = spark.createDataFrame(list(zip(keys, sizes, strict=True)), "group bigint, size bigint")
    cuts = sharding.minimax_cuts(rows, 6)
    sums = [0] * 6
    for k, s in zip(keys, sizes, strict=True):
        sums[sum(k >= c for c in cuts)] += s

    def fits(capacity):
        shards, filled = 1, 0
        for s in sizes:
            if filled + s > capacity:
                shards, filled = shards + 1, 0
            filled += s
        return shards <= 6

    assert max(sums) == next(c for c in range(max(sizes), sum(sizes)) if fits(c))


def test_groups_stay_together_and_slots_have_no_gaps(spark, edge_docs, edge_rows, no_docs):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot text " * 40] * 3 + [f"t{rng.randrange(900)} " * rng.randrange(1, 60)])) for i in range(2000)]
    rows += [(r[0], r[1]) for r in edge_rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("shard", F.lit(99))
    text = F.coalesce("text", F.lit(""))
    found = sharding.assign(docs, F.octet_length(text) + 8, text, extra={"crc": F.crc32(text.cast("binary")).cast("bigint")}).collect()
    assert sorted(((r.doc_id, r.size, r.crc) for r in found), key=repr) == sorted(
        ((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows), key=repr
    )
    for shard in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))
    crc_shards = {}
    for r in found:
        crc_shards.setdefault((r.crc, r.size), set()).add(r.shard)
    assert all(len(s) == 1 for s in crc_shards.values())
    assert sharding.assign(no_docs, F.lit(8), F.lit("")).count() == 0
