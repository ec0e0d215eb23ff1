"""Minimax contiguous partition of ordered atomic groups into shards of near equal bytes.

Equal texts form one group and stay together. Groups come in this order: those of more than a
1/HEAVY_SHARE of a shard by falling size, at most shards * HEAVY_SHARE of them, so that a group as
large as a shard does not unbalance what lies on either side of it; then all others by a 64-bit hash
of their text. The smallest capacity that a greedy left-to-right fill can meet is found by binary search, over sums
per hash range; ranges in which a cut may fall are split further until the answer is exact. The
driver holds at most ``2**FIRST_BITS`` sums plus some hundred split ranges per shard, whatever the
number of groups.

Defined results: a null text counts as the empty text (size 8, checksum 0), null or repeated
``doc_id`` values are rows like any others, equal rows get adjoining slots, an empty table gives an
empty table, and further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penprint.llm.common import saved, table, text_or_empty

SHARDS = 24
FIRST_BITS, STEP_BITS = 16, 6
ROWS_PER_BUCKET = 200_000
LEAST_BUCKETS = 64
HEAVY_SHARE = 64


class Ranges:
    """Sums of sizes over hash ranges in order; ``whole`` marks ranges that hold a single group."""

    def __init__(self, shift: np.ndarray, prefix: np.ndarray, total: np.ndarray, whole: np.ndarray):
        order = np.argsort(prefix << shift, kind="stable")
        self.shift, self.prefix, self.total, self.whole = (x[order] for x in (shift, prefix, total, whole))
        self.ends = np.cumsum(self.total)
        self.starts = self.ends - self.total

    def low(self) -> np.ndarray:
        return self.prefix << self.shift

    def fill(self, capacity: int, shards: int, divisible: bool, back: bool = False) -> list[int]:
        """Ends of greedily filled shards. ``divisible``: ranges of several groups may be cut anywhere."""
        ends, starts, whole = self.ends, self.starts, self.whole
        if back:
            all_of = ends[-1]
            ends, starts, whole = (all_of - self.starts)[::-1], (all_of - self.ends)[::-1], whole[::-1]
        at, cuts = 0, []
        for _ in range(shards):
            limit = at + capacity
            i = int(np.searchsorted(ends, limit, side="right"))  # first range not wholly inside
            reached = int(ends[i - 1]) if i else 0
            if i < len(ends) and divisible and not whole[i]:
                reached = max(reached, min(limit, int(ends[i])))
            at = max(at, reached)
            cuts.append(at)
        return cuts

    def least(self, shards: int, divisible: bool) -> int:
        """The smallest capacity with which the shards hold everything."""
        total = int(self.ends[-1])
        low, high = -(-total // shards), total
        while low < high:
            middle = (low + high) // 2
            if self.fill(middle, shards, divisible)[-1] >= total:
                high = middle
            else:
                low = middle + 1
        return low

    def unsure(self, low: int, high: int, shards: int) -> np.ndarray:
        """Ranges of several groups in which a cut may fall for a capacity from low to high."""
        found = np.zeros(len(self.total), bool)
        for a, b in zip(self.fill(low, shards, False), self.fill(high, shards, True), strict=True):
            found |= (self.starts <= b) & (self.ends > a)
        return found & ~self.whole

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """Lowest hash of shards 1, 2, ...: as even as the capacity allows."""
        total, at, keys = int(self.ends[-1]), 0, []
        back = [0, *self.fill(capacity, shards, False, back=True)]
        places = np.concatenate([[0], self.ends])
        for k in range(shards - 1):
            left = shards - k
            least, most = total - back[left - 1], at + capacity
            aim = at + (total - at) / left
            i = int(np.searchsorted(places, aim))
            near = [int(places[j]) for j in (i - 1, i) if 0 <= j < len(places)]
            near = [p for p in near if least <= p <= most]
            if near:
                at = max(at, min(near, key=lambda p: abs(p - aim)))
            else:
                allowed = places[(places >= least) & (places <= most)]
                at = max(at, int(allowed[np.argmin(np.abs(allowed - aim))]))
            i = int(np.searchsorted(self.starts, at))
            keys.append(int(self.low()[i]) if i < len(self.starts) else None)
        return keys


def _ranges(rows: DataFrame, shift: int) -> tuple[np.ndarray, ...]:
    found = (
        rows.groupBy(F.shiftright("group", shift).alias("prefix"))
        .agg(F.sum("size").alias("total"), (F.min("group") == F.max("group")).alias("whole"))
        .collect()
    )
    prefix = np.array([r["prefix"] for r in found], np.int64)
    return (
        np.full(len(found), shift, np.int64),
        prefix,
        np.array([r["total"] for r in found], np.int64),
        np.array([r["whole"] for r in found], bool),
    )


def minimax_cuts(rows: DataFrame, shards: int) -> list[int | None]:
    """First ``group`` value of shards 1 to ``shards - 1`` for rows of ``group`` and ``size``."""
    known = _ranges(rows, 64 - FIRST_BITS)
    if not len(known[0]):
        return [None] * (shards - 1)
    while True:
        ranges = Ranges(*known)
        low, high = ranges.least(shards, True), ranges.least(shards, False)
        unsure = ranges.unsure(low, high, shards)
        if low == high or not unsure.any():
            return ranges.cuts(high, shards)
        parts = [tuple(x[~unsure] for x in (ranges.shift, ranges.prefix, ranges.total, ranges.whole))]
        for shift in np.unique(ranges.shift[unsure]):
            these = [int(p) for p in ranges.prefix[unsure & (ranges.shift == shift)]]
            inside = rows.where(F.shiftright("group", int(shift)).isin(these))
            parts.append(_ranges(inside, max(0, int(shift) - STEP_BITS)))
        known = tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _heavy_first(rows: DataFrame, shards: int) -> DataFrame:
    """``group`` becomes the place in the order: heavy groups from the lowest number on, then hashes."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    heavy = (
        rows.groupBy("group")
        .agg(F.sum("size").alias("bytes"))
        .where(F.col("bytes") * shards * HEAVY_SHARE > total)
        .orderBy(F.desc("bytes"), "group")
        .collect()
    )
    ranks = rows.sparkSession.createDataFrame(
        [(r["group"], -(2**63) + i) for i, r in enumerate(heavy)], "heavy bigint, rank bigint"
    )
    return rows.join(F.broadcast(ranks), F.col("group") == F.col("heavy"), "left").withColumn(
        "group", F.coalesce("rank", F.shiftright("group", 1))
    ).drop("heavy", "rank")


def assign(docs: DataFrame, size: Column, group: Column, shards: int = SHARDS, extra: dict | None = None) -> DataFrame:
    """``doc_id, size, shard, slot`` and the ``extra`` columns; rows with equal ``group`` stay together.

    Slots run from 0 in every shard. They are counted per bucket of a hash of the id, so that neither
    a shard nor a large group has to pass through one task.
    """
    rows = saved(
        docs.select(
            "doc_id",
            size.cast("bigint").alias("size"),
            F.xxhash64(group).alias("group"),
            *[value.alias(name) for name, value in (extra or {}).items()],
        ),
        "shard-rows",
    )
    rows = _heavy_first(rows, shards)
    cuts = [c for c in minimax_cuts(rows, shards) if c is not None]
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("group") >= F.lit(cut)).cast("int")
    buckets = max(LEAST_BUCKETS, rows.count() // ROWS_PER_BUCKET)
    placed = rows.select(
        "*",
        shard.cast("int").alias("shard"),
        F.pmod(F.xxhash64("doc_id", "group"), F.lit(buckets)).alias("bucket"),
    )
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        placed.groupBy("shard", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    )
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "group")
    return (
        placed.withColumn("place", F.row_number().over(within))
        .join(first, ["shard", "bucket"])
        .select(
            "doc_id",
            "size",
            *(extra or {}),
            "shard",
            (F.col("first") + F.col("place") - 1).cast("bigint").alias("slot"),
        )
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = text_or_empty()
    placed = assign(
        docs, F.octet_length(text) + 8, text, extra={"text_crc32": F.crc32(text.cast("binary")).cast("bigint")}
    )
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
