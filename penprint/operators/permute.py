"""Batches in random order without a sort: a keyed permutation of row numbers.

A Feistel network permutes all numbers of ``2 * half`` bits; a number that comes out at ``n`` or above goes through it
again until it falls below (cycle walking), which permutes the numbers below ``n`` alone. Each row's place follows
from its own number, so nothing moves, and another seed gives another order at no cost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.operators.fit import BATCH

ROUNDS, KEY_BITS, MIXER = 4, 24, 2_654_435_761


def round_keys(seed: int) -> list[int]:
    """A key of ``KEY_BITS`` bits for every round."""
    return [int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:4], "big") >> (32 - KEY_BITS) for i in range(ROUNDS)]


def half_bits(n: int) -> int:
    """Bits of either half of the numbers that are permuted, at most four times as many as ``n``."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    if half > KEY_BITS:
        raise ValueError(f"at most {2 ** (2 * KEY_BITS)} rows")
    return half


def permuted(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The places of distinct numbers from 0 to ``n - 1``."""
    half, mask = half_bits(n), (1 << half_bits(n)) - 1
    out = numbers.astype(np.int64).copy()
    if len(out) and (out.min() < 0 or out.max() >= n):
        raise ValueError(f"numbers from 0 to {n - 1} are needed")
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for key in round_keys(seed):
            left, right = right, left ^ ((((right + (key & mask)) * MIXER) & 0xFFFFFFFF) >> (32 - half))
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out


def permuted_place(number: Column, n: int, seed: int) -> Column:
    @F.pandas_udf("bigint")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permuted(numbers.to_numpy(), n, seed))

    return place(number)


def permuted_batches(df: DataFrame, number: str, n: int, seed: int, size: int = BATCH) -> DataFrame:
    """Adds ``place`` and ``batch``: all ``n`` rows, numbered from 0 in ``number``, dealt to full batches in random order.

    Numbers that are null or outside of 0 to ``n - 1`` end the job with an error.
    """
    place = permuted_place(F.coalesce(F.col(number).cast("bigint"), F.lit(-1)), n, seed)
    return df.withColumn("place", place).withColumn("batch", F.expr(f"place div {size}"))
