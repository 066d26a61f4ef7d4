"""Seeded draws that must agree everywhere: the 64-bit Mersenne Twister, bounded integers, shuffles, hash uniforms.

These are sequential by nature and small; tables are made from their results.  The hash uniforms are
vectorised over uint64 and run in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: The hash starts one digit short of the usual offset basis; results depend on it.
HASH_START, HASH_PRIME = 1469598103934665603, 1099511628211


class Twister:
    """The published 64-bit generator mt19937-64."""

    N, M, A = 312, 156, 0xB5026F5AA96619E9
    UPPER, LOWER = 0xFFFFFFFF80000000, 0x7FFFFFFF

    def __init__(self, seed: int = 5489):
        self.state = [seed & MASK]
        for i in range(1, self.N):
            prev = self.state[-1]
            self.state.append((6364136223846793005 * (prev ^ (prev >> 62)) + i) & MASK)
        self.at = self.N

    def _refill(self) -> None:
        s, n, m = self.state, self.N, self.M
        for i in range(n):
            x = (s[i] & self.UPPER) | (s[(i + 1) % n] & self.LOWER)
            s[i] = s[(i + m) % n] ^ (x >> 1) ^ (self.A if x & 1 else 0)
        self.at = 0

    def __call__(self) -> int:
        if self.at == self.N:
            self._refill()
        x = self.state[self.at]
        self.at += 1
        x ^= (x >> 29) & 0x5555555555555555
        x ^= (x << 17) & 0x71D67FFFEDA60000
        x ^= (x << 37) & 0xFFF7EEE000000000
        return x ^ (x >> 43)

    def below(self, n: int) -> int:
        """An unbiased integer below n: draws from the odd first stretch are refused."""
        if n <= 0:
            raise ValueError("below: n must be positive")
        odd = (1 << 64) % n
        while (x := self()) < odd:
            pass
        return x % n


def shuffle(n: int, seed: int, first: int | None = None) -> list[int]:
    """A seeded shuffle of 0..n-1, swapping from the last place to the second (its first positions, if `first` is given)."""
    rng, a = Twister(seed), list(range(n))
    for i in range(n - 1, 0, -1):
        j = rng.below(i + 1)
        a[i], a[j] = a[j], a[i]
    return a[:first]


def split(spark: SparkSession, n: int, tests: int, seed: int) -> DataFrame:
    """(query_id, split): the first `tests` positions of the shuffle are 'test', all others 'train'."""
    if not 0 < tests < n:
        raise ValueError("split: there must be queries on both sides")
    chosen = set(shuffle(n, seed, tests))
    return spark.createDataFrame([(i, "test" if i in chosen else "train") for i in range(n)], "query_id bigint, split string")


def text_hash(text: str) -> int:
    h = HASH_START
    for b in text.encode():
        h = ((h ^ b) * HASH_PRIME) & MASK
    return h


def scramble(x: int) -> int:
    """splitmix64."""
    return int(_scramble(np.array([x & MASK], np.uint64))[0])


def _scramble(x: np.ndarray) -> np.ndarray:
    z = x + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def uniforms(set_id: str, rows: Iterable[int], seed: int) -> np.ndarray:
    """A number in [0, 1) for each row, from a hash of "set:row" and the seed."""
    h = np.fromiter((text_hash(f"{set_id}:{int(r)}") for r in rows), np.uint64)
    return _scramble(h ^ np.uint64(seed)).astype(np.float64) / 2.0**64


def uniform(row: Column, set_id: str, seed: int) -> Column:
    """The same as a column, in Arrow batches."""

    @F.pandas_udf("double")
    def draw(rows: pd.Series) -> pd.Series:
        return pd.Series(uniforms(set_id, rows, seed))

    return draw(row)
