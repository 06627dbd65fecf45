"""Scalar functions of the model as Spark columns, and the Java random numbers its sampling needs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def coalescent_cdf(morgans: Column, ne: float) -> Column:
    """Probability that a shared segment ends within ``morgans`` of its focus."""
    return 1 - 1 / (2 * F.lit(float(ne)) * F.expm1(2 * morgans) + 1)


def coalescent_quantile(p: Column, ne: float) -> Column:
    d = 2 * F.lit(float(ne)) * (1 - p)
    return 0.5 * F.log((p + d) / d)


def recombination(rate: float, distance: Column) -> Column:
    return -F.expm1(-F.lit(float(rate)) * distance)


def half_up(x: Column) -> Column:
    """Rounds to the nearest whole number, halves upward."""
    return F.floor(x + 0.5)


def genotype_count(n_alleles: Column) -> Column:
    return F.floor(n_alleles * (n_alleles + 1) / 2)


def min_mac(min_maf: float, n_haps: int) -> int:
    """Least minor allele count, from the next smaller 32-bit fraction."""
    below = np.nextafter(np.float32(min_maf), np.float32(-1))
    return int(np.ceil(np.float32(below * np.float32(n_haps))))


class JavaRandom:
    """The linear congruential generator of java.util.Random."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def bits(self, n: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return self.state >> (48 - n)

    def many_bits(self, count: int) -> np.ndarray:
        """``count`` draws of 31 bits at once: states are a power series in the multiplier, modulo 2^48."""
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(count, 0x5DEECE66D, np.uint64))
            plus = np.uint64(0xB) * np.cumsum(np.append(np.uint64(1), power[:-1]))
            states = (power * np.uint64(self.state) + plus) & np.uint64((1 << 48) - 1)
        self.state = int(states[-1])
        return (states >> np.uint64(17)).astype(np.int64)

    def distinct_pairs(self, bound: int, count: int) -> np.ndarray:
        """``count`` pairs of numbers below ``bound``, the second drawn again while it equals the first."""
        out, held = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        while len(out) < count:
            drawn = self.many_bits(2 * (count - len(out)) + 64)
            if bound & -bound == bound:
                value = (bound * drawn) >> 31
            else:
                value = drawn % bound
                value = value[drawn - value + (bound - 1) < 1 << 31]
            held = np.concatenate((held, value))
            while len(held) > 1:
                pairs = held[: len(held) // 2 * 2].reshape(-1, 2)
                same = np.flatnonzero(pairs[:, 0] == pairs[:, 1])
                good = pairs[: same[0]] if len(same) else pairs
                out, held = np.concatenate((out, good)), held[2 * len(good) :]
                if len(same):  # the first number stays, the second is left out
                    held = np.delete(held, 1)
        return out[:count]

    def next_double(self) -> float:
        return ((self.bits(26) << 27) + self.bits(27)) / (1 << 53)

    def next_int(self, bound: int) -> int:
        if bound & -bound == bound:
            return (bound * self.bits(31)) >> 31
        while True:
            drawn = self.bits(31)
            value = drawn % bound
            if drawn - value + (bound - 1) < 1 << 31:
                return value
