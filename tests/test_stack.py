"""Stacks against exact arithmetic."""

import random
from fractions import Fraction

from tessera.operators import stack

# a value of each stack is exactly two deviations from the mean, and the median depends on it
ON_THE_LIMIT = [
    [2, 14, 26, 29, 33, 40, 43, 46, 49],
    [1, 2, 10, 22, 26, 27, 29, 30, 33, 34, 35, 35, 36, 37, 43, 48],
    [1, 2, 6, 17, 18, 20, 20, 22, 24, 25, 27, 28, 29, 30, 33, 35, 37, 38, 39, 39, 43, 44, 45, 50],
]


def clipped(values):
    mean = Fraction(sum(values), len(values))
    variance = sum((v - mean) ** 2 for v in values) / len(values)
    kept = sorted(v for v in values if len(values) <= 3 or (v - mean) ** 2 <= 4 * variance)
    assert len(values) <= 3 or any((v - mean) ** 2 == 4 * variance for v in values)
    return float(kept[len(kept) // 2])


def test_limits_belong_to_the_inside_in_any_order(spark):
    rng, rows, want = random.Random(3), [], {}
    for values in [*ON_THE_LIMIT, [7, 7, 7, 7, 9], [5, 5, 5, 5], [1, 9, 50], [4]]:
        for _ in range(40):
            k = len(want)
            want[k] = clipped(values)
            rows += [(k, float(v)) for v in rng.sample(values, len(values))]
    rng.shuffle(rows)
    got = stack.sigma_clipped_median(spark.createDataFrame([*rows, (0, None)], "k int, v double").repartition(8), ["k"], "v")
    assert {r.k: r.median for r in got.collect()} == want


def test_equal_values_that_are_not_whole_stay(spark):
    rows = [(n, 0.1) for n in range(1, 30) for _ in range(n)]
    got = stack.sigma_clipped_median(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()
    assert {(r.k, r.median) for r in got} == {(n, 0.1) for n in range(1, 30)}
