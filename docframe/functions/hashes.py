"""Average hashes, bit distances and frame scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often and deep in lambdas it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def average_hash(pixels: Column) -> Column:
    """One bit a pixel, the first highest: whether it is at least the mean; a signed 64-bit word."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x) / F.size(pixels)
    bits = lambda m: F.aggregate(pixels, F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x >= m, 1).otherwise(0).cast("bigint")))
    return _once(mean, bits)


def brightness(pixels: Column) -> Column:
    """Mean of grey pixels (0 to 255) in per cent."""
    return F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x) / F.size(pixels) * 100.0 / 255.0


def entropy(pixels: Column) -> Column:
    """Bits a pixel of the histogram."""
    share = lambda v: F.size(F.filter(pixels, lambda x: x == v)) / F.size(pixels)
    return F.aggregate(F.transform(F.array_distinct(pixels), share), F.lit(0.0), lambda a, p: a - p * F.log2(p))


def sharpness(pixels: Column, width: int) -> Column:
    """Variance of an image's edges: each inner pixel times 9 less its 3 x 3 neighbourhood, within 0 to 255; the rim as it is."""
    at = lambda i: F.get(pixels, i)
    near = lambda i: sum((at(i + dy * width + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)), F.lit(0))
    n = F.size(pixels)
    rim = lambda i: (i < width) | (i >= n - width) | (i % width).isin(0, width - 1)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(rim(i), at(i)).otherwise(F.least(F.greatest(at(i) * 9 - near(i), F.lit(0)), F.lit(255))).cast("double"))
    total = lambda e, f: F.aggregate(e, F.lit(0.0), lambda a, x: a + f(x))
    variance = lambda e: total(e, lambda x: x * x) / n - F.pow(total(e, lambda x: x) / n, 2)
    return _once(edges, variance)


def bit_distance(a: Column, b: Column) -> Column:
    """Differing bits; 64 where one is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64))


def usable_frame(brightness: Column, entropy: Column, sharpness: Column) -> Column:
    return brightness.between(8.0, 95.0) & (entropy >= 0.3) & (sharpness >= 2.0)


def selection_score(brightness: Column, entropy: Column, sharpness: Column, difference: Column, reason: Column) -> Column:
    part = lambda x, most: F.least(x / most, F.lit(1.0))
    bonus = F.when(reason == "scene_change", 0.2).otherwise(0.0)
    return part(entropy, 8.0) * 0.25 + part(sharpness, 600.0) * 0.2 + part(difference, 32.0) * 0.45 + bonus - F.abs(brightness - 52.0) / 52.0 * 0.1
