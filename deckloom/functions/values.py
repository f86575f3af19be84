"""Numeric, colour and geometry expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EMU_PER_POINT = 12700


def clamp(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(high, value))


def clamp01(value: Column) -> Column:
    return clamp(value, 0.0, 1.0)


def round_up(value: Column, places: int) -> Column:
    """Round half up on the scaled value, floor(v * 10^p + 0.5) / 10^p."""
    factor = float(10**places)
    return F.floor(value * factor + 0.5) / F.lit(factor)


def emu_to_pt(emu: Column) -> Column:
    return F.round(emu / F.lit(EMU_PER_POINT), 4)


def pt_to_emu(pt: Column) -> Column:
    return F.bround(pt * F.lit(EMU_PER_POINT)).cast("bigint")


def normalize_hex(value: Column) -> Column:
    """``#abc`` or ``abcdef`` to ``#AABBCC``; anything else to null."""
    digits = F.upper(F.regexp_replace(F.trim(value), r"^#+", ""))
    full = F.when(F.length(digits) == 3, F.regexp_replace(digits, r"(.)", "$1$1")).otherwise(digits)
    return F.when(full.rlike(r"^[0-9A-F]{6}$"), F.concat(F.lit("#"), full))


def valid_hex(value: Column) -> Column:
    """Whether ``normalize_hex`` has a result, by a single match."""
    return value.rlike(r"^ *#*(?:[0-9A-Fa-f]{3}){1,2} *$")


def channel(hex_color: Column, index: int) -> Column:
    """Red (0), green (1) or blue (2) of ``#RRGGBB`` as bigint."""
    return F.conv(F.substring(hex_color, 2 + 2 * index, 2), 16, 10).cast("bigint")


def color_distance(a: list[Column], b: list[Column]) -> Column:
    """Euclidean distance of two RGB triples."""
    return F.sqrt(reduce(lambda s, t: s + t, [(x - y) * (x - y) for x, y in zip(a, b)]).cast("double"))


def color_distance_max(a: list[Column], b: list[Column]) -> Column:
    return F.greatest(*[F.abs(x - y) for x, y in zip(a, b)])


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Integer luma with the usual 299/587/114 weights, rounded to nearest."""
    return F.floor((r * 299 + g * 587 + b * 114 + 500) / 1000)


def hamming_hex(left: Column, right: Column) -> Column:
    """Bit distance of two 16-digit hex hashes, by 32-bit halves; a missing hash is 64 away."""

    def half(h: Column, start: int) -> Column:
        return F.conv(F.substring(h, start, 8), 16, 10).cast("bigint")

    distance = F.bit_count(half(left, 1).bitwiseXOR(half(right, 1))) + F.bit_count(
        half(left, 9).bitwiseXOR(half(right, 9))
    )
    missing = left.isNull() | right.isNull() | (left == "") | (right == "")
    return F.when(missing, F.lit(64)).otherwise(distance)


def intersection_area(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    wide = F.greatest(F.lit(0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    high = F.greatest(F.lit(0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    return wide * high


def bbox_iou(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Intersection over union of corner boxes: both missing 1, one missing 0."""
    inter = F.greatest(F.lit(0), F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(
        F.lit(0), F.least(ay1, by1) - F.greatest(ay0, by0)
    )
    union = (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - inter
    return (
        F.when(ax0.isNull() & bx0.isNull(), F.lit(1.0))
        .when(ax0.isNull() | bx0.isNull(), F.lit(0.0))
        .when(union == 0, F.lit(1.0))
        .otherwise(inter / union)
    )


def rotated_extent(width: Column, height: Column, degrees: Column) -> tuple[Column, Column]:
    """Width and height of the axis-aligned box around a rotated rectangle."""
    cos, sin = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    return (
        F.when(degrees == 0, width.cast("double")).otherwise(width * cos + height * sin),
        F.when(degrees == 0, height.cast("double")).otherwise(width * sin + height * cos),
    )


def ratio_similarity(a: Column, b: Column) -> Column:
    """One minus the relative difference, never below zero."""
    scale = F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(a - b) / scale)


def numeric_similarity(pairs: list[tuple[Column, Column]]) -> Column:
    """Mean ratio similarity over feature pairs."""
    return reduce(lambda s, t: s + t, [ratio_similarity(a, b) for a, b in pairs]) / F.lit(float(len(pairs)))


def style_jaccard(a: Column, b: Column) -> Column:
    """Set overlap of two colour lists; two empty lists are identical."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def safe_ratio(numerator: Column, denominator: Column, empty: Column) -> Column:
    return F.when(denominator == 0, empty).otherwise(numerator / denominator)
