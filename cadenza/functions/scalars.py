"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def play_label(ratio: Column) -> Column:
    """positive above 0.8, neutral above 0.2, else skip; the bounds themselves belong to the lower label."""
    return F.when(ratio > 0.8, "positive").when(ratio > 0.2, "neutral").otherwise("skip")


def label_target(label: Column) -> tuple[Column, Column]:
    """Training target and weight of a label."""
    y = F.when(label == "positive", 1.0).when(label == "neutral", 0.5).otherwise(0.0)
    return y, F.when(label == "neutral", 0.3).otherwise(1.0)


def label_code(label: Column) -> Column:
    """skip 0, neutral 1, positive 2, anything else 3."""
    return F.when(label == "skip", 0).when(label == "neutral", 1).when(label == "positive", 2).otherwise(3)


def ratio(part: Column, whole: Column) -> Column:
    """0.0 for an empty whole, else the quotient rounded to 6 places."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, 0.0).otherwise(F.round(part / whole, 6))


def rounded(value: Column, places: int) -> Column:
    """`value` to `places` places, halves away from zero; what rounds to zero keeps its sign, which `F.round` drops."""
    scale = float(10**places)
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale


def artist_key(artist: Column) -> Column:
    return F.lower(F.trim(F.coalesce(F.nullif(artist, F.lit("")), F.lit("unknown artist"))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(eps))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda acc, x: acc + x)


def unit_of(key: Column) -> Column:
    """A number in [0, 1) from the MD5 of a key: the same in every engine."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def clamp_ratio(elapsed: Column, duration: Column) -> Column:
    """Share of a track that was played, between 0 and 0.99, to 2 places."""
    return F.round(F.least(F.greatest(elapsed / F.nullif(duration, F.lit(0)), F.lit(0.0)), F.lit(0.99)), 2)


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])
