"""Vector functions as Columns, in double precision, and a hash embedder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity within [-1, 1]; 0 where a norm is 0."""
    d = norm(a) * norm(b)
    return F.when(d == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), d))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` loops over it."""
    return F.transform(F.array(value), body)[0]


def normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays."""
    return let(norm(a), lambda n: F.when(n == 0, doubles(a)).otherwise(F.transform(doubles(a), lambda x: F.try_divide(x, n))))


def hash_embed(text: Column, dim: int = 64) -> Column:
    """Unit vector from the bytes of the text's SHA-256, repeated and mapped to [-1, 1]."""
    byte = lambda digest, i: F.conv(F.substr(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")
    raw = let(F.sha2(F.coalesce(text, F.lit("")), 256), lambda digest: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: byte(digest, i) / 127.5 - 1))
    return let(raw, normalize)


def project_3d(x: Column, y: Column, z: Column, yaw: float, pitch: float) -> tuple[Column, Column]:
    """A point turned by ``yaw`` and ``pitch`` and seen along the z axis."""
    x1 = x * F.cos(F.lit(yaw)) - z * F.sin(F.lit(yaw))
    z1 = x * F.sin(F.lit(yaw)) + z * F.cos(F.lit(yaw))
    return x1, y * F.cos(F.lit(pitch)) - z1 * F.sin(F.lit(pitch))
