"""Vector expressions: arrays of numbers in, doubles or arrays of doubles out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-5


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared(a: Column) -> Column:
    return F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x)


def norm(a: Column) -> Column:
    return F.sqrt(squared(a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def scaled(a: Column, k: Column | float) -> Column:
    return F.transform(doubles(a), lambda x: x * k)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def unit(a: Column, eps: float = 0.0) -> Column:
    """a / (norm + eps); a vector of zeros stays."""
    n = norm(a) + F.lit(eps)
    return F.transform(doubles(a), lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x / n))


def to_ball(a: Column, radius: Column | float) -> Column:
    """On the ray of a, at the given radius, inside the open ball; a vector of zeros stays."""
    r = F.least(F.greatest(F.lit(0.0), F.lit(radius) if isinstance(radius, float) else radius), F.lit(1 - EPS))
    return scaled(unit(a), r)


def compress(a: Column) -> Column:
    """Only vectors on or beyond the rim are pulled inside."""
    n = F.greatest(norm(a), F.lit(EPS))
    return scaled(a, F.least(F.lit(1.0), (1 - EPS) / n))


def poincare(u: Column, v: Column) -> Column:
    return _acosh_arg(squared(minus(u, v)), squared(u), squared(v))


def _acosh_arg(d2: Column, u2: Column, v2: Column) -> Column:
    return F.acosh(F.greatest(F.lit(1.0), 1 + 2 * d2 / F.greatest((1 - u2) * (1 - v2), F.lit(EPS))))


def poincare_of(cos: Column, ru: Column | float, rv: Column | float) -> Column:
    """Distance of two points in the ball from their angle and radii; the arrays are needed for the angle only."""
    lit = lambda x: F.lit(x) if isinstance(x, float) else x
    ru, rv = (F.least(F.greatest(F.lit(0.0), lit(r)), F.lit(1 - EPS)) for r in (ru, rv))
    return _acosh_arg(F.greatest(F.lit(0.0), ru * ru + rv * rv - 2 * ru * rv * cos), ru * ru, rv * rv)


def dual_space(q: Column, c: Column, split: int, dim: int, w_angle: float = 2.0, w_plain: float = 1.0) -> Column:
    """Chord of the first ``split`` components' directions and squared distance of the rest, weighted."""
    a = lambda v: unit(F.slice(doubles(v), 1, split), 1e-8)
    b = lambda v: F.slice(doubles(v), split + 1, dim - split)
    return w_angle * 2 * (1 - dot(a(q), a(c))) + w_plain * squared(minus(b(q), b(c)))


def mobius_add(u: Column, v: Column) -> Column:
    uv, u2, v2 = dot(u, v), squared(u), squared(v)
    den = 1 + 2 * uv + u2 * v2
    return F.zip_with(doubles(u), doubles(v), lambda x, y: ((1 + 2 * uv + v2) * x + (1 - u2) * y) / den)


def three_space(q: Column, c: Column, first: int, second: int, dim: int) -> Column:
    """Chord, squared distance, and Moebius distance of tanh-projected parts, summed."""
    p = lambda v, i, n: F.slice(doubles(v), i + 1, n)
    chord = 2 * (1 - cosine(p(q, 0, first), p(c, 0, first)))
    plain = squared(minus(p(q, first, second), p(c, first, second)))
    rest = dim - first - second

    def ball(v):
        x = p(v, first + second, rest)
        n = F.greatest(norm(x), F.lit(EPS))
        return scaled(x, F.tanh(n) / n)

    m = norm(mobius_add(scaled(ball(q), -1.0), ball(c)))
    return chord + plain + 2 * F.atanh(F.least(m, F.lit(1 - EPS)))


def angle(a: Column, b: Column) -> Column:
    """In degrees."""
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine(a, b)))))


def literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])
