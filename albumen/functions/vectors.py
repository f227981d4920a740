"""Vector functions over array columns, in double precision, as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Over the shared length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Over the shared length; 0 if either is zero there."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def cosine_floored(a: Column, b: Column, floor: float = 1e-12) -> Column:
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    return dot(a, b) / ((norm(a) + floor) * (norm(b) + floor))


def confirmed_bonus(score: Column, confirmed: Column, each: float = 0.05, most: float = 0.10) -> Column:
    return F.least(F.lit(1.0), score + F.least(F.lit(most), confirmed * F.lit(each)))


def align(a: Column, size: int) -> Column:
    """Zeros appended or the end cut off."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), size)), 1, size)


def divided(a: Column, by: Column, where: Callable[[Column], Column] = lambda n: n.isNotNull()) -> Column:
    """a over a number that is found once a row, null unless the number is as `where` says: named within the function
    over a's components, it would be found again for each of them."""
    return F.transform(F.array(by), lambda n: F.when(where(n), F.transform(a, lambda x: x.cast("double") / n)))[0]


def has_length(n: Column) -> Column:
    """Whether n is the norm of a vector with a direction: not of one that is empty, zero or not finite."""
    return (n > 0) & ~F.isnan(n) & (n < float("inf"))


def unit(a: Column) -> Column:
    """Length 1; null for vectors that are empty, zero or not finite."""
    return divided(a, norm(a), has_length)


def hybrid(a: Column, b: Column) -> Column:
    """Two spaces side by side, as a unit vector."""
    return unit(F.concat(a.cast("array<double>"), b.cast("array<double>")))


def hamming(a: Column, b: Column) -> Column:
    """Differing characters; the longer length for texts of unequal lengths."""
    chars = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y)
    return F.when(F.length(a) != F.length(b), F.greatest(F.length(a), F.length(b))).otherwise(F.size(F.filter(chars, lambda same: ~same)))


def softmax(score: Column, window) -> Column:
    top = F.max(score).over(window)
    e = F.exp(score - top)
    return e / F.sum(e).over(window)
