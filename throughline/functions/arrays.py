"""Column expressions over probability vectors held as array<double>."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def shrink(counts: Column, n: Column, parent: Column, k: float) -> Column:
    """Dirichlet posterior mean with `k` pseudo-counts spread like `parent`."""
    return F.zip_with(counts, parent, lambda c, p: (c + F.lit(k) * p) / (n + F.lit(k)))


def normalise(arr: Column) -> Column:
    s = total(arr)
    return F.transform(arr, lambda x: F.try_divide(x, s))


def index_of(action: Column, alphabet: list[str]) -> Column:
    """1-based place of the action in the alphabet."""
    return F.array_position(F.array(*[F.lit(a) for a in alphabet]), action).cast("int")


def prob_of(probs: Column, action: Column, alphabet: list[str]) -> Column:
    return F.try_element_at(probs, index_of(action, alphabet))


def entropy_ratio(p: Column, q: Column) -> Column:
    """Kullback-Leibler distance of p from q in nats; zero-probability terms add nothing."""
    terms = F.zip_with(p, q, lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(F.lit(0.0)))
    return total(terms)


def variation(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda x, y: F.abs(x - y))) / F.lit(2.0)


def coalesce_all(*cols: Column) -> Column:
    return reduce(lambda a, b: F.coalesce(a, b), cols)
