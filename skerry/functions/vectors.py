"""Dense arrays, token sets and sparse maps: norms and similarities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    norm = F.greatest(l2_norm(a), F.lit(EPS))
    return F.transform(a, lambda x: x.cast("double") / norm)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / F.size(F.array_union(a, b)))


def kl_similarity(p: Column, q: Column, smooth: float = 1e-9) -> Column:
    """``exp(-(KL(p|q) + KL(q|p)) / 2)`` of two maps term -> weight, smoothed
    over the union of their terms and renormalised; 0 without any term."""
    keys = F.array_union(F.map_keys(p), F.map_keys(q))

    def weight(m: Column, k: Column) -> Column:
        return F.coalesce(F.try_element_at(m, k), F.lit(0.0)) + smooth

    def total(m: Column) -> Column:
        return _sum(F.transform(keys, lambda k: weight(m, k)))

    def with_totals(sums: Column) -> Column:
        def term(k: Column) -> Column:
            a, b = weight(p, k) / sums[0], weight(q, k) / sums[1]
            return (a - b) * F.ln(a / b)

        return F.exp(-0.5 * _sum(F.transform(keys, term)))

    score = F.element_at(F.transform(F.array(F.array(total(p), total(q))), with_totals), 1)
    return F.when(F.size(keys) == 0, F.lit(0.0)).otherwise(score)
