"""Column expressions of the panel engine; all stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def null_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def guarded(value: Column, detected: Column) -> Column:
    """A detected value; 0 where it was not detected or not measured."""
    return F.coalesce(F.when(F.coalesce(detected, F.lit(False)), value), F.lit(0.0))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def rounded(value: Column, digits: int = 6) -> Column:
    """A double for comparison: rounded, and never -0.0."""
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def gaussian_decay(distance: Column, cap: float) -> Column:
    return F.exp(-F.pow(distance / F.lit(cap), 2))


def entropy(p: Column) -> Column:
    """Binary entropy in nats, p clipped by 1e-9."""
    q = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return -(q * F.ln(q) + (1 - q) * F.ln(1 - q))


def adjusted_skew(x: Column) -> Column:
    """Sample skewness G1 of a group, null below three values or without spread."""
    n = F.count(x).cast("double")
    g1 = F.when(F.var_pop(x) > 0, F.skewness(x))
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are known, null if one is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def bucket_hash(key: Column, seed: int, size: int = 1_000_003) -> Column:
    """A seeded number below ``size`` from integer arithmetic, equal in every engine."""
    return F.pmod(F.pmod(key, F.lit(size)).cast("long") * F.lit(48_271 + 2 * seed) + F.lit(seed * 7919), F.lit(size))


def month_cycle(ts: Column) -> tuple[Column, Column]:
    angle = F.lit(2.0) * F.pi() * F.month(ts) / F.lit(12.0)
    return F.sin(angle), F.cos(angle)
