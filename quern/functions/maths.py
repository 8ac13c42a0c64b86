"""Column expressions over numbers: scales, tiers, travel, composite scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, places: int) -> Column:
    """Halves away from zero, judged on value * 10^places as a double, as C and the SQL's engine do, not on its decimal digits."""
    scale = float(10**places)
    scaled = value.cast("double") * scale
    return F.when(F.abs(scaled) < 2.0**52, F.signum(scaled) * (F.floor(F.abs(scaled)) + F.when(F.abs(scaled) - F.floor(F.abs(scaled)) >= 0.5, 1.0).otherwise(0.0)) / scale).otherwise(value.cast("double"))


def normalised(value: Column, low: float, high: float) -> Column:
    """Rescaled to [0, 1] and clamped; 0 where the range is empty."""
    return F.lit(0.0) if high <= low else F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def tier(weight: Column, limits: tuple[float, ...], names: tuple[str, ...]) -> Column:
    """The first name whose limit a weight reaches, the last one below all."""
    out = F.when(weight >= limits[0], names[0])
    for limit, name in zip(limits[1:], names[1:], strict=False):
        out = out.when(weight >= limit, name)
    return out.otherwise(names[-1])


def minutes_for(km: Column) -> Column:
    """Travel minutes: 12 a kilometre at first, 6 from one, 2 from five on; half-even whole minutes from 3 to 60."""
    raw = F.when(km < 1, km * 12.0).when(km < 5, 12.0 + (km - 1.0) * 6.0).otherwise(36.0 + (km - 5.0) * 2.0)
    return F.greatest(F.lit(3), F.least(F.lit(60), F.bround(raw).cast("int")))


def conflict_preservation(both_found: Column, sources: Column, order: Column) -> Column:
    """Harmonic mean of the parts that hold times the share of parts that do, that is the share."""
    return (both_found.cast("int") + sources.cast("int") + order.cast("int")) / 3.0


def lift(with_memory: Column, without: Column) -> Column:
    return (with_memory - without) / F.greatest(without, F.lit(1e-8))


def first_token_time(n: Column, a: float, b: float, c: float) -> Column:
    return a + b * n + c * n * n


def more_than_half(flags: Column) -> Column:
    """Whether more than half of an array of booleans hold."""
    return F.size(F.filter(flags, lambda x: x)) >= F.floor(F.size(flags) / 2) + 1
