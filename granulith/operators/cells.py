"""Sums that merge: particles are summed per photo once, and selections of photos add up those sums.

`members` (image_id and the selection's key columns, one row per pair) says which photos a selection holds. Particles are
never multiplied by the selections that share them; only a photo's few sums are. Without `members` the keys are columns of
the particles themselves.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

PHOTO = "image_id"


@dataclass
class Measure:
    partial: Column                       # over the rows of a photo
    merge: Callable[[str], Column]        # over the photos of a selection, by the partial's name


def count(condition: Column | None = None) -> Measure:
    return Measure(F.count("*") if condition is None else F.count_if(condition), F.sum)


def total(value: Column) -> Measure:
    return Measure(F.sum(value), F.sum)


def low(value: Column) -> Measure:
    return Measure(F.min(value), F.min)


def high(value: Column) -> Measure:
    return Measure(F.max(value), F.max)


def any_of(condition: Column) -> Measure:
    return Measure(F.bool_or(condition), F.bool_or)


def unit(keys: list[str], members: DataFrame | None) -> list[str]:
    """The columns that particles are first summed by."""
    return keys if members is None else [PHOTO, *[k for k in keys if k not in members.columns]]


def summed(df: DataFrame, keys: list[str], measures: dict[str, Measure], members: DataFrame | None = None,
           by: dict[str, Column] | None = None) -> DataFrame:
    """One row per key (and value of `by`) with the measures."""
    by = by or {}
    per = df.groupBy(*unit(keys, members), *[c.alias(n) for n, c in by.items()]).agg(*[m.partial.alias(n) for n, m in measures.items()])
    if members is None:
        return per
    return per.join(members, PHOTO).groupBy(*keys, *by).agg(*[m.merge(n).alias(n) for n, m in measures.items()])


def spread(value: Column, name: str) -> dict[str, Measure]:
    """Measures of a mean and standard deviation: squared deviations are taken from each photo's own mean."""
    n, mean = F.count(value), F.avg(value)
    return {f"{name}_n": count(value.isNotNull()), f"{name}_sum": total(value),
            f"{name}_dev": Measure(F.var_pop(value) * n, F.sum), f"{name}_mid": Measure(mean * mean * n, F.sum)}


def mean_of(name: str) -> Column:
    return F.col(f"{name}_sum") / F.nullif(F.col(f"{name}_n"), F.lit(0))


def deviation_of(name: str) -> Column:
    """Population standard deviation: within photos, and of the photos' means around the whole mean."""
    n = F.nullif(F.col(f"{name}_n"), F.lit(0))
    between = F.col(f"{name}_mid") - F.col(f"{name}_sum") * F.col(f"{name}_sum") / n
    return F.sqrt((F.col(f"{name}_dev") + F.greatest(F.lit(0.0), between)) / n)
