"""Targets: which columns they are, scaling them, turning objectives into values to maximise."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMMARY = "target summary variable"


@dataclass(frozen=True)
class Objective:
    """direction: max, min or fix (at ``aim_for``)."""

    direction: str = "max"
    aim_for: float | None = None
    weight: float = 1.0


def target_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("target")]


def to_maximise(value: Column, objective: Objective) -> Column:
    if not isinstance(objective, Objective):
        raise TypeError("an Objective is needed")
    if objective.direction == "max":
        return value
    if objective.direction == "min":
        return -value
    if objective.direction == "fix":
        return -F.abs(value - F.lit(objective.aim_for))
    raise ValueError(f"unknown direction {objective.direction!r}")


def adjusted(df: DataFrame, objectives: Mapping[str, Objective]) -> DataFrame:
    """All target columns turned into values to maximise; objectives must name exactly the targets."""
    if set(objectives) != set(target_columns(df)):
        raise ValueError(f"objectives are for {sorted(objectives)}, targets are {sorted(target_columns(df))}")
    return df.withColumns({c: to_maximise(F.col(f"`{c}`"), o) for c, o in objectives.items()})


def zscored(df: DataFrame, columns: list[str], mean: Mapping[str, float] | None = None, std: Mapping[str, float] | None = None) -> DataFrame:
    """Columns minus mean over population standard deviation (1 where that is 0); given values are reused.

    The statistics are one row, joined to all: no global window.
    """
    stats = df.agg(*(f(F.col(f"`{c}`").cast("double")).alias(f"__{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    joined = df.crossJoin(F.broadcast(stats))  # one row
    out = {}
    for i, c in enumerate(columns):
        m = F.lit(float(mean[c])) if mean and c in mean else F.col(f"__m{i}")
        s = F.lit(float(std[c])) if std and c in std else F.col(f"__s{i}")
        out[c] = (F.col(f"`{c}`") - m) / F.when(s == 0, F.lit(1.0)).otherwise(s)
    return joined.withColumns(out).select(*(F.col(f"`{c}`") for c in df.columns))


def de_zscored(means: Column, stds: Column | None, mean: float = 0.0, std: float = 1.0) -> tuple[Column, Column | None]:
    return means * F.lit(std) + F.lit(mean), None if stds is None else stds * F.lit(std)


def identity(df: DataFrame, columns: list[str]) -> DataFrame:
    return df


def with_summary(df: DataFrame, objectives: Mapping[str, Objective] | None = None, normalization: Callable[[DataFrame, list[str]], DataFrame] = zscored, name: str = SUMMARY) -> DataFrame:
    """``df`` and the weighted sum of its adjusted, normalised targets."""
    targets = target_columns(df)
    if not targets:
        raise ValueError("no target columns")
    objectives = objectives or {c: Objective() for c in targets}
    if set(objectives) != set(targets):
        raise ValueError("objectives must name exactly the targets")
    scratch = {c: f"__adjusted{i}" for i, c in enumerate(targets)}
    wide = df.withColumns({s: to_maximise(F.col(f"`{c}`"), objectives[c]).cast("double") for c, s in scratch.items()})
    total = F.lit(0.0)
    for c, s in scratch.items():
        total = total + F.lit(float(objectives[c].weight)) * F.col(s)
    return normalization(wide, list(scratch.values())).withColumn(name, total).drop(*scratch.values())


def target_matrix(df: DataFrame, max_targets: int | None = None, normalization: Callable[[DataFrame, list[str]], DataFrame] = identity) -> DataFrame:
    """The first ``max_targets`` target columns, normalised."""
    targets = target_columns(df)[:max_targets]
    return normalization(df.select(*(F.col(f"`{c}`") for c in targets)), targets)


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """bin, n: even bins from the smallest to the largest value; the last includes its end. Nulls and NaN are left out."""
    value = F.col(f"`{column}`").cast("double")
    rows = df.select(value.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) / bins
    place = F.least(F.coalesce(F.floor((F.col("x") - F.col("lo")) / width), F.lit(0)), F.lit(bins - 1))
    return rows.crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # one row
