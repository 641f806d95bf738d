"""Feature columns as one vector: concatenation, the slice of each feature in it, and batches of features and targets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType

from .splits import permuted, with_batches


def _depth(df: DataFrame, name: str) -> int:
    """Levels of arrays around numbers."""
    kind, depth = df.schema[name].dataType, 0
    while isinstance(kind, ArrayType):
        kind, depth = kind.elementType, depth + 1
    if not isinstance(kind, NumericType):
        raise TypeError(f"{name} does not hold numbers")
    return depth


def _flat(df: DataFrame, name: str) -> Column:
    """A feature as array<double>."""
    found, depth = F.col(f"`{name}`"), _depth(df, name)
    for _ in range(depth - 1):
        found = F.flatten(found)
    return F.transform(found, lambda x: x.cast("double")) if depth else F.array(found.cast("double"))


@dataclass(frozen=True)
class FeatureView:
    """Features of a table side by side; ``starts`` and ``widths`` say where each stands in the vector."""

    names: tuple[str, ...]
    widths: tuple[int, ...]

    @classmethod
    def of(cls, df: DataFrame, names: list[str] | None = None) -> FeatureView:
        """The named features, or all columns. Each must have one width in all rows: one aggregate finds it."""
        chosen = tuple(names or df.columns)
        sizes = {n: F.size(_flat(df, n)) for n in chosen}
        row = df.agg(*(f(c).alias(f"{k}{i}") for i, c in enumerate(sizes.values()) for k, f in (("lo", F.min), ("hi", F.max)))).first()
        for i, n in enumerate(chosen):
            if row[f"lo{i}"] != row[f"hi{i}"]:
                raise ValueError(f"{n} has {row[f'lo{i}']} to {row[f'hi{i}']} values")
        return cls(chosen, tuple(row[f"lo{i}"] or 0 for i in range(len(chosen))))

    def cat(self, df: DataFrame, out: str = "features") -> DataFrame:
        """``df`` with the concatenation of its features as array<double>."""
        return df.withColumn(out, F.concat(*(_flat(df, n) for n in self.names)))

    def idx(self, name: str) -> tuple[int, int]:
        """(first place, place behind the last) of a feature in the vector."""
        at = self.names.index(name)
        start = sum(self.widths[:at])
        return start, start + self.widths[at]

    def dims(self, *names: str) -> list[int]:
        """Places of some features, in the order asked for."""
        return [i for n in names for i in range(*self.idx(n))]

    def get(self, vector: Column, *names: str) -> Column:
        """Those features' part of a vector, in the order asked for."""
        return F.concat(*(F.slice(vector, a + 1, b - a) for a, b in map(self.idx, names)))

    def metadata(self) -> dict[str, tuple[int, int]]:
        return {n: self.idx(n) for n in self.names}


def feature_batches(df: DataFrame, features: list[str], targets: list[str] | None = None, size: int = 32, seed: int | None = 42, epoch: int = 0, index: str = "index", *, drop_single: bool = False) -> DataFrame:
    """batch_id, position, x (a vector of the features), y (of the targets); every epoch is shuffled anew, from the seed and its number.

    ``drop_single``: a last batch of one row is left out, if there are targets.
    """
    order = None if seed is None else seed + 1_000_003 * epoch
    rows = with_batches(df, size, order, index, drop_single=drop_single and targets is not None)
    x = F.concat(*(_flat(df, n) for n in features))
    y = F.concat(*(_flat(df, n) for n in targets)) if targets else F.lit(None).cast("array<double>")
    return rows.select("batch_id", "position", index, x.alias("x"), y.alias("y"))


@dataclass(frozen=True)
class Loader:
    """Batches of a table for a training loop: every batch a row of ``size`` rows' features and targets, the last one of what is left.

    ``index`` numbers the rows from 0 without gaps. A row's place is arithmetic on its number, so that one shuffle by batch is
    all that an epoch costs; a batch gathers ``size`` rows. Each epoch shuffles the order of the one before in the same way.
    ``drop_single``: with targets, the last row is left out if it would be a batch of its own.
    """

    rows: DataFrame
    features: tuple[str, ...]
    targets: tuple[str, ...] = ()
    size: int = 32
    seed: int | None = 42
    index: str = "index"
    drop_single: bool = False

    def count(self) -> int:
        n = self.rows.count()
        return n - 1 if self.drop_single and self.targets and n % self.size == 1 else n

    def __len__(self) -> int:
        return -(-self.count() // self.size)

    def batches(self, epoch: int = 0) -> DataFrame:
        """batch_id, rows (their numbers in order), a column of array<array<float>> for each feature and of array<float> for each target."""
        n = self.count()
        at = F.col(f"`{self.index}`").cast("long")
        place = at if self.seed is None else permuted(at, n, self.seed, epoch + 1)
        x = {f: F.transform(_flat(self.rows, f), lambda v: v.cast("float")) for f in self.features}
        y = {t: _flat(self.rows, t)[0].cast("float") for t in self.targets}
        columns = {f"c{i}": c for i, c in enumerate({**x, **y}.values())}
        placed = self.rows.where(at < n).select(place.alias("place"), at.alias("row"), *(c.alias(k) for k, c in columns.items()))
        batch = F.floor(F.col("place") / self.size).alias("batch_id")
        per = placed.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct("place", "row", *columns))).alias("b"))  # size rows
        of = lambda c: F.transform("b", lambda r: r[c])
        return per.select("batch_id", of("row").alias("rows"), *(of(k).alias(name) for k, name in zip(columns, [*x, *y], strict=True)))

    def epoch(self, number: int = 0) -> Iterator[tuple[dict[str, np.ndarray], dict[str, np.ndarray]]]:
        """(features, targets) of each batch in order, as 32-bit arrays; the driver holds a partition of batches at a time."""
        ordered = self.batches(number).repartitionByRange("batch_id").sortWithinPartitions("batch_id")
        for r in ordered.toLocalIterator(prefetchPartitions=True):
            yield {f: np.array(r[f], np.float32) for f in self.features}, {t: np.array(r[t], np.float32)[:, None] for t in self.targets}
