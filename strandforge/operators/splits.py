"""Row numbers, reproducible splits, folds and mini-batches.

``md5`` ranks rows by a digest of seed and index, which scales and which any SQL engine repeats; ``keyed`` permutes the row
numbers by arithmetic, so that a row's place needs neither a sort nor a shuffle; ``numpy`` follows numpy's permutation of
the row numbers, built on the driver, for tables of a size where that is fine.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandforge.sources.shared import shared_dir

TRAIN_TEST = "random_split_train_0_8_test_0_2"
MOST_NUMPY = 10_000_000


def _fixed(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder: rows keep their partitions, whatever is computed from them again."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def with_index(df: DataFrame, order: list[str] | None = None, name: str = "index") -> DataFrame:
    """Rows numbered from 0, in the given order or the table's own; an existing column is kept.

    Rows are numbered within their partition, and the rows of the partitions before, one number for each, are added:
    no single-task window.
    """
    if name in df.columns:
        return df
    rows = _fixed(df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df)
    placed = rows.withColumn("__place", F.monotonically_increasing_id())
    part = F.shiftright("__place", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    joined = placed.withColumn("__part", part).join(F.broadcast(before), "__part")  # a row for each partition
    return joined.withColumn(name, F.col("__before") + F.col("__place") - F.shiftleft(F.col("__part"), 33)).drop("__place", "__part", "__before")


def shuffled_rank(index: Column, seed: int) -> Column:
    """Key that puts rows in a random, reproducible order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), index.cast("string")).cast("binary"))


#: Rounds of the keyed permutation, its modulus, and how often a number outside of the rows is permuted again at most.
ROUNDS, MODULUS, WALKS = 6, (1 << 31) - 1, 24


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Three numbers for each round, from the seed's digests."""
    digest = lambda r: hashlib.md5(f"{seed}:{r}".encode()).digest()
    return [tuple(1 + int.from_bytes(digest(r)[4 * i : 4 * i + 4], "big") % (MODULUS - 1) for i in range(3)) for r in range(ROUNDS)]


def sides(n: int) -> tuple[int, int]:
    """Two numbers, about equal, of which the product is ``n`` or a little more."""
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def permuted(index: Column, n: int, seed: int, times: int = 1) -> Column:
    """Place of the row numbers 0 to n - 1 in an order that the seed decides, after shuffling the shuffled order ``times`` times.

    A Feistel network: a number is split in two by a division, and each round adds a keyed function of one side to the other,
    modulo its range. What lands beyond the rows is permuted again, until it lies among them.
    """
    a, b = sides(n)
    mixed = lambda y, k: F.pmod(_times(F.pmod(_times(y, k["x"]) + k["y"], F.lit(MODULUS)), None) + k["z"], F.lit(MODULUS))
    keys = [F.struct(*(F.lit(v).cast("long").alias(c) for c, v in zip("xyz", key, strict=True)), F.lit(b if r % 2 else a).cast("long").alias("size")) for r, key in enumerate(round_keys(seed))]

    def through(x: Column) -> Column:
        start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
        turn = lambda s, k: F.struct(s["r"].alias("l"), F.pmod(s["l"] + mixed(s["r"], k), k["size"]).alias("r"))
        return F.aggregate(F.array(*keys), start, turn, lambda s: s["l"] * b + s["r"])

    walks = F.sequence(F.lit(1), F.lit(min(WALKS, a * b - n + 1)))
    far = F.raise_error(F.lit("a row number is not below the number of rows")).cast("long")
    once = lambda x: F.aggregate(walks, through(x), lambda y, _: F.when(y < n, y).otherwise(through(y)), lambda y: F.when(y < n, y).otherwise(far))
    known = F.when((index >= 0) & (index < n), index.cast("long")).when(index.isNotNull(), far)
    return F.aggregate(F.sequence(F.lit(1), F.lit(times)), known, lambda x, _: once(x)) if times else known


def _times(x: Column, y: Column | None) -> Column:
    """A product of two numbers below MODULUS, or a square, within 64 bits."""
    least = F.pmod(x, F.lit(MODULUS))
    return least * (least if y is None else y)


def position(df: DataFrame, seed: int = 42, index: str = "index", backend: str = "md5", name: str = "position") -> DataFrame:
    """``df`` and each row's place (from 0) in the shuffled order."""
    if backend == "numpy":
        n = df.count()
        if n > MOST_NUMPY:
            raise ValueError("the numpy backend is for tables of at most 10 million rows")
        places = np.empty(n, np.int64)
        places[np.random.default_rng(seed).permutation(n)] = np.arange(n)
        table = _numbers(df.sparkSession, places, index, name)
        return df.join(table, index)
    if backend == "keyed":
        return df.withColumn(name, permuted(F.col(index), df.count(), seed))
    key = shuffled_rank(F.col(index), seed)
    # ranks within 4096 even ranges of the digest, then the rows of the ranges before: sorts run in parallel
    ranged = df.withColumn("__key", key).withColumn("__part", F.conv(F.substr("__key", F.lit(1), F.lit(3)), 16, 10).cast("int"))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy("__key", index)) - 1
    return ranged.withColumn("__place", place).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__place")).drop("__key", "__part", "__place", "__before")  # 4096 rows


def _numbers(spark: SparkSession, places: np.ndarray, index: str, name: str) -> DataFrame:
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({index: np.arange(len(places)), name: places}))


def with_train_test(df: DataFrame, seed: int = 42, test: float = 0.2, index: str = "index", backend: str = "md5", column: str = TRAIN_TEST) -> DataFrame:
    """The first ceil(test * n) rows of the shuffled order are ``test``, the others ``train``."""
    if column in df.columns:
        return df
    n = df.agg(F.count("*").alias("__rows"))
    placed = position(df, seed, index, backend, "__position").crossJoin(F.broadcast(n))  # one row
    return placed.withColumn(column, F.when(F.col("__position") < F.ceil(F.col("__rows") * F.lit(test)), "test").otherwise("train")).drop("__position", "__rows")


def with_folds(df: DataFrame, k: int = 10, seed: int = 42, index: str = "index", backend: str = "md5", column: str | None = None) -> DataFrame:
    """Folds ``split_0`` ... of n // k rows of the shuffled order; the last takes the rest."""
    column = column or f"random_split_{k}_fold"
    if column in df.columns:
        return df
    n = df.count()
    if k > n:
        raise ValueError(f"{k} folds of {n} rows")
    fold = F.least(F.floor(F.col("__position") / (n // k)), F.lit(k - 1))
    return position(df, seed, index, backend, "__position").withColumn(column, F.concat(F.lit("split_"), fold.cast("string"))).drop("__position")


def with_split_columns(df: DataFrame, seed: int = 42, index: str = "index", test: float = 0.2, k: int = 10) -> DataFrame:
    """Both split columns, from one shuffled order; at most ``k`` folds, fewer for fewer rows."""
    n = df.count()
    folds = min(k, max(1, n))
    name = f"random_split_{folds}_fold"
    new = {}
    if TRAIN_TEST not in df.columns:
        new[TRAIN_TEST] = F.when(F.col("__position") < F.ceil(F.lit(n) * F.lit(test)), "test").otherwise("train")
    if name not in df.columns:
        new[name] = F.concat(F.lit("split_"), F.least(F.floor(F.col("__position") / max(n // folds, 1)), F.lit(folds - 1)).cast("string"))
    return position(df, seed, index, name="__position").withColumns(new).drop("__position") if new else df


def by_column(df: DataFrame, column: str) -> dict[str, DataFrame]:
    """A filter per value of a split column, values in order."""
    values = sorted(r[0] for r in df.select(column).distinct().collect())  # split names
    return {v: df.where(F.col(column) == v) for v in values}


def split(df: DataFrame, column: str | None = None, k: int | None = None, seed: int = 42, index: str = "index") -> dict[str, DataFrame]:
    """Splits of a table: by an existing column, into ``k`` folds, or into train and test."""
    if column is not None:
        if column not in df.columns:
            raise ValueError(f"no column {column!r}")
        return by_column(df, column)
    if k is not None:
        return by_column(with_folds(df, k, seed, index, column="__fold"), "__fold")
    return by_column(with_train_test(df, seed, index=index), TRAIN_TEST)


def union(splits: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:
    chosen = [d for n, d in splits.items() if not names or n in names]
    if not chosen:
        raise ValueError("no such split")
    out = chosen[0]
    for d in chosen[1:]:
        out = out.unionByName(d)
    return out


def labelled(splits: dict[str, DataFrame], column: str) -> dict[str, DataFrame]:
    return {n: d if column in d.columns else d.withColumn(column, F.lit(n)) for n, d in splits.items()}


def train_test_sets(df: DataFrame, column: str, n_test: int = 1) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(train, test) for every choice of ``n_test`` splits as test."""
    names = sorted(r[0] for r in df.select(column).distinct().collect())  # split names
    if set(names) == {"train", "test"}:
        yield df.where(F.col(column) == "train"), df.where(F.col(column) == "test")
        return
    for chosen in combinations(names, n_test):
        yield df.where(~F.col(column).isin(*chosen)), df.where(F.col(column).isin(*chosen))


def fold_counts(df: DataFrame, column: str, n_test: int = 1) -> DataFrame:
    """choice, test, n_train, n_test for every choice of ``n_test`` splits as test, from one count of the splits."""
    counts = {r[0]: r["n"] for r in df.groupBy(column).agg(F.count("*").alias("n")).collect()}  # split names
    total = sum(counts.values())
    chosen = [("test",)] if set(counts) == {"train", "test"} else list(combinations(sorted(counts), n_test))
    rows = [(i, list(c), total - sum(counts[x] for x in c), sum(counts[x] for x in c)) for i, c in enumerate(chosen)]
    return df.sparkSession.createDataFrame(rows, "choice int, test array<string>, n_train long, n_test long")


def with_batches(df: DataFrame, size: int = 32, seed: int | None = 42, index: str = "index", *, drop_single: bool = False) -> DataFrame:
    """``df`` and batch_id; shuffled unless ``seed`` is None. ``drop_single``: no last batch of one row."""
    placed = df.withColumn("position", F.col(index)) if seed is None else position(df, seed, index)
    out = placed.withColumn("batch_id", F.floor(F.col("position") / size))
    n = df.count() if drop_single else 0
    return out.where(F.col("position") < n - 1) if n % size == 1 else out
