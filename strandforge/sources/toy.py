"""Small made datasets: variants of one protein with a number or a class to learn."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from strandforge.functions.alphabets import AMINO
from strandforge.operators.splits import TRAIN_TEST, with_index, with_train_test
from strandforge.operators.variants import apply_all
from strandforge.plans.encodings import encoded

LENGTH, VARIANTS = 442, 21


@dataclass
class ToyDataset:
    """``full``, ``train`` and ``test`` (a fifth of the rows)."""

    full: DataFrame

    @property
    def train(self) -> DataFrame:
        return self.full.where(f"{TRAIN_TEST} = 'train'")

    @property
    def test(self) -> DataFrame:
        return self.full.where(f"{TRAIN_TEST} = 'test'")


def parent(length: int = LENGTH) -> str:
    """A sequence made by a rule; it begins with M."""
    return "M" + "".join(AMINO[(7 * i * i + 3 * i + i // 5) % 20] for i in range(1, length))


def _rows(variants: int, length: int) -> list[tuple[int, str, str | None]]:
    base = parent(length)
    codes = [(17 * i % (length - 1) + 1, i) for i in range(1, variants)]
    swap = lambda at, i: AMINO[(AMINO.index(base[at]) + 1 + i % 19) % 20]
    return [(0, "wildtype", base), *((i, f"{base[at]}{at + 1}{swap(at, i)}", None) for at, i in codes)]


def _made(spark: SparkSession, target: str, kind: str, values: list[float] | list[int], wanted: list[str] | None, length: int) -> ToyDataset:
    rows = [(i, code, seq, values[i]) for i, code, seq in _rows(len(values), length)]
    df = spark.createDataFrame(rows, f"index long, aa_mut string, aa_seq string, {target} {kind}")
    filled = apply_all(df, offset=0).withColumn("aa_seq", _first("aa_seq", "applied")).drop("applied")
    return ToyDataset(with_train_test(with_index(encoded(filled, wanted) if wanted else filled)))


def _first(*columns: str):  # noqa: ANN202
    from pyspark.sql import functions as F

    return F.coalesce(*columns)


def regression(spark: SparkSession, wanted: list[str] | None = None, variants: int = VARIANTS, length: int = LENGTH) -> ToyDataset:
    return _made(spark, "target_kcat_per_kmol", "double", [round(10 + 5.5 * ((7 * i) % 13) / 13, 3) for i in range(variants)], wanted, length)


def classification(spark: SparkSession, wanted: list[str] | None = None, variants: int = VARIANTS, length: int = LENGTH) -> ToyDataset:
    return _made(spark, "target_high_low", "int", [(7 * i) % 13 // 7 for i in range(variants)], wanted, length)
