"""From a file to a table that is ready for training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from strandforge.operators.integrity import checked
from strandforge.operators.splits import by_column, with_index, with_split_columns
from strandforge.operators.tags import cleaned
from strandforge.operators.variants import filled
from strandforge.sources.tables import read_table, write_table

from .encodings import encoded


def preprocessed(df: DataFrame, *, add_index: bool = True, add_splits: bool = True, tags: DataFrame | None = None, seq: str = "aa_seq") -> DataFrame:
    """``df`` with an index and split columns; with a tag library, its sequences are stripped of terminal tags first."""
    if tags is not None:
        df = cleaned(with_index(df), tags, "index", seq)
    if add_index:
        df = with_index(df)
    return with_split_columns(df) if add_splits else df


def transformed(df: DataFrame, wanted: list[str] | None = None, *, add_index: bool = True, add_splits: bool = True) -> DataFrame:
    return encoded(preprocessed(df, add_index=add_index, add_splits=add_splits), wanted)


def complete(df: DataFrame) -> DataFrame:
    """Checked, and with missing sequences filled in from the codes of their own family."""
    df = checked(df)
    for family in ("aa", "dna"):
        if {f"{family}_seq", f"{family}_mut"} <= set(df.columns):
            return filled(df, f"{family}_seq", f"{family}_mut")
    return df


def from_dict(spark: SparkSession, columns: dict[str, list], wanted: list[str] | None = None, splits: str | None = None) -> DataFrame | dict[str, DataFrame]:
    """A table from lists by column name: checked, filled and encoded; ``splits`` names a column to split it by."""
    sizes = {len(v) for v in columns.values()}
    if len(sizes) > 1:
        raise ValueError("columns differ in length")
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), _schema(spark, columns))
    out = encoded(complete(df), wanted)
    return by_column(out, splits) if splits else out


def _schema(spark: SparkSession, columns: dict[str, list]) -> StructType:
    """Types by the first value of each column; strings where there is none."""
    out = StructType()
    for name, values in columns.items():
        known = next((x for x in values if x is not None), "")
        out = out.add(name, spark.createDataFrame([(known,)], ["x"]).schema["x"].dataType)
    return out


def prepare(spark: SparkSession, path: str, save_to: str | None = None, wanted: list[str] | None = None, *, add_index: bool = True, add_splits: bool = True) -> DataFrame:
    """Read, check, fill, index, split, encode; optionally save."""
    out = transformed(complete(read_table(spark, path)), wanted, add_index=add_index, add_splits=add_splits)
    if save_to:
        write_table(out, save_to)
    return out
