"""Checks of a table before it is processed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandforge.functions.targets import SUMMARY


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: nulls and NaN in each column."""
    kinds = dict(df.dtypes)
    missing = lambda c: F.isnull(f"`{c}`") | (F.isnan(f"`{c}`") if kinds[c] in ("float", "double") else F.lit(False))
    return df.agg(*(F.count_if(missing(c)).alias(c) for c in columns))


def missing_mask(df: DataFrame, column: str) -> DataFrame:
    kind = dict(df.dtypes)[column]
    return df.withColumn("missing", F.isnull(column) | (F.isnan(column) if kind in ("float", "double") else F.lit(False)))


def problems(df: DataFrame) -> list[str]:
    """What a table lacks: sequences, codes for missing sequences, targets."""
    found = []
    if SUMMARY in df.columns:
        raise KeyError(f"the column name {SUMMARY!r} is reserved")
    if not {"aa_seq", "dna_seq"} & set(df.columns):
        found.append("neither aa_seq nor dna_seq")
    open_ = [(s, m) for s, m in (("aa_seq", "aa_mut"), ("dna_seq", "dna_mut")) if s in df.columns and m not in df.columns]
    if open_:
        nulls = null_counts(df, [s for s, _ in open_]).first()
        found += [f"{s} has missing values and there is no {m}" for s, m in open_ if nulls[s]]
    if not any(c.lower().startswith("target") for c in df.columns):
        found.append("no target column")
    return found


def checked(df: DataFrame) -> DataFrame:
    """``df`` itself, or a KeyError; a table without columns passes."""
    if not isinstance(df, DataFrame):
        raise TypeError("a DataFrame is needed")
    if df.columns and (found := problems(df)):
        raise KeyError("; ".join(found))
    return df
