"""Sequence features of a stream: all expressions are row-local, so no state and no watermark are needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandforge.functions import sequences
from strandforge.functions.alphabets import AA
from strandforge.functions.mutations import applied, parsed_or_null


def encoded_stream(df: DataFrame, seq_col: str = "aa_seq") -> DataFrame:
    seq = F.col(seq_col)
    return df.withColumns({"aa_len": F.length(seq), "aa_1gram": sequences.symbol_counts(seq, AA), "seq_type": sequences.sequence_type(seq)})


def applied_stream(df: DataFrame, parent: str, mut_col: str = "aa_mut", offset: int = 0, out: str = "aa_seq") -> DataFrame:
    return df.withColumn(out, F.coalesce(applied(parsed_or_null(F.col(mut_col)), F.lit(parent), offset), F.lit(parent)))
