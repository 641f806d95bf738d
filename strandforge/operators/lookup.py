"""Joins with a table that has one row for each key, whatever share of all rows a key holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is frequent that holds more than one part in HOT_SHARE of all rows; its rows are dealt to SALTS tasks.
HOT_SHARE, SALTS = 2048, 32


def looked_up(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` with the other columns of ``groups`` (one row a key; ``weight``: rows of the key), nulls where there is none.

    At most HOT_SHARE keys can hold more than that share of all rows: only these are broadcast, to deal their rows to
    SALTS tasks; in ``groups`` they stand once for each. One shuffle join does the rest.
    """
    total = groups.agg(F.sum(weight)).first()[0] or 0
    frequent = F.col(weight) * HOT_SHARE > total
    hot = F.broadcast(groups.where(frequent).select(*keys, F.lit(True).alias("__hot")))  # HOT_SHARE rows
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    salted = groups.withColumn("__salt", F.explode(F.when(frequent, every).otherwise(F.array(F.lit(0)))))
    dealt = rows.join(hot, keys, "left").withColumn("__salt", F.when(F.col("__hot"), (F.rand(7) * SALTS).cast("int")).otherwise(0)).drop("__hot")
    return dealt.join(salted, [*keys, "__salt"], "left").drop("__salt")
