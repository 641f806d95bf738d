"""Exact deduplication that no frequent text can skew, in DataFrame operations only.

Texts are equal when identical after deleting white space ``[\\x20\\x09-\\x0D]``. Three combining stages group on the
digest *and* the whole normalised text, so content is compared at each: (1) every task combines its own rows (the
partial aggregate); (2) groups of a digest and a salt merge, the salt being the input split's number modulo ``salts``;
(3) the salts' winners of a digest merge. A text shared by a third of all rows reaches stage 2 as one row per task and
stage 3 as ``salts`` rows. Documents then look their group up by digest and length, a join in which Spark may split a
frequent key, since each key has one row on the other side.

The row with the most code points in its original text stays, then the smallest ``doc_id``. Nulls and edge cases: a
null text counts as empty; a null ``doc_id`` is the largest; repeated rows form one group and, having the same
``doc_id``, are kept or dropped together; a very long text is one value like others, compared whole; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32
#: The white space that does not count.
WHITE_SPACE = " \t\n\x0b\x0c\r"
LARGEST = (1 << 63) - 1
#: Rank of a row within its group as one number that aggregates in place: code points, then smaller doc_id first.
STEP = "100000000000000000000"


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct text: text_sha256, n_norm, keep_id, group_size."""
    own = _normalised(docs, id_col, text_col).withColumn("salt", F.spark_partition_id() % salts)
    merged = own.groupBy("text_sha256", "norm", "salt").agg(F.max("rank").alias("rank"), F.count("*").alias("n"))
    winners = merged.groupBy("text_sha256", "norm").agg(F.max("rank").alias("rank"), F.sum("n").alias("n"))
    back = F.lit(LARGEST).cast("decimal(38,0)") - F.pmod("rank", F.lit(STEP).cast("decimal(38,0)"))
    return winners.select("text_sha256", F.length("norm").alias("n_norm"), back.cast("long").alias("keep_id"), F.col("n").alias("group_size"))


def _normalised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _normal(text).alias("norm"), F.length(text).cast("decimal(18,0)").alias("n"))
    key = F.lit(LARGEST).cast("decimal(20,0)") - F.coalesce("doc_id", F.lit(LARGEST)).cast("decimal(20,0)")
    rank = (F.col("n").cast("decimal(38,0)") * F.lit(STEP).cast("decimal(21,0)")).cast("decimal(38,0)") + key
    return rows.select("doc_id", "norm", F.sha2("norm", 256).alias("text_sha256"), rank.cast("decimal(38,0)").alias("rank"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """``docs``, all columns unchanged, without the rows that do not stay. A row without ``doc_id`` stays; rows that share a
    ``doc_id`` are told apart by their texts, and stay or go together where these are equal too."""
    gone = exact_duplicates(docs, id_col, text_col, salts).where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest"))
    digest = F.sha2(_normal(docs[text_col]), 256)
    return docs.join(gone, (docs[id_col].cast("long") == gone["__id"]) & (digest == gone["__digest"]), "left_anti")


def _normal(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``."""
    groups = exact_groups(docs, id_col, text_col, salts)
    rows = _normalised(docs, id_col, text_col).select("doc_id", "text_sha256", F.length("norm").alias("n_norm"))
    keep = F.when(F.col("keep_id") == LARGEST, None).otherwise(F.col("keep_id"))
    return rows.join(groups, ["text_sha256", "n_norm"]).select(
        "doc_id", keep.alias("keep_id"), "group_size", (F.coalesce("doc_id", F.lit(LARGEST)) == F.col("keep_id")).alias("kept"), "text_sha256"
    )
