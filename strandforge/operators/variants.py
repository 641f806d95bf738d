"""Mutations across rows: the parent sequence, its sketch, offsets, filling in sequences, combining variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandforge.functions.mutations import applied, combined, is_unmutated, mutation_column, parsed_or_null


def parent_rows(df: DataFrame, mut_col: str) -> DataFrame:
    return df.where(F.contains(F.col(mut_col), F.lit("wildtype")) | F.contains(F.col(mut_col), F.lit("wt")))


def parent_sequence(df: DataFrame, seq_col: str = "aa_seq", mut_col: str = "aa_mut") -> str:
    """Sequence of the one row whose code names the wild type."""
    found = parent_rows(df, mut_col).select(seq_col).take(2)
    if len(found) != 1:
        raise ValueError("exactly one wild type row is needed")
    return found[0][0]


def positions(df: DataFrame, mutations: str = "mutations") -> DataFrame:
    """Distinct (pos, src) of all rows."""
    return df.select(F.explode(mutations).alias("m")).select("m.pos", "m.src").distinct()


def parent_sketch(df: DataFrame, mutations: str = "mutations", fill: str = "*") -> DataFrame:
    """One row: n_positions, and the parent as far as the mutations tell. Conflicting sources are an error.

    Gathers one row per position of the parent, not per variant.
    """
    per = positions(df, mutations).groupBy("pos").agg(F.count("*").alias("n"), F.min("src").alias("src"))
    one = per.agg(F.count("*").alias("n_positions"), F.max("pos").alias("last"), F.map_from_entries(F.collect_list(F.struct("pos", "src"))).alias("at"), F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("pos")))).alias("clash"))
    sketch = F.array_join(F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("at", i), F.lit(fill))), "")
    bad = F.raise_error(F.concat(F.lit("conflicting sources at "), F.array_join(F.col("clash").cast("array<string>"), ", "))).cast("string")
    return one.select("n_positions", F.when(F.size("clash") > 0, bad).otherwise(sketch).alias("sketch"))


def offsets(df: DataFrame, parent: str, mutations: str = "mutations") -> DataFrame:
    """offset, matches, matching_ratio and rank of every placement of the mutations on ``parent``: see offsets_on."""
    one = df.sparkSession.createDataFrame([(0, parent)], "parent_id int, sequence string")
    return offsets_on(df, one, mutations).drop("parent_id")


def offsets_on(df: DataFrame, parents: DataFrame, mutations: str = "mutations") -> DataFrame:
    """parent_id, offset, matches, matching_ratio, rank of every placement of the mutations on each of ``parents`` (parent_id, sequence).

    Each distinct position votes: its letter is joined with the places of the parents that have this letter, and a match counts
    for the offset between both. Placements without a vote have no match; larger offsets win ties. A parent that is
    shorter than the span of the mutations has no placement.
    """
    at = positions(df, mutations)
    span = at.agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count_distinct("pos").alias("n")).where("n > 0")
    windows = F.length("sequence") - (F.col("hi") - F.col("lo") + 1)
    sized = parents.select("parent_id", "sequence").crossJoin(F.broadcast(span)).where(windows >= 0)  # one row
    every = sized.select("parent_id", "n", F.explode(F.sequence(-F.col("lo"), windows - F.col("lo"))).alias("offset"))
    places = parents.select("parent_id", F.posexplode(F.split("sequence", "")).alias("place", "src"))
    voted = places.join(at, "src").groupBy("parent_id", (F.col("place") - F.col("pos")).alias("offset")).agg(F.count("*").alias("votes"))
    rank = F.row_number().over(Window.partitionBy("parent_id").orderBy(F.desc("matches"), F.desc("offset")))
    scored = every.join(voted, ["parent_id", "offset"], "left").withColumn("matches", F.coalesce("votes", F.lit(0).cast("long")))
    return scored.select("parent_id", "offset", "matches", (F.col("matches") / F.col("n")).alias("matching_ratio"), rank.alias("rank"))


def offset_report(df: DataFrame, parent: str, mutations: str = "mutations") -> DataFrame:
    """One row of the best placement: offset, matching_ratio, and the positions (from 1) that do not match with their letters in codes and parent.

    At most as many positions as the parent is long. A sketch longer than the parent is an error.
    """
    span = positions(df, mutations).agg((F.max("pos") - F.min("pos") + 1).alias("n")).first()
    if span["n"] is not None and span["n"] > len(parent):
        raise ValueError(f"the mutations span {span['n']} positions, the parent has {len(parent)}")
    best = offsets(df, parent, mutations).where("rank = 1").select("offset", "matching_ratio")
    there = F.substr(F.lit(parent), F.col("pos") + F.col("offset") + 1, F.lit(1))
    bad = positions(df, mutations).crossJoin(F.broadcast(best)).where(there != F.col("src")).select((F.col("pos") + 1).alias("pos"), "src", there.alias("par"))  # one row
    listed = bad.agg(F.array_sort(F.collect_list(F.struct("pos", "src", "par"))).alias("b"))
    each = lambda c: F.transform("b", lambda x: x[c])
    return best.crossJoin(listed).select("offset", "matching_ratio", each("pos").alias("non_match_pos"), each("src").alias("non_match_source"), each("par").alias("non_match_parent"))


def likely_offset(df: DataFrame, parent: str, mutations: str = "mutations") -> int:
    """The one offset at which all sources match the parent."""
    found = offsets(df, parent, mutations).where("matching_ratio = 1").take(2)
    if len(found) != 1:
        if found:
            raise ValueError("several offsets match all positions")
        r = offset_report(df, parent, mutations).first()
        raise ValueError("no offset matches all positions" + (f"; the best, {r['offset']}, differs at {r['non_match_pos']}" if r else ""))
    return found[0]["offset"]


def with_applied(df: DataFrame, mut_col: str, parent: str, offset: int | None = None, out: str = "applied", delimiter: str = "_") -> DataFrame:
    """``df`` and the sequence that each code makes of the parent; rows without mutations get the parent."""
    rows = df.withColumn("__mutations", parsed_or_null(F.col(mut_col), delimiter))
    if offset is None:
        offset = likely_offset(rows, parent, "__mutations")
    seq: Column = applied(F.col("__mutations"), F.lit(parent), offset)
    return rows.withColumn(out, F.when(F.col("__mutations").isNull(), F.when(is_unmutated(F.col(mut_col)), F.lit(parent))).otherwise(seq)).drop("__mutations")


def apply_all(df: DataFrame, parent: str | None = None, offset: int | None = None, out: str = "applied") -> DataFrame:
    """``df`` and the sequence of each code; the parent is that of the wild type row, the offset estimated, unless they are given.

    More than one row without mutations is an error, as is an empty table.
    """
    mut_col = mutation_column(df.columns)
    if mut_col is None:
        raise ValueError("no sequence column with codes")
    bare = df.where(is_unmutated(F.col(mut_col)) | F.contains(F.col(mut_col), F.lit("wildtype"))).limit(2).count()
    if bare > 1:
        raise ValueError("more than one row without mutations")
    if df.isEmpty():
        raise ValueError("an empty table")
    parent = parent_sequence(df, mut_col.replace("_mut", "_seq"), mut_col) if parent is None else parent
    return with_applied(df, mut_col, parent, offset, out)


def filled(df: DataFrame, seq_col: str = "aa_seq", mut_col: str = "aa_mut", parent: str | None = None, offset: int | None = None) -> DataFrame:
    """Missing sequences from the parent and the codes of the same family."""
    parent = parent_sequence(df, seq_col, mut_col) if parent is None else parent
    done = with_applied(df, mut_col, parent, offset, "__applied")
    return done.withColumn(seq_col, F.coalesce(seq_col, "__applied")).drop("__applied")


def pairs_between(a: DataFrame, b: DataFrame, key: str, mutations: str = "mutations", *, check: bool = True) -> DataFrame:
    """Each variant of ``a`` combined with each of ``b`` (the product is what is asked for)."""
    left = a.select(F.col(key).alias("a"), F.col(mutations).alias("__a"))
    right = b.select(F.col(key).alias("b"), F.col(mutations).alias("__b"))
    return left.crossJoin(right).select("a", "b", combined(F.col("__a"), F.col("__b"), check=check).alias(mutations))


def pairs_within(df: DataFrame, key: str, mutations: str = "mutations", *, check: bool = True, few: DataFrame | None = None) -> DataFrame:
    """Each pair of variants combined, the smaller key first; with ``few``, some rows of ``df``, the pairs that have one of them at least.

    All pairs are quadratic in the rows; ``few`` is broadcast.
    """
    if few is not None:
        named = few.select(F.col(key).alias("__k"), F.lit(True).alias("__named"))
        side = few.select(F.col(key).alias("__o"), F.col(mutations).alias("__y"))
        rows = df.select(F.col(key).alias("__i"), F.col(mutations).alias("__x"))
        met = rows.join(F.broadcast(named), F.col("__i") == F.col("__k"), "left").crossJoin(F.broadcast(side))
        first = F.col("__i") < F.col("__o")
        met = met.where(first | ((F.col("__i") > F.col("__o")) & F.col("__named").isNull()))  # a pair of two named rows once
        ends = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(n) for n, x, y in (("a", "__i", "__o"), ("b", "__o", "__i"), ("__a", "__x", "__y"), ("__b", "__y", "__x"))]
        return met.select(*ends).select("a", "b", combined(F.col("__a"), F.col("__b"), check=check).alias(mutations))
    left = df.select(F.col(key).alias("a"), F.col(mutations).alias("__a"))
    right = df.select(F.col(key).alias("b"), F.col(mutations).alias("__b"))
    return left.join(right, F.col("a") < F.col("b")).select("a", "b", combined(F.col("__a"), F.col("__b"), check=check).alias(mutations))
