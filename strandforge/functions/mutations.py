"""Mutation codes as Column builders. A mutation is struct<pos: int (from 0), src: string, targ: string>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MUTATIONS = "array<struct<pos: int, src: string, targ: string>>"
# Codes that stand for no mutation; the form of one mutation.
UNMUTATED = ("wildtype (wt)", "wildtype", "", "wt", "-", "none")
FORM = r"^([a-zA-Z])\s*([0-9]+)\s*([a-zA-Z])$"


def by_position(mutations: Column) -> Column:
    """Mutations in order of position; equal positions keep their order."""
    numbered = F.transform(mutations, lambda m, i: F.struct(m["pos"].alias("pos"), i.alias("i"), m.alias("m")))
    return F.transform(F.array_sort(numbered), lambda x: x["m"])


def parsed_code(code: Column, delimiter: str = "_", offset: int = 0, form: str = FORM) -> Column:
    """Mutations of a code such as ``C2X_E4Y``; a code that names the wild type has none, a malformed one is an error."""
    parts = F.transform(F.split(code, f"\\Q{delimiter}\\E"), F.trim)
    good = lambda p: F.when(p.rlike(form), p).otherwise(F.raise_error(F.concat(F.lit("malformed mutation: "), p)).cast("string"))
    one = lambda p: F.struct(
        (F.regexp_extract(p, form, 2).cast("int") - 1 + offset).cast("int").alias("pos"), F.regexp_extract(p, form, 1).alias("src"), F.regexp_extract(p, form, 3).alias("targ")
    )
    none = F.array().cast(MUTATIONS)
    return F.when(F.contains(code, F.lit("wildtype")), none).otherwise(by_position(F.transform(F.transform(parts, good), one)).cast(MUTATIONS))


def is_unmutated(code: Column) -> Column:
    return F.lower(F.trim(code)).isin(*UNMUTATED)


def parsed_or_null(code: Column, delimiter: str = "_", offset: int = 0) -> Column:
    """Mutations of a code, null where the code stands for none."""
    return F.when(~is_unmutated(code), parsed_code(code, delimiter, offset))


def applied(mutations: Column, parent: Column, offset: Column | int = 0, *, check: bool = False) -> Column:
    """``parent`` with each mutation's letter put in its place; ``check``: the source letter must stand there."""
    shift = F.lit(offset) if isinstance(offset, int) else offset

    def put(seq: Column, m: Column) -> Column:
        at = m["pos"] + shift
        out = F.concat(F.substr(seq, F.lit(1), at), m["targ"], F.substr(seq, at + 2))
        if not check:
            return out
        return F.when(F.substr(seq, at + 1, F.lit(1)) == m["src"], out).otherwise(F.raise_error(F.concat(F.lit("source letter differs at "), at.cast("string"))).cast("string"))

    return F.aggregate(mutations, parent, put)


def extracted(variant: Column, parent: Column, offset: int = 0) -> Column:
    """Mutations that lead from ``parent`` to ``variant``; null where their lengths differ.

    One-element arrays bind both sequences and their characters, so that each is computed once per row.
    """

    def between(v: Column, p: Column) -> Column:
        pairs = F.arrays_zip(F.split(p, "").alias("src"), F.split(v, "").alias("targ"))
        every = F.transform(pairs, lambda x, i: F.struct((i - offset).cast("int").alias("pos"), x["src"].alias("src"), x["targ"].alias("targ")))
        return F.when(F.length(v) == F.length(p), F.filter(every, lambda m: m["src"] != m["targ"]).cast(MUTATIONS))

    return F.transform(F.array(F.struct(variant.alias("v"), parent.alias("p"))), lambda x: between(x["v"], x["p"]))[0]


def extracted_code(variant: Column, parent: Column, delimiter: str = "_", offset: int = 0) -> Column:
    """Code of the mutations that lead from ``parent`` to ``variant``."""
    return code_of(extracted(variant, parent, offset), delimiter)


def code_of(mutations: Column, delimiter: str = "_", offset: int = 0) -> Column:
    """Code of mutations, in order of position."""
    return F.array_join(F.transform(by_position(mutations), lambda m: F.concat(m["src"], (m["pos"] - offset + 1).cast("string"), m["targ"])), delimiter)


def as_arrays(mutations: Column) -> Column:
    """struct<position, source, target> of three arrays."""
    return F.struct(mutations["pos"].alias("position"), mutations["src"].alias("source"), mutations["targ"].alias("target"))


def from_arrays(arrays: Column) -> Column:
    at = lambda i: F.struct(F.get(arrays["position"], i).cast("int").alias("pos"), F.get(arrays["source"], i).alias("src"), F.get(arrays["target"], i).alias("targ"))
    return F.transform(arrays["position"], lambda _, i: at(i)).cast(MUTATIONS)


def combined(first: Column, second: Column, *, check: bool = True) -> Column:
    """Mutations of both. At a shared position the targets are concatenated, one mutation per letter of the second's
    target; the sources must agree unless ``check`` is off, which concatenates them too."""

    def meet(a: Column, b: Column) -> Column:
        src = F.when(a["src"] == b["src"], a["src"]).otherwise(F.raise_error(F.concat(F.lit("sources differ at "), a["pos"].cast("string"))).cast("string")) if check else F.concat(a["src"], b["src"])
        return F.transform(F.split(b["targ"], ""), lambda t: F.struct(a["pos"].alias("pos"), src.alias("src"), F.concat(a["targ"], t).alias("targ")))

    at = lambda ms, m: F.filter(ms, lambda x: x["pos"] == m["pos"])
    own = F.filter(first, lambda m: F.size(at(second, m)) == 0)
    new = F.filter(second, lambda m: F.size(at(first, m)) == 0)
    both = F.flatten(F.flatten(F.transform(first, lambda a: F.transform(at(second, a), lambda b: meet(a, b)))))
    return by_position(F.concat(own.cast(MUTATIONS), both.cast(MUTATIONS), new.cast(MUTATIONS))).cast(MUTATIONS)


def concatenated(lists: Column) -> Column:
    """One list of the mutations of several, in the order given."""
    return F.flatten(lists)


def mutation_column(columns: list[str]) -> str | None:
    """Column with a table's codes: that of the DNA sequence before that of the protein."""
    for family in ("dna", "aa"):
        if {f"{family}_seq", f"{family}_mut"} <= set(columns):
            return f"{family}_mut"
    return None


def checked_mutation(found: tuple[int, str, str]) -> tuple[int, str, str]:
    """A mutation given as a tuple, or a TypeError."""
    if not (isinstance(found, tuple) and len(found) == 3 and isinstance(found[0], int) and isinstance(found[1], str) and isinstance(found[2], str)):
        raise TypeError("a mutation is (position, source, target)")
    return found


def as_mutation(found: tuple[int, str] | tuple[int, str, str]) -> tuple[int, str, str | None]:
    """(position, source, target) of a mutation given with or without a target. What is no tuple of two or three is an error."""
    if not isinstance(found, tuple):
        raise TypeError("a mutation is a tuple")
    if len(found) not in (2, 3):
        raise ValueError("a mutation is (position, source) or (position, source, target)")
    return checked_mutation(found) if len(found) == 3 else (*checked_mutation((*found, ""))[:2], None)


def variants_table(spark: SparkSession, variants: list[list[tuple]], out: str = "mutations") -> DataFrame:
    """index and an array of mutations for each variant given as tuples; those without a target have a null one.

    Positions, sketches and offsets need no targets; applying such a mutation gives null.
    """
    rows = [(i, [as_mutation(m) for m in v]) for i, v in enumerate(variants)]
    return spark.createDataFrame(rows, f"index long, {out} {MUTATIONS}")
