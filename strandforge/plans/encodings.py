"""Feature planning: what provides what, in which order, and applying it as chained projections."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandforge.functions import sequences
from strandforge.functions.alphabets import AA, DNA_STOP, SMILES
from strandforge.operators import graphs, kernels


@dataclass(frozen=True)
class Encoding:
    """``func`` adds the columns ``provides`` to a table that has ``requires``."""

    provides: tuple[str, ...]
    requires: tuple[str, ...]
    func: Callable[[DataFrame], DataFrame] = field(compare=False)
    expensive: bool = False

    def __post_init__(self) -> None:
        if isinstance(self.provides, str) or isinstance(self.requires, str):
            raise TypeError("provides and requires are tuples of names")


def _one_hot(column: str, alphabet: str, out: str) -> Callable[[DataFrame], DataFrame]:
    def apply(df: DataFrame) -> DataFrame:
        longest = df.agg(F.max(F.length(column))).first()[0] or 0  # one number
        return df.withColumn(out, sequences.one_hot(F.col(column), alphabet, longest))

    return apply


def _column(out: str, build: Callable[[], F.Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn(out, build())


def external(out: str, source: str, model: Callable[[DataFrame, str, str], DataFrame] | None = None) -> Callable[[DataFrame], DataFrame]:
    """An embedding by a model that is passed in; without one, asking for it is an error."""

    def apply(df: DataFrame) -> DataFrame:
        if model is None:
            raise NotImplementedError(f"{out} needs a pretrained model: pass one to registry()")
        return model(df, source, out)

    return apply


def batched_model(load: Callable[[], Any], encode: Callable[[Any, list[str]], list], size: int = 100, kind: str = "array<array<float>>") -> Callable[[DataFrame, str, str], DataFrame]:
    """A model for ``registry``: ``load`` runs once in each worker task, ``encode`` gets the model and ``size`` sequences at a time.

    Nulls stay null; what is no string is an error. ``kind`` is the type of one sequence's embedding.
    """
    if size < 1:
        raise ValueError("batches have one sequence at least")

    def apply(df: DataFrame, source: str, out: str) -> DataFrame:
        if dict(df.dtypes)[source] != "string":
            raise TypeError(f"{source} does not hold strings")

        @F.pandas_udf(kind)
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for part in parts:
                known = part[part.notna()]
                found: list = []
                for at in range(0, len(known), size):
                    found += encode(model, known.iloc[at : at + size].tolist())
                plain = [x.tolist() if hasattr(x, "tolist") else x for x in found]
                yield pd.Series(pd.Series(plain, index=known.index, dtype=object).reindex(part.index).where(part.notna(), None))

        return df.withColumn(out, run(F.col(source)))

    return apply


def registry(models: dict[str, Callable[[DataFrame, str, str], DataFrame]] | None = None) -> list[Encoding]:
    m = models or {}
    mean = lambda source, out: _column(out, lambda: kernels.mean_over_positions(F.col(source)))
    return [
        Encoding(("atm_count", "bnd_count"), ("bnd_idcs",), graphs.with_counts),
        Encoding(("atm_adj",), ("atm_count", "bnd_count"), graphs.with_adjacency),
        Encoding(("atm_bnd_incid",), ("atm_count", "bnd_count"), graphs.with_incidence),
        Encoding(("atm_retprob100",), ("atm_adj",), graphs.with_return_probabilities, expensive=True),
        Encoding(("aa_unirep_1900",), ("aa_seq",), external("aa_unirep_1900", "aa_seq", m.get("aa_unirep_1900")), expensive=True),
        Encoding(("aa_unirep_final",), ("aa_seq",), external("aa_unirep_final", "aa_seq", m.get("aa_unirep_final")), expensive=True),
        Encoding(("aa_seq",), ("dna_seq",), _column("aa_seq", lambda: sequences.translated(F.col("dna_seq")))),
        Encoding(("aa_1hot",), ("aa_seq",), _one_hot("aa_seq", AA, "aa_1hot")),
        Encoding(("dna_1hot",), ("dna_seq",), _one_hot("dna_seq", DNA_STOP, "dna_1hot")),
        Encoding(("smiles_1hot",), ("smiles_seq",), _one_hot("smiles_seq", SMILES, "smiles_1hot")),
        Encoding(("aa_len",), ("aa_seq",), _column("aa_len", lambda: F.length("aa_seq"))),
        Encoding(("dna_len",), ("dna_seq",), _column("dna_len", lambda: F.length("dna_seq"))),
        Encoding(("aa_1gram",), ("aa_seq",), _column("aa_1gram", lambda: sequences.symbol_counts(F.col("aa_seq"), AA))),
        Encoding(("aa_ankh_base",), ("aa_seq",), external("aa_ankh_base", "aa_seq", m.get("aa_ankh_base")), expensive=True),
        Encoding(("aa_esm2_t6_8M",), ("aa_seq",), external("aa_esm2_t6_8M", "aa_seq", m.get("aa_esm2_t6_8M")), expensive=True),
        Encoding(("aa_ankh_avg",), ("aa_ankh_base",), mean("aa_ankh_base", "aa_ankh_avg"), expensive=True),
        Encoding(("aa_esm2_avg",), ("aa_esm2_t6_8M",), mean("aa_esm2_t6_8M", "aa_esm2_avg"), expensive=True),
    ]


def order(encodings: list[Encoding], provided: Iterable[str], wanted: Iterable[str], *, strict: bool = True) -> list[Encoding]:
    """The encodings to run, each after those it needs. Not strict: names that cannot be had are left out."""
    have, makers = set(provided), {p: e for e in encodings for p in e.provides}
    done: list[Encoding] = []

    def reach(name: str, path: tuple[str, ...]) -> list[Encoding] | None:
        if name in have or any(name in e.provides for e in done):
            return []
        maker = makers.get(name)
        if maker is None or name in path:
            return None
        out: list[Encoding] = []
        for need in maker.requires:
            found = reach(need, (*path, name))
            if found is None:
                return None
            out += [e for e in found if e not in out]
        return [*out, maker]

    for name in wanted:
        found = reach(name, ())
        if found is None:
            if strict:
                raise ValueError(f"{name} cannot be had from {sorted(have)}")
            continue
        done += [e for e in found if e not in done]
    return done


def within_reach(names: Iterable[str], provided: Iterable[str]) -> list[str]:
    """Names worth trying: graph features need edges, molecule features a molecule; a table with proteins gets no DNA features, one with
    DNA only no protein features, and a table with neither no others."""
    have = list(provided)
    first = next((f for f in ("aa", "dna") if any(p.startswith(f) for p in have)), None)
    other = {"aa": "dna", "dna": "aa"}.get(first)
    graph, molecule = "bnd_idcs" in have, "smiles_seq" in have

    def useful(name: str) -> bool:
        if name.startswith(("atm", "bnd")):
            return graph
        if name.startswith("smiles"):
            return molecule
        return first is not None and not name.startswith(other)

    return [n for n in names if useful(n)]


def plan_table(spark: SparkSession, provided: Iterable[str], wanted: list[str] | None = None) -> DataFrame:
    """step, provides, requires: the plan of a table with the columns ``provided``."""
    table = registry()
    names = wanted or sorted(p for e in table if not e.expensive for p in e.provides)
    steps = order(table, list(provided), names if wanted else within_reach(names, provided), strict=bool(wanted))
    return spark.createDataFrame([(n, ",".join(e.provides), ",".join(e.requires)) for n, e in enumerate(steps)], "step int, provides string, requires string")


def encoded(df: DataFrame, wanted: list[str] | None = None, encodings: list[Encoding] | None = None) -> DataFrame:
    """``df`` with the wanted feature columns, or with all that can be had cheaply if none are named."""
    if wanted is not None and not isinstance(wanted, list):
        raise TypeError("wanted is a list of names")
    table = encodings or registry()
    names = wanted or within_reach(sorted(p for e in table if not e.expensive for p in e.provides), df.columns)
    for step in order(table, df.columns, names, strict=bool(wanted)):
        df = step.func(df)
    return df
