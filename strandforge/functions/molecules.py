"""Numbers for molecules and residues as Column builders: protons of atoms, carbon atoms of a protein, places of SMILES symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabets import AMINO, CARBON, PROTONS, RNA_STOP, SMILES_INDEX


def protons(symbols: Column) -> Column:
    """Protons of each element in an array of symbols; null for what is no element."""
    table = F.create_map(*(F.lit(x) for pair in PROTONS.items() for x in pair))
    return F.transform(symbols, lambda s: F.try_element_at(table, F.initcap(s)))


def carbon_atoms(seq: Column) -> Column:
    """Carbon atoms of a protein's residues; other symbols count none."""
    return sum(((F.length(seq) - F.length(F.replace(seq, F.lit(a), F.lit("")))) * CARBON[a] for a in AMINO[1:]), (F.length(seq) - F.length(F.replace(seq, F.lit(AMINO[0]), F.lit("")))) * CARBON[AMINO[0]])


def smiles_places(seq: Column) -> Column:
    """Place of each symbol of a SMILES string in its alphabet, the blank at 0; null for other symbols."""
    table = F.create_map(*(F.lit(x) for pair in SMILES_INDEX.items() for x in pair))
    return F.transform(F.split(seq, ""), lambda s: F.try_element_at(table, s))


def rna_places(seq: Column) -> Column:
    """Place of each base of an RNA sequence in its alphabet with the stop, from 1; 0 for other symbols."""
    return F.transform(F.split(seq, ""), lambda s: F.instr(F.lit(RNA_STOP), s))
