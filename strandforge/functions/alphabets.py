"""Symbol sets of sequences and molecules."""

from __future__ import annotations

# Symbols, the standard genetic code in TCAG order, carbon atoms, background shares of residues.
AMINO = "ACDEFGHIKLMNPQRSTVWY"
STOP, PAD = "*", " "
DNA, RNA = "ACGT", "ACGU"
SMILES = "#%()+-./0123456789=@ABCFHIKLMNOPRSTVXZ[\\]abcegilnoprstu"
ATOMS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe"
    " Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr"
    " Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CARBON = {"A": 3, "C": 3, "D": 4, "E": 5, "F": 9, "G": 2, "H": 6, "I": 6, "K": 6, "L": 6, "M": 5, "N": 4, "P": 5, "Q": 5, "R": 6, "S": 3, "T": 4, "V": 5, "W": 11, "Y": 9}
BACKGROUND = {
    "A": 0.0777, "C": 0.0157, "D": 0.0530, "E": 0.0656, "F": 0.0405, "G": 0.0691, "H": 0.0227, "I": 0.0591, "K": 0.0595, "L": 0.0960,
    "M": 0.0238, "N": 0.0427, "P": 0.0469, "Q": 0.0393, "R": 0.0526, "S": 0.0694, "T": 0.0550, "V": 0.0667, "W": 0.0118, "Y": 0.0311,
}
# What the ambiguous nucleotide letters stand for.
AMBIGUOUS = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}

AA, DNA_STOP, RNA_STOP = AMINO + STOP, DNA + STOP, RNA + STOP
#: Protons of an element; its last one, Oganesson, included.
PROTONS = {symbol: n + 1 for n, symbol in enumerate(ATOMS)}
SMILES_INDEX = {symbol: n for n, symbol in enumerate(PAD + SMILES)}


def codons() -> dict[str, str]:
    """Amino acid of each of the 64 codons."""
    return {a + b + c: CODE[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def amino_of(codon: str) -> str | None:
    """Amino acid of a codon with ambiguous letters: X where it may be several, None where a letter is unknown."""
    table, found = codons(), {""}
    for letter in codon.upper().replace("U", "T"):
        choices = AMBIGUOUS.get(letter, letter if letter in DNA else "")
        found = {f + x for f in found for x in choices}
    acids = {table[f] for f in found if len(f) == 3}
    return None if not acids else acids.pop() if len(acids) == 1 else "X"
