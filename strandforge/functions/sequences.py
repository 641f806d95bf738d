"""Sequence features as Column builders: lengths, symbol counts, one-hot rows, translation, composition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabets import AMINO, BACKGROUND, PAD, codons

# Letters of nucleotide codes, the ambiguous ones and gaps included.
NUCLEOTIDES = "ACGTURYKMSWBDHVN.X"


def seq_length(seq: Column) -> Column:
    return F.length(seq)


def symbol_counts(seq: Column, alphabet: str) -> Column:
    """Array of the number of times each symbol occurs, in alphabet order; other symbols are ignored."""
    return F.transform(F.array(seq), lambda s: _counts(s, alphabet))[0]  # the array binds the sequence


def _counts(seq: Column, alphabet: str) -> Column:
    """By bytes, whose number a text knows: no text is walked to count its characters."""
    left = lambda c: F.octet_length(F.replace(seq, c, F.lit("")))
    return F.transform(F.split(F.lit(alphabet), ""), lambda c: ((F.octet_length(seq) - left(c)) / F.octet_length(c)).cast("int"))


def kmers(seq: Column, k: int) -> Column:
    """Array of the overlapping k-mers of a sequence; empty if it is shorter.

    The one-element array binds the characters: ``substr`` would walk the whole string anew for each window.
    """
    n = F.length(seq) - (k - 1)
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    windows = F.transform(F.array(F.split(seq, "")), lambda c: F.transform(places, lambda i: F.array_join(F.slice(c, i, k), "")))[0]
    return F.when(n > 0, windows).otherwise(F.array().cast("array<string>"))


def ngram_counts(seq: Column, vocabulary: list[str]) -> Column:
    """Array of overlapping occurrences of each n-gram of the vocabulary."""
    found = {n: kmers(seq, n) for n in {len(v) for v in vocabulary}}
    return F.array(*(F.size(F.array_compact(F.transform(found[len(v)], _is(v)))) for v in vocabulary))


def ngrams(seq: Column, low: int, high: int) -> Column:
    """Array of the overlapping n-grams of every length from ``low`` to ``high``."""
    if not 1 <= low <= high:
        raise ValueError("lengths of n-grams are from 1 up")
    return F.concat(*(kmers(seq, n) for n in range(low, high + 1)))


def rows_to_flat(rows: Column) -> Column:
    """The concatenation of the rows of a matrix."""
    return F.flatten(rows)


def _is(value: str) -> Callable[[Column], Column]:
    """For transform: the value where it is this one, else null."""
    return lambda x: F.when(x == value, x)


def characters(seq: Column, length: Column | int | None = None, pad: str = "?") -> Column:
    """Array of single characters, padded on the right up to ``length``."""
    return F.split(seq if length is None else F.rpad(seq, F.lit(length) if isinstance(length, int) else length, pad), "")


def _known(seq: Column, alphabet: str) -> Column:
    strange = F.translate(seq, alphabet, "")
    return F.when(strange != "", F.raise_error(F.concat(F.lit("unknown symbols in sequence: "), strange)).cast("string")).otherwise(seq)


def symbol_places(seq: Column, alphabet: str) -> Column:
    """Array of each character's place in the alphabet, from 1: the ones of a one-hot matrix, of any length and without padding.

    A symbol outside of the alphabet is an error.
    """
    places = lambda s: F.transform(F.split(_known(s, alphabet), ""), lambda c: F.instr(F.lit(alphabet), c))
    return F.transform(F.array(seq), lambda s: F.when(s != "", places(s)).otherwise(F.array().cast("array<int>")))[0]  # the array binds the sequence


def one_hot(seq: Column, alphabet: str, length: int) -> Column:
    """``length`` rows of one byte per symbol: one look-up per position, zero rows for padding.

    A symbol outside of the alphabet, or a sequence longer than ``length``, is an error.
    """
    rows = [[0] * len(alphabet)] + [[int(i == j) for j in range(len(alphabet))] for i in range(len(alphabet))]
    table = F.array(*(F.array(*(F.lit(x).cast("tinyint") for x in r)) for r in rows))
    strange = F.translate(seq, alphabet + PAD, "")
    checked = F.when(strange != "", F.raise_error(F.concat(F.lit("unknown symbols in sequence: "), strange)).cast("string")).when(
        F.length(seq) > length, F.raise_error(F.lit(f"sequence longer than {length}")).cast("string")
    ).otherwise(seq)
    return F.transform(characters(checked, length, PAD), lambda c: F.get(table, F.instr(F.lit(alphabet), c)))


def flat_to_rows(flat: Column, width: int) -> Column:
    """Array of rows of ``width`` values from their concatenation."""
    rows = F.floor(F.size(flat) / width).cast("int")
    return F.when(rows > 0, F.transform(F.sequence(F.lit(0), F.greatest(rows - 1, F.lit(0))), lambda i: F.slice(flat, i * width + 1, width))).otherwise(F.array())


def translated(dna: Column, *, all_stops: bool = False) -> Column:
    """Protein of a coding sequence: whole codons, stops cut off at both ends (``all_stops``: anywhere).

    A codon with an unknown letter is an error. Ambiguous codons give their amino acid if it is certain, else X.
    """
    from .alphabets import AMBIGUOUS, amino_of

    letters = "ACGTU" + "".join(AMBIGUOUS)
    known = codons()
    known |= {a + b + c: x for a in letters for b in letters for c in letters if (x := amino_of(a + b + c)) not in (None, "X") and a + b + c not in known}
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    acid = lambda c: F.coalesce(F.try_element_at(table, c), F.when(c.rlike(f"^[{letters}]{{3}}$"), F.lit("X")).otherwise(F.raise_error(F.concat(F.lit("unknown codon "), c)).cast("string")))
    protein = F.array_join(F.transform(F.regexp_extract_all(F.upper(dna), F.lit("(?s)..."), F.lit(0)), acid), "")
    return F.replace(protein, F.lit("*"), F.lit("")) if all_stops else F.regexp_replace(protein, r"^\*+|\*+$", "")


def sequence_type(seq: Column) -> Column:
    """DNA, RNA, Protein, Ambiguous_Protein or Unknown."""
    upper = F.upper(seq)
    n = F.length(upper)
    share = lambda letters: (n - F.length(F.translate(upper, letters, ""))) / F.nullif(n, F.lit(0))
    coding = (n % 3 == 0) & (F.translate(upper, NUCLEOTIDES, "") == "")
    return (
        F.when(coding & (share("ATGC") > 0.99), "DNA")
        .when(coding & (share("AUGC") > 0.99), "RNA")
        .when(F.translate(upper, AMINO, "") == "", "Protein")
        .when(F.translate(upper, AMINO + "X", "") == "", "Ambiguous_Protein")
        .otherwise("Unknown")
    )


def js_distance(seq: Column) -> Column:
    """Jensen-Shannon distance between a sequence's residue shares and natural ones.

    One-element arrays bind values that are used several times, so that each is computed once per row.
    """
    return F.transform(F.array(seq), _distance)[0]


def _distance(seq: Column) -> Column:
    return F.transform(F.array(F.replace(F.upper(seq), F.lit("X"), F.lit(""))), _clean_distance)[0]


def _clean_distance(clean: Column) -> Column:
    counts = _counts(clean, AMINO)
    length = F.length(clean)
    total = sum(BACKGROUND.values())
    natural = F.array(*(F.lit(BACKGROUND[a] / total) for a in AMINO))
    part = lambda p, m: p * F.ln(p / m) / 2
    terms = lambda shares: F.zip_with(shares, natural, lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    shares = F.transform(F.array(F.transform(counts, lambda n: n / F.greatest(length, F.lit(1)) + F.lit(1e-16))), lambda x: F.transform(F.array(add(x)), lambda w: F.transform(x, lambda y: y / w))[0])
    return F.sqrt(F.greatest(add(terms(shares[0])), F.lit(0.0)))
