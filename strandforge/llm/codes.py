"""Vector codes: each part of a vector becomes the index of the nearest entry of its part position's codebook.

Components are whole numbers floor(4096 * x). Codebooks begin as the parts of the first vectors and are refined in rounds:
every task assigns its rows' parts and sums them by entry, the sums of all tasks merge by position and entry, and only
these, of a fixed number, reach the driver for the next round. Nothing else leaves the executors.

The nearest entry is searched in a vantage-point tree over the entries of a part position: a node holds one entry, its
two children those within and beyond the median distance from it, each with the least and the largest such distance. A
part goes down the nearer child first and visits the other only if that can hold an entry as near as the best one. Bounds
are whole numbers, rounded towards visiting, and an equal bound is visited; distances themselves are compared as exact
squared integers, equal ones by the lower index. So the result is that of comparing all entries.

Nulls and edge cases: vectors that are null, or hold null or non-finite components, take no part; a null id is kept, and comes
after all others; of equal ids the smaller vector comes first; vectors shorter than the longest, or than a multiple of the
number of parts, count as padded with zeros; with fewer vectors than entries a codebook has as many entries as there are
vectors; equal entries give the lower index; components beyond the bound of `most`, from which squared distances would
not fit 64 bits, are held there; error sums beyond 64 bits are held at the largest number; an empty table gives no rows; rows
with a null label share one sum; other columns are ignored, whatever their names; there are no texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, looked_up, stash

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows whose parts are searched at a time.
ROWS = 4096
LARGEST = (1 << 63) - 1


def most(width: int) -> int:
    """The largest component of parts of ``width`` components, so that eight squared distances fit 62 bits."""
    return math.isqrt((1 << 59) // max(width, 1)) // 2


@dataclass(frozen=True)
class Node:
    """An entry, and (least distance, largest distance, node) of its two children; distances rounded outwards to whole numbers."""

    entry: int
    children: tuple[tuple[float, float, Node], ...]


def _roots(squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers below and above the roots of squared distances, not too near."""
    root = np.sqrt(squared.astype(np.float64))
    return np.floor(root * (1 - 1e-12)), np.ceil(root * (1 + 1e-12))


def squared_distances(rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
    apart = rows - entry
    return np.einsum("ij,ij->i", apart, apart)


def vantage_tree(entries: np.ndarray, of: np.ndarray | None = None) -> Node | None:
    """The tree over the entries numbered ``of``; the entry that is farthest from the first is the vantage point."""
    of = np.arange(len(entries)) if of is None else of
    if not len(of):
        return None
    top = int(of[np.argmax(squared_distances(entries[of], entries[of[0]]))])
    rest = of[of != top]
    squared = squared_distances(entries[rest], entries[top])
    order = np.argsort(squared, kind="stable")
    low, high = _roots(squared[order])
    half = (len(rest) + 1) // 2
    cuts = [s for s in (slice(0, half), slice(half, len(rest))) if len(rest[s])]
    return Node(top, tuple((float(low[s].min()), float(high[s].max()), vantage_tree(entries, rest[order[s]])) for s in cuts))


def nearest(rows: np.ndarray, entries: np.ndarray, tree: Node | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, its squared distance, distances computed) for each row."""
    best, least = np.full(len(rows), len(entries)), np.full(len(rows), LARGEST)
    seen = 0

    def visit(node: Node, at: np.ndarray) -> None:
        nonlocal seen
        if not len(at):
            return
        squared = squared_distances(rows[at], entries[node.entry])
        seen += len(at)
        better = (squared < least[at]) | ((squared == least[at]) & (node.entry < best[at]))
        least[at[better]], best[at[better]] = squared[better], node.entry
        low, high = _roots(squared)
        # the least distance that an entry of a child can have
        bounds = [np.maximum(low - far, near - high) for near, far, _ in node.children]
        first = bounds[1] < bounds[0] if len(bounds) == 2 else np.zeros(len(at), bool)
        for turn in range(len(bounds)):
            for n, (_, _, child) in enumerate(node.children):
                own = at[first == (n != turn)]
                visit(child, own[bounds[n][first == (n != turn)] <= _roots(least[own])[1]])

    if (tree := tree or vantage_tree(entries)) is not None:
        visit(tree, np.arange(len(rows)))
    return best, least, seen


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS) -> tuple[DataFrame, int]:
    """(vec_id, label, v: whole numbers of one length; that length) of the vectors that take part."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts) * parts
    bound = most(width // parts)
    # held in doubles first: what lies beyond 64 bits cannot be cast
    whole = F.transform("v", lambda x: F.floor(F.least(F.greatest(x * F.lit(float(scale)), F.lit(-float(bound))), F.lit(float(bound)))).cast("long"))
    return rows.select("vec_id", "label", F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))).alias("v")), width


def _matrix(batch: pa.RecordBatch, parts: int, width: int) -> np.ndarray:
    """(rows, parts, components) of the column ``v``."""
    return batch.column(batch.schema.get_field_index("v")).flatten().to_numpy().reshape(batch.num_rows, parts, width // parts)


def _assigned(rows: np.ndarray, books: np.ndarray, trees: list[Node | None]) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, squared distances) of each row's parts."""
    found = [nearest(np.ascontiguousarray(rows[:, p]), book, tree)[:2] for p, (book, tree) in enumerate(zip(books, trees, strict=True))]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry the floored mean of its parts, an entry without parts as before."""
    parts, entries, size = books.shape
    trees = [vantage_tree(book) for book in books]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
        for batch in _cut(batches):
            m = _matrix(batch, parts, parts * size)
            index, _ = _assigned(m, books, trees)
            for p in range(parts):
                counts[p] += np.bincount(index[:, p], minlength=entries)
                np.add.at(total[p], index[:, p], m[:, p])
        part, entry = np.nonzero(counts)
        values = [part.astype(np.int32), entry.astype(np.int32), counts[part, entry]]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * size, pa.int32()), pa.array(total[part, entry].ravel()))
        yield pa.RecordBatch.from_arrays([*map(pa.array, values), lists], names=["part", "entry", "n", "total"])

    own = rows.select("v").mapInArrow(sums, "part int, entry int, n long, total array<long>")
    add = F.array(*(F.sum(F.get("total", F.lit(i))) for i in range(size)))
    out = books.copy()
    for r in own.groupBy("part", "entry").agg(F.sum("n").alias("n"), add.alias("total")).collect():  # parts x entries rows at most
        out[r["part"], r["entry"]] = np.array(r["total"], np.int64) // r["n"]
    return out


def codebooks(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(parts, entries, components) of the codebooks of integer vectors."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()  # that many rows
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    for _ in range(rounds if len(first) else 0):
        books = refined(rows, books)
    return books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each vector that takes part."""
    bound_batches(vectors.sparkSession)
    whole, width = integer_vectors(vectors, id_col, vector_col, label_col, scale, parts)
    rows = stash(whole, "parts")
    books = codebooks(rows, width, parts, entries, rounds)
    trees = [vantage_tree(book) for book in books]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            index, squared = _assigned(_matrix(batch, parts, width), books, trees)
            codes = pa.array([bytes(x).hex() for x in index.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, pa.array(squared.sum(1))], names=["vec_id", "label", "code", "error"])

    kind = dict(rows.dtypes)["vec_id"]
    # a null label is a label
    label = F.struct(F.coalesce("label", F.lit("")).alias("text"), F.col("label").isNull().alias("none")).alias("label")
    errors = stash(rows.mapInArrow(coded, f"vec_id {kind}, label string, code string, error long").select("vec_id", label, "code", "error"), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    sums = stash(errors.groupBy("label").agg(total.alias("label_error"), F.count("*").alias("n")), "labels")
    return looked_up(errors, sums, ["label"], "n").select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
