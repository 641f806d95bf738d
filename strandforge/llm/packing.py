"""Best-fit packing of tokenised documents into sequences of bounded length.

Documents are encoded on the executors and cut into pieces only where they exceed the capacity. The packing itself
needs nothing but the number of pieces of each length, a table of at most ``capacity`` rows, so the driver plans on
that histogram, whatever the corpus size:

* pieces above one third of the capacity are matched greedily, the longest with the longest partner that still fits,
  two per sequence at most;
* shorter pieces go, longest first, each into the tightest gap that holds it, and into new sequences when none does.

The plan says, for each length, which run of ranks goes to which run of sequences at which offset. A piece's rank among
those of its length comes from its place in its input split plus a prefix sum over splits, so no length, however
frequent, is gathered in one task.

Nulls and edge cases: a null or empty text is a document of the end id alone; a null ``doc_id`` is carried through;
repeated rows are packed each; pieces of equal length are interchangeable and take their places in the order of their input
split; a very long text is encoded whole and cut into pieces; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, slices, stash
from .wordbpe import encoder, with_ends

#: Bytes of text encoded at a time: a byte takes some thirty of numbers, words and ids.
TEXT_STEP = 2 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, split int, place long"


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most ``capacity`` ids; ``place`` counts the pieces of a length within an input split."""
    bound_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)  # pieces of each length so far
        for batch in slices(batches, limit=TEXT_STEP):
            ids, ends = encoder(path).encode(batch.column(1))
            whole = with_ends(ids, ends, end_id)
            sizes = np.diff(ends, prepend=0) + 1
            parts = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), parts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * capacity
            length = np.minimum(sizes[doc] - start, capacity)
            begin = (np.cumsum(sizes) - sizes)[doc] + start
            raw = memoryview(whole).cast("B")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * begin).tolist(), (4 * (begin + length)).tolist(), strict=True)]
            # rank among the pieces of a length: in order of length, places behind the first of each
            order = np.argsort(length, kind="stable")
            sorted_ = length[order]
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order)) - np.searchsorted(sorted_, sorted_) + seen[sorted_]
            seen += np.bincount(length, minlength=capacity + 1)
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), split, np.int32)), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "split", "place"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first sequence, offset): ranks in a row of a length go to sequences in a row."""
    left = {n: c for n, c in counts.items() if c}
    used: Counter[int] = Counter()
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first sequence, number)
    free = np.zeros(capacity + 1, np.int64)
    sequences = 0

    def put(length: int, first: int, number: int, offset: int) -> None:
        out.append((length, used[length], number, first, offset))
        used[length] += number
        left[length] -= number

    def leave(gap: int, first: int, number: int) -> None:
        if gap and number:
            gaps[gap].append((first, number))
            free[gap] += number

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for length in large:
        while left[length]:
            partner = next((p for p in large if p <= capacity - length and left[p] > (p == length)), None)
            number = left[length] if partner is None else left[length] // 2 if partner == length else min(left[length], left[partner])
            put(length, sequences, number, 0)
            if partner is not None:
                put(partner, sequences, number, length)
            leave(capacity - length - (partner or 0), sequences, number)
            sequences += number

    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            fits = np.flatnonzero(free[length:])
            if len(fits):
                gap = length + int(fits[0])
                first, there = gaps[gap].pop()
                free[gap] -= there
            else:
                gap, first, there = capacity, sequences, -(-left[length] // (capacity // length))
                sequences += there
            copies = min(gap // length, left[length])
            number = min(there, left[length] // copies)
            for n in range(copies):
                put(length, first, number, capacity - gap + n * length)
            leave(gap - copies * length, first, number)
            leave(gap, first + number, there - number)
    return out


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document."""
    cut = stash(pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    per_split = cut.groupBy("length", "split").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in per_split.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    steps = sorted(plan(counts, capacity))
    table = np.array(steps, np.int64).reshape(-1, 5)
    bounds = {n: (int(a), int(b)) for n, a, b in zip(*(lambda u: (u[0].tolist(), u[1], u[1] + u[2]))(np.unique(table[:, 0], return_index=True, return_counts=True)), strict=True)}

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def assign(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks, row = length.to_numpy(), rank.to_numpy(), np.zeros(len(length), np.int64)
        for n in np.unique(lengths):
            a, b = bounds[int(n)]
            row[lengths == n] = a + np.searchsorted(table[a:b, 1], ranks[lengths == n], "right") - 1
        return pd.DataFrame({"sequence_id": table[row, 3] + ranks - table[row, 1], "offset": table[row, 4]})

    before = F.sum("n").over(Window.partitionBy("length").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_split.select("length", "split", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = cut.join(offsets, ["length", "split"]).withColumn("at", assign("length", F.col("before") + F.col("place")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
