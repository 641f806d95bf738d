"""k-mer windows, averages over positions, Gram matrices and Nystrom features of sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandforge.functions.sequences import kmers, ngram_counts, ngrams
from strandforge.operators.lookup import looked_up
from strandforge.operators.splits import _fixed, with_index


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def linear_kernel(a: DataFrame, b: DataFrame, key: str, vector: str, most: int = 100_000) -> DataFrame:
    """a, b, value: inner products of all rows of both sides (the matrix is what is asked for).

    ``b`` is the small side: its vectors, ``most`` at most, are gathered into one matrix that every batch of ``a`` is multiplied with.
    """
    kind, side = dict(a.dtypes)[key], b.select(key, F.col(vector).cast("array<double>").alias("y")).limit(most + 1).toArrow()
    if len(side) > most:
        raise ValueError(f"the second side has more than {most} rows")
    if not len(side):
        return a.select(F.col(key).alias("a"), F.col(key).alias("b"), F.lit(0.0).alias("value")).where("false")
    names, matrix = side[key].to_numpy(), np.stack(side["y"].to_numpy())

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                values = np.stack(frame["x"].to_numpy()) @ matrix.T
                yield pd.DataFrame({"a": np.repeat(frame["a"].to_numpy(), len(names)), "b": np.tile(names, len(frame)), "value": values.ravel()})

    return a.select(F.col(key).alias("a"), F.col(vector).cast("array<double>").alias("x")).mapInPandas(multiply, f"a {kind}, b {dict(b.dtypes)[key]}, value double")


def mean_over_positions(matrix: Column) -> Column:
    """Average of the rows of an array<array<number>>."""
    total = F.aggregate(F.slice(matrix, 2, F.greatest(F.size(matrix) - 1, F.lit(0))), F.transform(matrix[0], lambda x: x.cast("double")), lambda s, r: F.zip_with(s, r, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(matrix))


def distinct_kmers(df: DataFrame, seq: str, k: int) -> DataFrame:
    """kmer, n: distinct windows of all sequences; a map-side combine shrinks them before the shuffle."""
    return df.select(F.explode(kmers(F.col(seq), k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


#: N-grams of a vocabulary at most that becomes one expression for each.
MOST_NGRAMS = 10_000
#: Symbols whose windows are counted at a time, of a sequence at least.
SYMBOLS = 1 << 20
#: Symbols of the n-grams of a vocabulary at most that every task holds (4 bytes each, and 16 for a gram); a larger one is joined.
HELD = 1 << 22


def coded_windows(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all texts, number of the text of each, code of the ``k`` symbols from each on, places from which these lie in one text)."""
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    code = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    one, windows = code, code
    for n in range(1, k):
        base = int(windows.max(initial=0)) + 1
        if base > (1 << 31):
            windows = np.unique(windows, return_inverse=True)[1].astype(np.int64)
            base = int(windows.max(initial=0)) + 1
        windows = windows[:-1] * (int(code.max(initial=0)) + 1) + one[n:] if len(windows) > 1 else windows[:0]
    return symbols, of, windows, np.flatnonzero(of[: len(windows)] == of[k - 1 :][: len(windows)])


def counted_windows(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all texts, number of the text, first place, number) of each distinct window of ``k`` symbols of each text."""
    symbols, of, windows, inside = coded_windows(texts, k)
    order = inside[np.lexsort((windows[inside], of[inside]))]
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(windows[order]) != 0) | (np.diff(of[order]) != 0)
    starts = np.flatnonzero(new)
    return symbols, of[order[starts]], order[starts], np.diff(np.append(starts, len(order)))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Keys and texts of two columns, about SYMBOLS symbols at a time, one row at least."""
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        ends = np.cumsum([0, *map(len, texts)])
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + SYMBOLS, "right")) - 1)
            yield batch.column(0).slice(at, stop - at), texts[at:stop]
            at = stop


def _strings(parts: np.ndarray) -> list[str] | np.ndarray:
    """Each row of code points as a string; numpy's own strings lose a NUL at the end."""
    k = parts.shape[1]
    if parts.all():
        return np.ascontiguousarray(parts).view(f"<U{k}").ravel()
    text = parts.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + k] for i in range(0, len(text), k)]


def row_ngrams(df: DataFrame, key: str, seq: str, low: int, high: int) -> DataFrame:
    """key, gram, n: how often each n-gram of ``low`` to ``high`` symbols occurs in the sequence of each row; nothing is shuffled."""
    if not 1 <= low <= high:
        raise ValueError("lengths of n-grams are from 1 up")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _pieces(batches):
            for k in range(low, high + 1):
                symbols, row, first, n = counted_windows(texts, k)
                parts = symbols[first[:, None] + np.arange(k)] if len(first) else np.zeros((0, k), np.uint32)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(_strings(parts), pa.string()), pa.array(n)], names=[key, "gram", "n"])

    return df.select(key, seq).mapInArrow(count, f"`{key}` {dict(df.dtypes)[key]}, gram string, n long")


def ngram_table(df: DataFrame, key: str, seq: str, low: int, high: int) -> DataFrame:
    """key, gram, n: how often each n-gram of ``low`` to ``high`` symbols occurs in the sequences of each key; the sparse form."""
    return row_ngrams(df, key, seq, low, high).groupBy(key, "gram").agg(F.sum("n").alias("n"))


def vocabulary_table(df: DataFrame, seq: str, low: int, high: int) -> DataFrame:
    """gram, id, n: the n-grams of all sequences, numbered in their order, and how often each occurs; of any size."""
    found = row_ngrams(df.select(F.lit(0).alias("__row"), seq), "__row", seq, low, high).groupBy("gram").agg(F.sum("n").alias("n"))
    return with_index(found, ["gram"], "id").select("gram", "id", "n")


def sparse_ngrams(df: DataFrame, key: str, seq: str, low: int, high: int, vocabulary: DataFrame | None = None) -> DataFrame:
    """key, size, indices, counts: each row's n-grams as a sparse vector over a vocabulary (gram, id, n), learned from the table unless it is given.

    A vocabulary of HELD symbols at most is broadcast: grams become ids where they are counted, and nothing is shuffled. With a larger
    one, which is never gathered, they do by a join in which frequent ones are salted. Grams outside of it are ignored. A row
    without any has empty arrays. ``key`` names each row once, ``gram`` each of the vocabulary's.
    """
    if not 1 <= low <= high:
        raise ValueError("lengths of n-grams are from 1 up")
    given = vocabulary_table(df, seq, low, high) if vocabulary is None else vocabulary
    known = given.select("gram", F.col("id").cast("long").alias("__id"), F.col("n").alias("__weight"))
    fits = F.char_length("gram").between(low, high) & F.col("__id").isNotNull()
    last, n = known.agg(F.max("__id"), F.count(F.when(fits, 1))).first()
    size = F.lit(0 if last is None else last + 1).cast("long")
    if n * high <= HELD:
        return _held_ngrams(df, key, seq, low, high, known.where(fits)).select(key, size.alias("size"), "indices", "counts")
    rows = df.select(F.col(key).alias("__key"), F.col(seq).alias("__seq"))
    coded = looked_up(row_ngrams(rows, "__key", "__seq", low, high), known, ["gram"], "__weight").where("__id is not null")
    per = coded.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("__id", "n"))).alias("__v"))  # a row's own n-grams
    part = lambda c: F.coalesce(F.transform("__v", lambda x: x[c]), F.array().cast("array<long>"))
    vectors = rows.select("__key").join(per, "__key", "left")
    return vectors.select(F.col("__key").alias(key), size.alias("size"), part("__id").alias("indices"), part("n").alias("counts"))


def _points(texts: list[str], width: int) -> np.ndarray:
    """Texts of at most ``width`` symbols as keys in the order of their code points, one more than these each: 0 only fills up."""
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), width), np.uint32)
    out[np.repeat(np.arange(len(texts)), sizes), np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = symbols + 1
    return out.view(f"<U{width}").ravel()


def known_windows(texts: list[str], low: int, high: int, grams: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, rank, number) of each distinct window of ``low`` to ``high`` symbols of each text that is one of ``grams`` (sorted keys by _points), in order."""
    found = [np.zeros(0, np.int64)]
    for k in range(low, high + 1) if len(grams) else ():
        symbols, of, windows, inside = coded_windows(texts, k)
        if not len(inside):
            continue
        _, first, which = np.unique(windows[inside], return_index=True, return_inverse=True)
        keys = np.zeros((len(first), high), np.uint32)
        keys[:, :k] = symbols[inside[first][:, None] + np.arange(k)] + 1
        keys = keys.view(grams.dtype).ravel()
        at = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
        ranks = np.where(grams[at] == keys, rank[at], -1)[which]
        hit = ranks >= 0
        found.append(of[inside[hit]] * len(grams) + ranks[hit])
    cells, n = np.unique(np.concatenate(found), return_counts=True)
    return *np.divmod(cells, max(len(grams), 1)), n


def _held_ngrams(df: DataFrame, key: str, seq: str, low: int, high: int, known: DataFrame) -> DataFrame:
    """key, indices, counts of ``sparse_ngrams``, by a vocabulary (gram, __id) that is gathered and broadcast."""
    held = known.select("gram", "__id").toArrow()  # HELD symbols
    grams, ids = _points(held["gram"].to_pylist(), high), held["__id"].to_numpy()
    order, by_id = np.argsort(grams), np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[by_id] = np.arange(len(ids))
    shared = df.sparkSession.sparkContext.broadcast((grams[order], rank[order], ids[by_id]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, rank, ids = shared.value
        for keys, texts in _pieces(batches):
            row, place, n = known_windows(texts, low, high, grams, rank)
            ends = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(ends, pa.array(ids[place])), pa.ListArray.from_arrays(ends, pa.array(n))], names=[key, "indices", "counts"])

    return df.select(key, seq).mapInArrow(count, f"`{key}` {dict(df.dtypes)[key]}, indices array<long>, counts array<long>")


def learned_vocabulary(df: DataFrame, seq: str, low: int, high: int) -> list[str]:
    """The n-grams that occur, in order."""
    found = df.select(F.explode(ngrams(F.col(seq), low, high)).alias("gram")).distinct().limit(MOST_NGRAMS + 1).collect()
    if len(found) > MOST_NGRAMS:
        raise ValueError(f"more than {MOST_NGRAMS} n-grams: use sparse_ngrams")
    return sorted(r["gram"] for r in found)


def with_ngrams(df: DataFrame, seq: str, low: int, high: int, vocabulary: list[str] | None = None, out: str = "ngrams") -> DataFrame:
    """``df`` with an array of counts in the order of the vocabulary, learned from the table unless it is given."""
    return df.withColumn(out, ngram_counts(F.col(seq), learned_vocabulary(df, seq, low, high) if vocabulary is None else vocabulary))


def mean_kmers(embedding: Column, k: int) -> Column:
    """Mean of all k-row windows of a matrix, flattened: entry (j, c) averages rows j to j + n - k.

    A running sum: the rows of the first average are added once, each further one adds a row and takes one off.
    """
    windows = F.size(embedding) - (k - 1)
    real = lambda r: F.transform(r, lambda x: x.cast("double"))
    first = F.aggregate(F.slice(embedding, 2, F.greatest(windows - 1, F.lit(0))), real(embedding[0]), lambda s, r: F.zip_with(s, r, lambda x, y: x + y.cast("double")))

    def move(sums: Column, j: Column) -> Column:
        apart = F.zip_with(F.get(embedding, j + windows - 1), F.get(embedding, j - 1), lambda x, y: x.cast("double") - y.cast("double"))
        return F.concat(sums, F.array(F.zip_with(F.element_at(sums, -1), apart, lambda x, y: x + y)))

    steps = F.sequence(F.lit(1), F.lit(k - 1)) if k > 1 else F.array().cast("array<int>")
    sums = F.aggregate(steps, F.array(first), move)
    return F.when(windows > 0, F.transform(F.flatten(sums), lambda x: x / windows))


def normalised_mean_kmers(embedding: Column, k: int) -> Column:
    """mean_kmers, scaled to length 1."""
    return F.transform(F.array(mean_kmers(embedding, k)), unit)[0]  # the array binds the mean


def unit(vector: Column) -> Column:
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def kmer_windows(df: DataFrame, key: str, embedding: str, k: int) -> DataFrame:
    """key, at, window (flattened) of every k-row window."""
    n = F.size(embedding) - (k - 1)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return df.select(key, embedding, F.explode(starts).alias("at")).select(key, "at", F.transform(F.flatten(F.slice(F.col(embedding), F.col("at") + 1, k)), lambda x: x.cast("double")).alias("window"))


def kmer_centers(df: DataFrame, key: str, embedding: str, k: int) -> DataFrame:
    """window, unit: distinct windows of all rows, and their unit vectors."""
    return kmer_windows(df, key, embedding, k).select("window").distinct().withColumn("unit", unit(F.col("window")))


def rkhs_features(df: DataFrame, key: str, embedding: str, k: int, size: int, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, seed: int = 0, starts: int = 10) -> DataFrame:
    """key, features: mean over a row's windows of their Nystrom features on ``size`` k-means centers, the best of ``starts``.

    k-means runs on the distinct windows; the driver holds the centers and one size x size matrix. The mean of a row's features is
    taken where the row is: its windows are neither exploded nor shuffled. A row without a window has null features.
    """
    kernel = kernel or (lambda x, y: x @ y.T)
    points = _fixed(kmer_centers(df, key, embedding, k).select("window"))
    centers = k_means(points, "window", size, starts, seed)[0]
    if not len(centers):
        return df.select(key, F.lit(None).cast("array<double>").alias("features"))
    norms = np.linalg.norm(centers, axis=1, keepdims=True)
    centers = centers / np.where(norms == 0, 1, norms)
    values, vectors = np.linalg.eigh(kernel(centers, centers))
    root = vectors @ np.diag(np.where(values > 1e-10, 1 / np.sqrt(np.maximum(values, 1e-10)), 0)) @ vectors.T

    @F.pandas_udf("array<double>")
    def project(matrices: pd.Series) -> pd.Series:
        return pd.Series([_mean_features(m, k, centers, root, kernel) for m in matrices])

    return df.select(key, project(F.col(embedding).cast("array<array<double>>")).alias("features"))


#: Windows whose kernel values are computed at a time.
WINDOWS = 1 << 14


def _mean_features(matrix: np.ndarray | None, k: int, centers: np.ndarray, root: np.ndarray, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """root times the mean of kernel values between the centers and all windows of a matrix."""
    n = len(matrix) - k + 1 if matrix is not None else 0
    if n < 1:
        return None
    rows = np.stack(matrix)
    windows = np.lib.stride_tricks.sliding_window_view(rows, k, axis=0).transpose(0, 2, 1)
    total = sum(kernel(centers, windows[a : a + WINDOWS].reshape(-1, centers.shape[1])).sum(1) for a in range(0, n, WINDOWS))
    return root @ (total / n)


def k_means(points: DataFrame, vector: str, size: int, starts: int = 10, seed: int = 0, rounds: int = 30, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """(centers, inertia) of the best of several starts, all fitted together: a round is one pass over the points for all starts.

    Each start begins with ``size`` distinct points, chosen by a hash. Tasks send a sum and a count for each center of each start.
    A start rests once its centers move less than ``tolerance``; a center that loses its points stays. Fewer points than
    ``size`` give as many centers as there are.
    """
    rows = points.select(F.col(vector).cast("array<double>").alias("x")).where("x is not null")
    chosen = [rows.distinct().orderBy(F.xxhash64(F.lit(seed * 1_000 + s), "x"), "x").limit(size).collect() for s in range(starts)]  # size rows each
    if not chosen[0]:
        return np.zeros((0, 0)), 0.0
    centers = np.array([[r["x"] for r in rows] for rows in chosen])
    going, inertia = np.ones(starts, bool), np.full(starts, np.inf)
    for turn in range(rounds + 1):
        moved, inertia = _round(rows, centers, going, inertia)
        shift = np.abs(moved - centers).max((1, 2))
        if turn == rounds or not (going := going & (shift > tolerance)).any():
            break
        centers = np.where(going[:, None, None], moved, centers)
    best = int(inertia.argmin())
    return centers[best], float(inertia[best])


def _round(rows: DataFrame, centers: np.ndarray, going: np.ndarray, inertia: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of the points nearest to each center, and the sums of squared distances, of the starts that still move."""
    now = np.flatnonzero(going)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(now), *centers.shape[1:]))
        count, error = np.zeros((len(now), centers.shape[1]), np.int64), np.zeros((len(now), centers.shape[1]))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            for n, s in enumerate(now):
                apart = (x * x).sum(1)[:, None] - 2 * x @ centers[s].T + (centers[s] ** 2).sum(1)
                of = apart.argmin(1)
                np.add.at(total[n], of, x)
                count[n] += np.bincount(of, minlength=len(count[n]))
                error[n] += np.bincount(of, np.maximum(apart[np.arange(len(x)), of], 0), len(count[n]))
        start, center = np.nonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(start) + 1) * centers.shape[2], pa.int32()), pa.array(total[start, center].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(now[start].astype(np.int32)), pa.array(center.astype(np.int32)), pa.array(count[start, center]), pa.array(error[start, center]), lists], names=["start", "center", "n", "error", "total"])

    def added(parts: pa.Table) -> pa.Table:
        total = np.stack(parts["total"].to_numpy()).sum(0)
        one = [parts["start"][0].as_py(), parts["center"][0].as_py(), int(parts["n"].to_numpy().sum()), float(parts["error"].to_numpy().sum()), total.tolist()]
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(one, parts.schema, strict=True)], schema=parts.schema)

    kind = "start int, center int, n long, error double, total array<double>"
    moved, inertia = centers.copy(), np.where(going, 0.0, inertia)
    for r in rows.mapInArrow(sums, kind).groupBy("start", "center").applyInArrow(added, kind).collect():  # starts x size rows
        moved[r["start"], r["center"]] = np.array(r["total"]) / r["n"]
        inertia[r["start"]] += r["error"]
    return moved, inertia
