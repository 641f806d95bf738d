"""Molecule graphs given as array<array<int>> of two rows, sources and destinations of the edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandforge.operators.splits import _fixed


def node_count(edges: Column) -> Column:
    """Distinct node ids."""
    return F.size(F.array_distinct(F.flatten(edges)))


def edge_count(edges: Column) -> Column:
    return F.size(edges[0])


def with_counts(df: DataFrame, edges: str = "bnd_idcs") -> DataFrame:
    """``df`` with atm_count and bnd_count; an edge list must have two rows."""
    checked = F.when(F.size(edges) == 2, F.col(edges)).otherwise(F.raise_error(F.lit("an edge list has two rows")).cast("array<array<int>>"))
    return df.withColumn("atm_count", node_count(checked)).withColumn("bnd_count", edge_count(checked))


def largest_counts(df: DataFrame, edges: str = "bnd_idcs") -> DataFrame:
    """One row: the most nodes and edges of any graph, the sizes to pad to."""
    return df.agg(F.max(node_count(F.col(edges))).alias("max_nodes"), F.max(edge_count(F.col(edges))).alias("max_edges"))


def edges_by_type(edges: Column, types: Column, wanted: list[int] | list[str]) -> Column:
    """Array of an edge list for each wanted type, empty ones included; types beyond the edges are ignored."""
    zipped = F.arrays_zip(edges[0], edges[1], F.slice(types, 1, F.size(edges[0])))
    of = lambda t: F.filter(zipped, lambda z: z["2"] == F.lit(t))
    return F.array(*(F.array(F.transform(of(t), lambda z: z["0"]), F.transform(of(t), lambda z: z["1"])) for t in wanted))


def adjacency_cells(df: DataFrame, key: str, edges: str = "bnd_idcs", *, directed: bool = False) -> DataFrame:
    """key, row, col of the cells that are set: the sparse form, for joins and large graphs. Ids beyond the nodes drop out."""
    n = node_count(F.col(edges))
    zipped = F.arrays_zip(F.col(edges)[0], F.col(edges)[1])
    cells = df.select(key, n.alias("n"), F.explode(zipped).alias("e")).select(key, "n", F.col("e.0").alias("row"), F.col("e.1").alias("col"))
    if not directed:
        cells = cells.unionByName(cells.select(key, "n", F.col("col").alias("row"), F.col("row").alias("col")))
    return cells.where((F.col("row") < F.col("n")) & (F.col("col") < F.col("n"))).select(key, "row", "col").distinct()


def _filled(graph: list[np.ndarray], n: int, size: int, fill: float | np.ndarray, pad: float, directed: bool) -> np.ndarray:
    out = np.full((size, size), pad, np.float32)
    out[:n, :n] = 0
    if len(graph) == 2:
        src, dst = np.asarray(graph[0], np.int64), np.asarray(graph[1], np.int64)
        values = np.asarray(fill, np.float32)
        if values.ndim and len(values) != len(src):
            raise ValueError("as many values as edges are needed")
        ok = (src < size) & (dst < size)
        values = values[ok] if values.ndim else values
        out[src[ok], dst[ok]] = values
        if not directed:
            out[dst[ok], src[ok]] = values
    return out


def with_adjacency(df: DataFrame, edges: str = "bnd_idcs", out: str = "atm_adj", size: int | None = None, fill: float | str = 1.0, pad: float = 0.0, *, directed: bool = False) -> DataFrame:
    """``df`` with a dense matrix per graph, as array<array<float>>; ``size`` pads it, ``fill`` is a number or names a column with one for each edge."""
    values = F.col(fill).cast("array<double>") if isinstance(fill, str) else F.array(F.lit(float(fill)))

    @F.pandas_udf("array<array<float>>")
    def matrix(e: pd.Series, n: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series([[list(r) for r in _filled(list(g), k, size or k, v if isinstance(fill, str) else v[0], pad, directed)] for g, k, v in zip(e, n, f, strict=True)])

    return df.withColumn(out, matrix(F.col(edges), node_count(F.col(edges)), values))


def _incident(graph: list[np.ndarray], nodes: int, fill: float, directed: bool) -> np.ndarray:
    src, dst = np.asarray(graph[0], np.int64), np.asarray(graph[1], np.int64)
    m, at = np.zeros((nodes, len(src)), np.float32), np.arange(len(src))
    m[dst[dst < nodes], at[dst < nodes]] = fill
    m[src[src < nodes], at[src < nodes]] = -fill if directed else fill
    return m


def with_incidence(df: DataFrame, edges: str = "bnd_idcs", out: str = "atm_bnd_incid", fill: float = 1.0, *, directed: bool = False) -> DataFrame:
    """``df`` with a node by edge matrix per graph; directed edges leave their source with a negative value."""

    @F.pandas_udf("array<array<float>>")
    def matrix(e: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([[list(r) for r in _incident(list(g), k, fill, directed)] for g, k in zip(e, n, strict=True)])

    return df.withColumn(out, matrix(F.col(edges), node_count(F.col(edges))))


def with_typed_incidence(df: DataFrame, types: str, wanted: list[int] | list[str], edges: str = "bnd_idcs", out: str = "atm_bnd_incid_by_type", fill: float = 1.0, *, directed: bool = False) -> DataFrame:
    """``df`` with an incidence matrix per wanted edge type: all nodes of the graph, the edges of the type."""

    @F.pandas_udf("array<array<array<float>>>")
    def matrices(e: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([[[list(r) for r in _incident(list(g), k, fill, directed)] for g in lists] for lists, k in zip(e, n, strict=True)])

    return df.withColumn(out, matrices(edges_by_type(F.col(edges), F.col(types), wanted), node_count(F.col(edges))))


def with_typed_adjacency(df: DataFrame, types: str, wanted: list[int] | list[str], edges: str = "bnd_idcs", out: str = "atm_adj_by_type") -> DataFrame:
    """``df`` with an adjacency matrix per wanted edge type, all of the whole graph's size."""

    @F.pandas_udf("array<array<array<float>>>")
    def matrices(e: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([[[list(r) for r in _filled(list(g), k, k, 1.0, 0.0, False)] for g in lists] for lists, k in zip(e, n, strict=True)])

    return df.withColumn(out, matrices(edges_by_type(F.col(edges), F.col(types), wanted), node_count(F.col(edges))))


def return_probabilities(adjacency: np.ndarray, steps: int) -> np.ndarray:
    """Node by step: the chance that a lazy walk is back after 2, 3, ... steps.

    The walk on an undirected graph is similar to a symmetric matrix, the eigenvalues of which give all steps at once. Other
    graphs, and those with a node without edges, take a matrix product for each step.
    """
    degree = adjacency.sum(1, keepdims=True)
    if steps and len(adjacency) and (degree > 0).all() and (adjacency == adjacency.T).all():
        root = np.sqrt(degree)
        values, vectors = np.linalg.eigh((np.eye(len(adjacency)) + adjacency / root / root.T) / 2)
        # 13 digits: what is a short fraction comes out as one
        return np.round(vectors**2 @ np.clip(values, 0, 1)[:, None] ** np.arange(2, steps + 2), 13)
    with np.errstate(divide="ignore", invalid="ignore"):
        walk = (np.eye(len(adjacency)) + adjacency / degree) / 2
    now, out = walk, []
    for _ in range(steps):
        now = now @ walk
        out.append(np.diag(now))
    return np.stack(out, 1) if out else np.zeros((len(adjacency), 0))


def with_return_probabilities(df: DataFrame, steps: int = 100, adjacency: str = "atm_adj", out: str = "atm_retprob100") -> DataFrame:
    """``df`` with return probabilities of each graph's nodes; matrix powers run in Arrow batches."""

    @F.pandas_udf("array<array<double>>")
    def powers(matrices: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in matrices:
            yield pd.Series([list(return_probabilities(np.array([*m], float).reshape(len(m), len(m)), steps)) for m in batch])

    return df.withColumn(out, powers(adjacency))


def sparse_return_probabilities(cells: DataFrame, key: str, steps: int = 100) -> DataFrame:
    """key, node, step (from 0), p: return probabilities of undirected graphs given as cells key, row, col, of any size, without a matrix.

    Nodes without edges have no rows. Walks spread from all nodes by joins with the edges. The walk is reversible, so a return
    after 2 t steps is the sum of squares of t steps' chances, each over the share of its end: half of the steps are walked.
    """
    edges = cells.select(key, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).distinct()
    degree = edges.groupBy(key, "row").agg(F.count("*").alias("d"))
    half = edges.join(degree, [key, "row"]).select(key, "row", "col", (0.5 / F.col("d")).alias("w"))
    walk = _fixed(half.unionByName(degree.select(key, "row", F.col("row").alias("col"), F.lit(0.5).alias("w"))).groupBy(key, "row", "col").agg(F.sum("w").alias("w")))
    ends = degree.select(key, F.col("row").alias("at"), "d")
    now, out = walk.select(key, F.col("row").alias("node"), F.col("col").alias("at"), F.col("w").alias("p")), None
    for t in range(1, steps // 2 + 2):
        # from node to at and back: p(at, node) = p(node, at) d(node) / d(at)
        after = _fixed(now.join(walk.select(key, F.col("row").alias("at"), "col", "w"), [key, "at"]).groupBy(key, "node", F.col("col").alias("at")).agg(F.sum(F.col("p") * F.col("w")).alias("p")))
        for step, other in ((2 * t - 2, now), (2 * t - 1, after)):
            if step >= steps:
                continue
            both = now.join(other.select(key, "node", "at", F.col("p").alias("q")), [key, "node", "at"]).join(ends, [key, "at"])
            back = both.groupBy(key, "node").agg(F.sum(F.col("p") * F.col("q") / F.col("d")).alias("p")).join(ends.withColumnRenamed("at", "node"), [key, "node"])
            part = back.select(key, "node", F.lit(step).alias("step"), (F.col("p") * F.col("d")).alias("p"))
            out = part if out is None else out.unionByName(part)
        now = after
    return out
