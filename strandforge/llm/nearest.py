"""Approximate nearest neighbours by inner product: probed lists, scanned dimension by dimension as far as needed.

Largest inner product becomes smallest distance: vectors are divided by the largest norm M and get one component more,
which makes all of them unit vectors; a query is divided by its own norm and gets a zero there. A random rotation then
spreads the distance evenly over all dimensions.

Fitting: a sample of at most ``SAMPLE`` vectors (and SAMPLE_BYTES), chosen by a hash of the id, goes to the driver. K-means
makes root-many lists of it, neighbouring lists form groups, and the fewest lists to probe are taken with which ASKED of the
sample's own rows find ``recall`` of their nearest in the sample. In the whole table neighbours are nearer than in a sample,
and lists are probed as often, so that the share found there is no less.

Index and search:

1. Every vector goes to its nearest list. Lists are written in packs of about PACK vectors, rotated and as they were: small
   lists of a group share a pack, a list with a third of all vectors has many. The sizes of the lists, LISTS numbers, are
   all that the driver sees of it.
2. Queries travel in packs, once to each group in which they probe a list, and meet the packs of the group one by one; what
   a pack of queries has found so far bounds its search of the next one. First queries probe their nearest few lists: the
   k-th score found there is where the search of the others begins.
3. Adaptive scan of a list: partial squared distances of a query to all vectors of the list after the first block of
   columns, then after the second, and so on. The hypothesis is that the whole distance is within the k-th one. A random
   rotation shows d of D dimensions a share of it that follows the Beta(d / 2, (D - d) / 2) distribution; a candidate is given
   up if its partial distance is beyond the k-th one times the (1 - ALPHA)-quantile of that share. Whoever is left is scored
   on the original vectors.
4. Queries that have found fewer than k rows (their lists were small) go on to all other lists.

Scores are sums of products of the original components in double precision. Rows that come back from a pack are k for a query
at most; the best of all packs are merged by a rank. A group with very many packs is cut into slices, to each of which the
queries go.

Nulls and edge cases: vectors that are null, zero or empty, or hold null or non-finite components, and rows with a null id, take no
part; shorter vectors count as padded with zeros; of equal scores the smaller id is nearer; a row with an id that occurs twice
is a query and a candidate of its own; fewer candidates than k are all returned, since then all lists are probed and all scored;
an empty table gives no rows; other columns are ignored, whatever their names; there are no texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, stash

#: Vectors, and bytes of them, that the index is fitted on; of them so many are asked to choose the number of probes.
SAMPLE, SAMPLE_BYTES, ASKED = 1 << 15, 32 << 20, 512
#: Most lists; lists in a group; vectors in a pack of the index, and queries in one.
LISTS, GROUP, PACK, QUERIES = 4096, 32, 1024, 512
#: Columns in a block; how seldom a test may give up a candidate at the k-th distance; packs in a slice of a group.
BLOCK, ALPHA, SLICE = 16, 1e-3, 64
#: Packs of queries of which a task holds what they have found.
HELD = 16
#: Share of the nearest that the probed lists are to hold.
RECALL = 0.97
#: Rounds of k-means.
ROUNDS = 8
#: Pairs of a query and a vector that are compared, and scored, at a time.
PAIRS, STEP = 1 << 18, 1 << 16
#: Squared distances lie between 0 and 4; what 32-bit components may make them differ by.
SLACK = 1e-5
PACKED = "grp int, slice int, rows int, lists binary, uids binary, ids binary, turned binary, body binary"
ASKS = "grp int, slice int, q_rows int, q_uids binary, q_ids binary, q_turned binary, q_body binary, q_least binary, q_lists binary"
FOUND = "query_uid long, query_id long, vec_id long, score double, pairs long, compared long, dims long"


def vectors_of(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """uid, vec_id, v, norm of every vector that takes part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    # the largest component first, so that no square overflows
    top = F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    rows = rows.withColumn("top", top)
    norm = F.col("top") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / F.col("top")) * (x / F.col("top"))))
    return rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "v", norm.alias("norm"))


def _padded(arrays: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(arrays), width))
    for i, x in enumerate(arrays):
        out[i, : len(x)] = x
    return out


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row, in no order."""
    k = min(k, scores.shape[1])
    return np.argpartition(-scores, k - 1, 1)[:, :k] if k else np.zeros((len(scores), 0), np.int64)


def k_means(points: np.ndarray, n: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """Centers of ``n`` clusters; one that loses its points takes the place of a random point."""
    centers = points[rng.choice(len(points), n, replace=False)]
    for _ in range(rounds):
        of = nearest_centers(points, centers, 1)[:, 0]
        counts = np.bincount(of, minlength=n)
        sums = np.zeros_like(centers)
        np.add.at(sums, of, points)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], points[rng.integers(len(points), size=n)])
    return centers


def nearest_centers(points: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the ``n`` nearest centers of each point, nearest first."""
    out = []
    for at in range(0, len(points), max(1, PAIRS // len(centers))):
        near = points[at : at + max(1, PAIRS // len(centers))] @ centers.T - (centers * centers).sum(1) / 2
        pick = _best(near, n)
        out.append(np.take_along_axis(pick, np.argsort(-np.take_along_axis(near, pick, 1), 1, kind="stable"), 1))
    return np.concatenate([*out, np.zeros((0, min(n, len(centers))), np.int64)])


@dataclass(frozen=True)
class Index:
    """What was fitted: the rotation, the lists' centers, the group of each list, the number of lists to probe."""

    width: int
    largest: float
    rotation: np.ndarray
    centers: np.ndarray
    groups: np.ndarray
    probes: int
    shares: tuple[float, ...] = ()

    def turned(self, body: np.ndarray, norms: np.ndarray, *, query: bool) -> np.ndarray:
        """Rotated unit vectors of rows or of queries."""
        unit = body / norms[:, None] if query else body / self.largest
        extra = np.zeros(len(body)) if query else np.sqrt(np.maximum(0, 1 - np.minimum(1, norms / self.largest) ** 2))
        return np.concatenate([unit, extra[:, None]], 1) @ self.rotation

    @property
    def blocks(self) -> list[slice]:
        edges = [*range(0, self.width + 1, BLOCK), self.width + 1]
        return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def share_quantiles(width: int, blocks: list[slice], alpha: float = ALPHA) -> tuple[float, ...]:
    """What share of a squared distance the dimensions up to the end of each block show, but for a part ``alpha`` of all rotations."""
    x = (np.arange(200_000) + 0.5) / 200_000
    out = []
    for d in (b.stop for b in blocks):
        if d >= width:
            out.append(1.0)
            continue
        log = (d / 2 - 1) * np.log(x) + ((width - d) / 2 - 1) * np.log1p(-x)
        weight = np.cumsum(np.exp(log - log.max()))
        out.append(min(1.0, float(x[np.searchsorted(weight, (1 - alpha) * weight[-1])])))
    return tuple(out)


def fitted(body: np.ndarray, norms: np.ndarray, largest: float, n: int, k: int, recall: float, seed: int = 1) -> Index:
    """The index of a sample of ``n`` vectors, the largest of which has the norm ``largest``."""
    rng = np.random.default_rng(seed)
    width = body.shape[1]
    rotation = np.linalg.qr(rng.normal(size=(width + 1, width + 1)))[0]
    raw = Index(width, largest, rotation, np.zeros((0, 0)), np.zeros(0, np.int64), 0)
    points = raw.turned(body, norms, query=False)
    lists = max(1, min(LISTS, math.isqrt(n), len(body)))
    centers = k_means(points, lists, rng)
    # neighbouring lists in one group
    groups = nearest_centers(centers, k_means(centers, -(-lists // GROUP), rng), 1)[:, 0]
    asked = rng.choice(len(body), min(ASKED, len(body)), replace=False)
    own, ranks = nearest_centers(points, centers, 1)[:, 0], []
    for at in np.array_split(asked, -(-len(asked) // 32)):
        q = raw.turned(body[at], norms[at], query=True)
        near = q @ points.T
        near[np.arange(len(at)), at] = -np.inf
        place = np.argsort(nearest_centers(q, centers, lists), 1)  # of each list in a query's order
        ranks.append(np.take_along_axis(place, own[_best(near, min(k, max(1, len(body) - 1)))], 1).ravel())
    rank = np.sort(np.concatenate(ranks))
    # the largest place that so many of the nearest need
    probes = int(rank[min(len(rank) - 1, math.ceil(recall * len(rank)))]) + 1 if len(body) > k + 1 else lists
    return Index(width, largest, rotation, centers, groups, probes, share_quantiles(width + 1, raw.blocks))


def _ranked(i: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each i: larger scores, then smaller ids."""
    order = np.lexsort((ids, -scores, i))
    starts = np.flatnonzero(np.concatenate([[True], np.diff(i[order]) != 0])) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def _adaptive(q: np.ndarray, rows: np.ndarray, limit: np.ndarray, blocks: list[slice], shares: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """(query, row) of the pairs that no test gives up, and the dimensions read; ``limit``: squared distance of the k-th, for each query."""
    first = blocks[0]
    part = (q[:, first] ** 2).sum(1)[:, None] + (rows[:, first] ** 2).sum(1)[None] - 2 * (q[:, first] @ rows[:, first].T)
    read = part.size * first.stop
    i, j = np.nonzero(part <= (limit * shares[0] + SLACK)[:, None])
    part = part[i, j]
    for block, share in zip(blocks[1:], shares[1:], strict=True):
        apart = q[i, block] - rows[j, block]
        part = part + np.einsum("ij,ij->i", apart, apart)
        read += apart.size
        left = part <= limit[i] * share + SLACK
        i, j, part = i[left], j[left], part[left]
    return i, j, read


class Asked:
    """A pack of queries: its vectors, and the k best rows for each query so far."""

    def __init__(self, r: object, index: Index, k: int) -> None:
        whole = lambda raw, kind: np.frombuffer(raw, kind).reshape(r.q_rows, -1)
        self.index, self.k = index, k
        self.uids, self.ids = np.frombuffer(r.q_uids, np.int64), np.frombuffer(r.q_ids, np.int64)
        self.turned, self.body, self.lists = whole(r.q_turned, np.float32), whole(r.q_body, np.float64), whole(r.q_lists, np.int32)
        top = np.abs(self.body).max(1)
        self.norms = top * np.sqrt(((self.body / top[:, None]) ** 2).sum(1))
        # a score that k rows elsewhere reach, or minus infinity
        self.least = np.frombuffer(r.q_least).copy()
        self.given = self.least.copy()
        self.of, self.near, self.best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.pairs = self.compared = self.read = 0

    def scan(self, at: np.ndarray, uids: np.ndarray, ids: np.ndarray, turned: np.ndarray, body: np.ndarray) -> None:
        """Look for the nearest of the queries ``at`` among some rows."""
        step = max(1, PAIRS // max(1, len(at)))
        self.pairs += len(at) * len(ids)
        for begin in range(0, len(ids), step):
            rows = slice(begin, begin + step)
            known = np.isfinite(self.least[at])
            old, new = at[known], at[~known]
            # a score's squared distance between unit vectors
            limit = 2 - 2 * (self.least[old] / self.norms[old]) / self.index.largest
            i, j, read = _adaptive(self.turned[old], turned[rows], limit.astype(np.float32), self.index.blocks, self.index.shares)
            i = old[i]
            if len(new):
                # no k-th score yet: the best of these rows, and what is as good but for rounding
                near = self.turned[new] @ turned[rows].T
                kth = np.partition(near, -min(self.k + 1, near.shape[1]), 1)[:, -min(self.k + 1, near.shape[1])]
                a, b = np.nonzero(near >= kth[:, None] - SLACK)
                i, j, read = np.concatenate([i, new[a]]), np.concatenate([j, b]), read + near.size * (self.index.width + 1)
            other = self.uids[i] != uids[rows][j]
            self.read += read
            self._add(i[other], begin + j[other], ids, body)

    def _add(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray, body: np.ndarray) -> None:
        if not len(i):
            return
        self.compared += len(i)
        scores = np.zeros(len(i))
        for n in range(0, len(i), STEP):
            scores[n : n + STEP] = (self.body[i[n : n + STEP]] * body[j[n : n + STEP]]).sum(1)
        touched = np.zeros(len(self.uids), bool)
        touched[i] = True
        again = touched[self.of]
        of, near, best = (np.concatenate([x[again], y]) for x, y in ((self.of, i), (self.near, ids[j]), (self.best, scores)))
        keep = _ranked(of, near, best, self.k)
        of, near, best = of[keep], near[keep], best[keep]
        counts = np.bincount(of, minlength=len(self.uids))
        full = counts == self.k
        self.least[full] = np.maximum(self.least[full], best[np.cumsum(counts)[full] - 1])
        self.of, self.near, self.best = (np.concatenate([x[~again], y]) for x, y in ((self.of, of), (self.near, near), (self.best, best)))

    def rows(self) -> Iterator[pd.DataFrame]:
        """FOUND rows; one without query tells the counts."""
        keep = self.best >= self.given[self.of]
        of = self.of[keep]
        yield pd.DataFrame({"query_uid": self.uids[of], "query_id": self.ids[of], "vec_id": self.near[keep], "score": self.best[keep], "pairs": 0, "compared": 0, "dims": 0})
        told = pd.DataFrame({"query_uid": [None], "query_id": [None], "vec_id": [None], "score": [None], "pairs": [self.pairs], "compared": [self.compared], "dims": [self.read]})
        yield told.astype({"query_uid": "Int64", "query_id": "Int64", "vec_id": "Int64", "score": "Float64"})


def _runs(frames: Iterator[pd.DataFrame], key: str, most: int) -> Iterator[pd.DataFrame]:
    """Frames of one key each, at most ``most`` rows long, of rows that come key by key."""
    held: pd.DataFrame | None = None
    for frame in frames:
        held = pd.concat([held, frame], ignore_index=True) if held is not None else frame
        while len(held) and (held[key].iloc[0] != held[key].iloc[-1] or len(held) >= most):
            n = min(most, int((held[key].to_numpy() == held[key].iloc[0]).sum()))
            yield held[:n]
            held = held[n:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


class Search:
    """The steps of a search with an index, as functions of batches."""

    def __init__(self, index: Index, k: int) -> None:
        self.index, self.k = index, k

    def assign(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """uid, vec_id, v, norm, the list of each vector and its group."""
        for frame in frames:
            turned = self.index.turned(_padded(frame.v, self.index.width), frame.norm.to_numpy(), query=False)
            lists = nearest_centers(turned, self.index.centers, 1)[:, 0]
            yield frame[["uid", "vec_id", "v", "norm"]].assign(list=lists.astype(np.int32), grp=self.index.groups[lists].astype(np.int32))

    def pack(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """PACKED rows of vectors that come pack by pack, and list by list within it."""
        for own in _runs(frames, "pack", 2 * PACK):
            body = _padded(own.v, self.index.width)
            turned = self.index.turned(body, own.norm.to_numpy(), query=False).astype(np.float32)
            raw = {"lists": own.list.to_numpy(np.int32), "uids": own.uid.to_numpy(np.int64), "ids": own.vec_id.to_numpy(np.int64), "turned": turned, "body": body}
            yield pd.DataFrame([{"grp": int(own.grp.iloc[0]), "slice": int(own.slice.iloc[0]), "rows": len(own), **{c: x.tobytes() for c, x in raw.items()}}])

    def ask(self, frames: Iterator[pd.DataFrame], begin: int, end: int, slices: dict[int, int]) -> Iterator[pd.DataFrame]:
        """ASKS rows of queries (with ``least``, null where unknown) that come pack by pack: a row for each slice of a group
        in which they probe a list, the ``begin``-th to the ``end``-th nearest."""
        for own in _runs(frames, "pack", 2 * QUERIES):
            body = _padded(own.v, self.index.width)
            turned = self.index.turned(body, own.norm.to_numpy(), query=True)
            lists = nearest_centers(turned, self.index.centers, end)[:, begin:].astype(np.int32)
            group_of = self.index.groups[lists]
            least = own.least.to_numpy(np.float64, na_value=-np.inf)
            out = []
            for group in np.unique(group_of):
                at = np.flatnonzero((group_of == group).any(1))
                raw = {"q_uids": own.uid.to_numpy(np.int64)[at], "q_ids": own.vec_id.to_numpy(np.int64)[at], "q_turned": turned[at].astype(np.float32), "q_body": body[at], "q_least": least[at]}
                probed = -np.sort(-np.where(group_of[at] == group, lists[at], -1), 1)
                raw["q_lists"] = np.ascontiguousarray(probed[:, (probed >= 0).any(0)])
                sent = {c: x.tobytes() for c, x in raw.items()}
                out += [{"grp": int(group), "slice": n, "q_rows": len(at), **sent} for n in range(slices.get(int(group), 0))]
            yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in ASKS.split(", ")])

    def search(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """FOUND rows of packs of queries and packs of vectors."""
        held: dict[tuple[int, int, bytes], Asked] = {}
        for frame in frames:
            for r in frame.itertuples(index=False):
                key = (r.grp, r.slice, r.q_uids)
                if (asked := held.get(key)) is None:
                    if len(held) == HELD:
                        yield from held.pop(next(iter(held))).rows()
                    asked = held[key] = Asked(r, self.index, self.k)
                lists, uids, ids = np.frombuffer(r.lists, np.int32), np.frombuffer(r.uids, np.int64), np.frombuffer(r.ids, np.int64)
                turned, body = np.frombuffer(r.turned, np.float32).reshape(r.rows, -1), np.frombuffer(r.body).reshape(r.rows, -1)
                starts = np.flatnonzero(np.concatenate([[True], np.diff(lists) != 0]))
                for a, b in zip(starts, np.append(starts[1:], r.rows), strict=True):
                    at = np.flatnonzero((asked.lists == lists[a]).any(1))
                    if len(at):
                        asked.scan(at, uids[a:b], ids[a:b], turned[a:b], body[a:b])
        for asked in held.values():
            yield from asked.rows()


def fit(rows: DataFrame, k: int, recall: float = RECALL) -> Index | None:
    """The index of a table of ``vectors_of``, of a bounded sample of it; None if it is empty."""
    n, width, largest = rows.agg(F.count("*"), F.max(F.size("v")), F.max("norm")).first()
    if not n:
        return None
    size = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    # rows below a bound of the hash: so many of them on average
    share = (1 << 31) * min(1.0, 0.9 * size / n) if n > size else 1 << 31
    sample = rows.where(F.pmod(F.xxhash64(F.lit(3), "uid", "vec_id"), F.lit(1 << 31)) < int(share)).limit(size).toPandas()  # SAMPLE rows
    if not len(sample):
        sample = rows.limit(1).toPandas()
    return fitted(_padded(sample.v, width), sample.norm.to_numpy(), largest, n, k, recall)


def _places(sizes: list[tuple[int, int, int, int]]) -> tuple[list[tuple[int, int, int]], dict[int, int], list[tuple[int, int]]]:
    """(list, its first pack within its group, its packs), slices of each group, (group, its packs of queries), from (group, list, vectors, queries) in order."""
    packs, last, room, asked = [], {}, {}, {}
    for group, at, n, n_queries in sizes:
        parts = -(-n // PACK)
        if parts == 1 and n <= room.get(group, 0):
            room[group] -= n
            packs.append((at, last[group], 1))
        else:
            packs.append((at, last.get(group, -1) + 1, parts))
            last[group] = last.get(group, -1) + parts
            room[group] = PACK - n if parts == 1 else 0
        asked[group] = asked.get(group, 0) + n_queries
    return packs, {g: n // SLICE + 1 for g, n in last.items()}, [(g, max(1, -(-n // QUERIES))) for g, n in asked.items()]


def _found(vectors: DataFrame, k: int, query_every: int, id_col: str, vector_col: str, recall: float) -> DataFrame | None:
    spark: SparkSession = vectors.sparkSession
    bound_batches(spark)
    rows = stash(vectors_of(vectors, id_col, vector_col), "vectors")
    index = fit(rows, k, recall)
    if index is None:
        return None
    steps = Search(index, k)
    assigned = stash(rows.mapInPandas(steps.assign, "uid long, vec_id long, v array<double>, norm double, list int, grp int"), "assigned")
    is_query = F.col("vec_id") % query_every == 0
    sizes = [tuple(r) for r in assigned.groupBy("grp", "list").agg(F.count("*"), F.count_if(is_query)).orderBy("grp", "list").collect()]  # LISTS rows
    packs, slices, asks = _places(sizes)
    salt = F.xxhash64("uid")
    place = F.broadcast(spark.createDataFrame(packs, "list int, first int, parts int"))  # LISTS rows
    placed = assigned.join(place, "list").withColumn("pack", F.col("first") + F.pmod(salt, F.col("parts")).cast("int")).drop("first", "parts")
    placed = placed.withColumn("slice", F.floor(F.col("pack") / SLICE).cast("int")).repartition("grp", "pack").sortWithinPartitions("grp", "pack", "list", "uid")
    packed = stash(placed.withColumn("pack", F.struct("grp", "pack").cast("string")).mapInPandas(steps.pack, PACKED), "packs")
    ask_place = F.broadcast(spark.createDataFrame(asks, "grp int, parts int"))
    queries = assigned.where(is_query).join(ask_place, "grp").withColumn("pack", F.pmod(salt, F.col("parts")).cast("int")).drop("parts")

    def step(asked: DataFrame, begin: int, end: int) -> DataFrame:
        ordered = asked.repartition("grp", "pack").sortWithinPartitions("grp", "pack", "uid").withColumn("pack", F.struct("grp", "pack").cast("string"))
        sent = ordered.mapInPandas(lambda frames: steps.ask(frames, begin, end, slices), ASKS)
        return stash(sent.join(packed, ["grp", "slice"]).mapInPandas(steps.search, FOUND), "found")

    def kth(found: DataFrame, place: int) -> DataFrame:
        """uid, least: the score at a place of the queries that have so many rows."""
        rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.desc("score")))
        scored = found.where("query_uid is not null").select(F.col("query_uid").alias("uid"), F.col("score").alias("least"), rank.alias("rank"))
        return scored.where(F.col("rank") == place).select("uid", "least")

    lists = len(index.centers)
    few = min(index.probes, math.isqrt(max(index.probes - 1, 0)) + 1)
    found = step(queries.withColumn("least", F.lit(None).cast("double")), 0, few)
    if few < index.probes:
        found = found.unionByName(step(queries.join(kth(found, k), "uid", "left"), few, index.probes))
    if index.probes < lists:
        short = queries.join(kth(found, k), "uid", "left_anti").withColumn("least", F.lit(None).cast("double"))
        if not short.isEmpty():
            found = found.unionByName(step(short, index.probes, lists))
    return found


def nearest_neighbours(vectors: DataFrame, k: int = 20, query_every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by ``query_every``."""
    found = _found(vectors, k, query_every, id_col, vector_col, recall)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id"))
    return found.where("query_uid is not null").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scan_report(vectors: DataFrame, k: int = 20, query_every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """One row: pairs of a query and a vector of its lists, pairs compared on all dimensions, dimensions read of all pairs."""
    found = _found(vectors, k, query_every, id_col, vector_col, recall)
    if found is None:
        return vectors.sparkSession.createDataFrame([(0, 0, 0)], "pairs long, compared long, dims long")
    return found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "compared", "dims")))
