"""Exact top-k inner products by block-at-a-time pruning.

Vectors become integer components floor(256 * x). In ``vec_id`` order they are packed into blocks, each with the
largest and smallest value of every component; a row of blocks is a super-block, the forward index of its vectors.

1. Every pack of queries scores one super-block, that of its own range of ids, and then of all super-blocks as many as the
   root of their number: a first k-th score for each query, below which few rows of the others lie.
2. The bounds of all blocks (the summed maxima of a query's terms) are compared with those scores, before the probes and
   before the others. Only the queries of a pack for which some block can still reach their k-th score go on to a
   super-block, and only there; only rows that reach that score come back.
3. Within a super-block a query visits blocks in the order of their bounds, scores a block by a matrix product, and stops
   once no block left can reach its k-th score. Its lists from all super-blocks then merge.

Bounds and queries meet by number, in packs; no side is broadcast or gathered whole. On vectors whose directions are
spread evenly no bound falls below the k-th score, and step 2 leaves every super-block open: see ``search_report``.

Nulls and edge cases: vectors that are null, or hold null or non-finite components, take no part; shorter vectors count
as padded with zeros; ties go to the smaller ``vec_id``; a row with a ``vec_id`` that occurs twice is a query and a
candidate of its own; rows with a null ``vec_id`` take no part; scores beyond 64 bits are held at the largest or
smallest value; an empty table gives no rows; other columns are ignored, whatever their names; there are no texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, stash

BLOCK, BLOCKS, QUERIES = 256, 32, 1024
#: Super-blocks whose bounds are compared with a pack of queries at a time.
BOUNDS = 64
#: Below this, products and sums of 4,096 components are exact in double precision.
SAFE = 1 << 20
LARGEST = (1 << 63) - 1
EMPTY = -LARGEST - 1
PACKED = "pack long, rows int, width int, uids binary, ids binary, body binary, top binary, low binary"
SCORE = "query_uid long, query_id long, vec_id long, score long"
SEARCHED = f"{SCORE}, blocks long, scored long"


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """uid, vec_id, v (array of whole numbers as double) of every vector that takes part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("uid"), "vec_id", F.transform("v", lambda x: F.rint(F.floor(x * F.lit(float(scale))).cast("double"))).alias("v")
    )


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """``size`` vectors, neighbours in ``vec_id``, per row."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, n, held = TaskContext.get().partitionId(), 0, []

        def out(take: pd.DataFrame) -> pd.DataFrame:
            width = max([1, *map(len, take.v)])
            body = np.zeros((len(take), width))
            for i, x in enumerate(take.v):
                body[i, : len(x)] = x
            top, low = block_edges(body)
            raw = {"uids": take.uid.to_numpy(np.int64), "ids": take.vec_id.to_numpy(np.int64), "body": body, "top": top, "low": low}
            return pd.DataFrame([{"pack": (part << 32) + n, "rows": len(take), "width": width, **{c: x.tobytes() for c, x in raw.items()}}])

        for frame in frames:
            held = [pd.concat([*held, frame], ignore_index=True)]
            while len(held[0]) >= size:
                yield out(held[0][:size])
                held, n = [held[0][size:].reset_index(drop=True)], n + 1
        if held and len(held[0]):
            yield out(held[0])

    return rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id", "uid").mapInPandas(pack, PACKED)


def _even(*arrays: np.ndarray) -> list[np.ndarray]:
    """The matrices, padded with zeros to one width."""
    width = max(x.shape[1] for x in arrays)
    return [x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in arrays]


def _safe(q: np.ndarray, body: np.ndarray) -> bool:
    """Whether products are exact in double precision."""
    return max(np.abs(q).max(initial=0), np.abs(body).max(initial=0)) < SAFE and q.shape[1] <= 4096


def block_edges(body: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(largest, smallest) value of each component in each block of rows."""
    parts = [body[s : s + block] for s in range(0, len(body), block)]
    return np.stack([p.max(0) for p in parts]), np.stack([p.min(0) for p in parts])


def block_bounds(q: np.ndarray, top: np.ndarray, low: np.ndarray, exact: bool) -> np.ndarray:
    """The most that each block can score, a little more than exact where doubles may round."""
    bounds = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    return bounds if exact else bounds + np.abs(bounds) * 1e-9 + 1


def best_of(
    q_uids: np.ndarray, q: np.ndarray, uids: np.ndarray, ids: np.ndarray, body: np.ndarray, k: int, block: int = BLOCK, least: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores, block visits): k columns each, of the best rows for each query; unused places have the score EMPTY.

    ``least``: a score that k rows elsewhere reach, for each query; blocks that cannot reach it are passed over.
    """
    q, body = _even(q, body)
    exact = _safe(q, body)
    starts = range(0, len(body), block)
    top, low = block_edges(body, block)
    bounds = block_bounds(q, top, low, exact)
    order = np.argsort(-bounds, 1, kind="stable")
    best_ids, best = np.full((len(q), k), LARGEST), np.full((len(q), k), EMPTY)
    floor = np.full(len(q), EMPTY) if least is None else least
    visits = 0
    for turn in range(len(starts)):
        block_of = order[:, turn]
        open_ = bounds[np.arange(len(q)), block_of] >= np.maximum(best[:, -1], floor).astype(float)
        if not open_.any():
            break
        visits += int(open_.sum())
        for b in np.unique(block_of[open_]):
            at = np.flatnonzero(open_ & (block_of == b))
            rows = slice(starts[b], starts[b] + block)
            scores = _products(q[at], body[rows], exact)
            own = q_uids[at][:, None] == uids[rows][None, :]
            # a query's own row is in one block at most; its place is given away
            scores = np.where(own, EMPTY, scores)
            all_ids = np.concatenate([best_ids[at], np.where(own, LARGEST, np.broadcast_to(ids[rows], scores.shape))], 1)
            scores = np.concatenate([best[at], scores], 1)
            pick = np.lexsort((all_ids, -np.maximum(scores, EMPTY + 1)), 1)[:, :k]
            best_ids[at], best[at] = np.take_along_axis(all_ids, pick, 1), np.take_along_axis(scores, pick, 1)
    return best_ids, best, visits


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (a @ b.T).astype(np.int64)
    largest = [float(np.abs(x).max(initial=0)) for x in (a, b)]
    if max(largest) < float(1 << 52) and largest[0] * largest[1] * a.shape[1] < float(1 << 62):
        # high and low halves: each product of halves is exact in double precision
        out = np.zeros((len(a), len(b)), np.int64)
        half = float(1 << 20)
        parts = [[x % half, np.floor(x / half) % half, np.floor(x / half / half)] for x in (a, b)]
        for i, x in enumerate(parts[0]):
            for j, y in enumerate(parts[1]):
                for at in range(0, a.shape[1], 4096):
                    out += (x[:, at : at + 4096] @ y[:, at : at + 4096].T).astype(np.int64) << np.int64(20 * (i + j)) if 20 * (i + j) < 63 else 0
        return out
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    # numbers beyond 52 bits: Python's integers, for the few rows of a block at a time
    return np.clip(whole(a) @ whole(b).T, EMPTY + 1, LARGEST).astype(np.int64)


def _matrix(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(rows, -1)


def _searched(vectors: DataFrame, k: int, query_every: int, id_col: str, vector_col: str, scale: int) -> tuple[DataFrame, DataFrame]:
    """(SEARCHED rows of a query's own super-block and the probes, of the others); a row without query tells the blocks of a step and those scored."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = stash(integer_vectors(vectors, id_col, vector_col, scale), "vectors")
    data = stash(_pack(rows, BLOCK * BLOCKS), "blocks")
    asks = stash(_pack(rows.where(F.col("vec_id") % query_every == 0), QUERIES).drop("top", "low"), "asks")
    named = asks.select(*(F.col(c).alias(f"q_{c}") for c in asks.columns))
    # packs are numbered within ranges of ids: the first super-block of a query's own range, if there is one
    home = F.shiftleft(F.shiftright(F.col("q_pack"), 32), 32)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                q_uids, q_ids = np.frombuffer(r.q_uids, np.int64), np.frombuffer(r.q_ids, np.int64)
                least = np.frombuffer(r.q_least, np.int64) if r.q_least is not None else None
                ids, best, visits = best_of(q_uids, _matrix(r.q_body, r.q_rows), np.frombuffer(r.uids, np.int64), np.frombuffer(r.ids, np.int64), _matrix(r.body, r.rows), k, least=least)
                # rows below a score that k others reach are of no use
                keep = ((best != EMPTY) & (best >= (least[:, None] if least is not None else EMPTY))).ravel()
                yield pd.DataFrame({"query_uid": np.repeat(q_uids, k)[keep], "query_id": np.repeat(q_ids, k)[keep], "vec_id": ids.ravel()[keep], "score": best.ravel()[keep], "blocks": 0, "scored": 0})
                yield pd.DataFrame({"query_uid": [None], "query_id": [None], "vec_id": [None], "score": [None], "blocks": [len(q_uids) * -(-r.rows // BLOCK)], "scored": [visits]}).astype({c: "Int64" for c in ("query_uid", "query_id", "vec_id", "score")})

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                yield pd.DataFrame({"q_pack": r.q_pack, "place": np.arange(r.q_rows), "query_uid": np.frombuffer(r.q_uids, np.int64)})

    def still_open(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                q = _matrix(r.q_body, r.q_rows)
                floor = np.full(r.q_rows, EMPTY)
                for place, score in dict(r.reached if r.reached is not None else {}).items():
                    floor[place] = score
                out = []
                for e in r.edges:
                    e_rows = -(-e["rows"] // BLOCK)
                    wide, top, low = _even(q, _matrix(e["top"], e_rows), _matrix(e["low"], e_rows))
                    bounds = block_bounds(wide, top, low, _safe(wide, np.concatenate([top, low])))
                    at = np.flatnonzero((bounds.max(1) >= floor.astype(float)) & (e["pack"] != (r.q_pack >> 32) << 32))
                    if len(at):
                        u, i = np.frombuffer(r.q_uids, np.int64)[at], np.frombuffer(r.q_ids, np.int64)[at]
                        out.append({"pack": e["pack"], "q_rows": len(at), "q_uids": u.tobytes(), "q_ids": i.tobytes(), "q_body": q[at].tobytes(), "q_least": floor[at].tobytes()})
                if out:
                    yield pd.DataFrame(out)

    places = named.select("q_pack", "q_rows", "q_uids").mapInPandas(members, "q_pack long, place int, query_uid long")
    n = data.count()
    root = math.isqrt(max(n - 1, 0)) + 1

    def step(found: DataFrame, probes: bool) -> DataFrame:
        """SEARCHED rows of the super-blocks, probes or others, that are open after what was found."""
        # k-th score of each query so far, beside its pack: a row per query that has k rows
        rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.desc("score")))
        best = found.where("query_uid is not null").select("query_uid", "score", rank.alias("rank")).where(F.col("rank") <= k)
        reached = best.groupBy("query_uid").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        least = places.join(reached, "query_uid").groupBy("q_pack").agg(F.map_from_entries(F.collect_list(F.struct("place", "least"))).alias("reached"))  # QUERIES entries
        lanes = max(1, -(-(root if probes else n) // BOUNDS))
        chosen = F.pmod(F.xxhash64("pack"), F.lit(root)) == 0
        edges = data.where(chosen if probes else ~chosen).select("pack", "rows", "top", "low")
        edges = edges.groupBy(F.pmod(F.xxhash64(F.lit(1), "pack"), F.lit(lanes)).alias("lane")).agg(F.collect_list(F.struct("pack", "rows", "top", "low")).alias("edges"))  # about BOUNDS rows
        sent = named.join(least, "q_pack", "left").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"))
        opened = sent.join(edges, "lane").select("q_pack", "q_rows", "q_uids", "q_ids", "q_body", "reached", "edges").mapInPandas(still_open, "pack long, q_rows int, q_uids binary, q_ids binary, q_body binary, q_least binary")
        return opened.join(data.drop("top", "low"), "pack").drop("pack").mapInPandas(search, SEARCHED)

    home_rows = named.withColumn("pack", home).join(data.drop("top", "low"), "pack").withColumn("q_least", F.lit(None).cast("binary")).drop("pack", "q_pack")
    first = stash(home_rows.mapInPandas(search, SEARCHED), "first")
    first = first.unionByName(stash(step(first, True), "probes"))
    return first, step(first, False)


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by ``query_every``."""
    first, rest = _searched(vectors, k, query_every, id_col, vector_col, scale)
    found = first.unionByName(rest).where(F.col("query_uid").isNotNull())
    rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_report(vectors: DataFrame, k: int = 5, query_every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """One row: blocks (pairs of a query and a block there are), scored (pairs whose vectors were scored)."""
    first, rest = _searched(vectors, k, query_every, id_col, vector_col, scale)
    rows = stash(integer_vectors(vectors, id_col, vector_col, scale), "vectors")
    n = rows.agg(F.ceil(F.count("*") / BLOCK).alias("b"), F.count_if(F.col("vec_id") % query_every == 0).alias("q"))
    scored = first.unionByName(rest).agg(F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"))
    return n.crossJoin(scored).select((F.col("b") * F.col("q")).alias("blocks"), "scored")  # one row each
