"""Prefix trie of conversations, merged family by family.

A family is the conversations of one base id (``conv_id - conv_id % FAMILY``, with the remainder's sign that of the id).
Every conversation is rebuilt as the first turns of its base conversation and its own turns behind them; a node of the
trie is a distinct sequence of first turns.

1. Turns become 128-bit digests of role and text. The base's turns and those of its other members meet in a cogroup by
   base id, are put in order and rebuilt; a family's sequences are written as arrays of prefix keys and bytes. The key of
   a prefix combines the digests of its turns, each mixed with its place.
2. Families build their small tries: a row for each node, with what its members there come to. Only these combined rows are
   shuffled, and merge by key. Children are counted by their parents' keys.
3. What is summed over subtrees must count a node once, whichever families have it. A node's owner is its smallest member; what
   a conversation owns is the end of its own path. So a family that knows where each member's part begins can sum what its
   members own below each of its nodes, and these sums merge by key like the first ones: no walk over levels, and no
   limit to the depth.
4. The ids that end in a node, of which there may be very many, are joined to text in ranges of RANGE ids, in parallel; one
   task then streams the few ranges of a node through SHA-256, which allows no other order, and holds one at a time.

A family's turns are held by one task, at about 40 bytes each; a family has at most nine ids, its conversations may be long.

Nulls and edge cases: rows with a null ``conv_id`` take no part; a null turn stands first; a null role or text is empty; turns
with the same number are put in the order of their digests, and repeated rows are turns of their own; a base that is absent
gives no turns; a conversation without turns left ends in the root; an empty table gives no rows, not even a root; very long
texts are digested whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, looked_up, stash

#: Ids of a family; a conversation takes fewer than HEADS turns of its base.
FAMILY, HEADS = 5, 9
#: Neighbouring ids whose text is made in one row.
RANGE = 1 << 14
NODE = ["depth", "k1", "k2"]
FAMILIES = "base long, convs array<long>, sizes array<int>, k1 array<long>, k2 array<long>, bytes array<long>"
PARTIAL = "depth int, k1 long, k2 long, p1 long, p2 long, conv_id long, n long, bytes long, path_bytes long"


def heads(conv_id: int) -> int:
    """Turns that a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def _mixed(digests: np.ndarray) -> np.ndarray:
    """Keys of all prefixes: each digest is mixed with its place, so that their combination tells the sequence."""
    x = digests.view(np.uint64) + np.arange(1, len(digests) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.bitwise_xor.accumulate(x ^ (x >> np.uint64(31))).view(np.int64)


def _turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    digest = lambda seed: F.xxhash64(F.lit(seed), "role", "text")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    known = F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn")
    return rows.select(base.alias("base"), "conv_id", *known, digest(1).alias("d1"), digest(2).alias("d2"), F.octet_length("text").cast("long").alias("bytes"))


def rebuilt(base: pa.Table, others: pa.Table) -> pa.Table:
    """A family's row of FAMILIES, of the turns of its base conversation and of its other members."""
    both = pa.concat_tables([base, others])
    at = {c: both.column(c).to_numpy() for c in ("conv_id", "numbered", "turn", "d1", "d2", "bytes")}
    order = np.lexsort((at["d2"], at["d1"], at["turn"], at["numbered"], at["conv_id"]))
    ids, starts = np.unique(at["conv_id"][order], return_index=True)
    turns = dict(zip(ids.tolist(), np.split(order, starts[1:]), strict=True))
    family = both.column("base")[0].as_py()
    first = turns.get(family, order[:0])
    out: dict[str, list[np.ndarray]] = {"k1": [], "k2": [], "bytes": []}
    root = np.zeros(1, np.int64)
    for conv, own in turns.items():
        n = heads(conv)
        path = np.concatenate([first[:n], own[n:]])
        for name, values in (("k1", _mixed(at["d1"][path])), ("k2", _mixed(at["d2"][path])), ("bytes", at["bytes"][path])):
            out[name].append(np.concatenate([root, values]))
    sizes = [len(k) for k in out["k1"]]
    lists = [pa.array([x], t) for x, t in ((list(turns), pa.list_(pa.int64())), (sizes, pa.list_(pa.int32())), *((np.concatenate(out[c]), pa.list_(pa.int64())) for c in out))]
    return pa.Table.from_arrays([pa.array([family], pa.int64()), *lists], names=["base", "convs", "sizes", *out])


def families(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row of FAMILIES for each base id: its conversations and, for each of them from the root on, the keys and bytes of its nodes."""
    turns = _turns(conversations, id_col, turn_col, role_col, text_col)
    base, others = turns.where("conv_id = base"), turns.where("conv_id <> base")
    return base.groupBy("base").cogroup(others.groupBy("base")).applyInArrow(rebuilt, FAMILIES)


class Paths:
    """The nodes on the paths of some families' conversations, one behind the other."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        flat = lambda c: batch.column(batch.schema.get_field_index(c)).flatten().to_numpy()
        self.convs, self.sizes, self.k1, self.k2, self.bytes = (flat(c) for c in ("convs", "sizes", "k1", "k2", "bytes"))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.depth = (np.arange(len(self.k1)) - self.starts[self.of]).astype(np.int32)

    def below(self, first: np.ndarray) -> np.ndarray:
        """Bytes of a path from each of its nodes on, or from the depth ``first`` of its conversation on if that is further down."""
        total = np.concatenate([[0], np.cumsum(self.bytes)])
        ends = (self.starts + self.sizes)[self.of]
        begin = self.starts[self.of] + np.maximum(self.depth, first[self.of])
        return total[ends] - total[np.minimum(begin, ends)]

    def merged(self, sums: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(a place of each distinct node, that of its smallest member; sums over its places)."""
        order = np.lexsort((self.convs[self.of], self.k2, self.k1, self.depth))
        new = np.ones(len(order), bool)
        new[1:] = np.any([np.diff(x[order]) != 0 for x in (self.depth, self.k1, self.k2)], axis=0)
        starts = np.flatnonzero(new)
        return order[starts], {c: np.add.reduceat(x[order], starts) if len(starts) else x for c, x in sums.items()}


def family_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PARTIAL of the tries of families."""
    for batch in batches:
        p = Paths(batch)
        one, sums = p.merged({"n": np.ones(len(p.k1), np.int64), "path_bytes": p.below(np.zeros(len(p.convs), np.int64))})
        inner = p.depth[one] > 0
        parent = lambda k: np.where(inner, k[one - 1], 0)
        columns = [p.depth[one], p.k1[one], p.k2[one], parent(p.k1), parent(p.k2), p.convs[p.of[one]], sums["n"], p.bytes[one], sums["path_bytes"]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split(" ")[0] for f in PARTIAL.split(", ")])


def family_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node in which each conversation ends."""
    for batch in batches:
        p = Paths(batch)
        last = p.starts + p.sizes - 1
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p.depth[last], p.k1[last], p.k2[last], p.convs)], names=[*NODE, "conv_id"])


def family_owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes and leaves that members own below each node of families with the column ``owners`` (conv_id, first, leaf)."""
    for batch in batches:
        p = Paths(batch)
        owners = {o["conv_id"]: (o["first"], o["leaf"]) for row in batch.column(batch.schema.get_field_index("owners")).to_pylist() for o in row or []}
        known = [owners.get(c, (np.iinfo(np.int32).max, False)) for c in p.convs.tolist()]
        first, leaf = np.array([k[0] for k in known], np.int64), np.array([k[1] for k in known], np.int64)
        one, sums = p.merged({"owned_bytes": p.below(first), "n_leaves": leaf[p.of]})
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p.depth[one], p.k1[one], p.k2[one], sums["owned_bytes"], sums["n_leaves"])], names=[*NODE, "owned_bytes", "n_leaves"])


def _digested(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the texts of each node, which come one behind the other in order."""
    import hashlib

    node, running = None, hashlib.sha256()
    for frame in frames:
        done = []
        for depth, k1, k2, text in frame[[*NODE, "ids"]].itertuples(index=False):
            if (depth, k1, k2) != node:
                if node is not None:
                    done.append((*node, running.hexdigest()))
                node, running = (depth, k1, k2), hashlib.sha256(text.encode())
            else:
                running.update(b"," + text.encode())
        yield pd.DataFrame(done, columns=[*NODE, "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, running.hexdigest())], columns=[*NODE, "ends_sha256"])


def end_digests(paths: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256 of the nodes in which conversations end."""
    ends = paths.select("convs", "sizes", "k1", "k2", "bytes").mapInArrow(family_ends, "depth int, k1 long, k2 long, conv_id long")
    ranges = ends.groupBy(*NODE, F.floor(F.col("conv_id") / RANGE).alias("range")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))  # RANGE ids
    texts = ranges.select(*NODE, "range", F.array_join("ids", ",").alias("ids"))
    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "range").mapInPandas(_digested, "depth int, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    bound_batches(conversations.sparkSession)
    paths = stash(families(conversations, id_col, turn_col, role_col, text_col), "families")
    own = paths.select("convs", "sizes", "k1", "k2", "bytes")
    sums = [F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("path_bytes").alias("path_bytes")]
    merged = stash(own.mapInArrow(family_nodes, PARTIAL).groupBy(*NODE).agg(*sums), "nodes")
    children = merged.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = stash(merged.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "children")
    # where the part of its path begins that a conversation owns, and whether that ends in a leaf
    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("first"), F.max(F.col("n_children") == 0).alias("leaf"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    owners = owners.groupBy(base.alias("base")).agg(F.collect_list(F.struct("conv_id", "first", "leaf")).alias("owners"))  # a family's ids
    owned = paths.join(owners, "base").select("convs", "sizes", "k1", "k2", "bytes", "owners").mapInArrow(family_owned, "depth int, k1 long, k2 long, owned_bytes long, n_leaves long")
    owned = owned.groupBy(*NODE).agg(F.sum("owned_bytes").alias("owned_bytes"), F.sum("n_leaves").alias("n_leaves"))
    whole = stash(nodes.join(owned, NODE).join(end_digests(paths), NODE, "left"), "trie")
    parents = whole.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n_siblings"))
    return looked_up(whole, parents, ["depth", "p1", "p2"], "n_siblings").select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("path_bytes") - F.col("owned_bytes")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
