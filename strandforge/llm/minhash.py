"""Near duplicates by min-max hashing over word shingles, with links confirmed on full sets.

Each document's set of 5-word shingles is hashed by ``PERMUTATIONS`` multiplications, and both the smallest and the
largest value of each are kept: two unbiased values for one evaluation. The values are cut into ``BANDS`` bands of
``ROWS``; documents that share a band are candidates. At a similarity of 0.85 a pair misses all bands with a
probability of 3e-7. One bit of each value also bounds the similarity of a pair: more than ``BITS_OFF`` of 192 bits
differ with a probability under 1e-9 at 0.85 or more.

1. Documents with equal sets become one class; only its smallest doc_id goes on.
2. Every member of a bucket is compared, on full sets, with the bucket's smallest document: a star, not all pairs.
3. What those links connect needs no more comparing. Buckets in which more than ``BLOCK`` members stay outside of the
   component that most belong to get further stars, around one member inside of it and one outside, drawn anew for each bucket and
   round. A connected family of any size joins in a few rounds, at a cost that grows with its rows.
4. In buckets that still hold several components, the members outside of the one that most belong to are compared with all
   members that are not connected to them, in blocks of ``BLOCK`` documents: first on bits, then on the full sets of
   those documents that have an open pair. A pair that shares several buckets is opened in its first one only. No link
   between different sets is lost beyond the odds above.
5. The links' connected components come from alternating star contraction, each round written to the shared folder.

No step gathers a bucket: it is aggregated, joined and cut into blocks. Only links and open blocks leave a task.

Nulls and edge cases: a null, empty or blank text has no shingles and is linked with nothing; fewer than 5 words make
one shingle; a null doc_id is linked with nothing, has a null component and is kept; repeated rows have one doc_id and
share its result; different texts of one doc_id are documents of their own, each of which can be linked; a very long text is hashed STEP shingles at a time, whole; pairs at exactly the threshold are linked, and
of equal texts the smallest doc_id stands for all; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, slices, stash

PERMUTATIONS, BANDS, ROWS, BITS_OFF = 96, 32, 6, 40
WORDS, PERCENT, BLOCK = 5, 85, 128
#: Rounds of further stars at most; they end before where a round saves less than a tenth of the comparing.
STARS = 8
SEED = 20_240_607
#: What bounds the similarity of a pair without its sets.
FACTS = ("n_shingles", "b1", "b2", "b3")
#: Shingles hashed at a time, and columns of a comparison at a time.
STEP, COLUMNS = 4096, 1 << 14
#: Bytes of text hashed at a time: a byte takes some twenty of numbers.
TEXT_STEP = 1 << 20
C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * C1
    x ^= x >> np.uint64(29)
    x *= C2
    x ^= x >> np.uint64(32)
    return x


def shingles(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; null counts as empty."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = pc.list_flatten(lists)
    filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(filled)])[lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]]
    coded = flat.dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) for w in distinct), np.uint64, len(distinct))  # bytes: A-Z only
    h = own[coded.indices.to_numpy(zero_copy_only=False)][filled] if len(own) else np.zeros(0, np.uint64)
    wide = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for n in range(words):
        wide = _mix(wide ^ h[n : n + len(wide)])
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(wide[a : b - words + 1]))
        elif b > a:
            one = np.array([b - a], np.uint64)
            for x in h[a:b]:
                one = _mix(one ^ x)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def min_max(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Smallest, then largest value of the set under each multiplication."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(factors), np.uint64)
    for at in range(0, len(found), STEP):
        values = factors[:, None] * found[None, at : at + STEP]
        np.minimum(low, values.min(1), out=low)
        np.maximum(high, values.max(1), out=high)
    return np.concatenate([low, high])


def factors(n: int = PERMUTATIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2"))


def signatures(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t1 and t2 (128 bits of the text), n_shingles, digest of the set, bands (bucket of each), b1 to b3 (a bit of each value)."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = factors()
        for batch in slices(batches, limit=TEXT_STEP):
            sets = shingles(batch.column(1), words)
            values = np.stack([min_max(s, by) for s in sets])
            bands = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sets), BANDS)).copy()
            for n in range(ROWS):
                bands = _mix(bands ^ values.reshape(len(sets), BANDS, ROWS)[:, :, n])
            bits = np.packbits((values >> np.uint64(7)) & np.uint64(1) == 1, axis=1).view("<i8")
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in (0, 2, 3)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(bands.view(np.int64).ravel())),
                    *(pa.array(bits[:, n]) for n in range(3)),
                ],
                names=["doc_id", "t1", "t2", "n_shingles", "digest", "bands", "b1", "b2", "b3"],
            )

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, t1 long, t2 long, n_shingles long, digest binary, bands array<long>, b1 long, b2 long, b3 long")


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """id, shingles (distinct hashes) of id, text rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_STEP):
            sets = shingles(batch.column(1), words)
            ends = np.cumsum([0, *map(len, sets)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))], names=["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles array<long>")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches."""
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        if not len(held):
            continue
        columns = [held[k].to_numpy() for k in keys]
        cut = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1).tolist()]
        for a, b in zip(cut, cut[1:], strict=False):
            yield held.slice(a, b - a)
        held = held.slice(cut[-1])
    if held is not None and len(held):
        yield held


def open_rows(bucket: int, label: np.ndarray, block: np.ndarray, n: np.ndarray, bits: np.ndarray, bands: np.ndarray, percent: int) -> np.ndarray:
    """Which rows have a pair that is not connected, may be similar enough, and shares no earlier bucket."""
    close = np.zeros((len(label), len(label)), np.int64)
    for k in range(bits.shape[1]):
        close += np.bitwise_count(bits[:, None, k] ^ bits[None, :, k])
    may = (close <= BITS_OFF) & (label[:, None] != label[None, :]) & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :]))
    if len(set(block.tolist())) > 1:
        may &= block[:, None] != block[None, :]  # pairs within a block have a group of their own
    found = np.zeros(len(label), bool)
    for a in np.flatnonzero(may.any(1)):
        others = np.flatnonzero(may[a])
        first = bands[a][(bands[a] == bands[others]).argmax(1)]
        if len(others := others[first == bucket]):
            found[a] = True
            found[others] = True
    return found


def similar(sets: list[np.ndarray], label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs that join different labels and are similar enough; those within one new component are left out."""
    sizes = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), sizes)
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for start in range(0, int(flat[-1]) + 1 if len(flat) else 0, COLUMNS):
        a, b = np.searchsorted(flat, [start, start + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[a:b], flat[a:b] - start] = 1
        common += part @ part.T
    both = np.rint(common).astype(np.int64)
    hit = (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)) & (label[:, None] != label[None, :])
    root = {int(x): int(x) for x in label}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(*np.nonzero(np.triu(hit)), strict=True):
        x, y = top(int(label[a])), top(int(label[b]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(a), int(b)))
    return out


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id) of every id in the links a, b: large-star and small-star rounds until nothing changes."""
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        before, edges = edges, stash(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before)
        now = mark(edges)
        if now == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = now


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, main (the label of most members), n_main and n_out (members with it and with others) of buckets with several labels."""
    each = members.join(labels, "id").groupBy("bucket", "label").agg(F.count("*").alias("n"))
    per = each.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("all"))
    return stash(per.select("bucket", F.col("most.label").alias("main"), F.col("most.n").alias("n_main"), (F.col("all") - F.col("most.n")).alias("n_out")).where("n_out > 0"), "mixed")


def _likely(a: str, b: str, percent: int) -> Column:
    """Whether bits and sizes leave a pair open; ``a`` and ``b`` stand before the names of its columns."""
    off = sum((F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in ("b2", "b3")), F.bit_count(F.col(f"{a}b1").bitwiseXOR(F.col(f"{b}b1"))))
    return (off <= BITS_OFF) & (100 * F.least(f"{a}n_shingles", f"{b}n_shingles") >= percent * F.greatest(f"{a}n_shingles", f"{b}n_shingles"))


def _star_pairs(crowd: DataFrame, labels: DataFrame, mixed: DataFrame, turn: int, percent: int) -> DataFrame:
    """a, b: two centers of each bucket, one inside and one outside of its main component, with the members that are not connected to
    them and may be similar enough. ``crowd`` has bucket, id and FACTS, so that only such pairs are shuffled."""
    own = crowd.join(labels, "id").join(mixed, "bucket").select("bucket", "id", "label", *FACTS, (F.col("label") != F.col("main")).alias("outside"))
    drawn = F.min(F.struct(F.xxhash64("id", "bucket", F.lit(turn)), F.col("id").alias("a"), F.col("label").alias("la"), *FACTS)).alias("c")
    centers = own.groupBy("bucket", "outside").agg(drawn).groupBy("bucket").agg(F.collect_list("c").alias("centers"))  # two at most
    pairs = own.join(centers, "bucket").select("id", "label", *FACTS, F.explode("centers").alias("c")).where((F.col("label") != F.col("c.la")) & _likely("c.", "", percent))
    return pairs.select(F.least("c.a", "id").alias("a"), F.greatest("c.a", "id").alias("b")).distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels``, one for all that the links connect."""
    ends = [labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}")) for c in "ab"]
    top = components(links.join(ends[0], "a").join(ends[1], "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    top = top.select(F.col("id").alias("label"), F.col("component").alias("top"))
    return stash(labels.join(top, "label", "left").select("id", F.coalesce("top", "label").alias("label")), "labels")


def _open_links(members: DataFrame, labels: DataFrame, mixed: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, size: int) -> DataFrame:
    """Links a, b between components that share a bucket (step 4)."""
    own = members.join(labels, "id")
    outside = F.col("label") != F.col("main")
    number = lambda c: F.ceil(F.col(c) / size).cast("long")
    per = mixed.select("bucket", "main", number("n_main").alias("mains"), number("n_out").alias("outs"))
    spread = F.xxhash64("id", "bucket")
    block = F.when(outside, F.col("mains") + F.pmod(spread, F.greatest("outs", F.lit(1)))).otherwise(F.pmod(spread, F.greatest("mains", F.lit(1))))
    placed = own.join(per, "bucket").withColumn("block", block)
    every = F.sequence(F.lit(0).cast("long"), F.col("mains") + F.col("outs") - 1)
    pairs = F.when(F.col("block") < F.col("mains"), F.transform(F.filter(every, lambda x: x >= F.col("mains")), lambda x: F.struct(F.col("block").alias("i"), x.alias("j")))).otherwise(
        F.transform(every, lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    )
    cells = placed.select("bucket", "id", "label", "block", F.explode(pairs).alias("cell")).select("bucket", "cell.i", "cell.j", "id", "label", "block")
    keys = ["bucket", "i", "j"]

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, keys):
            bits = np.stack([g[c].to_numpy().view(np.uint64) for c in ("b1", "b2", "b3")], 1)
            bands = pc.list_flatten(g["bands"]).to_numpy().reshape(len(g), -1)
            found = open_rows(g["bucket"][0].as_py(), g["label"].to_numpy(), g["block"].to_numpy(), g["n_shingles"].to_numpy(), bits, bands, percent)
            if found.any():
                yield from g.filter(pa.array(found)).select([*keys, "id", "label"]).combine_chunks().to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, keys):
            ids = g["id"].to_numpy()
            found = similar([np.asarray(x.values) for x in g["shingles"]], g["label"].to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in found], pa.int64()), pa.array([ids[b] for _, b in found], pa.int64())], names=["a", "b"])

    facts = reps.select(F.col("rep").alias("id"), "n_shingles", "bands", "b1", "b2", "b3")
    open_ = cells.join(facts, "id").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(narrow, "bucket long, i long, j long, id long, label long")
    return open_.join(sets, "id").select(*keys, "id", "label", "shingles").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, t1, t2 (128 bits of the text) for each row of ``docs``."""
    if percent < 80 or words < 1:
        raise ValueError("bands and bits are laid out for similarities of 0.8 or more")
    base = stash(signatures(docs, words, id_col, text_col), "signatures")
    linked = base.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "bands", "b1", "b2", "b3")]
    # a class goes by a number of its own, since a doc_id may stand on several texts
    first = F.min(F.struct("doc_id", "t1", "t2")).alias("first")
    reps = stash(linked.groupBy("digest").agg(first, *firsts).withColumn("rep", F.monotonically_increasing_id()), "classes")
    buckets = reps.select(F.col("rep").alias("id"), F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("center")).where("n > 1").select("bucket", "center")
    members = stash(buckets.join(shared, "bucket"), "members")
    ids = members.select("id").distinct()
    wanted = reps.select(F.col("rep").alias("id"), "first.*").join(ids, "id", "left_semi")
    sets = stash(shingle_sets(_texts(docs, id_col, text_col).join(wanted, ["doc_id", "t1", "t2"]).dropDuplicates(["id"]).select("id", "text"), words), "sets")

    def side(name: str) -> tuple[DataFrame, DataFrame]:
        facts = reps.select(F.col("rep").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in FACTS))
        return facts, sets.select(F.col("id").alias(name), F.col("shingles").alias(f"{name}_set"))

    (a_facts, a_sets), (b_facts, b_sets) = side("a"), side("b")
    both = F.size(F.array_intersect("a_set", "b_set"))
    union = F.size("a_set") + F.size("b_set") - both

    def confirmed(likely: DataFrame) -> DataFrame:
        return stash(likely.join(a_sets, "a").join(b_sets, "b").where(100 * both >= percent * union).select("a", "b"), "links")

    star = members.where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    links = confirmed(star.join(a_facts, "a").join(b_facts, "b").where(_likely("a_", "b_", percent)).select("a", "b"))

    # part of the components, enough to spare comparing: the smallest center of each document, followed twice
    up = stash(links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("label")), "labels")
    for _ in range(2):
        up = up.join(up.select(F.col("id").alias("label"), F.col("label").alias("next")), "label", "left").select("id", F.coalesce("next", "label").alias("label"))
    labels = stash(ids.join(up, "id", "left").select("id", F.coalesce("label", "id").alias("label")), "labels")
    mixed = _mixed(members, labels)
    crowded = lambda: mixed.where(F.col("n_out") > block)
    cost = lambda: crowded().agg(F.sum(F.col("n_out") * (F.col("n_main") + F.col("n_out")))).first()[0] or 0
    left = cost()
    if left:
        facts = reps.select(F.col("rep").alias("id"), *FACTS)
        crowd = stash(members.join(crowded().select("bucket"), "bucket").join(facts, "id").select("bucket", "id", *FACTS), "crowd")
        for turn in range(STARS):
            new = confirmed(_star_pairs(crowd, labels, crowded(), turn, percent))
            labels = _merged(labels, new if turn else links.unionByName(new))
            links, mixed = links.unionByName(new), _mixed(crowd, labels)
            before, left = left, cost()
            if 10 * left > 9 * before or not left:
                break
        mixed = _mixed(members, labels)
    more = _open_links(members, labels, mixed, reps, sets, percent, block)
    found = components(links.unionByName(more))
    found = found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())  # the smallest one too
    classes = reps.select("digest", F.col("rep").alias("id"), F.col("first.doc_id").alias("doc_id"))
    least = classes.join(found, "id").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    within = found.join(least, "component").select("id", "component_id")
    named = classes.join(within, "id", "left").select("digest", F.coalesce("component_id", "doc_id").alias("component_id"))
    rows = base.select("doc_id", "n_shingles", "digest", "t1", "t2")
    alone = rows.where(F.col("digest").isNull() | F.col("doc_id").isNull()).withColumn("component_id", F.col("doc_id"))
    whole = rows.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull()).join(named, "digest")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return whole.unionByName(alone).select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "t1", "t2")


def keep_one(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns unchanged, without the rows that are linked with a smaller ``doc_id``. A row without ``doc_id`` stays;
    rows that share a ``doc_id`` are told apart by their texts."""
    gone = near_duplicates(docs, percent, words, block, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2"))
    text = docs[text_col].cast("string")
    same = (docs[id_col].cast("long") == gone["__id"]) & (F.xxhash64(F.lit(1), text) == gone["__t1"]) & (F.xxhash64(F.lit(2), text) == gone["__t2"])
    return docs.join(gone, same, "left_anti")
