"""Vector codes against plain ones."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandforge.llm import codes, queries

SCHEMA = "vec_id long, embedding array<double>, label int"
FIELDS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def plain(rows, parts=8, entries=16, rounds=6):
    """FIELDS of (vec_id, vector, label) rows, with Python's integers and all entries compared."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max([0, *(len(v) for _, v, _ in kept)]) // parts) * parts
    size = width // parts
    bound = codes.most(size)
    whole = [[math.floor(max(-bound, min(bound, 4096 * x))) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for v in whole]
    first = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, whole[n]))[:entries]
    books = [[list(cut[n][p]) for n in first] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda part, book: min((apart(part, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = [best(c[p], books[p])[1] for c in cut]
            for k in range(len(books[p])):
                own = [c[p] for c, o in zip(cut, of, strict=True) if o == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[best(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        by[lab] = by.get(lab, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, by[lab], digest) for (i, _, lab), f, e in zip(kept, found, errors, strict=True)), key=str)


def coded(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in codes.vector_codes(df).collect()), key=str)


def made(seed, n):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(size=20).round(1 + i % 3)], int(i % 3)) for i in rng.permutation(n)]
    rows += [(1000 + i, rows[0][1], None) for i in range(30)] + rows[:3]  # copies, repeated rows
    rows += [(2000, None, 1), (2001, [1.0, None], 1), (2002, [float("nan")], 1), (2003, [float("inf")], 1), (2004, [], 2), (2005, [1e300, -1e300, 7.0], 2), (None, [0.5] * 20, None), (-4, [0.0] * 20, 0), (-3, [-0.0] * 21, 0)]
    return rows


@pytest.mark.parametrize("n", [0, 5, 160])
def test_codes_equal_plain_ones(spark, n):
    rows = {0: [(2000, None, 1)], 5: made(5, 5)[5 : 5 + 30 : 6], 160: made(160, 160)}[n]
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    assert coded(df.repartition(3)) == want
    clash = df.select("*", *(F.lit("clash").alias(c) for c in ("v", "code", "n", "error", "part", "entry", "total", "text")))
    assert coded(clash) == want


def test_codes_of_nothing(spark):
    assert coded(spark.createDataFrame([], SCHEMA)) == []
    assert coded(spark.createDataFrame([(1, [], 2), (2, [], None)], SCHEMA)) == plain([(1, [], 2), (2, [], None)])


@pytest.mark.parametrize("seed", range(6))
def test_the_tree_finds_the_nearest_entry(seed):
    rng = np.random.default_rng(seed)
    scale = 10 ** (seed + 1)
    entries = rng.integers(-scale, scale, (16, 1 + seed))
    entries[[3, 9, 12]] = entries[0]  # equal entries
    rows = np.concatenate([rng.integers(-scale, scale, (500, 1 + seed)), entries, (entries[:8] + entries[8:]) // 2])
    every = ((rows[:, None] - entries[None]) ** 2).sum(2)
    index, squared, seen = codes.nearest(rows, entries)
    assert (index == every.argmin(1)).all() and (squared == every.min(1)).all()
    assert seen <= every.size and (seed > 1 or seen < 0.8 * every.size)


def test_codes_of_a_given_table(spark):
    df = queries.table(spark, "/root/testdata/sf0.001", "embeddings")
    assert coded(df) == plain([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])
