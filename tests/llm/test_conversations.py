"""The conversation trie against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from strandforge.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string"
FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Rows of FIELDS for (conv_id, turn, role, text) rows without ties of a turn."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    members = defaultdict(list)
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    weight = {n: (len(m) - 1) * len(n[-1][1].encode()) if n else 0 for n, m in members.items()}
    children = defaultdict(int)
    for n in members:
        if n:
            children[n[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for n in members:
        for d in range(len(n) + 1):
            saved[n[:d]] += weight[n]
            leaves[n[:d]] += children[n] == 0
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if paths[c] == n))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in conversations.prefix_trie(df).collect()), key=str)


def made(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-12, 60), 10**12, 10**12 + 3]:
        if c % 7 == 3:
            continue
        numbers = rng.sample(range(-3, 30), rng.randint(1, 12))
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "ü👍", "", None])) for t in numbers]
        if c % 4 == 0:
            rows.append((c, None, "system", "first"))
    rows += [(None, 1, "user", "x"), (200, 0, "user", "long " * 50_000), (201, 0, "user", "long " * 50_000)]
    rows += [(c, t, "user", f"turn {t}") for c in range(300, 340) for t in range(3)]  # copies
    rows += [(400, t, "user", f"deep {t % 5}") for t in range(700)]
    rng.shuffle(rows)
    return rows


def test_trie_equals_a_plain_one(spark, monkeypatch):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    assert found(df) == want
    clash = df.select("*", *(F.lit("clash").alias(n) for n in ("base", "depth", "k1", "n", "ids", "owners", "digest")))
    monkeypatch.setattr(conversations, "RANGE", 4)  # ends of a node in several ranges
    assert found(clash.repartition(13)) == want


def test_trie_of_ties_repeats_and_nothing(spark):
    rows = [(5, 1, "user", "a"), (5, 1, "user", "b"), (5, 1, "user", "b"), (6, 1, "user", "b"), (6, 1, "user", "a"), (6, 1, "user", "b")]
    one = found(spark.createDataFrame(rows, SCHEMA))
    assert one == found(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3))
    assert max(r[1] for r in one) == 3  # repeated rows are turns
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)) == []


def test_trie_of_a_given_table(spark):
    df = queries.table(spark, "/root/testdata/sf0.01", "conversations")
    assert found(df) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_frequent_keys_are_looked_up_apart(spark, monkeypatch):
    from strandforge.llm import common

    rows = spark.createDataFrame([(i % 7, i) for i in range(70)] + [(99, 1), (None, 2)], "k long, v long")
    groups = spark.createDataFrame([(k, f"g{k}", 60 if k == 3 else 1) for k in range(7)], "k long, name string, n long")
    plain = sorted(((r["k"], r["v"], r["name"]) for r in rows.join(groups, "k", "left").collect()), key=str)
    for share in (1, 2, 4096):
        monkeypatch.setattr(common, "HOT_SHARE", share)
        assert sorted(((r["k"], r["v"], r["name"]) for r in common.looked_up(rows, groups, ["k"], "n").collect()), key=str) == plain
    assert common.looked_up(rows, groups.limit(0), ["k"], "n").count() == rows.count()
