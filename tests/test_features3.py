"""Tag libraries, learned vocabularies, keyed permutations, loaders, walks without matrices, votes for offsets: against plain versions."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandforge import queries
from strandforge.operators import features, graphs, kernels, lookup, splits, tag_index, tags, variants

DATA = "/root/testdata/sf0.001"


def plain_windows(seq, tag, cutoff):
    """(start, identity) of the windows of a sequence that are a tag, by comparing all symbols of all windows."""
    n = len(tag)
    if n >= len(seq):
        return []
    a, b = np.frombuffer(seq.encode("latin-1", "replace"), np.uint8), np.frombuffer(tag.encode(), np.uint8)
    same = np.zeros(len(a) - n + 1, np.int64)
    for i in range(n):
        same += a[i : len(a) - n + 1 + i] == b[i]
    return [(int(i), round(100 * int(s) / n, 2)) for i, s in enumerate(same) if round(100 * int(s) / n, 2) >= cutoff]


def test_library_of_150_tags_against_brute_force(spark):
    """Each type, lengths 5 to 1,024, planted whole, altered and cut off; read from a file."""
    listed = queries.made_library()
    assert len(listed) == 150 and len({n for n, _ in listed}) > 96 and (min(len(t) for _, t in listed), max(len(t) for _, t in listed)) == (5, 1024)
    library = queries.library(spark)
    assert [(r["name"], r["tag"]) for r in library.orderBy("place").collect()] == listed
    rng = np.random.default_rng(4)
    seqs = ["", "A", "ÄÖ日本" * 30]
    for i, (_, t) in enumerate(listed):
        noise = "".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), rng.integers(0, 60)))
        changed = np.array(list(t))
        changed[rng.choice(len(t), int(len(t) * (0.1 if i % 2 else 0.12)), replace=False)] = "A"
        seqs.append(noise + [t, "".join(changed), t[1:], "日" + t][i % 4] + noise[::-1] + ("".join(changed) if i % 5 == 0 else ""))
    df = spark.createDataFrame(list(enumerate(seqs)) + [(1000, None)], "id int, s string").repartition(3)
    kinds = {r["place"]: r["type"] for r in library.collect()}
    for cutoff in (80.0, 90.0, 100.0):
        got = {(r["id"], r["place"], r["start"], r["end"], r["identity"]) for r in tags.tag_hits(df, library, "id", "s", cutoff).collect()}
        want = set()
        for i, s in enumerate(seqs):
            for p, (_, t) in enumerate(listed):
                if kinds[p] != "fusion" or len(s) - len(t) >= 25:
                    want |= {(i, p, at, at + len(t), x) for at, x in plain_windows(s, t, cutoff)}
        assert got == want and len({w[1] for w in want}) > 70


def test_tag_index_across_steps(monkeypatch):
    rng = np.random.default_rng(6)
    library = ["".join(rng.choice(list("ACGT"), n)) for n in (1, 3, 8, 40, 64, 65, 130, 300)]
    texts = ["".join(rng.choice(list("ACGTX"), n)) + t + "".join(rng.choice(list("ACGT"), 9)) for n, t in zip((0, 5, 64, 200, 1, 2, 700, 3), library, strict=True)] + [None, ""]
    want = {(i, t, at, round(len(tag) * (1 - x / 100))) for i, s in enumerate(texts) for t, tag in enumerate(library) for at, x in plain_windows(s or "", tag, 70.0)}
    want = {w for w in want if len(library[w[1]]) < len(texts[w[0]] or "")}
    for step in (50, 333, 1 << 20):
        monkeypatch.setattr(tag_index, "STEP", step)
        monkeypatch.setattr(tag_index, "WINDOWS", 7)
        found = list(zip(*(x.tolist() for x in tag_index.TagIndex(library, 70.0).search(texts)), strict=True))
        assert len(found) == len(set(found)) and {f for f in found if len(library[f[1]]) < len(texts[f[0]] or "")} == want


def test_mismatches_allowed():
    for cutoff in (80.0, 90.0, 99.99):
        for n in (1, 2, 7, 13, 100, 1024, 20_000):
            m = tag_index.most_mismatches(n, cutoff)
            assert round(100 * (n - m) / n, 2) >= cutoff and (m == n or round(100 * (n - m - 1) / n, 2) < cutoff)


@pytest.mark.parametrize("k", [1, 2, 5, 9])
def test_row_ngrams_and_sparse_vectors(spark, monkeypatch, k):
    monkeypatch.setattr(kernels, "SYMBOLS", 40)
    texts = {1: "ABABA", 2: "", 3: None, 4: "日本日本語👍🏽👍🏽", 5: "A" * 50, 6: "xy" * 30, 7: "ABABAQ"}
    df = spark.createDataFrame(list(texts.items()), "id int, s string").repartition(2)
    want = {i: Counter((t or "")[a : a + n] for n in range(max(1, k - 1), k + 1) for a in range(len(t or "") - n + 1)) for i, t in texts.items()}
    got = {(r["id"], r["gram"]): r["n"] for r in kernels.row_ngrams(df, "id", "s", max(1, k - 1), k).collect()}
    assert got == {(i, g): n for i, c in want.items() for g, n in c.items()}
    vocabulary = sorted({g for c in want.values() for g in c})
    table = kernels.vocabulary_table(df, "s", max(1, k - 1), k)
    assert [(r["gram"], r["id"]) for r in table.orderBy("id").collect()] == [(g, i) for i, g in enumerate(vocabulary)]
    for share in (1, 10**6):
        monkeypatch.setattr(lookup, "HOT_SHARE", share)
        rows = {r["id"]: r for r in kernels.sparse_ngrams(df, "id", "s", max(1, k - 1), k, table).collect()}
        assert set(rows) == set(texts)
        for i, r in rows.items():
            assert r["size"] == len(vocabulary) and dict(zip([vocabulary[x] for x in r["indices"]], r["counts"], strict=True)) == want[i] and r["indices"] == sorted(r["indices"])
    few = table.where(F.col("id") % 2 == 0)
    other = {r["id"]: r for r in kernels.sparse_ngrams(df, "id", "s", max(1, k - 1), k, few).collect()}
    assert all(set(r["indices"]) == {x for x in rows[i]["indices"] if x % 2 == 0} for i, r in other.items())


def test_a_vocabulary_of_half_a_million(spark):
    """No entry becomes an expression of the plan."""
    df = spark.range(130_000).select("id", F.concat(F.lpad(F.conv("id", 10, 36), 5, "0"), F.lit("-"), F.reverse(F.lpad(F.conv("id", 10, 36), 5, "0"))).alias("s"))
    table = kernels.vocabulary_table(df, "s", 6, 6)
    assert table.count() > 500_000
    row = kernels.sparse_ngrams(df, "id", "s", 6, 6, table).agg(F.sum(F.size("indices")).alias("n"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("total"), F.min("size").alias("size")).first()
    assert row["total"] == 6 * 130_000 and row["size"] == table.count() and row["n"] <= row["total"]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000, 4099])
def test_keyed_permutation(spark, n):
    df = spark.range(n)
    got = df.select("id", splits.permuted(F.col("id"), n, 5).alias("p"), splits.permuted(F.col("id"), n, 5, 3).alias("p3"), splits.permuted(F.col("id"), n, 6).alias("q"), splits.permuted(F.col("id"), n, 5, 0).alias("none")).collect()
    p = {r["id"]: r["p"] for r in got}
    assert sorted(p.values()) == sorted(r["q"] for r in got) == list(range(n))
    assert all(r["p3"] == p[p[p[r["id"]]]] and r["none"] == r["id"] for r in got)
    if n >= 97:
        ranks = np.array([p[i] for i in range(n)])
        assert abs(np.corrcoef(ranks, np.arange(n))[0, 1]) < 5 / math.sqrt(n) and [r["q"] for r in got] != [r["p"] for r in got]
        assert (np.abs(np.diff(ranks)) == 1).sum() < 12
    with pytest.raises(Exception, match="row number"):
        spark.range(n + 1).select(splits.permuted(F.col("id"), n, 5)).collect()


def test_keyed_splits(spark):
    df = spark.range(103).withColumnRenamed("id", "index")
    placed = splits.with_folds(splits.with_train_test(df, 3, backend="keyed"), 10, 3, backend="keyed", column="fold")
    assert Counter(r[splits.TRAIN_TEST] for r in placed.collect()) == {"test": 21, "train": 82}
    assert Counter(r["fold"] for r in placed.collect()) == {**{f"split_{i}": 10 for i in range(9)}, "split_9": 13}
    plan = splits.position(df, 3, backend="keyed")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


@pytest.mark.parametrize(("n", "size"), [(10, 4), (17, 4), (17, 16), (64, 8), (1, 3), (0, 3)])
def test_loader(spark, n, size):
    rows = [(i, [float(i), i + 0.5], i % 3) for i in range(n)]
    df = spark.createDataFrame(rows, "index long, v array<double>, t int").repartition(3)
    for single in (False, True):
        loader = features.Loader(df, ("v", "index"), ("t",), size, 11, drop_single=single)
        m = n - 1 if single and n % size == 1 else n
        assert len(loader) == -(-m // size)
        order, seen = list(range(m)), {}
        shuffled = dict(df.where(F.col("index") < m).select("index", splits.permuted(F.col("index"), m, 11)).collect())
        for epoch in range(3):
            order = [x for _, x in sorted((shuffled[i], x) for i, x in enumerate(order))] if epoch else sorted(shuffled, key=shuffled.get)
            got = list(loader.epoch(epoch))
            assert [len(x["v"]) for x, _ in got] == [size] * (m // size) + [m % size] * (m % size > 0)
            flat = [int(i) for x, _ in got for i in x["index"][:, 0]]
            assert flat == order and sorted(flat) == list(range(m))
            assert all(x["v"].dtype == np.float32 and y["t"].shape == (len(x["v"]), 1) and (x["v"][:, 1] == x["v"][:, 0] + 0.5).all() and (y["t"][:, 0] == x["index"][:, 0] % 3).all() for x, y in got)
            seen[epoch] = flat
        assert m < 10 or seen[0] != seen[1] != seen[2]
    plain = features.Loader(df, ("v",), (), size, None)
    assert [int(v) for x, _ in plain.epoch() for v in x["v"][:, 0]] == list(range(n))


def test_walks_with_and_without_matrices(spark):
    rng = np.random.default_rng(2)
    adjacency = []
    for n in (1, 2, 5, 9):
        a = np.triu(rng.random((n, n)) < 0.5, 1).astype(float)
        a[np.arange(n - 1), np.arange(1, n)] = 1
        adjacency.append(np.maximum(a + a.T, np.eye(n) * (n == 1)))
    for a in adjacency:
        walk = (np.eye(len(a)) + a / a.sum(1, keepdims=True)) / 2
        want = np.stack([np.diag(np.linalg.matrix_power(walk, s + 2)) for s in range(12)], 1)
        assert np.allclose(graphs.return_probabilities(a, 12), want)
    directed = np.array([[0, 1, 0], [0, 0, 1], [1, 0, 0.0]])
    walk = (np.eye(3) + directed) / 2
    assert np.allclose(graphs.return_probabilities(directed, 3)[:, 2], np.diag(np.linalg.matrix_power(walk, 4)))
    with np.errstate(all="ignore"):
        assert np.isnan(graphs.return_probabilities(np.array([[0, 1, 0], [1, 0, 0], [0, 0, 0.0]]), 2)).all()
    cells = [(k, int(i), int(j)) for k, a in enumerate(adjacency) for i, j in zip(*np.nonzero(a), strict=True)]
    df = spark.createDataFrame(cells, "g int, row int, col int")
    for steps in (1, 2, 5):
        got = {(r["g"], r["node"], r["step"]): r["p"] for r in graphs.sparse_return_probabilities(df, "g", steps).collect()}
        want = {(k, i, s): p for k, a in enumerate(adjacency) for i, row in enumerate(graphs.return_probabilities(a, steps)) for s, p in enumerate(row)}
        assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], abs_tol=1e-12) for x in want)


@pytest.mark.parametrize("k", [1, 2, 7])
def test_running_means(spark, k):
    m = np.random.default_rng(k).normal(size=(7, 3))
    df = spark.createDataFrame([(1, m.tolist()), (2, m[:2].tolist())], "id int, m array<array<double>>")
    got = {r[0]: r[1] for r in df.select("id", kernels.mean_kmers(F.col("m"), k)).collect()}
    for i, x in ((1, m), (2, m[:2])):
        want = np.stack([x[a : a + k].ravel() for a in range(len(x) - k + 1)]).mean(0) if k <= len(x) else None
        assert got[i] is None if want is None else np.allclose(got[i], want)


def test_votes_for_offsets(spark):
    rng = np.random.default_rng(9)
    parents = {i: "".join(rng.choice(list("ACD"), n)) for i, n in enumerate((30, 30, 12, 3, 31))}
    at = {(p, parents[0][p + 4]) for p in (0, 3, 7, 15)} | {(9, "Z"), (3, "C")}
    df = spark.createDataFrame([([{"pos": p, "src": s, "targ": "X"}],) for p, s in sorted(at) * 2], "mutations array<struct<pos: int, src: string, targ: string>>")
    table = spark.createDataFrame(list(parents.items()), "parent_id int, sequence string")
    got = {(r["parent_id"], r["offset"]): (r["matches"], r["rank"]) for r in variants.offsets_on(df, table).collect()}
    lo, hi = min(p for p, _ in at), max(p for p, _ in at)
    want = {}
    for i, parent in parents.items():
        scored = sorted(((sum(parent[p + o] == s for p, s in at), o) for o in range(-lo, len(parent) - hi)), reverse=True)
        want |= {(i, o): (m, rank + 1) for rank, (m, o) in enumerate(scored)}
    assert got == want
    assert variants.offsets_on(df.limit(0), table).count() == 0


def test_frequent_keys_are_dealt(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 7, i) for i in range(70)] + [(99, 1), (None, 2)], "k long, v long")
    groups = spark.createDataFrame([(k, f"g{k}", 60 if k == 3 else 1) for k in range(7)], "k long, name string, n long")
    plain = sorted(((r["k"], r["v"], r["name"]) for r in rows.join(groups, "k", "left").collect()), key=str)
    for share in (1, 2, 4096):
        monkeypatch.setattr(lookup, "HOT_SHARE", share)
        assert sorted(((r["k"], r["v"], r["name"]) for r in lookup.looked_up(rows, groups, ["k"], "n").collect()), key=str) == plain
    assert lookup.looked_up(rows, groups.limit(0), ["k"], "n").count() == rows.count()


def test_strip_query_against_a_plain_walk(spark):
    """What a walk over sorted hits finds, in Python, for the sequences of the library query."""

    def walk(hits, text):
        near = lambda gap, n: abs(gap) <= (n - 1 if n <= tags.MARGIN else tags.MARGIN)
        first, last = 0, len(text)
        for start, end in sorted(hits):
            if not near(start - first, end - start):
                break
            first = end
        for start, end in sorted(hits, key=lambda h: -h[1]):
            if not near(end - last, end - start):
                break
            last = start
        at = text.find("M", first, first + tags.FIRST_M)
        return (at if at >= 0 else first), last

    rows = queries.library_tagged(spark, DATA).cache()
    hits = tags.nonredundant(tags.tag_hits(rows, queries.library(spark), "doc_id", "aa_seq"), "doc_id").collect()
    of = {r["doc_id"]: [(h["start"], h["end"]) for h in hits if h["doc_id"] == r["doc_id"]] for r in rows.collect()}
    found = queries.tag_library_strip(spark, DATA).collect()
    assert len(found) == len(of) and sum(r["n_end"] > 0 for r in found) > 20 and sum(r["c_start"] < len(r["aa_seq"]) for r in found) > 20
    assert all((r["n_end"], r["c_start"]) == walk(of[r["doc_id"]], r["aa_seq"]) for r in found)


def test_k_means_with_restarts(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([c + rng.normal(size=(40, 3)) * 0.1 for c in rng.normal(size=(5, 3)) * 5])
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "v array<double>").repartition(4)
    inertia = lambda centers: float(((x[:, None] - centers[None]) ** 2).sum(2).min(1).sum())
    many, found = kernels.k_means(df, "v", 5, 10)
    assert math.isclose(inertia(many), found, rel_tol=1e-6)
    one = [kernels.k_means(df, "v", 5, 1, seed)[1] for seed in range(3)]
    assert found <= min(one) + 1e-6 and found < 40 * 5 * 3 * 0.02
    again, _ = kernels.k_means(df.repartition(2), "v", 5, 10)
    assert np.allclose(sorted(map(tuple, many.round(6))), sorted(map(tuple, again.round(6))))
    assert len(kernels.k_means(df.limit(0), "v", 5)[0]) == 0 and len(kernels.k_means(df.limit(3), "v", 5)[0]) <= 3


def test_store_versions(spark, tmp_path):
    from strandforge.sources import store

    box = store.Store(spark, f"{tmp_path}/hub")
    df = spark.range(10)
    assert box.push(df, "a") == [] and box.versions("a") == [1]
    held = box.pull("a")
    # a table made of the stored one, as its next version; the first is still read
    assert box.push({"x": held.where("id < 4"), "y": held.where("id >= 4")}, "a") == [store.WHOLE]
    assert held.count() == 10 and box.pull("a", version=1).count() == 10 and box.pull("a", ["x"]).count() == 4 and box.splits("a") == ["x", "y"]
    # a push that fails on the way changes nothing
    bad = df.select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        box.push({"x": df, "z": bad}, "a")
    assert box.versions("a") == [1, 2] and box.splits("a") == ["x", "y"] and box.pull("a", ["x", "y"]).count() == 10
    # a manifest that is not written to its end is no commit
    box._create(f"{tmp_path}/hub/a/manifests/000003.json", '{"folder": "000', overwrite=False)
    assert box.versions("a") == [1, 2] and box.pull("a", ["x"]).count() == 4
    # of two pushes at once one fails
    with pytest.raises(Exception, match="exists"):
        box.push(df, "a")
    fs, at = box._path(f"{tmp_path}/hub/a/manifests/000003.json")
    fs.delete(at, True)
    assert box.push(df.limit(3), "a") == ["x", "y"] and box.versions("a") == [2, 3] and box.pull("a").count() == 3
    with pytest.raises(FileNotFoundError):
        box.pull("a", version=1)
    box.push({"s": df, "t": df.limit(0)}, "b")
    assert {(r["name"], r["split_info"], r["full_size"]) for r in box.explore().collect()} == {("a", "whole_dataset: 3", 3), ("b", "s: 10, t: 0", 10)}


def test_nested_columns_come_back(spark, tmp_path):
    from strandforge.sources import tables

    kind = "i int, a array<long>, b array<array<double>>, s struct<x: long, y: string, z: array<string>>, t string, j string"
    rows = [(1, [1, 2], [[0.5], []], (4, 'say "so", \\ 日\n', ["a,b"]), "plain, text", "[1, 2"), (2, [], None, (None, None, None), "[not", '{"k": 1}'), (3, None, [[1.0, 2.25]], None, None, None)]
    df = spark.createDataFrame(rows, kind)
    tables.write_csv(df, f"{tmp_path}/n.csv")
    back = tables.read_table(spark, f"{tmp_path}/n.csv", nested=True)
    assert dict(back.dtypes)["a"] == "array<bigint>" and dict(back.dtypes)["b"] == "array<array<double>>" and dict(back.dtypes)["t"] == dict(back.dtypes)["j"] == "string"
    got = {r["i"]: r for r in back.collect()}
    for i, a, b, s, t, j in rows:
        r = got[i]
        assert (r["a"], r["b"], r["t"], r["j"]) == (a, b, t, j) and (r["s"] is None if s is None else (r["s"]["x"], r["s"]["y"], r["s"]["z"]) == s)
    assert tables.with_nested(spark.range(2)).columns == ["id"]


def test_one_job_counts_all_tables(spark):
    from strandforge.sources import tables

    frames = {n: queries.table(spark, DATA, n) for n in ("nation", "documents")}
    assert {r["name"]: r["n_rows"] for r in tables.counted(frames).collect()} == {n: df.count() for n, df in frames.items()}
    plan = tables.counted(frames)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema: struct<>") == 2
    assert tables.catalog(spark, {}).count() == 0


def test_mutations_as_tuples(spark):
    from strandforge.functions import mutations as M

    assert M.as_mutation((1, "A")) == (1, "A", None) and M.as_mutation((1, "A", "C")) == (1, "A", "C")
    for bad, error in (([1, "A"], TypeError), (("A", 1), TypeError), ((1,), ValueError), ((1, "A", "C", "D"), ValueError), ((1, "A", 2), TypeError)):
        with pytest.raises(error):
            M.as_mutation(bad)
    df = M.variants_table(spark, [[(2, "C"), (4, "E")], [(4, "E", "X")], []])
    assert [r["mutations"] for r in df.orderBy("index").collect()] == [[(2, "C", None), (4, "E", None)], [(4, "E", "X")], []]
    assert variants.likely_offset(df, "ABCDEFGH") == 0 and variants.parent_sketch(df).first()["sketch"] == "**C*E"
    assert [r[0] for r in df.orderBy("index").select(M.applied(F.col("mutations"), F.lit("ABCDEFGH"), 0)).collect()] == [None, "ABCDXFGH", "ABCDEFGH"]


@pytest.mark.parametrize("held", [1 << 22, 0])
@pytest.mark.parametrize(("low", "high"), [(1, 1), (2, 4), (5, 5)])
def test_sparse_vectors_over_a_given_vocabulary(spark, monkeypatch, held, low, high):
    """Held by every task or joined: the same vectors; NULs, unseen symbols, ids with gaps and grams of other lengths are met."""
    monkeypatch.setattr(kernels, "HELD", held)
    monkeypatch.setattr(kernels, "SYMBOLS", 30)
    learned = ["ab\0", "\0\0\0\0\0", "abcabcab", "日本日本語👍🏽", "zzzzzz", "", None]
    texts = dict(enumerate([*learned, "ab", "a\0b\0\0", "qqq日本語 zz", "\U0010ffff" * 7, "ab" * 40, "\0" * 9]))
    grams = lambda t: [t[a : a + k] for k in range(low, high + 1) for a in range(len(t or "") - k + 1)]
    table = kernels.vocabulary_table(spark.createDataFrame([(t,) for t in learned], "s string"), "s", low, high)
    assert {r["gram"]: r["n"] for r in table.collect()} == Counter(g for t in learned for g in grams(t))
    odd = spark.createDataFrame([("abcabcab", 10**12, 1), (None, 5, 1), ("b", None, 1)], "gram string, id long, n long")
    given = table.select("gram", (1000 - 3 * F.col("id")).alias("id"), "n").unionByName(odd.where(F.col("gram").isNull() | ~F.col("gram").isin([] if low > 1 else ["b"])))
    ids = {r["gram"]: r["id"] for r in given.where("gram is not null and id is not null").collect()}
    found = kernels.sparse_ngrams(spark.createDataFrame(list(texts.items()), "id int, s string").repartition(3), "id", "s", low, high, given)
    assert found.dtypes == [("id", "int"), ("size", "bigint"), ("indices", "array<bigint>"), ("counts", "array<bigint>")]
    got = {r["id"]: (r["size"], list(zip(r["indices"], r["counts"], strict=True))) for r in found.collect()}
    assert got == {i: (10**12 + 1, sorted((ids[g], n) for g, n in Counter(grams(t)).items() if g in ids)) for i, t in texts.items()}
    none = kernels.sparse_ngrams(spark.createDataFrame([(1, "ab")], "id int, s string"), "id", "s", low, high, table.where("false")).collect()
    assert [tuple(r) for r in none] == [(1, 0, [], [])]


def test_sparse_vectors_shuffle_no_grams(spark):
    """With a vocabulary that tasks can hold, disk does not grow with the texts."""
    df = spark.range(50).select("id", F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 256)).alias("s"))
    found = kernels.sparse_ngrams(df, "id", "s", 4, 4, kernels.vocabulary_table(df.limit(3), "s", 4, 4))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
