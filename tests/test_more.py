"""Tag finding as a whole, features, stored tables, pipelines and streams, against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandforge import queries
from strandforge.functions import alphabets, molecules
from strandforge.functions import mutations as M
from strandforge.functions import sequences as S
from strandforge.functions import targets as T
from strandforge.functions.alphabets import AA, AMINO
from strandforge.operators import features, graphs, integrity, kernels, splits, tags, variants
from strandforge.plans import encodings, pipelines
from strandforge.sources import store, tables, toy
from strandforge.streaming import encode

from .test_operators import plain_hits

LIBRARY = [("His-Tag", "HHHHHH"), ("His-Fusion", "SSHHHHHHSS"), ("Flag-Tag", "DYKDDDDK"), ("Sig-Leader", "MKKLL"), ("Cut-Cleavage", "ENLYFQ"), ("Wee-Tag", "WCW")]


def found_tags(seq, library=LIBRARY, cutoff=90.0, quirk=False):
    """Tags of one sequence, step by step: [(start, end, name, location)], (n_end, c_start)."""
    place = {n: i for i, (n, _) in enumerate(library)}
    size = {n: len(t) for n, t in library}
    groups = {}
    for name, start, _ in sorted(plain_hits(seq, library, cutoff), key=lambda h: (place[h[0]], h[1])):
        groups.setdefault(name.split("-")[0], []).append((start, start + size[name], name))
    kept = []
    for hits in groups.values():
        own = []
        for a in sorted(hits, key=lambda h: h[0] - h[1]):
            if not any((b[0] <= a[0] and a[1] <= b[1]) or (a[0] <= b[0] and b[1] <= a[1]) for b in own):
                own.append(a)
        kept += own
    limit = lambda n: n - 1 if n <= 4 else 4
    n_end, c_start = 0, len(seq)
    for start, end, _ in sorted(kept):
        if abs(start - n_end) > limit(end - start):
            break
        n_end = end
    for start, end, _ in sorted(kept, key=lambda h: -h[1]):
        if abs(end - c_start) > limit(end - start):
            break
        c_start = start
    for at in range(n_end, min(n_end + 4, len(seq))):
        if seq[at] == "M":
            n_end = at
            break
    front = lambda h: h[1] <= n_end and (h[1] - h[0] > 4 or h[0] <= h[1] - h[0] - 1)
    back = lambda h: not h[2].endswith("-Leader") and h[0] >= c_start and (h[1] - h[0] > 4 or abs(h[1] - len(seq)) <= h[1] - h[0] - 1)
    terminal = any(front(h) or back(h) for h in kept)
    out = []
    for h in sorted(kept):
        where = "C-terminus" if back(h) else "N-terminus" if front(h) else "Internal" if h[2].endswith("-Tag") and not (quirk and terminal) else None
        out += [(*h, where)] if where else []
    return out, (n_end, c_start)


def made_sequences():
    rng = np.random.default_rng(11)
    parts = [t for _, t in LIBRARY] + ["", "M", "AVL", "GS", "HHH"]
    pick = lambda n: "".join(rng.choice(parts, n))
    return [pick(rng.integers(0, 4)) + "".join(rng.choice(list("AVLIMGST"), rng.integers(0, 50))) + pick(rng.integers(0, 4)) for _ in range(150)] + ["", "M", "GHHHHHHMYNAMEISCARL"]


@pytest.fixture(scope="module")
def sequences(spark):
    return spark.createDataFrame(list(enumerate(made_sequences())), "id int, s string").cache()


def test_find_tags(spark, sequences):
    library = tags.tag_library(spark, LIBRARY)
    for quirk in (False, True):
        rows = tags.find_tags(sequences, library, "id", "s", quirk=quirk).collect()
        assert len(rows) == sequences.count()
        for r in rows:
            got = [(t["start"], t["end"], t["name"], t["location"]) for t in r["tags"]]
            assert (got, (r["n_end"], r["c_start"])) == found_tags(r["s"], quirk=quirk), r["s"]
    all_tags = [t for s in made_sequences() for t in found_tags(s)[0]]
    assert {t[3] for t in all_tags} == {"N-terminus", "C-terminus", "Internal"}


def test_strip_report(spark, sequences):
    hits = tags.nonredundant(tags.tag_hits(sequences, tags.tag_library(spark, LIBRARY), "id", "s"), "id")
    report = tags.with_strip_report(sequences, hits, "id", "s")
    rows, of = report.collect(), dict(LIBRARY)
    total = 0
    for r in rows:
        listed, (a, b) = found_tags(r["s"])
        out = [t for t in listed if t[3] != "Internal"]
        total += len(out)
        text = lambda where: " ".join(f"[{t[2]}:{t[0]}-{of[t[2]]}-{t[1]}]" for t in out if t[3] == where) or "None"
        assert (r["tags_found"], r["names"], r["locations"]) == (bool(out), [t[2] for t in out], [t[3] for t in out])
        assert r["summary"] == f"N-term: {text('N-terminus')} C-term: {text('C-terminus')}" and r["sequence"] == r["s"][a:b]
    summary = tags.cleaning_summary(report).first()
    assert summary["tags"] == total == summary["n_terminal"] + summary["c_terminal"] and summary["sequences"] == len(rows)
    stripped = {r["id"]: r for r in tags.stripped(sequences, hits, "id", "s").collect()}
    assert all(stripped[r["id"]]["stripped_seq"] == r["sequence"] and stripped[r["id"]]["removed_tags"] == ",".join(r["names"]) for r in rows)
    last = next(r for r in rows if r["s"].endswith("CARL"))
    assert last["sequence"] == "MYNAMEISCARL" and last["summary"] == "N-term: [His-Tag:1-HHHHHH-7] C-term: None"


def test_conservation(spark):
    rows = [(1, "HHHHHHAVL", "--HHHHHHAVL", "AAHHH--HAVL"), (2, "AVLHHHHHH", None, "AVL"), (3, "AVLIHHHHHH", "AVLIHHHHHH", "AVLIHHHHHH")]
    df = spark.createDataFrame(rows, "id int, s string, q string, r string")
    library = tags.tag_library(spark, LIBRARY[:1])
    hits = tags.with_conservation(tags.tag_hits(df, library, "id", "s"), df, "id", "s", "q", "r")
    assert {r["id"]: r["conservation"] for r in hits.collect()} == {1: 66.67, 2: 0.0, 3: 100.0}
    found = {r["id"]: len(r["tags"]) for r in tags.find_tags(df, library, "id", "s", query_aln="q", reference_aln="r").collect()}
    assert found == {1: 1, 2: 1, 3: 0}
    for q, r, text in (("HHHHHH", "HHHHH", "length"), ("HHHHHHA", "HHHHHHA", "not the sequence"), ("", "", "empty query")):
        bad = spark.createDataFrame([(1, "HHHHHHAVL", q, r)], "id int, s string, q string, r string")
        with pytest.raises(Exception, match=text):
            tags.with_conservation(tags.tag_hits(bad, library, "id", "s"), bad, "id", "s", "q", "r").collect()


def test_clean_and_csv(spark, tmp_path):
    rows = [("a", "HHHHHH" + "MAVLIKRS" * 3), ("b", "ATGGCT" * 5), ("c", "GGGGGGGGGGGGGGGGG"), ("d", "MGGGGGGGGG")]
    df = spark.createDataFrame(rows, "id string, s string")
    library = tags.tag_library(spark, LIBRARY)
    out = {r["id"]: r for r in tags.cleaned(df, library, "id", "s", convert=True, drop_artificial=True).collect()}
    assert set(out) == {"a", "b", "d"} and out["b"]["s"] == "MA" * 5 and out["a"]["s"] == "MAVLIKRS" * 3
    assert out["a"]["removed_tags"].startswith("N-term: [His-Tag") and out["d"]["removed_tags"] == "N-term: None C-term: None"
    df.coalesce(1).write.csv(f"{tmp_path}/in.csv", header=True)
    summary = tags.strip_csv(spark, f"{tmp_path}/in.csv", f"{tmp_path}/out.csv", "s", library).first()
    assert (summary["sequences"], summary["with_tags"], summary["n_percent"]) == (4, 1, 100)
    back = {r["id"]: r for r in tables.read_table(spark, f"{tmp_path}/out.csv").collect()}
    assert back["a"]["s"] == "MAVLIKRS" * 3 and back["b"]["s"] == "ATGGCT" * 5
    with pytest.raises(TypeError):
        tags.strip_csv(spark, "x.parquet", "y", "s", library)
    spark.createDataFrame([("X-Tag", "hhhh ", "m"), ("Y-Fusion", "AAAA", "m")], "name string, sequence string, method string").coalesce(1).write.csv(f"{tmp_path}/lib.csv", header=True)
    assert [(r["name"], r["tag"], r["type"]) for r in tags.read_library(spark, f"{tmp_path}/lib.csv").orderBy("place").collect()] == [("X-Tag", "HHHH", "purification"), ("Y-Fusion", "AAAA", "fusion")]


def test_tag_queries_against_plain_versions(spark):
    data = "/root/testdata/sf0.001"
    seqs = {r["doc_id"]: r["aa_seq"] for r in queries.tagged(spark, data).collect()}
    want = {i: found_tags(s, queries.TAGS) for i, s in seqs.items()}
    got = {(r["doc_id"], r["start"], r["end"], r["name"], r["location"]) for r in queries.tag_locations(spark, data).collect()}
    assert got == {(i, *t) for i, (listed, _) in want.items() for t in listed}
    for r in queries.tag_report(spark, data).collect():
        a, b = want[r["doc_id"]][1]
        assert r["sequence"] == seqs[r["doc_id"]][a:b]
    assert {r["doc_id"]: r["stripped_seq"] for r in queries.tag_strip(spark, data).collect()} == {i: seqs[i][a:b] for i, (_, (a, b)) in want.items()}
    assert queries.clean_dataset(spark, data).count() > 0
    terminal = [t[3] for listed, _ in want.values() for t in listed if t[3] != "Internal"]
    r = queries.cleaning_summary(spark, data).first()
    assert (r["sequences"], r["tags"], r["n_terminal"]) == (len(seqs), len(terminal), terminal.count("N-terminus"))


def test_mutation_helpers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    a, b = M.parsed_code(F.lit("A2C")), M.parsed_code(F.lit("C1D_E4F"))
    assert [m["pos"] for m in one(M.concatenated(F.array(a, b)))] == [1, 0, 3]
    assert M.mutation_column(["aa_seq", "aa_mut", "dna_seq", "dna_mut"]) == "dna_mut" and M.mutation_column(["aa_mut"]) is None
    assert M.checked_mutation((1, "A", "C")) == (1, "A", "C")
    with pytest.raises(TypeError):
        M.checked_mutation((1, "A"))
    assert one(M.extracted_code(F.lit("ACD"), F.lit("AED"))) == "E2C" and one(M.extracted(F.lit(""), F.lit(""))) == []


def test_apply_all_and_report(spark):
    df = spark.createDataFrame([("wildtype", "ABCDEFGH"), ("C2X_E4Y", None), ("F5T", None)], "aa_mut string, aa_seq string")
    assert [r["applied"] for r in variants.apply_all(df).collect()] == ["ABCDEFGH", "ABXDYFGH", "ABCDETGH"]
    with pytest.raises(ValueError, match="more than one"):
        variants.apply_all(df.unionByName(df.limit(1).withColumn("aa_mut", F.lit("wt"))))
    with pytest.raises(ValueError, match="empty"):
        variants.apply_all(df.where("false"))
    with pytest.raises(ValueError, match="no sequence"):
        variants.apply_all(df.drop("aa_seq"))
    rows = df.where("aa_mut like '%_%' and aa_mut <> 'wildtype'").select(M.parsed_code(F.col("aa_mut")).alias("mutations"))
    r = variants.offset_report(rows, "ABCDZFGH").first()
    assert (r["offset"], r["non_match_pos"], r["non_match_source"], r["non_match_parent"]) == (1, [4], ["E"], ["Z"]) and round(r["matching_ratio"], 3) == 0.667
    with pytest.raises(ValueError, match="differs at \\[4\\]"):
        variants.likely_offset(rows, "ABCDZFGH")
    with pytest.raises(ValueError, match="the parent has 2"):
        variants.offset_report(rows, "AB")


def test_features(spark):
    df = spark.createDataFrame([(i, float(i), [[1, i], [i, 2]], "x") for i in range(7)], "index long, a double, m array<array<int>>, s string")
    view = features.FeatureView.of(df, ["m", "a"])
    assert view.widths == (4, 1) and view.idx("a") == (4, 5) and view.dims("a", "m") == [4, 0, 1, 2, 3] and view.metadata() == {"m": (0, 4), "a": (4, 5)}
    rows = view.cat(df).select("index", "features", view.get(F.col("features"), "a", "m").alias("g")).collect()
    assert all(list(r["features"]) == [1, r["index"], r["index"], 2, r["index"]] and list(r["g"]) == [r["index"], 1, r["index"], r["index"], 2] for r in rows)
    with pytest.raises(TypeError):
        features.FeatureView.of(df)
    with pytest.raises(ValueError, match="values"):
        features.FeatureView.of(df.withColumn("m", F.when(F.col("index") == 0, F.array(F.array(F.lit(1)))).otherwise(F.col("m"))), ["m"])
    first, second = (features.feature_batches(df, ["m", "a"], ["a"], 3, 42, e).collect() for e in (0, 1))
    assert len(first) == 7 and [r["position"] for r in sorted(first, key=lambda r: r["index"])] != [r["position"] for r in sorted(second, key=lambda r: r["index"])]
    assert len(features.feature_batches(df, ["a"], ["a"], 3, drop_single=True).collect()) == 6 and len(features.feature_batches(df, ["a"], None, 3, drop_single=True).collect()) == 7
    assert [r["index"] for r in features.feature_batches(df, ["a"], None, 3, None).orderBy("position").collect()] == list(range(7))


def test_kernels_more(spark):
    df = spark.createDataFrame([(1, "AAB"), (2, "B"), (3, "")], "id int, s string")
    assert kernels.learned_vocabulary(df, "s", 1, 2) == ["A", "AA", "AB", "B"]
    assert {r["id"]: r["ngrams"] for r in kernels.with_ngrams(df, "s", 1, 2).collect()} == {1: [2, 1, 1, 1], 2: [0, 0, 0, 1], 3: [0, 0, 0, 0]}
    assert {(r["id"], r["gram"]): r["n"] for r in kernels.ngram_table(df, "id", "s", 1, 2).collect()} == {(1, "A"): 2, (1, "AA"): 1, (1, "AB"): 1, (1, "B"): 1, (2, "B"): 1}
    with pytest.raises(ValueError):
        kernels.ngram_table(df, "id", "s", 2, 1)
    m = np.random.default_rng(1).normal(size=(6, 5, 2))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id int, m array<array<double>>")
    want = np.stack([np.stack([x[i : i + 2].ravel() for i in range(4)]).mean(0) for x in m])
    got = np.stack([r[0] for r in rows.orderBy("id").select(kernels.normalised_mean_kmers(F.col("m"), 2)).collect()])
    assert np.allclose(got, want / np.linalg.norm(want, axis=1, keepdims=True))
    # centers that span all windows leave the kernel as it is
    f = np.stack([r["features"] for r in kernels.rkhs_features(rows, "id", "m", 2, 12).orderBy("id").collect()])
    assert np.allclose(f @ f.T, want @ want.T)
    v = spark.createDataFrame([(i, x.ravel().tolist()) for i, x in enumerate(m)], "id int, v array<double>")
    assert len(kernels.linear_kernel(v, v.limit(2), "id", "v").collect()) == 12 and kernels.linear_kernel(v, v.where("false"), "id", "v").count() == 0
    with pytest.raises(ValueError):
        kernels.linear_kernel(v, v, "id", "v", most=3)


def test_graphs_more(spark):
    df = spark.createDataFrame([([[0, 1, 0], [2, 1, 3]], [5.0, 6.0, 7.0], [1, 2, 1])], "bnd_idcs array<array<int>>, w array<double>, t array<int>")
    a = np.array(graphs.with_adjacency(df, fill="w", directed=True).first()["atm_adj"])
    assert a[0, 2] == 5 and a[1, 1] == 6 and a[0, 3] == 7 and a.sum() == 18
    with pytest.raises(Exception, match="as many values"):
        graphs.with_adjacency(df.withColumn("w", F.array(F.lit(1.0))), fill="w").collect()
    m = graphs.with_typed_incidence(df, "t", [1, 2, 3], directed=True).first()["atm_bnd_incid_by_type"]
    assert [np.array(x).shape for x in m] == [(4, 2), (4, 1), (4, 0)] and np.array(m[0])[:, 1].tolist() == [-1, 0, 0, 1]
    assert tuple(graphs.largest_counts(df).first()) == (4, 3)


def test_splits_more(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "x int").repartition(7)
    assert [r["index"] for r in splits.with_index(df, ["x"]).orderBy("x").collect()] == list(range(101))
    assert sorted(r["index"] for r in splits.with_index(df).collect()) == list(range(101)) and splits.with_index(splits.with_index(df)).columns == ["x", "index"]
    rows = splits.with_index(df, ["x"])
    both, single = splits.with_split_columns(rows), splits.with_folds(splits.with_train_test(rows), 10)
    assert sorted(map(tuple, both.select(*single.columns).collect())) == sorted(map(tuple, single.collect()))
    assert {k: v.count() for k, v in splits.split(rows).items()} == {"test": 21, "train": 80} and len(splits.split(rows, k=4)) == 4
    assert set(splits.split(both, "random_split_10_fold")) == {f"split_{i}" for i in range(10)}
    with pytest.raises(ValueError):
        splits.split(rows, "none")
    parts = splits.labelled(splits.split(rows), "part")
    assert all(r["part"] == n for n, d in parts.items() for r in d.collect())
    counts = splits.fold_counts(splits.with_folds(rows, 5, column="f"), "f", 2).collect()
    assert [tuple(r["test"]) for r in counts] == list(itertools.combinations([f"split_{i}" for i in range(5)], 2)) and all(r["n_train"] + r["n_test"] == 101 for r in counts)
    assert [tuple(r)[1:] for r in splits.fold_counts(both, splits.TRAIN_TEST).collect()] == [(["test"], 80, 21)]


def test_stored_tables(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(4)], "a int, b string")
    df.where("a < 2").write.parquet(f"{tmp_path}/d/one")
    df.where("a >= 2").write.parquet(f"{tmp_path}/d/two")
    assert tables.read_splits(spark, f"{tmp_path}/d").count() == 4
    assert {(r["a"], r["s"]) for r in tables.read_splits(spark, f"{tmp_path}/d", ["two"], "s").collect()} == {(2, "two"), (3, "two")}
    with pytest.raises(ValueError):
        tables.read_splits(spark, f"{tmp_path}/d", ["three"])
    tables.write_table(df, f"{tmp_path}/t.parquet")
    assert tables.rename_stored(spark, f"{tmp_path}/t.parquet", {"a": "x"}, f"{tmp_path}/u.parquet").columns == ["x", "b"]
    for names in ({"z": "y"}, {"a": "b"}):
        with pytest.raises(ValueError):
            tables.rename_stored(spark, f"{tmp_path}/t.parquet", names, f"{tmp_path}/v.parquet")
    assert tables.awkward_columns(["a b", "c/d", "e.f", "g"]) == ["a b", "c/d", "e.f"]
    monkeypatch.setenv("STRANDFORGE_DIR", "/base")
    monkeypatch.setenv("STRANDFORGE_RESULTS_DIR", "/out")
    assert (tables.folder(), tables.folder("data"), tables.folder("results")) == ("/base", "/base/data", "/out") and tables.stem_and_ending("a.b.csv") == ("a.b", ".csv")
    assert tables.table_tags(["x_solubility", "target y"]) == ["_SOL", "at_least_one_feature_named_TARGET"]
    assert tables.column_classes(spark.createDataFrame([(1, 1, 1, 1)], "index int, aa_len int, `target x` int, split_a int")) == {"features": ["aa_len"], "targets": ["target x"], "splits": ["split_a"]}
    assert integrity.missing_mask(spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "x double"), "x").where("missing").count() == 2


def test_similarity(spark, tmp_path):
    (tmp_path / "M").write_text("\n".join(queries.similarity_lines()))
    got = tables.load_similarity(spark, str(tmp_path), "M", AMINO)
    scores = tables.similarity_array(got, AMINO)
    assert len(scores) == 20 and all(scores[i][i] == 3 for i in range(20)) and scores == [list(c) for c in zip(*scores, strict=True)]
    (tmp_path / "M").write_text("broken")
    assert tables.similarity_array(tables.load_similarity(spark, str(tmp_path), "M", AMINO), AMINO) == scores
    with pytest.raises(ValueError):
        tables.load_similarity(spark, str(tmp_path), "M", AMINO, replace=True)
    one = lambda a, b: spark.range(1).select(tables.similarity_score(F.lit(a), F.lit(b), scores, AMINO)).first()[0]
    assert one("AC", "AC") == 6 and one("", "") == 0 and one("A", "AC") is None
    with pytest.raises(Exception, match="unknown symbols"):
        one("A!", "AC")


def test_store(spark, tmp_path):
    box = store.Store(spark, f"{tmp_path}/hub")
    assert box.names() == []
    df = spark.createDataFrame([(i, "AC", i * 0.5, i % 2) for i in range(10)], "index long, aa_seq string, `target solubility` double, `target class` int")
    out = box.publish(df, "one", lambda d: pipelines.transformed(d, ["aa_len"]))
    assert {"aa_len", splits.TRAIN_TEST} <= set(out.columns) and out.count() == 10
    text = box.read_me("one")
    assert "- target solubility - regression" in text and "- target class - classification" in text and "- 10 datapoints" in text and box.update_read_me("one") == text
    assert box.push(splits.split(splits.with_train_test(df)), "one") == ["whole_dataset"] and box.splits("one") == ["test", "train"]
    with pytest.raises(ValueError):
        box.pull("one")
    assert box.pull("one", ["train", "test"]).count() == 10
    with pytest.raises(FileNotFoundError):
        box.pull("none")
    row = box.explore(f"{tmp_path}/log.csv").first()
    assert (row["name"], row["tags"], row["target_tags"], row["full_size"], row["split_info"]) == ("one", "_PE", "_SOL, at_least_one_feature_named_TARGET", 10, "test: 2, train: 8")
    assert spark.read.csv(f"{tmp_path}/log.csv", header=True).count() == 1


def test_toy(spark):
    data = toy.regression(spark, ["aa_len"])
    assert (data.full.count(), data.train.count(), data.test.count()) == (21, 16, 5)
    rows = data.full.collect()
    assert {r["aa_len"] for r in rows} == {442} and len({r["aa_seq"] for r in rows}) == 21
    assert all(sum(a != b for a, b in zip(r["aa_seq"], toy.parent(), strict=True)) == (r["aa_mut"] != "wildtype") for r in rows)
    assert {r["target_high_low"] for r in toy.classification(spark).full.collect()} == {0, 1}


def test_pipelines(spark, tmp_path):
    rows = spark.createDataFrame([("wildtype", "GMPKSEFTHC", 1), ("T8M", None, 2), ("P3G", None, 3)], "aa_mut string, aa_seq string, `target foo` int")
    tables.write_csv(rows, f"{tmp_path}/x.csv")
    out = pipelines.prepare(spark, f"{tmp_path}/x.csv", f"{tmp_path}/y", ["aa_len", "aa_1gram"])
    assert {"index", splits.TRAIN_TEST, "random_split_3_fold", "aa_len", "aa_1gram"} <= set(out.columns)
    assert sorted(r["aa_seq"] for r in spark.read.parquet(f"{tmp_path}/y").collect()) == ["GMGKSEFTHC", "GMPKSEFMHC", "GMPKSEFTHC"]
    assert "index" not in pipelines.transformed(rows, ["aa_len"], add_index=False, add_splits=False).columns
    stripped = pipelines.preprocessed(spark.createDataFrame([("HHHHHHMAVLIKRSTV",)], "aa_seq string"), tags=tags.tag_library(spark, LIBRARY)).first()
    assert stripped["aa_seq"] == "MAVLIKRSTV" and stripped["index"] == 0
    made = pipelines.from_dict(spark, {"aa_mut": ["wildtype", "T8M"], "aa_seq": ["GMPKSEFTHC", None], "target": [1.5, None], "part": ["u", "v"]}, ["aa_len"])
    assert {r["aa_seq"] for r in made.collect()} == {"GMPKSEFTHC", "GMPKSEFMHC"} and dict(made.dtypes)["target"] == "double"
    assert set(pipelines.from_dict(spark, {"aa_seq": ["AC", "CA"], "target": [1, 2], "part": ["u", "v"]}, ["aa_len"], "part")) == {"u", "v"}
    with pytest.raises(ValueError):
        pipelines.from_dict(spark, {"aa_seq": ["A"], "target": [1, 2]})
    with pytest.raises(KeyError):
        pipelines.from_dict(spark, {"aa_seq": ["A"]})


def test_plan_reach():
    names = ["aa_len", "dna_len", "smiles_1hot", "atm_adj", "other"]
    assert encodings.within_reach(names, ["aa_seq", "dna_seq"]) == ["aa_len", "other"]
    assert encodings.within_reach(names, ["dna_seq", "bnd_idcs"]) == ["dna_len", "atm_adj", "other"]
    assert encodings.within_reach(names, ["smiles_seq"]) == ["smiles_1hot"]


def test_histogram(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 10)] + [(None,), (float("nan"),)], "x double")
    assert {r["bin"]: r["n"] for r in T.histogram(df, "x", 5).collect()} == {0: 2, 1: 1, 4: 1}
    assert [tuple(r) for r in T.histogram(df.where("x = 2"), "x").collect()] == [(0, 1)]


def test_streams(spark, tmp_path):
    spark.createDataFrame([("wt", "ATGATG"), ("A1C", "MK")], "aa_mut string, aa_seq string").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("aa_mut string, aa_seq string").parquet(f"{tmp_path}/in")
    out = encode.applied_stream(encode.encoded_stream(source), "AAA", out="v")
    query = out.writeStream.format("memory").queryName("encoded_rows").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination(60)
    rows = {r["aa_mut"]: r for r in spark.table("encoded_rows").collect()}
    assert rows["wt"]["v"] == "AAA" and rows["A1C"]["v"] == "CAA" and rows["wt"]["seq_type"] == "DNA" and rows["A1C"]["aa_len"] == 2
    assert sum(rows["wt"]["aa_1gram"]) == 6 and len(rows["wt"]["aa_1gram"]) == len(AA)


def test_one_hot_round_trip(spark):
    df = spark.range(1).select(S.rows_to_flat(S.one_hot(F.lit("MLG"), AA, 5)).alias("f")).select(S.flat_to_rows(F.col("f"), 21).alias("r"))
    assert [AA[r.index(1)] if 1 in r else "" for r in df.first()["r"]] == ["M", "L", "G", "", ""]


def test_molecules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(molecules.protons(F.array(F.lit("C"), F.lit("og"), F.lit("Zz")))) == [6, 118, None]
    assert one(molecules.carbon_atoms(F.lit("GAW?"))) == 2 + 3 + 11
    assert one(molecules.smiles_places(F.lit(" C!"))) == [0, 1 + alphabets.SMILES.index("C"), None] and one(molecules.rna_places(F.lit("AU*X"))) == [1, 4, 5, 0]
    assert round(sum(alphabets.BACKGROUND.values()), 2) == 1.0 and set(alphabets.BACKGROUND) == set(AMINO) == set(alphabets.CARBON)


def test_models_in_batches(spark):
    def load():
        return {"calls": 0}

    def encode(model, seqs):
        model["calls"] += 1
        assert len(seqs) <= 2
        return [np.array([[ord(c), len(s)] for c in s], np.float32) for s in seqs]

    model = encodings.batched_model(load, encode, 2)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(["AC", None, "D", "EFG", "H"])], "id int, aa_seq string")
    out = encodings.encoded(df, ["aa_esm2_avg"], encodings.registry({"aa_esm2_t6_8M": model})).orderBy("id").collect()
    assert [r["aa_esm2_avg"] for r in out] == [[66.0, 2.0], None, [68.0, 1.0], [70.0, 3.0], [72.0, 1.0]]
    with pytest.raises(TypeError):
        model(df, "id", "x")
    with pytest.raises(ValueError):
        encodings.batched_model(load, encode, 0)
