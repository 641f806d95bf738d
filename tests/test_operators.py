"""Known answers of single operators, and plain versions of those without SQL."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandforge.functions import mutations as M
from strandforge.functions import sequences as S
from strandforge.functions import targets as T
from strandforge.functions.alphabets import AA, PROTONS, amino_of, codons
from strandforge.operators import graphs, integrity, kernels, splits, tags, variants
from strandforge.plans import encodings
from strandforge.sources import tables


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def muts(*found):
    return F.array(*(F.struct(F.lit(p).alias("pos"), F.lit(s).alias("src"), F.lit(t).alias("targ")) for p, s, t in found)).cast(M.MUTATIONS)


def plain(found):
    return [(m["pos"], m["src"], m["targ"]) for m in found]


def test_parse(spark):
    assert plain(one(spark, M.parsed_code(F.lit("E4Y_C2X")))) == [(1, "C", "X"), (3, "E", "Y")]
    assert plain(one(spark, M.parsed_code(F.lit("A 977 G")))) == [(976, "A", "G")]
    assert one(spark, M.parsed_code(F.lit("wildtype (wt)"))) == []
    assert one(spark, M.parsed_or_null(F.lit(" WT "))) is None
    with pytest.raises(Exception, match="malformed"):
        one(spark, M.parsed_code(F.lit("E2319")))


def test_apply_extract_format(spark):
    for code, want in (("C2X_E4Y", "ABXDYFGH"), ("F5T", "ABCDETGH")):
        assert one(spark, M.applied(M.parsed_code(F.lit(code)), F.lit("ABCDEFGH"), 1)) == want
        back = M.extracted(F.lit(want), F.lit("ABCDEFGH"), 1)
        assert one(spark, M.code_of(back)) == code
    assert one(spark, M.extracted(F.lit("ABC"), F.lit("ABCD"))) is None
    assert one(spark, M.extracted(F.lit("ABCD"), F.lit("ABCD"))) == []
    assert one(spark, M.code_of(muts((34, "C", "A"), (12, "A", "T"), (23, "T", "G")))) == "A13T_T24G_C35A"
    with pytest.raises(Exception, match="differs"):
        one(spark, M.applied(muts((0, "B", "C")), F.lit("AAA"), check=True))


def test_combine(spark):
    a, b = muts((1, "A", "B"), (5, "C", "D")), muts((1, "A", "CE"), (3, "F", "G"))
    assert plain(one(spark, M.combined(a, b))) == [(1, "A", "BC"), (1, "A", "BE"), (3, "F", "G"), (5, "C", "D")]
    with pytest.raises(Exception, match="sources differ"):
        one(spark, M.combined(a, muts((1, "Z", "C"))))
    assert plain(one(spark, M.combined(a, muts((1, "Z", "C")), check=False)))[0] == (1, "AZ", "BC")


def test_fill_and_offset(spark):
    df = spark.createDataFrame([("wildtype", "GMPKSEFTHC", 1), ("T8M", None, 2), ("P3G", None, 3)], "aa_mut string, aa_seq string, `target foo` long")
    assert {r["aa_mut"]: r["aa_seq"] for r in variants.filled(df).collect()} == {"wildtype": "GMPKSEFTHC", "T8M": "GMPKSEFMHC", "P3G": "GMGKSEFTHC"}
    rows = spark.createDataFrame([("C9X_E11Y",), ("D10K",)], "c string").select(M.parsed_code(F.col("c")).alias("mutations"))
    assert variants.likely_offset(rows, "ABCDEFGH") == -6
    rows = spark.createDataFrame([("A1X",)], "c string").select(M.parsed_code(F.col("c")).alias("mutations"))
    with pytest.raises(ValueError, match="several"):
        variants.likely_offset(rows, "AAAAAAAA")
    with pytest.raises(ValueError, match="no offset"):
        variants.likely_offset(rows, "BBBB")
    with pytest.raises(ValueError, match="wild type"):
        variants.parent_sequence(df.where("aa_mut <> 'wildtype'"))


def test_sketch(spark):
    df = spark.range(1).select(muts((3, "A", "C"), (2, "B", "D")).alias("mutations"))
    assert tuple(variants.parent_sketch(df).first()) == (2, "**BA")
    with pytest.raises(Exception, match="conflicting"):
        variants.parent_sketch(spark.range(1).select(muts((0, "M", "A"), (0, "B", "C")).alias("mutations"))).collect()


def test_targets(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5), (3.0, 5)], "`target a` double, b int")
    z = [r[0] for r in T.zscored(df, ["target a", "b"]).orderBy("`target a`").collect()]
    assert np.allclose(z, [-1.22474487, 0, 1.22474487])
    assert T.target_columns(df) == ["target a"]
    with pytest.raises(ValueError):
        T.adjusted(df, {"target x": T.Objective()})
    with pytest.raises(ValueError):
        T.to_maximise(F.col("b"), T.Objective("up"))
    with pytest.raises(ValueError):
        T.with_summary(df.select("b"))


def test_integrity(spark):
    ok = spark.createDataFrame([("A", 1)], "aa_seq string, `Target x` int")
    assert integrity.checked(ok) is ok
    with pytest.raises(KeyError, match="missing values"):
        integrity.checked(spark.createDataFrame([(None, 1)], "aa_seq string, target int"))
    with pytest.raises(KeyError, match="reserved"):
        integrity.checked(ok.withColumn(T.SUMMARY, F.lit(1)))
    with pytest.raises(TypeError):
        integrity.checked([1])


def test_sequences(spark):
    assert len(codons()) == 64 and amino_of("TAR") == "*" and amino_of("GCN") == "A" and amino_of("NNN") == "X" and PROTONS["Og"] == 118
    for dna, want in (("GATCTG", "DL"), ("CTT", "L"), ("AAGATTACACCT", "KITP"), ("TAGGGACAAAATGCATTG", "GQNAL"), ("GC", ""), ("GCNTTT", "AF")):
        assert one(spark, S.translated(F.lit(dna))) == want
    with pytest.raises(Exception, match="codon"):
        one(spark, S.translated(F.lit("GC!")))
    hot = np.array(one(spark, S.one_hot(F.lit("MLG"), AA, 5)))
    assert hot.shape == (5, 21) and hot.sum() == 3 and hot[3:].sum() == 0
    with pytest.raises(Exception, match="unknown symbols"):
        one(spark, S.one_hot(F.lit("XMPBSOFT"), AA, 8))
    assert one(spark, S.ngram_counts(F.lit("AAAC"), ["AA", "AC", "C"])) == [2, 1, 1]
    assert one(spark, S.sequence_type(F.lit("ATGATG"))) == "DNA" and one(spark, S.sequence_type(F.lit("MKX"))) == "Ambiguous_Protein"
    assert one(spark, F.size(S.kmers(F.lit("AB"), 3))) == 0


def test_splits(spark):
    six = spark.createDataFrame([(i,) for i in range(6)], "index long")
    folds = {r["index"]: r["f"] for r in splits.with_folds(six, 3, backend="numpy", column="f").collect()}
    assert [folds[i] for i in (3, 2, 5, 4, 1, 0)] == ["split_0", "split_0", "split_1", "split_1", "split_2", "split_2"]
    parts = {r["index"]: r["p"] for r in splits.with_train_test(six, 93, backend="numpy", column="p").collect()}
    assert {i for i, p in parts.items() if p == "test"} == {3, 1}
    with pytest.raises(ValueError):
        splits.with_folds(six, 7)
    both = splits.with_split_columns(six)
    assert len(both.columns) == 3 and splits.with_train_test(both).columns == both.columns
    sets = list(splits.train_test_sets(splits.with_folds(six, 3, column="f"), "f", 2))
    assert len(sets) == 3 and all(a.count() + b.count() == 6 for a, b in sets)


def test_graphs(spark):
    df = spark.createDataFrame([([[0, 1, 0], [2, 1, 3]],)], "bnd_idcs array<array<int>>")
    row = graphs.with_incidence(graphs.with_adjacency(graphs.with_counts(df)), directed=True).first()
    assert (row["atm_count"], row["bnd_count"]) == (4, 3)
    a = np.array(row["atm_adj"])
    assert a[0, 2] == a[2, 0] == a[1, 1] == a[0, 3] == 1 and a.sum() == 5
    assert np.array(row["atm_bnd_incid"])[:, 0].tolist() == [-1, 0, 1, 0]
    typed = graphs.with_typed_adjacency(df.withColumn("t", F.array(F.lit(1), F.lit(2), F.lit(1))), "t", [1, 2]).first()["atm_adj_by_type"]
    assert np.array(typed).sum((1, 2)).tolist() == [4.0, 1.0]
    padded = np.array(graphs.with_adjacency(df, size=5, pad=-1.0).first()["atm_adj"])
    assert padded.shape == (5, 5) and (padded[4] == -1).all()
    with pytest.raises(Exception, match="two rows"):
        graphs.with_counts(spark.createDataFrame([([[0]],)], "bnd_idcs array<array<int>>")).collect()


def test_kernels(spark):
    m = np.arange(12.0).reshape(4, 3)
    df = spark.createDataFrame([(1, m.tolist())], "id int, m array<array<double>>")
    want = np.stack([m[i : i + 2].ravel() for i in range(3)]).mean(0)
    assert np.allclose(df.select(kernels.mean_kmers(F.col("m"), 2)).first()[0], want)
    assert np.allclose(df.select(kernels.mean_over_positions(F.col("m"))).first()[0], m.mean(0))
    assert kernels.kmer_windows(df, "id", "m", 2).count() == 3 and kernels.kmer_centers(df, "id", "m", 2).count() == 3


def test_planner(spark):
    steps = encodings.order(encodings.registry(), ["bnd_idcs"], ["atm_retprob100"])
    assert [s.provides[0] for s in steps] == ["atm_count", "atm_adj", "atm_retprob100"]
    with pytest.raises(ValueError):
        encodings.order(encodings.registry(), ["dna_seq"], ["atm_adj"])
    assert not encodings.order(encodings.registry(), ["dna_seq"], ["atm_adj"], strict=False)
    df = spark.createDataFrame([("ATGAAA",)], "dna_seq string")
    out = encodings.encoded(df)
    assert {"dna_len", "dna_1hot"} <= set(out.columns) and "atm_adj" not in out.columns and "aa_seq" not in out.columns
    assert {"aa_seq", "aa_1hot"} <= set(encodings.encoded(df, ["aa_1hot"]).columns)
    with pytest.raises(NotImplementedError):
        encodings.encoded(df, ["aa_esm2_avg"])
    with pytest.raises(TypeError):
        encodings.encoded(df, {"aa_len"})


def plain_hits(seq, library, cutoff):
    out = set()
    for name, tag in library:
        n, rest = len(tag), len(seq) - len(tag)
        if rest <= 0 or (name.endswith("-Fusion") and rest < 25):
            continue
        for i in range(rest + 1):
            identity = round(100 * sum(a == b for a, b in zip(seq[i : i + n], tag, strict=True)) / n, 2)
            if identity >= cutoff:
                out.add((name, i, identity))
    return out


def test_tags(spark):
    library = [("His-Tag", "HHHHHH"), ("His-Fusion", "SSHHHHHHSS"), ("Flag-Tag", "DYKDDDDK")]
    rng = np.random.default_rng(3)
    seqs = ["".join(rng.choice(list("HDKYSM"), 60)) for _ in range(40)] + ["MGSSHHHHHHSSG" + "AVLI" * 10 + "DYKDDDDK", "", "HHHHHH"]
    df = spark.createDataFrame(list(enumerate(seqs)), "id int, s string")
    for cutoff in (60.0, 80.0, 90.0):
        hits = tags.tag_hits(df, tags.tag_library(spark, library), "id", "s", cutoff).collect()
        assert {(r["id"], r["name"], r["start"], r["identity"]) for r in hits} == {(i, *h) for i, s in enumerate(seqs) for h in plain_hits(s, library, cutoff)}
    found = tags.nonredundant(tags.tag_hits(df, tags.tag_library(spark, library), "id", "s"), "id")
    row = tags.stripped(df, found, "id", "s").where("id = 40").first()
    assert row["stripped_seq"] == "G" + "AVLI" * 10 and row["removed_tags"] == "His-Fusion,Flag-Tag"
    bare = spark.createDataFrame([("AAMK",)], "s string").select(tags.termini(F.array().cast("array<struct<start: int, end: int>>"), F.col("s")).alias("e"))
    assert tuple(bare.first()["e"]) == (2, 4)


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2])], "a int, b array<int>")
    tables.write_csv({"x": df, "y": df}, f"{tmp_path}/Data.csv")
    assert tables.read_table(spark, f"{tmp_path}/data_X.csv").first()["b"] == "[1,2]"
    with pytest.raises(TypeError):
        tables.read_table(spark, "a.txt")
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, f"{tmp_path}/none.csv")
    assert tables.with_section("# A\n\n- x\n\n\nrest", "# A", ["y"]) == "# A\n\n- y\n\n\nrest"
    text = ["# note", "  A C X", "A 4 -1 0", "C -1 9 0", "X 0 0 1"]
    lines = spark.createDataFrame(list(enumerate(text)), "line_no int, value string")
    scores = {(r["row_sym"], r["col_sym"]): r["score"] for r in tables.similarity_table(lines, "m", "AC").collect()}
    assert scores == {("A", "A"): 4, ("A", "C"): -1, ("C", "A"): -1, ("C", "C"): 9}
    with pytest.raises(ValueError):
        tables.similarity_table(lines, "m", "AZ")
    assert tables.table_tags(["aa_seq", "dna_mut"]) == ["_PE", "_DNA"]


def test_pairs_within_counts(spark):
    df = spark.createDataFrame([(i, f"A{i + 1}C") for i in range(5)], "id int, c string").select("id", M.parsed_code(F.col("c")).alias("mutations"))
    assert {(r["a"], r["b"]) for r in variants.pairs_within(df, "id").collect()} == set(itertools.combinations(range(5), 2))


def test_long_sequences(spark, tmp_path):
    """Sequence and tag queries against plain versions over whole texts, far beyond 300 letters."""
    from strandforge import queries

    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY hbzé\n"), n)) for n in (0, 5, 299, 301, 700, 4000)] + [None, "K" * 320 + "HHHHHH" + "A" * 700 + "WWW"]
    spark.createDataFrame([(i + 5 * 7, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    letters = {i + 35: "".join(c for c in t or "" if c.isascii() and c.isalpha()).upper() for i, t in enumerate(texts)}
    proteins = {i: "".join(c for c in t if c in AA) for i, t in letters.items()}
    got = lambda name: [tuple(r) for r in queries.queries()[name](spark, str(tmp_path)).collect()]
    assert dict(got("seq_length")) == {i: len(s) for i, s in proteins.items()} and max(map(len, proteins.values())) > 3000
    assert sorted(got("one_hot")) == [(i, n, AA.index(c) + 1) for i, s in sorted(proteins.items()) for n, c in enumerate(s)]
    assert sorted(got("char_counts_1gram")) == [(i, n, s.count(c)) for i, s in sorted(proteins.items()) for n, c in enumerate(AA)]
    grams = lambda k: [(i, s[n : n + k]) for i, s in proteins.items() for n in range(len(s) - k + 1)]
    assert {(i, g): n for i, g, n in got("char_ngram_2")} == {x: n for x, n in Counter(grams(2)).items()}
    assert dict(got("kmer_distinct")) == dict(Counter(g for _, g in grams(3)))
    genes = {i: "".join("ACGT"[(ord(c) - 65) % 4] for c in s) for i, s in letters.items()}
    assert dict(got("translate_dna")) == {i: "".join(codons()[s[n : n + 3]] for n in range(0, len(s) - 2, 3)).strip("*") for i, s in genes.items()}
    tagged = {i: ("MGSSHHHHHHSSG" if i % 5 == 0 else "") + s + ("DYKDDDDK" if i % 7 == 0 else "") for i, s in proteins.items()}
    hits = {(i, *h) for i, s in tagged.items() for h in plain_hits(s, queries.TAGS, 80.0)}
    assert set(got("tag_hits")) == hits and (42, "His-Tag", 320, 100.0) in hits and (42, "FLAG-Tag", 1029, 100.0) in hits
    stripped = {r["doc_id"]: r["stripped_seq"] for r in queries.tag_strip(spark, str(tmp_path)).collect()}
    assert stripped[42] == proteins[42]


def test_tags_across_pieces(spark):
    """A tag is found at each place of a long sequence, and a tag longer than a piece too."""
    long = "".join(np.random.default_rng(1).choice(list("ACDEFG"), 100))
    library = [("His-Tag", "HHHHHH"), ("Big-Tag", long)]
    seqs = ["K" * n + t + "K" * 200 for n in range(140) for _, t in library]
    df = spark.createDataFrame(list(enumerate(seqs)), "id int, s string")
    hits = tags.tag_hits(df, tags.tag_library(spark, library), "id", "s", 80.0).collect()
    assert sorted((r["id"], r["name"], r["start"], r["identity"]) for r in hits) == sorted((i, *h) for i, s in enumerate(seqs) for h in plain_hits(s, library, 80.0))


def test_tags_many_seeds(spark, monkeypatch):
    """The search for seeds before the join changes nothing."""
    df = spark.createDataFrame([(1, "K" * 90 + "HHHAHH" + "K" * 90 + "DYKDDDDK")], "id int, s string")
    library = tags.tag_library(spark, [("His-Tag", "HHHHHH"), ("FLAG-Tag", "DYKDDDDK")])
    found = []
    for few in (100, 0):
        monkeypatch.setattr(tags, "FEW_SEEDS", few)
        found.append(sorted((r["name"], r["start"], r["identity"]) for r in tags.tag_hits(df, library, "id", "s", 80.0).collect()))
    assert found[0] == found[1] == [("FLAG-Tag", 186, 100.0), ("His-Tag", 90, 83.33)]


def test_pairs_within_few(spark):
    df = spark.createDataFrame([(i, f"A{i % 4 + 1}{'CDEFGH'[i]}") for i in range(6)], "id int, c string").select("id", M.parsed_code(F.col("c")).alias("mutations"))
    plain_rows = lambda d: sorted((r["a"], r["b"], plain(r["mutations"])) for r in d.collect())
    every = plain_rows(variants.pairs_within(df, "id"))
    assert plain_rows(variants.pairs_within(df, "id", few=df.where("id in (1, 4)"))) == [r for r in every if {1, 4} & {r[0], r[1]}]


def test_pairs_cover_the_table(spark):
    from strandforge import queries

    data = "/root/testdata/sf0.001"
    n = queries.table(spark, data, "part").count()
    assert queries.variant_pairs_cross(spark, data).select("a").distinct().count() == n
    within = queries.variant_pairs_within(spark, data)
    assert within.count() == 4 * (n - 4) + 6


def test_return_probabilities_have_100_steps(spark):
    from strandforge import queries

    data = "/root/testdata/sf0.001"
    steps = queries.return_probabilities(spark, data).groupBy("conv_id", "node").agg(F.collect_set("step").alias("s")).collect()
    assert steps and all(sorted(r["s"]) == list(range(100)) for r in steps)


def test_catalog_has_every_table(spark):
    from pathlib import Path

    from strandforge import queries

    data = "/root/testdata/sf0.001"
    assert {r["name"] for r in queries.catalog_report(spark, data).collect()} == {p.stem for p in Path(data).glob("*.parquet")}
