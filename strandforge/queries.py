"""Queries over the driver tables, one or more for each operator; inputs are derived as ``inputs`` says."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import mutations as M
from .functions import sequences as S
from .functions import targets as T
from .functions.alphabets import AA, AMINO, codons
from .operators import features, graphs, integrity, kernels, splits, tags, variants
from .plans import encodings
from .sources import tables
from .sources.shared import fresh_path

PARENT = "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQAPILSRVGDGTQDNLSGAEKAVQVKVK"
SHIFT = 7
#: The parent with other letters at two places.
ALTERED = PARENT[:10] + "W" + PARENT[11:30] + "C" + PARENT[31:]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Keys of the variants that all others are combined with: the full product is quadratic.
CROSSED, PAIRED = [52, 53, 9], [2, 3, 52, 9]
TAGS = [("His-Tag", "HHHHHH"), ("FLAG-Tag", "DYKDDDDK"), ("Long-Tag", "MGSSHHHHHHSSG"), ("His-Fusion", "SSHHHHHHSS"), ("Short-Leader", "MKK")]

COLUMN_TAGS = [tables.TagPattern("KEYED", ("key",)), tables.TagPattern("TEXT", ("text", "html")), tables.TagPattern("JUDGED", ("quality", "toxic"), True)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made_library() -> list[tuple[str, str]]:
    """150 tags of 5 to 1,024 residues by a rule, in 96 families, of all four types."""
    size = lambda i: round(5 * (1024 / 5) ** (i / 149))
    kind = lambda i: "Tag" if i < 91 else "Fusion" if i < 117 else "Leader" if i < 136 else "Cleavage"
    letter = lambda i, j: AMINO[hashlib.md5(f"{i}:{j}".encode()).digest()[0] % 20]
    # every seventh place in the library's order, so that each type has tags of all lengths
    return [(f"T{n % 96:02d}-{kind(n)}", "".join(letter(n * 7 % 150, j) for j in range(size(n * 7 % 150)))) for n in range(150)]


def library(spark: SparkSession) -> DataFrame:
    """The made library, written as a file and read from it."""
    path = f"{fresh_path(spark, 'tags')}.csv"
    rows = [(n, s.lower(), "made", "rule", "") for n, s in made_library()]
    spark.createDataFrame(rows, "name string, sequence string, method string, origin string, reference string").coalesce(1).write.csv(path, header=True)
    return tags.read_library(spark, path)


def altered(tag: F.Column) -> F.Column:
    """Every twelfth residue is A: more than nine in ten stay."""
    return F.regexp_replace(tag, "(.{11}).", "$1A")


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, aa_seq: all amino-acid letters of each document."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), f"[^{AMINO}{AMINO.lower()}]+", "")).alias("aa_seq"))


def _full(df: DataFrame) -> DataFrame:
    """``df`` without empty sequences: an outer explode binds the sequence, so that the filter does not derive it a second time."""
    return df.select("doc_id", F.explode_outer(F.array("aa_seq")).alias("aa_seq")).where("aa_seq <> ''")


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    letters = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", ""))
    mapped = F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC")
    return d.select("doc_id", mapped.alias("dna_seq"))


def coded(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """p_partkey, aa_mut, targets: two-site codes against PARENT, one wild type; ``shift`` moves the positions."""
    p = table(spark, sf_dir, "part")
    at = F.col("p_partkey") % 50
    site = lambda x, k: F.concat(F.substr(F.lit(PARENT), (x + 1).cast("int"), F.lit(1)), (x + 1 + shift).cast("string"), F.substr(F.lit(AMINO), ((F.col("p_size") + k) % 20 + 1).cast("int"), F.lit(1)))
    code = F.when(F.col("p_partkey") == 1, "wildtype").otherwise(F.concat_ws("_", site(at, 0), site(at + 7, 3)))
    return p.select("p_partkey", code.alias("aa_mut"), F.col("p_retailprice").alias("target price"), F.col("p_size").cast("double").alias("target size"))


def _long(df: DataFrame, key: str = "p_partkey", mutations: str = "m") -> DataFrame:
    return df.select(key, F.explode(mutations).alias("x")).select(key, "x.pos", "x.src", "x.targ")


def _r(c: F.Column | str) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def null_mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.nullif("lang", F.lit("en")).alias("lang"), F.nullif("source", F.lit("src0")).alias("source"), F.nullif(F.col("n_chars").cast("double"), F.lit(0.0)).alias("n"))
    return integrity.null_counts(d, ["lang", "source", "n"])


def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = integrity.problems(proteins(spark, sf_dir).select(F.nullif("aa_seq", F.lit("")).alias("aa_seq"), F.nullif(F.col("doc_id"), F.lit(0)).alias("n")))
    return spark.createDataFrame([(x,) for x in found], "problem string")


def index_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.with_index(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


def target_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("target price"))
    return T.zscored(o, ["target price"]).select("o_orderkey", _r(F.col("target price")).alias("z"))


def target_dezscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    means, stds = T.de_zscored(F.col("o_totalprice"), F.col("o_totalprice") / 2, 3.0, 2.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", _r(means).alias("mean"), _r(stds).alias("std"))


def target_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = T.target_matrix(coded(spark, sf_dir), 1, T.zscored)
    return m.select(_r(F.col("`target price`")).alias("z"))


def target_adjust_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.adjusted(coded(spark, sf_dir), {"target price": T.Objective("fix", 1200.0), "target size": T.Objective("min")})
    return out.select("p_partkey", _r(F.col("`target price`")).alias("price"), _r(F.col("`target size`")).alias("size"))


def summary_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    goals = {"target price": T.Objective("fix", 1200.0, 2.0), "target size": T.Objective("min", None, 0.5)}
    return T.with_summary(coded(spark, sf_dir), goals).select("p_partkey", _r(F.col(f"`{T.SUMMARY}`")).alias("summary"))


def summary_variable_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_summary(coded(spark, sf_dir)).select("p_partkey", _r(F.col(f"`{T.SUMMARY}`")).alias("summary"))


def target_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 50)


def feature_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    flat = features.FeatureView.of(e, ["label", "embedding"]).cat(e)
    return flat.select("vec_id", F.posexplode("features").alias("i", "x")).select("vec_id", "i", _r("x").alias("x"))


def feature_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features taken from the vector in another order."""
    e = table(spark, sf_dir, "embeddings")
    view = features.FeatureView.of(e, ["label", "embedding", "vec_id"])
    part = view.cat(e).select("vec_id", F.posexplode(view.get(F.col("features"), "embedding", "label")).alias("i", "x"))
    return part.select("vec_id", "i", _r("x").alias("x"))


def missing_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.nullif("lang", F.lit("en")).alias("lang"))
    return integrity.missing_mask(d, "lang").select("doc_id", "missing")


def parse_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(coded(spark, sf_dir).select("p_partkey", M.parsed_or_null(F.col("aa_mut")).alias("m")))


def non_parsed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark, sf_dir).where(M.is_unmutated(F.col("aa_mut"))).select("p_partkey", "aa_mut")


def parent_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.parent_sketch(coded(spark, sf_dir).select(M.parsed_or_null(F.col("aa_mut")).alias("m")), "m")


def parent_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coded(spark, sf_dir).withColumn("aa_seq", F.when(F.col("aa_mut") == "wildtype", F.lit(PARENT)))
    return spark.createDataFrame([(variants.parent_sequence(rows),)], "aa_seq string")


def estimate_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coded(spark, sf_dir, SHIFT).select(M.parsed_or_null(F.col("aa_mut")).alias("m"))
    return variants.offsets(rows, PARENT, "m").select("offset", F.col("matches").cast("long").alias("matches"), _r("matching_ratio").alias("matching_ratio"), "rank")


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parent_id, sequence: a parent for each nation, rotated by its key."""
    at = F.col("n_nationkey").cast("int") % len(PARENT)
    turned = F.concat(F.substr(F.lit(PARENT), at + 1), F.substr(F.lit(PARENT), F.lit(1), at))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("parent_id"), turned.alias("sequence"))


def offsets_on_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every placement of the codes on the parents of all nations."""
    rows = coded(spark, sf_dir).select(M.parsed_or_null(F.col("aa_mut")).alias("m"))
    return variants.offsets_on(rows, parents(spark, sf_dir), "m").select("parent_id", "offset", "matches", _r("matching_ratio").alias("matching_ratio"), "rank")


def apply_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.with_applied(coded(spark, sf_dir, SHIFT), "aa_mut", PARENT, out="aa_seq").select("p_partkey", "aa_seq")


def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coded(spark, sf_dir).withColumn("aa_seq", F.when(F.col("p_partkey") == 1, F.lit(PARENT)).when(F.col("p_partkey") % 3 == 0, F.lit("GIVEN")))
    return variants.filled(rows).select("p_partkey", "aa_seq")


def extract_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = variants.with_applied(coded(spark, sf_dir), "aa_mut", PARENT, 0, "v")
    return _long(rows.select("p_partkey", M.extracted(F.col("v"), F.lit(PARENT)).alias("m")))


def mutation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coded(spark, sf_dir).select("p_partkey", M.parsed_or_null(F.col("aa_mut")).alias("m"))
    back = M.from_arrays(M.as_arrays(F.col("m")))
    return rows.where("m is not null").select("p_partkey", M.code_of(back, "-", 0).alias("code"))


def extract_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = variants.with_applied(coded(spark, sf_dir), "aa_mut", PARENT, 0, "v")
    return rows.select("p_partkey", M.extracted_code(F.col("v"), F.lit(PARENT)).alias("code"))


def offset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best offset on a parent that differs in two places."""
    rows = coded(spark, sf_dir, SHIFT).select(M.parsed_or_null(F.col("aa_mut")).alias("m"))
    r = variants.offset_report(rows, ALTERED, "m")
    listed = r.select("offset", _r("matching_ratio").alias("matching_ratio"), F.explode(F.arrays_zip("non_match_pos", "non_match_source", "non_match_parent")).alias("x"))
    return listed.select("offset", "matching_ratio", F.col("x.non_match_pos").alias("pos"), F.col("x.non_match_source").alias("src"), F.col("x.non_match_parent").alias("par"))


def _beside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b, first, second: each variant and the one with the next key."""
    v = _variants(spark, sf_dir)
    after = v.select((F.col("p_partkey") - 1).alias("a"), F.col("p_partkey").alias("b"), F.col("mutations").alias("second"))
    return v.select(F.col("p_partkey").alias("a"), F.col("mutations").alias("first")).join(after, "a")


def combine_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _beside(spark, sf_dir).select("a", "b", M.code_of(M.combined(F.col("first"), F.col("second"))).alias("code"))


def concat_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _beside(spark, sf_dir).select("a", F.posexplode(M.concatenated(F.array("first", "second"))).alias("place", "x"))
    return both.select("a", "place", "x.pos", "x.src", "x.targ")


def similarity_lines() -> list[str]:
    """A matrix in the form of a file: 3 less the fewest letters that differ between codons of two residues."""
    of = {a: [c for c, x in codons().items() if x == a] for a in AA}
    score = lambda a, b: 3 - min(sum(x != y for x, y in zip(c, d, strict=True)) for c in of[a] for d in of[b])
    names = sorted(AA, reverse=True)
    return ["# similarity of codons", "  " + " ".join(names), *(" ".join([a, *(str(score(a, b)) for b in names)]) for a in names)]


def codon_matrix(spark: SparkSession) -> DataFrame:
    return tables.similarity_table(spark.createDataFrame(list(enumerate(similarity_lines())), "line_no int, value string"), "codons", AA)


def similarity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many proteins a residue stands right before another: counted, laid out as the lines of a matrix file, and read from these."""
    pairs = kernels.row_ngrams(proteins(spark, sf_dir), "doc_id", "aa_seq", 2, 2).groupBy("gram").agg(F.count("*").alias("n"))
    symbols = F.explode(F.split(F.lit(AA), ""))
    cells = spark.range(1).select(symbols.alias("row")).select("row", symbols.alias("col")).join(F.broadcast(pairs), F.concat("row", "col") == F.col("gram"), "left")  # a row for each pair of residues
    per = cells.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.instr(F.lit(AA), F.col("col")).alias("at"), F.coalesce("n", F.lit(0)).cast("string").alias("n")))).alias("v"))
    lines = per.select(F.instr(F.lit(AA), F.col("row")).alias("line_no"), F.concat_ws(" ", "row", F.transform("v", lambda x: x["n"])).alias("value"))
    head = spark.range(1).select(F.lit(0).alias("line_no"), F.lit("  " + " ".join(AA)).alias("value"))
    return tables.similarity_table(head.unionByName(lines), "neighbours", AA)


def similarity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every variant's sequence against the parent's."""
    scores = tables.similarity_array(codon_matrix(spark), AA)
    rows = variants.with_applied(coded(spark, sf_dir), "aa_mut", PARENT, 0, "v")
    return rows.select("p_partkey", tables.similarity_score(F.col("v"), F.lit(PARENT), scores, AA).alias("score"))


def ngram_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = variants.with_applied(coded(spark, sf_dir), "aa_mut", PARENT, 0, "v")
    return kernels.ngram_table(rows, "p_partkey", "v", 1, 3)


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3-grams of all proteins, numbered in order."""
    return kernels.vocabulary_table(proteins(spark, sf_dir), "aa_seq", 3, 3)


def sparse_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every protein over the vocabulary of 3-grams of all, one row for each entry that is not 0."""
    v = kernels.sparse_ngrams(proteins(spark, sf_dir), "doc_id", "aa_seq", 3, 3)
    cells = v.select("doc_id", "size", F.explode(F.arrays_zip("indices", "counts")).alias("x"))
    return cells.select("doc_id", "size", F.col("x.indices").alias("id"), F.col("x.counts").alias("n"))


def sparse_ngrams_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over the vocabulary of 4-grams that the pages' addresses and the benchmark's texts use: of unseen texts, most grams drop out."""
    learned = table(spark, sf_dir, "benchmark").select("text").unionByName(table(spark, sf_dir, "pages").select(F.col("url").alias("text")))
    v = kernels.sparse_ngrams(table(spark, sf_dir, "documents"), "doc_id", "text", 4, 4, kernels.vocabulary_table(learned, "text", 4, 4))
    return v.select("doc_id", "size", F.size("indices").cast("long").alias("n_entries"), F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n_grams"))


def one_hot_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of the one in each row of a one-hot matrix of fixed length, 0 for padding; through its flat form and back."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.substr(F.lit(PARENT), F.lit(1), F.col("p_size") + 1).alias("s"))
    flat = p.select("p_partkey", S.rows_to_flat(S.one_hot(F.col("s"), AA, len(PARENT))).alias("f"))
    rows = flat.select("p_partkey", F.posexplode(S.flat_to_rows(F.col("f"), len(AA))).alias("pos", "r"))
    return rows.select("p_partkey", "pos", F.array_position("r", F.lit(1).cast("tinyint")).alias("symbol"))


def encoding_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is computed, and in which order, for the tables of proteins, genes, both, and graphs, by their schemas."""
    found = {"proteins": proteins(spark, sf_dir), "genes": genes(spark, sf_dir), "graphs": turns(spark, sf_dir)}
    found["both"] = found["proteins"].join(found["genes"], "doc_id")
    parts = [encodings.plan_table(spark, [c for c in df.columns if not c.endswith("_id")]).withColumn("have", F.lit(name)) for name, df in found.items()]
    return reduce(DataFrame.unionByName, parts)


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All coded variants; the wild type has no mutations."""
    found = F.coalesce(M.parsed_or_null(F.col("aa_mut")), F.array().cast(M.MUTATIONS))
    return coded(spark, sf_dir).select("p_partkey", found.alias("mutations"))


def _few(spark: SparkSession, sf_dir: str, at: list[int]) -> DataFrame:
    """Named variants, the small side of a product with all variants."""
    return _variants(spark, sf_dir).where(F.col("p_partkey").isin(at))


def variant_pairs_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every variant combined with each of CROSSED."""
    out = variants.pairs_between(_variants(spark, sf_dir), F.broadcast(_few(spark, sf_dir, CROSSED)), "p_partkey")
    return out.select("a", "b", M.code_of(F.col("mutations")).alias("code"))


def variant_pairs_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of variants of which one at least is among PAIRED."""
    out = variants.pairs_within(_variants(spark, sf_dir), "p_partkey", few=_few(spark, sf_dir, PAIRED))
    return out.select("a", "b", M.code_of(F.col("mutations")).alias("code"))


def seq_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proteins(spark, sf_dir).select("doc_id", S.seq_length(F.col("aa_seq")).cast("long").alias("aa_len"))


def char_counts_1gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proteins(spark, sf_dir).select("doc_id", F.posexplode(S.symbol_counts(F.col("aa_seq"), AA)).alias("i", "n")).select("doc_id", "i", F.col("n").cast("long").alias("n"))


def char_ngram_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.row_ngrams(proteins(spark, sf_dir), "doc_id", "aa_seq", 2, 2)


def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ones of each sequence's one-hot matrix: a row for each of its characters."""
    return proteins(spark, sf_dir).select("doc_id", F.posexplode(S.symbol_places(F.col("aa_seq"), AA)).alias("pos", "symbol")).select("doc_id", "pos", F.col("symbol").cast("long").alias("symbol"))


def translate_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genes(spark, sf_dir).select("doc_id", S.translated(F.col("dna_seq")).alias("aa_seq"))


def sequence_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = proteins(spark, sf_dir).select("doc_id", F.lit("aa").alias("kind"), F.col("aa_seq").alias("s")).unionByName(genes(spark, sf_dir).select("doc_id", F.lit("dna").alias("kind"), F.col("dna_seq").alias("s")))
    return both.select("doc_id", "kind", S.sequence_type(F.col("s")).alias("type"))


def js_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _full(proteins(spark, sf_dir)).select("doc_id", _r(S.js_distance(F.col("aa_seq"))).alias("distance"))


def split_train_test_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    return splits.with_train_test(d, index="doc_id").select("doc_id", F.col(splits.TRAIN_TEST).alias("part"))


def split_kfold_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.with_folds(table(spark, sf_dir, "documents").select("doc_id"), 7, index="doc_id", column="fold")


def union_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = splits.by_column(split_kfold_md5(spark, sf_dir), "fold")
    return splits.union(parts, ["split_1", "split_6"]).groupBy("fold").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def kfold_train_test_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.fold_counts(split_kfold_md5(spark, sf_dir), "fold", 6).select("choice", "n_train", "n_test")


def minibatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = splits.with_batches(table(spark, sf_dir, "events").select("event_id"), 64, 11, "event_id")
    return out.select("event_id", F.col("batch_id").cast("long").alias("batch_id"))


def minibatch_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of the second epoch: first and last feature, and the target."""
    rows = features.feature_batches(table(spark, sf_dir, "embeddings"), ["embedding"], ["label"], 32, 42, 1, "vec_id")
    return rows.select("vec_id", F.col("batch_id").cast("long").alias("batch_id"), _r(F.col("x")[0]).alias("first"), _r(F.element_at("x", -1)).alias("last"), _r(F.col("y")[0]).alias("target"))


def permuted_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, part and fold of each vector by the keyed permutation of the row numbers."""
    e = splits.with_index(table(spark, sf_dir, "embeddings").select("vec_id"), ["vec_id"])
    both = splits.with_folds(splits.with_train_test(splits.position(e, 42, backend="keyed"), 42, backend="keyed", column="part"), 7, 42, backend="keyed", column="fold")
    return both.select("vec_id", "position", "part", "fold")


def minibatch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loader's batches of the second epoch: the vectors' numbers in order, sums over the features, the targets."""
    e = splits.with_index(table(spark, sf_dir, "embeddings"), ["vec_id"])
    loader = features.Loader(e, ("embedding", "vec_id"), ("label",), 32, 42)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    total = add(F.transform("embedding", lambda v: add(F.transform(v, lambda x: x.cast("double")))))
    ids = F.array_join(F.transform("vec_id", lambda v: v[0].cast("long").cast("string")), ",")
    return loader.batches(1).select("batch_id", ids.alias("ids"), F.round(total, 3).alias("total"), F.array_join(F.transform("label", lambda y: y.cast("int").cast("string")), ",").alias("labels"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, bnd_idcs: each conversation as a graph, an edge from every turn to the next, and one back to the first."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").cast("int").alias("last"))
    path = F.sequence(F.lit(0), F.col("last") - 1)
    return c.where("last > 0").select("conv_id", F.array(F.concat(path, F.array("last")), F.concat(F.transform(path, lambda i: i + 1), F.array(F.lit(0)))).alias("bnd_idcs"))


def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.with_counts(turns(spark, sf_dir)).select("conv_id", F.col("atm_count").cast("long").alias("atm_count"), F.col("bnd_count").cast("long").alias("bnd_count"))


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.adjacency_cells(turns(spark, sf_dir), "conv_id")


def adjacency_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = graphs.with_adjacency(turns(spark, sf_dir)).select("conv_id", F.posexplode("atm_adj").alias("row", "r"))
    return m.select("conv_id", "row", F.posexplode("r").alias("col", "v")).where("v > 0").select("conv_id", "row", "col")


def incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = graphs.with_incidence(turns(spark, sf_dir), directed=True).select("conv_id", F.posexplode("atm_bnd_incid").alias("node", "r"))
    return m.select("conv_id", "node", F.posexplode("r").alias("edge", "v")).where("v <> 0").select("conv_id", "node", "edge", F.col("v").cast("double").alias("v"))


def adjacency_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = turns(spark, sf_dir).withColumn("bnd_type", F.transform(F.col("bnd_idcs")[0], lambda i: i % 2))
    parts = g.select("conv_id", F.posexplode(graphs.edges_by_type(F.col("bnd_idcs"), F.col("bnd_type"), [0, 1, 9])).alias("type", "e"))
    return parts.select("conv_id", "type", F.size(F.col("e")[0]).cast("long").alias("n"))


def incidence_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = turns(spark, sf_dir).withColumn("bnd_type", F.transform(F.col("bnd_idcs")[0], lambda i: i % 2))
    m = graphs.with_typed_incidence(g, "bnd_type", [1, 0], directed=True).select("conv_id", F.posexplode("atm_bnd_incid_by_type").alias("type", "m"))
    m = m.select("conv_id", "type", F.posexplode("m").alias("node", "r")).select("conv_id", "type", "node", F.posexplode("r").alias("edge", "v"))
    return m.where("v <> 0").select("conv_id", "type", "node", "edge", F.col("v").cast("double").alias("v"))


def return_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graphs.with_return_probabilities(graphs.with_adjacency(turns(spark, sf_dir)), out="p")
    rows = g.select("conv_id", F.posexplode("p").alias("node", "r"))
    return rows.select("conv_id", "node", F.posexplode("r").alias("step", "p")).select("conv_id", "node", "step", _r("p").alias("p"))


def sparse_return_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten steps of the walk without matrices."""
    found = graphs.sparse_return_probabilities(graphs.adjacency_cells(turns(spark, sf_dir), "conv_id"), "conv_id", 10)
    return found.select("conv_id", "node", "step", _r("p").alias("p"))


def linear_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the ten label prototypes (the smallest vec_id of each label)."""
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("vec_id"))
    return kernels.linear_kernel(e, first, "vec_id", "embedding").select("a", "b", (F.round("value", 4) + F.lit(0.0)).alias("value"))


def kmer_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.distinct_kmers(proteins(spark, sf_dir), "aa_seq", 3)


def _rows8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a matrix of 8 positions of 8 values."""
    return table(spark, sf_dir, "embeddings").select("vec_id", S.flat_to_rows(F.col("embedding"), 8).alias("m"))


def mean_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows8(spark, sf_dir).select("vec_id", F.posexplode(kernels.mean_over_positions(F.col("m"))).alias("i", "x")).select("vec_id", "i", _r("x").alias("x"))


def kmer_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows8(spark, sf_dir).select("vec_id", F.posexplode(kernels.mean_kmers(F.col("m"), 3)).alias("i", "x")).select("vec_id", "i", _r("x").alias("x"))


def kmer_mean_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows8(spark, sf_dir).select("vec_id", F.posexplode(kernels.normalised_mean_kmers(F.col("m"), 3)).alias("i", "x")).select("vec_id", "i", _r("x").alias("x"))


def kmer_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of the unit vector of each distinct window, and how many windows have them."""
    c = kernels.kmer_centers(_rows8(spark, sf_dir), "vec_id", "m", 3).select(_r(F.col("unit")[0]).alias("first"), _r(F.col("unit")[23]).alias("last"))
    return c.groupBy("first", "last").agg(F.count("*").alias("n"))


def rkhs_kmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.rkhs_features(_rows8(spark, sf_dir), "vec_id", "m", 3, 8)


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proteins with planted tags: in front of every fifth, behind every seventh."""
    p = proteins(spark, sf_dir)
    front = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("MGSSHHHHHHSSG"), F.col("aa_seq"))).otherwise(F.col("aa_seq"))
    return p.withColumn("aa_seq", F.when(F.col("doc_id") % 7 == 0, F.concat(front, F.lit("DYKDDDDK"))).otherwise(front))


def tag_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = tags.tag_hits(tagged(spark, sf_dir), tags.tag_library(spark, TAGS), "doc_id", "aa_seq", 80.0)
    return hits.select("doc_id", "name", "start", "identity")


def library_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proteins with a tag of the made library in front of every third, and an altered one behind every second."""
    of = F.broadcast(library(spark).select("place", "tag"))
    rows = proteins(spark, sf_dir).withColumn("place", (F.col("doc_id") % 150).cast("int")).join(of, "place")
    front = F.when(F.col("doc_id") % 3 == 0, F.col("tag")).otherwise("")
    back = F.when(F.col("doc_id") % 2 == 0, altered(F.col("tag"))).otherwise("")
    return rows.select("doc_id", F.concat(front, F.col("aa_seq"), back).alias("aa_seq"))


def tag_library_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tags of a library of 150 in all proteins."""
    hits = tags.tag_hits(library_tagged(spark, sf_dir), library(spark), "doc_id", "aa_seq")
    return hits.select("doc_id", "place", "name", "start", "identity")


def tag_library_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = library_tagged(spark, sf_dir)
    hits = tags.nonredundant(tags.tag_hits(rows, library(spark), "doc_id", "aa_seq"), "doc_id")
    return tags.stripped(rows, hits, "doc_id", "aa_seq")


def _nonredundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.nonredundant(tags.tag_hits(tagged(spark, sf_dir), tags.tag_library(spark, TAGS), "doc_id", "aa_seq"), "doc_id")


def tag_nonredundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nonredundant(spark, sf_dir).select("doc_id", "name", "start", "end")


def tag_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.stripped(tagged(spark, sf_dir), _nonredundant(spark, sf_dir), "doc_id", "aa_seq")


def tag_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits against an alignment in which the planted tags stand over gaps."""
    gaps = lambda by, n: F.when(F.col("doc_id") % by == 0, "-" * n).otherwise("")
    bare = proteins(spark, sf_dir).select("doc_id", F.col("aa_seq").alias("bare"))
    rows = tagged(spark, sf_dir).join(bare, "doc_id").withColumns({"q": F.nullif("aa_seq", F.lit("")), "r": F.nullif(F.concat(gaps(5, 13), F.col("bare"), gaps(7, 8)), F.lit(""))})
    hits = tags.tag_hits(rows, tags.tag_library(spark, TAGS), "doc_id", "aa_seq", 80.0)
    return tags.with_conservation(hits, rows, "doc_id", "aa_seq", "q", "r").select("doc_id", "name", "start", "conservation")


def tag_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tags.find_tags(tagged(spark, sf_dir), tags.tag_library(spark, TAGS), "doc_id", "aa_seq")
    return found.select("doc_id", F.explode("tags").alias("t")).select("doc_id", "t.name", "t.start", "t.end", "t.location")


def tag_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = tags.with_strip_report(tagged(spark, sf_dir), _nonredundant(spark, sf_dir), "doc_id", "aa_seq")
    return report.select("doc_id", "tags_found", F.array_join("names", ",").alias("names"), F.array_join("locations", ",").alias("locations"), "summary", "sequence")


def cleaning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences with tags, and tags by terminus."""
    report = tags.with_strip_report(tagged(spark, sf_dir), _nonredundant(spark, sf_dir), "doc_id", "aa_seq")
    return tags.cleaning_summary(report)


def clean_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _full(tagged(spark, sf_dir))
    return tags.cleaned(rows, tags.tag_library(spark, TAGS), "doc_id", "aa_seq", convert=True, drop_artificial=True)


def tag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tagged(spark, sf_dir)
    hits = tags.tag_hits(rows, tags.tag_library(spark, TAGS), "doc_id", "aa_seq", 80.0)
    return tags.tag_summary(hits, rows, "doc_id")


def artificial_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.without_artificial(_full(proteins(spark, sf_dir)), "aa_seq", 0.2).select("doc_id")


def catalog_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.catalog(spark, {n: table(spark, sf_dir, n) for n in TABLES}).select("name", "n_rows", F.col("n_columns").cast("long").alias("n_columns"), "features")


def column_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, tag) for n in TABLES for tag in tables.table_tags(table(spark, sf_dir, n).columns, COLUMN_TAGS)]
    return spark.createDataFrame(rows, "name string, tag string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = """summary_variable null_mask_counts integrity_report index_column target_zscore target_dezscore target_matrix target_adjust_max
    summary_variable_default target_histogram feature_concat parse_mutations non_parsed_rows parent_sketch parent_sequence estimate_offset apply_mutations
    fill_missing extract_mutations mutation_codes variant_pairs_cross variant_pairs_within seq_length char_counts_1gram char_ngram_2 one_hot translate_dna
    sequence_types js_distances split_train_test_md5 split_kfold_md5 union_splits kfold_train_test_sets minibatches graph_counts adjacency adjacency_dense
    incidence adjacency_by_type return_probabilities linear_kernel kmer_distinct mean_embedding kmer_mean rkhs_kmer tag_hits tag_nonredundant tag_strip
    tag_summary artificial_filter catalog_report feature_slices missing_mask extract_codes offset_report combine_variants concat_mutations similarity_matrix
    similarity_score ngram_range one_hot_padding encoding_plan minibatch_features incidence_by_type kmer_mean_unit kmer_centers tag_conservation tag_locations
    tag_report cleaning_summary clean_dataset column_tags tag_library_hits tag_library_strip vocabulary sparse_ngrams sparse_ngrams_given permuted_splits
    minibatch_rows sparse_return_probabilities offsets_on_parents""".split()
    return {n: globals()[n] for n in names}
