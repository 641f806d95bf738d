"""Purification tags: approximate search as a seed join, redundancy, termini, stripping and reports.

A tag of length n may differ in ``floor(n * (100 - cutoff) / 100)`` places, so one of that many plus one disjoint seeds
must occur exactly. The tag library is small and fixed, so its seeds are broadcast; sequences are cut into short pieces that
overlap by a tag's length, pieces give their k-mers of the seed lengths, and only seed hits are verified. A k-mer thus carries
its piece and never the whole sequence, which may be of any length. Libraries of many or long tags, with more seeds than FEW_SEEDS,
are searched by ``tag_index`` instead, with the same result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandforge.functions.sequences import js_distance, sequence_type, translated
from strandforge.operators.splits import with_index
from strandforge.operators.tag_index import library_windows
from strandforge.sources.tables import read_table, write_csv

HIT = "struct<name: string, tag: string, type: string, start: int, end: int, identity: double>"
MOST_TAGS = 10_000
# Name endings of tag types; residues that a fusion tag leaves outside; the gap within a terminus.
TYPES = {"-Fusion": "fusion", "-Leader": "leader", "-Cleavage": "cleavage"}
FUSION_REST, MARGIN, FIRST_M = 25, 4, 4
#: Symbols of a piece, besides what it shares with the next one.
PIECE = 64
#: So many seeds at most are looked for in a piece before its k-mers are taken.
FEW_SEEDS = 100


def tag_type(name: Column) -> Column:
    return F.coalesce(*(F.when(name.endswith(end), kind) for end, kind in TYPES.items()), F.lit("purification"))


def tag_library(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """place, name, tag, type of (name, sequence) rows in library order."""
    if len(rows) > MOST_TAGS:
        raise ValueError(f"a tag library has at most {MOST_TAGS} rows; it is broadcast")
    found = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(rows)], "place int, name string, tag string")
    return found.withColumn("type", tag_type(F.col("name")))


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """A tag library from a CSV file with the columns name and sequence, in file order."""
    rows = read_table(spark, path).select("name", F.upper(F.trim("sequence")).alias("tag")).limit(MOST_TAGS + 1).collect()  # a bounded library
    return tag_library(spark, [(r["name"], r["tag"]) for r in rows])


def _seeds(tags: DataFrame, cutoff: float) -> DataFrame:
    n = F.length("tag")
    parts = F.least(F.floor(n * (100 - cutoff) / 100 + 1e-9).cast("int") + 1, n)
    at = lambda i: F.floor(i * n / parts).cast("int")
    cut = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(at(i).alias("at"), F.substr(F.col("tag"), at(i) + 1, at(i + 1) - at(i)).alias("seed")))
    return tags.select("place", "name", "tag", "type", F.explode(cut).alias("s")).select("place", "name", "tag", "type", F.col("s.at").alias("seed_at"), F.col("s.seed").alias("seed"))


def _windows(text: Column, k: int) -> Column:
    """struct<i (from 1), seed> of each window of ``k`` symbols of a short text."""
    starts = F.when(F.length(text) >= k, F.sequence(F.lit(1), F.greatest(F.length(text) - (k - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("i"), F.substr(text, i, F.lit(k)).alias("seed")))


def _pieces(text: Column, overlap: int) -> Column:
    """struct<begin (from 0), piece> of each piece of a text, in time linear in it; hits that start in its own symbols lie in the piece whole."""
    size = max(PIECE, overlap)
    own = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    # the one-element array binds the pieces for the look at the next one
    return F.transform(F.array(own), lambda all_: F.transform(all_, lambda p, j: F.struct((j * size).alias("begin"), F.length(p).alias("own"), F.concat(p, F.left(F.coalesce(F.get(all_, j + 1), F.lit("")), F.lit(overlap))).alias("piece"))))[0]


def tag_hits(df: DataFrame, tags: DataFrame, key: str, seq: str, cutoff: float = 90.0) -> DataFrame:
    """key, place, name, tag, type, start, end, identity of every window that is a tag to ``cutoff`` percent."""
    seeds = _seeds(tags, cutoff)
    known = seeds.select("seed", F.length("tag")).distinct().collect()  # of a bounded library
    if len({r[0] for r in known}) > FEW_SEEDS:
        return _library_hits(df, tags, key, seq, cutoff)
    lengths = sorted({len(r[0]) for r in known})
    cut = df.select(key, F.length(seq).alias("__n"), F.explode(_pieces(F.col(seq), max((r[1] for r in known), default=1) - 1)).alias("p"))
    found = sorted({r[0] for r in known})
    cut = cut.where(F.col("p.piece").rlike("|".join(map(re.escape, found))))  # pieces without any seed have no hits
    cut = cut.select(key, "__n", F.col("p.begin").alias("__begin"), F.col("p.own").alias("__own"), F.col("p.piece").alias("__piece"))
    grams = F.flatten(F.array(*(_windows(F.col("__piece"), k) for k in lengths)))
    spread = cut.select("*", F.explode(grams).alias("g")).select(key, "__n", "__begin", "__own", "__piece", F.col("g.i").alias("i"), F.col("g.seed").alias("seed"))
    n = F.length("tag")
    rest = F.col("__n") - n
    met = spread.join(F.broadcast(seeds), "seed").withColumn("__at", F.col("i") - 1 - F.col("seed_at")).withColumn("start", F.col("__begin") + F.col("__at"))
    met = met.where((F.col("__at") >= 0) & (F.col("__at") < F.col("__own")) & (F.col("start") <= rest) & (rest > 0) & ((F.col("type") != "fusion") | (rest >= FUSION_REST)))
    window = F.substr(F.col("__piece"), F.col("__at") + 1, n)
    same = F.aggregate(F.zip_with(F.split(window, ""), F.split(F.col("tag"), ""), lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    scored = met.withColumn("identity", F.bround(100 * same / n, 2)).where(F.col("identity") >= cutoff)
    return scored.select(key, "place", "name", "tag", "type", "start", (F.col("start") + n).alias("end"), "identity").distinct()


def _library_hits(df: DataFrame, tags: DataFrame, key: str, seq: str, cutoff: float) -> DataFrame:
    rows = tags.orderBy("place").collect()  # of a bounded library
    found = library_windows(df, [r["tag"] for r in rows], key, seq, cutoff)
    n = F.length("tag")
    named = tags.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "__at int, place int, name string, tag string, type string")
    met = found.withColumnRenamed("place", "__at").join(F.broadcast(named), "__at").withColumn("rest", F.col("length") - n)
    met = met.where((F.col("rest") > 0) & ((F.col("type") != "fusion") | (F.col("rest") >= FUSION_REST)))
    scored = met.withColumn("identity", F.bround(100 * F.col("same") / n, 2)).where(F.col("identity") >= cutoff)
    return scored.select(key, "place", "name", "tag", "type", "start", (F.col("start") + n).alias("end"), "identity")


def contains_hit(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """One of two hits lies within the other."""
    return ((a_start <= b_start) & (b_end <= a_end)) | ((b_start <= a_start) & (a_end <= b_end))


def nonredundant(hits: DataFrame, key: str) -> DataFrame:
    """Of hits of one tag family (the name up to its first hyphen), the longest; those within or around it go.

    The hits of one sequence and family are few, and are folded within their row.
    """
    family = F.split(F.col("name"), "-")[0]
    order = F.struct((-(F.col("end") - F.col("start"))).alias("o"), "place", "start", "name", "tag", "type", "end", "identity")
    listed = hits.groupBy(key, family.alias("__family")).agg(F.array_sort(F.collect_list(order)).alias("h"))
    inside = lambda x, y: contains_hit(x["start"], x["end"], y["start"], y["end"])
    kept = F.aggregate("h", F.slice("h", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: inside(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return listed.select(key, F.explode(kept).alias("x")).select(key, *(F.col(f"x.{c}").alias(c) for c in ("place", "name", "tag", "type", "start", "end", "identity")))


def with_conservation(hits: DataFrame, df: DataFrame, key: str, seq: str, query_aln: str, reference_aln: str) -> DataFrame:
    """``hits`` and conservation: percent of a hit's residues that the aligned reference shares; 0 where there is no alignment.

    Alignments must be of one length, not empty, and the query's must be the sequence but for gaps.
    """
    q, r = F.col(query_aln), F.col(reference_aln)
    wrong = F.when(F.length(q) == 0, "an empty query alignment").when(F.length(r) == 0, "an empty reference alignment").when(F.length(q) != F.length(r), "alignments differ in length")
    wrong = wrong.when(F.replace(q, F.lit("-"), F.lit("")) != F.col(seq), "the query alignment is not the sequence")
    pairs = F.filter(F.arrays_zip(F.split(q, "").alias("q"), F.split(r, "").alias("r")), lambda x: x["q"] != "-")
    shared = F.array_join(F.transform(pairs, lambda x: F.when(x["q"] == x["r"], "1").otherwise("0")), "")
    mask = F.when(q.isNotNull() & r.isNotNull(), F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string")).otherwise(shared))
    met = hits.join(df.select(key, mask.alias("__mask")), key)
    n = F.col("end") - F.col("start")
    part = F.substr(F.col("__mask"), F.col("start") + 1, n)
    same = F.length(part) - F.length(F.replace(part, F.lit("1"), F.lit("")))
    return met.withColumn("conservation", F.coalesce(F.bround(100 * same / n, 2), F.lit(0.0))).drop("__mask")


def termini(hits: Column, seq: Column, margin: int = MARGIN) -> Column:
    """struct<n_end, c_start>: the end of the N-terminal tags and the start of the C-terminal ones; hits are an array of structs with start and end.

    Hits are walked inwards from each end, as long as the next one lies near enough: a fold over them in order.
    """
    size = lambda h: h["end"] - h["start"]
    near = lambda gap, h: F.abs(gap) <= F.when(size(h) <= margin, size(h) - 1).otherwise(F.lit(margin))

    def walk(ordered: Column, begin: Column, outer: str, inner: str) -> Column:
        start = F.struct(begin.alias("at"), F.lit(True).alias("on"))
        step = lambda s, h: F.when(s["on"] & near(h[outer] - s["at"], h), F.struct(h[inner].alias("at"), F.lit(True).alias("on"))).otherwise(F.struct(s["at"].alias("at"), F.lit(False).alias("on")))
        return F.aggregate(ordered, start, step, lambda s: s["at"])

    plain = F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end")))
    back = F.transform(F.array_sort(F.transform(hits, lambda h: F.struct((-h["end"]).alias("o"), h["start"].alias("start"), h["end"].alias("end")))), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end")))
    first = walk(F.array_sort(plain), F.lit(0), "start", "end")
    last = walk(back, F.length(seq), "end", "start")
    # the first M that follows at once
    placed = lambda n: n + F.greatest(F.instr(F.substr(seq, n + 1, F.lit(FIRST_M)), F.lit("M")) - 1, F.lit(0))
    n_end = F.transform(F.array(first), placed)[0]
    return F.when(seq.isNull(), F.struct(F.lit(0).alias("n_end"), F.lit(0).alias("c_start"))).otherwise(F.struct(n_end.alias("n_end"), last.alias("c_start")))


FOUND = "array<struct<start: int, end: int, name: string, tag: string, type: string, conservation: double>>"


def with_tags(df: DataFrame, hits: DataFrame, key: str, seq: str, cutoff: float = 90.0, *, quirk: bool = False) -> DataFrame:
    """``df`` with n_end, c_start and tags: the hits of each sequence that are not conserved beyond ``cutoff``, by start, with their location.

    Location: N-terminus, C-terminus or Internal. Leaders are never at the C-terminus; leaders, fusions and cleavage sites are
    never internal; a tag of at most MARGIN residues must stand that close to the end. Hits without a location are left out.
    ``quirk``: a hit is internal only where no hit is terminal.
    """
    known = hits if "conservation" in hits.columns else hits.withColumn("conservation", F.lit(0.0))
    order = F.struct(*(F.col(c).alias(c) for c in ("start", "end", "name", "tag", "type", "conservation")))
    per = known.where(F.col("conservation") <= cutoff).groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("__hits"))  # few for a sequence

    joined = df.join(per, key, "left").withColumn("__hits", F.coalesce("__hits", F.array().cast(FOUND))).withColumn("__ends", termini(F.col("__hits"), F.col(seq)))
    joined = joined.withColumns({"n_end": F.col("__ends.n_end"), "c_start": F.col("__ends.c_start"), "__len": F.length(seq)})
    size = lambda h: h["end"] - h["start"]
    beside = lambda h, gap: (size(h) > MARGIN) | (gap <= size(h) - 1)
    front = lambda h: (h["end"] <= F.col("n_end")) & beside(h, h["start"])
    back = lambda h: (h["type"] != "leader") & (h["start"] >= F.col("c_start")) & beside(h, F.abs(h["end"] - F.col("__len")))
    inner = lambda h: (h["type"] == "purification") & (~F.exists("__hits", lambda x: front(x) | back(x)) if quirk else F.lit(True))
    where = lambda h: F.when(back(h), "C-terminus").when(front(h), "N-terminus").when(inner(h), "Internal")
    placed = F.transform("__hits", lambda h: h.withField("location", where(h)))
    return joined.withColumn("tags", F.filter(placed, lambda h: h["location"].isNotNull())).drop("__hits", "__ends", "__len")


def _removed() -> Column:
    return F.filter("tags", lambda h: h["location"] != "Internal")


def stripped(df: DataFrame, hits: DataFrame, key: str, seq: str) -> DataFrame:
    """``df`` with n_end, c_start, stripped_seq and removed_tags (names of the terminal tags, by start)."""
    found = with_tags(df, hits, key, seq)
    bare = F.substr(F.col(seq), F.col("n_end") + 1, F.greatest(F.col("c_start") - F.col("n_end"), F.lit(0)))
    return found.withColumns({"stripped_seq": bare, "removed_tags": F.array_join(F.transform(_removed(), lambda h: h["name"]), ",")}).drop("tags")


def with_strip_report(df: DataFrame, hits: DataFrame, key: str, seq: str) -> DataFrame:
    """``df`` with tags_found, names, locations, summary and sequence (without its terminal tags)."""
    found = with_tags(df, hits, key, seq).withColumn("__out", _removed())
    one = lambda h: F.concat(F.lit("["), h["name"], F.lit(":"), h["start"].cast("string"), F.lit("-"), h["tag"], F.lit("-"), h["end"].cast("string"), F.lit("]"))
    of = lambda place: F.coalesce(F.nullif(F.array_join(F.transform(F.filter("__out", lambda h: h["location"] == place), one), " "), F.lit("")), F.lit("None"))
    out = {
        "tags_found": F.size("__out") > 0,
        "names": F.transform("__out", lambda h: h["name"]),
        "locations": F.transform("__out", lambda h: h["location"]),
        "summary": F.concat(F.lit("N-term: "), of("N-terminus"), F.lit(" C-term: "), of("C-terminus")),
        "sequence": F.substr(F.col(seq), F.col("n_end") + 1, F.greatest(F.col("c_start") - F.col("n_end"), F.lit(0))),
    }
    return found.withColumns(out).drop("__out", "tags", "n_end", "c_start")


def find_tags(df: DataFrame, tags: DataFrame, key: str, seq: str, cutoff: float = 90.0, query_aln: str | None = None, reference_aln: str | None = None, *, quirk: bool = False) -> DataFrame:
    """Search, redundancy, conservation (where alignments are named), termini and locations: see with_tags."""
    hits = nonredundant(tag_hits(df, tags, key, seq, cutoff), key)
    if query_aln and reference_aln:
        hits = with_conservation(hits, df, key, seq, query_aln, reference_aln)
    return with_tags(df, hits, key, seq, cutoff, quirk=quirk)


def cleaned(df: DataFrame, tags: DataFrame, key: str, seq: str, *, convert: bool = False, drop_artificial: bool = False) -> DataFrame:
    """``df`` with its sequences converted to proteins (``convert``), stripped of terminal tags, and a summary in ``removed_tags``;
    ``drop_artificial``: rows of unnatural composition that do not begin with M go."""
    rows = df.withColumn(seq, converted(F.col(seq))) if convert else df
    if drop_artificial:
        rows = without_artificial(rows, seq)
    report = with_strip_report(rows, nonredundant(tag_hits(rows, tags, key, seq), key), key, seq)
    return report.withColumns({seq: F.col("sequence"), "removed_tags": F.col("summary")}).select(*df.columns, "removed_tags")


def cleaning_summary(report: DataFrame) -> DataFrame:
    """One row of a table with a strip report: sequences, with_tags and their percent, tags, n_terminal, c_terminal and their percents."""
    at = lambda place: F.coalesce(F.sum(F.size(F.filter("locations", lambda x: x == place))), F.lit(0))
    counts = report.agg(F.count("*").alias("sequences"), F.count_if(F.col("tags_found")).alias("with_tags"), F.coalesce(F.sum(F.size("locations")), F.lit(0)).alias("tags"), at("N-terminus").alias("n_terminal"), at("C-terminus").alias("c_terminal"))
    percent = lambda a, b: F.bround(100 * F.col(a) / F.nullif(F.col(b), F.lit(0))).cast("int")
    return counts.withColumns({"tag_percent": percent("with_tags", "sequences"), "n_percent": percent("n_terminal", "tags"), "c_percent": percent("c_terminal", "tags")})


def strip_csv(spark: SparkSession, source: str, target: str, seq: str, tags: DataFrame) -> DataFrame:
    """Strip the sequences of a CSV file into another (column ``removed_tags`` says of what); returns the summary."""
    if not source.lower().endswith(".csv"):
        raise TypeError("a CSV file is needed")
    rows = with_index(read_table(spark, source), name="__row")
    hits = nonredundant(tag_hits(rows, tags, "__row", seq), "__row")
    report = with_strip_report(rows, hits, "__row", seq)
    out = report.withColumns({seq: F.col("sequence"), "removed_tags": F.col("summary")})
    write_csv(out.select(*(c for c in rows.columns if c != "__row"), "removed_tags"), target)
    return cleaning_summary(report)


def tag_summary(hits: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """name, n_hits, n_sequences, percent of all sequences, rounded half to even."""
    n = rows.agg(F.count("*").alias("__n"))
    per = hits.groupBy("name").agg(F.count("*").alias("n_hits"), F.count_distinct(key).alias("n_sequences"))
    return per.crossJoin(F.broadcast(n)).select("name", "n_hits", "n_sequences", F.bround(100 * F.col("n_sequences") / F.nullif("__n", F.lit(0))).cast("int").alias("percent"))  # one row


def converted(seq: Column, *, strict: bool = True) -> Column:
    """Protein of nucleotide sequences, stops dropped; other sequences as they are. ``strict``: what is no protein then is an error."""

    def of(x: Column) -> Column:
        protein = translated(x, all_stops=True)
        if strict:
            known = sequence_type(protein).isin("Protein", "Ambiguous_Protein")
            protein = F.when(known, protein).otherwise(F.raise_error(F.concat(F.lit("unknown sequence: "), x)).cast("string"))
        return F.when(sequence_type(x).isin("DNA", "RNA"), protein).otherwise(x)

    return F.transform(F.array(seq), of)[0]  # the array binds the sequence


def without_artificial(df: DataFrame, seq: str, most: float = 0.6) -> DataFrame:
    """Rows whose composition is natural or which begin with M."""
    return df.where((js_distance(F.col(seq)) <= most) | F.startswith(F.upper(seq), F.lit("M")))
