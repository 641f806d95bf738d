"""License scan by diagonal voting, in DataFrame operations only.

Templates are whole license texts, searched by their rolling ``TEXT_GRAM``-word grams, and short phrases, searched by their
word pairs. Every such gram of every text is joined, by hash and then by the words themselves, to the positions of the
same gram in the templates (fixed lists of a checked size, so the broadcast side never grows). A hit votes for its
diagonal, the word at which the template would start. Diagonals of a template within a slack merge, so that a text with
inserted or missing words still forms one span. Spans are then verified: the words that a text's hits cover must be
``COVERAGE`` of the template's words, and lie in a stretch of at most ``STRETCH`` times its length; of a phrase,
``COVERAGE`` of its pairs must be met. A base phrase stands exactly where one diagonal holds all its pairs.

Nulls and edge cases: a null or word-less text has no words and no labels (empty strings, null positions, score 0);
repeated rows are scanned each; a null ``doc_id`` is carried through; several templates over the same words all count;
a very long text is scanned whole, a gram carries its own words only; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .license_texts import TEXTS

TEXT_GRAM, COVERAGE, STRETCH = 5, 0.8, 1.5
#: Words by which neighbouring diagonals of a phrase and of a text may lie apart.
PHRASE_SLACK, TEXT_SLACK = 2, 8
#: Grams of all templates at most: they are broadcast.
MOST_GRAMS = 100_000

# Words are runs of other characters than these; phrases and their labels.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
OWN = {
    "mit license": "mit",
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0 1 0": "cc0",
    "creative commons attribution": "cc",
    "public domain dedication": "public-domain",
}


def words_of(text: str) -> list[str]:
    """Words of a template, as ``scan`` takes them from documents."""
    return [w for w in re.split(BETWEEN_WORDS, text.translate(str.maketrans(UPPER, LOWER))) if w]


def templates(spark: SparkSession, base: dict[str, str], own: dict[str, str], texts: dict[str, str]) -> DataFrame:
    """One row per gram of each template; one row without template, which keeps documents that match nothing.

    ``base`` and ``own`` map phrases to labels, ``texts`` labels to license texts.
    """
    listed = [(words_of(p), x, True, 2) for p, x in base.items()] + [(words_of(p), x, False, 2) for p, x in own.items()] + [(words_of(t), x, False, TEXT_GRAM) for x, t in texts.items()]
    rows = [("", None, None, None, None, None, None)]
    for n, (words, label, is_base, k) in enumerate(listed):
        if len(words) < k:
            raise ValueError(f"the template {' '.join(words)!r} has fewer than {k} words")
        rows += [(" ".join(words[i : i + k]), n, label, is_base, k, len(words), i) for i in range(len(words) - k + 1)]
    if len(rows) > MOST_GRAMS:
        raise ValueError(f"templates have more than {MOST_GRAMS} grams; they are broadcast")
    found = spark.createDataFrame(rows, "gram string, template int, label string, base boolean, k int, size int, at int")
    return found.withColumn("hash", F.xxhash64("gram"))


def _grams(words: Column, k: int) -> Column:
    """Every k words in a row, joined by spaces."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.concat_ws(" ", w, *(F.get(words, i + n) for n in range(1, k))))


def scan(
    docs: DataFrame, base: dict[str, str] | None = None, own: dict[str, str] | None = None, texts: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of ``docs``."""
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.array_remove(F.split(lower, BETWEEN_WORDS), "").alias("words"))
    every = F.concat(F.array(F.lit("")), _grams(F.col("words"), 2), _grams(F.col("words"), TEXT_GRAM))
    keyed = words.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), every.alias("grams"))
    grams = keyed.select("row", "doc_id", "n_words", F.posexplode("grams").alias("n", "gram"))
    known = templates(docs.sparkSession, BASE if base is None else base, OWN if own is None else own, TEXTS if texts is None else texts)
    hits = grams.withColumn("hash", F.xxhash64("gram")).join(F.broadcast(known), ["hash", "gram"])  # MOST_GRAMS rows
    # behind the empty gram stand the pairs, then the longer grams
    place = (F.col("n") - 1 - F.when(F.col("k") == 2, F.lit(0)).otherwise(F.greatest(F.col("n_words") - 1, F.lit(0)))).cast("long")
    hits = hits.withColumn("place", place)
    key = ["row", "doc_id", "n_words", "template", "label", "base", "k", "size"]
    votes = hits.groupBy(*key, (F.col("place") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"), F.collect_set("at").alias("met"), F.min("place").alias("begin"), F.max("place").alias("end"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    slack = F.when(F.col("k") == 2, F.lit(PHRASE_SLACK)).otherwise(F.lit(TEXT_SLACK))
    opens = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > slack).cast("int"), F.lit(1))
    exact = F.col("base") & (F.col("votes") == F.col("size") - F.col("k") + 1)
    spans = (
        votes.withColumn("opens", opens)
        .withColumn("span", F.sum("opens").over(along))
        .groupBy(*key, "span")
        .agg(
            F.sum(exact.cast("long")).alias("places"),
            F.min(F.when(exact, F.col("diagonal"))).alias("first"),
            F.max(F.when(exact, F.col("diagonal"))).alias("last"),
            F.array_distinct(F.flatten(F.collect_list("met"))).alias("met"),
            (F.max("end") + F.first("k") - F.min("begin")).alias("stretch"),
        )
    )
    pairs = F.size("met") / (F.col("size") - 1)
    covered = F.size(F.array_distinct(F.flatten(F.transform("met", lambda i: F.sequence(i, i + (TEXT_GRAM - 1)))))) / F.col("size")
    share = F.when(F.col("k") == 2, pairs).when(F.col("stretch") <= STRETCH * F.col("size"), covered).otherwise(0.0)
    spans = spans.withColumn("share", share)
    stands = F.when(F.col("base"), F.col("places") > 0).otherwise(F.col("share") >= coverage)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        spans.groupBy("row", "doc_id", "n_words")
        .agg(
            F.coalesce(F.sum(F.when(F.col("base"), F.col("places"))), F.lit(0)).alias("n_base"),
            F.min("first").alias("first_word"),
            F.max("last").alias("last_word"),
            joined(F.when(F.col("base") & stands, F.col("label"))).alias("base_labels"),
            joined(F.when(stands, F.col("label"))).alias("labels"),
            F.coalesce(F.max(F.when(stands, F.col("share"))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
