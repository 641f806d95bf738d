"""From raw documents to training sequences, in five stages; each is written and read again as the next one's input.

1. ``quality classifier``: documents that score under 0.3 go.
2. ``language id``: documents without a letter, or of which no language holds half of the words, go.
3. ``exact dedup``: of texts that are equal but for white space, the longest stays.
4. ``minhash near-dedup``: of each group of near duplicates (85 % or more of five-word shingles in common), the smallest doc_id stays.
5. ``best-fit packing``: all that is left, packed into sequences of 4096 tokens.

The stages before packing return the columns that they get, whatever these are besides ``doc_id``, ``text`` and ``lang``. A null text
counts as empty: language id rejects it. A row without doc_id is never dropped as a duplicate; repeated rows stay or go together; rows
that share a doc_id are told apart by their texts; very long texts are read whole; an empty table gives no rows.
Models are trained on what the stage gets, and on the ``labels`` table. ORACLE_SQL is None: the trained stages and the
tokenizer have no SQL; the tests hold every stage against a plain version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandforge.llm import exact, language, minhash, packing, quality
from strandforge.llm.common import stash
from strandforge.llm.queries import CAPACITY, END_ID, table, tokenizer_path

ORACLE_SQL: str | None = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), CAPACITY, END_ID)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("language id", language_stage),
    ("exact dedup", exact_stage),
    ("minhash near-dedup", near_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the ``documents`` of a directory."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
