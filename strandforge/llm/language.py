"""Language identification as a mixture: each document's language proportions by expectation-maximisation.

Each language is a table of log-likelihoods of hashed byte 3-grams. A document is taken to draw each of its words from
one of its languages; expectation-maximisation over the words' likelihoods finds the proportions. The language set is
chosen by penalised likelihood: starting from the best single language, the next most likely one is added as long as
the gain exceeds ``penalty * log(words)``. The prediction is the set's largest proportion, which is also the score.

The tables are fitted on at most ``max_docs`` labelled documents in all, shared evenly by the languages, those whose
ids hash lowest; their counts, at most languages x buckets rows, are summed in Spark. Every document is then decided
from its whole text in one pass without a shuffle.

Nulls and edge cases: a null text, a text without a letter, or an empty training set give ``und`` with score 0; rows
with a null ``lang`` do not train; a null ``doc_id`` is not held out; repeated rows are decided each, and train once; of
equal proportions the language that is first by name wins; a very long text is a batch of its own and is read whole; an
empty table gives no rows; other columns are ignored, whatever their names, and pass through ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, slices
from .quality import held_out

if TYPE_CHECKING:
    from pyspark import Broadcast

BITS = 16
MAX_DOCS = 6000
#: Languages at most: a table of 2**BITS doubles for each is broadcast once, half a megabyte a language.
MAX_LANGUAGES = 256
UNDETERMINED = "und"
# ASCII characters that are no letters stand as spaces between words
_spaces = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def units(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed 3-grams, first 3-gram of each word, first word of each text and the end) of all texts.

    A word's 3-grams are those that begin at the space before it or at a byte of it, and a text's do not depend on the next one.
    """
    raw = [b" " + (t or "").lower().encode().translate(_spaces) + b" \0" for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    buf = np.frombuffer(b"".join([*raw, b"  "]), np.uint8)
    wide = buf.astype(np.uint32)
    grams = ((wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    blank = (buf == 32) | (buf == 0)
    own = ~(blank[:-2] & blank[1:-1])
    at = np.cumsum(own) - own
    begins = np.flatnonzero(blank[:-2] & own)  # the space before each word
    return grams[own], at[begins], np.concatenate([[0], np.searchsorted(begins, ends)])


@dataclass
class Languages:
    names: list[str]
    table: np.ndarray  # buckets x languages, log-likelihoods

    def words(self, grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Log-likelihood of each word in each language."""
        if not len(begins):
            return np.zeros((0, len(self.names)))
        return np.add.reduceat(self.table[grams], begins, 0)


def mixture(words: np.ndarray, first: np.ndarray, rounds: int = 8, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) of each document; words: log-likelihoods, first: as from units().

    allowed: which languages each document may have.
    """
    sizes = np.diff(first)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    peak = words.max(1, keepdims=True) if len(words) else words[:, :1]
    if allowed is not None and len(words):
        peak = np.where(allowed[owner], words, -np.inf).max(1, keepdims=True)
    like = np.exp(np.minimum(words - peak, 0))
    start = np.ones((len(sizes), words.shape[1])) if allowed is None else allowed.astype(float)
    shares = start / start.sum(1, keepdims=True)
    full = sizes > 0
    at = first[:-1][full]
    for _ in range(rounds):
        joint = like * shares[owner]
        total = np.maximum(joint.sum(1, keepdims=True), 1e-300)
        shares[full] = np.add.reduceat(joint / total, at, 0) / sizes[full, None]
    total = np.maximum((like * shares[owner]).sum(1), 1e-300)
    level = np.zeros(len(sizes))
    if full.any():
        level[full] = np.add.reduceat(np.log(total) + peak[:, 0], at)
    return shares, level


def decide(model: Languages, texts: list[str | None], penalty: float = 3.0) -> tuple[list[str], list[float], list[dict[str, float]]]:
    """(language, score, proportions of the chosen set) of each text."""
    n, width = len(texts), len(model.names)
    grams, begins, first = units(texts)
    letters = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
    if not width:
        return [UNDETERMINED] * n, [0.0] * n, [{} for _ in texts]
    words = model.words(grams, begins)
    shares, _ = mixture(words, first)
    sizes = np.diff(first)
    full = sizes > 0
    alone = np.zeros((n, width))
    if full.any():
        alone[full] = np.add.reduceat(words, first[:-1][full], 0)
    ranks = np.argsort(-shares, 1, kind="stable")
    chosen = np.zeros((n, width), bool)
    best = alone.argmax(1)
    chosen[np.arange(n), best] = True
    final, level = chosen.astype(float), alone.max(1)
    trying = np.flatnonzero(full)
    for turn in range(1, width):
        if not len(trying):
            break
        wider = chosen[trying].copy()
        # the most likely language that is not in the set
        rest = np.where(np.take_along_axis(wider, ranks[trying], 1), width, np.arange(width)).min(1)
        wider[np.arange(len(trying)), np.take_along_axis(ranks[trying], rest[:, None], 1)[:, 0]] = True
        picked = np.concatenate([np.arange(first[i], first[i + 1]) for i in trying])
        bounds = np.concatenate([[0], np.cumsum(sizes[trying])])
        found, gained = mixture(words[picked], bounds, allowed=wider)
        better = gained - level[trying] > penalty * np.log(sizes[trying] + 1.0)
        taken = trying[better]
        chosen[taken], final[taken], level[taken] = wider[better], found[better], gained[better]
        trying = taken
    pick = final.argmax(1)
    names = [model.names[p] if ok and f else UNDETERMINED for p, ok, f in zip(pick, letters, full, strict=True)]
    scores = [float(final[i, p]) if name != UNDETERMINED else 0.0 for i, (p, name) in enumerate(zip(pick, names, strict=True))]
    sets = [{model.names[j]: float(final[i, j]) for j in np.flatnonzero(chosen[i])} if names[i] != UNDETERMINED else {} for i in range(n)]
    # letters of no word of the tables' alphabet still have a best language
    return names, scores, sets


def train(docs: DataFrame, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", smooth: float = 0.5) -> Languages:
    """3-gram tables of every language, from documents that are not held out (remainder 2 of 4)."""
    bound_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, 4, 2))
    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: their tables go to every executor")
    names = sorted(sizes)
    if not names:
        return Languages([], np.zeros((1 << BITS, 0)))
    each = max(1, max_docs // len(names))
    # only ids that hash below a bound that about twice ``each`` of a language meet go on, so that no task ranks all of one
    hashed = F.xxhash64("doc_id")
    bound = F.lit(None).cast("long")
    for lang, n in sizes.items():
        share = (2 * each + 64) / max(n, 1)
        bound = F.when(F.col("lang") == lang, F.lit((1 << 63) - 1 if share >= 1 else int(share * 2.0**64) - (1 << 63))).otherwise(bound)
    few = rows.select("doc_id", "lang").where(hashed <= bound).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = few.withColumn("place", place).where(F.col("place") <= each).select("doc_id", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            langs = batch.column(0).to_pylist()
            grams, begins, first = units(batch.column(1).to_pylist())
            starts = np.append(begins, len(grams))[first]
            for lang, a, b in zip(langs, starts[:-1], starts[1:], strict=True):
                sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
                sums[lang] += np.bincount(grams[a:b], minlength=1 << BITS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    # max_docs rows at most, one text for each: an id that stands on many rows trains by its last text in order
    texts = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.max("text").alias("text"))
    sums = texts.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((1 << BITS, len(names)), smooth)
    where = {x: i for i, x in enumerate(names)}
    table[sums["bucket"].to_numpy(), np.array([where[x] for x in sums["lang"].to_pylist()], np.int64)] += sums["n"].to_numpy()
    return Languages(names, np.log(table / table.sum(0)))


def batch_bytes(model: Languages) -> int:
    """Bytes of text decided at a time: each takes a number for every language."""
    return max(1 << 14, (4 << 20) // max(1, len(model.names)))


def _broadcast(model: Languages) -> Broadcast[Languages]:
    """The model once for each executor instead of once for each task; its size is bounded by MAX_LANGUAGES."""
    return SparkSession.getActiveSession().sparkContext.broadcast(model)


def decider(model: Languages, penalty: float = 3.0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: puts ``lang_pred`` and ``lang_score`` in place of the ``text`` column."""
    shared = _broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=batch_bytes(shared.value)):
            at = batch.schema.get_field_index("text")
            names, scores, _ = decide(shared.value, batch.column(at).to_pylist(), penalty)
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*(batch.schema.names[i] for i in rest), "lang_pred", "lang_score"])

    return run


def keep_identified(docs: DataFrame, least: float = 0.5, max_docs: int = MAX_DOCS, penalty: float = 3.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, of which one language holds ``least`` of the words or more."""
    shared = _broadcast(train(docs, max_docs, id_col, text_col, lang_col))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, limit=batch_bytes(shared.value)):
            names, scores, _ = decide(shared.value, batch.column(batch.schema.get_field_index(text_col)).to_pylist(), penalty)
            yield batch.filter(pa.array([n != UNDETERMINED and x >= least for n, x in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def identify(docs: DataFrame, max_docs: int = MAX_DOCS, penalty: float = 3.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``."""
    model = train(docs, max_docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, 4, 2).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(decider(model, penalty), "doc_id long, held_out boolean, lang_pred string, lang_score double").select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
