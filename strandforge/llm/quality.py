"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: hashed byte 3-grams of the text, and 3-grams of marks that say of each word whether it
repeats the one before it. Each indicator is scaled by its class log-count ratio (naive
Bayes), a linear hinge-loss model is fitted on the scaled indicators by dual coordinate descent, and a logistic curve maps
margins to scores.

The model is fitted on labelled rows in the order of their ids' hashes, with all features of each: ``max_rows`` rows at most, and
as many as have ``MAX_FEATURES`` features together (one row at least). So its cost and the size of what reaches the driver do not
grow with the corpus; every row is scored, from its whole text, in one pass without a shuffle.

Nulls and edge cases: a null text counts as empty and is scored from the model's offset; rows without a label (or a null
one) do not train; with several labels for an id the highest counts; without any training row, or with one class only,
every score is the share of label 1 (1 where there is no row); a null ``doc_id`` never trains and is not held out; repeated
rows are scored each and train once; a score of exactly the threshold passes; a very long text is a batch of its own and is
scored whole; an empty table gives no rows; other columns are ignored, whatever their names, and pass through ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices, stash

BITS = 18
MAX_ROWS = 6000
#: Words in a gram of marks of repeated words; their features follow the hashed ones.
MARKS = 3
SIZE = (1 << BITS) + (1 << MARKS)
#: Features of all rows that train, at most: 4 bytes each reach the driver.
MAX_FEATURES = 96 << 20


def features(text: str | None, seen: np.ndarray) -> np.ndarray:
    """Distinct feature numbers of a text. ``seen``: scratch space of SIZE integers."""
    raw = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint32)
    grams = np.zeros(0, np.uint32)
    if len(raw) > 2:
        grams = ((raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        at = np.arange(len(grams))
        seen[grams] = at
        grams = grams[seen[grams] == at]
    words = (text or "").split()
    if len(words) > MARKS:
        again = np.fromiter((a == b for a, b in zip(words, words[1:], strict=False)), np.uint32, len(words) - 1)
        marks = sum(again[n : len(again) - MARKS + 1 + n] << np.uint32(n) for n in range(MARKS))
        grams = np.concatenate([grams, np.flatnonzero(np.bincount(marks)).astype(np.uint32) + np.uint32(1 << BITS)])
    return grams


@dataclass
class NbSvm:
    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> float:
        margin = float(self.weights[found].sum()) + self.offset
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 12, smooth: float = 1.0, seed: int = 7) -> NbSvm:
    """Hinge loss, dual coordinate descent over indicators scaled by log-count ratios."""
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    share = float((y > 0).mean()) if len(y) else 1.0
    if share in (0.0, 1.0):
        return NbSvm(np.zeros(SIZE), 0.0, 0.0, 30.0 if share else -30.0)
    count = {s: smooth + np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t == s] or [np.zeros(0, np.uint32)]).astype(np.int64), minlength=SIZE) for s in (1.0, -1.0)}
    ratio = np.log(count[1.0] / count[1.0].sum()) - np.log(count[-1.0] / count[-1.0].sum())
    w, offset, alpha = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    norms = np.array([float((ratio[r] ** 2).sum()) + 1.0 for r in rows])
    # classes weigh the same together
    caps = np.where(y > 0, cost * len(y) / (2 * (y > 0).sum()), cost * len(y) / (2 * (y < 0).sum())) / 100
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            x = ratio[r]
            gradient = y[i] * (float(w[r] @ x) + offset) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), caps[i])
            if step := (new - alpha[i]) * y[i]:
                w[r] += step * x
                offset += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-6:
            break
    weights = w * ratio
    margins = np.array([float(weights[r].sum()) for r in rows]) + offset
    slope, shift = _logistic(margins, y)
    return NbSvm(weights, offset, slope, shift)


def _logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve from margins to probabilities, with targets held off 0 and 1."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * (a - 1), (p - target).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margins**2).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = max(1e-3, a - np.clip(step[0], -1, 1)), b - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def held_out(id_col: str = "doc_id", parts: int = 5, part: int = 0) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> NbSvm:
    """Fit on the ``max_rows`` labelled rows, held-out ones excluded, whose ids hash lowest."""
    bound_batches(docs.sparkSession)
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    marked = marked.where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # only ids that docs still has, since a stage before may have removed some: those of lowest hash are looked up first
    hashed, n, factor = F.xxhash64("doc_id"), marked.count(), 4
    while True:
        share = factor * max_rows / max(n, 1)
        near = marked if share >= 1 else marked.where(hashed <= int(share * 2.0**64) - (1 << 63))
        near = F.broadcast(near) if factor == 4 else near  # 4 * max_rows rows, or about as many
        there = rows.select("doc_id").join(near, "doc_id").select("doc_id", "label").distinct()
        chosen = there.orderBy(hashed, "doc_id").limit(max_rows)
        if share >= 1 or chosen.count() == max_rows:
            break
        factor *= 16
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SIZE, np.int64)
        for batch in slices(batches):
            found = [features(t, seen) for t in batch.column(2).to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "label", "found"])

    # max_rows rows, one text for each: an id that stands on many rows trains by its last text in order
    texts = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))
    found = stash(texts.mapInArrow(gather, "doc_id long, label int, found array<int>"), "training")
    # in the same order, as many rows as the bound of features allows
    places = sorted((tuple(r) for r in found.select(hashed, "doc_id", F.size("found")).collect()))  # max_rows rows
    n_within = max(1, int((np.cumsum([p[2] for p in places]) <= MAX_FEATURES).sum()))
    if n_within < len(places):
        found = found.where(F.struct(hashed, "doc_id") <= F.struct(*(F.lit(x).cast("long") for x in places[n_within - 1][:2])))
    got = found.toArrow().sort_by("doc_id")
    parts = [np.asarray(x.values, np.uint32) for chunk in got["found"].chunks for x in chunk]  # views of Arrow's buffers
    return fit(parts, got["label"].to_numpy())


def scorer(model: NbSvm) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: adds ``quality_score`` to batches that have a ``text`` column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SIZE, np.int64)
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            scores = [model.score(features(t, seen)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if i != at), pa.array(scores, pa.float64())], names=[*(n for i, n in enumerate(batch.schema.names) if i != at), "quality_score"])

    return run


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that score ``threshold`` or more."""
    model = train(docs, labels, max_rows, id_col, text_col, label_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SIZE, np.int64)
        for batch in slices(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([model.score(features(t, seen)) >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    model = train(docs, labels, max_rows, id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(scorer(model), "doc_id long, held_out boolean, quality_score double")
    return scored.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
