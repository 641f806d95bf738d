"""SentencePiece encoding and decoding through a table of distinct marked words.

The model marks white space with U+2581. If no piece has a mark behind another character, no piece crosses the start
of a marked word, so the pieces of a text are the pieces of its marked words in order. Each distinct marked word of a
batch is segmented once (a bounded table keeps it for later batches), and ids are joined back by position. A model with
other pieces or another normaliser is used text by text. Decoding is the library's, over all ids of a document.

Nulls and edge cases: a null text counts as empty and gives the begin and end ids alone; rows are independent of one
another, so repeated rows give equal results; where segmentations tie, the library's own choice holds, since it cuts each word;
a very long text is a batch of its own and is encoded whole; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices

MARK = "▁"
TABLE_ENTRIES = 500_000


class PieceTable:
    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        norm = model.normalizer_spec
        self.by_word = (
            norm.add_dummy_prefix
            and norm.escape_whitespaces
            and not norm.remove_extra_whitespaces
            and not norm.precompiled_charsmap
            and not model.trainer_spec.treat_whitespace_as_suffix
            and not any(MARK in p.piece.lstrip(MARK) for p in model.pieces)
            and not any(p.type == 4 for p in model.pieces)  # user-defined pieces are matched before all others
        )
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.words: dict[str, bytes] = {}
        self.lone_mark = np.array([self.library.piece_to_id(MARK)], "<u4").tobytes()

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, without begin and end ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_word:
            return [np.array(x, "<u4") for x in self.library.encode(texts.to_pylist(), num_threads=1)]
        if len(self.words) > TABLE_ENTRIES:
            self.words.clear()
        # the library puts a mark before the text; behind it, words are cut at single marks
        marked = pc.replace_substring(texts, MARK, " ")
        lists = pc.split_pattern(marked, " ")
        parts = pc.list_flatten(lists)
        coded = parts.dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.words
        found = list(map(known.get, distinct))
        if new := [w for w, ids in zip(distinct, found, strict=True) if ids is None]:
            for word, ids in zip(new, self.library.encode(new, num_threads=1), strict=True):
                known[word] = np.array(ids, "<u4").tobytes()
            found = list(map(known.__getitem__, distinct))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        at = coded.indices.to_numpy(zero_copy_only=False)
        counts = sizes[at]
        ends = np.cumsum(counts)
        starts = np.cumsum(sizes) - sizes
        ids = flat[np.repeat(starts[at] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]]
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        runs = pc.or_(pc.or_(pc.match_substring(marked, "  "), pc.starts_with(marked, " ")), pc.ends_with(marked, " "))
        for i in np.flatnonzero(runs.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._with_runs(marked[i].as_py())
        return out

    def _with_runs(self, text: str) -> np.ndarray:
        """For texts in which marks stand together or at an end: a run of marks belongs to the word behind it."""
        found = []
        for word in re.findall(" +[^ ]*", f" {text}"):
            key = word[1:]  # the library adds the first mark itself, but none to an empty text
            if key and key not in self.words:
                self.words[key] = np.array(self.library.encode(key), "<u4").tobytes()
            found.append(self.words[key] if key else self.lone_mark)
        return np.frombuffer(b"".join(found), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


@lru_cache(maxsize=2)
def table(path: str) -> PieceTable:
    """One table for each worker process and file."""
    return PieceTable(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (with begin and end id) of every whole text."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = table(path)
        for batch in slices(batches):
            rows = [np.concatenate([[model.bos], x, [model.eos]]).astype(np.int32) for x in model.encode(batch.column(1))]
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rows])]), pa.int32()), pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text decoded from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = table(path)
        for batch in batches:
            texts = [model.library.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, keeping digests only."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = table(path)
        for batch in slices(batches):
            rows = [np.concatenate([[model.bos], x, [model.eos]]).astype("<u4") for x in model.encode(batch.column(1))]
            sha = [hashlib.sha256(x.tobytes()).hexdigest() for x in rows]
            back = [hashlib.sha256(model.decode(x).encode()).hexdigest() for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in rows], pa.int64()), pa.array(sha), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
