"""Token shards as wavelet matrices: succinct bit-planes with rank and select, one compressed file per shard.

A shard holds the ids of neighbouring documents in ``doc_id`` order. Level by level, from the highest bit, the plane of
that bit is stored and the ids are split stably by it, zeros first. Planes are cut into frames of ``FRAME`` words, each
compressed by itself; the directory holds the zeros of each plane, the ones before each frame, and where frames lie.
``access``, ``count`` (rank) and ``occurrence`` (select) read the directory and one or two frames for each plane, whatever
the shard's size. File: magic, header (counts, planes, frame words, compressed sizes), directory, document lengths and
ids, frames; each section compressed with zstandard.

``access_tokens``, ``count_tokens`` and ``find_occurrences`` look up many positions and tokens in all shards of a manifest.

Files are written and read by the tasks through Arrow's file systems (local, hdfs, s3, gcs, abfs; ``s3a`` and ``s3n``
are read as ``s3``), because no Spark writer has a format of one's own.

Nulls and edge cases: a null or empty text is a document of the end id alone; null ``doc_id`` sorts first; repeated
rows keep their own entries (ties in ``doc_id`` are ordered by text); a very long text is encoded whole and may make its
shard larger; an empty table writes nothing; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, fresh_path, slices, stash
from .wordbpe import encoder, with_ends

MAGIC = b"SFWM0002"
HEADER = "<QQIIQQQ"  # documents, ids, planes, words of a frame, then compressed bytes of directory, lengths, doc ids
SHARD_IDS = 1 << 21
FRAME = 1 << 10  # 64-bit words of a frame
MANIFEST = pa.schema([("path", pa.string()), ("range", pa.int32()), ("place", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()), ("within", pa.int64())])
NO_ID = -(1 << 63)  # stands for a null doc_id inside a shard


def _narrow(planes: int) -> type:
    """The smallest type that holds ids of so many bits."""
    return np.uint16 if planes <= 16 else np.uint32


@dataclass
class WaveletMatrix:
    """Bit-planes over ``size`` ids. ``words[k]``: plane k in 64-bit words, bit i of the plane at word i // 64."""

    size: int
    zeros: np.ndarray
    words: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        width = -(-len(ids) // 64)
        words, zeros, now = np.zeros((planes, width), "<u8"), np.zeros(planes, "<i8"), ids.astype(_narrow(planes))
        for k in range(planes):
            bit = now & now.dtype.type(1 << (planes - 1 - k)) != 0
            packed = np.packbits(bit, bitorder="little")
            words[k].view(np.uint8)[: len(packed)] = packed
            low = np.compress(~bit, now)
            zeros[k] = len(low)
            now = np.concatenate([low, np.compress(bit, now)])
        return cls(len(ids), zeros, words)

    def _bits(self, k: int) -> np.ndarray:
        return np.unpackbits(self.words[k].view(np.uint8), bitorder="little", count=self.size).astype(bool)

    def _ones(self) -> np.ndarray:
        """Ones before each word, by plane: the rank directory."""
        if not hasattr(self, "_directory"):
            counts = np.bitwise_count(self.words).astype(np.int64)
            self._directory = np.concatenate([np.zeros((len(counts), 1), np.int64), np.cumsum(counts, 1)], 1)
        return self._directory

    def rank1(self, k: int, i: np.ndarray | int) -> np.ndarray:
        """Ones in the first ``i`` bits of plane k."""
        i = np.asarray(i, np.int64)
        word, rest = i // 64, (i % 64).astype(np.uint64)
        part = np.append(self.words[k], np.uint64(0))[word] & ((np.uint64(1) << rest) - np.uint64(1))
        return self._ones()[k][word] + np.bitwise_count(part)

    def access(self, i: np.ndarray | int) -> np.ndarray:
        """Ids at positions ``i``."""
        i = np.asarray(i, np.int64)
        out = np.zeros(i.shape, np.uint32)
        for k in range(len(self.words)):
            bit = (self.words[k][i // 64] >> (i % 64).astype(np.uint64)) & np.uint64(1) == 1
            ones = self.rank1(k, i)
            out = (out << np.uint32(1)) | bit
            i = np.where(bit, self.zeros[k] + ones, i - ones)
        return out

    def _range(self, value: int, start: int, stop: int) -> tuple[int, int]:
        planes = len(self.words)
        if value >> planes:
            return 0, 0
        for k in range(planes):
            a, b = (int(x) for x in self.rank1(k, np.array([start, stop])))
            start, stop = (int(self.zeros[k]) + a, int(self.zeros[k]) + b) if value >> (planes - 1 - k) & 1 else (start - a, stop - b)
        return start, stop

    def count(self, value: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of ``value`` at positions start to stop."""
        a, b = self._range(value, start, self.size if stop is None else stop)
        return b - a

    def occurrence(self, value: int, n: int) -> int:
        """Position of the n-th (from 0) occurrence of ``value``, or -1."""
        first, last = self._range(value, 0, self.size)
        if not 0 <= n < last - first:
            return -1
        i = first + n
        for k in reversed(range(len(self.words))):
            one = i >= self.zeros[k]
            i = self._select(k, i - int(self.zeros[k]) if one else i, bool(one))
        return i

    def _select(self, k: int, n: int, one: bool) -> int:
        before = self._ones()[k] if one else np.arange(self.words.shape[1] + 1) * 64 - self._ones()[k]
        word = int(np.searchsorted(before, n, "right")) - 1
        bits = np.unpackbits(self.words[k][word : word + 1].view(np.uint8), bitorder="little") == one
        return word * 64 + int(np.flatnonzero(bits)[n - before[word]])

    def decode(self) -> np.ndarray:
        """All ids: the splits undone from the lowest plane up."""
        now = np.zeros(self.size, _narrow(len(self.words)))
        for k in reversed(range(len(self.words))):
            now[self.zeros[k] :] |= now.dtype.type(1 << (len(self.words) - 1 - k))
            up, bit = np.empty_like(now), self._bits(k)
            # zeros come first, then ones; place() repeats what is too short, so none is given where there is none
            for where, part in ((~bit, now[: self.zeros[k]]), (bit, now[self.zeros[k] :])):
                if len(part):
                    np.place(up, where, part)
            now = up
        return now.astype(np.uint32)


def _frames(width: int, frame: int) -> int:
    return -(-width // frame)


def dump(docs: np.ndarray, lengths: np.ndarray, matrix: WaveletMatrix, frame: int = FRAME) -> bytes:
    pack = zstandard.ZstdCompressor(level=1).compress
    planes, width = matrix.words.shape
    starts = range(0, width, frame)
    parts = [pack(np.ascontiguousarray(matrix.words[k, a : a + frame]).tobytes()) for k in range(planes) for a in starts]
    ones = matrix._ones()[:, [*starts]] if width else np.zeros((planes, 0), np.int64)
    directory = np.concatenate([matrix.zeros, ones.ravel(), np.cumsum([0, *map(len, parts)])]).astype("<i8")
    front = [pack(x.tobytes()) for x in (directory, lengths.astype("<u4"), docs.astype("<i8"))]
    return MAGIC + struct.pack(HEADER, len(docs), matrix.size, planes, frame, *map(len, front)) + b"".join([*front, *parts])


class ShardFile:
    """A shard that is read as far as it is needed. ``fetch(start, size)`` gives bytes of the file; ``fetched`` counts them."""

    def __init__(self, fetch: Callable[[int, int], bytes]) -> None:
        self._fetch, self.fetched = fetch, 0
        head = self._read(0, 8 + struct.calcsize(HEADER))
        if head[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        self.documents, self.size, self.planes, self.frame, n_dir, self._n_lengths, self._n_docs = struct.unpack_from(HEADER, head, 8)
        self._front = len(head) + n_dir
        directory = np.frombuffer(_unpack(self._read(len(head), n_dir)), "<i8")
        self.width = -(-self.size // 64)
        n = _frames(self.width, self.frame)
        self.zeros, self._before = directory[: self.planes], directory[self.planes : self.planes * (1 + n)].reshape(self.planes, n)
        self._at = directory[self.planes * (1 + n) :] + self._front + self._n_lengths + self._n_docs
        self._held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def _read(self, start: int, size: int) -> bytes:
        self.fetched += size
        return self._fetch(start, size)

    def lengths(self) -> np.ndarray:
        return np.frombuffer(_unpack(self._read(self._front, self._n_lengths)), "<u4")

    def docs(self) -> np.ndarray:
        return np.frombuffer(_unpack(self._read(self._front + self._n_lengths, self._n_docs)), "<i8")

    def _words(self, k: int, f: int) -> tuple[np.ndarray, np.ndarray]:
        """(words, ones before each word) of a frame; some frames are held."""
        found = self._held.get((k, f))
        if found is None:
            i = k * self._before.shape[1] + f
            words = np.frombuffer(_unpack(self._read(int(self._at[i]), int(self._at[i + 1] - self._at[i]))), "<u8")
            counts = np.cumsum(np.bitwise_count(words).astype(np.int64))
            if len(self._held) >= HELD_FRAMES:
                self._held.pop(next(iter(self._held)))
            found = self._held[k, f] = (np.append(words, np.uint64(0)), self._before[k, f] + np.concatenate([[0], counts]))
        return found

    def _look(self, k: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits at ``i``, ones before ``i``) in plane k; the place behind the last counts too."""
        bit, ones = np.zeros(len(i), bool), np.zeros(len(i), np.int64)
        word, rest = i // 64, (i % 64).astype(np.uint64)
        frame = np.minimum(word // self.frame, max(self._before.shape[1] - 1, 0))
        for f in np.unique(frame).tolist() if self.width else []:
            at = np.flatnonzero(frame == f)
            words, before = self._words(k, f)
            own, r = word[at] - f * self.frame, rest[at]
            bit[at] = (words[own] >> r) & np.uint64(1) == 1
            ones[at] = before[own] + np.bitwise_count(words[own] & ((np.uint64(1) << r) - np.uint64(1)))
        return bit, ones

    def access(self, i: np.ndarray) -> np.ndarray:
        """Ids at positions ``i``."""
        i, out = np.asarray(i, np.int64), np.zeros(len(i), np.uint32)
        for k in range(self.planes):
            bit, ones = self._look(k, i)
            out = (out << np.uint32(1)) | bit
            i = np.where(bit, self.zeros[k] + ones, i - ones)
        return out

    def span(self, value: int, start: int = 0, stop: int | None = None) -> tuple[int, int]:
        """Where the occurrences of ``value`` at positions start to stop lie behind the lowest plane."""
        ends = np.array([start, self.size if stop is None else stop], np.int64)
        if value < 0 or value >> self.planes:
            return 0, 0
        for k in range(self.planes):
            ones = self._look(k, ends)[1]
            ends = self.zeros[k] + ones if value >> (self.planes - 1 - k) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, value: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of ``value`` at positions start to stop."""
        a, b = self.span(value, start, stop)
        return b - a

    def occurrence(self, value: int, n: int) -> int:
        """Position of the n-th (from 0) occurrence of ``value``, or -1."""
        first, last = self.span(value)
        if not 0 <= n < last - first:
            return -1
        i = first + n
        for k in reversed(range(self.planes)):
            one = i >= self.zeros[k]
            i = self._select(k, i - int(self.zeros[k]) if one else i, bool(one))
        return i

    def _select(self, k: int, n: int, one: bool) -> int:
        """Position of the n-th one (zero) of plane k: its frame by the directory, its word by the frame."""
        before = self._before[k]
        ahead = before if one else np.arange(len(before)) * 64 * self.frame - before
        f = int(np.searchsorted(ahead, n, "right")) - 1
        words, ones = self._words(k, f)
        inner = ones if one else np.arange(f * self.frame, f * self.frame + len(ones)) * 64 - ones
        w = int(np.searchsorted(inner, n, "right")) - 1
        bits = np.unpackbits(words[w : w + 1].view(np.uint8), bitorder="little") == one
        return (f * self.frame + w) * 64 + int(np.flatnonzero(bits)[n - inner[w]])

    def matrix(self) -> WaveletMatrix:
        """The whole shard in memory."""
        rows = [np.concatenate([np.zeros(0, "<u8"), *(self._words(k, f)[0][:-1] for f in range(self._before.shape[1]))]) for k in range(self.planes)]
        return WaveletMatrix(self.size, self.zeros, np.stack(rows))


#: Frames of a shard that a lookup keeps in memory.
HELD_FRAMES = 256


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def in_memory(data: bytes) -> ShardFile:
    return ShardFile(lambda start, size: data[start : start + size])


def load(data: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """(doc ids, lengths, wavelet matrix) of a shard file's bytes."""
    shard = in_memory(data)
    docs, lengths = shard.docs(), shard.lengths()
    if len(docs) != shard.documents:
        raise ValueError("damaged wavelet shard")
    return docs, lengths, shard.matrix()


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    scheme, mark, rest = path.partition("://")
    return pa.fs.FileSystem.from_uri(f"s3://{rest}" if mark and scheme in ("s3a", "s3n") else path)


def write_file(path: str, data: bytes) -> None:
    """Write under another name and move into place, so that a retried task leaves a whole file or none."""
    fs, name = _file_system(path)
    fs.create_dir(name.rpartition("/")[0])
    with fs.open_output_stream(temporary := f"{name}.{uuid.uuid4().hex}") as f:
        f.write(data)
    fs.move(temporary, name)


def read_file(path: str) -> bytes:
    fs, name = _file_system(path)
    with fs.open_input_stream(name) as f:
        return f.read()


def open_shard(path: str) -> ShardFile:
    """A shard file of which only what is asked for is read."""
    fs, name = _file_system(path)
    return ShardFile(lambda start, size, f=fs.open_input_file(name): f.read_at(size, start))


def write_shards(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 1, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode documents into shard files in ``doc_id`` order; the manifest (one row per file) says what is where.

    Manifest: path, range (number of the doc_id range), place (of the file in it), docs, ids, start (ids before it).
    """
    bound_batches(docs.sparkSession)
    folder = folder or fresh_path(docs.sparkSession, "wavelet")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        names: list[int] = []
        lengths: list[int] = []
        place = within = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal place, within, size, held, names, lengths
            ids = np.concatenate(held)
            name = f"{folder}/range-{part:06d}/{place:06d}.wvm"
            write_file(name, dump(np.array(names, np.int64), np.array(lengths, np.int64), WaveletMatrix.build(ids)))
            row = pa.RecordBatch.from_pylist([{"path": name, "range": part, "place": place, "docs": len(names), "ids": len(ids), "within": within}], MANIFEST)
            place, within, size, held, names, lengths = place + 1, within + len(ids), 0, [], [], []
            return row

        for batch in slices(batches):
            ids, ends = encoder(path).encode(batch.column(1))
            begins = np.concatenate([[0], ends[:-1]])
            # the end id goes behind each document
            whole = with_ends(ids, ends, end_id)
            held.append(whole)
            names += [NO_ID if x is None else x for x in batch.column(0).to_pylist()]
            lengths += (ends - begins + 1).tolist()
            size += len(whole)
            if size >= shard_ids:
                yield flush()
        if names:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = stash(ordered.mapInArrow(write, "path string, range int, place int, docs long, ids long, within long"), "manifest")
    # one row per range, then a prefix sum over them: the ranges are as many as shuffle partitions
    ranges = files.groupBy("range").agg(F.sum("ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    begin = ranges.select("range", F.coalesce(before, F.lit(0)).alias("begin"))
    return files.join(F.broadcast(begin), "range").select("path", "range", "place", "docs", "ids", (F.col("begin") + F.col("within")).alias("start"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of a manifest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs, lengths, matrix = load(read_file(path))
                raw, ends = memoryview(matrix.decode().astype("<u4").tobytes()), np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=docs == NO_ID), pa.array(begin + starts, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a stated number of partitions: the manifest is small, but its files are not, and they must not fall to one task
    files = manifest.select("path", "start").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _by_file(rows: DataFrame) -> DataFrame:
    """Rows with a path, those of one file together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").sortWithinPartitions("path")


def access_tokens(manifest: DataFrame, positions: DataFrame, column: str = "position") -> DataFrame:
    """position, token at each of ``positions`` (places in the ids of all documents); places beyond the last give no row.

    A file covers few stretches of SHARD_IDS places; positions find their file by the stretch they lie in.
    """
    bucket = lambda c: F.floor(c / SHARD_IDS)
    files = manifest.select("path", "start", (F.col("start") + F.col("ids")).alias("stop")).withColumn("bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("stop") - 1))))
    asked = positions.select(F.col(column).cast("long").alias("position")).distinct().withColumn("bucket", bucket(F.col("position")))
    met = asked.join(files, "bucket").where((F.col("position") >= F.col("start")) & (F.col("position") < F.col("stop"))).select("path", "start", "position")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, shard = None, None
        for batch in batches:
            names, places = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            begin, out = batch.column(1).to_numpy(), np.zeros(len(names), np.int64)
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    if names[a] != path:
                        path, shard = names[a], open_shard(names[a])
                    out[a:b] = shard.access(places[a:b] - begin[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out)], names=["position", "token"])

    return _by_file(met).mapInArrow(look, "position long, token long")


#: Tokens of one lookup at most: they go to every shard.
MOST_TOKENS = 10_000


def _counts(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """path, start, token, n of every file that holds the token."""
    if len(set(tokens)) > MOST_TOKENS:
        raise ValueError(f"more than {MOST_TOKENS} tokens")
    wanted = sorted(set(tokens))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = open_shard(path)
                found = [(path, start, t, n) for t in wanted if (n := shard.count(t))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["path", "start", "token", "n"])

    return _by_file(manifest.select("path", "start")).mapInArrow(count, "path string, start long, token long, n long")


def count_tokens(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """token, n: occurrences of each of ``tokens`` in all documents; those that do not occur give no row."""
    return _counts(manifest, tokens).groupBy("token").agg(F.sum("n").alias("n"))


def find_occurrences(manifest: DataFrame, wanted: list[tuple[int, int]]) -> DataFrame:
    """token, n, position of the n-th (from 0) occurrence of a token in all documents, for each (token, n); there may be none.

    Counts by file tell which file holds it: a prefix sum over the files for each token.
    """
    spark = manifest.sparkSession
    counts = _counts(manifest, [t for t, _ in wanted])
    before = F.sum("n").over(Window.partitionBy("token").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    ranged = counts.select("path", "start", "token", F.coalesce(before, F.lit(0)).alias("lo"), "n").withColumn("hi", F.col("lo") + F.col("n")).drop("n")
    asked = spark.createDataFrame(sorted(set(wanted)), "token long, n long")
    met = ranged.join(F.broadcast(asked), "token").where((F.col("n") >= F.col("lo")) & (F.col("n") < F.col("hi"))).select("path", "start", "token", "n", (F.col("n") - F.col("lo")).alias("place"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [open_shard(path).occurrence(t, i) + start for path, start, t, i in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(at, pa.int64())], names=["token", "n", "position"])

    return _by_file(met).mapInArrow(find, "token long, n long, position long")
