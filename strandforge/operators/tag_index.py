"""Approximate search for a whole library of tags: a multi-pattern index of seeds, then bit-parallel mismatch counts.

A tag of length n may differ in m places, so one of m + 1 disjoint seeds must occur exactly. Seeds of all tags are indexed by
length as packed codes; one pass over a text per seed length finds their places. Each place proposes a start for its
tag, and a proposed window is compared 64 symbols at a time: the symbols' codes lie in bit planes, a window's words are
cut from the planes at any offset, exclusive ors with the tag's words mark the places that differ, and their bits are
counted. A window is given up as soon as it differs in too many places.

A library is small and fixed: the index travels with the tasks. Texts may be of any length; STEP symbols are searched at a
time, with the overlap that a hit at their end needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbols of texts searched at a time; windows compared at a time; bits of the table that rules out most places of a text.
STEP, WINDOWS, FILTER = 1 << 20, 1 << 16, 16
HASH = np.uint64(0x9E3779B97F4A7C15)


def most_mismatches(n: int, cutoff: float) -> int:
    """Places in which a window may differ from a tag of ``n`` symbols to be alike to ``cutoff`` percent, rounded to two digits."""
    m = int(n * (100 - cutoff) / 100 + 1e-9)
    while m < n and round(100 * (n - m - 1) / n, 2) >= cutoff:
        m += 1
    return m


def seeds_of(n: int, mismatches: int) -> list[tuple[int, int]]:
    """(begin, end) of the disjoint seeds of a tag."""
    parts = min(mismatches + 1, n)
    return [(i * n // parts, (i + 1) * n // parts) for i in range(parts)]


@dataclass(frozen=True)
class Seeds:
    """Seeds of one length: sorted codes, and the tags and offsets of each from ``starts`` on."""

    codes: np.ndarray
    starts: np.ndarray
    tag: np.ndarray
    offset: np.ndarray
    table: np.ndarray


class TagIndex:
    """Tags and their seeds; symbols that no tag has are 0."""

    def __init__(self, tags: list[str], cutoff: float) -> None:
        letters = sorted(set("".join(tags)))
        if any(ord(c) > 255 for c in letters):
            raise ValueError("symbols of tags are of one byte")
        self.bits = max(1, len(letters).bit_length())
        self.codes = np.zeros(256, np.uint8)
        self.codes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.lengths = np.array([len(t) for t in tags], np.int64)
        self.most = [most_mismatches(len(t), cutoff) for t in tags]
        own = [self.coded(t) for t in tags]
        self.words = [self.planes(c)[:, : -(-len(c) // 64)] for c in own]
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i, (c, m) in enumerate(zip(own, self.most, strict=True)):
            for a, b in seeds_of(len(c), m):
                size = min(b - a, 63 // self.bits)  # what fits a code; the rest is compared with the window
                if size:
                    found.setdefault(size, []).append((int(self.packed(c[a : a + size], size)[0]), i, a))
        self.seeds = {size: self._seeds(rows) for size, rows in sorted(found.items())}

    def _seeds(self, rows: list[tuple[int, int, int]]) -> Seeds:
        code, tag, offset = (np.array(x) for x in zip(*sorted(rows), strict=True))
        codes, starts = np.unique(code.astype(np.uint64), return_index=True)
        table = np.zeros(1 << FILTER, bool)
        table[codes * HASH >> np.uint64(64 - FILTER)] = True
        return Seeds(codes, np.append(starts, len(code)), tag, offset, table)

    def coded(self, text: str) -> np.ndarray:
        return self.codes[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]

    def packed(self, codes: np.ndarray, size: int) -> np.ndarray:
        """Code of each window of ``size`` symbols, from those of half the size."""
        if size == 1:
            return codes.astype(np.uint64)
        half = self.packed(codes, size // 2)
        n = len(codes) - size + 1
        out = half[:n] << np.uint64(self.bits * (size // 2)) | half[size // 2 :][:n]
        return out if size % 2 == 0 else out << np.uint64(self.bits) | codes[size - 1 :][:n]

    def planes(self, codes: np.ndarray) -> np.ndarray:
        """The codes' bits, a row of 64-bit words for each, and two words more than needed."""
        n = 8 * (-(-len(codes) // 64) + 2)
        out = np.zeros((self.bits, n), np.uint8)
        for b in range(self.bits):
            packed = np.packbits(codes >> b & 1, bitorder="little")
            out[b, : len(packed)] = packed
        return out.view("<u8").astype(np.uint64)

    def proposed(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tag, start) that a seed proposes, each once; starts may lie outside of the text."""
        tags, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, s in self.seeds.items():
            if len(codes) < size:
                continue
            window = self.packed(codes, size)
            at = np.flatnonzero(s.table[window * HASH >> np.uint64(64 - FILTER)])
            place = np.minimum(np.searchsorted(s.codes, window[at]), len(s.codes) - 1)
            same = s.codes[place] == window[at]
            at, place = at[same], place[same]
            n = s.starts[place + 1] - s.starts[place]
            row = np.repeat(s.starts[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            tags.append(s.tag[row])
            starts.append(np.repeat(at, n) - s.offset[row])
        tag, start = np.concatenate(tags), np.concatenate(starts)
        both = np.unique(np.stack([tag, start], 1), axis=0)
        return both[:, 0], both[:, 1]

    def mismatches(self, planes: np.ndarray, tag: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, places that differ) of the windows that are alike enough."""
        words, n = self.words[tag], int(self.lengths[tag])
        count = np.zeros(len(starts), np.int64)
        for w in range(words.shape[1]):
            at, shift = (starts >> 6) + w, (starts & 63).astype(np.uint64)
            apart = np.zeros(len(starts), np.uint64)
            for b in range(self.bits):
                apart |= (planes[b, at] >> shift | planes[b, at + 1] << np.uint64(1) << (np.uint64(63) - shift)) ^ words[b, w]
            if n - 64 * w < 64:
                apart &= np.uint64((1 << (n - 64 * w)) - 1)
            count += np.bitwise_count(apart)
            left = count <= self.most[tag]
            starts, count = starts[left], count[left]
        return starts, count

    def search(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, tag, start, places that differ) of all windows that are alike enough and lie within their text."""
        sizes = np.array([len(t or "") for t in texts], np.int64)
        ends = np.cumsum(sizes)
        codes = self.coded("".join(t or "" for t in texts))
        overlap = int(self.lengths.max(initial=1)) - 1
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        for begin in range(0, len(codes), STEP):
            part = codes[begin : begin + STEP + overlap]
            tag, start = self.proposed(part)
            text = np.searchsorted(ends, np.maximum(start, 0) + begin, "right")
            inside = (start >= 0) & (start < STEP) & (start + self.lengths[tag] <= len(part))
            inside &= begin + start + self.lengths[tag] <= ends[np.minimum(text, len(ends) - 1)]
            planes = self.planes(part)
            for t in np.unique(tag[inside]):
                own = start[inside & (tag == t)]
                for a in range(0, len(own), WINDOWS):
                    at, n = self.mismatches(planes, int(t), own[a : a + WINDOWS])
                    row = np.searchsorted(ends, at + begin, "right")
                    for column, values in zip(out, (row, np.full(len(at), t), at + begin - (ends[row] - sizes[row]), n), strict=True):
                        column.append(values)
        return tuple(np.concatenate(c) for c in out)


def library_windows(df: DataFrame, tags: list[str], key: str, seq: str, cutoff: float) -> DataFrame:
    """key, place (of the tag in ``tags``), start, same (places that agree), length (of the sequence) of every window that is a tag to ``cutoff`` percent."""
    index = TagIndex(tags, cutoff)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ends = np.cumsum([0, *(len(t or "") for t in texts)])
            at = 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(ends, ends[at] + STEP, "right")) - 1)
                row, tag, start, apart = index.search(texts[at:stop])
                row += at
                columns = [tag.astype(np.int32), start.astype(np.int32), (index.lengths[tag] - apart).astype(np.int32), np.diff(ends)[row].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *map(pa.array, columns)], names=[key, "place", "start", "same", "length"])
                at = stop

    return df.select(key, F.col(seq).cast("string").alias(seq)).mapInArrow(search, f"`{key}` {dict(df.dtypes)[key]}, place int, start int, same int, length int")
