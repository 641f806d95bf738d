"""Whole-text encoding with a ``tokenizers`` file through tables of words.

The word-level BPE file drops white space and no pre-token crosses it, so a text's ids are the ids of its chunks in
order, and those of a chunk of plain letters are the ids of its words. The distinct chunks of a batch are cut into words at once.
Each worker keeps two bounded tables word -> ids, the words met lately and those before, and the library is asked only for words
that are in neither, for all of a batch at once. Files with another layout are encoded text by text.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of each of a worker's two tables (some 150 bytes each).
TABLE_ENTRIES = 300_000

# The file's split pattern and normalisers, and the same pattern over the characters of the fast path.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
LEARNT = 1 << 14
#: Bytes of lower-case letters up to ÿ that do not stand for themselves.
SHOWN_ELSE = (0x9F, 0xA0, 0xAD)
#: Stands for a chunk of other letters; no plain one holds it.
ODD = "\0"
#: Stands behind the ids of each chunk; no id is so large.
CUT = np.uint32(0xFFFFFFFF)
SIMPLE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\na-z0-9ß-öø-ÿ]+|\n"

_simple = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
_pieces = re.compile(SIMPLE_SPLIT).findall


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


class WordBpe:
    """Ids of whole texts, equal to the library's ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_chunk = steps[0].get("pattern") == {"Regex": SPLIT} and (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS and spec.get("post_processor") is None
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.bytes_as = byte_alphabet()
        self.bare = Tokenizer(self.library.model)  # for words that are split and mapped already
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        mark = self.bare.encode(self.bytes_as[0]).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of words of plain letters, LEARNT in a library call, each followed by a mark, which no such word holds."""
        if len(words) > LEARNT:  # the library takes some 150 bytes for each id
            return [ids for at in range(0, len(words), LEARNT) for ids in self._learn(words[at : at + LEARNT])]
        shown = " \n ".join([*words, ""])
        if not shown.isascii():
            shown = shown.encode().decode("latin-1")
            for b in SHOWN_ELSE:
                shown = shown.replace(chr(b), self.bytes_as[b])
        ids = np.array(self.bare.encode_batch_fast([shown.replace("\n", self.bytes_as[0])])[0].ids, "<u4")
        raw, stops = ids.tobytes(), (4 * np.flatnonzero(ids == self.mark)).tolist()
        return [raw[a:b] for a, b in zip([0, *(x + 4 for x in stops[:-1])], stops, strict=True)]

    def _meet(self, words: set[str]) -> None:
        """Put the ids of words into the younger table. What was met lately is in two: the younger becomes the older one when it is full."""
        if len(self.young) > TABLE_ENTRIES:
            self.young, self.old = {}, self.young
        new = words.difference(self.young)
        known = {w: ids for w in new if (ids := self.old.get(w)) is not None}
        self.young.update(known)
        if unknown := list(new.difference(known)):
            self.young.update(zip(unknown, self._learn(unknown), strict=True))

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, end of each chunk in them)"""
        plain = list(map(bool, map(_simple, chunks))) if self.mark is not None else [False] * len(chunks)
        whole = "\n".join(chunks)
        if special := [s for s in self.special if s in whole]:
            plain = [p and not any(s in c for s in special) for p, c in zip(plain, chunks, strict=True)]
        odd = [] if all(plain) else [c for p, c in zip(plain, chunks, strict=True) if not p]
        if odd:
            whole = "\n".join([c if p else ODD for p, c in zip(plain, chunks, strict=True)])
        self.young["\n"], self.young[ODD] = CUT.tobytes(), b""  # stand behind each chunk, and for one of other letters
        flat = _pieces(f"{whole}\n".lower()) if chunks else []
        self._meet(set(flat))
        parts = map(self.young.__getitem__, flat)
        if odd:
            parts = list(parts)
            if len(self.odd) > TABLE_ENTRIES:
                self.odd.clear()
            for c in odd:
                if c not in self.odd:
                    self.odd[c] = np.array(self.library.encode(c, add_special_tokens=False).ids, "<u4").tobytes()
            for n, c in zip((n for n, w in enumerate(flat) if w == ODD), odd, strict=True):
                parts[n] = self.odd[c]
        found = np.frombuffer(b"".join(parts), "<u4")
        cut = found == CUT
        ends = np.flatnonzero(cut)
        return found[~cut], ends - np.arange(len(ends))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text in them); null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_chunk:
            found = [np.array(x.ids, "<u4") for x in self.library.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<u4"), *found]), np.cumsum([len(x) for x in found], dtype=np.int64)
        lists = pc.ascii_split_whitespace(texts)  # ASCII white space only; other white space stays in its chunk
        coded = pc.list_flatten(lists).dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        flat, stops = self._chunks(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = coded.indices.to_numpy(zero_copy_only=False)
        sizes = np.diff(stops, prepend=0)[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if total < 1 << 31 and len(flat) < 1 << 31 else np.int64
        first = np.concatenate([[0], stops[:-1]])[at] if total else ends
        ids = flat[np.repeat((first - ends + sizes).astype(kind), sizes) + np.arange(total, dtype=kind)]
        per_text = lists.offsets.to_numpy()[1:] - lists.offsets.to_numpy()[0]
        return ids, np.concatenate([[0], ends])[per_text]


def with_ends(ids: np.ndarray, ends: np.ndarray, end_id: int) -> np.ndarray:
    """Little-endian ids with the end id behind each text."""
    out = np.full(len(ids) + len(ends), end_id, "<u4")
    own = np.ones(len(out), bool)
    own[ends + np.arange(len(ends))] = False
    if len(ids):
        np.place(out, own, ids)
    return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    """One encoder for each worker process and file."""
    return WordBpe(path)
