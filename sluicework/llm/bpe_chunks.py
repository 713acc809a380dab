"""Exact byte-level BPE by reuse of content-defined chunks, and its decoding.

A text is cut where a rolling hash of the last bytes has certain zeros, so that texts with the same
passage get the same chunks whatever stands before them. A chunk is encoded once in a worker, and its
ids are reused wherever it comes back. A cut may fall inside a word; the join is then repaired by
encoding again from the last sure token border before it to the first one after it.

A border is sure between a character that is no white space and a white-space character: the
vocabulary's split pattern never matches across it, whatever stands further left or right. Pieces
between sure borders ("units", mostly a blank and a word) are kept as well, since most of a text
consists of units that came before. New units are encoded by tiktoken with the ranks of the same
vocabulary, where that is known to split like the tokenizers library: in Latin text, and if the ids of
the vocabulary follow its merges. All others are encoded by the tokenizers library itself.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .common import text_of

#: Average bytes of a chunk (a power of two) and the bytes that the rolling hash sees.
CHUNK = 1024
_SEEN = 16
#: What a worker keeps at most: units, and bytes of chunk texts. Both caches start anew when full.
UNITS = 300_000
CHUNK_BYTES = 24 << 20
_KEPT = 64

_UNIT = re.compile(r"\s*\S+|\s+")
#: White space to Python's patterns but not to the vocabulary's; a text with one is encoded whole.
_ODD = re.compile("[\x1c-\x1f]")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


#: How a byte-level vocabulary splits a text before it merges (a fixed value).
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Up to here the classes of characters are the same in all versions of Unicode.
_LATIN = "\u024f"


class Codec:
    """Encodes and decodes as the tokenizers library does, with reuse. `path`: a byte-level BPE file.

    `only_library` leaves the encoding of all units to the tokenizers library.
    """

    def __init__(self, path: str, chunk: int = CHUNK, units: int = UNITS, chunk_bytes: int = CHUNK_BYTES, only_library: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunk, self.max_units, self.max_bytes = chunk, units, chunk_bytes
        self.units: dict[str, bytes] = {}
        self.chunks: dict[bytes, tuple[str, bytes | None, str]] = {}
        self.held = 0
        self.reused = self.encoded = 0
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.table = [self._bytes_of(i) for i in range(size)]
        self.sizes = np.array([len(b) for b in self.table], np.int64)
        self.ranks = None if only_library else self._ranks()

    def _bytes_of(self, token: int) -> bytes:
        name = self.tokenizer.id_to_token(token)
        if name is None:
            return b""
        return name.encode() if name in self.special else bytes(map(_byte_of().__getitem__, name))

    def _ranks(self) -> tiktoken.Encoding | None:
        """The same vocabulary by ranks, if ids are ranks: single bytes first, then the merges in their order."""
        own = {b: i for i, b in enumerate(self.table) if b and self.tokenizer.id_to_token(i) not in self.special}
        if sorted(own.values()) != list(range(len(own))) or any(len(b) != 1 for b in self.table[:256]):
            return None
        ranks = tiktoken.Encoding("units", pat_str=_SPLIT, mergeable_ranks=own, special_tokens={})
        probe = [t for b in self.table[256::97] if not (t := b.decode("utf-8", "ignore")).isspace() and t]
        return ranks if all(ranks.encode_ordinary(t) == self.tokenizer.encode(t, add_special_tokens=False).ids for t in probe) else None

    def _raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        """The ids of those of `units` that aren't kept; short ones are kept from now on."""
        new = list({u for u in units if u not in self.units})
        if len(self.units) + len(new) > self.max_units:
            self.units = {}
            new = list(set(units))
        made, rest, apart = {}, [], []
        for unit in new:
            if self.ranks is not None and (unit.isascii() or max(unit) <= _LATIN):
                made[unit] = array("I", self.ranks.encode_ordinary(unit)).tobytes()
            elif unit[0].isspace() and not unit[-1].isspace():
                rest.append(unit)
            else:
                apart.append(unit)
        if rest:  # a sure border on both sides of each: one call for all, whose ids are dealt out by their bytes
            ids = np.array(self.tokenizer.encode("".join(rest), add_special_tokens=False).ids, "<u4")
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(u.encode()) for u in rest])) + 1
            for unit, a, b in zip(rest, [0, *ends.tolist()], ends.tolist()):
                made[unit] = ids[a:b].tobytes()
        for unit, e in zip(apart, self.tokenizer.encode_batch_fast(apart, add_special_tokens=False)):
            made[unit] = np.array(e.ids, "<u4").tobytes()
        self.units.update((u, ids) for u, ids in made.items() if len(u) <= _KEPT)
        return made

    def _units(self, units: list[str]) -> bytes:
        try:
            return b"".join(map(self.units.__getitem__, units))
        except KeyError:
            made = self._learn(units)
            return b"".join([made[u] if u in made else self.units[u] for u in units])

    def _chunk(self, data: bytes) -> tuple[str, bytes | None, str]:
        """(first unit, ids of the units between, last unit); without a border inside: (text, None, "")."""
        known = self.chunks.get(data)
        if known is not None:
            self.reused += 1
            return known
        self.encoded += 1
        units = _UNIT.findall(data.decode())
        made = (units[0], self._units(units[1:-1]), units[-1]) if len(units) > 1 else (data.decode(), None, "")
        if self.held + len(data) > self.max_bytes:
            self.chunks.clear()
            self.held = 0
        if len(data) <= 16 * self.chunk:
            self.chunks[data] = made
            self.held += len(data)
        return made

    def cuts(self, data: bytes) -> list[int]:
        """Ends of the chunks of `data`, the last one its length; never inside a character."""
        n = len(data)
        if n <= self.chunk:
            return [n] if n else []
        at = np.ndarray((n - 7,), "<u8", data, strides=(1,))
        mixed = at[:-8] * _MIX[0]
        mixed ^= at[8:] * _MIX[1]
        mixed ^= mixed >> np.uint64(31)
        mixed *= _MIX[0]
        ends = np.flatnonzero((mixed >> np.uint64(32)) % np.uint64(self.chunk) == 0) + _SEEN
        raw, found = data, []
        for end in ends.tolist():
            while end < n and raw[end] & 0xC0 == 0x80:
                end += 1
            if end < n and (not found or end > found[-1]):
                found.append(end)
        found.append(n)
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if _ODD.search(text) or any(s in text for s in self.special):
            return self._raw(text)
        data = text.encode()
        out: list[bytes] = []
        start, joined = 0, []
        for end in self.cuts(data):
            first, ids, last = self._chunk(data[start:end])
            joined.append(first)
            if ids is not None:  # a sure border on either side of `ids`: the join before it can be repaired now
                out += (self._units(_UNIT.findall("".join(joined))), ids)
                joined = [last]
            start = end
        out.append(self._units(_UNIT.findall("".join(joined))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """As decode(ids, skip_special_tokens=False): bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies name printable Latin-1 bytes by themselves and number the others from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    names = {chr(b): b for b in plain}
    return names | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


@lru_cache(maxsize=2)
def codec(path: str, only_library: bool = False) -> Codec:
    """One codec for each Python worker: what it has encoded serves the worker's later tasks too."""
    return Codec(path, only_library=only_library)


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            counts, ids_sha, text_sha, size = [], [], [], 0
            for text in batch.column(1).to_pylist():
                ids = c.encode(text)
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids).encode("utf-8", "replace")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def encode_ids(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids: binary of little-endian unsigned 32-bit ids) of every row; a null text has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(c.encode, part.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])
    return _rows(docs, doc_id, text).mapInArrow(run, "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows of `encode_ids`; null ids decode to an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(ids or b"") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of the ids and of the decoded text of every row of `docs`.

    A null text counts as empty: no ids, and the digest of nothing. Rows are independent: repeated
    rows and ids give repeated results. Columns other than the two named may have any name.

    Returns doc_id, n_tokens (long), ids_sha256, decoded_sha256.
    """
    return _rows(docs, doc_id, text).mapInArrow(
        _encoded(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
