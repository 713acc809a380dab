"""An adaptive context-mixing range coder for token ids, in numpy.

A block of ids is dealt to lanes that run in lockstep: step t codes the t-th id of every lane, and the
models, which all lanes share, learn from the step before the next one. Blocks don't share anything.

Predictions: order 2 and order 1 each name the id that followed their context last, with a count of
how often it held; order 0 is the frequency of every id so far. A logistic mixer weighs what the three
orders say about the first candidate (of order 2, or of order 1 where order 2 has none); the record of
order 1 weighs its candidate if that is another one. The range coder then codes one of three cases,
first candidate, second, neither; in the last case the id itself by its order-0 frequency.

All model arithmetic is on integers, so that every machine decodes what another one has encoded.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

#: Lanes of a full block, and the least ids of a lane.
LANES, LEAST = 2048, 64
_MAGIC = b"SLTK"
_HEAD = struct.Struct("<4sIIII")  # magic, ids, vocabulary, lanes, crc32 of the rest
_SLOTS = 18
_TRUST = 15
_TOP, _BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
_U16, _U48 = np.uint64(16), np.uint64(48)
_RISE = 32
_RATE = 11

#: Logistic function of x / 256 in twelfth-bit probabilities, for x from -2047 to 2047, and its inverse.
_SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.int32)
_STRETCH = np.clip(np.searchsorted(_SQUASH, np.arange(4096)) - 2047, -2047, 2047).astype(np.int32)


class Models:
    """Order-0 to order-2 predictions and their mixer. `see` and `learn` take turns.

    A context's entry is (named id + 1) * 16 + trust. Counts of trust, and the mixer's weights, are
    brought up to date on every fourth step, from all lanes of that step.
    """

    def __init__(self, vocabulary: int):
        self.second = np.zeros(1 << _SLOTS, np.int32)
        self.first = np.zeros(vocabulary, np.int32)
        self.count = np.ones(vocabulary, np.int64)
        self.steps = 0
        self.held = np.ones((3, _TRUST + 1), np.int64)  # how often a candidate of that trust held: order 1, order 2, second candidate
        self.asked = np.full((3, _TRUST + 1), 2, np.int64)
        self.weights = np.tile(np.array([24000, 16000, 8000], np.int32), (4, 1))
        self._sum()
        self._trust()

    def _sum(self) -> None:
        self.until = np.r_[0, np.cumsum(self.count)].astype(np.uint64)
        self.total = self.until[-1]

    def _trust(self) -> None:
        p = np.clip(self.held * 4096 // self.asked, 1, 4095)
        self.said, self.other = _STRETCH[p[:2]].astype(np.int32), p[2].astype(np.int32)

    def see(self, before: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first candidate, second one or -1, their frequencies of 65536) after the ids `earlier`, `before`."""
        h = before.astype(np.uint32) * np.uint32(2654435761)
        h ^= earlier.astype(np.uint32) * np.uint32(2246822519)
        h ^= h >> np.uint32(15)
        h *= np.uint32(3266489917)
        self.slot = h >> np.uint32(32 - _SLOTS)
        self.before = before
        self.e2, self.e1 = self.second[self.slot], self.first[before]
        two, one = (self.e2 >> 4) - 1, (self.e1 >> 4) - 1
        self.two, self.one = two, one
        known = two >= 0
        a = np.where(known, two, one)
        agree = one == a
        self.case = known * np.int8(2) + agree
        x = np.empty((3, len(a)), np.int32)
        x[0] = self.said[1][self.e2 & 15]
        x[0] *= known
        x[1] = np.where(agree, self.said[0][self.e1 & 15], -512)
        x[2] = _STRETCH[np.minimum(self.count[a] * 4096 // int(self.total), 4095)]
        at = (self.weights.T[:, self.case] * x).sum(0, dtype=np.int32) >> 15
        pa = _SQUASH[np.minimum(np.maximum(at, -2047), 2047) + 2047]
        pa *= a >= 0
        self.a, self.x, self.pa = a, x, pa
        fa = pa << 4
        left = 65536 - fa
        b = np.where(agree, -1, one)
        fb = np.maximum(left * self.other[self.e1 & 15] >> 12, 1) * (b >= 0)
        self.b = b
        return a, b, fa, fb

    def learn(self, ids: np.ndarray) -> None:
        for table, at, entry, said in ((self.second, self.slot, self.e2, self.two), (self.first, self.before, self.e1, self.one)):
            # a candidate that held gains trust; one that didn't loses half of it, or its place if it has none
            trust = entry & 15
            table[at] = np.where(said == ids, entry + (trust < _TRUST), np.where(trust > 0, entry - trust + (trust >> 1), (ids + 1) << 4))
        np.add.at(self.count, ids, _RISE)
        if self.steps % 4 == 0:
            self._adapt(ids)
        self.steps += 1
        if self.steps < 16 or self.steps % 8 == 0:
            self._sum()

    def _adapt(self, ids: np.ndarray) -> None:
        hit = ids == self.a
        miss = (np.where(hit, 4095, 0) - self.pa) * (self.a >= 0)
        lanes = np.maximum(np.bincount(self.case, minlength=4), 1)
        for k in range(3):
            pull = (np.bincount(self.case, miss * self.x[k], 4).astype(np.int64) >> _RATE) // lanes
            self.weights[:, k] = np.clip(self.weights[:, k] + 4 * pull, -(1 << 17), 1 << 17)
        ask = self.b >= 0
        ask &= ~hit
        for k, (on, said, entry) in enumerate((
                (self.one >= 0, self.one, self.e1), (self.two >= 0, self.two, self.e2), (ask, self.b, self.e1))):
            trust = entry & 15
            self.asked[k] += np.bincount(trust[on], minlength=_TRUST + 1)
            self.held[k] += np.bincount(trust[on & (said == ids)], minlength=_TRUST + 1)
        self._trust()


class _Writer:
    def __init__(self, lanes: int, room: int):
        self.low, self.wide = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
        self.words, self.n = np.zeros((lanes, room), np.uint16), np.zeros(lanes, np.int64)

    def put(self, lanes: np.ndarray, low: np.ndarray, size: np.ndarray, unit: np.ndarray) -> None:
        """Narrow each lane to [low, low + size) in units of `unit`."""
        self.low[lanes] += unit * low
        self.wide[lanes] = unit * size
        while True:
            at, wide = self.low[lanes], self.wide[lanes]
            fixed = (at ^ (at + wide)) < _TOP
            go = fixed | (wide < _BOTTOM)
            if not go.any():
                return
            lanes, at, wide, fixed = lanes[go], at[go], wide[go], fixed[go]
            wide = np.where(fixed, wide, -at & (_BOTTOM - np.uint64(1)))
            self.words[lanes, self.n[lanes]] = (at >> _U48).astype(np.uint16)
            self.n[lanes] += 1
            self.low[lanes], self.wide[lanes] = at << _U16, wide << _U16

    def end(self) -> bytes:
        for _ in range(4):
            self.words[np.arange(len(self.low)), self.n] = (self.low >> _U48).astype(np.uint16)
            self.n += 1
            self.low <<= _U16
        kept = np.arange(self.words.shape[1])[None, :] < self.n[:, None]
        return self.n.astype("<u4").tobytes() + self.words[kept].astype("<u2").tobytes()


class _Reader:
    def __init__(self, data: bytes, lanes: int):
        n = np.frombuffer(data, "<u4", lanes).astype(np.int64)
        self.words = np.r_[np.frombuffer(data, "<u2", offset=4 * lanes), np.zeros(8, "<u2")].astype(np.uint64)
        self.next = np.cumsum(n) - n
        self.low, self.wide = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
        self.code = np.zeros(lanes, np.uint64)
        for _ in range(4):
            self.code = self.code << _U16 | self.words[self.next]
            self.next += 1

    def got(self, lanes: np.ndarray, low: np.ndarray, size: np.ndarray, unit: np.ndarray) -> None:
        self.low[lanes] += unit * low
        self.wide[lanes] = unit * size
        while True:
            at, wide = self.low[lanes], self.wide[lanes]
            fixed = (at ^ (at + wide)) < _TOP
            go = fixed | (wide < _BOTTOM)
            if not go.any():
                return
            lanes, at, wide, fixed = lanes[go], at[go], wide[go], fixed[go]
            wide = np.where(fixed, wide, -at & (_BOTTOM - np.uint64(1)))
            self.code[lanes] = self.code[lanes] << _U16 | self.words[np.minimum(self.next[lanes], len(self.words) - 1)]
            self.next[lanes] += 1
            self.low[lanes], self.wide[lanes] = at << _U16, wide << _U16


def _lanes(n: int) -> tuple[int, int]:
    """(lanes, steps) of a block of n ids."""
    lanes = max(1, min(LANES, n // LEAST))
    steps = -(-n // lanes)
    return -(-n // steps) if n else 0, steps


def pack(ids: np.ndarray) -> bytes:
    """A checksummed block of ids below 2^26."""
    n = len(ids)
    vocabulary = int(ids.max()) + 1 if n else 1
    if vocabulary > 1 << 26:
        raise ValueError("an id of 2^26 or more")
    lanes, steps = _lanes(n)
    body = b""
    if n:
        rows = np.zeros(lanes * steps, np.int32)
        rows[:n] = ids
        rows = rows.reshape(lanes, steps).T.copy()
        models, out = Models(vocabulary), _Writer(lanes, 3 * steps + 8)
        before = earlier = np.zeros(lanes, np.int32)
        for t in range(steps):
            live = -(-(n - t) // steps)  # lanes that have a t-th id; only the last ones can lack it
            own, every = rows[t][:live], np.arange(live)
            a, b, fa, fb = models.see(before[:live], earlier[:live])
            first = own == a
            second = (own == b) & ~first
            low = np.where(first, 0, np.where(second, fa, fa + fb)).astype(np.uint64)
            size = np.where(first, fa, np.where(second, fb, 65536 - fa - fb)).astype(np.uint64)
            out.put(every, low, size, out.wide[:live] >> _U16)
            rest = np.flatnonzero(~(first | second))
            if len(rest):
                said = own[rest]
                low = models.until[said]
                out.put(rest, low, models.until[said + 1] - low, out.wide[rest] // models.total)
            models.learn(own)
            before, earlier = own, before[:live]
        body = out.end()
    return _HEAD.pack(_MAGIC, n, vocabulary, lanes, _checksum(n, vocabulary, lanes, body)) + body


def _checksum(n: int, vocabulary: int, lanes: int, body: bytes) -> int:
    """Of the body and of what the header says about it."""
    return zlib.crc32(body, zlib.crc32(_HEAD.pack(_MAGIC, n, vocabulary, lanes, 0)))


def unpack(block: bytes) -> np.ndarray:
    """The ids of a block; ValueError if it is damaged."""
    if len(block) < _HEAD.size:
        raise ValueError("damaged block of token ids")
    magic, n, vocabulary, lanes, crc = _HEAD.unpack_from(block)
    body = block[_HEAD.size:]
    if magic != _MAGIC or _checksum(n, vocabulary, lanes, body) != crc or (n and lanes != _lanes(n)[0]):
        raise ValueError("damaged block of token ids")
    if not n:
        return np.zeros(0, np.uint32)
    steps = _lanes(n)[1]
    rows = np.zeros((steps, lanes), np.int32)
    models, source = Models(vocabulary), _Reader(body, lanes)
    before = earlier = np.zeros(lanes, np.int32)
    for t in range(steps):
        live = -(-(n - t) // steps)
        every = np.arange(live)
        a, b, fa, fb = models.see(before[:live], earlier[:live])
        unit = source.wide[:live] >> _U16
        value = np.minimum((source.code[:live] - source.low[:live]) // unit, np.uint64(65535)).astype(np.int32)
        first = value < fa
        second = ~first & (value < fa + fb)
        low = np.where(first, 0, np.where(second, fa, fa + fb)).astype(np.uint64)
        size = np.where(first, fa, np.where(second, fb, 65536 - fa - fb)).astype(np.uint64)
        source.got(every, low, size, unit)
        own = np.where(first, a, b)
        rest = np.flatnonzero(~(first | second))
        if len(rest):
            unit = source.wide[rest] // models.total
            value = np.minimum((source.code[rest] - source.low[rest]) // unit, models.total - np.uint64(1))
            said = np.searchsorted(models.until, value, side="right") - 1
            low = models.until[said]
            source.got(rest, low, models.until[said + 1] - low, unit)
            own[rest] = said
        rows[t][:live] = own
        models.learn(own)
        before, earlier = own, before[:live]
    return rows.T.ravel()[:n].astype(np.uint32)
