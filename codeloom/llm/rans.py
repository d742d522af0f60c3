"""Static range asymmetric numeral system over token ids, many interleaved lanes at a time.

A :class:`Table` holds the shared frequencies (quantised to ``2**BITS``).  :func:`encode` gives one independent block:
symbol i belongs to lane ``i % lanes``; each lane has a state in [2**20, 2**52) that gives off 32-bit words.  States
below 2**53 are exact as double-precision numbers, so all lanes of a row are divided at once.
Every ``check`` rows the block notes all states and the place in the words, so that a decoder can begin there;
each stretch between two such checkpoints carries the crc32 of its ids.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

BITS = 20
_LOW = float(1 << BITS)
_WORD = float(1 << 32)
_MASK = np.int64((1 << BITS) - 1)
#: Ids between two checkpoints, about.
STRETCH = 1 << 18
MAX_LANES = 4096
#: Ids up to this have their shares in an array by id.
_DENSE = 1 << 22


@dataclass
class Table:
    symbols: np.ndarray  # uint32, ascending
    freq: np.ndarray  # int64, sums to 2**BITS

    def __post_init__(self):
        self.start = np.cumsum(self.freq) - self.freq
        self._slots = self._by_id = None

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        """From the ids themselves; every id that occurs gets a share."""
        if not len(ids):
            return cls(np.zeros(1, np.uint32), np.array([1 << BITS], np.int64))
        if int(ids.max()) < _DENSE:
            counts = np.bincount(ids)
            symbols = np.flatnonzero(counts)
            c = counts[symbols]
        else:
            symbols, c = np.unique(ids, return_counts=True)
        if len(symbols) > 1 << BITS:
            raise ValueError("more symbols than shares")
        room = (1 << BITS) - len(symbols)
        freq = 1 + c * room // c.sum()
        freq[np.argmax(c)] += (1 << BITS) - freq.sum()
        return cls(symbols.astype(np.uint32), freq.astype(np.int64))

    def to_bytes(self) -> bytes:
        return zlib.compress(np.array([len(self.symbols)], "<u4").tobytes() + np.diff(self.symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + self.freq.astype("<u4").tobytes(), 6)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Table:
        a = np.frombuffer(zlib.decompress(raw), "<u4")
        n = int(a[0])
        return cls(np.cumsum(a[1 : n + 1], dtype=np.uint32), a[n + 1 :].astype(np.int64))

    def shares(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Frequency and first share of each id, as doubles; an id without a share is an error."""
        if not len(ids):
            return np.empty(0), np.empty(0)
        if int(self.symbols[-1]) < _DENSE:
            if self._by_id is None:
                self._by_id = np.zeros((2, int(self.symbols[-1]) + 1))
                self._by_id[0, self.symbols], self._by_id[1, self.symbols] = self.freq, self.start
            if int(ids.max()) > int(self.symbols[-1]):
                raise ValueError("an id is not in the table")
            freq, start = self._by_id[0].take(ids), self._by_id[1].take(ids)
        else:
            at = np.minimum(np.searchsorted(self.symbols, ids), len(self.symbols) - 1)
            found = self.symbols[at] == ids
            freq, start = np.where(found, self.freq[at], 0).astype(float), self.start[at].astype(float)
        if not freq.all():
            raise ValueError("an id is not in the table")
        return freq, start

    @property
    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each of the 2**BITS shares: the id that owns it, that id's frequency, and the share's place in it."""
        if self._slots is None:
            self._slots = np.repeat(self.symbols, self.freq), np.repeat(self.freq, self.freq), np.arange(1 << BITS) - np.repeat(self.start, self.freq)
        return self._slots


def lanes_for(n: int) -> int:
    return max(1, min(MAX_LANES, 1 << max(0, (n // 256).bit_length())))


def encode(ids: np.ndarray, table: Table, stretch: int = STRETCH) -> dict:
    """n, lanes, check (rows between checkpoints), words, and for each checkpoint its states, word offset and crc32."""
    n = len(ids)
    lanes = lanes_for(n)
    rows = -(-n // lanes)
    check = max(1, stretch // lanes)
    filler = int(np.argmax(table.freq))  # the last row is filled up with the cheapest symbol
    freq, start = np.full((rows, lanes), float(table.freq[filler])), np.full((rows, lanes), float(table.start[filler]))
    freq.reshape(-1)[:n], start.reshape(-1)[:n] = table.shares(ids)
    x = np.full(lanes, _LOW)
    words: list[np.ndarray] = []
    states, left = [], []
    count = 0
    most = np.empty(lanes)
    for r in range(rows - 1, -1, -1):
        f = freq[r]
        np.multiply(f, _WORD, out=most)
        over = np.flatnonzero(x >= most)
        if len(over):
            w = x[over]
            high = np.floor(w * (1 / _WORD))
            words.append((w - high * _WORD).astype(np.uint32))
            count += len(w)
            x[over] = high
        # x // f * 2**BITS + x % f + start, in exact doubles
        q = np.floor(x / f)
        x += q * (_LOW - f)
        x += start[r]
        if r % check == 0:
            states.append(x.astype("<u8"))
            left.append(count)
    words.reverse()
    crc = [zlib.crc32(ids[a : a + check * lanes].astype("<u4").tobytes()) for a in range(0, n, check * lanes)]
    return {
        "n": n,
        "lanes": lanes,
        "check": check,
        "words": np.concatenate(words).astype("<u4").tobytes() if words else b"",
        "states": np.concatenate(states[::-1]).tobytes() if states else b"",
        "offsets": [count - k for k in left[::-1]],
        "crc32": crc,
    }


def decode_rows(states: np.ndarray, words: np.ndarray, rows: int, n: int, table: Table) -> np.ndarray:
    """The first ``n`` ids of ``rows`` rows of lanes, from the lanes' states and the words that follow."""
    x, at = states.astype(np.int64), 0
    out = np.empty((rows, len(x)), np.uint32)
    symbol, freq, place = table.slots
    for r in range(rows):
        low = x & _MASK
        symbol.take(low, out=out[r])
        x = freq.take(low) * (x >> BITS) + place.take(low)
        need = np.flatnonzero(x < (1 << BITS))
        if len(need):
            x[need] = (x[need] << 32) | words[at : at + len(need)]
            at += len(need)
    return out.reshape(-1)[:n]


def decode_stretch(block: dict, table: Table, k: int) -> np.ndarray:
    """The ids between checkpoint ``k`` and the next, found from that checkpoint alone and checked."""
    lanes, check, n = block["lanes"], block["check"], block["n"]
    rows = min(check, -(-n // lanes) - k * check)
    states = np.frombuffer(block["states"], "<u8")[k * lanes : (k + 1) * lanes]
    ids = decode_rows(states, np.frombuffer(block["words"], "<u4")[block["offsets"][k] :], rows, min(n - k * check * lanes, rows * lanes), table)
    if zlib.crc32(ids.astype("<u4", copy=False).tobytes()) != block["crc32"][k]:
        raise ValueError(f"checksum of stretch {k} is wrong")
    return ids


def decode(block: dict, table: Table) -> np.ndarray:
    parts = [decode_stretch(block, table, k) for k in range(len(block["crc32"]))]
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)
