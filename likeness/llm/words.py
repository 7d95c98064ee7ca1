"""Words of many texts at once: 64-bit hashes over the UTF-8 bytes of Arrow columns.

A word is a longest run of word bytes inside one text. Its hash is a polynomial in the
(lower-cased) bytes, modulo 2**64, mixed with its length; equal words have equal
hashes, and unequal ones differ but for a chance of about 2**-64.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


#: Values of bytes where A-Z differ from a-z, and where they count as a-z.
EXACT = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64)
VALUES = EXACT.copy()
VALUES[65:91] = VALUES[97:123]
#: Word bytes where words are runs of letters, digits and all that is not ASCII.
ALPHANUMERIC = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
                         for b in range(256)])
#: Word bytes where words are what white space separates.
VISIBLE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and where each text begins; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(column: pa.Array, limit: int):
    """Row ranges of about ``limit`` bytes of text; a longer text makes one alone."""
    _, bounds = utf8(column)
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + limit, "right")) - 1)
        yield begin, end
        begin = end


@dataclass
class Words:
    hashes: np.ndarray  # of each word
    first: np.ndarray  # of each text, its first word; one more at the end

    @property
    def text(self) -> np.ndarray:
        """The text that each word stands in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _powers(n: int, known={}) -> tuple[np.ndarray, np.ndarray]:
    if n > known.get("n", 0):
        known["n"] = n = max(n, CHUNK * 2)
        for name, base in (("up", BASE), ("down", INVERSE)):
            run = np.full(n, base, np.uint64)
            run[0] = 1
            known[name] = np.cumprod(run)
    return known["up"], known["down"]


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """Hashes of stretches of bytes that begin in ascending order."""
    found = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + CHUNK)))
        low, high = begin[i], end[j - 1]
        up, down = _powers(high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.multiply(values[data[low:high]], up[:high - low], out=sums[1:])
        np.cumsum(sums, out=sums)
        found[i:j] = (sums[end[i:j] - low] - sums[begin[i:j] - low]) * down[begin[i:j] - low]
        i = j
    return mix(found + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_bounds(data: np.ndarray, bounds: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends in the bytes of texts that begin at ``bounds``."""
    inside = word_bytes[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True  # words end where texts do
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | cut[1:-1]
    closes[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def words_of(column: pa.Array, word_bytes: np.ndarray, values: np.ndarray = VALUES) -> Words:
    """The words of a column of texts, in order."""
    data, bounds = utf8(column)
    begin, end = word_bounds(data, bounds, word_bytes)
    return Words(span_hashes(data, begin, end, values), np.searchsorted(begin, bounds))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words; as many fewer than words, and none of less."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        total = total * np.uint64(0x5851F42D4C957F2D) + hashes[i:len(hashes) - n + 1 + i]
    return mix(total + np.uint64(n))


class Members:
    """Tests many hashes for membership in a few: a bitmap first, a search for the rest."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        bits = 16
        while bits < 22 and 1 << bits < 64 * len(self.keys):
            bits += 1
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.keys >> self.shift).astype(np.int64)] = True

    def positions(self, hashes: np.ndarray) -> np.ndarray:
        """Where the members stand."""
        at = np.flatnonzero(self.seen[(hashes >> self.shift).astype(np.int64)])
        if len(at):
            found = np.searchsorted(self.keys, hashes[at])
            at = at[self.keys[np.minimum(found, len(self.keys) - 1)] == hashes[at]]
        return at
