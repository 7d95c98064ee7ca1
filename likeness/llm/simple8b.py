"""Simple-8b coding of token ids in numpy, with escapes.

A 64-bit word has a selector in its top four bits and a number of equally wide ids in the
rest. An id too wide for 20 bits is written as the escape, all ones in 20 bits, and stands
in a list of its own.
"""

import numpy as np

# Ids in a word and bits of each, by selector. Selectors 0 and 1 are runs of zeros.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = (1 << 20) - 1


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint64) and escaped ids (uint32); each word takes as many ids as fit."""
    ids = np.asarray(ids, np.uint32)
    escaped = ids[ids >= ESCAPE]
    values = np.minimum(ids, ESCAPE).astype(np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), escaped
    # Bits of each id, with zeros after the last: the rest of a last word stays zero.
    most = np.zeros(n + int(COUNTS[0]), np.uint8)
    most[:n] = np.frexp(values.astype(np.float64))[1]
    selector, width = np.full(n, 13, np.uint8), 1
    for c, s in [(2, 13), *((int(COUNTS[s]), s) for s in range(13, -1, -1))]:
        # The widest of the ``c`` ids from each place on, of two runs that overlap.
        most, width = np.maximum(most[:len(most) - c + width], most[c - width:]), c
        if s < 13:
            # Not where fewer ids are left than the next wider word takes.
            here = max(0, n - int(COUNTS[s + 1]))
            np.putmask(selector[:here], most[:here] <= BITS[s], s)
    step = COUNTS.astype(np.uint8)[selector].tobytes()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([values, np.zeros(240, np.uint64)])
    for s in np.flatnonzero(np.bincount(chosen)):
        if BITS[s]:
            mine = np.flatnonzero(chosen == s)
            first, packed = starts[mine], words[mine]
            for j in range(COUNTS[s]):
                packed |= padded[first + j] << np.uint64(j * BITS[s])
            words[mine] = packed
    return words, escaped


def decode(words: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block, all words of one selector at a time."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    starts = np.cumsum(counts) - counts
    ids = np.zeros(int(counts.sum()), np.uint32)
    for s in np.unique(selector):
        if BITS[s]:
            mine = np.flatnonzero(selector == s)
            first, packed = starts[mine], words[mine]
            mask = np.uint64((1 << int(BITS[s])) - 1)
            for j in range(COUNTS[s]):
                ids[first + j] = packed >> np.uint64(j * BITS[s]) & mask
    ids = ids[:n]
    if len(escaped):
        ids[ids == ESCAPE] = escaped
    return ids
