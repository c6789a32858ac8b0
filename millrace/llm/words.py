"""Words of many texts at once, as 64-bit hashes in one array."""

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLOCK = 1 << 20
_powers: list[np.ndarray] = []

# Bytes that separate words: ASCII white space, or all of ASCII but letters and digits.
SPACE = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def powers() -> tuple[np.ndarray, np.ndarray]:
    """p^i and p^-i modulo 2^64 for the places of a block."""
    if not _powers:
        for p in (_ODD, _INVERSE):
            steps = np.full(_BLOCK, p, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def split(data: bytes, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of UTF-8 bytes; equal words have equal hashes, never zero.

    A word's hash is the difference of two prefix sums of byte * p^place, moved to place zero.
    """
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~separators[raw]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers()
    sums = np.zeros(len(raw) + 1, np.uint64)
    # places count from the start of a block of _BLOCK bytes; the few words across a border are redone below
    for lo in range(0, len(raw), _BLOCK):
        part = raw[lo:lo + _BLOCK]
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:len(part)], out=sums[lo + 1:lo + 1 + len(part)])
    first, last = start // _BLOCK, (end - 1) // _BLOCK if len(end) else end
    before = np.where(start % _BLOCK == 0, np.uint64(0), sums[start])
    hashes = (sums[end] - before) * down[start % _BLOCK]
    for i in np.flatnonzero(first != last):
        word, value = raw[start[i]:end[i]], 0
        for lo in range(0, len(word), _BLOCK):
            part = word[lo:lo + _BLOCK].astype(np.uint64) + np.uint64(1)
            scale = pow(int(_ODD), lo, 1 << 64)
            value += int((part * up[:len(part)]).sum(dtype=np.uint64)) * scale
        hashes[i] = value % (1 << 64)
    hashes = mixed(hashes)
    hashes[hashes == 0] = 1
    return hashes, start, end


def hashed(texts: list[str], separators: np.ndarray = NOT_ALNUM, lower: bool = True):
    """(hashes of all words, number of the first word of each text, and the total at the end)."""
    parts = [(t.lower() if lower else t).encode() + b"\n" for t in texts]
    hashes, start, _ = split(b"".join(parts), separators)
    borders = np.cumsum([0] + [len(p) for p in parts])
    return hashes, np.searchsorted(start, borders)
