"""Word shingles of texts as sets of 64-bit hashes, computed on bytes with numpy."""

from __future__ import annotations

import numpy as np

#: Words of a shingle unless the caller says otherwise (op1 takes four).
WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_rng = np.random.default_rng(20)
#: What a byte stands for in a word's hash; A-Z stand for a-z.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TURN = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_BACK)):
            grown = np.full(n, base, np.uint64)
            grown[0] = 1
            _powers[k] = np.cumprod(grown)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _TURN[0]
    x = (x ^ (x >> np.uint64(29))) * _TURN[1]
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """A hash of each word, in order; the text is cut at white space into stretches of about `step` bytes."""
    out, start = [], 0
    while start < len(data):
        end = min(len(data), start + step)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        part = data[start:end]
        up, back = _upto(len(part) + 1)
        space = np.empty(len(part) + 2, bool)
        space[0] = space[-1] = True
        space[1:-1] = _SPACE[part]
        edges = np.flatnonzero(space[1:] != space[:-1])
        firsts, lasts = edges[::2], edges[1::2]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[:-1], out=sums[1:])
        out.append(mixed((sums[lasts] - sums[firsts]) * back[firsts] + (lasts - firsts).astype(np.uint64)))
        start = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(data: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `words` words; of fewer words, the whole sequence is one."""
    hashes = word_hashes(data)
    if not len(hashes):
        return hashes
    size = min(words, len(hashes))
    total = np.full(len(hashes) - size + 1, np.uint64(size))
    for k in range(size):
        total = mixed(total) + hashes[k : len(hashes) - size + 1 + k] * _TURN[k % 4]
    return np.unique(mixed(total))
