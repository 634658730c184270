"""Words of whole shards, found and hashed on UTF-8 bytes with numpy."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240601)
#: One odd 64-bit value per byte: h(word) = sum of TABLE[b_j] * BASE**j, modulo 2**64.
TABLE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))
CHUNK = 1 << 20

#: Bytes of words in `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Bytes of words in `[^\x20\x09-\x0D]+`.
NON_SPACE = np.ones(256, bool)
NON_SPACE[0x20] = NON_SPACE[0x09:0x0E] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_LOWER_TABLE = TABLE[LOWER]
#: A second hash, to tell words apart whose first agree.
SECOND = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, _BASE_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with a line feed after each, and where each text begins."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    begins = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=begins[1:])
    return np.frombuffer(b"\n".join(raw) + b"\n", np.uint8), begins


def spans(data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans [start, end) of the maximal runs of `kind`."""
    flag = np.zeros(len(data) + 2, np.int8)
    flag[1:-1] = kind[data]
    step = np.diff(flag)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = _LOWER_TABLE) -> np.ndarray:
    """64-bit hashes of the words, lower-cased by default; equal words have equal hashes."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        p, inv = _pow(max(hi - lo, CHUNK) + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * p[: hi - lo], out=total[1:])
        s = start[i:j] - lo
        out[i:j] = (total[end[i:j] - lo] - total[s]) * inv[s]
        i = j
    return mixed(out)
