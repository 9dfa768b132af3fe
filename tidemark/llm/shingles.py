"""Vectorised word shingles: hashed five-word windows of whole texts in numpy."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place on a copy."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


#: Bytes that are hashed at once, so memory besides the word hashes does not grow with a text.
SEGMENT = 1 << 18
_UP = np.multiply.accumulate(np.r_[np.uint64(1), np.full(SEGMENT, _BASE, np.uint64)])
_DOWN = np.multiply.accumulate(np.r_[np.uint64(1), np.full(SEGMENT, _INVERSE, np.uint64)])


def _segment(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, sum of byte values times powers of the base) of each word of a segment."""
    edge = np.diff((~_SPACE[data]).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _UP[: len(data)], out=sums[1:])
    return starts, ends - starts, (sums[ends] - sums[starts]) * _DOWN[starts]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word, segment by segment; words may span segments."""
    parts: list[list[np.ndarray]] = []
    for lo in range(0, len(data), SEGMENT):
        starts, lengths, sums = _segment(data[lo : lo + SEGMENT])
        if parts and len(starts) and starts[0] == 0 and not _SPACE[data[lo - 1]]:
            # the segment's first word goes on with the last one so far
            _, last_lengths, last_sums = next(p for p in reversed(parts) if len(p[0]))
            last_sums[-1:] += sums[:1] * np.uint64(pow(_BASE, int(last_lengths[-1]), 1 << 64))
            last_lengths[-1] += lengths[0]
            starts, lengths, sums = starts[1:], lengths[1:], sums[1:]
        parts.append([starts + lo, lengths, sums])
    starts, lengths, sums = (np.concatenate(x) for x in zip(*parts))
    return starts, mix(sums + lengths.astype(np.uint64))


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at the six ASCII white-space bytes."""
    return (text or "").encode("utf-8", "replace").lower().split()


def exact_shingles(text: str | None, size: int = 5) -> set[tuple[bytes, ...]]:
    """Distinct ``size``-word windows; a shorter text is one window; no words, no window."""
    w = words(text)
    if not w:
        return set()
    if len(w) < size:
        return {tuple(w)}
    return set(zip(*(w[i:] for i in range(size))))


def hashed_shingles(texts: list[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted by row then hash.

    Words are hashed from prefix sums of byte values times powers of an odd base
    (mod 2**64), so the cost is a few passes over the bytes with no Python per word.
    """
    raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    lengths = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    starts, h = word_hashes(data)
    if len(starts) == 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    row = np.searchsorted(np.cumsum(lengths), starts, side="right")
    n = np.bincount(row, minlength=len(raw))
    first = np.cumsum(n) - n
    place = np.arange(len(h)) - first[row]
    take = np.flatnonzero((place + size <= n[row]) | ((n[row] < size) & (place == 0)))
    combined = np.zeros(len(take), np.uint64)
    short = n[row[take]] < size
    for k in range(size):
        at = take + k
        inside = ~short | (k < n[row[take]])
        value = h[np.minimum(at, len(h) - 1)] * inside
        combined = (combined + value) * np.uint64(0x9FB21C651E98DF25)
    combined = mix(combined ^ (np.minimum(n[row[take]], size).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    rows = row[take]
    bounds = np.searchsorted(rows, np.arange(len(raw) + 1))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        combined[lo:hi].sort()
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (combined[1:] != combined[:-1])
    return rows[fresh], combined[fresh]


def in_pieces(texts: list[str | None], characters: int = 1 << 18):
    """(from, to) ranges of ``texts`` of about so many characters, one text at least."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= characters:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
