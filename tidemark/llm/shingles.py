"""Word shingles of UTF-8 texts as 64-bit hashes, computed over whole batches of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes of text hashed at a time.
CHUNK = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_BASE = 0x5851F42D4C957F2D
_UP = _powers(1 << 16, _BASE)


def word_edges(text: bytes) -> np.ndarray:
    """First byte and end of every word, in turn."""
    space = _SPACE[np.frombuffer(text, np.uint8)]
    inside = np.zeros(len(space) + 2, bool)
    np.logical_not(space, out=inside[1:-1])
    return np.flatnonzero(inside[1:] != inside[:-1])


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word; words lie between ASCII white space, A-Z read as a-z."""
    b = np.frombuffer(text.lower(), np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(_SPACE[b], prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    size = end - start
    out = np.zeros(len(start), np.uint64)
    if len(start):
        # Bytes, each times the power of its place in the word, summed by word.
        at = np.flatnonzero(~_SPACE[b])
        place = at - np.repeat(start, size)
        up = _UP if (top := int(size.max())) <= len(_UP) else _powers(top, _BASE)
        out = np.add.reduceat((b[at].astype(np.uint64) + np.uint64(1)) * up[place], np.cumsum(size) - size)
    return mix(out + size.astype(np.uint64) * _ODD), start, end


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = mix(total + words[i : i + n]) * _ODD
    return total


def batched_words(texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined into chunks: their numbers, all words' hashes, starts and ends in the own text, and how many words
    each text has."""
    at = 0
    while at < len(texts):
        some, size = [], 0
        while at < len(texts) and (not some or size + len(texts[at]) <= CHUNK):
            some.append(at)
            size += len(texts[at]) + 1
            at += 1
        joined = b"\n".join(texts[i] for i in some)
        first = np.cumsum([0, *(len(texts[i]) + 1 for i in some[:-1])])
        h, s, e = word_hashes(joined)
        own = np.searchsorted(first, s, "right") - 1
        yield some, h, s - first[own], e - first[own], np.bincount(own, minlength=len(some))


def shingle_sets(texts: list[bytes], k: int = WORDS) -> Iterator[np.ndarray]:
    """Per text its distinct shingles' hashes, sorted; the whole sequence is one shingle if there are fewer words."""
    for _, h, _, _, n in batched_words(texts):
        at = np.concatenate([[0], np.cumsum(n)])
        every = windows(h, k)
        for i, m in enumerate(n.tolist()):
            if m >= k:
                x = np.sort(every[at[i] : at[i] + m - k + 1])
                yield x[np.concatenate([[True], x[1:] != x[:-1]])]
            else:
                yield windows(h[at[i] : at[i] + m], m) + np.uint64(m) if m else np.zeros(0, np.uint64)
