"""Sparse text features for the classifiers, computed over batches of texts in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tidemark.llm.shingles import word_hashes

#: White space for ASCII characters that are no letters or digits.
_PLAIN = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def grams(texts: list[bytes], sizes: tuple[int, ...], bins: int) -> np.ndarray:
    """Hashed counts of byte n-grams of lower-cased texts: square roots, each row of length 1 (or 0)."""
    joined = np.frombuffer(b"\0\0\0\0".join([*(t.lower() for t in texts), b""]), np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), [len(t) + 4 for t in texts])
    out = np.zeros(len(texts) * bins)
    code = np.zeros(len(joined), np.uint64)
    for k in range(1, max(sizes) + 1):
        m = len(joined) - k + 1
        if m <= 0:
            break
        code = (code[:m] << np.uint64(8)) | joined[k - 1 :]
        if k in sizes:
            inside = (joined[:m] > 0) & (joined[k - 1 :] > 0)
            h = (code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bins.bit_length() + 1)
            out += np.bincount(row[:m][inside] * bins + h[inside].astype(np.int64), minlength=len(out))
    out = np.sqrt(out.reshape(len(texts), bins))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def by_size(texts: list[bytes], most: int = 1 << 20, rows: int = 256) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``most`` bytes and at most ``rows`` texts, with the number of the first."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and end - at < rows and (end == at or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def word_set(text: bytes) -> np.ndarray:
    """Hashes of the distinct words of a text, lower-cased and without ASCII punctuation."""
    return np.unique(word_hashes(text.translate(_PLAIN))[0])
