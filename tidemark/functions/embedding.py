"""Hashing embedding of text: signed buckets of words and character pairs and triples."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

DIMENSIONS = 256


def fnv1a(text: str) -> int:
    """32-bit FNV-1a over UTF-16 units: the low byte of each, then the high byte if it isn't 0."""
    h = 0x811C9DC5
    raw = text.encode("utf-16-le", "surrogatepass")
    for low, high in zip(raw[::2], raw[1::2]):
        h = (h ^ low) * 0x01000193 & 0xFFFFFFFF
        if high:
            h = (h ^ high) * 0x01000193 & 0xFFFFFFFF
    return h


def features_of(words: list[str]) -> Counter[str]:
    """Buckets of normalised words: the words, and pairs and triples of characters of all of them together."""
    compact = "".join(words)
    counts = Counter(f"w:{w}" for w in words)
    for n in (2, 3):
        counts.update(f"c{n}:{compact[i : i + n]}" for i in range(len(compact) - n + 1))
    return counts


def embedded(words: list[str], dimensions: int = DIMENSIONS) -> list[float]:
    """Unit vector of normalised words; zeros if there are none."""
    v = [0.0] * dimensions
    for f, n in features_of(words).items():
        v[fnv1a(f) % dimensions] += (1 + math.log(n)) * (1 if fnv1a(f"{f}#sign") & 1 == 0 else -1)
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v] if size else v


def _hashed(h: np.ndarray, units: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """FNV-1a of many strings at once, going on from ``h``: rows of UTF-16 units, of which the first ``sizes`` count."""
    prime = np.uint32(0x01000193)
    for k in range(units.shape[1]):
        on = k < sizes
        low, high = (units[:, k] & 0xFF).astype(np.uint32), (units[:, k] >> 8).astype(np.uint32)
        h = np.where(on, (h ^ low) * prime, h)
        h = np.where(on & (high > 0), (h ^ high) * prime, h)
    return h


def hashes(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """FNV-1a of strings, and of the same with ``#sign`` behind them."""
    raw = [np.frombuffer(f.encode("utf-16-le", "surrogatepass"), "<u2") for f in some]
    sizes = np.array([len(r) for r in raw], int)
    own = np.zeros(len(some), np.uint32)
    # Strings of like length together, so that one long word doesn't widen them all.
    by = np.argsort(sizes, kind="stable")
    for at in range(0, len(by), 4096):
        part = by[at : at + 4096]
        units = np.zeros((len(part), int(sizes[part].max(initial=0))), np.uint16)
        for i, k in enumerate(part):
            units[i, : sizes[k]] = raw[k]
        own[part] = _hashed(np.full(len(part), 0x811C9DC5, np.uint32), units, sizes[part])
    sign = np.frombuffer("#sign".encode("utf-16-le"), "<u2")
    return own, _hashed(own, np.tile(sign, (len(some), 1)), np.full(len(some), len(sign)))


def embedded_batch(texts: list[list[str] | None], dimensions: int = DIMENSIONS) -> list[list[float] | None]:
    """``embedded`` of many texts: each distinct bucket of the batch is hashed once."""
    counts = [features_of(t) if t is not None else Counter() for t in texts]
    place: dict[str, int] = {}
    for c in counts:
        for f in c:
            place.setdefault(f, len(place))
    own, sign = hashes(list(place))
    column, amount = own % dimensions, np.where(sign & 1 == 0, 1.0, -1.0)
    out: list[list[float] | None] = []
    for t, c in zip(texts, counts):
        if t is None:
            out.append(None)
            continue
        at = np.fromiter((place[f] for f in c), int, len(c))
        v = np.zeros(dimensions)
        np.add.at(v, column[at], (1 + np.log(np.fromiter(c.values(), float, len(c)))) * amount[at])
        size = float(np.sqrt((v * v).sum()))
        out.append((v / size if size else v).tolist())
    return out


@F.pandas_udf(ArrayType(DoubleType()))
def hashing_embedding(tokens: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Embedding of an array of normalised words; null stays null. Encode each distinct text once and join it back."""
    for s in tokens:
        # Parts of a batch, as each holds its distinct buckets.
        yield pd.Series([v for at in range(0, len(s), 512) for v in embedded_batch([None if t is None else list(t) for t in s[at : at + 512]])], index=s.index, dtype=object)
