"""Secret scans: patterns of known kinds, and a battery of randomness tests on encoded-looking strings with a
length-aware control of false discoveries."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import written

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_NAMED = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CODED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
KINDS = ("assign", "access", "hex", "random")

#: Upper ends of length classes, in characters.
CLASSES = (24, 32, 48, 64, 128)
#: Classes of p-values: powers of ten, the last open.
BINS = 16
#: Power of ten of the share of strings that aren't random which the first class of p-values admits, at least.
LEAST_SHARE = -4


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans ``(start, kind, end)`` of the base patterns in code points, by start, then kind as in ``KINDS``."""
    out = []
    if _NAMED.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _normal(z: float) -> float:
    """Two-sided tail of the standard normal distribution."""
    return math.erfc(abs(z) / math.sqrt(2))


def _chi(x: float, freedom: int) -> float:
    """Upper tail of the chi-squared distribution, by the cube-root approximation."""
    if freedom < 1:
        return 1.0
    z = ((x / freedom) ** (1 / 3) - (1 - 2 / (9 * freedom))) / math.sqrt(2 / (9 * freedom))
    return 0.5 * math.erfc(z / math.sqrt(2))


#: Alphabets of encodings, in their order, smallest first, as cells for the test of uniformity.
_ALPHABETS = (
    ("0123456789abcdef", ("01234567", "89", "abcdef")),
    ("0123456789ABCDEF", ("01234567", "89", "ABCDEF")),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ("ABCDEFGHIJKLM", "NOPQRSTUVWXYZ", "234567")),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", ("ABCDEFGHIJKLM", "NOPQRSTUVWXYZ", "0123456789")),
    ("abcdefghijklmnopqrstuvwxyz0123456789", ("abcdefghijklm", "nopqrstuvwxyz", "0123456789")),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789")),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789+/-_")),
)


def randomness(s: str) -> float:
    """P-value of the battery for a string under the hypothesis that it is random in the smallest alphabet it fits:
    uniformity of letters and of kinds of letters, runs above and below the median letter, correlation of
    neighbours; combined by Fisher's method."""
    own = set(s)
    alphabet, cells = next((a for a in _ALPHABETS if own <= set(a[0])), _ALPHABETS[-1])
    place = {c: i for i, c in enumerate(alphabet)}
    values = [place.get(c, 0) for c in s]
    n, size = len(s), len(alphabet)
    expected = [n * len(c) / size for c in cells]
    kinds = _chi(sum((sum(map(s.count, c)) - e) ** 2 / e for c, e in zip(cells, expected)), len(cells) - 1)
    letters = _chi(sum(s.count(c) ** 2 for c in own) * size / n - n, size - 1)
    high = [v >= size / 2 for v in values]
    up = sum(high)
    if 0 < up < n:
        crossings = sum(a != b for a, b in zip(high, high[1:]))
        mean = 2 * up * (n - up) / n
        spread = math.sqrt(max(1e-9, mean * (mean - 1) / (n - 1)))
        runs = _normal((crossings - mean) / spread)
    else:
        runs = 2.0 ** (1 - n)
    middle = sum(values) / n
    power = sum((v - middle) ** 2 for v in values)
    serial = _normal(sum((a - middle) * (b - middle) for a, b in zip(values, values[1:])) / power * math.sqrt(n)) if power else 0.0
    x = -sum(math.log(max(p, 1e-30)) for p in (min(1.0, 2 * min(kinds, letters)), runs, serial))
    return math.exp(-x) * (1 + x + x * x / 2)


def candidates(text: str) -> list[tuple[int, int, int, int, bool]]:
    """Encoded-looking strings of 20 characters or more: start, end, length class, p-value class, and whether it is a
    decoy: letters only, at most the first a capital, as natural words are."""
    out = []
    for m in _CODED.finditer(text):
        s = m[0].rstrip("=")
        decoy = s.isalpha() and s[1:].islower()
        p = randomness(s)
        out.append((m.start(), m.end(), sum(len(s) >= c for c in CLASSES), min(BINS - 1, int(-math.log10(max(p, 1e-30)))), decoy))
    return out


def find_secrets(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """Secrets in every whole text: a row per document with ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``,
    ``base_sha256``, ``spans`` (``kind:start:end``, comma-joined) and ``n_random``.

    Base patterns are always reported. Encoded-looking strings are added as ``random`` where the battery doesn't
    reject randomness: natural words, put through the same battery, show which share of what isn't random passes the
    tests at each length, and a length class admits p-values down to the point where its discoveries would be false
    at more than ``rate``. That share is taken as 10^-4 at least for p-values over 0.1, and ten times as much for each
    power of ten below: one rule, with and without words to learn from, that depends on shares and not on counts. Offsets are code points, ends exclusive. Null and empty texts have no spans; repeated rows are
    scanned each on its own; extra columns are ignored; an empty table gives an empty result.
    """
    span = "array<struct<start:int,kind:int,end:int>>"
    found = "array<struct<start:int,end:int,size:int,bin:int,decoy:boolean>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        more_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("size", pa.int32()), ("bin", pa.int32()), ("decoy", pa.bool_())]))
        for b in batches:
            base, digest, more = [], [], []
            for t in b.column(1).to_pylist():
                spans = base_spans(t or "")
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                digest.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest())
                more.append([dict(zip(("start", "end", "size", "bin", "decoy"), c)) for c in candidates(t or "")])
            yield pa.record_batch([b.column(0), pa.array(base, base_type), pa.array(digest), pa.array(more, more_type)], names=["doc_id", "base", "base_sha256", "found"])

    scanned = written(docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, base {span}, base_sha256 string, found {found}"))
    # Classes of length and p-value, decoy or not: a table of a few hundred rows at most.
    table = scanned.select(F.explode("found").alias("c")).groupBy("c.size", "c.bin", "c.decoy").count().collect()
    n = {(r["size"], r["bin"], r["decoy"]): r["count"] for r in table}
    cut = []
    for size in range(len(CLASSES) + 1):
        decoys = targets = 0
        all_decoys = sum(n.get((size, b, True), 0) for b in range(BINS))
        most = -1
        for b in range(BINS):
            decoys, targets = decoys + n.get((size, b, True), 0), targets + n.get((size, b, False), 0)
            share = max(decoys / all_decoys if all_decoys else 0.0, 10.0 ** (b + LEAST_SHARE))
            false = min(1.0, share) * sum(n.get((size, x, False), 0) for x in range(BINS))
            if targets and b < BINS - 1 and false <= rate * targets:
                most = b
        cut.append(most)
    limits = F.array(*map(F.lit, cut))
    random = F.filter("found", lambda c: ~c["decoy"] & (c["bin"] <= F.element_at(limits, c["size"] + 1)))
    more = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))
    text = F.transform(F.array_sort(F.concat("base", more)), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), "base_sha256", F.array_join(text, ",").alias("spans"), F.size(random).cast("long").alias("n_random"))
