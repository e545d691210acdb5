"""BPE encoding and decoding with a tokenization automaton.

The merges of a word-level BPE vocabulary are compiled into a deterministic automaton over tokens: it begins with
one state and a loop for every symbol, and one merge gadget after another turns it into the automaton that accepts
exactly the token sequences BPE produces. Encoding a pre-split word is a walk along its arcs, decoding emits the
arcs' labels.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm._common import each_text, kept, make_room

#: Pre-split words of text that is lower-case and within Latin-1, by the vocabulary's own pattern.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t-\r \x85\xa0a-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+")
#: Latin-1 capitals would be letters too; text is lowered before, so none remain.


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class MergeAutomaton:
    """Deterministic automaton of the token sequences that a list of merges yields.

    The gadget of merge ``u v -> w`` sends every ``u`` arc to a copy of its target that lacks the ``v`` arc, and
    adds a ``w`` arc, to the target of that ``v`` arc, beside every ``u`` arc. A state is thus entered by one token
    only, and a copy differs from its original by one arc: states are kept as their original, the arc removed and
    the number of the gadget. Outgoing arcs are worked out when first needed and kept in a table.
    """

    def __init__(self, symbols: list[str], merges: list[tuple[str, str]]):
        n = len(symbols)
        self.label = [*symbols, *(a + b for a, b in merges)]
        self.token = {s: i for i, s in enumerate(self.label)}
        self.state = [0] * len(self.label)  # the state that a token's arcs enter
        self.origin, self.removed, self.gadget = [-1], [-1], [-1]
        self.born = [-1] * len(self.label)  # the gadget that added a token's arcs
        self.left = [-1] * len(self.label)
        self.copies: dict[tuple[int, int], int] = {}
        entered = [-1]  # the token whose copies a state belongs to
        for i, (a, b) in enumerate(merges):
            u, v, w = self.token[a], self.token[b], n + i
            self.state[w] = self.state[v]
            self.origin.append(self.state[u])
            self.removed.append(v)
            self.gadget.append(i)
            entered.append(u)
            self.state[u] = len(self.origin) - 1
            self.copies[u, v] = i
            self.born[w], self.left[w] = i, u
        self._chains(entered)
        self.arcs: dict[int, bool] = {}

    def _chains(self, entered: list[int]) -> None:
        """For each state, the tokens whose gadgets made it or an original of it, with the last gadget of each."""
        self.made: list[tuple[tuple[int, int], ...]] = [()] * len(self.origin)
        for s in range(1, len(self.origin)):
            before = self.made[self.origin[s]]
            mine = (entered[s], self.gadget[s])
            self.made[s] = (mine, *(before[1:] if before and before[0][0] == entered[s] else before))

    def arc(self, last: int, token: int) -> bool:
        """Whether the state that ``last`` enters has an arc for ``token`` (``last`` -1: the first state)."""
        if last < 0:
            return True
        key = last << 20 | token
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) > 300_000:
                self.arcs.clear()
            known = self.arcs[key] = self._has(self.state[last], token)
        return known

    def _has(self, state: int, token: int) -> bool:
        added = len(self.origin)  # a token has the arcs that its left part had when it was added
        while token >= 0:
            for u, until in self.made[state]:
                i = self.copies.get((u, token))
                if i is not None and i <= until and i <= added:
                    return False
            added, token = self.born[token], self.left[token]
        return True

    def index(self, end: str) -> None:
        """Arcs by the symbols they spell: last arcs, whose label has ``end``, and a trie of the inner ones."""
        self.last = {s.removesuffix(end): t for s, t in self.token.items() if s.endswith(end)}
        self.trie: dict = {}
        for s, t in self.token.items():
            if not s.endswith(end):
                node = self.trie
                for c in s:
                    node = node.setdefault(c, {})
                node[""] = t

    def encode(self, symbols: str) -> list[int]:
        """Tokens on the only path that spells ``symbols`` and ends with a last arc; longest arcs are tried first."""
        n, trie, final, arc, arcs = len(symbols), self.trie, self.last, self.arc, self.arcs
        path: list[int] = []
        # Where a step began, the inner arcs left to try there; None: all that are shorter than its own.
        steps: list[tuple[int, list[tuple[int, int]] | None]] = []
        i, last = 0, -1
        while True:  # mostly the longest arcs will do
            t = final.get(symbols[i:] if i else symbols)
            if t is None:
                node, longest, j = trie, None, i
                for c in symbols[i:-1]:
                    node = node.get(c)
                    if node is None:
                        break
                    j += 1
                    if "" in node:
                        longest, end = node, j
                if longest is None:
                    break
                t = longest[""]
            else:
                end = n
            if last >= 0:
                known = arcs.get(last << 20 | t)
                if not (arc(last, t) if known is None else known):
                    break
            path.append(t)
            if end == n:
                return path
            steps.append((i, None))
            i, last = end, t
        dead: set[tuple[int, int]] = set()
        while True:  # on from there, as there is one path only
            t = final.get(symbols[i:])
            if t is not None:
                known = True if last < 0 else arcs.get(last << 20 | t)
                if arc(last, t) if known is None else known:
                    path.append(t)
                    return path
            steps.append((i, self._inner(symbols, i, n - 1)))
            while True:
                beyond, (i, left) = i, steps[-1]
                if left is None:
                    left = self._inner(symbols, i, beyond - 1)
                    steps[-1] = i, left
                last = path[-1] if path else -1
                found = False
                while left:
                    j, t = left.pop()
                    known = True if last < 0 else arcs.get(last << 20 | t)
                    if (arc(last, t) if known is None else known) and (not dead or (j, t) not in dead):
                        found = True
                        break
                if found:
                    path.append(t)
                    i, last = j, t
                    break
                steps.pop()
                if not steps:
                    raise ValueError(f"no path spells {symbols!r}")
                dead.add((i, path.pop()))

    def _inner(self, symbols: str, i: int, end: int) -> list[tuple[int, int]]:
        """Ends, ``end`` at most, and tokens of the inner arcs that spell what follows ``i``, shortest first."""
        node, out = self.trie, []
        for j in range(i, end):
            node = node.get(symbols[j])
            if node is None:
                break
            if "" in node:
                out.append((j + 1, node[""]))
        return out


class WordCodec:
    """Encoder and decoder for one ``tokenizers`` file with an end-of-word BPE model, as that library has them."""

    #: Words, and white-space-separated pieces, whose ids are remembered; those that weren't met again while half as many new
    #: ones were are forgotten.
    REMEMBERED = 500_000

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.alphabet = byte_alphabet()
        vocab = model["vocab"]
        self._compile(model)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.small = size <= 1 << 16  # whether ids fit in 16 bits
        self.labels = [b""] * size
        for s, i in [*vocab.items(), *self.special.items()]:
            self.labels[i] = s.encode()
        self.decimals = [b"%d" % i for i in range(size)]
        self.of_bytes = str.maketrans({chr(b): c for b, c in enumerate(self.alphabet)})
        self.specials = re.compile("|".join(map(re.escape, self.special)))
        self.marks = [s.encode() for s in self.special]
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        codec = self

        class Pieces(dict):
            older: dict[bytes, bytes] = {}

            def __missing__(self, piece: bytes) -> bytes:
                if len(self) >= codec.REMEMBERED // 2:
                    self.older = dict(self)
                    self.clear()
                ids = self.older.get(piece)
                if ids is None:
                    ids = codec._piece(piece.decode())
                self[piece] = ids
                return ids

        self.pieces = Pieces()

    def _compile(self, model: dict) -> None:
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        symbols = [c + e for c in self.alphabet for e in ("", self.end)]
        self.automaton = MergeAutomaton(symbols, merges)
        self.automaton.index(self.end)
        self.ids = [model["vocab"][s].to_bytes(4, "little") for s in self.automaton.label]

    def _merged(self, symbols: str) -> bytes:
        """Ids of a word that isn't remembered."""
        return b"".join([self.ids[t] for t in self.automaton.encode(symbols)])

    @functools.cached_property
    def library(self):
        """The library's tokenizer, whose normalizer and pre-tokenizer serve text beyond Latin-1."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _word(self, word: str) -> bytes:
        """Ids of a pre-split word as little-endian 32-bit numbers."""
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= self.REMEMBERED // 2:
                self.older, self.words = self.words, {}
            ids = self.older.get(word)
            if ids is not None:
                self.words[word] = ids
                return ids
            symbols = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.of_bytes)
            ids = self.words[word] = self._merged(symbols)
        return ids

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            if piece[-1] > "\xff" or max(piece) > "\xff" or not unicodedata.is_normalized("NFC", piece):
                piece = self.library.normalizer.normalize_str(piece)
            else:
                piece = piece.lower()
            if max(piece, default="") > "\xff":
                back = {c: b for b, c in enumerate(self.alphabet)}
                split = [bytes(back[c] for c in w).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(piece)]
                return b"".join(map(self._word, split))
        if piece.isalpha():
            return self._word(piece)
        return b"".join(map(self._word, _WORD.findall(piece)))

    def encode(self, text: bytes) -> bytes:
        """Ids of a text in UTF-8 as little-endian 32-bit numbers."""
        if any(m in text for m in self.marks):
            out, at, whole = [], 0, text.decode()
            for m in self.specials.finditer(whole):
                out += [self._plain(whole[at : m.start()].encode()), np.array([self.special[m[0]]], "<u4").tobytes()]
                at = m.end()
            return b"".join([*out, self._plain(whole[at:].encode())])
        return self._plain(text)

    def _plain(self, text: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, text.lower().split()))

    def decode(self, ids: list[int]) -> bytes:
        """The arcs' labels joined as the library joins tokens when a file names no decoder: by spaces."""
        return b" ".join(map(self.labels.__getitem__, ids))


class LibraryCodec(WordCodec):
    """The same, with the library's own merges for words that aren't remembered: no automaton is compiled or kept."""

    def _compile(self, model: dict) -> None:
        self.model = self.library.model
        self.ids = {i: i.to_bytes(4, "little") for i in model["vocab"].values()}

    def _merged(self, symbols: str) -> bytes:
        return b"".join([self.ids[t.id] for t in self.model.tokenize(symbols)])


_codecs = kept("codecs")


def codec(path: str, kind: type[WordCodec] = WordCodec) -> WordCodec:
    """The codec of a vocabulary file, compiled once in each Python worker."""
    if (path, kind) not in _codecs:
        _codecs[path, kind] = kind(path)
        make_room()  # of the file's contents
    return _codecs[path, kind]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``id_col``, ``ids`` (array<int>): ids of each whole text. Null and empty texts have no ids; repeated
    rows are encoded each on its own; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            flat = [c.encode(t) for t in each_text(b.column(1))]
            offsets = np.cumsum([0, *(len(x) // 4 for x in flat)]).astype("int32")
            ids = pa.array(np.frombuffer(b"".join(flat), "<u4").astype("int32"))
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), ids)], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode_ids(frame: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Columns ``id_col``, ``text``: the labels of an array of ids. Null arrays decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            out = [c.decode(x or []).decode() for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(out, pa.string())], names=[id_col, "text"])

    return frame.select(id_col, ids_col).mapInArrow(run, f"{id_col} {dict(frame.dtypes)[id_col]}, text string")


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: encodes each whole text and decodes the ids
    again, keeping only digests, so that neither ids nor texts leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, first, second = [], [], []
            for t in each_text(b.column(1)):
                ids = np.frombuffer(c.encode(t), "<u4").tolist()
                n.append(len(ids))
                first.append(hashlib.sha256(b" ".join(map(c.decimals.__getitem__, ids))).hexdigest())
                second.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(first), pa.array(second)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
