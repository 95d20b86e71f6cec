"""Token ids of whole texts by a public byte-level BPE vocabulary.

The ids of a pre-token come from a dynamic programme over its byte prefixes. For every prefix there is exactly one token
with which its encoding ends; that token is found by trying the vocabulary entries that end there, longest first, and
keeping the one that is compatible with the last token of the prefix before it. Two neighbouring tokens are compatible
if merging their bytes from scratch would yield these two again. Walking the stored last tokens backwards gives the ids.
As the entries of a prefix never change when bytes are appended, an append goes on from the stored entries of the last
pre-token and costs only the new bytes, and an edit encodes only the pre-tokens around it anew (`Encoded`).

Defined results: a null text and an empty text both have the empty list of ids. Strings of special tokens inside a text
are ordinary text. Texts of any length are encoded as a whole. Equal rows get equal ids; other columns are kept as they are.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; a parameter of every entry point.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The public pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode White_Space, which the pattern's \s stands for.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_CACHE_ENTRIES = 400_000  # of a worker's memory of chunks; it starts anew when full
_LONG_CHUNK = 64  # longer chunks are not remembered


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixEncoder:
    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        letters, vocab = _byte_letters(), model["vocab"]
        self.ids = {bytes(letters[c] for c in t): i for t, i in vocab.items() if all(c in letters for c in t)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}  # of a mergeable pair
        self.order: dict[int, int] = {i: -1 for i in self.ids.values()}  # of a token: when it comes to be, bytes at once
        for k, (a, b) in enumerate(merges):
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            if pair not in self.rank:
                self.rank[pair] = k
            if made not in self.parts:
                self.parts[made], self.order[made] = pair, k
        self.longest = max(map(len, self.ids))
        self.pieces = regex.compile(PATTERN.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))
        self.irregular = regex.compile(f" (?:[{_SPACE}]|$)")
        self.known: dict[str, list[int]] = {}

    def compatible(self, left: int, right: int, until: int = 1 << 60) -> bool:
        """Whether the bytes of both, merged from scratch before rank `until`, end up as these two tokens: undoing the merges
        on either side of the boundary, latest first, no pair across it may have had its turn before the undone merge."""
        while True:
            if self.rank.get((left, right), 1 << 60) < until:
                return False
            a, b = self.order[left], self.order[right]
            if a < 0 and b < 0:
                return True
            # Merges of one rank run from left to right: a pair across the boundary goes before an equal one in the right token.
            if a > b:
                until, left = a, self.parts[left][1]
            else:
                until, right = b + 1, self.parts[right][0]

    def lasts(self, raw: bytes, known: list[int] | None = None) -> list[int]:
        """The last token of every prefix of `raw`, from the empty one (-1) on; `known` are those of a prefix already done."""
        out = known or [-1]
        ids = self.ids
        for end in range(len(out), len(raw) + 1):
            for start in range(max(0, end - self.longest), end):
                t = ids.get(raw[start:end])
                if t is not None and (self.alone(t) if start == 0 else self.alone(t) and self.compatible(out[start], t)):
                    out.append(t)
                    break
        return out

    @lru_cache(maxsize=60_000)  # noqa: B019 - one encoder lives as long as its process
    def alone(self, t: int) -> bool:
        """Whether the token's own bytes encode to just it."""
        if t not in self.parts:
            return True
        a, b = self.parts[t]
        return self.alone(a) and self.alone(b) and self.compatible(a, b, self.order[t])

    def walk(self, raw: bytes, lasts: list[int]) -> list[int]:
        out, end = [], len(raw)
        while end:
            out.append(t := lasts[end])
            end -= self.width(t)
        return out[::-1]

    def width(self, t: int) -> int:
        if not hasattr(self, "_width"):
            self._width = {i: len(b) for b, i in self.ids.items()}
        return self._width[t]

    def piece(self, text: str) -> list[int]:
        raw = text.encode("utf-8", "replace")
        t = self.ids.get(raw)
        if t is not None and self.alone(t):
            return [t]
        return self.walk(raw, self.lasts(raw))

    def chunk(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for p in self.pieces.findall(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p)
                self.remember(p, ids)
            out += ids
        return out

    def remember(self, text: str, ids: list[int]) -> None:
        if len(text) <= _LONG_CHUNK:
            if len(self.known) >= _CACHE_ENTRIES:
                self.known.clear()
            self.known[text] = ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.irregular.search(text):
            return self.chunk(text)
        # A single blank before something else always begins a pre-token, so the text may be cut there.
        first, *rest = text.split(" ")
        out, known = list(self.chunk(first)) if first else [], self.known
        for c in rest:
            c = " " + c
            ids = known.get(c)
            if ids is None:
                ids = self.chunk(c)
                self.remember(c, ids)
            out += ids
        return out


class Encoded:
    """A text with its pre-tokens and ids, for appends and edits that re-encode only what they touch."""

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder, self.pieces = encoder, encoder.pieces.findall(text)
        self.each = [encoder.piece(p) for p in self.pieces]
        #: The last tokens of all prefixes of the last pre-token, and its bytes, once an append has needed them.
        self.lasts: tuple[bytes, list[int]] = (b"", [-1])

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    @property
    def ids(self) -> list[int]:
        return [i for ids in self.each for i in ids]

    def append(self, more: str) -> None:
        """Pre-tokens before the last one end where they end whatever follows; the last one may go on, and its own prefixes keep
        their last tokens."""
        if not more:
            return
        tail = self.pieces.pop() if self.pieces else ""
        if tail:
            self.each.pop()
        for piece in self.encoder.pieces.findall(tail + more):
            raw = piece.encode("utf-8", "replace")
            done, known = self.lasts
            self.lasts = raw, self.encoder.lasts(raw, known if raw.startswith(done) else None)
            self.pieces.append(piece)
            self.each.append(self.encoder.walk(raw, self.lasts[1]))

    def edit(self, at: int, remove: int, insert: str) -> None:
        """Replaces `remove` characters from `at` on by `insert`. Encoding starts two pre-tokens before the change and goes on
        until a boundary of old and new pre-tokens meets beyond it."""
        text = self.text
        new = text[:at] + insert + text[at + remove :]
        pos = k = 0
        while k < len(self.pieces) and pos + len(self.pieces[k]) < at:
            pos += len(self.pieces[k])
            k += 1
        for _ in range(2):
            if k:
                k -= 1
                pos -= len(self.pieces[k])
        ends, p = {}, sum(map(len, self.pieces[:k]))
        shift = len(insert) - remove
        for j in range(k, len(self.pieces)):
            p += len(self.pieces[j])
            if p >= at + remove + 1:
                ends[p + shift] = j + 1
        pieces, each, resume = [], [], len(self.pieces)
        for m in self.encoder.pieces.finditer(new, pos):
            pieces.append(m[0])
            each.append(self.encoder.piece(m[0]))
            if m.end() in ends:
                resume = ends[m.end()]
                break
        self.pieces[k:resume], self.each[k:resume], self.lasts = pieces, each, (b"", [-1])


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY) -> PrefixEncoder:
    """One per process and vocabulary file."""
    return PrefixEncoder(path)


def token_ids(text: Column, path: str = VOCABULARY) -> Column:
    """array<int>: the ids of each text."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        e, flat, ends = encoder(path), [], [0]
        for t in texts.to_pylist():
            flat += e.encode(t)
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))

    return ids(text)


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """int: how many ids each text has."""

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        e = encoder(path)
        return pa.array([len(e.encode(t)) for t in texts.to_pylist()], pa.int32())

    return count(text)


def encode_corpus(df: DataFrame, text: str = "text", out: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """All rows and columns of `df`, and `out`; a column of that name is replaced. No shuffle."""
    return df.withColumn(out, token_ids(F.col(text), path))
