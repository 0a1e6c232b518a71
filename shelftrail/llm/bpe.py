"""Byte-level BPE as a tree of joins.

A text is halved until a piece is short, pieces are encoded, and neighbours are joined on the way up. An encoding keeps
its pre-tokens (the matches of the split pattern) with their ids, and two of them are joined by encoding again only a
window around the seam:

* Pre-tokens. The pattern is matched from left to right and looks at most `REACH` characters past a match, so all
  matches of the left half that end `REACH` before the seam stand whatever follows. Matching starts anew behind the last
  of those; as soon as one of the new matches ends where a match of the right half ends, both matchers are in the same
  state and everything behind it stands too. If they do not meet inside the window, it grows.
* Inside one long pre-token the same is done on bytes: merged ids are a valid encoding exactly when each two neighbours
  are one (the pair encodes to itself), so a window is encoded anew and grown until its first and last pairs are valid.

Decoding concatenates bytes up the same tree. Texts are rows of a DataFrame; each is encoded in its own task with memory
in proportion to it.

Defined cases: a null text is empty; an empty text has no ids; special tokens are ordinary text; repeated rows are
encoded each for themselves; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import in_pieces, map_arrow

#: Pieces of up to this many characters are encoded whole.
LEAF_CHARS = 1024
#: Pre-tokens longer than this are halved too.
LONG_BYTES = 256
#: "'re" can become one match only when all three characters are there, and white space looks one further.
REACH = 3
#: Bytes, about, that a worker spends on the encoded pre-tokens it remembers, and as many again on pairs of ids.
REMEMBERED_BYTES = 40 << 20
#: What an entry takes besides its characters and ids, and what a pair takes: measured, with the tables' free places.
TOKEN_BYTES, PAIR_BYTES = 175, 100

#: Letters, numbers and white space up to U+00FF, and with them the split pattern of the rank files for such texts.
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\\t-\\r \u0085\u00a0"
LATIN_PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class BytePairEncoder:
    """Encodes and decodes with given ranks; `pattern` splits a text before any merge."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.findall = self.split.findall
        if pattern == public_tokenizers.PATTERN:  # most texts hold Latin-1 characters only, where `re` can say the same
            latin = re.compile(LATIN_PATTERN)
            self.findall = lambda text: (latin if _is_latin(text) else self.split).findall(text)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.bytes_of[i] = piece
        #: Ids of pre-tokens as bytes, which take little room and are put together without a number being made.
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0
        self.code, self.kind = ("H", "u2") if len(self.bytes_of) <= 1 << 16 else ("I", "u4")
        #: Whether pairs are valid, by first id << 32 | second id.
        self.checked: dict[int, bool] = {}
        #: The most bytes of a token, by its first two.
        self.longest: dict[bytes, int] = {}
        for piece in ranks:
            self.longest[piece[:2]] = max(self.longest.get(piece[:2], 1), len(piece))

    # -- bytes of one pre-token

    def _search(self, piece: bytes) -> list[int]:
        """Ids of which each two neighbours are valid, longest tokens tried first: there is just one such sequence.

        So has every beginning of the piece, and a place from which nothing led on is never tried again.
        """
        out, starts, at, get, checked, longest, n = [], [], 0, self.ranks.get, self.checked, self.longest.get, len(piece)
        end, dead = min(n, longest(piece[:2], 1)), set()
        while at < n:
            last = out[-1] if out else None
            while end > at:
                token = get(piece[at:end]) if end not in dead else None
                if token is not None:
                    if last is None:
                        break
                    good = checked.get(last << 32 | token)
                    if good or good is None and self.valid(last, token):
                        break
                end -= 1
            if end > at:
                out.append(token)
                starts.append(at)
                at = end
                end = min(n, at + longest(piece[at : at + 2], 1))
            elif out:  # nothing fits behind the last token: a shorter one in its place
                dead.add(at)
                out.pop()
                end = at - 1
                at = starts.pop()
            else:  # ranks that no merges made
                return self._merge(piece, search=False)
        return out

    def valid(self, a: int, b: int) -> bool:
        """Whether a pair of ids encodes to itself."""
        good = self.checked.get(a << 32 | b)
        if good is None:
            good = self._merge(self.bytes_of[a] + self.bytes_of[b], search=False) == [a, b]
            if len(self.checked) * PAIR_BYTES >= REMEMBERED_BYTES:
                self.checked.clear()
            self.checked[a << 32 | b] = good
        return good

    def _merge(self, piece: bytes, search: bool = True) -> list[int]:
        """The ids of a piece. Without `search`, as they are defined: the pair of lowest rank is merged again and again."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if search:
            return self._search(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        inf = len(ranks) + 1
        pair = [ranks.get(parts[i] + parts[i + 1], inf) for i in range(len(parts) - 1)]
        while pair:
            low = min(pair)
            if low == inf:
                break
            i = pair.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], inf)
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], inf)
        return [ranks[p] for p in parts]

    def _join_ids(self, left: list[int], right: list[int]) -> list[int]:
        size = 1
        while left and right and not self.valid(left[-1], right[0]):
            a, b = max(0, len(left) - size), min(len(right), size)
            window = self._merge(b"".join(map(self.bytes_of.__getitem__, left[a:] + right[:b])))
            if (a == 0 or self.valid(left[a - 1], window[0])) and (b == len(right) or self.valid(window[-1], right[b])):
                return left[:a] + window + right[b:]
            size *= 2
        return left + right

    def encode_piece(self, piece: bytes) -> list[int]:
        if len(piece) <= LONG_BYTES:
            return self._merge(piece)
        half = len(piece) // 2
        return self._join_ids(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    def _ids(self, token: str) -> bytes:
        ids = self.known.get(token)
        if ids is None:
            ids = array(self.code, self.encode_piece(token.encode("utf-8"))).tobytes()
            if len(token) <= 64:
                if self.known_bytes >= REMEMBERED_BYTES:
                    self.known.clear()
                    self.known_bytes = 0
                self.known[token] = ids
                self.known_bytes += TOKEN_BYTES + len(token) + len(ids)
        return ids

    # -- pre-tokens of a text; an encoding is the list of them

    def _join_tokens(self, left: list[str], right: list[str]) -> list[str]:
        if not left or not right:
            return left + right
        loose, keep = 0, len(left)
        while keep and (loose < REACH or keep == len(left)):
            keep -= 1
            loose += len(left[keep])
        take, span = 0, ""
        grow = 8
        while True:
            more = right[take : take + grow]
            take += len(more)
            grow *= 2
            span = "".join(left[keep:]) + "".join(right[:take])
            ends, at = set(), loose
            for t in right[:take]:
                at += len(t)
                ends.add(at)
            whole, fresh, at = take == len(right), [], 0
            for m in self.split.finditer(span):
                if m.end() + REACH > len(span) and not whole:
                    break
                fresh.append(m.group())
                at = m.end()
                if at in ends and at >= loose:
                    break
            else:
                if whole:
                    return left[:keep] + fresh
                continue
            if at in ends and at >= loose:
                skip, end = 0, loose
                while end < at:
                    end += len(right[skip])
                    skip += 1
                return left[:keep] + fresh + right[skip:]

    def pretokens(self, text: str) -> list[str]:
        if len(text) <= LEAF_CHARS:
            return self.findall(text)
        half = len(text) // 2
        return self._join_tokens(self.pretokens(text[:half]), self.pretokens(text[half:]))

    def encode(self, text: str) -> np.ndarray:
        known, make = self.known.get, self._ids
        return np.frombuffer(b"".join([known(t) or make(t) for t in self.pretokens(text)]), self.kind).astype("<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, halves concatenated."""
        if len(ids) <= 8 * LEAF_CHARS:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoder(vocabulary: str = "byte_bpe_50k.tiktoken") -> BytePairEncoder:
    """One encoder per worker process. A vocabulary is a name of the installed public tokenizers or a path."""
    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    return BytePairEncoder(read_ranks(path), public_tokenizers.PATTERN)


def per_text(docs: DataFrame, columns: list[str], schema: str, make: Callable[[str], tuple]) -> DataFrame:
    """`columns` of `docs` beside what `make` gives for each whole text (null: empty), in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        for b in in_pieces(batches):
            made = [make(t or "") for t in b.column(0).to_pylist()]
            out = [pa.array(list(x)) for x in zip(*made, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *out], names=[*columns, *names])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema]
    some = docs.select(F.col("text").cast("string").alias("_text"), *columns)
    return map_arrow(some, run, ", ".join([*kept, schema]))


def encode_texts(docs: DataFrame, columns: list[str], vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """`columns`, n_tokens, ids (array of int) and decoded (binary) for every row of `docs`."""

    def make(text: str) -> tuple:
        enc = encoder(vocabulary)
        ids = enc.encode(text)
        return len(ids), ids.astype(np.int32), enc.decode(ids)

    return per_text(docs, columns, "n_tokens long, ids array<int>, decoded binary", make)


def encode_digests(docs: DataFrame, columns: list[str], vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """`columns`, n_tokens, ids_sha256 and decoded_sha256 (of the ids decoded again) for every row of `docs`."""

    def make(text: str) -> tuple:
        enc = encoder(vocabulary)
        ids = enc.encode(text)
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest()

    return per_text(docs, columns, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
