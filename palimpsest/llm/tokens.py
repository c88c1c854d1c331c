"""Encoding of texts with a public byte-level BPE vocabulary.

A piece of text (the vocabulary's split pattern cuts pieces) is encoded in one
pass: the Aho-Corasick automaton over all tokens gives the longest token at a
byte position; a token may follow another only if merging by rank would keep
the border between the two, which ``Bpe.fits`` checks against the table of
merges and remembers per pair; where no token fits, the encoder steps back to
the next shorter one. That gives the exact result of merging by rank in time
linear in the piece, however long it is.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder with the vocabulary files; a parameter of every operator here.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Pieces up to this many bytes are remembered per Python worker, at most so many of them.
MEMO_BYTES, MEMO_PIECES = 64, 400_000
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Bpe:
    """Encoder and decoder of one vocabulary file of ranks (one base64 token and its id per line)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.token = {i: t for t, i in self.ids.items()}
        self.split = regex.compile(PATTERN).findall
        self.longest = max(map(len, self.ids))
        self.pair: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, list[int]] = {}
        # the automaton works on characters of one byte each
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.halves = self._halves()
        self.prefix = {}  # longest proper prefix that is a token, or -1
        for token, i in self.ids.items():
            self.prefix[i] = next((self.ids[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ids), -1)

    def _halves(self) -> dict[int, tuple[int, int]]:
        """The two tokens whose merge makes a token; (id, id) for a single byte."""
        halves = {}
        for token, i in sorted(self.ids.items(), key=lambda x: x[1]):
            if len(token) == 1:
                halves[i] = (i, i)
                continue
            parts = list(self._merge(token, i))
            halves[i] = (parts[0], parts[1]) if len(parts) == 2 else (i, i)
        return halves

    def _merge(self, token: bytes, below: int) -> list[int]:
        """Merge by rank, using only ranks under ``below``."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 1:
            rank, at = min((self.ids.get(parts[k] + parts[k + 1], below), k) for k in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Would merging by rank leave the border between these two tokens?

        The merge that could cross the border is looked for while both tokens
        are taken apart along their merges, the later merge first.
        """
        known = self.pair.get((left, right))
        if known is None:
            known = self.pair[left, right] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        none = 1 << 60
        limit = none
        while True:
            crossing = self.ids.get(self.token[left] + self.token[right], none)
            if crossing < limit:
                return False
            if left > right:
                limit = left
                outer, inner = self.halves[left]
                if outer == left and inner == left:  # a byte; go on with the right side
                    limit = right + 1
                    first = self.halves[right][0]
                    if first == right:
                        return True
                    right = first
                else:
                    left = inner
            else:
                limit = right + 1
                first, last = self.halves[right]
                if first == right and last == right:
                    limit = left
                    outer, inner = self.halves[left]
                    if inner == left:
                        return True
                    left = inner
                else:
                    right = first

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        # the longest token from each position, from all matches of one pass
        best = [-1] * size
        reach = [0] * size
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            n = len(self.token[i])
            start = end - n + 1
            if n > reach[start]:
                reach[start], best[start] = n, i
        out: list[int] = []
        dead = bytearray(size + 1)
        at, candidate = 0, best[0]
        while True:
            while candidate != -1:
                after = at + len(self.token[candidate])
                if not dead[after] and (not out or self.fits(out[-1], candidate)):
                    break
                candidate = self.prefix[candidate]
            if candidate != -1:
                out.append(candidate)
                at = after
                if at == size:
                    return out
                candidate = best[at]
            else:  # no token from here: this border is no border of the result
                dead[at] = 1
                last = out.pop()
                at -= len(self.token[last])
                candidate = self.prefix[last]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty give []. Strings that look like special tokens are ordinary text."""
        out: list[int] = []
        if not text:
            return out
        memo = self.memo
        for piece in self.split(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= MEMO_BYTES:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out

    def decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """Offset table: the bytes of all tokens in one array, and where each id begins."""
        sizes = np.zeros(max(self.token) + 2, np.int64)
        for i, token in self.token.items():
            sizes[i + 1] = len(token)
        offsets = np.cumsum(sizes)
        data = np.zeros(offsets[-1], np.uint8)
        for i, token in self.token.items():
            data[offsets[i] : offsets[i + 1]] = np.frombuffer(token, np.uint8)
        return data, offsets

    def decode_many(self, lists: list) -> list[str]:
        """Texts of lists of ids, gathered from the offset table in one step."""
        data, offsets = self.decoder() if not hasattr(self, "_table") else self._table
        self._table = data, offsets
        out = []
        for ids in lists:
            ids = np.asarray(ids if ids is not None else [], np.int64)
            sizes = offsets[ids + 1] - offsets[ids]
            ends = np.cumsum(sizes)
            where = np.repeat(offsets[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
            out.append(data[where].tobytes().decode("utf-8", "replace"))
        return out


_loaded: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """The vocabulary at ``path``, loaded once per Python process."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    """Path of a vocabulary file."""
    return f"{folder or TOKENIZER_DIR}/{name}.tiktoken"


def encode(df: DataFrame, keys: list[str], text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """``keys`` and the list of ids of each row's text, one row per row of ``df``.

    Null and empty texts give the empty list. No shuffle: one pass over the
    scanned partitions, Arrow batches in and out.
    """
    path = path or vocabulary()
    schema = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe(path)
        for batch in batches:
            lists = pa.array([encoder.encode(t) for t in batch.column(len(keys)).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], lists], [*keys, out])

    return df.select(*keys, F.col(text).alias("_text")).mapInArrow(run, f"{schema}, `{out}` array<int>")


def decode(df: DataFrame, keys: list[str], ids: str = "ids", out: str = "text", path: str | None = None) -> DataFrame:
    """The texts of lists of ids; a null list gives the empty text."""
    path = path or vocabulary()
    schema = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe(path)
        for batch in batches:
            texts = pa.array(encoder.decode_many(batch.column(len(keys)).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], texts], [*keys, out])

    return df.select(*keys, F.col(ids).alias("_ids")).mapInArrow(run, f"{schema}, `{out}` string")


def count(df: DataFrame, keys: list[str], text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """Number of tokens of each row's text, without moving the ids."""
    path = path or vocabulary()
    schema = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe(path)
        for batch in batches:
            sizes = pa.array([len(encoder.encode(t)) for t in batch.column(len(keys)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], sizes], [*keys, out])

    return df.select(*keys, F.col(text).alias("_text")).mapInArrow(run, f"{schema}, `{out}` bigint")
