"""Corpus encoding with a public byte-level BPE vocabulary.

Each pre-token is encoded by backtracking: one scan of an Aho-Corasick automaton over the vocabulary finds the longest
token that starts at every position; a token may follow another only if the pair is compatible, that is, if BPE would
not have merged across the border first, which tables of merges and of the tokens' edges tell; if no token fits, the
last one is taken back. A position is never tried twice, so the time is linear in the text, and the ids are exactly those
of the merge procedure. Decoding copies slices out of one byte string by an offset table.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finloom.plans.runtime import spread

#: Where the public vocabularies are installed; a parameter everywhere.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The vocabulary's published pre-token pattern with white space spelled out (Unicode's White_Space, which
# Python's \\s is not), and what the pattern is over ASCII only.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"

#: Pre-tokens that one Python worker remembers before it forgets them all.
MEMO = 400_000


class Encoder(dict):
    """Maps a pre-token to its ids; as a dict it remembers what it has encoded."""

    def __init__(self, raw: bytes):
        import ahocorasick
        import regex

        super().__init__()
        pairs = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in raw.splitlines() if line)]
        self.token = [t for t, _ in sorted(pairs, key=lambda p: p[1])]
        self.id = {t: i for i, t in enumerate(self.token)}
        self.auto = ahocorasick.Automaton()
        for t, i in self.id.items():
            self.auto.add_word(t.decode("latin-1"), (len(t), i))
        self.auto.make_automaton()
        # The offset table: token i is blob[offset[i]:offset[i + 1]].
        self.blob = b"".join(self.token)
        self.offset = np.concatenate([[0], np.cumsum([len(t) for t in self.token])])
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = []
        self.shorter: list[int] = []
        self.pair_memo: dict[tuple[int, int], bool] = {}
        self.right: list[tuple[int, ...]] = []
        self.left: list[tuple[int, ...]] = []
        self._tables()
        self.wide = regex.compile(PATTERN).findall
        self.narrow = re.compile(ASCII_PATTERN).findall

    def _tables(self) -> None:
        """For every token the longest token that is a proper prefix of it, the two tokens that merge into it, and its
        edges: the tokens at its right and at its left border as its merges are undone one after the other."""
        for i, t in enumerate(self.token):
            n = len(t) - 1
            while n and t[:n] not in self.id:
                n -= 1
            self.shorter.append(self.id[t[:n]] if n else -1)
        for i, t in enumerate(self.token):
            left, found = self.shorter[i], (i, i)
            while left >= 0:
                right = self.id.get(t[len(self.token[left]) :], -1)
                if 0 <= right < i and left < i and self._fits(left, right):
                    found = (left, right)
                    self.merged[found] = i
                    break
                left = self.shorter[left]
            self.halves.append(found)
            self.left.append((i, *self.left[found[0]]) if found[0] != i else (i,))
            self.right.append((i, *self.right[found[1]]) if found[1] != i else (i,))

    def _fits(self, a: int, b: int) -> bool:
        """Whether BPE leaves the border between tokens a and b alone: along the right edge of a and the left edge of b,
        latest merge first, whether some earlier merge would have crossed the border."""
        ends, begins, i, j, before, merged = self.right[a], self.left[b], 0, 0, 1 << 60, self.merged
        while True:
            a, b = ends[i], begins[j]
            m = merged.get((a, b))
            if m is not None and m < before:
                return False
            more_a, more_b = i + 1 < len(ends), j + 1 < len(begins)
            if more_a and (a > b or not more_b):
                before, i = a, i + 1
            elif more_b:
                before, j = b + 1, j + 1
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        key = (a, b)
        got = self.pair_memo.get(key)
        if got is None:
            if len(self.pair_memo) > MEMO:
                self.pair_memo.clear()
            got = self.pair_memo[key] = self._fits(a, b)
        return got

    def __missing__(self, piece: str) -> list[int]:
        ids = self.encode_bytes(piece.encode("utf-8"))
        if len(self) >= MEMO:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode_bytes(self, data: bytes) -> list[int]:
        whole = self.id.get(data)
        if whole is not None:
            return [whole]
        n, token, shorter = len(data), self.token, self.shorter
        # The longest token from every position: at equal starts the automaton reports the longer one later.
        longest = [-1] * n
        for end, (size, i) in self.auto.iter(data.decode("latin-1")):
            longest[end - size + 1] = i
        # open_[p] is False once it is known that no valid encoding passes through p.
        open_, out, at = bytearray(b"\x01") * (n + 1), [], 0
        now = longest[0]
        while at < n or not out:
            last = out[-1] if out else -1
            while True:
                end = at + len(token[now])
                if open_[end] and (last < 0 or self.compatible(last, now)):
                    out.append(now)
                    at = end
                    now = longest[at] if at < n else -1
                    break
                if shorter[now] >= 0:
                    now = shorter[now]
                    continue
                open_[at] = 0
                now = out.pop()
                at -= len(token[now])
                break
        return out

    def pieces(self, text: str) -> list[str]:
        return self.narrow(text) if text.isascii() else self.wide(text)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.pieces(text)))) if text else []

    def decode(self, ids) -> bytes:
        o, blob = self.offset, self.blob
        return b"".join(blob[o[i] : o[i + 1]] for i in ids)


_ENCODERS: dict[int, Encoder] = {}


def encoder(raw: bytes) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    key = hash(raw)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(raw)
    return _ENCODERS[key]


def encode_corpus(documents: DataFrame, path: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and the token ids of ``text_col`` for every row.

    Null and empty texts give an empty list (never null); blank texts give the ids of their white space. Special
    tokens' strings are ordinary text. Repeated rows each give a row; other columns are ignored, whatever their names.
    The driver reads the vocabulary (its size is fixed by the tokenizer) and broadcasts it; the work is one pass of
    Arrow batches without a shuffle.
    """
    with open(path, "rb") as f:
        raw = documents.sparkSession.sparkContext.broadcast(f.read())
    kind = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        get = enc.__getitem__
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lists = [np.fromiter(chain.from_iterable(map(get, enc.pieces(t))), np.int32) if t else np.empty(0, np.int32) for t in texts]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.concatenate(lists) if lists else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)).cast(kind)], names=["_id", ids_col])

    src = spread(documents.select(documents[id_col].alias("_id"), documents[text_col].alias("_text")))
    schema = T.StructType([T.StructField("_id", documents.schema[id_col].dataType), T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    return src.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def decode_corpus(encoded: DataFrame, path: str = TOKENIZER, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The texts back from their ids, by the offset table. A null list gives an empty text."""
    with open(path, "rb") as f:
        raw = encoded.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def back(ids: pd.Series) -> pd.Series:
        dec = encoder(raw.value).decode
        return ids.map(lambda x: "" if x is None else dec(x).decode("utf-8", "replace"))

    return encoded.withColumn(text_col, back(ids_col))
