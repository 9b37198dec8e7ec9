"""p6: token ids of a whole corpus by a byte-level BPE rank file.

Each text is cut by the tokenizer's pattern, and each *distinct* word is merged once per worker: the word's
part boundaries and the ranks of adjacent parts sit in two contiguous arrays, the minimum rank is found by a
scan, its boundary is deleted and the two neighbouring ranks are refreshed. The scan is quadratic in the word,
so words beyond ``SHORT_WORD`` bytes keep the same arrays as linked lists under a heap.

Null and empty texts give an empty list. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that goes with the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT_WORD = 160
#: Distinct words a worker remembers; the memory is emptied, never the work, when it is full.
MEMO_WORDS = 400_000
_NONE = 1 << 60
_ENCODERS: dict[str, "RankEncoder"] = {}


class RankEncoder(dict):
    """Maps a word to the little-endian int32 bytes of its ids; unknown words are encoded on first use."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.findall = regex.compile(PATTERN).findall

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        raw = word.encode("utf-8", "surrogatepass")
        ids = np.array(self.merge(raw), dtype="<i4").tobytes()
        if len(raw) <= SHORT_WORD:
            self[word] = ids
        return ids

    def merge(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        return self._merge_short(raw) if len(raw) <= SHORT_WORD else self._merge_long(raw)

    def _merge_short(self, raw: bytes) -> list[int]:
        rank = self.ranks.get
        edge = list(range(len(raw) + 1))
        pair = [rank(raw[i : i + 2], _NONE) for i in range(len(raw) - 1)]
        while pair:
            least = min(pair)
            if least == _NONE:
                break
            at = pair.index(least)
            del edge[at + 1], pair[at]
            if at < len(pair):
                pair[at] = rank(raw[edge[at] : edge[at + 2]], _NONE)
            if at:
                pair[at - 1] = rank(raw[edge[at - 1] : edge[at + 1]], _NONE)
        return [self.ranks[raw[a:b]] for a, b in zip(edge, edge[1:])]

    def _merge_long(self, raw: bytes) -> list[int]:
        rank, n = self.ranks.get, len(raw)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, left, end = heapq.heappop(heap)
            mid = after[left] if alive[left] else n
            if mid >= n or after[mid] != end:
                continue
            alive[mid] = False
            after[left] = end
            if end < n:
                before[end] = left
                if (r := rank(raw[left : after[end]])) is not None:
                    heapq.heappush(heap, (r, left, after[end]))
            prev = before[left]
            if prev >= 0 and (r := rank(raw[prev:end])) is not None:
                heapq.heappush(heap, (r, prev, end))
        ids, at = [], 0
        while at < n:
            ids.append(self.ranks[raw[at : after[at]]])
            at = after[at]
        return ids

    def encode(self, text: str | None) -> bytes:
        return b"".join([self[w] for w in self.findall(text)]) if text else b""


def encoder(path: str) -> RankEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = RankEncoder(path)
    return _ENCODERS[path]


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(id, ids): the list of token ids of every row's text; other columns are ignored. No shuffle."""
    src = df.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("_ll_text"))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(ranks)
        for whole in batches:
            for batch in _slices(whole):
                raw = [enc.encode(t) for t in batch.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, raw)]) // 4
                flat = pa.array(np.frombuffer(b"".join(raw), dtype="<i4"))
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, "ids"])

    return src.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(id, n_tokens): as :func:`encode_ids`, but only the number of ids leaves the worker."""
    src = df.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("_ll_text"))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(ranks)
        for whole in batches:
            for batch in _slices(whole):
                n = pa.array([len(enc.encode(t)) // 4 for t in batch.column(1).to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), n], [id_col, "n_tokens"])

    return src.mapInArrow(run, f"`{id_col}` {kind}, n_tokens int")


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(id, text): the texts that lists of token ids stand for; a null or empty list gives the empty text. No shuffle.

    Ids without a token are an error; bytes that are no UTF-8 become replacement characters.
    """
    src = df.select(F.col(id_col).alias(id_col), F.col(ids_col).alias("_ll_ids"))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        piece = {rank: raw for raw, rank in encoder(ranks).ranks.items()}
        for batch in batches:
            texts = [b"".join([piece[i] for i in ids or ()]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return src.mapInArrow(run, f"`{id_col}` {kind}, text string")
