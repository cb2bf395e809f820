"""Byte-level BPE by a rank file: encoding with a segment tree over byte positions, and decoding.

The text is cut by the tokenizer's pattern; each match is merged on its own. A leaf of the segment
tree stands for a live token start and holds ``rank * length + position`` of the pair it begins, so
the root is the leftmost pair of least rank. A merge changes three leaves: the merged token, the one
it swallowed and the live neighbour on the left. A match of n bytes costs O(n log n), also when it
is megabytes long.

Null texts count as empty; an empty text has no ids. Repeated rows and null ids of documents are kept
as they are; other columns are not touched. Invalid ids do not occur: decoding takes ids of the same
rank file and raises on others.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskrank.llm.common import slices

# Matches kept per Python worker, a memory bound only: later unknown matches are merged again.
CACHED_MATCHES = 250_000
NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pattern match."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    end = list(range(1, n + 1))  # of the token that starts here
    before = list(range(-1, n - 1))  # start of the live token on the left

    def put(leaf: int, value: int) -> None:
        k = size + leaf
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            k >>= 1
            if other < value:
                value = other
            if tree[k] == value:
                return
            tree[k] = value

    while (best := tree[1]) < NONE:
        left = best % n
        right = end[left]
        stop = end[left] = end[right]
        put(right, NONE)
        rank = None
        if stop < n:
            before[stop] = left
            rank = get(piece[left : end[stop]])
        put(left, NONE if rank is None else rank * n + left)
        if (first := before[left]) >= 0:
            rank = get(piece[first:stop])
            put(first, NONE if rank is None else rank * n + first)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return ids


class Matches(dict):
    """Match -> its ids as int32 bytes; filled on demand."""

    def __init__(self, ranks: dict[bytes, int], limit: int):
        self.ranks, self.limit = ranks, limit

    def __missing__(self, match: str) -> bytes:
        value = np.array(merge(match.encode(), self.ranks), dtype="<i4").tobytes()
        if len(self) < self.limit and len(match) < 100:
            self[match] = value
        return value


@lru_cache(maxsize=2)
def _worker_matches(path: str) -> Matches:
    """Kept by a Python worker from task to task."""
    return Matches(load_ranks(path), CACHED_MATCHES)


@lru_cache(maxsize=2)
def _worker_vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all tokens' bytes one after another, start by id, length by id)."""
    tokens = {rank: token for token, rank in load_ranks(path).items()}
    lengths = np.zeros(max(tokens) + 1, dtype=np.int64)
    for rank, token in tokens.items():
        lengths[rank] = len(token)
    starts = np.cumsum(lengths) - lengths
    return np.frombuffer(b"".join(tokens.get(i, b"") for i in range(len(lengths))), dtype=np.uint8), starts, lengths


def _with_column(batch: pa.RecordBatch, drop: str, name: str, column: pa.Array) -> pa.RecordBatch:
    names = [c for c in batch.schema.names if c != drop]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), column], [*names, name])


def encode(
    df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", keep_text: bool = False
) -> DataFrame:
    """``df`` with ``ids`` (array of int) in place of ``text``, by the ranks in ``path``.

    ``ids`` must not be a column of ``df``. ``keep_text`` keeps the text as well.
    """
    if ids in df.columns:
        raise ValueError(f"{ids} is a column already")
    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, find = _worker_matches(path), regex.compile(pattern).findall
        get = known.__getitem__
        for batch in slices(batches, text):
            coded = [b"".join(map(get, find(t))) if t else b"" for t in batch.column(text).to_pylist()]
            offsets = np.zeros(len(coded) + 1, dtype=np.int32)
            np.cumsum([len(c) // 4 for c in coded], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(coded), dtype="<i4"))
            column = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield _with_column(batch, "" if keep_text else text, ids, column)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with ``decoded`` (binary: the tokens' bytes one after another); null ids decode to nothing."""
    schema = T.StructType([*df.schema.fields, T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts, lengths = _worker_vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                column = part.column(ids)
                values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = np.array([n or 0 for n in pa.compute.list_value_length(column).to_pylist()], dtype=np.int64)
                sizes = lengths[values]
                ends = np.cumsum(sizes)
                total = int(ends[-1]) if len(ends) else 0
                # byte k of the output is byte (k - token's first output byte) of its token
                source = np.repeat(starts[values] - (ends - sizes), sizes) + np.arange(total)
                out = data[source].tobytes()
                edges = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
                pieces = [out[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield _with_column(part, "", decoded, pa.array(pieces, pa.binary()))

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """The contract's columns from (doc_id, text): number of ids, hash of the ids, hash of the decoded bytes."""
    coded = encode(df.select("doc_id", "text"), path, pattern)
    return decode(coded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
