"""Token ids as Parquet files that allow selective reads of tokens and of their metadata.

Files are written in ascending document order. A row holds the document id, the number of ids, their
place inside the write task's part, the part's number, and the ids as a list column. Ids are
dictionary-encoded (a vocabulary fits one dictionary page); the metadata columns are delta-encoded.
Row groups and pages have set sizes, and the writer adds page indexes, so a filter on ``doc_id`` reads
the pages it needs and a query without ``ids`` never touches them. The place of a document in the
whole token stream is the part's offset (one number per write task) plus its place in the part.

Null texts count as empty: such a document has just the end id. Rows that repeat a document id follow
one another in the order of their texts' hashes; a null id comes first.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duskrank.llm.common import slices, text_key

CACHED_WORDS = 900_000

FILE_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"
WRITE_OPTIONS = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start_in_part": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "compression": "zstd",
}


def _parts(word: str) -> tuple[str, ...]:
    """Cuts a word of letters from the marks behind it, between which the tokenizer cuts as well.

    Limited to Latin letters, about which all Unicode versions agree, that are letters in lower case too (a
    dotted capital I becomes a letter and a combining dot, which stays with the marks); ASCII is lower-cased as
    the tokenizer does.
    """
    core = word.rstrip(".,;:!?*$%&#|")
    if not core.isalpha() or max(core) > "\u024f" or not unicodedata.normalize("NFC", core.lower()).isalpha():
        return (word,)
    tail = word[len(core) :]
    core = core.lower() if core.isascii() else core
    return (core, tail) if tail else (core,)


class Words(dict):
    """Word without ASCII white space -> its ids as int32 bytes.

    The tokenizer lower-cases, drops white space and never merges across it, so a text's ids are its
    words' ids one after another. Unknown words are encoded by the tokenizers library, many at once.
    """

    def __init__(self, path: str, limit: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit

    def learn(self, words: list[str]) -> dict[str, bytes]:
        parts = {w: _parts(w) for w in words}
        new = {p for pair in parts.values() for p in pair if p not in self}
        new_list = list(new)
        coded = self.tokenizer.encode_batch_fast(new_list, add_special_tokens=False)
        found = {p: array("i", c.ids).tobytes() for p, c in zip(new_list, coded, strict=True)}
        if len(self) < self.limit:
            self.update((p, ids) for p, ids in found.items() if len(p) < 100)
        known = {w: b"".join(found[p] if p in found else self[p] for p in pair) for w, pair in parts.items()}
        if len(self) < self.limit:
            self.update((w, ids) for w, ids in known.items() if len(w) < 100)
        return known

    def ids(self, texts: list[str | None]) -> list[list[int]]:
        values, ends = self.encode(pa.array(texts, pa.string()), [])
        return [part.tolist() for part in np.split(values, ends[:-1])] if texts else []

    def encode(self, texts: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, each text's followed by ``end``, and where each text's ids end.

        Arrow cuts the texts at ASCII white space (other white space stays inside words, where the tokenizer
        drops it) and numbers the distinct words; only those are looked up, and numpy lays their ids out.
        """
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        new = [w for w in names if w not in self]
        found = self.learn(new) if new else {}
        known = [found[w] if w in found else self[w] for w in names]
        size = np.array([len(ids) // 4 for ids in known], dtype=np.int32)
        flat, first = np.frombuffer(b"".join(known), dtype="<i4"), np.cumsum(size, dtype=np.int32) - size

        per_word = size[code]
        up_to = np.concatenate(([0], np.cumsum(per_word, dtype=np.int32)))
        text_ends = up_to[lists.offsets.to_numpy() - lists.offsets[0].as_py()][1:]
        place = np.arange(up_to[-1], dtype=np.int32)
        source = place + np.repeat(first[code] - up_to[:-1], per_word)
        if not end:
            return flat[source], text_ends
        ends = text_ends + len(end) * np.arange(1, len(texts) + 1, dtype=np.int32)
        out = np.empty(ends[-1] if len(ends) else 0, dtype="<i4")
        out[place + np.repeat(len(end) * np.arange(len(texts), dtype=np.int32), np.diff(text_ends, prepend=0))] = flat[source]
        for k, token in enumerate(end):
            out[ends - len(end) + k] = token
        return out, ends


@lru_cache(maxsize=2)
def _worker_words(path: str) -> Words:
    return Words(path, CACHED_WORDS)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encodes ``docs`` (doc_id, text) and writes the files of the module's format to ``path``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, place = _worker_words(tokenizer), 0
        for batch in slices(batches, "text", 4 << 20):
            values, ends = words.encode(batch.column("text"), [end_id])
            offsets = np.concatenate(([0], ends)).astype(np.int32)
            counts = np.diff(offsets).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(place + offsets[:-1].astype(np.int64)),
                    pa.array(counts),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                ],
                ["doc_id", "start_in_part", "n_tokens", "ids"],
            )
            place += int(counts.sum())

    order = ["doc_id", "_order"]
    rows = docs.select(F.col("doc_id").cast("long"), "text", text_key(F.col("text")).alias("_order"))
    # the text's hash as second key lets Spark cut a document id that many rows share
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    coded = rows.mapInArrow(run, "doc_id long, start_in_part long, n_tokens long, ids array<int>")
    coded.select("doc_id", F.spark_partition_id().alias("part"), "start_in_part", "n_tokens", "ids").write.options(
        **WRITE_OPTIONS
    ).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids.

    The parts' offsets come from the metadata columns alone; they are one row per write task, which
    is what is broadcast.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    return files.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("_offset") + F.col("start_in_part")).alias("start"), "n_tokens", "ids"
    )


def with_crc(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: unsigned crc32 of the ids as little-endian 32-bit integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            data = memoryview(np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
            edges = np.concatenate(([0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))))
            edges = (4 * edges).tolist()
            crcs = [zlib.crc32(data[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            columns = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
