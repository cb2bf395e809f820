"""Line dedup by content-defined chunks of lines.

A line ends at a newline or, inside a paragraph, at the end of a sentence; lines are compared without
the white space around them. Chunks are the shortest runs of ``MIN_LINES`` or more lines and ``MIN_WORDS``
or more words that begin at a line, and the shortest that end at a line. Where a chunk lies depends on its
own lines only, and every passage of that size is the union of the chunks inside it, wherever it stands. A
rolling hash names the chunks; those whose hash occurs more than once in the corpus are candidates.

Of each hash the first occurrence, by document id (null last), text hash and place, is the original. The
texts of the document and of the original's document are brought together and compared byte by byte from
the chunk in both directions, so that a repeated passage is found up to its first and last line. What
equals the original is removed from the later occurrence. A removed line's text thus stands unchanged at
an earlier place, and by induction some occurrence always stays.

Null texts stay null and have no lines. Rows that repeat a document id and text are one document: what is
removed from one is removed from all. Empty texts and tables pass through. Other columns are kept;
``n_chars``, if a column, follows the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskrank.llm.common import slices
from duskrank.llm.probminhash import mix
from duskrank.session import cut

MIN_LINES = 2
MIN_WORDS = 16
SALT_ROWS = 512

_ENDS = re.compile(r"(?<=[.!?])(?= )|(?<=\n)")
_SEEDS = "array<struct<hash: bigint, pos: int, n: int>>"
_SEED_TYPE = pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int32()), ("n", pa.int32())]))
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def lines_of(text: str) -> list[str]:
    """Pieces that make up the text; white space without a line belongs to the piece before it."""
    if "\0" in text:
        pieces = _ENDS.split(text)
    else:  # a mark at every end; the expression would be tried at every character
        for end in ".!?":
            text = text.replace(f"{end} ", f"{end}\0 ")
        pieces = text.replace("\n", "\n\0").split("\0")
    out: list[str] = []
    for piece in pieces:
        if out and (not piece or piece.isspace()):
            out[-1] += piece
        elif piece:
            out.append(piece)
    return out


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    factors = np.full(n, base, dtype=_U)
    factors[:1] = 1
    return np.cumprod(factors, dtype=_U)


def seeds(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first line and number of lines of every chunk."""
    return all_seeds([text])[:3]


def all_seeds(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the chunks of all texts, text by text: hash, first line and number of lines; and where each text's chunks end.

    The lines of the texts are numbered through, and a chunk must lie inside its text.
    """
    lines, sizes = [], []
    for text in texts:
        own = [piece.strip() for piece in lines_of(text)]
        lines += own
        sizes.append(len(own))
    n = len(lines)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, lines), dtype=_U, count=n)
    words = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.fromiter((x.count(" ") + 1 for x in lines), dtype=np.int64, count=n), out=words[1:])
    ends = np.cumsum(sizes, dtype=np.int64)
    begins, ends_at = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)  # of each line's text
    at = np.arange(n)
    stop = np.maximum(at + MIN_LINES, np.searchsorted(words, words[:-1] + MIN_WORDS, "left"))
    start = np.minimum(at + 1 - MIN_LINES, np.searchsorted(words, words[1:] - MIN_WORDS, "right") - 1)
    whole = stop <= ends_at
    # the shortest chunk that ends at a line may be the shortest that begins at its first line: once is enough
    more = start >= begins
    more[more] = stop[start[more]] != at[more] + 1
    first, last = np.concatenate((at[whole], start[more])), np.concatenate((stop[whole], at[more] + 1))
    first, last = np.divmod(np.sort(first * (n + 1) + last, kind="stable"), n + 1)
    # sums of place-dependent terms make every chunk's hash a difference of two running sums
    sums = np.concatenate((np.zeros(1, dtype=_U), np.cumsum(codes * _powers(_BASE, n), dtype=_U)))
    hashes = mix((sums[last] - sums[first]) * _powers(_INVERSE, n + 1)[first] + (last - first).astype(_U))
    return hashes.view(np.int64), first - begins[first], last - first, np.searchsorted(first, ends, "left")


def _seeded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        hashes, first, n, ends = all_seeds([t or "" for t in batch.column("text").to_pylist()])
        columns = [pa.array(c.astype(t)) for c, t in zip((hashes, first, n), ("i8", "i4", "i4"), strict=True)]
        chunks = pa.StructArray.from_arrays(columns, fields=list(_SEED_TYPE.value_type))
        found = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), chunks).cast(_SEED_TYPE)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_key"), found], ["doc_id", "_key", "seeds"])


def stripped_lines(text: str) -> list[str]:
    return [x.strip() for x in lines_of(text)]


def repeated_runs(
    text: str, original: str, same: bool, found: list[tuple[int, int, int]]
) -> list[tuple[int, int]]:
    """Runs of lines of ``text`` that equal lines of ``original``, grown from ``found`` (place, original's place, n)."""
    mine = stripped_lines(text)
    return grown_runs(mine, mine if same else stripped_lines(original), found)


def grown_runs(mine: list[str], theirs: list[str], found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """``repeated_runs`` of texts that are cut into lines already."""
    runs: list[tuple[int, int]] = []
    done = bytearray(len(mine))  # a run ends where another begins, so equal lines in any number are passed once
    for pos, first, n in sorted(found):
        shift = pos - first
        if all(done[pos : pos + n]):
            continue
        if mine[pos : pos + n] != theirs[first : first + n]:
            continue  # equal hashes of different lines
        a, b = pos, pos + n
        while a > max(0, shift) and not done[a - 1] and mine[a - 1] == theirs[a - 1 - shift]:
            a -= 1
        while b < len(mine) and b - shift < len(theirs) and not done[b] and mine[b] == theirs[b - shift]:
            b += 1
        done[a:b] = b"\1" * (b - a)
        runs.append((a, b))
    return runs


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, theirs = None, []
    for batch in slices(batches, "text"):
        keys, firsts, texts = (batch.column(c).to_pylist() for c in ("_key", "first_key", "text"))
        found = batch.column("found")
        ends = np.cumsum([0, *pa.compute.list_value_length(found).to_pylist()]).tolist()
        chunks = list(zip(*(c.to_pylist() for c in found.flatten().flatten()), strict=True))
        out = []
        for k, text in enumerate(texts):
            mine = stripped_lines(text)
            if keys[k] != firsts[k] and firsts[k] != last:  # rows come sorted by original where the join sorts
                last, theirs = firsts[k], stripped_lines(batch.column("original")[k].as_py())
            runs = grown_runs(mine, mine if keys[k] == firsts[k] else theirs, chunks[ends[k] : ends[k + 1]])
            out.append([i for a, b in runs for i in range(a, b)])
        yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(out, pa.list_(pa.int32()))], ["_key", "places"])


def _candidates(keyed: DataFrame) -> DataFrame:
    """(_key, first_key, found): repeated chunks of a document whose original stands in the document first_key."""
    seeded = keyed.select("doc_id", "_key", "text").mapInArrow(_seeded, f"doc_id long, _key long, seeds {_SEEDS}")
    chunks = cut(seeded.filter(F.size("seeds") > 0), "seeds").select("doc_id", "_key", F.inline("seeds"))
    # both sides read all columns, so that one shuffle serves them
    chunks = chunks.repartition("hash")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("_key").alias("key"), "pos", "n")
    firsts = chunks.groupBy("hash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    met = chunks.join(firsts.select("hash", "first"), "hash").filter(
        (F.col("_key") != F.col("first.key"))
        | (F.col("pos") != F.col("first.pos"))
        | ~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    )
    # a set: rows that repeat a document find the same
    found = F.struct("pos", F.col("first.pos").alias("first"), "n")
    groups = met.groupBy("_key", F.col("first.key").alias("first_key")).agg(F.collect_set(found).alias("found"))
    return cut(groups, "candidates")


def _salted(pairs: DataFrame) -> DataFrame:
    """Adds ``salt``: documents that share an original are spread over groups of about ``SALT_ROWS``."""
    sizes = pairs.groupBy("first_key").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).alias("_salts"))
    salted = pairs.join(sizes, "first_key").withColumn("salt", F.pmod(F.xxhash64("_key"), F.col("_salts")))
    return cut(salted.drop("_salts"), "salted")


def _rebuilt(schema: T.StructType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("_gone").to_pylist(), strict=True):
                drop = set(gone)
                texts.append("".join(x for i, x in enumerate(lines_of(text)) if i not in drop))
            columns = []
            for name in schema.names:
                if name == "text":
                    columns.append(pa.array(texts, batch.schema.field("text").type))
                elif name == "n_chars":
                    columns.append(pa.array([len(t) for t in texts]).cast(batch.schema.field("n_chars").type))
                elif name == "_n_gone":
                    columns.append(pa.array([len(set(g)) for g in batch.column("_gone").to_pylist()], pa.int64()))
                else:
                    columns.append(batch.column(name))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return run


def dedup_lines(docs: DataFrame, removed: str | None = None) -> DataFrame:
    """``docs`` with repeated chunks removed from ``text``; ``removed`` names a column for the number of removed lines."""
    # one shuffle by key serves the comparison's two sides and the result, as all of them read whole rows
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text")).repartition("_key")
    pairs = _salted(_candidates(docs.select("doc_id", "text").withColumn("_key", F.xxhash64("doc_id", "text"))))
    one = keyed.groupBy("_key").agg(F.first(F.struct(*docs.columns)).alias("_row")).select("_key", "_row.text")
    mine = pairs.join(one, "_key")
    original = one.select(F.col("_key").alias("first_key"), F.col("text").alias("original"))
    original = original.join(pairs.select("first_key", "salt").distinct(), "first_key")
    both = mine.join(original, ["first_key", "salt"]).select("_key", "first_key", "text", "original", "found")
    places = both.mapInArrow(_compared, "_key long, places array<int>")
    gone = places.groupBy("_key").agg(F.flatten(F.collect_list("places")).alias("_gone")).filter(F.size("_gone") > 0)
    joined = keyed.join(gone, "_key", "left")
    none = F.lit(0).cast("long").alias("_n_gone")
    same = joined.filter("_gone IS NULL").select(*docs.columns, none)
    schema = T.StructType([*docs.schema.fields, T.StructField("_n_gone", T.LongType())])
    changed = joined.filter("_gone IS NOT NULL").select(*docs.columns, "_gone").mapInArrow(_rebuilt(schema), schema)
    out = same.unionByName(changed)
    return out.withColumnRenamed("_n_gone", removed) if removed else out.drop("_n_gone")
