"""What several operators share: the word rule, row keys, table access."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed rule of the result contracts: white space is exactly these six characters.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only, so that every engine agrees on the result."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def text_key(text: Column) -> Column:
    """Hash of a text; together with the document id it names a row (equal rows share the name)."""
    return F.xxhash64(text)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that a slice holds about ``limit`` bytes of ``column`` (or a single row)."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + (size or 0) > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def same_key(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equi-join condition on ``names`` in which null meets null."""
    on = F.lit(True)
    for name in names:
        on = on & left[name].eqNullSafe(right[name])
    return on


def crc32_sql(text: str) -> str:
    """DuckDB expression: unsigned CRC-32 of the UTF-8 bytes of ``text`` (characters up to U+07FF), bit by bit."""
    points = f"list_transform(string_split({text}, ''), lambda ch: unicode(ch))"
    octets = f"flatten(list_transform({points}, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + (p >> 6), 128 + (p & 63)] END))"
    bit = "lambda x, i: xor(x >> 1, 3988292384 * (x & 1))"
    octet = f"lambda c, o: list_reduce([xor(c, o), 0, 0, 0, 0, 0, 0, 0, 0], {bit})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}::BIGINT[]), {octet}), 4294967295)"
