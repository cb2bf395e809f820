"""Quality rules: base counts of each text, and line frequency across the documents of a host.

A line is what ``\\n`` separates; it is compared by its words joined by one space with A-Z lower-cased.
Per host, the distinct documents (equal texts count once) that hold a line are counted. Lines in more
than ``limit(host) = max(MIN_DOCS, SHARE * documents of the host)`` documents are frequent. Near copies of
one document would make all of its lines frequent, although copies are a matter of deduplication: so a
frequent line is boilerplate, and removed, if more than the limit's number of documents hold it that are
no copies of one another, whatever part of them it fills. Those are told by what else a document holds:
its own lines are neither frequent nor edited forms of a frequent line of the host (lines that begin or
end with the same ``END_WORDS`` words). A document counts if more than 1 / ``OWN_PARTS`` of its words are
in own lines (texts that share more are 0.8 similar or more), and documents with the same own lines count
once. A document is depleted, and rejected, if removal leaves less than ``1 - DEPLETED`` of its words.

Null texts count as empty: no words, hence ``base_failed``. Null is a host of its own. Repeated rows each
get a row. Other columns are kept by ``apply`` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskrank.llm.common import WORD, ascii_lower, slices, text_key
from duskrank.session import cut

MIN_DOCS = 10
SHARE = 0.01
DEPLETED = 0.7
OWN_PARTS = 9  # two texts that share 8/9 of their words have a Jaccard index of 8/10
END_WORDS = 5

# Fixed by the result contract.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = (
    "_row long, doc_id long, source string, _text long, n_words long, word_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long, lines array<struct<line: long, words: long, head: long, tail: long>>"
)


def line_hash(normalised: bytes) -> int:
    """Equals Spark's xxhash64 of the same string."""
    h = xxhash.xxh64_intdigest(normalised, 42)
    return h - (1 << 64) if h >> 63 else h


def repeated_window_words(words: list[bytes]) -> int:
    """Words inside a window of WINDOW words that occurs at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.uint64)
    code = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        code = code * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    # equal windows share a code; windows that share a code are compared word by word
    maybe = np.zeros(n, dtype=bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    places: dict[bytes, list[int]] = {}
    for i in np.flatnonzero(maybe).tolist():
        places.setdefault(ids[i : i + WINDOW].tobytes(), []).append(i)
    mark = np.zeros(len(words) + 1, dtype=np.int64)
    for found in places.values():
        if len(found) > 1:
            at = np.array(found)
            np.add.at(mark, at, 1)
            np.add.at(mark, at + WINDOW, -1)
    return int((np.cumsum(mark)[:-1] > 0).sum())


def text_counts(text: str) -> tuple[int, int, int, int, int, list[dict[str, int]]]:
    raw = text.encode()
    words = raw.split()  # of bytes: exactly the six white-space characters
    seen: set[bytes] = set()
    duplicates, lines = 0, {}
    for line in raw.split(b"\n"):
        parts = line.split()
        if parts:
            duplicates += line in seen
            seen.add(line)
            key, *ends = (line_hash(b" ".join(x).lower()) for x in (parts, parts[:END_WORDS], parts[-END_WORDS:]))
            n = lines[key][0] if key in lines else 0
            lines[key] = (n + len(parts), *ends)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        duplicates,
        repeated_window_words(words),
        [{"line": k, "words": n, "head": head, "tail": tail} for k, (n, head, tail) in lines.items()],
    )


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lines_type = pa.list_(pa.struct([(name, pa.int64()) for name in ("line", "words", "head", "tail")]))
    for batch in slices(batches, "text"):
        rows = list(zip(*(text_counts(t or "") for t in batch.column("text").to_pylist()), strict=True))
        columns = [batch.column(c) for c in ("_row", "doc_id", "source", "_text")]
        columns += [pa.array(values, pa.int64()) for values in rows[:5]] + [pa.array(rows[5], lines_type)]
        yield pa.RecordBatch.from_arrays(columns, ["_row", "doc_id", "source", "_text", *_COUNTS, "lines"])


def base_failed() -> Column:
    repeated = 100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    return (F.col("n_words") < MIN_WORDS) | repeated


def counts(docs: DataFrame) -> DataFrame:
    """The base counts and the lines' hashes of every row, written once; the rest works on this narrow table."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        text_key(F.coalesce("text", F.lit(""))).alias("_text"),
        "text",
    )
    return cut(rows.mapInArrow(_counted, _SCHEMA), "line_counts")


def boilerplate(counted: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(_row, n_words, line, words) of the boilerplate lines in one row of each distinct text per host."""
    first = counted.groupBy("source", "_text").agg(F.min("_row").alias("_row")).select("_row")
    texts = counted.join(first, "_row", "left_semi").select("_row", "source", "n_words", "lines")
    limits = texts.groupBy(F.col("source").alias("_host")).agg(
        F.greatest(F.lit(float(min_docs)), F.lit(share) * F.count(F.lit(1))).alias("_limit")
    )
    held = texts.select("_row", "source", "n_words", F.inline("lines"))

    def over_limit(lines: DataFrame) -> DataFrame:
        n = lines.groupBy(F.col("source").alias("_h"), F.col("line").alias("_line")).agg(F.count(F.lit(1)).alias("_n"))
        many = n.join(limits, F.col("_h").eqNullSafe(F.col("_host"))).filter("_n > _limit")
        return many.select("_h", "_line")

    def among(lines: DataFrame, chosen: DataFrame, name: str = "line", how: str = "left_semi") -> DataFrame:
        return lines.join(chosen, F.col("source").eqNullSafe(F.col("_h")) & (F.col(name) == F.col("_line")), how)

    frequent = cut(among(held, over_limit(held)), "frequent_lines")
    own = held.join(frequent.select("_row").distinct(), "_row", "left_semi")
    known = frequent.select(F.col("source").alias("_h"), F.col("line").alias("_line"))
    own = among(own, known.distinct(), how="left_anti")
    for end in ("head", "tail"):
        ends = frequent.select(F.col("source").alias("_h"), F.col(end).alias("_line"))
        own = among(own, ends.distinct(), end, "left_anti")
    rest = own.groupBy("_row").agg(
        F.sum("words").alias("_own"), F.first("n_words").alias("_n_words"), F.sort_array(F.collect_list("line")).alias("_lines")
    )
    rest = rest.filter(OWN_PARTS * F.col("_own") > F.col("_n_words")).select("_row", F.md5(F.to_json("_lines")).alias("_rest"))
    distinct = frequent.join(rest, "_row").select("source", "line", "_rest").distinct()
    return among(frequent, over_limit(distinct))


def verdicts(counted: DataFrame, **limits) -> DataFrame:
    """(_host, _key, removed, depleted): one row per host and text that holds boilerplate."""
    removed = boilerplate(counted, **limits).groupBy("_row").agg(
        F.collect_list("line").alias("removed"),
        (F.sum("words") > DEPLETED * F.first("n_words")).alias("depleted"),
    )
    names = counted.select("_row", F.col("source").alias("_host"), F.col("_text").alias("_key"))
    return names.join(removed, "_row").drop("_row")


def judge(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every row of ``docs`` (doc_id, text, source)."""
    counted = counts(docs)
    found = verdicts(counted, **limits)
    on = counted["source"].eqNullSafe(found["_host"]) & (counted["_text"] == found["_key"])
    failed = base_failed()
    kept = ~failed & ~F.coalesce("depleted", F.lit(False))
    return counted.join(found, on, "left").select("doc_id", *_COUNTS, failed.alias("base_failed"), kept.alias("kept"))


def apply(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` without rejected rows and without boilerplate lines; ``n_chars``, if a column, follows the text."""
    counted = counts(docs)
    failed = counted.filter(base_failed()).select(
        F.col("source").alias("_host"), F.col("_text").alias("_key"), F.lit(None).cast("array<bigint>").alias("removed"),
        F.lit(True).alias("depleted"),
    )
    found = verdicts(counted, **limits).unionByName(failed.distinct())
    # names that no column of a corpus has
    found = found.groupBy(F.col("_host").alias("_lq_host"), F.col("_key").alias("_lq_key")).agg(
        F.first("removed", True).alias("_lq_removed"), F.max("depleted").alias("_lq_depleted")
    )
    keyed = docs.withColumn("_lq_text", text_key(F.coalesce("text", F.lit(""))))
    on = keyed["source"].eqNullSafe(found["_lq_host"]) & (keyed["_lq_text"] == found["_lq_key"])
    joined = keyed.join(found, on, "left").filter(~F.coalesce("_lq_depleted", F.lit(False)))

    def normalised(line: Column) -> Column:
        return ascii_lower(F.array_join(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)), " "))

    lines = F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains("_lq_removed", F.xxhash64(normalised(x))))
    text = F.when(F.col("_lq_removed").isNotNull(), F.array_join(lines, "\n")).otherwise(F.col("text"))
    joined = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = F.col("_lq_removed").isNotNull()
        joined = joined.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")))
    return joined.select(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (
  SELECT r, i, array_to_string(ws[i : i + 7], ' ') AS w
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS c FROM win) WHERE c >= 2),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM again) GROUP BY r),
l AS (
  SELECT r, line, len(ws) AS words, array_to_string(ws, ' ') AS norm,
         array_to_string(ws[1:5], ' ') AS head, array_to_string(ws[greatest(1, len(ws) - 4) : len(ws)], ' ') AS tail
  FROM (
    SELECT r, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x20\x09-\x0D]+') AS ws
    FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d))
  WHERE len(ws) > 0),
dup AS (SELECT r, sum(c - 1) AS n FROM (SELECT r, line, count(*) AS c FROM l GROUP BY r, line) GROUP BY r),
texts AS (SELECT min(r) AS r, source, text, any_value(len(ws)) AS n_words FROM d GROUP BY source, text),
limits AS (SELECT source, greatest(10.0, 0.01 * count(*)) AS lim FROM texts GROUP BY source),
held AS (
  SELECT t.r, t.source, t.n_words, l.norm, l.head, l.tail, sum(l.words) AS words
  FROM texts t JOIN l ON l.r = t.r GROUP BY t.r, t.source, t.n_words, l.norm, l.head, l.tail),
freq AS (
  SELECT h.* FROM held h
  JOIN (SELECT source, norm, count(*) AS n FROM held GROUP BY source, norm) f
    ON f.norm = h.norm AND f.source IS NOT DISTINCT FROM h.source
  JOIN limits m ON m.source IS NOT DISTINCT FROM h.source WHERE f.n > m.lim),
heads AS (SELECT DISTINCT source, head FROM freq),
tails AS (SELECT DISTINCT source, tail FROM freq),
own AS (
  SELECT h.r, string_agg(h.norm, chr(10) ORDER BY h.norm) AS rest FROM held h
  WHERE h.r IN (SELECT r FROM freq)
    AND NOT EXISTS (SELECT 1 FROM freq f WHERE f.norm = h.norm AND f.source IS NOT DISTINCT FROM h.source)
    AND NOT EXISTS (SELECT 1 FROM heads f WHERE f.head = h.head AND f.source IS NOT DISTINCT FROM h.source)
    AND NOT EXISTS (SELECT 1 FROM tails f WHERE f.tail = h.tail AND f.source IS NOT DISTINCT FROM h.source)
  GROUP BY h.r HAVING 9 * sum(h.words) > any_value(h.n_words)),
boiler AS (
  SELECT f.source, f.norm FROM freq f JOIN own o ON o.r = f.r
  JOIN limits m ON m.source IS NOT DISTINCT FROM f.source GROUP BY f.source, f.norm
  HAVING count(DISTINCT o.rest) > any_value(m.lim)),
gone AS (
  SELECT t.source, t.text FROM freq f
  JOIN boiler b ON b.norm = f.norm AND b.source IS NOT DISTINCT FROM f.source
  JOIN texts t ON t.r = f.r GROUP BY t.source, t.text HAVING sum(f.words) > 0.7 * any_value(t.n_words)),
c AS (
  SELECT d.r, d.doc_id, d.source, d.text, len(d.ws)::BIGINT AS n_words,
         (length(d.text) - length(translate(d.text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')))
           AS spaces,
         (length(d.text) - length(translate(d.text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dup ON dup.r = d.r LEFT JOIN rep ON rep.r = d.r)
SELECT c.doc_id, n_words, (length(c.text) - spaces)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND g.text IS NULL AS kept
FROM c LEFT JOIN gone g ON g.text = c.text AND g.source IS NOT DISTINCT FROM c.source
"""
