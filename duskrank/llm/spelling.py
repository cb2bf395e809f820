"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Words are counted over all documents. Two words one edit apart have nearly the same letters: the squared
distance of their letter counts is 1 for an inserted or deleted letter and 2 for a replaced one. Words are
sorted by length and letter counts and cut into blocks of ``BLOCK`` words; a block of one length meets
the blocks of the same and the next length whose letter counts can come that near (each block keeps the
least and largest count of every letter, which rules pairs of blocks out exactly). For a pair of blocks one
matrix product gives all squared distances; only pairs at most two apart are compared letter by letter.
Each pair of blocks returns, per word, the number of near words and the best of them, never the pairs.

A word's form is its near word of largest count, if that is at least ``LEAD`` times its own; forms lead to
roots by doubling the steps, and as counts grow by that factor with every step, few doublings are enough.

Null texts have no words; a null id is written ``null`` in the hash that misspells words. Rows that
repeat an id are documents of their own. Texts of any length are read whole; other columns are not used; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskrank.llm.common import ASCII_LOWER, ASCII_UPPER, crc32_sql, slices
from duskrank.session import cut

# Fixed rules of the result contract: letters, shortest word, least count, every how many runs a letter is lost.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
MIN_LENGTH, MIN_COUNT, LOST = 6, 5, 199
LEAD = 5
BLOCK = 512
HELD_WORDS = 300_000
COMPARED_LETTERS = 1 << 23

# in Latin-1 a letter is a byte, and lower() of bytes changes A-Z only; other characters become '?'
_RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % MIN_LENGTH)
_COLUMN = np.full(256, -1)
_COLUMN[np.frombuffer(LETTERS.encode("latin-1"), np.uint8)] = np.arange(len(LETTERS))


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flushed(counts: dict[bytes, int]) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], ["word", "n"])

    total: dict[bytes, int] = {}
    for batch in slices(batches, "text"):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if not text:
                continue
            start = crc32(f"{'null' if doc_id is None else doc_id}:".encode())
            for word, n in Counter(_RUN.findall(text.encode("latin-1", "replace").lower())).items():
                h = crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                if h % LOST == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < MIN_LENGTH:
                        continue
                total[word] = total.get(word, 0) + n
            if len(total) > HELD_WORDS:
                yield flushed(total)
                total = {}
    yield flushed(total)


def word_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of every word that occurs often enough in ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    parts = rows.mapInArrow(_counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def letter_counts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(words x letters) codes and (words x alphabet) counts of words of one length."""
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)
    counts = np.zeros((len(words), len(LETTERS)), np.float32)
    np.add.at(counts, (np.arange(len(words))[:, None], _COLUMN[codes]), 1)
    return codes, counts


def near_pairs(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with a[i] and b[j] exactly one edit apart; b's words are as long or one longer."""
    (ca, x), (cb, y) = letter_counts(a), letter_counts(b)
    used = x.any(axis=0) | y.any(axis=0)
    x, y = x[:, used], y[:, used]
    # one product gives -distance^2 / 2: the squares ride along as two more columns
    one = np.ones((len(x), 1), np.float32), np.ones((len(y), 1), np.float32)
    left = np.hstack([x, -0.5 * (x * x).sum(axis=1, keepdims=True), one[0]])
    right = np.hstack([y, one[1], -0.5 * (y * y).sum(axis=1, keepdims=True)])
    i, j = np.divmod(np.flatnonzero((left @ right.T).ravel() >= -1.0), len(y))
    near = np.zeros(len(i), bool)
    step = max(1, COMPARED_LETTERS // cb.shape[1])
    for start in range(0, len(i), step):
        part = slice(start, start + step)
        near[part] = one_edit(ca[i[part]], cb[j[part]])
    return i[near], j[near]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: exactly one letter replaced, or one letter of b left out."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    head = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= a.shape[1]


_BLOCK_COLUMNS = "id long, length int, words array<string>, counts array<long>, low array<int>, high array<int>"


def _block(words: list[str], counts: list[int], number: int) -> dict:
    _, held = letter_counts(words)
    low, high = held.min(axis=0).astype(int).tolist(), held.max(axis=0).astype(int).tolist()
    return {"id": number, "length": len(words[0]), "words": words, "counts": counts, "low": low, "high": high}


def _blocked(size: int):
    """Consecutive words of one length as blocks; the rows of a task come sorted."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 40
        words: list[str] = []
        counts: list[int] = []
        for frame in frames:
            out = []
            for word, n in zip(frame["word"], frame["n"], strict=True):
                if words and (len(words) == size or len(word) != len(words[0])):
                    out.append(_block(words, counts, number))
                    words, counts, number = [], [], number + 1
                words.append(word)
                counts.append(n)
            if out:
                yield pd.DataFrame(out)
        if words:
            yield pd.DataFrame([_block(words, counts, number)])

    return run


def _letter_order(vocabulary: DataFrame) -> str:
    """The letters by how often the vocabulary has them, most frequent first (one number per letter)."""
    sums = [F.sum(F.length("word") - F.length(F.replace("word", F.lit(c), F.lit("")))).alias(f"c{k}") for k, c in enumerate(LETTERS)]
    found = vocabulary.agg(*sums).first()
    return "".join(c for _, c in sorted((-(found[k] or 0), c) for k, c in enumerate(LETTERS)))


def _profile(order: str):
    """Letter counts in the given order as a sortable string; words of one length with near profiles stand together."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: "".join(chr(48 + min(w.count(c), 70)) for c in order))

    return run


def _summed(words: list[str], own: np.ndarray, other: np.ndarray, others: list[str], n: np.ndarray) -> list[np.ndarray]:
    """word, n_near, form_n, form of the words at ``own``: the near word of largest count, ties by code points."""
    rank = np.empty(len(others), np.int64)
    rank[np.argsort(np.array(others))] = np.arange(len(others))
    order = np.lexsort((rank[other], -n[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    best = other[first]
    return [np.array(words, object)[own[first]], np.diff(first, append=len(own)), n[best], np.array(others, object)[best]]


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pair of blocks and word: how many near words the other block has, and the best of them."""
    for batch in batches:
        out: list[list[np.ndarray]] = []
        for k in range(batch.num_rows):
            a, b = batch.column("words")[k].as_py(), batch.column("other_words")[k].as_py()
            i, j = near_pairs(a, b)
            if not len(i):
                continue
            out.append(_summed(a, i, j, b, batch.column("other_counts")[k].values.to_numpy()))
            if not batch.column("same")[k].as_py():  # in a block with itself every pair is there both ways
                out.append(_summed(b, j, i, a, batch.column("counts")[k].values.to_numpy()))
        if out:
            word, n_near, form_n, form = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(word, pa.string()), pa.array(n_near, pa.int64()), pa.array(form_n, pa.int64()), pa.array(form, pa.string())],
                ["word", "n_near", "form_n", "form"],
            )


def near_words(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near, form_n, form: every word of ``vocabulary`` (word, n) that has near words, and the best of them."""
    order = _letter_order(vocabulary)
    keyed = cut(vocabulary.withColumn("_length", F.length("word")).withColumn("_profile", _profile(order)("word")), "profiles")
    keys = ["_length", "_profile", "word"]
    ranged = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    blocks = cut(ranged.select("word", "n").mapInPandas(_blocked(block), _BLOCK_COLUMNS), "word_blocks")
    a = blocks.select(F.col("id").alias("a"), F.col("length").alias("la"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
    b = blocks.select(F.col("id").alias("b"), F.col("length").alias("lb"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    a = a.withColumn("lb", F.explode(F.array("la", F.col("la") + 1)))
    below = F.zip_with("low_a", "high_b", lambda x, y: F.greatest(x - y, F.lit(0)))
    above = F.zip_with("low_b", "high_a", lambda x, y: F.greatest(x - y, F.lit(0)))
    gap = F.aggregate(F.zip_with(below, above, lambda x, y: x * x + y * y), F.lit(0), lambda s, x: s + x)
    pairs = a.join(b, "lb").filter(((F.col("la") < F.col("lb")) | (F.col("a") <= F.col("b"))) & (gap <= 2)).select("a", "b")
    pairs = cut(pairs, "block_pairs")
    met = pairs.join(blocks.select(F.col("id").alias("a"), "words", "counts"), "a").join(
        blocks.select(F.col("id").alias("b"), F.col("words").alias("other_words"), F.col("counts").alias("other_counts")), "b"
    )
    met = met.select("words", "counts", "other_words", "other_counts", (F.col("a") == F.col("b")).alias("same"))
    found = met.mapInArrow(_compared, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("_n"), F.col("form").alias("_form")))
    sums = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best"))
    return sums.select("word", "n_near", (-F.col("_best._n")).alias("form_n"), F.col("_best._form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for the words of ``forms`` (word, form): the end of the chain of forms."""
    known = cut(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        later = known.select(F.col("word").alias("root"), F.col("root").alias("_later"))
        doubled = known.join(later, "root", "left")
        known = cut(doubled.select("word", F.coalesce("_later", "root").alias("root"), F.col("_later").isNotNull().alias("_on")), "forms")
        if not known.filter("_on").limit(1).count():
            return known.select("word", "root")
        known = known.drop("_on")


def variants(docs: DataFrame, min_count: int = MIN_COUNT, lead: int = LEAD, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs`` that occurs often enough."""
    vocabulary = cut(word_counts(docs, min_count), "vocabulary")
    best = near_words(vocabulary, block)
    led = F.col("form_n") >= lead * F.col("n")
    known = vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(led, F.col("form")).alias("form"), F.when(led, F.col("form_n")).alias("form_n"),
    )
    known = cut(known, "variants")
    ends = roots(known.filter("form IS NOT NULL"))
    return known.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


# near words meet by a letter left out: at the same place in both (replaced), or in the longer one only
SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{ASCII_UPPER}', '{ASCII_LOWER}') AS run
  FROM documents),
hashed AS (
  SELECT run, c, {crc32_sql("coalesce(doc_id::VARCHAR, 'null') || ':' || run")} AS h
  FROM (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= {MIN_LENGTH} GROUP BY doc_id, run)),
spelt AS (
  SELECT c, CASE WHEN h % {LOST} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM hashed),
words AS (
  SELECT word, sum(c)::BIGINT AS n FROM spelt WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(c) >= {MIN_COUNT}),
cuts AS (
  SELECT word, k, substr(word, 1, k) || substr(word, k + 2) AS rest
  FROM (SELECT word, unnest(range(length(word))) AS k FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, rest FROM cuts WHERE rest IN (SELECT word FROM words)
  UNION SELECT rest, word FROM cuts WHERE rest IN (SELECT word FROM words)),
best AS (
  SELECT near.word, count(*) AS n_near, first(o.word ORDER BY o.n DESC, o.word) AS form, max(o.n) AS form_n
  FROM near JOIN words o ON o.word = near.other GROUP BY near.word),
led AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= {LEAD} * w.n THEN b.form END AS form,
         CASE WHEN b.form_n >= {LEAD} * w.n THEN b.form_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
steps AS (
  SELECT word, word AS root, 0 AS step FROM led
  UNION ALL SELECT s.word, l.form, s.step + 1 FROM steps s JOIN led l ON l.word = s.root WHERE l.form IS NOT NULL)
SELECT led.word, led.form, e.root, led.n, led.n_near, led.form_n
FROM led JOIN (SELECT word, max_by(root, step) AS root FROM steps GROUP BY word) e ON e.word = led.word
"""
