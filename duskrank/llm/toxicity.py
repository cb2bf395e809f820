"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lower-cases, maps look-alike letters of other scripts and full-width forms to Latin, and reads
digits and signs inside a word as the letters they stand for. The folded text is its words (runs of
letters), each after one space; lexicon entries start at a word's start and match a whole word or any
word that begins so. Exception phrases are entries of weight zero: a match inside one does not count.

The lexicon is learnt from labelled documents: for every word and word beginning, in how many labelled
toxic and clean documents it stands (counted by Spark over at most ``TRAIN_ROWS`` labelled documents). An entry's weight is its
log odds, by a cautious estimate. Of a chain of beginnings the longest is taken that still covers nearly the same toxic words.
Words that begin like an entry but stand in clean documents as often become exceptions.

A document's weight is the sum over its matches divided by the root of its length in words; a monotone
fit on the training documents turns it into the score. Empty and null texts have weight zero, which
scores as the training documents without a match do. Without training labels there is no lexicon and
every score is 0. Repeated rows each get a row and count as often as they occur; of several labels of
one document the toxic one holds. Only (doc_id, text) and (doc_id, toxic) are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskrank.llm.common import slices
from duskrank.session import cut

# Letters of other scripts that look like a Latin letter, one group per Latin letter.
LOOK_ALIKES = {
    "a": "аα", "b": "ьβ", "c": "сϲ", "d": "ԁ", "e": "еє", "g": "ɡ", "h": "һ", "i": "іιı", "j": "ј", "k": "кκ",
    "l": "ӏ", "m": "м", "n": "ո", "o": "оοо", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս",
    "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уγ",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
# Phrases in which a word of abuse is none.
EXCEPTIONS = ("idiot proof", "idiot light", "trash can", "trash bin", "trash collection", "sore loser", "clown fish")

# An entry stands in so many toxic training documents, however many there are.
MIN_TOXIC_DOCS = 3
MIN_LOG_ODDS = 2.5
NEARLY_ALL = 0.9
BEGINNINGS = range(3, 13)
# The lexicon and the score are fitted on at most so many labelled documents of each label, those whose
# ids have the smallest hashes; a list of ids of that size is what is broadcast.
TRAIN_ROWS = {1: 20_000, 0: 40_000}
SCORE_BINS = 64

_FOLD = {ord(c): latin for latin, group in LOOK_ALIKES.items() for c in group}
_FOLD |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_FOLD |= {0xFF10 + i: chr(48 + i) for i in range(10)}
# From a token's start: letters, then a sign or digit. Nothing is tried twice, however long the token.
_MIXED = re.compile(r"(?<![\w@$!])[^\W\d_]*+[0-9@$!][\w@$!]*+")
_WORD = re.compile(r"[^\W\d_]+")
_SUBSTITUTE = str.maketrans(SUBSTITUTES)


def _spelled(match: re.Match) -> str:
    token = match[0].strip("!")
    return token.translate(_SUBSTITUTE) if _WORD.search(token) else token


def folded_words(text: str) -> list[str]:
    text = text.lower().translate(_FOLD) if not text.isascii() else text.lower()
    if any(c in text for c in SUBSTITUTES):
        text = _MIXED.sub(_spelled, text)
    return _WORD.findall(text)


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, clean): documents of each label with the word, summed up in portions."""

    def portion() -> pa.RecordBatch:
        words = list(toxic | clean)
        columns = [pa.array(words, pa.string())]
        columns += [pa.array([c[w] for w in words], pa.int64()) for c in (toxic, clean)]
        return pa.RecordBatch.from_arrays(columns, ["word", "toxic", "clean"])

    toxic, clean = Counter(), Counter()
    for batch in slices(batches, "text"):
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            (toxic if label else clean).update(set(folded_words(text or "")))
        if len(clean) + len(toxic) > 300_000:
            yield portion()
            toxic, clean = Counter(), Counter()
    yield portion()


def learn_lexicon(train: DataFrame) -> tuple[dict[str, float], list[str]]:
    """(entry -> weight, exception words) from ``train`` (text, toxic 0/1).

    An entry ending in a space is a whole word. Every entry that passes the evidence rule is kept: it stands in
    ``MIN_TOXIC_DOCS`` of the sample's documents, so the lexicon is bounded by the sample (``TRAIN_ROWS``), not by the corpus.
    """
    by_label = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    n_toxic, n_clean = by_label.get(1, 0), by_label.get(0, 0)
    if not n_toxic or not n_clean:
        return {}, []
    words = train.select("text", "toxic").mapInArrow(_count_words, "word string, toxic long, clean long")
    words = cut(words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "words")

    ends = F.filter(F.array(*map(F.lit, BEGINNINGS)), lambda k: k <= F.length("word"))
    begins = F.transform(ends, lambda k: F.substring("word", F.lit(1), k))
    parts = words.select(F.explode(F.concat(begins, F.array(F.concat("word", F.lit(" "))))).alias("part"), "toxic", "clean")
    parts = parts.groupBy("part").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # log odds at one standard deviation to the cautious side, so that rare entries need clear evidence
    low = (F.col("toxic") - F.sqrt("toxic") + 0.5) / (n_toxic + 1.0)
    high = (F.col("clean") + F.sqrt(F.col("clean") + 1.0) + 0.5) / (n_clean + 1.0)
    strong = parts.withColumn("weight", F.log(low) - F.log(high)).filter(
        (F.col("toxic") >= MIN_TOXIC_DOCS) & (F.col("weight") >= MIN_LOG_ODDS)
    )
    strong = cut(strong, "strong_parts")
    # the largest continuation of a beginning, by one letter or by the word's end
    shorter = F.when(F.length("part") > F.lit(BEGINNINGS[-1]), F.substring("part", 1, BEGINNINGS[-1])).otherwise(
        F.expr("substring(part, 1, length(part) - 1)")
    )
    longest = strong.groupBy(shorter.alias("part")).agg(F.max("toxic").alias("next"))
    closed = strong.join(longest, "part", "left").filter(
        F.coalesce(F.col("next"), F.lit(0)) < NEARLY_ALL * F.col("toxic")
    )
    # entries that another entry begins are redundant
    lengths = F.sequence(F.lit(BEGINNINGS[0]), F.greatest(F.length("part") - 1, F.lit(BEGINNINGS[0])))
    inner = closed.select("part", F.explode(lengths).alias("k")).filter("k < length(part)")
    inner = inner.select("part", F.expr("substring(part, 1, k)").alias("start"))
    covered = inner.join(closed.select(F.col("part").alias("start")), "start", "left_semi").select("part").distinct()
    chosen = cut(closed.join(covered, "part", "left_anti").select("part", "weight"), "entries")
    lexicon = {r["part"]: r["weight"] for r in chosen.collect()}

    starts = {e for e in lexicon if not e.endswith(" ")}
    if not starts:
        return lexicon, []
    own_odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    clean_words = words.filter((F.col("clean") > 0) & (own_odds < 1.0)).withColumn("part", F.explode(begins))
    found = clean_words.join(chosen, "part", "left_semi").select("word").distinct()
    return lexicon, sorted(r["word"] for r in found.collect())


@lru_cache(maxsize=2)
def automaton(entries: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]) -> ahocorasick.Automaton:
    """Patterns with the space before them; values are (length, weight), weight 0 for exceptions."""
    a = ahocorasick.Automaton()
    for entry, weight in entries:
        a.add_word(" " + entry, (len(entry) + 1, weight))
    for phrase in exceptions:
        a.add_word(f" {phrase} ", (len(phrase) + 2, 0.0))
    a.make_automaton()
    return a


def text_weight(words: list[str], found: ahocorasick.Automaton) -> float:
    """Weights of the matches outside exceptions; of matches that start together the longest counts."""
    if not words or not len(found):
        return 0.0
    best: dict[int, tuple[int, float]] = {}
    excused: list[tuple[int, int]] = []
    for end, (length, weight) in found.iter(f" {' '.join(words)} "):
        start = end - length + 1
        if not weight:
            excused.append((start, end))
        elif length > best.get(start, (0, 0.0))[0]:
            best[start] = (length, weight)
    return sum(w for s, (_, w) in best.items() if not any(a <= s < b for a, b in excused))


def weigh(docs: DataFrame, lexicon: dict[str, float], exceptions: list[str]) -> DataFrame:
    """doc_id, weight (normalised by length) for every row of ``docs`` (doc_id, text)."""
    entries, phrases = tuple(sorted(lexicon.items())), tuple(sorted({*exceptions, *EXCEPTIONS}))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(entries, phrases) if entries else ahocorasick.Automaton()
        for batch in slices(batches, "text"):
            weights = []
            for text in batch.column("text").to_pylist():
                words = folded_words(text or "")
                weights.append(text_weight(words, found) / math.sqrt(len(words) + 1.0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(weights)], ["doc_id", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, weight double")


def weight_bin(weight: Column) -> Column:
    """0 for no match, then steps of a fifth of an octave."""
    step = F.floor(5.0 * F.log2(weight)) + 25
    return F.when(weight <= 0, 0).otherwise(F.least(F.greatest(step, F.lit(1)), F.lit(SCORE_BINS - 1))).cast("int")


def monotone_rates(toxic: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Rates that do not fall with the bin: neighbours that violate the order are pooled."""
    pools: list[list[float]] = []  # toxic, total, bins
    for t, n in zip(toxic, total, strict=True):
        pools.append([float(t), float(n), 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] > pools[-1][0] * pools[-2][1]:
            t1, n1, k1 = pools.pop()
            pools[-1] = [pools[-1][0] + t1, pools[-1][1] + n1, pools[-1][2] + k1]
    return np.concatenate([np.full(int(k), (t + 0.001) / (n + 0.002) if n else 0.0) for t, n, k in pools])


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text); ``labels``: doc_id, toxic."""
    remainder = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4))
    held_out = remainder == 2
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out)
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    samples = [known.filter(F.col("toxic") == label).orderBy(*by_hash).limit(n) for label, n in TRAIN_ROWS.items()]
    known = F.broadcast(cut(samples[0].unionByName(samples[1]), "training_ids"))
    train = docs.select("doc_id", "text").join(known, "doc_id")
    lexicon, exceptions = learn_lexicon(cut(train.select("text", "toxic"), "train"))
    weighed = cut(weigh(docs, lexicon, exceptions).withColumn("bin", weight_bin(F.col("weight"))), "weighed")

    bins = weighed.join(known, "doc_id").groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    toxic, total = np.zeros(SCORE_BINS), np.zeros(SCORE_BINS)
    for r in bins.collect():  # one row per bin at most
        toxic[r["bin"]], total[r["bin"]] = r["toxic"], r["n"]
    filled = total > 0
    rates = np.zeros(SCORE_BINS)
    if filled.any():
        places = np.flatnonzero(filled)
        # an empty bin scores like the next lower one that has documents
        rates = monotone_rates(toxic[filled], total[filled])[np.maximum(np.searchsorted(places, range(SCORE_BINS), "right") - 1, 0)]
    value = F.element_at(F.array(*(F.lit(float(r)) for r in rates)), F.col("bin") + 1)
    return weighed.select(
        "doc_id",
        held_out.alias("held_out"),
        value.alias("score"),
        (value >= threshold).cast("int").alias("predicted"),
    )
