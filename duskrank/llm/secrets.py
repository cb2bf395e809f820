"""Secret scans: fixed patterns, and a battery of randomness tests for everything else that looks like a key.

Base spans come from three patterns. The method adds spans of kind ``random``: maximal runs of key
characters with a letter and a digit, whose encoding (hex, base32, base36, base64) is inferred from the
characters. A run that mixes the signs of both base64 alphabets fits no encoding: it is cut at its slashes (so a
token behind a path is tested by itself), and what still mixes them at every sign. Tested is what carries at least ``MIN_BITS`` if uniform. Three tests ask whether such a run could
be a uniform draw from its alphabet: chi-squared of the character counts, number of runs above and below
the alphabet's middle, and lag-one serial correlation. Their p-values are combined by Fisher's method.

Error control: dismissing a run means rejecting "this is random". Benjamini-Hochberg bounds the share of
random strings among the dismissed ones by ``FDR``. It is applied per length class, because longer runs
are easier to reject and must not decide for short ones. The p-values are counted in ``BINS`` steps of
their logarithm, so the threshold needs one small count per class and step, over all documents.

Positions are code points, end exclusive. Null texts count as empty and have no spans; repeated rows are
scanned like any others and count in the error control as often as they occur. Other columns are not used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskrank.session import cut

# Fixed patterns of the result contract: (kind, pattern, what a match must fit as well).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LONG_HEX = r"[0-9a-f]{32,}"

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])"
# Pieces of a run that mixes + or / with - or _, and of a piece that mixes + with - or _.
SEGMENT, PLAIN = "[A-Za-z0-9+_-]{20,}", "[A-Za-z0-9]{20,}"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Encodings from the narrowest: (characters allowed, alphabet in order).
ENCODINGS = (
    ("^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("^[A-Z2-7]+$", UPPER + DIGITS[2:8]),
    ("^[0-9a-z]+$", DIGITS + LOWER),
    ("^[0-9A-Z]+$", DIGITS + UPPER),
    ("^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
MIN_BITS = 80.0
FDR = 0.05
BIN_WIDTH, BINS = 0.02, 5000
_BLOCK = 256


def running_sum(values: Column) -> Column:
    """Sums of array<long> ``values`` up to each element; blocks keep the copying of arrays short."""

    def sums(block: Column, first: Column) -> Column:
        start = F.array(first)
        run = F.aggregate(block, start, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(run, F.lit(2), F.size(block))

    def total(block: Column) -> Column:
        return F.aggregate(block, F.lit(0).cast("long"), lambda acc, x: acc + x)

    zero = F.lit(0).cast("long")
    n_blocks = F.ceil(F.size(values) / _BLOCK).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), n_blocks - 1), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK))
    )
    offsets = F.aggregate(
        blocks, F.array(zero), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + total(b)))
    )
    run = F.flatten(F.zip_with(blocks, F.slice(offsets, F.lit(1), n_blocks), lambda b, o: sums(b, o)))
    return F.when(F.size(values) > 0, run).otherwise(F.array().cast("array<long>"))


def _spans(text: Column, pattern: str, kind: str, order: int, valid=None) -> Column:
    """array<struct<start, rank, stop, kind, text>> of the leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.transform(found, lambda m: F.length(m).cast("long"))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("long"))
    # end of match i: the gaps up to it and the matches up to it
    ends = running_sum(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), lengths, lambda g, n: g + n))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if valid else found
    spans = F.zip_with(
        F.arrays_zip(found.alias("m"), value.alias("v")),
        ends,
        lambda mv, e: F.struct(
            (e - F.length(mv["m"])).alias("start"),
            F.lit(order).alias("rank"),
            e.alias("stop"),
            F.lit(kind).alias("kind"),
            mv["m"].alias("text"),
            mv["v"].alias("value"),
        ),
    )
    if valid:
        spans = F.filter(spans, lambda s: valid(s["value"]))
    return F.transform(spans, lambda s: s.dropFields("value"))


def _unmixed(run: Column) -> Column:
    """The run itself, or the pieces of a run that fits no encoding, as spans of the text."""

    def mixed(span: Column) -> Column:
        return span["text"].rlike("[+/]") & span["text"].rlike("[_-]")

    def pieces(span: Column, pattern: str) -> Column:
        return F.transform(
            _spans(span["text"], pattern, "random", 3),
            lambda s: F.struct(
                (s["start"] + span["start"]).alias("start"), s["rank"].alias("rank"), (s["stop"] + span["start"]).alias("stop"),
                s["kind"].alias("kind"), s["text"].alias("text"),
            ),
        )

    def plain(span: Column) -> Column:
        return F.when(mixed(span), pieces(span, PLAIN)).otherwise(F.array(span))

    return F.when(mixed(run), F.flatten(F.transform(pieces(run, SEGMENT), plain))).otherwise(F.array(run))


def _upper_normal(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a polynomial times a Gaussian (absolute error below 1e-7)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (1.0 + 0.3275911 * x)
    # fixed coefficients of the complementary error function's rational approximation
    poly = reduce(
        lambda acc, c: acc * t + c, (-1.453152027, 1.421413741, -0.284496736, 0.254829592), F.lit(1.061405429)
    )
    tail = 0.5 * poly * t * F.exp(-x * x)
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def _clamp(p: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-40), p))


def randomness(runs: DataFrame) -> DataFrame:
    """Adds n, alphabet, p (Fisher's combination of the three tests) to rows with a string ``text``.

    Small p: not a uniform draw. Rows that fit no encoding or carry too few bits are dropped.
    """
    alphabet = F.coalesce(*(F.when(F.col("text").rlike(rule), F.lit(chars)) for rule, chars in ENCODINGS))
    k = F.length("alphabet").cast("double")
    counts = F.aggregate(
        F.split("alphabet", ""),
        F.lit(0.0),
        lambda acc, c: acc + F.pow((F.length("text") - F.length(F.replace(F.col("text"), c, F.lit("")))).cast("double"), 2.0),
    )
    df = runs.withColumn("alphabet", alphabet).filter("alphabet IS NOT NULL")
    df = df.withColumn("n", F.length("text").cast("double"))
    df = df.filter(F.col("n") * F.log2(k) >= MIN_BITS)
    codes = F.transform(
        F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.instr(F.col("alphabet"), c).cast("double") - 0.5
    )
    df = df.withColumn("codes", codes)
    n = F.col("n")

    chi = k / n * counts - n
    free = k - 1.0
    cube = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1.0 / 3.0)) - (1.0 - 2.0 / (9.0 * free))) / F.sqrt(
        2.0 / (9.0 * free)
    )
    high = F.transform("codes", lambda x: x > k / 2.0)
    above = F.size(F.filter(high, lambda h: h)).cast("double")
    below = n - above
    pairs = F.sequence(F.lit(1), F.size("codes") - 1)
    changes = F.size(F.filter(pairs, lambda i: F.element_at(high, i) != F.element_at(high, i + 1))).cast("double")
    mean_runs = 2.0 * above * below / n + 1.0
    var_runs = (mean_runs - 1.0) * (mean_runs - 2.0) / (n - 1.0)
    z_runs = F.when(var_runs > 0, (changes + 1.0 - mean_runs) / F.sqrt(var_runs)).otherwise(F.lit(40.0))

    mean = F.aggregate("codes", F.lit(0.0), lambda acc, x: acc + x) / n
    spread = F.aggregate("codes", F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    lagged = F.aggregate(
        pairs, F.lit(0.0), lambda acc, i: acc + (F.element_at("codes", i) - mean) * (F.element_at("codes", i + 1) - mean)
    )
    z_serial = F.when(spread > 0, (lagged / spread + 1.0 / (n - 1.0)) * F.sqrt(n)).otherwise(F.lit(40.0))
    df = df.select(
        *df.columns,
        _clamp(_upper_normal(cube)).alias("p_chi"),
        _clamp(2.0 * _upper_normal(F.abs(z_runs))).alias("p_runs"),
        _clamp(2.0 * _upper_normal(F.abs(z_serial))).alias("p_serial"),
    )
    half = -(F.log("p_chi") + F.log("p_runs") + F.log("p_serial"))  # half of Fisher's statistic, 6 degrees
    return df.withColumn("p", _clamp(F.exp(-half) * (1.0 + half + half * half / 2.0))).drop("codes")


def length_class(n: Column) -> Column:
    return F.floor(F.log2(n)).cast("int")


def p_bin(p: Column) -> Column:
    """Step of -log p; a larger step is a smaller p."""
    return F.least(F.floor(-F.log(p) / BIN_WIDTH), F.lit(BINS)).cast("int")


def thresholds(tested: DataFrame, fdr: float = FDR) -> DataFrame:
    """(class, cut): runs of the class whose p-step is ``cut`` or more are dismissed.

    Benjamini-Hochberg with every p-value rounded up to its step's upper bound, which dismisses no more
    than the exact rule. At most one row per length class.
    """
    counts = tested.groupBy("class", "bin").count()
    smaller = Window.partitionBy("class").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy("class")
    ranked = counts.withColumn("_rank", F.sum("count").over(smaller)).withColumn("_m", F.sum("count").over(everything))
    bound = F.exp(-F.col("bin") * BIN_WIDTH)
    return ranked.filter(bound <= fdr * F.col("_rank") / F.col("_m")).groupBy("class").agg(F.min("bin").alias("cut"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, base and added spans as arrays of structs."""
    text = F.col("text")
    none = F.array().cast("array<struct<start:bigint,rank:int,stop:bigint,kind:string,text:string>>")

    def where(condition: Column, spans: Column) -> Column:
        return F.when(condition, spans).otherwise(none)

    found = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).select(
        "doc_id",
        where(text.rlike(ASSIGN), _spans(text, ASSIGN, "assign", 0, lambda v: F.length(v) >= 8)).alias("assign"),
        where(
            text.contains("AKIA"), F.filter(_spans(text, ACCESS, "access", 1), lambda s: F.length(s["text"]) >= 16)
        ).alias("access"),
        # a run of 32 or more is the only kind of HEX match that passes, wherever shorter ones lie
        where(text.rlike(LONG_HEX), _spans(text, LONG_HEX, "hex", 2)).alias("hex"),
        where(text.rlike(CANDIDATE), _spans(text, CANDIDATE, "random", 3)).alias("more"),
    )
    base = F.concat("assign", "access", "hex")
    found = found.withColumn("base", F.array_sort(base))
    apart = F.filter(
        F.flatten(F.transform("more", _unmixed)),
        lambda m: (
            m["text"].rlike("[0-9]")
            & m["text"].rlike("[A-Za-z]")
            & ~F.exists("base", lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"]))
        ),
    )
    # the texts' spans are small: written once, the corpus is not scanned again
    found = cut(found.withColumn("more", apart).drop("assign", "access", "hex").withColumn("_row", F.uuid()), "spans")

    runs = found.filter(F.size("more") > 0).select("_row", F.inline("more"))
    tested = randomness(runs).withColumn("class", length_class(F.col("n"))).withColumn("bin", p_bin(F.col("p")))
    tested = cut(tested.select("_row", "start", "rank", "stop", "kind", "text", "class", "bin"), "tested")
    passed = tested.join(thresholds(tested), "class", "left").filter("cut IS NULL OR bin < cut")
    added = passed.groupBy("_row").agg(F.collect_list(F.struct("start", "rank", "stop", "kind", "text")).alias("added"))
    return found.join(added, "_row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns: counts per base kind, digest of the base spans, and all spans as text."""

    def listed(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))),
            ",",
        )

    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan(docs).select(
        "doc_id",
        n("assign"),
        n("access"),
        n("hex"),
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
