"""Mixing sources to target weights by capped water-filling, then seeded repetitions of documents.

Targets: each source gets its weight's share of a word budget, but at most ``max_epochs`` times its
own size; what a clamped source cannot take is shared by weight among the others. With the sources in
the order of cap / weight, the first i of them are clamped at the level lambda, so lambda follows from
two running sums over one row per source and no loop is needed.

Repetitions: a target of 1.3 times the source's size means that every document enters once, and
documents in the order of a seeded hash enter once more until 0.3 of the size is reached; the document
at the border enters with as many words as are missing. A source's words thus meet its target exactly.
The border is found without ordering a source: the hash range is cut into slices of about
``SLICE_ROWS`` documents, whole slices are summed, and only the slice with the border is ordered.

Null texts have no words. Null is a source of its own, ranked last. Rows that repeat a document id are
documents of their own; equal rows are interchangeable. A null id is hashed as 'null'. An empty table
gives no rows. Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskrank.llm.common import WORD
from duskrank.session import cut

SEED = 17
SLICE_ROWS = 1 << 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sources: DataFrame, cycle: Sequence[int] = (3, 1, 2), budget: float = 1.5, max_epochs: float = 2.0
) -> DataFrame:
    """Adds weight and target to one row per source (source, source_size).

    Weights repeat ``cycle`` over the sources in code-point order, null last. The windows see one row
    per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(cycle)
    weighted = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), place + 1).cast("double"))
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        weighted.withColumn("_cap", cap)
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_budget", F.lit(float(budget)) * F.sum("source_size").over(everything))
        .withColumn("_level", F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_level") / F.sum("weight").over(onwards))
    )
    # the level that holds is that of the first source it does not clamp; none: the budget exceeds all caps
    holds = F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))
    level = F.min(holds).over(everything)["_level"]
    target = F.coalesce(F.least(F.col("_cap"), F.col("weight") * level), F.col("_cap"))
    return filled.withColumn("target", target).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, seed: int = SEED, slice_rows: int = SLICE_ROWS, **targets) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source)."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    sized = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), order.alias("_order")), "sized")

    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    filled = source_targets(sources.select("source", "source_size"), **targets)
    words = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    plan = (
        filled.alias("f")
        .join(sources.select(F.col("source").alias("_s"), "_rows"), F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("_whole", whole)
        .withColumn("_extra", words - F.col("_whole") * F.col("source_size"))
        .withColumn("_slices", F.ceil(F.col("_rows") / slice_rows).cast("long"))
        .select(F.col("_s"), "source_size", "target", "_whole", "_extra", "_slices")
    )
    plan = cut(plan, "plan")
    place = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long")
    slice_of = F.shiftright(place * F.col("_slices"), 32)
    placed = sized.join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_slice", slice_of)

    sums = placed.groupBy("source", "_slice").agg(F.sum("size").alias("_sum"), F.first("_extra").alias("_extra"))
    up_to = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("_end", F.sum("_sum").over(up_to)).filter(F.col("_end") > F.col("_extra"))
    border = ends.groupBy(F.col("source").alias("_s")).agg(
        F.min(F.struct("_slice", (F.col("_end") - F.col("_sum")).alias("_before"))).alias("_border")
    )
    # a source has no border if all its words are taken alike (nothing extra, or no words at all)
    joined = placed.join(border, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    at_border = F.coalesce(F.col("_slice") == F.col("_border._slice"), F.lit(False))
    inside = joined.filter(~at_border).withColumn(
        "_more", F.when(F.col("_slice") < F.col("_border._slice"), F.col("size")).otherwise(F.lit(0))
    )
    earlier = Window.partitionBy("source").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_extra") - F.col("_border._before") - F.coalesce(F.sum("size").over(earlier), F.lit(0))
    split = joined.filter(at_border).withColumn("_more", F.least(F.col("size"), F.greatest(F.lit(0), left)))
    taken = F.col("_whole") * F.col("size") + F.col("_more")
    columns = ["doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken")]
    return inside.select(*columns).unionByName(split.select(*columns))


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``docs`` with every document as often as the mix takes it, whole texts only.

    The document at a source's border enters once more if at least half of its words are taken. Rows meet
    by id, size and source. Rows that share all three share out the copies that the mix gives them
    together: they are numbered, and the first ones enter once more than the others.
    """
    half = F.col("taken") * 2 >= F.col("size") * (2 * F.floor(F.col("taken") / F.col("size")) + 1)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size")) + half.cast("int")).otherwise(0)
    times = mixed.groupBy(F.col("doc_id").alias("_mix_id"), F.col("size").alias("_mix_size"), F.col("source").alias("_mix_source"))
    times = times.agg(F.sum(copies).alias("_mix_sum"), F.count(F.lit(1)).alias("_mix_n")).filter("_mix_sum > 0")
    times = times.withColumn("_mix_copies", F.floor(F.col("_mix_sum") / F.col("_mix_n")).cast("int"))
    times = times.withColumn("_mix_more", F.col("_mix_sum") - F.col("_mix_copies") * F.col("_mix_n"))
    sized = docs.withColumn("_mix_words", n_words(F.col("text")))
    on = (
        sized["doc_id"].eqNullSafe(times["_mix_id"])
        & (sized["_mix_words"] == times["_mix_size"])
        & sized["source"].eqNullSafe(times["_mix_source"])
    )
    met = sized.join(times, on)
    alike, shared = met.filter("_mix_more = 0"), met.filter("_mix_more > 0")
    rows = alike.select(*docs.columns, "_mix_copies").unionByName(_shared_out(shared).select(*docs.columns, "_mix_copies"))
    copy = F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))
    return rows.filter("_mix_copies > 0").withColumn("_mix_copy", copy).select(*docs.columns)


def _shared_out(rows: DataFrame) -> DataFrame:
    """Adds one copy to ``_mix_more`` rows of each group; rows are numbered within the written parts, then across them."""
    rows = cut(rows.withColumn("_mix_row", F.monotonically_increasing_id()), "shared_rows")
    rows = rows.withColumn("_mix_part", F.shiftright("_mix_row", 33))
    names = ["_mix_id", "_mix_size", "_mix_source"]
    parts = rows.groupBy(*names, "_mix_part").agg(F.count(F.lit(1)).alias("_mix_held"))
    earlier = Window.partitionBy(*names).orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_mix_before", F.coalesce(F.sum("_mix_held").over(earlier), F.lit(0))).alias("p")
    on = F.col("r._mix_part") == F.col("p._mix_part")
    for name in names:
        on = on & F.col(f"r.{name}").eqNullSafe(F.col(f"p.{name}"))
    placed = rows.alias("r").join(parts, on).select("r.*", "_mix_before")
    place = F.row_number().over(Window.partitionBy(*names, "_mix_part").orderBy("_mix_row")) + F.col("_mix_before")
    more = (place <= F.col("_mix_more")).cast("int")
    return placed.withColumn("_mix_copies", F.col("_mix_copies") + more)


SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(concat('17:', coalesce(doc_id::VARCHAR, 'null'))) AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sized GROUP BY source),
caps AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, (2.0::DOUBLE * source_size) / weight AS ratio,
         1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM sources),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM caps),
chosen AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE level <= ratio),
targets AS (
  SELECT source, source_size, least(cap, weight * chosen.level) AS target FROM levels, chosen),
plan AS (
  SELECT *, floor(target + 0.5)::BIGINT AS words,
         CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS whole
  FROM targets),
ordered AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, p.words - p.whole * p.source_size AS extra,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (whole * size + least(size, greatest(0, extra - before)))::BIGINT AS taken
FROM ordered
"""
