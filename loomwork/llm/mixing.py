"""Mixing sources to target weights, in DataFrame functions only.

The schedule is a low-discrepancy sequence: slot ``k`` has the golden-ratio
point ``frac(k * 0.618...)``, and the source whose interval of the cumulative
slot shares holds it.  A source's documents lie end to end in a fixed shuffled
order and are cut into blocks of equal numbers of words; the slots of a source are
ranked, and slot rank ``r`` takes block ``r mod blocks``, so that every pass
over a source is whole before the next one begins, and none begins beyond the
allowed number of passes.

Nothing is ordered globally: offsets within a source and ranks within the
schedule come from sums over small ranges of shuffle keys and of slots, so that
a source with a third of all rows is spread like the others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm._spark import settle, table

WEIGHTS = (5, 2, 1)
GOLDEN = 0.6180339887498949
GOLDEN_SEGMENT = 0.47548671310877194  # frac(65536 * golden ratio), so that far points keep their digits
SEGMENT = 65536
CELLS = 1024
ROWS_A_RANGE = 4096


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """``(source, si, source_size, target)`` from ``(source, source_size)``.

    Sources in order of code points, null last, have the weights in turn and share
    the sum of all sizes; a target stops at ``most`` times its source's size
    and the excess is shared again by weight.  In order of size over weight, a source is
    full if the level that it and those after it would reach is above it.
    """
    everything = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("si"), F.lit(len(weights))).cast("int") + 1)
    rows = sizes.withColumn("si", F.row_number().over(everything) - 1).withColumn("w", weight.cast("long")).withColumn("cap", most * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "si")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        "*",
        F.sum("source_size").over(whole).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("filled"),
        F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
    )
    full = F.col("cap") * F.col("rest") <= F.col("w") * (F.col("total") - F.col("filled"))
    rows = rows.withColumn("full", full)
    over = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole)
    open_ = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(whole)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("w") * (F.col("total") - over)).cast("double") / open_.cast("double"))
    return rows.select("source", F.col("si").cast("long").alias("si"), "source_size", target.alias("target"))


def _plan(sources: DataFrame, block_words: int, min_blocks: int, most: int) -> DataFrame:
    """Adds the block length and count, and the interval [lo, hi) of the points that a source has."""
    length = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("source_size") / min_blocks))).cast("long")
    rows = sources.withColumn("block_len", length).withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block_len")).cast("long"))
    rows = rows.withColumn("slots", F.col("target") / F.col("block_len"))
    run = Window.orderBy("si").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("upto", F.sum("slots").over(run)).withColumn("all_slots", F.sum("slots").over(whole))
    return rows.withColumn("lo", (F.col("upto") - F.col("slots")) / F.col("all_slots")).withColumn("hi", F.col("upto") / F.col("all_slots")).withColumn("most", F.lit(most))


def schedule(plan: DataFrame) -> DataFrame:
    """``(slot, si, pass, block)``: what the mix takes, in order; ``plan`` is the settled table of sources."""
    spark = plan.sparkSession
    count = plan.agg(F.round(F.max("all_slots")).cast("long").alias("n")).first().n or 0
    hi, lo = F.floor(F.col("id") / SEGMENT).cast("double"), (F.col("id") % SEGMENT).cast("double")
    frac = lambda x: x - F.floor(x)
    points = spark.range(count).select(F.col("id").alias("slot"), frac(frac(hi * F.lit(GOLDEN_SEGMENT)) + frac(lo * F.lit(GOLDEN))).alias("u"))
    cell = lambda x: F.floor(x * CELLS)
    cells = plan.where("slots > 0").select("si", "lo", F.when(F.col("upto") == F.max("upto").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(2.0)).otherwise(F.col("hi")).alias("hi"), "n_blocks", "most")
    cells = cells.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), F.least(cell(F.col("hi")), F.lit(CELLS - 1)))))
    taken = points.withColumn("cell", cell(F.col("u"))).join(cells, "cell").where("lo <= u AND u < hi")
    taken = taken.select("slot", "si", "n_blocks", "most", F.floor(F.col("slot") / SEGMENT).alias("segment"))
    counts = taken.groupBy("si", "segment").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("si").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("si", "segment", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("si", "segment").orderBy("slot")) - 1
    ranked = taken.withColumn("r", rank).join(starts, ["si", "segment"]).withColumn("rank", F.col("start") + F.col("r"))
    ranked = ranked.where(F.col("rank") < F.col("most") * F.col("n_blocks"))
    return ranked.select("slot", "si", F.floor(F.col("rank") / F.col("n_blocks")).alias("pass"), (F.col("rank") % F.col("n_blocks")).alias("block"))


def offsets(sizes: DataFrame, n_rows: int) -> DataFrame:
    """Adds ``at``, the words of the source's documents before this one in shuffled order."""
    digits = max(0, math.ceil(math.log(max(1, n_rows / ROWS_A_RANGE), 16)))
    rows = sizes.withColumn("range", F.substring("key", 1, digits) if digits else F.lit(""))
    sums = rows.groupBy("si", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("si").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("si", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("si", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["si", "range"])
    return rows.withColumn("at", F.col("start") + F.col("inner")).drop("range", "inner", "start")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, block_words: int = 64, min_blocks: int = 256, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for every row of ``docs``: doc_id, size, source_size, target, taken.

    ``size`` counts words (runs outside ``[\\x20\\x09-\\x0D]``; 0 for a null or
    empty text), ``taken`` the words that the schedule takes of the document,
    repeats counted; it is ``most`` times the size at most.  A source's taken
    words differ from its target by a few blocks of ``block_words`` words (small
    sources: of 1/``min_blocks`` of their words).  The order of documents hangs on their
    ids alone, so that reruns agree; repeated rows are documents of their own, and
    null ids are one key.  An empty table gives an empty result; other columns are not read.
    """
    key = F.md5(F.coalesce(docs[id_col].cast("string"), F.lit("")))
    rows = settle(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), F.coalesce(n_words(docs[text_col].cast("string")), F.lit(0).cast("long")).alias("size"), key.alias("key")))
    plan = settle(_plan(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), block_words, min_blocks, most))
    known = rows.join(plan.select("source", "si", "source_size", "target", "block_len"), rows["source"].eqNullSafe(plan["source"])).drop(rows["source"]).drop(plan["source"])
    placed = offsets(known, rows.count())
    first, last = F.floor(F.col("at") / F.col("block_len")), F.floor((F.col("at") + F.col("size") - 1) / F.col("block_len"))
    times = schedule(plan).groupBy("si", "block").agg(F.count("*").alias("times"))
    spans = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    shared = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("block_len")) - F.greatest(F.col("at"), F.col("block") * F.col("block_len"))
    columns = ["doc_id", "size", "source_size", "target"]
    took = spans.join(times, ["si", "block"], "left").groupBy(*columns, "si", "at").agg(F.sum(shared * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    return took.select(*columns, "taken").unionByName(placed.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: ``taken / size`` times, rounded half up.

    Documents without words are not in the schedule and stay once.  Repeated
    rows share one answer, the most that one of them has.
    """
    often = mix(docs, id_col=id_col, **options).select(F.col("doc_id").alias("__mix_id"), F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).alias("__copies"))
    often = often.groupBy("__mix_id").agg(F.max("__copies").cast("int").alias("__copies")).where("__copies > 0")
    rows = docs.join(often, docs[id_col].cast("long").eqNullSafe(often["__mix_id"]))
    return rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies")))).select(*(docs[c] for c in docs.columns))


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS si FROM s0),
s2 AS (SELECT *, [5, 2, 1][1 + si % 3]::BIGINT AS w, 3 * source_size AS cap FROM s1),
s3 AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / w, si ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS filled,
         (sum(w) OVER (ORDER BY cap / w, si ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest
  FROM s2),
s4 AS (SELECT *, cap * rest <= w * (total - filled) AS is_full FROM s3),
s5 AS (
  SELECT *, (coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0))::BIGINT AS over_cap,
         (coalesce(sum(w) FILTER (WHERE NOT is_full) OVER (), 0))::BIGINT AS open_w
  FROM s4),
s6 AS (
  SELECT source, si, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE (w * (total - over_cap))::DOUBLE / open_w::DOUBLE END AS target,
         greatest(1, least(64, source_size // 256))::BIGINT AS block_len
  FROM s5),
s7 AS (SELECT *, ceil(source_size / block_len)::BIGINT AS n_blocks, target / block_len AS slots FROM s6),
s8 AS (
  SELECT *, sum(slots) OVER (ORDER BY si ROWS UNBOUNDED PRECEDING) AS upto,
         sum(slots) OVER (ORDER BY si ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS all_slots
  FROM s7),
s AS (
  SELECT *, (upto - slots) / all_slots AS lo, CASE WHEN upto = max(upto) OVER () THEN 2.0::DOUBLE ELSE upto / all_slots END AS hi
  FROM s8),
p0 AS (
  SELECT slot, (slot // 65536)::DOUBLE * 0.47548671310877194::DOUBLE AS x, (slot % 65536)::DOUBLE * 0.6180339887498949::DOUBLE AS y
  FROM (SELECT unnest(range((SELECT coalesce(round(max(all_slots)), 0)::BIGINT FROM s))) AS slot)),
p AS (SELECT slot, (x - floor(x)) + (y - floor(y)) AS z FROM p0),
t AS (
  SELECT si, n_blocks, row_number() OVER (PARTITION BY si ORDER BY slot) - 1 AS rnk
  FROM p JOIN s ON s.slots > 0 AND s.lo <= z - floor(z) AND z - floor(z) < s.hi),
times AS (SELECT si, rnk % n_blocks AS block, count(*) AS times FROM t WHERE rnk < 3 * n_blocks GROUP BY ALL),
o AS (
  SELECT d.doc_id, d.size, s.si, s.source_size, s.target, s.block_len, d.key,
         coalesce(sum(d.size) OVER (PARTITION BY s.si ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos0
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
b AS (SELECT *, unnest(CASE WHEN size > 0 THEN range(pos0 // block_len, (pos0 + size - 1) // block_len + 1) ELSE [0] END) AS block FROM o)
SELECT b.doc_id, b.size, b.source_size, b.target,
       sum(CASE WHEN b.size = 0 THEN 0 ELSE (least(pos0 + size, (b.block + 1) * block_len) - greatest(pos0, b.block * block_len)) * coalesce(times, 0) END)::BIGINT AS taken
FROM b LEFT JOIN times ON b.si = times.si AND b.block = times.block
GROUP BY b.doc_id, b.size, b.source_size, b.target, b.si, b.pos0
"""
