"""What the rows of a speaker agree on, and rows that follow it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.runs import merged

KEYS = ("media", "speaker")


def primary_language(rows: DataFrame, weight: Column, keys: Sequence[str] = KEYS, skip: Sequence[str] = ("other",)) -> DataFrame:
    """``(keys, lang, weight, total, n)``: the heaviest language of each key, the first seen on ties."""
    rows = rows.where(~F.col("lang").isin(*skip)).withColumn("_w", weight)
    by = rows.groupBy(*keys, "lang").agg(F.sum("_w").alias("weight"), F.count("*").alias("n"), F.min(F.struct("s", "pos")).alias("first"))
    best = F.max_by(F.struct("lang", "weight", "n"), F.struct("weight", (-F.col("first.s")).alias("a"), (-F.col("first.pos")).alias("b")))
    return by.groupBy(*keys).agg(best.alias("m"), F.sum("weight").alias("total"), F.sum("n").alias("rows")).select(*keys, F.col("m.lang").alias("primary"), F.col("m.weight").alias("weight"), "total", F.col("m.n").alias("n"), "rows")


def with_prior(rows: DataFrame, least: int = 3, share: float = 0.6, weak_below: float | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """``other`` rows (and, given ``weak_below``, less confident ones) take their speaker's majority language."""
    prior = primary_language(rows, F.lit(1), keys, ("other", "silence")).where((F.col("total") >= least) & (F.col("weight") / F.col("total") >= share))
    joined = rows.join(prior.select(*keys, "primary"), list(keys), "left")
    weak = F.col("lang") == "other"
    if weak_below is not None:
        weak = weak | ((F.col("conf") < weak_below) & (F.col("lang") != "silence"))
    return joined.withColumn("lang", F.when(F.col("primary").isNotNull() & weak, F.col("primary")).otherwise(F.col("lang"))).drop("primary")


def flipped_by_evidence(rows: DataFrame, marked: Column, of: str, to: str, below: float = 0.7, least_rows: int = 5, least_hits: int = 3, share: float = 0.15, keys: Sequence[str] = KEYS) -> DataFrame:
    """Two passes: where enough of a speaker's rows carry evidence, doubtful ``of`` rows become ``to``."""
    seen = rows.groupBy(*keys).agg(F.count("*").alias("_t"), F.count_if(marked).alias("_h"))
    joined = rows.join(seen, list(keys))
    flip = (F.col("_t") >= least_rows) & (F.col("_h") >= least_hits) & (F.col("_h") / F.col("_t") >= share) & (F.col("lang") == of) & (F.col("conf") < below)
    return joined.withColumn("lang", F.when(flip, F.lit(to)).otherwise(F.col("lang"))).drop("_t", "_h")


def smoothed(rows: DataFrame, least_units: int = 5, ratio: float = 0.3, protected: Sequence[str] = ("may", "lat"), keys: Sequence[str] = KEYS) -> DataFrame:
    """Short or doubtful rows of a speaker with two rows or more take the primary language, by units; equal neighbours merge.

    Rows have ``n`` units and a summed confidence ``conf``; a row is doubtful under
    ``ratio`` times the speaker's confidence for each unit times its own units.
    """
    stats = rows.where("lang <> 'other'").groupBy(*keys).agg((F.sum("conf") / F.sum("n")).alias("_avg"))
    primary = primary_language(rows, F.col("n"), keys).select(*keys, "primary")
    counted = rows.withColumn("_rows", F.count("*").over(Window.partitionBy(*keys)))
    joined = counted.join(primary, list(keys), "left").join(stats, list(keys), "left")
    weak = (F.col("n") < least_units) | (F.col("conf") < ratio * F.col("_avg") * F.col("n"))
    change = (F.col("_rows") >= 2) & F.col("primary").isNotNull() & ~F.col("lang").isin(*protected) & (F.col("lang") != F.col("primary"))
    change = change & F.when(F.col("lang") == "other", F.col("n") < least_units).otherwise(weak)
    changed = joined.withColumn("lang", F.when(change, F.col("primary")).otherwise(F.col("lang"))).drop("_rows", "primary", "_avg")
    return merged(changed.withColumn("units", F.col("n")), ["lang"], keys)


def inherited(rows: DataFrame, profiles: DataFrame, least: int = 5, share: float = 0.8, longest: int = 1000, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows not transcribed that are ``other`` or short take the language of a speaker known well enough."""
    known = profiles.where((F.col("rows") >= least) & (F.col("n") / F.col("rows") >= share)).select(*keys, "primary")
    joined = rows.join(known, list(keys), "left")
    take = F.col("primary").isNotNull() & (F.col("backend") != "whisper") & ((F.col("lang") == "other") | (F.col("e") - F.col("s") < longest)) & ~F.col("lang").isin("may", "lat")
    return joined.withColumn("lang", F.when(take, F.col("primary")).otherwise(F.col("lang"))).drop("primary")


def speaking_shares(rows: DataFrame, keys: Sequence[str] = ("media",)) -> DataFrame:
    """Percent of the speaking time of each speaker, rounded half to even, most first: ``rank``."""
    times = rows.where("speaker IS NOT NULL").groupBy(*keys, "speaker").agg(F.sum(F.col("e") - F.col("s")).alias("time"))
    whole = F.sum("time").over(Window.partitionBy(*keys))
    order = Window.partitionBy(*keys).orderBy(F.col("time").desc(), "speaker")
    return times.withColumn("percent", F.bround(100 * F.col("time") / whole).cast("long")).withColumn("rank", F.row_number().over(order))
