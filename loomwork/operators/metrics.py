"""Evaluation: confusion, precision and recall, costs, agreement, intervals, rhythm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What mistaking the first label for the second costs.
COSTS = {("nah", "spa"): 2.0, ("nah", "oth"): 1.5, ("nah", "unk"): 0.5, ("may", "spa"): 2.0, ("may", "oth"): 1.5, ("may", "unk"): 0.5, ("spa", "nah"): 1.5, ("spa", "may"): 1.5}
DEFAULT_COST, ABSTAIN_COST, LARGEST_COST = 1.0, 0.5, 2.0


def matched(truth: DataFrame, predicted: DataFrame, key: str = "cue", missing: str = "oth") -> DataFrame:
    """``(key, gt, pred, dur, found)``: a truth without a prediction counts as ``missing``; its length falls back to the prediction's."""
    p = predicted.select(key, F.col("lang").alias("pred"), F.col("dur").alias("_pd"), F.lit(True).alias("_f"))
    rows = truth.select(key, F.col("lang").alias("gt"), F.col("dur").alias("_td")).join(p, key, "left")
    dur = F.greatest(F.when(F.col("_td") > 0, F.col("_td")).otherwise(F.coalesce("_pd", F.lit(0))), F.lit(0))
    return rows.select(key, "gt", F.coalesce("pred", F.lit(missing)).alias("pred"), dur.alias("dur"), F.coalesce("_f", F.lit(False)).alias("found"))


def confusion(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys, "gt", "pred").agg(F.count("*").alias("n"))


def by_label(rows: DataFrame) -> DataFrame:
    """True positives, false ones, misses, precision, recall and F1 of every label."""
    wrong = (F.col("gt") != F.col("pred")).cast("int")
    side = lambda label, tp, fp, fn: F.struct(label.alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    sides = rows.select(F.explode(F.array(side(F.col("gt"), 1 - wrong, F.lit(0), wrong), side(F.col("pred"), F.lit(0), wrong, F.lit(0)))).alias("x"))
    sums = sides.groupBy(F.col("x.label").alias("label")).agg(*(F.sum(f"x.{c}").alias(c) for c in ("tp", "fp", "fn")))
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return sums.withColumn("precision", p).withColumn("recall", r).withColumn("f1", 2 * p * r / F.greatest(p + r, F.lit(0.001)))


def accuracies(rows: DataFrame) -> DataFrame:
    """One row: share of rows and of time that is right, of all, without abstentions, and of two languages."""
    right = F.col("gt") == F.col("pred")
    share = lambda cond: F.count_if(right & cond) / F.greatest(F.count_if(cond), F.lit(1))
    return rows.agg(
        F.count("*").alias("n"),
        share(F.lit(True)).alias("accuracy"),
        share((F.col("gt") != "unk") & (F.col("pred") != "unk")).alias("accuracy_known"),
        share(F.col("gt").isin("nah", "spa")).alias("accuracy_two"),
        (F.sum(F.when(right, F.col("dur")).otherwise(0)) / F.greatest(F.sum("dur").cast("double"), F.lit(0.001))).alias("accuracy_time"),
    )


def cost_of(gt: Column, pred: Column) -> Column:
    special = F.create_map(*(F.lit(x) for (a, b), c in COSTS.items() for x in (f"{a}>{b}", c)))[F.concat_ws(">", gt, pred)]
    return F.when(gt == pred, 0.0).when(gt == "unk", 0.0).when(pred == "unk", F.coalesce(special, F.lit(ABSTAIN_COST))).otherwise(F.coalesce(special, F.lit(DEFAULT_COST)))


def costs(rows: DataFrame) -> DataFrame:
    """Total cost and the score left of the largest one possible."""
    most = LARGEST_COST * F.count_if(F.col("gt") != "unk")
    total = F.sum(cost_of(F.col("gt"), F.col("pred")))
    return rows.agg(total.alias("cost"), most.alias("most"), (1 - total / F.greatest(most, F.lit(0.001))).alias("score"))


def dearest_pairs(rows: DataFrame, top: int = 10) -> DataFrame:
    pairs = rows.where("gt <> pred").groupBy("gt", "pred").agg(F.count("*").alias("n"), F.sum(cost_of(F.col("gt"), F.col("pred"))).alias("cost"))
    return pairs.orderBy(F.col("cost").desc(), "gt", "pred").limit(top)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a share, rounded to 6 places; (0, 1) for none."""
    p, z2 = hits / n, z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    margin = z / (1 + z2 / n) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low, high = F.round(F.greatest(F.lit(0.0), centre - margin), 6), F.round(F.least(F.lit(1.0), centre + margin), 6)
    return F.when(n == 0, 0.0).otherwise(low), F.when(n == 0, 1.0).otherwise(high)


def bag_f1(a: DataFrame, b: DataFrame, key: str, token: str = "token") -> DataFrame:
    """F1 of two token bags for every key: common counts against both sizes."""
    x = a.groupBy(key, token).agg(F.count("*").alias("na"))
    y = b.groupBy(key, token).agg(F.count("*").alias("nb"))
    both = x.join(y, [key, token], "full_outer").na.fill(0, ["na", "nb"])
    s = both.groupBy(key).agg(F.sum(F.least("na", "nb")).alias("same"), F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    return s.withColumn("f1", F.when(F.col("na") + F.col("nb") > 0, 2 * F.col("same") / (F.col("na") + F.col("nb"))).otherwise(0.0))


def positional_agreement(a: Column, b: Column) -> Column:
    """Share of equal places of the shorter array, times the ratio of the lengths."""
    short, long_ = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    same = F.size(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"] == p["y"]))
    return F.when(short > 0, same / short * (short / long_)).otherwise(0.0)


def error_rate(rows: DataFrame, edits: Column, size: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Edits over reference lengths, summed before the division."""
    return rows.groupBy(*keys).agg(F.sum(edits).alias("edits"), F.sum(size).alias("size")).withColumn("rate", F.col("edits") / F.greatest("size", F.lit(1)))


def pairwise_variability(rows: DataFrame, value: str, keys: Sequence[str] = ("media",), order: Sequence[str] = ("s", "pos")) -> DataFrame:
    """Rhythm of successive lengths: normalised (pairs whose mean is 0 left out) and raw; 0 for fewer than two."""
    w = Window.partitionBy(*keys).orderBy(*order)
    a, b = F.col(value), F.col("_next")
    pairs = rows.withColumn("_next", F.lead(value).over(w))
    norm = F.avg(F.when(b.isNotNull() & (a + b != 0), F.abs(a - b) / ((a + b) / 2.0)))
    raw = F.avg(F.abs(a - b).cast("double"))
    return pairs.groupBy(*keys).agg(F.coalesce(100 * norm, F.lit(0.0)).alias("npvi"), F.coalesce(raw, F.lit(0.0)).alias("rpvi"))


def separation(rows: DataFrame, feature: str, cls: str, one: str, two: str) -> DataFrame:
    """Means and population deviations of a feature in two classes, Cohen's d, and the overlap of their 10 to 90 percentiles."""
    f = lambda c: F.when(F.col(cls) == c, F.col(feature))
    parts = []
    for k, c in (("a", one), ("b", two)):
        parts += [F.avg(f(c)).alias(f"mean_{k}"), F.stddev_pop(f(c)).alias(f"sd_{k}"), F.percentile(f(c), F.lit(0.1)).alias(f"p10_{k}"), F.percentile(f(c), F.lit(0.9)).alias(f"p90_{k}")]
    s = rows.agg(*parts)
    pooled = F.sqrt((F.col("sd_a") ** 2 + F.col("sd_b") ** 2) / 2)
    common = F.greatest(F.lit(0.0), F.least("p90_a", "p90_b") - F.greatest("p10_a", "p10_b"))
    return s.withColumn("d", (F.col("mean_a") - F.col("mean_b")) / pooled).withColumn("common", common)


def compared(a: DataFrame, b: DataFrame, key: str, ok: str) -> DataFrame:
    """What became of each case between two reports."""
    rows = a.select(key, F.col(ok).alias("_a")).join(b.select(key, F.col(ok).alias("_b")), key, "full_outer")
    change = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed").when(F.col("_a") & ~F.col("_b"), "regression").when(~F.col("_a") & F.col("_b"), "improvement").otherwise("unchanged")
    return rows.select(key, change.alias("change"))


def marker_weight(own: Column, reference: Column, floor: float = 0.05) -> Column:
    """Share of a marker's hits that are a language's own, not below ``floor``."""
    return F.when(own + reference > 0, F.greatest(own / (own + reference), F.lit(floor))).otherwise(F.lit(floor))


def log_likelihood(rows: DataFrame, counts: DataFrame, models: Sequence[str], vocabulary: int, alpha: float, keys: Sequence[str], by: str = "lang") -> DataFrame:
    """Mean log probability of bigrams ``(a, b)`` under each model, additively smoothed."""
    totals = counts.groupBy(by, "a").agg(F.sum("n").alias("t"))
    scored = rows.withColumn(by, F.explode(F.array(*map(F.lit, models)))).join(counts, [by, "a", "b"], "left").join(totals, [by, "a"], "left")
    p = (F.coalesce("n", F.lit(0)) + alpha) / (F.coalesce("t", F.lit(0)) + alpha * vocabulary)
    return scored.groupBy(*keys, by).agg(F.avg(F.log(p)).alias("loglik"))
