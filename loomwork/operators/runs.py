"""Runs of equal labels in ordered streams: grouping, merging, absorbing, collapsing.

Streams are partitions of a key in the order of ``order`` columns; set-based
operators use windows, and those whose next step depends on the last one's
outcome fold each stream in order in one grouped Arrow call.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.text import strip_accents

# Function words of short copies.
BLEED_WORDS = ("de", "del", "la", "el", "que", "en", "y", "por", "para", "con", "no", "es", "un", "una")


def _order(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def run_ids(rows: DataFrame, label: Column, keys: Sequence[str] = ("media",), order: Sequence[str] = ("s", "pos"), breaks: Column | None = None) -> DataFrame:
    """Adds ``run``, from 1 on: it grows where the label (or ``breaks``) changes; two nulls are equal."""
    w = _order(keys, order)
    rows = rows.withColumn("_label", label)
    changed = ~F.col("_label").eqNullSafe(F.lag("_label").over(w)) | (F.row_number().over(w) == 1)
    if breaks is not None:
        changed = changed | breaks
    return rows.withColumn("_new", changed.cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "_label")


def carried_runs(rows: DataFrame, tag: str = "tag", score: str = "score", keys: Sequence[str] = ("media",), order: Sequence[str] = ("s", "pos")) -> DataFrame:
    """Runs of tags, a null tag going on with the run before it (``other`` at the start): keys, run, lang, s, e, n, confidence."""
    w = _order(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("lang", F.coalesce(F.last(tag, ignorenulls=True).over(w), F.lit("other")))
    runs = run_ids(rows, F.col("lang"), keys, order)
    return runs.groupBy(*keys, "run").agg(F.first("lang").alias("lang"), F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n"), F.sum(score).alias("confidence"))


def merged(rows: DataFrame, by: Sequence[str], keys: Sequence[str] = ("media",), order: Sequence[str] = ("s", "pos")) -> DataFrame:
    """Neighbours with equal ``by`` columns become one row: keys, run, by, s, e, n, texts in order."""
    runs = run_ids(rows, F.struct(*by), keys, order)
    texts = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda x: x["text"]), " ").alias("text")] if "text" in rows.columns else []
    return runs.groupBy(*keys, "run").agg(*(F.first(c).alias(c) for c in by), F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n"), *texts)


def sandwiched(rows: DataFrame, outer: str, inner: str, longest: int, keys: Sequence[str] = ("media",), order: Sequence[str] = ("s", "pos"), most_units: int | None = None) -> DataFrame:
    """``lang`` of short ``inner`` rows between two ``outer`` rows becomes ``outer``."""
    w = _order(keys, order)
    hit = (F.col("lang") == inner) & (F.lag("lang").over(w) == outer) & (F.lead("lang").over(w) == outer) & (F.col("e") - F.col("s") <= longest)
    if most_units is not None:
        hit = hit & (F.col("n") <= most_units)
    return rows.withColumn("lang", F.when(hit, F.lit(outer)).otherwise(F.col("lang")))


def collapsed(rows: DataFrame, symbol: str, blank: str, keys: Sequence[str] = ("media",), order: Sequence[str] = ("s", "pos")) -> DataFrame:
    """Connectionist collapse: repeats go first, then blanks."""
    w = _order(keys, order)
    return rows.withColumn("_p", F.lag(symbol).over(w)).where(~F.col(symbol).eqNullSafe(F.col("_p")) & (F.col(symbol) != blank)).drop("_p")


def symbol_spans(rows: DataFrame, symbol: str, blank: str, score: str, keys: Sequence[str] = ("media",), order: Sequence[str] = ("s", "pos")) -> DataFrame:
    """Runs of one symbol that is not the blank, with their bounds and mean score."""
    runs = run_ids(rows, F.col(symbol), keys, order)
    spans = runs.groupBy(*keys, "run").agg(F.first(symbol).alias(symbol), F.min("s").alias("s"), F.max("s").alias("last"), F.avg(score).alias("conf"))
    return spans.where(F.col(symbol) != blank)


def until_next(rows: DataFrame, last_length: int, keys: Sequence[str] = ("media",), order: Sequence[str] = ("s", "pos")) -> DataFrame:
    """End of each event is the start of the next; the last lasts ``last_length``."""
    return rows.withColumn("e", F.lead("s").over(_order(keys, order))).withColumn("e", F.coalesce("e", F.col("s") + last_length))


def transitions(rows: DataFrame, state: Column, keys: Sequence[str] = ("media",), order: Sequence[str] = ("s", "pos")) -> DataFrame:
    """How often the state changes within each key."""
    rows = rows.withColumn("_s", state).withColumn("_p", F.lag("_s").over(_order(keys, order)))
    return rows.groupBy(*keys).agg(F.count_if(F.col("_p").isNotNull() & (F.col("_s") != F.col("_p"))).alias("n_events"))


def prior_at_row(rows: DataFrame, keys: Sequence[str], order: Sequence[str], langs: Sequence[str], least: int = 3, share: float = 0.7) -> DataFrame:
    """The language that earlier rows of the key agree on, visible at each row: ``prior`` or null."""
    w = _order(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_n", F.count("*").over(w))
    best = F.lit(None).cast("string")
    for x in reversed(langs):
        c = F.count_if(F.col("lang") == x).over(w)
        rows = rows.withColumn(f"_c_{x}", c)
    for x in reversed(langs):
        best = F.when((F.col("_n") >= least) & (F.col(f"_c_{x}") / F.col("_n") >= share), F.lit(x)).otherwise(best)
    return rows.withColumn("prior", best).drop("_n", *(f"_c_{x}" for x in langs))


def allocated(rows: DataFrame, taken: str, keys: Sequence[str] = ("media",), order: Sequence[str] = ("s", "pos")) -> DataFrame:
    """New negative numbers for rows without one, below the smallest of their key and below 0: ``number``."""
    low = F.least(F.coalesce(F.min(taken).over(Window.partitionBy(*keys)), F.lit(0)), F.lit(0))
    rank = F.count_if(F.col(taken).isNull()).over(_order(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("number", F.coalesce(F.col(taken), low - rank))


def bleed_merged(rows: DataFrame, keys: Sequence[str] = ("media",), order: Sequence[str] = ("s", "pos"), longest: float = 1.2) -> DataFrame:
    """Segments ``(keys, s, e, text, speaker, lang, ipa)`` in seconds, short copies of a neighbour's words merged or without text; ``mark`` tells which.

    A copy lasts ``longest`` at most, has one to four words with a function word among them, and stands whole in a
    neighbour of at least three words more.  It goes into the segment kept before it if speaker and language are
    the same and the gap is no longer than that; else its text becomes null; before any other it stays.  At most
    four copies follow each other, so that what is folded into one row is as small.
    """
    norm = F.trim(F.regexp_replace(F.regexp_replace(strip_accents(F.coalesce("text", F.lit(""))), "\\p{Mn}", ""), "[^a-z0-9]", " "))
    over = _order(keys, order)
    rows = rows.withColumns({"_norm": norm, "mark": F.lit("")}).withColumn("_words", F.filter(F.split("_norm", " +"), lambda x: x != ""))
    holds = lambda shift: F.coalesce((shift("_n") >= F.size("_words") + 3) & F.contains(shift("_norm"), F.col("_norm")), F.lit(False))
    small = (F.col("e") - F.col("s") <= longest) & F.col("_n").between(1, 4) & (F.length("_norm") >= 6) & F.arrays_overlap("_words", F.array(*map(F.lit, BLEED_WORDS)))
    rows = rows.withColumn("_n", F.size("_words"))
    rows = rows.withColumn("_bleed", small & (holds(lambda c: F.lag(c).over(over)) | holds(lambda c: F.lead(c).over(over)))).drop("_norm", "_words", "_n")
    rows = rows.withColumn("_island", F.sum((~F.col("_bleed")).cast("int")).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    names = [*order, *(c for c in rows.columns if c not in (*keys, *order, "_island"))]
    changed = lambda x, **new: F.struct(*(new.get(c, x[c]).alias(c) for c in names))

    def step(out: Column, x: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        near = last["speaker"].eqNullSafe(x["speaker"]) & last["lang"].eqNullSafe(x["lang"]) & (x["s"] - last["e"] <= longest)
        ipa = F.when(F.coalesce(x["ipa"], F.lit("")) == "", last["ipa"]).otherwise(F.trim(F.concat_ws(" ", F.trim(last["ipa"]), F.trim(x["ipa"]))))
        taken = changed(last, e=F.greatest(last["e"], x["e"]), ipa=ipa, mark=F.concat(last["mark"], F.lit("+bleed-merged")))
        bare = changed(x, text=F.lit(None).cast("string"), mark=F.concat(x["mark"], F.lit("+bleed-pruned")))
        into = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(taken))
        return F.when(~x["_bleed"] | (F.size(out) == 0), F.concat(out, F.array(x))).when(near, into).otherwise(F.concat(out, F.array(bare)))

    islands = rows.groupBy(*keys, "_island").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("_rows"))
    kept = F.aggregate("_rows", F.slice("_rows", 1, 0), step)
    return islands.select(*keys, F.explode(kept).alias("_x")).select(*keys, "_x.*").drop("_bleed")


def spread(rows: DataFrame, parts: Column, s: Column, e: Column) -> DataFrame:
    """One row for every element of ``parts``, with an even share of the time from ``s`` to ``e``: adds i, part, ps, pe."""
    n = F.size(parts)
    rows = rows.select("*", s.alias("_s"), e.alias("_e"), n.alias("_n"), F.posexplode(parts).alias("i", "part"))
    step = (F.col("_e") - F.col("_s")) / F.col("_n")
    return rows.withColumn("ps", F.col("_s") + F.col("i") * step).withColumn("pe", F.col("ps") + step).drop("_s", "_e", "_n")


def folded(rows: DataFrame, fold: Callable[[list[dict]], list[dict]], schema: str, keys: Sequence[str] = ("media",), order: Sequence[str] = ("s", "pos")) -> DataFrame:
    """``fold`` maps the rows of a stream, as dicts in order, to new rows; for steps that depend on each other's outcome."""
    order = list(order)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(fold(frame.sort_values(order, kind="stable").to_dict("records")), columns=names)

    return rows.groupBy(*keys).applyInPandas(run, schema)


def _joined(*parts: dict, lang: str | None = None) -> dict:
    return {**parts[0], "lang": lang or parts[0]["lang"], "s": parts[0]["s"], "e": parts[-1]["e"], "n": sum(p["n"] for p in parts)}


def merge_short(least: int) -> Callable[[list[dict]], list[dict]]:
    """Fold: a run of fewer than ``least`` units joins its neighbours, again and again until none is left or one run remains.

    The first goes to the next, the last to the one before; between equal languages
    all three become one; else the larger neighbour takes it, the earlier on ties.
    """

    def fold(rows: list[dict]) -> list[dict]:
        rows = [dict(r) for r in rows]
        while len(rows) > 1 and (i := next((k for k, r in enumerate(rows) if r["n"] < least), None)) is not None:
            if i == 0:
                rows[0:2] = [_joined(rows[0], rows[1], lang=rows[1]["lang"])]
            elif i == len(rows) - 1:
                rows[i - 1 :] = [_joined(rows[i - 1], rows[i])]
            elif rows[i - 1]["lang"] == rows[i + 1]["lang"]:
                rows[i - 1 : i + 2] = [_joined(*rows[i - 1 : i + 2])]
            elif rows[i + 1]["n"] > rows[i - 1]["n"]:
                rows[i : i + 2] = [_joined(rows[i], rows[i + 1], lang=rows[i + 1]["lang"])]
            else:
                rows[i - 1 : i + 1] = [_joined(rows[i - 1], rows[i])]
        return rows

    return fold


def absorb_islands(priority: dict[str, int]) -> Callable[[list[dict]], list[dict]]:
    """Fold: a run between two of one language of higher priority joins them if it scores no more there than they do, until nothing changes."""

    def fold(rows: list[dict]) -> list[dict]:
        rows, changed = [dict(r) for r in rows], True
        while changed:
            changed = False
            for i in range(1, len(rows) - 1):
                a, b, c = rows[i - 1 : i + 2]
                if a["lang"] == c["lang"] != b["lang"] and priority.get(a["lang"], 0) > priority.get(b["lang"], 0) and b["conf"] <= max(a["conf"], c["conf"]):
                    rows[i - 1 : i + 2] = [_joined(a, b, c)]
                    changed = True
                    break
        return rows

    return fold


def keep_confident(rows: list[dict]) -> list[dict]:
    """Fold: of overlapping rows the more confident stays, the earlier on ties; each is compared with the last that stayed."""
    kept: list[dict] = []
    for r in rows:
        if not kept or r["s"] >= kept[-1]["e"]:
            kept.append(r)
        elif r["conf"] > kept[-1]["conf"]:
            kept[-1] = r
    return kept


def keep_apart(least: int) -> Callable[[list[dict]], list[dict]]:
    """Fold: rows that start within ``least`` of the last one that stayed go."""

    def fold(rows: list[dict]) -> list[dict]:
        kept: list[dict] = []
        for r in rows:
            if not kept or r["s"] - kept[-1]["s"] >= least:
                kept.append(r)
        return kept

    return fold


def next_labels(known: list[tuple[float, float, str]], used: int, turns: list[dict]) -> tuple[list[str], int]:
    """Labels of a pass's turns after the pass before it, and how many labels there are by then."""
    names: dict[str, str] = {}
    for t in sorted(turns, key=lambda t: (t["s"], t["e"])):
        if t["speaker"] in names:
            continue
        best = max(((min(t["e"], e) - max(t["s"], s), label) for s, e, label in known if label not in names.values()), default=(0, ""), key=lambda x: x[0])
        if best[0] > 0:
            names[t["speaker"]] = best[1]
        else:
            names[t["speaker"]] = f"Speaker {letters(used)}"
            used += 1
    return [names[t["speaker"]] for t in turns], used


def stable_labels(passes: list[list[dict]]) -> list[list[str]]:
    """Speaker labels that hold across passes: a speaker takes the label of the earlier turn that its first turn overlaps most, else a new letter."""
    known: list[tuple[float, float, str]] = []
    used, out = 0, []
    for turns in passes:
        labels, used = next_labels(known, used, turns)
        out.append(labels)
        known = [(t["s"], t["e"], label) for t, label in zip(turns, labels)]
    return out


def letters(i: int) -> str:
    """A to Z, then AA, AB and so on."""
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out
