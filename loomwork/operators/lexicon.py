"""Dictionary search over symbol sequences that are strings of one character a symbol.

Windows and entries meet on their lengths, so that only windows whose length
allows the wanted distance are compared; the dictionary side is small
and its size is checked by the planner.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(1.0)


def whole_matches(rows: DataFrame, lexicon: DataFrame, keys: Sequence[str], text: str = "text", most: float = 0.3) -> DataFrame:
    """``(keys, word, score)``: the entry nearest to the whole sequence, within ``most`` of the longer length; the first in the lexicon's order on ties."""
    n = F.char_length(text)
    near = rows.select(*keys, F.col(text).alias("_t"), F.explode(F.sequence(F.floor(n * (1 - most)).cast("int"), F.ceil(n / (1 - most)).cast("int"))).alias("_len"))
    entries = lexicon.select("ord", "word", F.col("code").alias("_c"), F.char_length("code").alias("_len"))
    pairs = near.join(entries, "_len").withColumn("_d", F.levenshtein("_t", "_c")).withColumn("_m", F.greatest(F.char_length("_t"), F.col("_len")))
    good = pairs.where((F.col("_m") > 0) & (F.col("_d") <= F.floor(F.lit(most) * F.col("_m")))).withColumn("score", 1 - F.col("_d") / F.col("_m"))
    best = good.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "word")).alias("m"))
    return best.select(*keys, F.col("m.word").alias("word"), F.col("m.score").alias("score"))


def windows_near(rows: DataFrame, lexicon: DataFrame, keys: Sequence[str], text: str = "text", least_length: int = 3, most: float = 0.3) -> DataFrame:
    """``(keys, word, start, length, score)``: windows one shorter to one longer than an entry and near to it; the best for each word and start."""
    lengths = lexicon.select(F.explode(F.sequence(F.char_length("code") - 1, F.char_length("code") + 1)).alias("length")).where(F.col("length") >= least_length).distinct()
    t = F.col(text)
    starts = rows.select(*keys, t.alias("_t"), F.explode(F.sequence(F.lit(0), F.greatest(F.char_length(t) - least_length, F.lit(0)))).alias("start"))
    cut = starts.join(F.broadcast(lengths), F.col("start") + F.col("length") <= F.char_length("_t")).withColumn("_w", F.substring(F.col("_t"), F.col("start") + 1, F.col("length")))
    entries = lexicon.select("ord", "word", F.col("code").alias("_c"), F.explode(F.sequence(F.char_length("code") - 1, F.char_length("code") + 1)).alias("length"))
    distinct = cut.select("_w", "length").distinct().join(entries, "length")
    d, m = F.levenshtein("_w", "_c"), F.greatest(F.char_length("_w"), F.char_length("_c"))
    near = distinct.where(d <= F.floor(F.lit(most) * m)).select("_w", "word", (1 - d / m).alias("score"))
    hits = cut.join(near, "_w")
    return hits.groupBy(*keys, "word", "start").agg(F.max(F.struct("score", (-F.col("length")).alias("l"))).alias("m")).select(*keys, "word", "start", (-F.col("m.l")).alias("length"), F.col("m.score").alias("score"))


def overridden(tags: DataFrame, matches: DataFrame, lang: str, keys: Sequence[str]) -> DataFrame:
    """Positions inside matches become ``lang`` with a match's score: matches apply by falling score, so that the lowest one that covers a position stays."""
    cover = matches.withColumn("pos", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)))
    last = cover.groupBy(*keys, "pos").agg(F.min("score").alias("_s"))
    rows = tags.join(last, [*keys, "pos"], "left")
    return rows.withColumn("tag", F.when(F.col("_s").isNotNull(), F.lit(lang)).otherwise(F.col("tag"))).withColumn("score", F.coalesce("_s", "score")).drop("_s")


def positional_matches(rows: DataFrame, lexicon: DataFrame, keys: Sequence[str], text: str = "text", least: float = 0.6) -> DataFrame:
    """``(keys, word, start, score)``: for every entry the first window that agrees in enough places; windows near the end are not looked at."""
    code = lexicon.select("word", F.col("code").alias("_c"), F.char_length("code").alias("_n"))
    t = F.col(text)
    pairs = rows.select(*keys, t.alias("_t"), F.explode(F.sequence(F.lit(0), F.greatest(F.char_length(t) - 1, F.lit(0)))).alias("start")).join(F.broadcast(code), F.col("start") < F.greatest(F.lit(1), F.char_length("_t") - F.col("_n") - 1))
    window = F.substring(F.col("_t"), F.col("start") + 1, F.col("_n"))
    same = F.size(F.filter(F.arrays_zip(F.split(window, "").alias("x"), F.split("_c", "").alias("y")), lambda p: p["x"] == p["y"]))
    hits = pairs.withColumn("score", same / F.col("_n")).where(F.col("score") >= least)
    return hits.groupBy(*keys, "word").agg(F.min(F.struct("start", "score")).alias("m")).select(*keys, "word", F.col("m.start").alias("start"), F.col("m.score").alias("score"))


def filtered(entries: DataFrame, least: int = 3) -> DataFrame:
    """Curated entries, those of unknown frequency, and frequent ones."""
    return entries.where((F.col("source") == "curated") | F.col("freq").isNull() | (F.col("freq") >= least))


def combined(curated: DataFrame, corpus: DataFrame) -> DataFrame:
    """All curated entries, and those of the corpus whose word, in any case, is not among them."""
    extra = corpus.join(curated.select(F.lower("word").alias("_k")).distinct(), F.lower("word") == F.col("_k"), "left_anti")
    return curated.unionByName(extra)
