"""Rules over measured frames: voice onset, overlapping speech, lateral bursts, vowels, consonants, prosody."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Formants of the Spanish vowels in Hz, and the features that prosody profiles describe.
VOWELS = {"a": (750, 1300), "e": (500, 1900), "i": (300, 2400), "o": (500, 900), "u": (320, 750)}
PROSODY = ("f0_range", "f0_std", "npvi_v", "speech_rate")

KEYS = ("media", "pos")


def _known(name: str) -> Column:
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def voice_trim(segments: DataFrame, frames: DataFrame, keys: Sequence[str] = KEYS, depth: float = 15.0, slack: float = 0.1, shortest: float = 0.08) -> DataFrame:
    """Segments ``(keys, s, e)`` in seconds with ``onset, offset_, trimmed, reason`` from frames ``(keys, t, db)``.

    Voice is louder than ``depth`` below the segment's loudest frame.  Ends move out by at most ``slack``.
    Segments without a measured frame, or shorter than ``shortest`` afterwards, stay as they are.
    """
    heard = frames.select(*keys, "t", _known("db").alias("_db")).where("_db IS NOT NULL").withColumn("_top", F.max("_db").over(Window.partitionBy(*keys)))
    loud = F.when(F.col("_db") > F.col("_top") - depth, F.col("t"))
    rows = segments.join(heard.groupBy(*keys).agg(F.min(loud).alias("_on"), F.max(loud).alias("_off"), F.lit(True).alias("_any")), list(keys), "left")
    on, off = F.greatest(F.col("_on"), F.col("s") - slack), F.least(F.col("_off"), F.col("e") + slack)
    reason = F.when(F.col("_any").isNull(), "no_valid_intensity").when(F.col("_on").isNull(), "below_threshold").when(off - on < shortest, "too_short_after_trim")
    rows = rows.withColumns({"reason": reason, "trimmed": reason.isNull()})
    return rows.withColumns({"onset": F.when(F.col("trimmed"), on).otherwise(F.col("s")), "offset_": F.when(F.col("trimmed"), off).otherwise(F.col("e"))}).drop("_on", "_off", "_any")


def overlapped_speech(segments: DataFrame, frames: DataFrame, keys: Sequence[str] = KEYS, least: float = 0.2, harmonic: float = 10.0) -> DataFrame:
    """``(keys, low_ratio, high_ratio, hnr, int_cv, score, overlap)`` of segments from frames ``(keys, f0, hnr, db)``.

    Two speakers show as voiced frames both of 80 to 180 and of 180 to 350 Hz; little harmonicity and a varying
    loudness support that.  Segments under half a second or with fewer than ten voiced frames do not overlap.
    """
    f0, n = F.col("_f0"), F.count_if(F.col("_f0") > 0)
    share = lambda a, b: F.coalesce(F.count_if((f0 > a) & (f0 < b)) / F.nullif(n, F.lit(0)), F.lit(0.0))
    spread = F.when((F.count("_db") > 3) & (F.avg("_db") > 0), F.stddev_pop("_db") / F.avg("_db"))
    measured = frames.select(*keys, _known("f0").alias("_f0"), _known("hnr").alias("_hnr"), _known("db").alias("_db")).groupBy(*keys)
    sums = measured.agg(n.alias("_n"), share(80, 180).alias("low_ratio"), share(180, 350).alias("high_ratio"), F.avg("_hnr").alias("hnr"), spread.alias("int_cv"))
    rows = segments.join(sums, list(keys), "left").fillna(0, ["_n", "low_ratio", "high_ratio", "hnr", "int_cv"])
    both = (F.col("low_ratio") > least) & (F.col("high_ratio") > least)
    score = both.cast("double") * 0.5 + (F.col("hnr") < harmonic).cast("double") * 0.3 + (F.col("int_cv") > 0.15).cast("double") * 0.2
    enough = (F.col("e") - F.col("s") >= 0.5) & (F.col("_n") >= 10)
    return rows.select(*keys, "low_ratio", "high_ratio", "hnr", "int_cv", F.when(enough, score).otherwise(0.0).alias("score"), (enough & both).alias("overlap"))


def lateral_bursts(segments: DataFrame, frames: DataFrame, keys: Sequence[str] = KEYS, shortest: float = 0.04, most_voiced: float = 0.3, least_friction: float = 0.25) -> DataFrame:
    """``(keys, t, phone, confidence)`` of bursts in frames ``(keys, t, db, voicing, friction, centroid, length)`` of segments ``(keys, s, e)``.

    A burst is a frame 6 dB below the segment's mean before a louder one.  The last four columns measure the
    sound after it, which has to be voiceless and noisy; its centre tells laterals (2.5 to 5.5 kHz) from
    other affricates.  A missing loudness counts as 0, a missing voicing as 0.5, a missing centre as 5 kHz.
    """
    fit = segments.where((F.col("e") - F.col("s") >= 0.05) & (F.col("e") - F.col("s") <= 30)).select(*keys)
    whole = Window.partitionBy(*keys)
    rows = frames.withColumn("_db", F.coalesce(_known("db"), F.lit(0.0))).join(fit, list(keys), "left_semi")
    rows = rows.withColumns({
        "_i": F.row_number().over(whole.orderBy("t")), "_next": F.lead("_db").over(whole.orderBy("t")),
        "_n": F.count("*").over(whole), "_mean": F.avg("_db").over(whole), "_any": F.count(_known("db")).over(whole),
    })
    rows = rows.where("_i > 1 AND _i < _n - 1 AND _any > 0 AND _db < _mean - 6 AND _next > _db")
    voicing, friction, centre = F.coalesce(_known("voicing"), F.lit(0.5)), _known("friction"), F.coalesce(_known("centroid"), F.lit(5000.0))
    rows = rows.where((voicing < most_voiced) & (friction > least_friction) & (F.col("length") > shortest))
    lateral = (centre > 2500) & (centre < 5500)
    phone = F.when(lateral, "tɬ").when(centre > 5500, "tʃ").otherwise("tɬ?")
    weight = F.when(lateral, 2.0).when(centre > 5500, 1.5).otherwise(1.0)
    return rows.select(*keys, "t", phone.alias("phone"), F.round(F.least(F.lit(1.0), (1 - voicing) * friction * weight), 3).alias("confidence"))


def lateral_segments(segments: DataFrame, bursts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``(keys, tl, tl_confidence, tl_events)`` of all segments: whether a lateral is heard, sure or not."""
    heard = bursts.where(F.col("phone").isin("tɬ", "tɬ?")).groupBy(*keys).agg(F.max("confidence").alias("c"), F.count("*").alias("n"))
    rows = segments.select(*keys).join(heard, list(keys), "left")
    return rows.select(*keys, F.col("n").isNotNull().alias("tl"), F.coalesce("c", F.lit(0.0)).alias("tl_confidence"), F.coalesce("n", F.lit(0).cast("long")).alias("tl_events"))


def nearest_vowel(f1: Column, f2: Column) -> Column:
    """The vowel with the closest formants, the first of equally close ones; ``?`` without formants."""
    distance = lambda a, b: F.pow((f1 - a) / 200, F.lit(2)) + F.pow((f2 - b) / 400, F.lit(2))
    near = F.array_min(F.array(*(F.struct(distance(a, b).alias("d"), F.lit(i).alias("i"), F.lit(v).alias("v")) for i, (v, (a, b)) in enumerate(VOWELS.items()))))
    return F.when(f1.isNull() | f2.isNull(), "?").otherwise(near["v"])


def consonant(centre: Column, ms: Column, voiced: Column) -> Column:
    """A consonant by the centre of its spectrum in Hz, its length in milliseconds and its voicing."""
    nasal = F.when(centre < 1200, "m").otherwise("n")
    approximant = F.when(centre < 1500, "β").when(centre > 2500, "ð").otherwise("ɣ")
    plosive = F.when(centre > 3000, "t").when(centre < 1500, "p").otherwise("k")
    middle = F.when(centre > 4000, "s").when(centre > 2500, "tʃ").otherwise("f")
    fricative = F.when(centre > 3500, "s").when(centre > 2000, "ʃ").otherwise("x")
    return F.when(voiced & (ms > 30), nasal).when(voiced, approximant).when(ms < 30, plosive).when(ms < 80, middle).otherwise(fricative)


def prosody_scores(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Rows with a ``code`` and a ``score`` for each profile of ``prosody_profiles``.

    One less the mean distance from the targets, each in units of its range and 1 at most, times the profile's weight.
    Features whose range is empty do not count; a profile without any scores 0.
    """
    part = lambda f: F.when(F.col(f"_p.{f}.max") > F.col(f"_p.{f}.min"), F.least(F.lit(1.0), F.abs(F.col(f) - F.col(f"_p.{f}.target")) / (F.col(f"_p.{f}.max") - F.col(f"_p.{f}.min"))))
    parts = F.array_compact(F.array(*(part(f) for f in PROSODY)))
    mean = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(parts), F.lit(0))
    both = rows.crossJoin(profiles.select(F.struct(*profiles.columns).alias("_p")))
    return both.select(*rows.columns, F.col("_p.code").alias("code"), (F.coalesce(F.greatest(F.lit(0.0), 1 - mean), F.lit(0.0)) * F.col("_p.weight")).alias("score"))
