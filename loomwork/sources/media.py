"""Audio files, language profiles, letter-to-sound rules, and manifests with required fields."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def audio_chunks(spark: SparkSession, path: str, seconds: float = 3.0) -> DataFrame:
    """``(path, chunk, start_s, sample_rate, samples array<float>)`` of WAV files of 16 bits: mono, in [-1, 1], in chunks of equal length, the last shorter."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                with wave.open(io.BytesIO(content)) as file:
                    rate, channels = file.getframerate(), file.getnchannels()
                    step = max(1, int(rate * seconds))
                    for i in range(0, max(file.getnframes(), 1), step):
                        raw = np.frombuffer(file.readframes(step), "<i2").reshape(-1, channels)
                        yield pd.DataFrame({"path": [name], "chunk": [i // step], "start_s": [i / rate], "sample_rate": [rate], "samples": [(raw.mean(1) / 32768).astype(np.float32)]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, chunk int, start_s double, sample_rate int, samples array<float>")


def peak_normalised(samples: Column, peak: float = 0.9) -> Column:
    """Samples scaled to a largest magnitude of ``peak``; silence stays."""
    top = F.array_max(F.transform(samples, lambda x: F.abs(x)))
    return F.when(top > 0, F.transform(samples, lambda x: (x / top * peak).cast("float"))).otherwise(samples)


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """``(code, priority, threshold, kind, gram, weight)`` of profile files: markers of one to three symbols, whose keys may be lists written as text.

    Kind is uni, bi, tri or negative; marks without a weight weigh 1.
    """
    schema = "code STRING, priority INT, threshold DOUBLE, marker_phonemes ARRAY<STRING>, marker_sequences ARRAY<ARRAY<STRING>>, marker_trigrams ARRAY<ARRAY<STRING>>, marker_weights MAP<STRING, DOUBLE>, sequence_weights MAP<STRING, DOUBLE>, trigram_weights MAP<STRING, DOUBLE>, negative_markers MAP<STRING, DOUBLE>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    plain = lambda k: F.trim(F.regexp_replace(F.regexp_replace(k, "[\\[\\]()'\"]", ""), "\\s*,\\s*", " "))
    weights = lambda m: F.map_from_entries(F.transform(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,double>"))), lambda e: F.struct(plain(e["key"]), e["value"])))

    def rows(kind: str, marks: Column, weight: str) -> Column:
        w = weights(F.col(weight))
        grams = F.array_union(F.coalesce(marks, F.array().cast("array<string>")), F.map_keys(w))
        return F.transform(grams, lambda g: F.struct(F.lit(kind).alias("kind"), g.alias("gram"), F.coalesce(F.element_at(w, g), F.lit(1.0)).alias("weight")))

    joined = lambda c: F.transform(c, lambda g: F.array_join(g, " "))
    every = F.concat(
        rows("uni", F.col("marker_phonemes"), "marker_weights"),
        rows("bi", joined(F.col("marker_sequences")), "sequence_weights"),
        rows("tri", joined(F.col("marker_trigrams")), "trigram_weights"),
        rows("negative", F.array().cast("array<string>"), "negative_markers"),
    )
    return raw.select("code", F.coalesce("priority", F.lit(1)).alias("priority"), F.coalesce("threshold", F.lit(0.0)).alias("threshold"), F.explode(every).alias("m")).select("code", "priority", "threshold", "m.*")


def prosody_profiles(spark: SparkSession, path: str) -> DataFrame:
    """``(code, name, rhythm_class, f0_range, f0_std, npvi_v, speech_rate, weight)`` of profile files, one object each, by code.

    The four features are structs of ``min``, ``max`` and ``target``.  A file that lacks a field is an error when it is read.
    """
    span = "STRUCT<min: DOUBLE, max: DOUBLE, target: DOUBLE>"
    schema = f"code STRING, name STRING, rhythm_class STRING, f0_range {span}, f0_std {span}, npvi_v {span}, speech_rate {span}, weight DOUBLE"
    raw = spark.read.schema(schema).json(path, multiLine=True, pathGlobFilter="*.json")
    return required(raw, raw.columns).orderBy("code")


def sound_rules(spark: SparkSession, path: str) -> DataFrame:
    """``(grapheme, ipa array<string>)`` of a rule file, longest graphemes first."""
    raw = spark.read.csv(path, header=True)
    rows = raw.select(F.trim(raw.columns[0]).alias("grapheme"), F.split(F.trim(raw.columns[1]), "\\s+").alias("ipa"))
    return rows.where("grapheme <> ''").orderBy(F.char_length("grapheme").desc(), "grapheme")


def required(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The rows; missing columns are an error now, missing values when the rows are read."""
    gone = [f for f in fields if f not in rows.columns]
    if gone:
        raise ValueError(f"missing fields: {', '.join(gone)}")
    whole = F.assert_true(F.greatest(*(F.col(f).isNull().cast("int") for f in (*fields, fields[0]))) == 0, F.lit("a required field is empty"))
    return rows.where(whole.isNull())
