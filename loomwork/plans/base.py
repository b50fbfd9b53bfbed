"""How the driver's tables stand in for recordings, and the registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LANGS = {"click": "spa", "view": "nah", "purchase": "eng", "signup": "may", "error": "other"}
DAY = 86_400_000
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"

#: The same stand-ins in SQL: a day is a recording, an event a segment that lasts its value in seconds.
PRELUDE = """WITH seg AS (
  SELECT (epoch_us(ts) // 1000) // 86400000 AS media, event_id AS pos, (epoch_us(ts) // 1000) AS s, (epoch_us(ts) // 1000) + floor(value * 1000)::BIGINT AS e,
         CASE event_type WHEN 'click' THEN 'spa' WHEN 'view' THEN 'nah' WHEN 'purchase' THEN 'eng' WHEN 'signup' THEN 'may' ELSE 'other' END AS lang,
         value / 500 AS conf, 'S' || (user_id % 4) AS speaker, event_type, 1 + event_id % 9 AS n
  FROM events),
turn AS (SELECT * FROM seg WHERE event_type IN ('click', 'view', 'purchase')),
asr AS (SELECT * FROM seg WHERE event_type NOT IN ('click', 'view', 'purchase')),
cue AS (SELECT doc_id AS cue, CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'may' WHEN 'de' THEN 'nah' ELSE 'spa' END AS gt_lang, n_chars AS dur,
               CASE (doc_id * 7) % 11 WHEN 0 THEN 'spa' WHEN 1 THEN 'nah' WHEN 2 THEN 'unk' WHEN 3 THEN 'oth' ELSE CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'may' WHEN 'de' THEN 'nah' ELSE 'spa' END END AS pred_lang
        FROM documents),
scored AS (SELECT cue, gt_lang AS gt, CASE WHEN cue % 13 = 0 THEN 'oth' ELSE pred_lang END AS pred, dur FROM cue),
"""


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query; ``sql`` continues the stand-ins' WITH clause."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = PRELUDE + sql
        return f

    return register


def plain(name: str, sql: str) -> Callable:
    """As ``query``, with SQL that needs no stand-ins."""

    def register(f):
        query(name)(f)
        ORACLE_SQL[name] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def millis(ts: str):
    """Milliseconds since 1970 of a time without zone, whatever the session's zone is; parts of one are cut toward 1970, as SQL's // does."""
    return F.expr(f"cast(cast(cast({ts} - timestamp_ntz'1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(20, 6)) * 1000 AS BIGINT)")


def segments(spark: SparkSession, d: str) -> DataFrame:
    s = millis("ts")
    lang = F.create_map(*(F.lit(x) for kv in LANGS.items() for x in kv))[F.col("event_type")]
    return read(spark, d, "events").select(
        (s / DAY).cast("long").alias("media"), F.col("event_id").alias("pos"), s.alias("s"), (s + F.floor(F.col("value") * 1000)).cast("long").alias("e"),
        lang.alias("lang"), (F.col("value") / 500).alias("conf"), F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("speaker"), "event_type", (1 + F.col("event_id") % 9).alias("n"),
    )


def turns(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).where(F.col("event_type").isin("click", "view", "purchase"))


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).where(~F.col("event_type").isin("click", "view", "purchase"))


def truth(spark: SparkSession, d: str) -> DataFrame:
    lang = F.when(F.col("lang") == "en", "eng").when(F.col("lang") == "fr", "may").when(F.col("lang") == "de", "nah").otherwise("spa")
    return read(spark, d, "documents").select(F.col("doc_id").alias("cue"), lang.alias("lang"), F.col("n_chars").alias("dur"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("cue") * 7 % 11
    pred = F.when(k == 0, "spa").when(k == 1, "nah").when(k == 2, "unk").when(k == 3, "oth").otherwise(F.col("lang"))
    return truth(spark, d).where("cue % 13 <> 0").select("cue", pred.alias("lang"), "dur")


def register_views(spark: SparkSession, d: str) -> None:
    """The stand-ins as views for ``spark.sql``."""
    for name, f in (("segments", segments), ("turns", turns), ("transcripts", transcripts), ("truth", truth), ("predictions", predictions)):
        f(spark, d).createOrReplaceTempView(f"loomwork_{name}")
