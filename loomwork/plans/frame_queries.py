"""Queries over measured frames, subtitle flavours, manifests and reports; tables stand in for what is measured."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import text as tx
from loomwork.operators import frames as fr
from loomwork.operators import runs
from loomwork.plans.base import plain, predictions, query, read, segments, truth
from loomwork.sources import subtitles as st

#: A recording and speaker is a segment of a tenth of a second for each event, an event one of its frames.
FRAMES = """x AS (SELECT 1),
f AS (SELECT media, speaker, row_number() OVER (PARTITION BY media, speaker ORDER BY s, pos) / 10.0::DOUBLE AS t, CASE WHEN pos % 17 <> 0 THEN (40 + (pos * 7) % 31)::DOUBLE END AS db, CASE WHEN pos % 5 <> 0 THEN (60 + (pos * 37) % 320)::DOUBLE END AS f0,
  (pos % 25)::DOUBLE AS hnr, CASE WHEN pos % 4 <> 0 THEN (pos % 10) / 20.0::DOUBLE END AS voicing, (pos % 9) / 9.0::DOUBLE AS friction, (1500 + (pos * 53) % 6000)::DOUBLE AS centroid, (pos % 12) / 100.0::DOUBLE AS length, pos FROM seg),
g AS (SELECT media, speaker, 0.25::DOUBLE AS s, count(*) / 10.0::DOUBLE AS e FROM seg GROUP BY ALL),
"""
KEYS = ("media", "speaker")


def frames(spark, d):
    from pyspark.sql import Window

    p, n = F.col("pos"), F.row_number().over(Window.partitionBy(*KEYS).orderBy("s", "pos"))
    return segments(spark, d).select(
        *KEYS, (n / 10.0).alias("t"), F.when(p % 17 != 0, (40 + p * 7 % 31).cast("double")).alias("db"), F.when(p % 5 != 0, (60 + p * 37 % 320).cast("double")).alias("f0"), (p % 25).cast("double").alias("hnr"),
        F.when(p % 4 != 0, p % 10 / 20.0).alias("voicing"), (p % 9 / 9.0).alias("friction"), (1500 + p * 53 % 6000).cast("double").alias("centroid"), (p % 12 / 100.0).alias("length"), "pos",
    )


def framed(spark, d):
    return segments(spark, d).groupBy(*KEYS).agg(F.lit(0.25).alias("s"), (F.count("*") / 10.0).alias("e"))


@query("x3_trimmed_segments", FRAMES + """h AS (SELECT media, speaker, min(t) AS a, max(t) AS b FROM (SELECT *, max(db) OVER (PARTITION BY media, speaker) AS top FROM f) WHERE db > top - 15 GROUP BY ALL),
c AS (SELECT g.*, greatest(a, s - 0.1) AS a, least(b, e + 0.1) AS b, a IS NULL AS none FROM g LEFT JOIN h USING (media, speaker))
SELECT media, speaker, round(CASE WHEN none OR b - a < 0.08 THEN s ELSE a END, 6) AS onset, round(CASE WHEN none OR b - a < 0.08 THEN e ELSE b END, 6) AS offset_, NOT none AND b - a >= 0.08 AS trimmed,
  CASE WHEN none THEN 'no_valid_intensity' WHEN b - a < 0.08 THEN 'too_short_after_trim' END AS reason FROM c""")  # fmt: skip
def x3_trimmed(spark, d):
    return fr.voice_trim(framed(spark, d), frames(spark, d), KEYS).select(*KEYS, F.round("onset", 6).alias("onset"), F.round("offset_", 6).alias("offset_"), "trimmed", "reason")


LATERAL = FRAMES + """r AS (SELECT f.*, row_number() OVER w AS i, coalesce(lead(coalesce(db, 0)) OVER w, 0) AS nx, count(*) OVER p AS n, avg(coalesce(db, 0)) OVER p AS mean, count(db) OVER p AS m
  FROM f JOIN g USING (media, speaker) WHERE g.e - g.s BETWEEN 0.05 AND 30 WINDOW w AS (PARTITION BY media, speaker ORDER BY t), p AS (PARTITION BY media, speaker)),
b AS (SELECT media, speaker, pos, CASE WHEN centroid > 2500 AND centroid < 5500 THEN 'tɬ' WHEN centroid > 5500 THEN 'tʃ' ELSE 'tɬ?' END AS phone,
  round(least(1.0::DOUBLE, (1 - coalesce(voicing, 0.5)) * friction * CASE WHEN centroid > 2500 AND centroid < 5500 THEN 2.0 WHEN centroid > 5500 THEN 1.5 ELSE 1.0 END), 3) AS confidence
  FROM r WHERE i > 1 AND i < n - 1 AND m > 0 AND coalesce(db, 0) < mean - 6 AND nx > coalesce(db, 0) AND coalesce(voicing, 0.5) < 0.3 AND friction > 0.25 AND length > 0.04)
"""


def _bursts(spark, d):
    return fr.lateral_bursts(framed(spark, d), frames(spark, d), KEYS)


@query("x4_lateral_bursts", LATERAL + "SELECT media, speaker, phone, count(*) AS n, round(sum(confidence), 3) AS confidence FROM b GROUP BY ALL")
def x4_bursts(spark, d):
    return _bursts(spark, d).groupBy(*KEYS, "phone").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 3).alias("confidence"))


@query("x4_lateral_segments", LATERAL + "SELECT g.media, g.speaker, count(phone) > 0 AS tl, coalesce(max(confidence), 0) AS tl_confidence, count(phone) AS tl_events FROM g LEFT JOIN b ON g.media = b.media AND g.speaker = b.speaker AND phone <> 'tʃ' GROUP BY ALL")
def x4_segments(spark, d):
    return fr.lateral_segments(framed(spark, d), _bursts(spark, d), KEYS)


@query("x6_overlapped_speech", FRAMES + """m AS (SELECT media, speaker, count(f0) AS n, count(*) FILTER (WHERE f0 > 80 AND f0 < 180) AS lo, count(*) FILTER (WHERE f0 > 180 AND f0 < 350) AS hi, avg(hnr) AS hnr, CASE WHEN count(db) > 3 THEN stddev_pop(db) / avg(db) ELSE 0 END AS cv FROM f GROUP BY ALL),
r AS (SELECT g.media, g.speaker, coalesce(lo / nullif(n, 0), 0) AS lo, coalesce(hi / nullif(n, 0), 0) AS hi, hnr, coalesce(cv, 0) AS cv, e - s >= 0.5 AND n >= 10 AS enough FROM g JOIN m USING (media, speaker))
SELECT media, speaker, round(lo, 6) AS low_ratio, round(hi, 6) AS high_ratio, round(hnr, 6) AS hnr, round(cv, 6) AS int_cv, round(CASE WHEN enough THEN (lo > 0.2 AND hi > 0.2)::INT * 0.5 + (hnr < 10)::INT * 0.3 + (cv > 0.15)::INT * 0.2 ELSE 0 END, 2)::DOUBLE AS score, enough AND lo > 0.2 AND hi > 0.2 AS overlap FROM r""")  # fmt: skip
def x6_overlap(spark, d):
    rows = fr.overlapped_speech(framed(spark, d), frames(spark, d), KEYS)
    return rows.select(*KEYS, *(F.round(c, 6).alias(c) for c in ("low_ratio", "high_ratio", "hnr", "int_cv")), F.round("score", 2).alias("score"), "overlap")


@query("f53_vowels_and_consonants", """v(o, v, a, b) AS (VALUES (0, 'a', 750, 1300), (1, 'e', 500, 1900), (2, 'i', 300, 2400), (3, 'o', 500, 900), (4, 'u', 320, 750)),
p AS (SELECT pos, 200 + pos % 700 AS f1, 700 + pos % 1900 AS f2, 900 + (pos * 31) % 4000 AS c, (pos * 3) % 110 AS ms, pos % 3 = 0 AS voiced FROM seg),
n AS (SELECT pos, arg_min(v, pow((f1 - a) / 200, 2) + pow((f2 - b) / 400, 2) + o * 1e-12) AS vowel FROM p, v GROUP BY pos)
SELECT p.pos, CASE WHEN p.pos % 13 = 0 THEN '?' ELSE vowel END AS vowel, CASE WHEN voiced THEN CASE WHEN ms > 30 THEN CASE WHEN c < 1200 THEN 'm' ELSE 'n' END WHEN c < 1500 THEN 'β' WHEN c > 2500 THEN 'ð' ELSE 'ɣ' END
  WHEN ms < 30 THEN CASE WHEN c > 3000 THEN 't' WHEN c < 1500 THEN 'p' ELSE 'k' END WHEN ms < 80 THEN CASE WHEN c > 4000 THEN 's' WHEN c > 2500 THEN 'tʃ' ELSE 'f' END WHEN c > 3500 THEN 's' WHEN c > 2000 THEN 'ʃ' ELSE 'x' END AS consonant
FROM p JOIN n USING (pos)""")  # fmt: skip
def f53_sounds(spark, d):
    p = F.col("pos")
    vowel = fr.nearest_vowel(F.when(p % 13 != 0, 200 + p % 700), 700 + p % 1900)
    return segments(spark, d).select("pos", vowel.alias("vowel"), fr.consonant(900 + p * 31 % 4000, p * 3 % 110, p % 3 == 0).alias("consonant"))


@plain("s10_prosody_scores", """WITH pr(code, a1, b1, t1, a2, b2, t2, weight) AS (VALUES ('deu', -0.2, 0.3, 0.1, -0.1, 0.1, 0.0, 1.0), ('nah', 0.0, 0.0, 0.5, -0.5, 0.5, 0.1, 0.5)), e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
SELECT vec_id, code, round(greatest(0, 1 - CASE WHEN b1 > a1 THEN (least(1, abs(x - t1) / (b1 - a1)::DOUBLE) + least(1, abs(y - t2) / (b2 - a2)::DOUBLE)) / 2 ELSE least(1, abs(y - t2) / (b2 - a2)::DOUBLE) END) * weight::DOUBLE, 6) AS score FROM e, pr""")  # fmt: skip
def s10_scores(spark, d):
    span = "struct<min:double,max:double,target:double>"
    none = (0.0, 0.0, 0.0)
    table = [("deu", (-0.2, 0.3, 0.1), (-0.1, 0.1, 0.0), none, none, 1.0), ("nah", (0.0, 0.0, 0.5), (-0.5, 0.5, 0.1), none, none, 0.5)]
    profiles = spark.createDataFrame(table, f"code string, f0_range {span}, f0_std {span}, npvi_v {span}, speech_rate {span}, weight double")
    features = {k: F.element_at("embedding", i).cast("double") for i, k in enumerate(fr.PROSODY, 1)}
    rows = read(spark, d, "embeddings").select("vec_id", *(c.alias(k) for k, c in features.items()))
    return fr.prosody_scores(rows, profiles).select("vec_id", "code", F.round("score", 6).alias("score"))


@plain("f46_recording_names", """WITH c AS (SELECT page_id, page_id % 4 AS v, page_id % 5 AS t, page_id % 3 AS k FROM pages)
SELECT page_id, CASE v WHEN 0 THEN 'Omitlan' WHEN 1 THEN 'Tenango' WHEN 2 THEN 'Xonotla' ELSE 'Unknown' END AS village, CASE t WHEN 0 THEN 'Botan' WHEN 1 THEN 'Cuent' WHEN 2 THEN 'Zoolo' ELSE 'Unknown' END AS topic,
  CASE k WHEN 0 THEN '' WHEN 1 THEN 'OPH' || (100 + page_id % 900) ELSE 'OPH' || (100 + page_id % 900) || ' VPR522' END AS speakers FROM c""")  # fmt: skip
def f46_names(spark, d):
    i = F.col("page_id")
    village = F.element_at(F.array(*map(F.lit, ("Omitl", "Tengo", "Xonot", "Xonott"))), (i % 4 + 1).cast("int"))
    topic = F.element_at(F.array(*map(F.lit, ("Botan", "Cuent", "Zoolo", "botan", "Cuenta"))), (i % 5 + 1).cast("int"))
    code = F.concat(F.lit("OPH"), (100 + i % 900).cast("string"))
    who = F.when(i % 3 == 0, F.concat(F.lit("x"), code)).when(i % 3 == 1, code).otherwise(F.concat(code, F.lit("_VPR522")))
    name = tx.recording_name(F.concat_ws("_", village, topic, who, F.lit("2008.wav")))
    return read(spark, d, "pages").select("page_id", name["village"].alias("village"), name["topic"].alias("topic"), F.array_join(name["speakers"], " ").alias("speakers"))


def _any_of(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


@plain("f47_paragraph_candidates", f"""WITH t AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(lower(text), '[a-záéíóúüñç''\\-]+'), lambda x: trim(x, '''')), lambda x: x <> '') AS w FROM benchmark),
c AS (SELECT item_id, len(w) AS n, len(list_filter(w, lambda x: x IN ({_any_of(tx.PARAGRAPH_SPANISH)}))) AS sp, len(list_filter(w, lambda x: x IN ({_any_of(tx.PARAGRAPH_FUNCTION)}))) AS fn,
  len(list_filter(w, lambda x: contains(x, 'tl'))) + len(list_filter(w, lambda x: contains(x, 'tz'))) + len(list_filter(w, lambda x: contains(x, 'hu'))) + 2 * len(list_filter(w, lambda x: suffix(x, 'tzin'))) + len(list_filter(w, lambda x: regexp_matches(x, '^(cuauh|quauh|teo|xoch|tla)'))) AS cl FROM t)
SELECT item_id, round(CASE WHEN n < 5 THEN 0 ELSE fn * 2.0::DOUBLE + cl * 0.6::DOUBLE - sp / n * 6.0::DOUBLE + least(n, 30) * 0.03::DOUBLE END, 4) AS score FROM c""")  # fmt: skip
def f47_candidates(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.round(tx.paragraph_score(F.col("text")), 4).alias("score"))


#: Turns of conversations as subtitles of two flavours, two and a half seconds each.
TURNS = """WITH c AS (SELECT conv_id, turn, (turn * 2.5)::DOUBLE AS start_s, (turn * 2.5 + 2.25)::DOUBLE AS end_s, turn % 4 AS k FROM conversations)
"""


def _files(spark, d, block):
    ms = lambda x: tx.srt_time((x * 1000).cast("long"))
    head = F.concat((F.col("turn") + 1).cast("string"), F.lit("\n"), ms(F.col("turn") * 2.5), F.lit(" --> "), ms(F.col("turn") * 2.5 + 2.25), F.lit("\n"))
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.concat(head, block).alias("block"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda x: x["block"]), "\r\n\r\n")
    return rows.groupBy("conv_id").agg(F.concat(F.lit("no number\n\n"), whole, F.lit("\n\n")).alias("value"))


@plain("s5_annotated_cues", TURNS + """SELECT conv_id, turn + 1 AS cue, start_s, end_s, CASE k WHEN 0 THEN '[NAH|SPEAKER_01|STEM_A] amo ' || turn WHEN 1 THEN '[x SPA y] no SPEAKER_02' WHEN 2 THEN 'plain' ELSE '' END AS text, CASE k WHEN 0 THEN 'NAH' WHEN 1 THEN 'SPA' END AS lang,
  CASE k WHEN 0 THEN 'SPEAKER_01' WHEN 1 THEN 'SPEAKER_02' END AS speaker, CASE k WHEN 0 THEN 'STEM_A' WHEN 1 THEN 'STEM_B-2' END AS stem, CASE k WHEN 1 THEN 'a m o' END AS ipa, CASE k WHEN 1 THEN 0.75::DOUBLE END AS confidence FROM c""")  # fmt: skip
def s5_cues(spark, d):
    k, turn = F.col("turn") % 4, F.col("turn").cast("string")
    block = (
        F.when(k == 0, F.concat(F.lit("[NAH|SPEAKER_01|STEM_A] amo "), turn)).when(k == 1, F.lit("[x SPA y] no SPEAKER_02\n♫fused: a m o \n♫Conf: 0.75 STEM_B-2\n[LLM] left out"))
        .when(k == 2, F.lit("plain\n♫conf: 1.2.3")).otherwise(F.lit(""))
    )
    return st.annotated_cues(_files(spark, d, block), keys=("conv_id",)).select("conv_id", "cue", "start_s", "end_s", "text", "lang", "speaker", "stem", "ipa", "confidence")


@plain("s6_rich_cues", TURNS + """SELECT conv_id, turn + 1 AS cue, start_s, end_s, 2.25::DOUBLE AS duration, CASE k WHEN 0 THEN 'SPEAKER_1|b' WHEN 1 THEN 'S2' ELSE '?' END AS speaker, CASE k WHEN 0 THEN 'nah' WHEN 1 THEN 'spa' ELSE 'oth' END AS lang,
  CASE k WHEN 0 THEN 'amo [LLM]' WHEN 1 THEN 'hola' WHEN 2 THEN 'plain [XX]' ELSE '' END AS text, CASE k WHEN 0 THEN 'ft' WHEN 1 THEN 'unc' ELSE 'whisper' END AS source, CASE k WHEN 0 THEN 'a l' ELSE '' END AS ipa_allo, CASE k WHEN 0 THEN 'w' ELSE '' END AS ipa_w2v2,
  CASE k WHEN 0 THEN 'tɬ kʼ a ts kʼ' WHEN 1 THEN 'pʼ o' ELSE '' END AS ipa_fused, CASE k WHEN 1 THEN '10ms' ELSE '' END AS trim, CASE k WHEN 0 THEN '0.5' ELSE '' END AS conf, CASE k WHEN 0 THEN 'kʼ ts tɬ' ELSE '' END AS nah_markers, CASE k WHEN 0 THEN 'kʼ' WHEN 1 THEN 'pʼ' ELSE '' END AS ejectives FROM c""")  # fmt: skip
def s6_cues(spark, d):
    k = F.col("turn") % 4
    block = (
        F.when(k == 0, F.lit("[Nahuatl|SPEAKER_1|b]  [FT] amo [LLM]\n♫allo: a l\n♫w2v2: x\n♫w2v2: w\n♫fused: tɬ kʼ a ts kʼ\n♫conf: 0.5"))
        .when(k == 1, F.lit("[español|S2] hola [UNC]\n♫fused: pʼ o\n♫trim:10ms\n ♫conf: 1")).when(k == 2, F.lit("plain [XX]")).otherwise(F.lit(""))
    )
    rows = st.rich_cues(_files(spark, d, block), keys=("conv_id",)).withColumns({c: F.array_join(c, " ") for c in ("nah_markers", "ejectives")})
    return rows.drop("i")


@query("k6_benchmark_report", """r AS (SELECT cue % 7 AS media, lower(gt_lang) AS gt, pred_lang AS pred FROM (SELECT cue, CASE WHEN cue % 19 = 0 THEN 'unk' ELSE gt_lang END AS gt_lang, pred_lang FROM cue) WHERE cue % 13 <> 0)
SELECT media, count(*) AS total, count(*) FILTER (WHERE gt = 'unk') AS unk, round(count(*) FILTER (WHERE gt = pred) / count(*), 4) AS accuracy_all, round(count(*) FILTER (WHERE gt = pred AND gt <> 'unk') / count(*) FILTER (WHERE gt <> 'unk'), 4) AS accuracy_known,
  round(count(*) FILTER (WHERE gt = pred AND gt IN ('nah', 'spa')) / nullif(count(*) FILTER (WHERE gt IN ('nah', 'spa')), 0), 4) AS accuracy_two, round(count(*) FILTER (WHERE gt <> 'unk' AND (gt = 'nah') = (pred = 'nah')) / count(*) FILTER (WHERE gt <> 'unk'), 4) AS accuracy_nah,
  coalesce(round(count(*) FILTER (WHERE gt = 'nah' AND pred = 'nah') / nullif(count(*) FILTER (WHERE gt <> 'unk' AND pred = 'nah'), 0), 4), 0) AS nah_precision, coalesce(round(count(*) FILTER (WHERE gt = 'nah' AND pred = 'nah') / nullif(count(*) FILTER (WHERE gt = 'nah'), 0), 4), 0) AS nah_recall,
  (SELECT coalesce(string_agg(gt || '>' || pred || ':' || n, ' ' ORDER BY gt, pred), '') FROM (SELECT gt, pred, count(*) AS n FROM r q WHERE q.media = r.media AND gt <> 'unk' GROUP BY gt, pred)) AS confusion FROM r GROUP BY media""")  # fmt: skip
def k6_report(spark, d):
    lang = F.upper(F.when(F.col("cue") % 19 == 0, "unk").otherwise(F.col("lang")))
    media, none = (F.col("cue") % 7).alias("media"), F.lit(None).cast("double")
    rows = truth(spark, d).select(media, F.col("cue").alias("cue_index"), lang.alias("correct_lang"), F.lit("S1").alias("correct_speaker"), none.alias("start_s"), none.alias("end_s"))
    report = st.snapshot_report(st.truth_snapshot(rows), predictions(spark, d).select(media, F.col("cue").alias("cue_index"), "lang"))
    cell = lambda x: F.concat(x["gt"], F.lit(">"), x["pred"], F.lit(":"), x["n"].cast("string"))
    return report.withColumn("confusion", F.array_join(F.transform("confusion", cell), " "))


@query("k8_segment_manifests", "x AS (SELECT 1) SELECT media, to_json({'version': '1.0', 'segment_count': count(*), 'total_speech_ms': sum(e - s)::BIGINT, 'segments': list({'start_ms': s, 'end_ms': e, 'duration_ms': e - s} ORDER BY s, pos)})::VARCHAR AS value FROM seg GROUP BY media")
def k8_manifests(spark, d):
    return st.segment_manifests(segments(spark, d))


@plain("w19_merged_bleed", """WITH t AS (SELECT conv_id, turn, turn % 3 AS k, turn % 6 < 3 AS same FROM conversations)
SELECT conv_id, turn, (turn * 1.0)::DOUBLE AS s, (turn * 1.0 + CASE WHEN k = 1 AND same AND EXISTS (SELECT 1 FROM t b WHERE b.conv_id = t.conv_id AND b.turn = t.turn + 1) THEN 2.0 ELSE 1.0 END)::DOUBLE AS e,
  CASE k WHEN 0 THEN 'amo nikan' WHEN 1 THEN 'Él vino por la noche, tarde ' || turn WHEN 2 THEN CASE WHEN same THEN 'por la noche' END END AS text,
  CASE WHEN k = 1 AND same AND EXISTS (SELECT 1 FROM t b WHERE b.conv_id = t.conv_id AND b.turn = t.turn + 1) THEN 'i' || turn || ' i' || (turn + 1) ELSE 'i' || turn END AS ipa,
  CASE WHEN k = 1 AND same AND EXISTS (SELECT 1 FROM t b WHERE b.conv_id = t.conv_id AND b.turn = t.turn + 1) THEN '+bleed-merged' WHEN k = 2 THEN '+bleed-pruned' ELSE '' END AS mark
FROM t WHERE NOT (k = 2 AND same)""")  # fmt: skip
def w19_merged(spark, d):
    turn, k = F.col("turn"), F.col("turn") % 3
    text = F.when(k == 0, "amo nikan").when(k == 1, F.concat(F.lit("Él vino por la noche, tarde "), turn.cast("string"))).otherwise("por la Noche!")
    rows = read(spark, d, "conversations").select("conv_id", "turn", (turn * 1.0).alias("s"), (turn * 1.0 + 1.0).alias("e"), text.alias("text"), F.when((k == 2) & (turn % 6 >= 3), "B").otherwise("A").alias("speaker"), F.lit("spa").alias("lang"), F.concat(F.lit("i"), turn.cast("string")).alias("ipa"))
    return runs.bleed_merged(rows, ("conv_id",), ("s", "turn")).select("conv_id", F.col("turn").cast("long").alias("turn"), "s", "e", "text", "ipa", "mark")
