"""Queries over subtitle texts, cascades, sequence folds and streams."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from loomwork.functions import sequences as sq
from loomwork.functions import symbols as sy
from loomwork.functions import text as tx
from loomwork.operators import cascade as ca
from loomwork.operators import intervals as iv
from loomwork.plans.base import DAY, EVENTS, millis, plain, query, read, segments, transcripts, turns
from loomwork.plans.text_queries import RULES
from loomwork.sources import subtitles as st
from loomwork.streaming import live


def _day_rows(spark, d):
    return segments(spark, d).withColumns({"s": F.col("s") % DAY, "e": F.col("s") % DAY + F.col("e") - F.col("s"), "text": F.concat(F.lit("word "), F.col("pos").cast("string")), "speaker": F.concat(F.lit("SPEAKER_"), F.substring("speaker", 2, 2))})


@query("s4_s7_k2_subtitle_round_trip", "r AS (SELECT media, row_number() OVER (PARTITION BY media ORDER BY s % 86400000, pos) AS cue, s % 86400000 AS s, s % 86400000 + e - s AS e, lang, 'SPEAKER_' || substr(speaker, 2, 2) AS speaker, 'word ' || pos AS body FROM seg) SELECT media, cue, s, e, lang, speaker, body FROM r")
def s4(spark, d):
    files = st.subtitle_texts(_day_rows(spark, d).drop("conf"))
    return st.cues(files, keys=("media",)).select("media", "cue", "s", "e", "lang", "speaker", "body")


@query("k1_k3_retagged_subtitles", "x AS (SELECT 1) SELECT media, count(*) FILTER (WHERE lang = 'spa') AS spa, count(*) FILTER (WHERE lang IN ('other', 'nah')) AS nah FROM seg GROUP BY media")
def k9(spark, d):
    files = st.subtitle_texts(_day_rows(spark, d).drop("conf")).withColumn("value", st.retagged(F.col("value"), {"OTHER": "NAH"}))
    return st.cues(files, keys=("media",)).groupBy("media").agg(F.count_if(F.col("lang") == "spa").alias("spa"), F.count_if(F.col("lang") == "nah").alias("nah"))


@plain("s13_s14_transcriber_turns", "SELECT conv_id, turn, role AS speaker, turn * 2.5::DOUBLE AS s, (turn + 1) * 2.5::DOUBLE AS e FROM conversations")
def s14(spark, d):
    turn = F.format_string('<Turn speaker="%s" startTime="%s" endTime="%s"/>', "role", (F.col("turn") * 2.5).cast("string"), ((F.col("turn") + 1) * 2.5).cast("string"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("x")))), lambda x: x["x"]), "")
    files = read(spark, d, "conversations").groupBy("conv_id").agg(F.concat(F.lit('<Trans><Episode><Section endTime="99">'), body, F.lit("</Section></Episode></Trans>")).alias("value"))
    return st.transcriber_turns(files, keys=("conv_id",)).select("conv_id", F.col("turn").cast("long").alias("turn"), "speaker", "s", "e")


@plain("s15_elan_annotations", "SELECT conv_id, 'tier' AS tier, min(turn) * 100 AS s, max(turn) * 100 + 100 AS e, 'n' || count(*) AS value FROM conversations GROUP BY conv_id")
def s15(spark, d):
    g = read(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"), F.count("*").alias("n"))
    one = '<TIME_SLOT TIME_SLOT_ID="%s" TIME_VALUE="%s"/>'
    xml = F.concat(
        F.lit("<ANNOTATION_DOCUMENT><TIME_ORDER>"), F.format_string(one, F.lit("t1"), (F.col("a") * 100).cast("string")), F.format_string(one, F.lit("t2"), (F.col("b") * 100 + 100).cast("string")), F.lit("</TIME_ORDER>"),
        F.lit('<TIER TIER_ID="tier"><ANNOTATION><ALIGNABLE_ANNOTATION TIME_SLOT_REF1="t1" TIME_SLOT_REF2="t2"><ANNOTATION_VALUE>n'), F.col("n").cast("string"), F.lit("</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION></TIER>"),
        F.lit('<TIER TIER_ID="traduccion"><ANNOTATION><ALIGNABLE_ANNOTATION TIME_SLOT_REF1="t1" TIME_SLOT_REF2="t2"><ANNOTATION_VALUE>x</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION></TIER></ANNOTATION_DOCUMENT>'),
    )
    return st.elan_annotations(g.select("conv_id", xml.alias("value")), keys=("conv_id",))


@plain("s17_manifest_join", "SELECT c.conv_id * 100 + c.turn AS utt_id, c.role, CASE WHEN c.turn % 2 = 0 THEN c.turn * 1.5::DOUBLE END AS s FROM conversations c")
def s17(spark, d):
    texts = read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("utt_id"), "role", "turn")
    return st.manifest(texts.select("utt_id", "role"), texts.where("turn % 2 = 0").select("utt_id", (F.col("turn") * 1.5).alias("s")))


@plain("s18_inventories", "SELECT lower(trim(lang)) AS iso, string_agg(DISTINCT source, ' ' ORDER BY source) AS phonemes FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1")
def s18(spark, d):
    return st.inventories(read(spark, d, "documents"), "lang", "source", ["en", "fr"]).select("iso", F.array_join("phonemes", " ").alias("phonemes"))


@plain("s20_paragraphs", "SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text <> ''")
def s20(spark, d):
    spaced = F.regexp_replace("text", "\\n", "\n \n")
    return read(spark, d, "documents").where("text <> ''").select("doc_id", F.size(st.paragraphs(spaced)).alias("n"))


@plain("k4_nested_export", "SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS n, coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS turns FROM conversations GROUP BY conv_id")
def k4(spark, d):
    rows = read(spark, d, "conversations")
    out = st.nested(rows.select("conv_id").distinct(), rows.where("role = 'assistant'").select("conv_id", "turn", "role"), "conv_id")
    return out.select("conv_id", F.size("children").cast("long").alias("n"), F.array_join(F.transform("children", lambda x: x["turn"].cast("string")), ",").alias("turns"))


@plain("k7_count_tables", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type")
def k7(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "event_type")


@plain("k11_upsert", "SELECT coalesce(o.k, n.k) AS k, coalesce(n.a, o.a) AS a, coalesce(n.b, o.b) AS b FROM (SELECT c_custkey AS k, c_mktsegment AS a, c_nationkey AS b FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'new' END AS a, c_nationkey + 1 AS b FROM customer WHERE c_custkey % 2 = 0) n ON o.k = n.k")
def k11(spark, d):
    c = read(spark, d, "customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("a"), F.col("c_nationkey").alias("b"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 4 != 0, "new").alias("a"), (F.col("c_nationkey") + 1).alias("b"))
    return st.upserted(old, new, ["k"])


EVIDENCE = """ev AS (SELECT media, pos, s, e, event_type, speaker, n % 9 = 7 AS tl, pos % 5 = 0 AS ovl, CASE WHEN pos % 4 = 0 THEN 'spa' WHEN pos % 4 = 1 THEN 'eng' END AS text_lang, (pos % 23) // 6 AS latin, (pos % 10) / 5.0::DOUBLE AS maya,
  lang AS asr_lang, conf >= 0.1 AS asr_ok, conf AS asr_conf, CASE WHEN pos % 3 = 0 THEN 'nah' END AS ipa_lang, 0.6::DOUBLE AS ipa_conf FROM seg),
dc AS (SELECT *, CASE WHEN tl AND NOT ovl AND coalesce(text_lang, '') <> 'spa' AND text_lang IS NOT NULL THEN 'tl' WHEN latin >= 3 THEN 'latin' WHEN maya >= 1.2 AND asr_lang <> 'spa' THEN 'maya_hint' WHEN asr_ok AND text_lang = 'spa' THEN 'asr_text' WHEN asr_ok THEN 'asr' WHEN ipa_lang IS NOT NULL THEN 'ipa' ELSE 'none' END AS source FROM ev),
c1 AS (SELECT media, pos, source, CASE source WHEN 'tl' THEN 'nah' WHEN 'latin' THEN 'lat' WHEN 'maya_hint' THEN 'may' WHEN 'asr_text' THEN 'spa' WHEN 'asr' THEN asr_lang WHEN 'ipa' THEN ipa_lang ELSE 'other' END AS lang,
  round(CASE source WHEN 'tl' THEN 0.9 WHEN 'latin' THEN 0.95 WHEN 'maya_hint' THEN least(0.9, maya / 2) WHEN 'asr_text' THEN asr_conf WHEN 'asr' THEN asr_conf WHEN 'ipa' THEN ipa_conf ELSE 0 END, 6)::DOUBLE AS conf, s, e, speaker FROM dc)
"""


def evidence(spark, d):
    p = F.col("pos")
    return segments(spark, d).select(
        "media", "pos", "s", "e", "event_type", "speaker", (F.col("n") % 9 == 7).alias("tl"), (p % 5 == 0).alias("overlaps"), F.when(p % 4 == 0, "spa").when(p % 4 == 1, "eng").alias("text_lang"),
        F.floor(p % 23 / 6).alias("latin"), (p % 10 / 5.0).alias("maya"), F.col("lang").alias("asr_lang"), (F.col("conf") >= 0.1).alias("asr_ok"), F.col("conf").alias("asr_conf"), F.when(p % 3 == 0, "nah").alias("ipa_lang"), F.lit(0.6).alias("ipa_conf"),
    )


@query("c1_turn_decision", EVIDENCE + "SELECT media, pos, lang, conf, source FROM c1")
def c1(spark, d):
    return ca.turn_decision(evidence(spark, d)).select("media", "pos", "lang", F.round("conf", 6).alias("conf"), "source")


@query("c2_ejective_vote", "x AS (SELECT 1) SELECT pos, CASE WHEN pos % 3 = 2 THEN CASE WHEN pos % 7 = 0 THEN FALSE ELSE ((pos % 2 = 0)::INT * 0.4 + (pos % 5 < 2)::INT * 0.3) / 0.7 >= 0.5 END ELSE CASE WHEN pos % 7 = 0 THEN FALSE ELSE ((pos % 2 = 0)::INT * 0.4 + (pos % 5 < 2)::INT * 0.3 + (pos % 11 < 6)::INT * 0.3) / 1.0 >= 0.5 END END AS ejective FROM seg WHERE pos % 7 <> 0")
def c2(spark, d):
    p = F.col("pos")
    return segments(spark, d).where("pos % 7 <> 0").select("pos", ca.ejective_vote(p % 2 == 0, p % 5 < 2, F.when(p % 3 != 2, p % 11 < 6)).alias("ejective"))


@query("c3_second_voter", EVIDENCE + ", v AS (SELECT *, CASE WHEN pos % 2 = 0 THEN lang ELSE 'may' END AS v, (pos % 20) / 20.0::DOUBLE AS vc FROM c1) SELECT media, pos, CASE WHEN v <> lang AND vc >= 0.9 AND conf < 0.5 THEN v ELSE lang END AS lang, CASE WHEN v = lang THEN 'agree' WHEN vc >= 0.9 AND conf < 0.5 THEN 'override' ELSE 'none' END AS voted FROM v")
def c3(spark, d):
    rows = ca.turn_decision(evidence(spark, d)).withColumn("mms", F.when(F.col("pos") % 2 == 0, F.col("lang")).otherwise("may")).withColumn("mms_conf", F.col("pos") % 20 / 20.0)
    return ca.voted(rows, "lang", "mms", "conf").select("media", "pos", "lang", "voted")


@query("c4_post_passes", EVIDENCE + """, h AS (SELECT media, speaker, count(*) AS t, count(*) FILTER (WHERE source = 'tl') AS h FROM c1 GROUP BY ALL),
a AS (SELECT c1.*, CASE WHEN t >= 5 AND h >= 3 AND h / t >= 0.02 AND lang = 'spa' AND conf < 0.7 THEN 'nah' ELSE lang END AS l1 FROM c1 JOIN h USING (media, speaker)),
b0 AS (SELECT media, speaker, l1, count(*) AS w, min(s) AS s0, arg_min(pos, (s, pos)) AS p0 FROM a WHERE l1 NOT IN ('other', 'silence') GROUP BY ALL),
b1 AS (SELECT *, row_number() OVER (PARTITION BY media, speaker ORDER BY w DESC, s0, p0) AS rk, sum(w) OVER (PARTITION BY media, speaker) AS total FROM b0),
b AS (SELECT media, speaker, l1 AS main FROM b1 WHERE rk = 1 AND total >= 3 AND w / total >= 0.3),
p AS (SELECT a.*, CASE WHEN main IS NOT NULL AND l1 = 'other' THEN main ELSE l1 END AS l2 FROM a LEFT JOIN b ON b.media = a.media AND b.speaker = a.speaker)
SELECT media, pos, CASE WHEN conf < 0.02 AND l2 NOT IN ('other', 'silence', 'unknown', 'lat') THEN 'unknown' ELSE l2 END AS lang FROM p""")
def c4(spark, d):
    from loomwork.operators.speakers import flipped_by_evidence, with_prior

    rows = ca.turn_decision(evidence(spark, d)).withColumn("conf", F.round("conf", 6))
    rows = flipped_by_evidence(rows, F.col("source") == "tl", "spa", "nah", share=0.02)
    rows = with_prior(rows, share=0.3)
    weak = (F.col("conf") < 0.02) & ~F.col("lang").isin("other", "silence", "unknown", "lat")
    return rows.select("media", "pos", F.when(weak, "unknown").otherwise(F.col("lang")).alias("lang"))


@plain("c5_spanish_reclaim", "WITH t AS (SELECT conv_id, turn, text, CASE WHEN turn % 2 = 0 THEN 'nah' ELSE 'spa' END AS lang, (turn % 5) / 5.0::DOUBLE AS sh FROM conversations) SELECT conv_id, turn, CASE WHEN lang <> 'spa' AND sh >= 0.35 AND NOT regexp_matches(lower(text), 'nik[aeiou]|tik[aeiou]|mik[aeiou]|tict|nicn') AND NOT contains(text, 'tion') THEN 'spa' ELSE lang END AS lang FROM t")
def c5(spark, d):
    rows = read(spark, d, "conversations").withColumns({"lang": F.when(F.col("turn") % 2 == 0, "nah").otherwise("spa"), "spanish_share": F.col("turn") % 5 / 5.0, "exclusive": F.contains("text", F.lit("tion"))})
    return ca.spanish_reclaim(rows).select("conv_id", "turn", "lang")


@query("c6_output_text", "o AS (SELECT pos, CASE WHEN pos % 11 = 0 THEN 'r' END AS rec, CASE WHEN pos % 7 = 0 THEN 'u' ELSE '' END AS unc, CASE WHEN pos % 5 = 0 THEN 'f' END AS ft, CASE WHEN pos % 3 = 0 THEN 'l' END AS llm, CASE WHEN pos % 2 = 0 THEN 'i' END AS ipa FROM seg) SELECT pos, coalesce(rec, nullif(unc, ''), ft, llm, ipa, 't') AS shown, CASE WHEN rec IS NOT NULL THEN 'REC' WHEN unc <> '' THEN 'UNC' WHEN ft IS NOT NULL THEN 'FT' WHEN llm IS NOT NULL THEN 'LLM' WHEN ipa IS NOT NULL THEN 'IPA' ELSE 'whisper' END AS mark FROM o")
def c6(spark, d):
    p = F.col("pos")
    rows = segments(spark, d).select("pos", F.when(p % 11 == 0, "r").alias("rec"), F.when(p % 7 == 0, "u").otherwise("").alias("unc"), F.when(p % 5 == 0, "f").alias("ft"), F.when(p % 3 == 0, "l").alias("llm"), F.when(p % 2 == 0, "i").alias("ipa"), F.lit("t").alias("text"))
    return ca.output_text(rows).select("pos", "shown", "mark")


@query("c7_tier_routing", """tr AS (SELECT *, CASE WHEN -conf * 2 > -0.3 THEN 'HIGH' WHEN -conf * 2 < -0.7 THEN 'LOW' ELSE 'MEDIUM' END AS tier FROM asr),
b AS (SELECT a.media, a.pos, t.pos AS best, least(a.e, t.e) - greatest(a.s, t.s) AS ov, a.s, row_number() OVER (PARTITION BY a.media, a.pos ORDER BY least(a.e, t.e) - greatest(a.s, t.s) DESC, t.s, t.pos) AS rk FROM tr a JOIN turn t ON a.media = t.media AND a.s < t.e AND t.s < a.e WHERE a.tier = 'HIGH'),
w AS (SELECT *, row_number() OVER (PARTITION BY media, best ORDER BY ov DESC, s, pos) AS r2 FROM b WHERE rk = 1),
hi AS (SELECT t.media, t.s, t.e, 'whisper' AS backend FROM w JOIN turn t ON t.media = w.media AND t.pos = w.best WHERE r2 = 1),
me AS (SELECT media, s, e, 'whisper-medium' AS backend FROM tr WHERE tier = 'MEDIUM'),
fb AS (SELECT media, s, e, 'turn' AS backend FROM turn t WHERE NOT EXISTS (SELECT 1 FROM w WHERE r2 = 1 AND w.media = t.media AND w.best = t.pos) UNION ALL SELECT media, s, e, 'low' FROM tr WHERE tier = 'LOW'),
ok AS (SELECT * FROM hi UNION ALL SELECT * FROM me)
SELECT media, s, e, backend FROM ok UNION ALL SELECT media, s, e, backend FROM fb WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.media = fb.media AND fb.s < ok.e AND fb.e > ok.s)""")
def c7(spark, d):
    asr = transcripts(spark, d).withColumn("tier", tx.confidence_tier(-F.col("conf") * 2))
    speech = turns(spark, d)
    claimed = iv.one_to_one(asr.where("tier = 'HIGH'"), speech)
    won = claimed.where("pos IS NOT NULL").select("media", F.col("best").alias("pos"))
    columns = lambda df, backend: df.select("media", "s", "e", F.lit(backend).alias("backend"))
    accepted = columns(speech.join(won, ["media", "pos"], "left_semi"), "whisper").unionByName(columns(asr.where("tier = 'MEDIUM'"), "whisper-medium"))
    rest = columns(speech.join(won, ["media", "pos"], "left_anti"), "turn").unionByName(columns(asr.where("tier = 'LOW'"), "low")).withColumn("pos", F.struct("s", "e", "backend"))
    return accepted.unionByName(iv.without_overlaps(rest, accepted).drop("pos"))


@query("c10_separated_pick", "k AS (SELECT media, pos // 2 AS turn, pos % 2 AS src, lang, conf FROM seg), g AS (SELECT media, turn, count(DISTINCT lang) AS kinds, arg_max(src, (conf, -src)) AS best, arg_max(src, (conf, -src)) FILTER (WHERE lang <> 'nah') AS other FROM k GROUP BY ALL) SELECT g.media, g.turn, k.src, k.lang FROM g JOIN k ON k.media = g.media AND k.turn = g.turn AND k.src = CASE WHEN kinds > 1 AND other IS NOT NULL THEN other ELSE best END")
def c10(spark, d):
    rows = segments(spark, d).select("media", F.expr("pos div 2").alias("turn"), (F.col("pos") % 2).alias("src"), "lang", "conf")
    return ca.separated_pick(rows, ["media", "turn"]).select("media", "turn", "src", "lang")


@query("f49_unknown_classifier", "x AS (SELECT 1) SELECT pos, CASE WHEN n = 7 THEN 'nah' WHEN n = 5 THEN 'may' WHEN pos % 13 >= 11 THEN 'nah' WHEN pos % 4 = 0 THEN 'spa' WHEN conf > 0.25 THEN 'eng' ELSE 'oth' END AS lang FROM seg")
def f49(spark, d):
    p = F.col("pos")
    rows = segments(spark, d).select("pos", (F.col("n") == 7).alias("tl"), (F.col("n") == 5).alias("ejective"), F.when(p % 13 >= 11, 2).otherwise(0).alias("lexicon_hits"), F.when(p % 4 == 0, "spa").alias("text_lang"), (F.col("conf") * 2).alias("margin"), F.lit("eng").alias("likeliest"))
    return ca.third_class(rows).select("pos", "lang")


def _words(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " ").alias("w"))


@query("f11_expand_contract")
def f11(spark, d):
    f = sq.vectorised(lambda w: sq.expand_contract(list(w), {"th": ("t", "h"), "tz": ("t", "z")}), "array<string>")
    return _words(spark, d).select("item_id", f(F.split(F.array_join("w", ""), "")).alias("phones"))


@query("f12_expand_contract_variants")
def f12(spark, d):
    f = sq.vectorised(lambda w: sq.expand_contract(list(w), sq.EJECTIVE_PARTS, sq.AFFRICATE_PARTS), "array<string>")
    marked = F.regexp_replace(F.regexp_replace(F.array_join("w", " "), "e", "ʼ"), " ", "")
    return _words(spark, d).select("item_id", f(F.split(marked, "")).alias("phones"))


@query("f19_f20_phone_vote")
def f20(spark, d):
    def fuse(a, b):
        found, sure = sq.vote(list(a), [0.4 + len(x) / 20 for x in a], list(b), [sq.default_confidences(len(b) / 20)[0]] * len(b))
        return {"fused": found, "confidence": sure}

    t = _words(spark, d)
    other = t.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("b"))
    return t.select("item_id", F.col("w").alias("a")).join(other, "item_id").select("item_id", sq.vectorised(fuse, "struct<fused:array<string>,confidence:double>")("a", "b").alias("v")).select("item_id", "v.*")


@query("f23_f25_letters_and_sounds")
def f23(spark, d):
    to = sq.vectorised(lambda t: sq.letters_to_sounds(t, RULES), "array<string>")
    back = sq.vectorised(lambda p: sq.sounds_to_letters(list(p), RULES), "string")
    return read(spark, d, "benchmark").select("item_id", to("text").alias("ipa")).withColumn("text", back("ipa"))


@query("f35_closest_word")
def f35(spark, d):
    f = sq.vectorised(lambda t: sq.closest_word(t or "", ["thering", "castellano"]), "string")
    return read(spark, d, "benchmark").select("item_id", f("text").alias("word"))


@query("f55_morphemes")
def f55(spark, d):
    tables = ({"ni": ("ni", 1), "ti": ("ti", 1), "ki": ("ki", 2), "on": ("on", 3), "th": ("th", 2)}, {"kali": "kali", "ation": "ation", "eren": "eren"}, {"tin": ("tin", 1), "ing": ("ing", 1), "ed": ("ed", 2)})
    f = sq.vectorised(lambda w: [{"kind": k, "form": v} for k, v in sq.morphemes(list(w), *tables)], "array<struct<kind:string,form:string>>")
    return _words(spark, d).select("item_id", F.posexplode("w").alias("i", "word")).where("word <> ''").select("item_id", "i", f("word").alias("parts"))


@query("x3_voice_onset", "m AS (SELECT media, max(conf) AS top FROM seg GROUP BY media) SELECT s.media, min(s.s) AS onset, max(s.s) AS offset_ FROM seg s JOIN m USING (media) WHERE conf > top - 0.3 GROUP BY s.media")
def x3(spark, d):
    rows = segments(spark, d)
    top = rows.groupBy("media").agg(F.max("conf").alias("top"))
    return rows.join(top, "media").where(F.col("conf") > F.col("top") - 0.3).groupBy("media").agg(F.min("s").alias("onset"), F.max("s").alias("offset_"))


@query("x5_x6_frame_ratios", "x AS (SELECT 1) SELECT media, round(count(*) FILTER (WHERE conf < 0.05) / count(*), 6) AS low, round(count(*) FILTER (WHERE conf > 0.2) / count(*), 6) AS high, count(*) FILTER (WHERE conf < 0.05) / count(*) > 0.2 AND count(*) FILTER (WHERE conf > 0.2) / count(*) > 0.1 AS overlap FROM seg GROUP BY media")
def x6(spark, d):
    low, high = F.count_if(F.col("conf") < 0.05) / F.count("*"), F.count_if(F.col("conf") > 0.2) / F.count("*")
    return segments(spark, d).groupBy("media").agg(F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), ((low > 0.2) & (high > 0.1)).alias("overlap"))


@plain("st6_streaming_buckets", "SELECT event_type, (epoch_us(ts) // 1000) // 300000 AS bucket, count(*) AS n FROM events GROUP BY ALL")
def st6(spark, d):
    events = live.event_stream(spark, f"{d}/events.parquet", EVENTS)
    counts = events.groupBy("event_type", F.floor(millis("ts") / 300000).alias("bucket")).agg(F.count("*").alias("n"))
    return live.collected(counts, live.checkpoint_folder(spark), "complete")


@query("st2_st4_streaming_runs")
def st2(spark, d):
    events = live.event_stream(spark, f"{d}/events.parquet", EVENTS)
    s = millis("ts")
    rows = events.select(F.col("user_id").alias("media"), s.alias("s"), (s + F.floor(F.col("value") * 1000)).cast("long").alias("e"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("lang"))
    return live.collected(live.closed_runs(rows, longest=10**12), live.checkpoint_folder(spark), rest=live.last_runs)


@query("w19_bleed_fragments", "l AS (SELECT media, pos, lang, speaker, lag(lang) OVER w AS a, lead(lang) OVER w AS b, e - s AS len FROM seg WINDOW w AS (PARTITION BY media ORDER BY s, pos)) SELECT media, pos FROM l WHERE NOT coalesce(len < 5000 AND a = lang AND b = lang, FALSE)")
def w19(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("media").orderBy("s", "pos")
    rows = segments(spark, d).withColumns({"a": F.lag("lang").over(w), "b": F.lead("lang").over(w)})
    return rows.where(~F.coalesce((F.col("e") - F.col("s") < 5000) & (F.col("a") == F.col("lang")) & (F.col("b") == F.col("lang")), F.lit(False))).select("media", "pos")


@query("w21_st3_stable_labels")
def w21(spark, d):
    from loomwork.operators.runs import folded, stable_labels

    def fold(rows):
        passes = [[r for r in rows if r["pos"] % 2 == k] for k in (0, 1)]
        return [{"media": r["media"], "pos": r["pos"], "label": x} for p, names in zip(passes, stable_labels(passes)) for r, x in zip(p, names)]

    return folded(turns(spark, d).select("media", "pos", "s", "e", "speaker"), fold, "media long, pos long, label string")


def cross_validated(rows, folds: int = 5):
    """``(id, label, fold, prediction, fold_accuracy, accuracy)`` of rows of ``(id, label, features)``.

    Each label's rows are dealt in turn by the hash of their id; a row's prediction
    is that of the model fitted on the other folds.  Accuracy is that of all predictions.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.sql import Window

    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    rows = rows.withColumn("fold", (F.row_number().over(order) % folds).cast("int")).cache()
    held = []
    for k in range(folds):
        model = LogisticRegression(maxIter=10, regParam=0.01).fit(rows.where(F.col("fold") != k))
        held.append(model.transform(rows.where(F.col("fold") == k)).select("id", "label", "fold", "prediction"))
    out = functools.reduce(lambda a, b: a.unionByName(b), held)
    right = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    by_fold = out.groupBy("fold").agg(right.alias("fold_accuracy"))
    return out.join(F.broadcast(by_fold), "fold").crossJoin(F.broadcast(out.agg(right.alias("accuracy"))))


@query("a36_cross_validated_predictions")
def a36_predictions(spark, d):
    from pyspark.ml.functions import array_to_vector

    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return cross_validated(rows).select(F.col("id").alias("vec_id"), "fold", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"), "fold_accuracy", "accuracy")


@plain("f52_fused_transliterations", """WITH p AS (SELECT a.item_id, lower(a.text) AS x, lower(b.text) AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
i AS (SELECT item_id, list_filter(string_split_regex(x, '\\s+'), lambda w: w <> '') AS wx, list_filter(string_split_regex(y, '\\s+'), lambda w: w <> '') AS wy FROM p),
e AS (SELECT item_id, k, wx[k] AS a, wy[k] AS b FROM (SELECT *, unnest(range(1, greatest(len(wx), len(wy)) + 1)) AS k FROM i)),
cue(c) AS (VALUES ('tl'), ('tz'), ('hu'), ('qu'), ('cu'), ('x'), ('z'), ('k'), ('tlan'), ('meh')),
v AS (SELECT DISTINCT a AS w FROM e WHERE a IS NOT NULL UNION SELECT b FROM e WHERE b IS NOT NULL),
sc AS (SELECT w, 25 * (SELECT count(*) FROM cue WHERE contains(w, c)) + CASE WHEN length(w) >= 6 THEN 10 ELSE 0 END
              - CASE WHEN w IN ('de', 'del', 'la', 'el', 'y', 'que', 'en', 'por', 'para', 'con', 'no', 'es', 'un', 'una') THEN 30 ELSE 0 END AS s FROM v),
f AS (SELECT item_id, k, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN sb.s - sa.s > 5 THEN b WHEN sa.s - sb.s > 5 THEN a WHEN length(a) >= length(b) THEN a ELSE b END AS w
      FROM e LEFT JOIN sc sa ON sa.w = a LEFT JOIN sc sb ON sb.w = b),
n AS (SELECT item_id, string_agg(w, ' ' ORDER BY k) AS t, max(k) AS last, arg_max(w, k) AS lw FROM f GROUP BY item_id)
SELECT n.item_id, CASE WHEN n.item_id % 2 = 0 AND lw LIKE '%ki' THEN left(t, length(t) - 2) || 'izke' WHEN n.item_id % 2 = 0 AND lw LIKE '%ke' THEN left(t, length(t) - 2) || 'zke'
                       WHEN n.item_id % 2 = 0 AND lw LIKE '%i' THEN t || 'zke' ELSE t END AS fused FROM n""")
def f52(spark, d):
    t = read(spark, d, "benchmark").select("item_id", F.lower("text").alias("x"))
    other = t.select((F.col("item_id") - 1).alias("item_id"), F.col("x").alias("y"))
    heard = F.when(F.col("item_id") % 2 == 0, "a s k i").otherwise("a s k a")
    return t.join(other, "item_id").select("item_id", sy.fused_transliteration(F.col("x"), F.col("y"), heard).alias("fused"))


@plain("f36_scored_check", """WITH t AS (SELECT conv_id, turn, lower(text) AS t FROM conversations)
SELECT conv_id, turn, length(t) >= 4 AND (CASE WHEN contains(t, 'thering') OR contains(t, 'ation') THEN 35 WHEN contains(t, 'ouan') OR contains(t, 'eren') THEN 20 ELSE 0 END
  + least(30, 15 * len(regexp_extract_all(t, 'nik[aeiou]|tik[aeiou]|mik[aeiou]|tict|ticm|ticn|nicn|nicm|nict|ichi|pil|neci|mati|caci|pano|mict|tequi|chiua|cipac|mani|tonan|nican|tlaco|acal|cali|ichan|ipan|ican|isti|lis|ilia|ilis|teca|tlaca|xica|naca|meca|titec|teka|tlaka|xika|naka|meka|titek|iske|isce|monec|monek|oneki|oneci|otl|utl|pach')))
  - 20 * len(regexp_extract_all(t, '[bcdfgp][rl]|str|ntr')) >= 15) AS ok FROM t""")
def f36(spark, d):
    ok = sy.has_nahuatl_forms(F.col("text"), ["thering", "ation", "ouan", "eren"])
    return read(spark, d, "conversations").select("conv_id", "turn", ok.alias("ok"))


@query("u2_u3_u4_marker_sets", "m AS (SELECT media, list_distinct(list(lang)) AS langs FROM seg GROUP BY media) SELECT media, array_to_string(list_sort(list_intersect(langs, ['nah', 'may', 'xyz'])), ' ') AS both, len(list_distinct(list_concat(langs, ['xyz', 'spa']))) AS either FROM m")
def u2(spark, d):
    lit = lambda *xs: F.array(*map(F.lit, xs))
    m = segments(spark, d).groupBy("media").agg(F.collect_set("lang").alias("langs"))
    return m.select("media", F.array_join(F.array_sort(F.array_intersect("langs", lit("nah", "may", "xyz"))), " ").alias("both"), F.size(F.array_union("langs", lit("xyz", "spa"))).alias("either"))


@query("o2_o6_o8_orders_and_limits", "c AS (SELECT speaker, count(*) AS n FROM seg GROUP BY speaker ORDER BY n DESC, speaker LIMIT 1) SELECT media, pos, s FROM seg WHERE speaker = (SELECT speaker FROM c) ORDER BY s, e, pos LIMIT 20")
def o6(spark, d):
    rows = segments(spark, d)
    top = rows.groupBy("speaker").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "speaker").limit(1).select("speaker")
    return rows.join(top, "speaker", "left_semi").orderBy("s", "e", "pos").select("media", "pos", "s").limit(20)


@query("sql_surface", "x AS (SELECT 1) SELECT lang, count(*) AS n FROM turn GROUP BY lang")
def sql_surface(spark, d):
    from loomwork.plans.base import register_views

    register_views(spark, d)
    return spark.sql("SELECT lang, count(*) AS n FROM loomwork_turns GROUP BY lang")
