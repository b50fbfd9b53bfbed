"""Queries over speakers, evaluation, projections and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.operators import metrics as me
from loomwork.operators import speakers as sp
from loomwork.plans.base import EVENTS, millis, plain, predictions, query, read, segments, transcripts, truth, turns
from loomwork.streaming import live


def _rows(spark, d):
    return me.matched(truth(spark, d), predictions(spark, d))


@query("j1_truth_predictions", "x AS (SELECT 1) SELECT cue, gt, pred, dur FROM scored WHERE cue % 13 <> 0")
def j1(spark, d):
    return _rows(spark, d).where("found").select("cue", "gt", "pred", "dur")


@query("j2_unmatched", "x AS (SELECT 1) SELECT cue FROM scored WHERE cue % 13 = 0")
def j2(spark, d):
    return truth(spark, d).join(predictions(spark, d), "cue", "left_anti").select("cue")


@query("a1_confusion", "x AS (SELECT 1) SELECT gt, pred, count(*) AS n FROM scored GROUP BY ALL")
def a1(spark, d):
    return me.confusion(_rows(spark, d))


@query("a1_confusion_rollup", "x AS (SELECT 1) SELECT gt, pred, count(*) AS n FROM scored GROUP BY ROLLUP (gt, pred)")
def a1_rollup(spark, d):
    return _rows(spark, d).rollup("gt", "pred").agg(F.count("*").alias("n"))


LABELS = """l AS (SELECT gt AS label, (gt = pred)::INT AS tp, 0 AS fp, (gt <> pred)::INT AS fn FROM scored UNION ALL SELECT pred, 0, (gt <> pred)::INT, 0 FROM scored),
t AS (SELECT label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM l GROUP BY label),
pr AS (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM t) """


@query("a2_precision_recall", LABELS + "SELECT label, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / greatest(p + r, 0.001), 6) AS f1 FROM pr")
def a2(spark, d):
    r = me.by_label(_rows(spark, d))
    return r.select("label", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("a3_a4_accuracies", """x AS (SELECT 1) SELECT count(*) AS n, round(avg((gt = pred)::INT), 6) AS accuracy,
  round(avg((gt = pred)::INT) FILTER (WHERE gt <> 'unk' AND pred <> 'unk'), 6) AS accuracy_known, round(avg((gt = pred)::INT) FILTER (WHERE gt IN ('nah', 'spa')), 6) AS accuracy_two,
  round(sum(CASE WHEN gt = pred THEN dur ELSE 0 END) / sum(dur), 6) AS accuracy_time FROM scored""")
def a3(spark, d):
    r = me.accuracies(_rows(spark, d))
    return r.select("n", *(F.round(c, 6).alias(c) for c in r.columns if c != "n"))


COST = """CASE WHEN gt = pred THEN 0.0 WHEN gt = 'unk' THEN 0.0 WHEN gt IN ('nah', 'may') AND pred = 'spa' THEN 2.0 WHEN gt IN ('nah', 'may') AND pred = 'oth' THEN 1.5
  WHEN pred = 'unk' THEN 0.5 WHEN gt = 'spa' AND pred IN ('nah', 'may') THEN 1.5 ELSE 1.0 END"""


@query("a5_costs", f"c AS (SELECT *, ({COST})::DOUBLE AS cost FROM scored) SELECT round(sum(cost), 6) AS cost, (2.0 * count(*) FILTER (WHERE gt <> 'unk'))::DOUBLE AS most, round(1 - sum(cost) / (2.0 * count(*) FILTER (WHERE gt <> 'unk')), 6) AS score FROM c")
def a5(spark, d):
    return me.costs(_rows(spark, d)).select(F.round("cost", 6).alias("cost"), "most", F.round("score", 6).alias("score"))


@query("a5_o4_dearest_pairs", f"c AS (SELECT *, ({COST})::DOUBLE AS cost FROM scored WHERE gt <> pred) SELECT gt, pred, count(*) AS n, sum(cost) AS cost FROM c GROUP BY gt, pred ORDER BY cost DESC, gt, pred LIMIT 10")
def a5_pairs(spark, d):
    return me.dearest_pairs(_rows(spark, d))


@query("a6_binary_metrics", "x AS (SELECT 1) SELECT count(*) FILTER (WHERE gt = 'nah' AND pred = 'nah') AS tp, round(count(*) FILTER (WHERE gt = 'nah' AND pred = 'nah') / greatest(count(*) FILTER (WHERE pred = 'nah'), 1), 6) AS precision, round(count(*) FILTER (WHERE gt = 'nah' AND pred = 'nah') / greatest(count(*) FILTER (WHERE gt = 'nah'), 1), 6) AS recall FROM scored")
def a6(spark, d):
    is_gt, is_pred = F.col("gt") == "nah", F.col("pred") == "nah"
    tp = F.count_if(is_gt & is_pred)
    return _rows(spark, d).agg(tp.alias("tp"), F.round(tp / F.greatest(F.count_if(is_pred), F.lit(1)), 6).alias("precision"), F.round(tp / F.greatest(F.count_if(is_gt), F.lit(1)), 6).alias("recall"))


PRIMARY = """b AS (SELECT media, speaker, lang, {w} AS weight, count(*) AS n, min(s) AS s0, arg_min(pos, (s, pos)) AS p0 FROM seg WHERE {keep} GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY media, speaker ORDER BY weight DESC, s0, p0) AS rk, sum(weight) OVER (PARTITION BY media, speaker) AS total, sum(n) OVER (PARTITION BY media, speaker) AS rows_ FROM b) """


@query("a7_speaker_languages", PRIMARY.format(w="sum(n)", keep="lang <> 'other'").replace("sum(n) AS weight, count(*) AS n", "sum(seg.n) AS weight, count(*) AS n") + "SELECT media, speaker, lang AS primary, weight::BIGINT AS weight, total::BIGINT AS total, n, rows_::BIGINT AS rows FROM k WHERE rk = 1")
def a7(spark, d):
    return sp.primary_language(segments(spark, d), F.col("n"))


@query("a8_speaker_profiles", PRIMARY.format(w="count(*)", keep="lang <> 'other' AND conf >= 0.05") + "SELECT media, speaker, lang AS primary, n, rows_::BIGINT AS rows FROM k WHERE rk = 1")
def a8(spark, d):
    return sp.primary_language(segments(spark, d).where("conf >= 0.05"), F.lit(1)).select("media", "speaker", "primary", "n", "rows")


PRIOR = PRIMARY.format(w="count(*)", keep="lang NOT IN ('other', 'silence')") + ", p AS (SELECT media, speaker, lang AS main FROM k WHERE rk = 1 AND total >= 3 AND weight / total >= 0.3) "


@query("a9_speaker_prior", PRIOR + "SELECT s.media, s.pos, CASE WHEN main IS NOT NULL AND (lang = 'other' OR conf < 0.02) THEN main ELSE lang END AS lang FROM seg s LEFT JOIN p ON p.media = s.media AND p.speaker = s.speaker")
def a9(spark, d):
    return sp.with_prior(segments(spark, d), share=0.3, weak_below=0.02).select("media", "pos", "lang")


@query("a10_two_pass_evidence", "h AS (SELECT media, speaker, count(*) AS t, count(*) FILTER (WHERE n >= 8) AS h FROM seg GROUP BY ALL) SELECT s.media, s.pos, CASE WHEN t >= 5 AND h >= 3 AND h / t >= 0.15 AND lang = 'spa' AND conf < 0.7 THEN 'nah' ELSE lang END AS lang FROM seg s JOIN h ON h.media = s.media AND h.speaker = s.speaker")
def a10(spark, d):
    return sp.flipped_by_evidence(segments(spark, d), F.col("n") >= 8, "spa", "nah").select("media", "pos", "lang")


@query("a14_top_forms", "c AS (SELECT lang, speaker, count(*) AS n FROM seg GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, speaker) AS rk FROM c) SELECT lang, string_agg(speaker, ',' ORDER BY rk) AS forms FROM r WHERE rk <= 3 GROUP BY lang")
def a14(spark, d):
    c = segments(spark, d).groupBy("lang", "speaker").agg(F.count("*").alias("n"))
    top = c.withColumn("rk", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "speaker"))).where("rk <= 3")
    return top.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "speaker"))), lambda x: x["speaker"]), ",").alias("forms"))


WILSON = """w AS (SELECT {k}, n, h, h / n AS p, 3.8416::DOUBLE AS z FROM c),
ci AS (SELECT {k}, n, h, (p + z / (2 * n)) / (1 + z / n) AS mid, 1.96::DOUBLE / (1 + z / n) * sqrt(p * (1 - p) / n + z / (4 * n * n)) AS half FROM w)
SELECT {k}, n, h, round(greatest(0, mid - half), 6) AS low, round(least(1, mid + half), 6) AS high FROM ci"""


@query("a15_wilson_interval", "c AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE conf > 0.1) AS h FROM seg GROUP BY lang), " + WILSON.format(k="lang"))
def a15(spark, d):
    rows = segments(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("conf") > 0.1).alias("h"))
    low, high = me.wilson(F.col("h"), F.col("n"))
    return rows.select("lang", "n", "h", low.alias("low"), high.alias("high"))


@plain("a16_hallucination_rates", "WITH c AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = 0) AS h FROM documents JOIN labels USING (doc_id) GROUP BY lang), " + WILSON.format(k="lang"))
def a16(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("h"))
    low, high = me.wilson(F.col("h"), F.col("n"))
    return rows.select("lang", "n", "h", low.alias("low"), high.alias("high"))


@query("a17_dominant_label", "c AS (SELECT media, lang, count(*) AS n FROM seg GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY media) AS total, row_number() OVER (PARTITION BY media ORDER BY lang = 'other', n DESC, lang) AS rk FROM c) SELECT media, lang, round(n / total, 4) AS share FROM r WHERE rk = 1")
def a17(spark, d):
    c = segments(spark, d).groupBy("media", "lang").agg(F.count("*").alias("n"))
    w = Window.partitionBy("media")
    r = c.withColumn("total", F.sum("n").over(w)).withColumn("rk", F.row_number().over(w.orderBy(F.col("lang") == "other", F.col("n").desc(), "lang")))
    return r.where("rk = 1").select("media", "lang", F.round(F.col("n") / F.col("total"), 4).alias("share"))


@query("a18_speaking_shares", "t AS (SELECT media, speaker, sum(e - s) AS time FROM seg GROUP BY ALL) SELECT media, speaker, time::BIGINT AS time, round_even(100 * time / sum(time) OVER (PARTITION BY media), 0)::BIGINT AS percent, row_number() OVER (PARTITION BY media ORDER BY time DESC, speaker) AS rank FROM t")
def a18(spark, d):
    return sp.speaking_shares(segments(spark, d))


@plain("a19_language_distribution", "SELECT lang, count(*) AS n, count(*) FILTER (WHERE lang <> 'es' AND contains(text, ' de ')) AS looks_spanish FROM documents GROUP BY lang")
def a19(spark, d):
    return read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if((F.col("lang") != "es") & F.contains("text", F.lit(" de "))).alias("looks_spanish"))


TOKENS = "WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM benchmark), a AS (SELECT item_id // 2 AS k, token, count(*) AS na FROM t WHERE item_id % 2 = 0 GROUP BY ALL), b AS (SELECT item_id // 2 AS k, token, count(*) AS nb FROM t WHERE item_id % 2 = 1 GROUP BY ALL) "


@plain("a20_bag_agreement", TOKENS + "SELECT k, sum(least(coalesce(na, 0), coalesce(nb, 0)))::BIGINT AS same, sum(coalesce(na, 0))::BIGINT AS na, sum(coalesce(nb, 0))::BIGINT AS nb, round(2 * sum(least(coalesce(na, 0), coalesce(nb, 0))) / (sum(coalesce(na, 0)) + sum(coalesce(nb, 0))), 6) AS f1 FROM a FULL JOIN b USING (k, token) GROUP BY k")
def a20(spark, d):
    t = read(spark, d, "benchmark").select(F.expr("item_id div 2").alias("k"), (F.col("item_id") % 2).alias("side"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token"))
    return me.bag_f1(t.where("side = 0"), t.where("side = 1"), "k").withColumn("f1", F.round("f1", 6))


@plain("a21_positional_agreement", """WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
p AS (SELECT a.item_id // 2 AS k, a.w AS x, b.w AS y FROM t a JOIN t b ON a.item_id + 1 = b.item_id AND a.item_id % 2 = 0)
SELECT k, round(len(list_filter(list_zip(x, y, true), lambda z: z[1] = z[2])) / least(len(x), len(y)) * (least(len(x), len(y)) / greatest(len(x), len(y))), 6) AS agreement FROM p""")
def a21(spark, d):
    t = read(spark, d, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    p = t.where("item_id % 2 = 0").select((F.col("item_id") + 1).alias("j"), F.expr("item_id div 2").alias("k"), F.col("w").alias("x")).join(t.select(F.col("item_id").alias("j"), F.col("w").alias("y")), "j")
    return p.select("k", F.round(me.positional_agreement(F.col("x"), F.col("y")), 6).alias("agreement"))


@plain("a22_error_rates", """WITH p AS (SELECT role, regexp_replace(lower(text), '[^a-z]', '', 'g') AS h, regexp_replace(lower(text), '[^a-z]|the', '', 'g') AS r FROM conversations)
SELECT role, sum(levenshtein(h, r))::BIGINT AS edits, sum(length(r))::BIGINT AS size, round(sum(levenshtein(h, r)) / greatest(sum(length(r)), 1), 6) AS rate FROM p GROUP BY role""")
def a22(spark, d):
    rows = read(spark, d, "conversations").select("role", F.regexp_replace(F.lower("text"), "[^a-z]", "").alias("h"), F.regexp_replace(F.lower("text"), "[^a-z]|the", "").alias("r"))
    return me.error_rate(rows, F.levenshtein("h", "r"), F.char_length("r"), ["role"]).withColumn("rate", F.round("rate", 6))


@query("a23_run_statistics", "x AS (SELECT 1) SELECT media, lang, count(*) AS n, count(DISTINCT speaker) AS speakers, sum(e - s)::BIGINT AS time, round(avg(conf), 9) AS conf FROM seg GROUP BY ALL")
def a23(spark, d):
    return segments(spark, d).groupBy("media", "lang").agg(F.count("*").alias("n"), F.countDistinct("speaker").alias("speakers"), F.sum(F.col("e") - F.col("s")).alias("time"), F.round(F.avg("conf"), 9).alias("conf"))


@query("a24_separation", """a AS (SELECT avg(conf) FILTER (WHERE lang = 'nah') AS ma, stddev_pop(conf) FILTER (WHERE lang = 'nah') AS sa, quantile_cont(conf, 0.1) FILTER (WHERE lang = 'nah') AS la, quantile_cont(conf, 0.9) FILTER (WHERE lang = 'nah') AS ha,
  avg(conf) FILTER (WHERE lang = 'spa') AS mb, stddev_pop(conf) FILTER (WHERE lang = 'spa') AS sb, quantile_cont(conf, 0.1) FILTER (WHERE lang = 'spa') AS lb, quantile_cont(conf, 0.9) FILTER (WHERE lang = 'spa') AS hb FROM seg)
SELECT round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round((ma - mb) / sqrt((sa * sa + sb * sb) / 2), 6) AS d, round(greatest(0, least(ha, hb) - greatest(la, lb)), 6) AS common FROM a""")
def a24(spark, d):
    return me.separation(segments(spark, d), "conf", "lang", "nah", "spa").select(*(F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "d", "common")))


@query("a25_rhythm", "l AS (SELECT media, e - s AS x, lead(e - s) OVER (PARTITION BY media ORDER BY s, pos) AS y FROM seg) SELECT media, round(coalesce(100 * avg(abs(x - y) / ((x + y) / 2.0::DOUBLE)) FILTER (WHERE y IS NOT NULL AND x + y <> 0), 0), 6) AS npvi, round(coalesce(avg(abs(x - y)), 0), 6) AS rpvi FROM l GROUP BY media")
def a25(spark, d):
    r = me.pairwise_variability(segments(spark, d).withColumn("len", F.col("e") - F.col("s")), "len")
    return r.select("media", F.round("npvi", 6).alias("npvi"), F.round("rpvi", 6).alias("rpvi"))


@query("a26_marker_weights", "c AS (SELECT speaker, count(*) FILTER (WHERE lang = 'nah') AS own, count(*) FILTER (WHERE lang = 'spa') AS ref FROM seg GROUP BY speaker) SELECT speaker, round(CASE WHEN own + ref > 0 THEN greatest(own / (own + ref), 0.05) ELSE 0.05 END, 6) AS weight FROM c")
def a26(spark, d):
    c = segments(spark, d).groupBy("speaker").agg(F.count_if(F.col("lang") == "nah").alias("own"), F.count_if(F.col("lang") == "spa").alias("ref"))
    return c.select("speaker", F.round(me.marker_weight(F.col("own"), F.col("ref")), 6).alias("weight"))


@query("a28_episode_bounds", "x AS (SELECT 1) SELECT speaker, media, count(*) AS n, arg_min(lang, (s, pos)) AS first_lang, arg_max(lang, (s, pos)) AS last_lang, min(s) AS s, max(e) AS e FROM seg GROUP BY ALL")
def a28(spark, d):
    order = F.struct("s", "pos")
    return segments(spark, d).groupBy("speaker", "media").agg(F.count("*").alias("n"), F.min_by("lang", order).alias("first_lang"), F.max_by("lang", order).alias("last_lang"), F.min("s").alias("s"), F.max("e").alias("e"))


@query("a29_weighted_totals", "x AS (SELECT 1) SELECT lang, sum(n * CASE WHEN speaker = 'S0' THEN 3 ELSE 1 END)::BIGINT AS total FROM seg GROUP BY lang")
def a29(spark, d):
    shares = spark.createDataFrame([("S0", 3), ("S1", 1), ("S2", 1), ("S3", 1)], "speaker string, share int")
    return segments(spark, d).join(F.broadcast(shares), "speaker").groupBy("lang").agg(F.sum(F.col("n") * F.col("share")).alias("total"))


@query("a30_overlap_report", "f AS (SELECT t.media, t.pos, t.lang, max((a.pos IS NOT NULL)::INT) AS hit FROM turn t LEFT JOIN asr a ON a.media = t.media AND a.s < t.e AND t.s < a.e GROUP BY ALL) SELECT lang, hit, count(*) AS n FROM f GROUP BY ALL")
def a30(spark, d):
    from loomwork.operators.intervals import overlap_join

    hit = overlap_join(turns(spark, d).select("media", "pos", "s", "e"), transcripts(spark, d).select("media", "s", "e")).select("media", F.col("l_pos").alias("pos"), F.lit(1).alias("hit")).distinct()
    return turns(spark, d).select("media", "pos", "lang").join(hit, ["media", "pos"], "left").groupBy("lang", F.coalesce("hit", F.lit(0)).alias("hit")).agg(F.count("*").alias("n"))


@query("a31_annotation_stats", "x AS (SELECT 1) SELECT count(*) AS total, count(*) FILTER (WHERE gt = pred) AS agreed, count(*) FILTER (WHERE pred = 'unk') AS unknown, count(DISTINCT gt) AS labels, sum(dur)::BIGINT AS time FROM scored")
def a31(spark, d):
    return _rows(spark, d).agg(F.count("*").alias("total"), F.count_if(F.col("gt") == F.col("pred")).alias("agreed"), F.count_if(F.col("pred") == "unk").alias("unknown"), F.countDistinct("gt").alias("labels"), F.sum("dur").alias("time"))


@query("a32_pass_rates", "x AS (SELECT 1) SELECT gt, count(*) AS n, count(*) FILTER (WHERE gt = pred) AS passed, round(count(*) FILTER (WHERE gt = pred) / count(*), 4) AS rate FROM scored GROUP BY gt")
def a32(spark, d):
    passed = F.count_if(F.col("gt") == F.col("pred"))
    return _rows(spark, d).groupBy("gt").agg(F.count("*").alias("n"), passed.alias("passed"), F.round(passed / F.count("*"), 4).alias("rate"))


@query("a34_hash_split")
def a34(spark, d):
    k = F.pmod(F.xxhash64("media"), F.lit(10))
    return segments(spark, d).select("media", "pos", F.when(k < 8, "train").when(k == 8, "dev").otherwise("test").alias("split")).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("media").alias("recordings"))


@query("a35_config_sweep", "v AS (SELECT unnest([0.02, 0.05, 0.1, 0.2]) AS thr) SELECT thr::DOUBLE AS thr, count(*) FILTER (WHERE (conf > thr) = (lang = 'nah')) AS right_, round(count(*) FILTER (WHERE (conf > thr) = (lang = 'nah')) / count(*), 6) AS accuracy FROM seg, v GROUP BY thr")
def a35(spark, d):
    rows = segments(spark, d).withColumn("thr", F.explode(F.array(*(F.lit(x) for x in (0.02, 0.05, 0.1, 0.2)))))
    right = F.count_if((F.col("conf") > F.col("thr")) == (F.col("lang") == "nah"))
    return rows.groupBy("thr").agg(right.alias("right_"), F.round(right / F.count("*"), 6).alias("accuracy"))


@query("a37_scope_inference", "s AS (SELECT speaker, count(DISTINCT media % 2) AS k, min(media % 2) AS one FROM seg GROUP BY speaker) SELECT speaker, CASE WHEN k = 1 THEN 'season' || one ELSE 'global' END AS scope FROM s")
def a37(spark, d):
    s = segments(spark, d).groupBy("speaker").agg(F.countDistinct(F.col("media") % 2).alias("k"), F.min(F.col("media") % 2).alias("one"))
    return s.select("speaker", F.when(F.col("k") == 1, F.concat(F.lit("season"), F.col("one").cast("string"))).otherwise("global").alias("scope"))


@query("a38_merged_corpora", "u AS (SELECT 'turn' AS source, media % 3 AS split, e - s AS t FROM turn UNION ALL SELECT 'asr', media % 3, e - s FROM asr) SELECT split, source, count(*) AS n, round(sum(t) / 3600000, 6) AS hours FROM u GROUP BY ALL")
def a38(spark, d):
    u = turns(spark, d).withColumn("source", F.lit("turn")).unionByName(transcripts(spark, d).withColumn("source", F.lit("asr")))
    return u.groupBy((F.col("media") % 3).alias("split"), "source").agg(F.count("*").alias("n"), F.round(F.sum(F.col("e") - F.col("s")) / 3600000, 6).alias("hours"))


@query("j19_display_names", "x AS (SELECT 1) SELECT s.pos, coalesce(CASE WHEN s.speaker = 'S1' THEN 'Ana' END, CASE WHEN s.speaker IN ('S1', 'S2') THEN 'hero' || s.speaker END, s.speaker) AS name FROM seg s")
def j19(spark, d):
    slugs = spark.createDataFrame([("S1", "heroS1"), ("S2", "heroS2")], "speaker string, slug string")
    names = spark.createDataFrame([("heroS1", "Ana")], "slug string, display string")
    return segments(spark, d).join(F.broadcast(slugs), "speaker", "left").join(F.broadcast(names), "slug", "left").select("pos", F.coalesce("display", "slug", "speaker").alias("name"))


@query("j20_compared_reports", "a AS (SELECT cue, gt = pred AS ok FROM scored WHERE cue % 5 <> 0), b AS (SELECT cue, gt = pred OR cue % 7 = 0 AS ok FROM scored WHERE cue % 6 <> 0) SELECT cue, CASE WHEN a.ok IS NULL THEN 'new' WHEN b.ok IS NULL THEN 'removed' WHEN a.ok AND NOT b.ok THEN 'regression' WHEN NOT a.ok AND b.ok THEN 'improvement' ELSE 'unchanged' END AS change FROM a FULL JOIN b USING (cue)")
def j20(spark, d):
    rows = _rows(spark, d).withColumn("ok", F.col("gt") == F.col("pred"))
    return me.compared(rows.where("cue % 5 <> 0"), rows.where("cue % 6 <> 0").withColumn("ok", F.col("ok") | (F.col("cue") % 7 == 0)), "cue", "ok")


@query("c8_speaker_smoothing")
def c8(spark, d):
    return sp.smoothed(segments(spark, d))


@query("c9_speaker_inheritance", PRIMARY.format(w="count(*)", keep="lang <> 'other'") + ", p AS (SELECT media, speaker, lang AS main FROM k WHERE rk = 1 AND rows_ >= 5 AND n / rows_ >= 0.4) SELECT s.media, s.pos, CASE WHEN main IS NOT NULL AND event_type <> 'click' AND (lang = 'other' OR e - s < 1000) AND lang NOT IN ('may', 'lat') THEN main ELSE lang END AS lang FROM seg s LEFT JOIN p ON p.media = s.media AND p.speaker = s.speaker")
def c9(spark, d):
    rows = segments(spark, d).withColumn("backend", F.when(F.col("event_type") == "click", "whisper").otherwise("allo"))
    return sp.inherited(rows, sp.primary_language(rows, F.lit(1)), share=0.4).select("media", "pos", "lang")


@query("o1_o3_natural_order", "x AS (SELECT 1) SELECT pos, row_number() OVER (ORDER BY CASE WHEN speaker = 'S3' THEN 10000 ELSE substr(speaker, 2)::INT END, s, pos) AS rank FROM seg WHERE media = (SELECT min(media) FROM seg)")
def o3(spark, d):
    rows = o3_all(spark, d)
    return rows.join(rows.agg(F.min("media").alias("media")), "media").select("pos", "rank")


@query("o1_o3_natural_order_all")
def o3_all(spark, d):
    number = F.when(F.col("speaker") != "S3", F.regexp_extract("speaker", "(\\d+)", 1).cast("int"))
    return segments(spark, d).select("media", "pos", F.row_number().over(Window.partitionBy("media").orderBy(F.coalesce(number, F.lit(10000)), "s", "pos")).alias("rank"))


@query("o5_most_common", "x AS (SELECT 1) SELECT speaker, lang, count(*) AS n FROM seg GROUP BY ALL ORDER BY n DESC, speaker, lang LIMIT 6")
def o5(spark, d):
    return segments(spark, d).groupBy("speaker", "lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "speaker", "lang").limit(6)


@query("o7_best_candidate", "c AS (SELECT media, speaker, pos, 0.55 * (n / 9.0::DOUBLE) + 0.45 * conf AS score FROM seg) SELECT media, speaker, arg_max(pos, (score, -pos)) AS pos FROM c GROUP BY ALL")
def o7(spark, d):
    rows = segments(spark, d).withColumn("score", 0.55 * (F.col("n") / 9.0) + 0.45 * F.col("conf"))
    return rows.groupBy("media", "speaker").agg(F.max_by("pos", F.struct("score", -F.col("pos"))).alias("pos"))


@query("u1_key_sets", "a AS (SELECT cue FROM scored WHERE cue % 2 = 0), b AS (SELECT cue FROM scored WHERE cue % 3 = 0) SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def u1(spark, d):
    rows = truth(spark, d).select("cue")
    a, b = rows.where("cue % 2 = 0"), rows.where("cue % 3 = 0")
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "only"))


@plain("u5_letter_jaccard", """WITH p AS (SELECT a.item_id AS k, list_distinct(string_split(regexp_replace(lower(a.text), '[^a-z]', '', 'g'), '')) AS x, list_distinct(string_split(regexp_replace(lower(b.text), '[^a-z]', '', 'g'), '')) AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)
SELECT k, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS j FROM p""")
def u5(spark, d):
    t = read(spark, d, "benchmark").select("item_id", F.array_distinct(F.split(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "")).alias("x"))
    p = t.join(t.select((F.col("item_id") - 1).alias("item_id"), F.col("x").alias("y")), "item_id")
    return p.select(F.col("item_id").alias("k"), F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 6).alias("j"))


@query("u6_vocabulary", "x AS (SELECT 1) SELECT media, string_agg(DISTINCT speaker || lang, ' ' ORDER BY speaker || lang) AS vocabulary FROM seg GROUP BY media")
def u6(spark, d):
    return segments(spark, d).groupBy("media").agg(F.array_join(F.array_sort(F.collect_set(F.concat("speaker", "lang"))), " ").alias("vocabulary"))


@plain("s19_relational_scan", "SELECT o_orderpriority, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY ALL")
def s19(spark, d):
    orders = read(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderpriority", "o_totalprice")
    joined = orders.join(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("o_orderpriority", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@plain("st1_tumbling_windows", "SELECT (epoch_us(ts) // 1000) // 300000 AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st1(spark, d):
    events = live.event_stream(spark, f"{d}/events.parquet", EVENTS)
    counts = events.groupBy(F.floor(millis("ts") / 300000).alias("bucket"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return live.collected(counts, live.checkpoint_folder(spark), "complete")


@plain("st5_new_speakers", "SELECT user_id, min(event_id) AS first_event FROM events GROUP BY user_id")
def st5(spark, d):
    events = live.event_stream(spark, f"{d}/events.parquet", EVENTS)
    return live.collected(events.groupBy("user_id").agg(F.min("event_id").alias("first_event")), live.checkpoint_folder(spark), "complete")


@query("st7_decode_windows", "v AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS k) SELECT pos, k, s + 100 * (k - 3) AS s, e + 50 * (k % 2) AS e FROM turn, v")
def st7(spark, d):
    rows = turns(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return rows.select("pos", "k", (F.col("s") + 100 * (F.col("k") - 3)).alias("s"), (F.col("e") + 50 * (F.col("k") % 2)).alias("e"))
