"""Queries over intervals and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import intervals as iv
from loomwork.operators import runs
from loomwork.plans.base import query, segments, transcripts, turns

BEST = """best AS (
  SELECT a.media, a.pos, t.pos AS best, least(a.e, t.e) - greatest(a.s, t.s) AS ov, a.s AS s,
         row_number() OVER (PARTITION BY a.media, a.pos ORDER BY {ratio} least(a.e, t.e) - greatest(a.s, t.s) DESC, t.s, t.pos) AS rk
  FROM asr a JOIN turn t ON a.media = t.media AND a.s < t.e AND t.s < a.e)
"""


@query("j3_best_overlap", BEST.format(ratio="") + "SELECT a.media, a.pos, b.best, b.ov FROM asr a LEFT JOIN best b ON a.media = b.media AND a.pos = b.pos AND rk = 1")
def j3(spark, d):
    return iv.best_overlap(transcripts(spark, d), turns(spark, d))


@query("j4_one_to_one", BEST.format(ratio="") + ", w AS (SELECT *, row_number() OVER (PARTITION BY media, best ORDER BY ov DESC, s, pos) AS r2 FROM best WHERE rk = 1) SELECT t.media, t.pos AS best, w.pos, w.ov FROM turn t LEFT JOIN w ON t.media = w.media AND t.pos = w.best AND r2 = 1")
def j4(spark, d):
    return iv.one_to_one(transcripts(spark, d), turns(spark, d))


@query("j4_unassigned_turns", BEST.format(ratio="") + ", w AS (SELECT * FROM best WHERE rk = 1) SELECT media, pos FROM turn t WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.media = t.media AND w.best = t.pos)")
def j4_unassigned(spark, d):
    return iv.one_to_one(transcripts(spark, d), turns(spark, d)).where("pos IS NULL").select("media", F.col("best").alias("pos"))


def _pairs(spark, d):
    p = iv.overlap_join(transcripts(spark, d).select("media", "pos", "s", "e"), turns(spark, d).select("media", "pos", "s", "e"))
    return p.withColumn("score", F.col("ov") / F.greatest(F.col("l_e") - F.col("l_s"), F.col("r_e") - F.col("r_s"), F.lit(1)))


@query("j5_greedy_annotations")
def j5(spark, d):
    return iv.greedy_pairs(_pairs(spark, d), ["media"], 0.25)


@query("j6_speaker_mapping")
def j6(spark, d):
    a = transcripts(spark, d).select("media", F.col("speaker").alias("pos"), "s", "e")
    b = turns(spark, d).select("media", F.col("speaker").alias("pos"), "s", "e")
    total = a.groupBy("media", F.col("pos").alias("l_pos")).agg(F.sum(F.col("e") - F.col("s")).alias("all"))
    sums = iv.overlap_join(a, b).groupBy("media", "l_pos", "r_pos").agg(F.sum("ov").alias("ov")).join(total, ["media", "l_pos"])
    return iv.greedy_pairs(sums.withColumn("score", F.col("ov") / F.greatest("all", F.lit(1))), ["media"], 0.05)


@query("j7_best_by_ratio", BEST.format(ratio="(least(a.e, t.e) - greatest(a.s, t.s))::DOUBLE / (a.e - a.s) DESC,") + "SELECT a.media, a.pos, b.best, b.ov FROM asr a LEFT JOIN best b ON a.media = b.media AND a.pos = b.pos AND rk = 1")
def j7(spark, d):
    return iv.best_overlap(transcripts(spark, d), turns(spark, d), ratio_of="l")


@query("j8_fixture_prediction", BEST.format(ratio="") + "SELECT a.media, a.pos, coalesce(t.lang, 'NONE') AS pred, a.lang FROM asr a LEFT JOIN best b ON a.media = b.media AND a.pos = b.pos AND rk = 1 LEFT JOIN turn t ON t.pos = b.best")
def j8(spark, d):
    best = iv.best_overlap(transcripts(spark, d), turns(spark, d), keep=["lang"])
    names = turns(spark, d).select(F.col("pos").alias("best"), F.col("lang").alias("pred"))
    return best.join(names, "best", "left").select("media", "pos", F.coalesce("pred", F.lit("NONE")).alias("pred"), "lang")


@query("j9_without_overlaps", "x AS (SELECT 1) SELECT media, pos, s, e FROM asr a WHERE NOT EXISTS (SELECT 1 FROM turn t WHERE t.media = a.media AND a.s < t.e AND a.e > t.s)")
def j9(spark, d):
    return iv.without_overlaps(transcripts(spark, d), turns(spark, d)).select("media", "pos", "s", "e")


@query("j10_consume_once")
def j10(spark, d):
    return iv.consume_once(turns(spark, d), transcripts(spark, d), 0.3)


@query("j11_points_in_segments", "x AS (SELECT 1) SELECT a.media, a.pos, t.pos AS span FROM asr a JOIN turn t ON a.media = t.media AND (a.s + a.e) // 2 BETWEEN t.s AND t.e")
def j11(spark, d):
    mid = F.expr("(s + e) div 2").alias("t")
    return iv.points_in(transcripts(spark, d).select("media", "pos", mid), turns(spark, d))


@query("j12_nearest_midpoint", """p AS (
  SELECT a.media, a.pos, t.pos AS near, abs((a.s + a.e) // 2 - (t.s + t.e) // 2) AS dist FROM asr a JOIN turn t ON a.media = t.media AND abs((a.s + a.e) // 2 - (t.s + t.e) // 2) < 60000),
r AS (SELECT *, row_number() OVER (PARTITION BY media, pos ORDER BY dist, near) AS rk FROM p)
SELECT a.media, a.pos, r.near, r.dist FROM asr a LEFT JOIN r ON a.media = r.media AND a.pos = r.pos AND rk = 1""")
def j12(spark, d):
    mid = F.expr("(s + e) div 2").alias("t")
    return iv.nearest(transcripts(spark, d).select("media", "pos", mid), turns(spark, d).select("media", "pos", mid), 60_000)


@query("j13_attach_by_start", "last_text AS (SELECT media, s // 1000 AS k, arg_max(pos, pos) AS text_pos FROM asr GROUP BY ALL) SELECT t.media, t.pos, l.text_pos FROM turn t LEFT JOIN last_text l ON l.media = t.media AND l.k = t.s // 1000")
def j13(spark, d):
    last = transcripts(spark, d).groupBy("media", F.expr("s div 1000").alias("k")).agg(F.max("pos").alias("text_pos"))
    return turns(spark, d).select("media", "pos", F.expr("s div 1000").alias("k")).join(last, ["media", "k"], "left").select("media", "pos", "text_pos")


@query("j14_within_tolerance", "x AS (SELECT 1) SELECT t.media, t.pos, min(a.pos) AS other FROM turn t JOIN asr a ON a.media = t.media AND abs(a.s - t.s) < 20000 GROUP BY ALL")
def j14(spark, d):
    return iv.within(turns(spark, d).select("media", "pos", F.col("s").alias("t")), transcripts(spark, d).select("media", "pos", F.col("s").alias("t")), 20_000)


@query("j18_speaker_overlaps", "x AS (SELECT 1) SELECT a.media, a.pos AS a, b.pos AS b, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM turn a JOIN turn b ON a.media = b.media AND a.pos < b.pos AND a.speaker <> b.speaker AND a.s < b.e AND b.s < a.e AND least(a.e, b.e) - greatest(a.s, b.s) >= 200")
def j18(spark, d):
    return iv.speaker_overlaps(turns(spark, d), 200)


@query("j23_refined_turns", "h AS (SELECT t.media, t.pos, min(a.s) AS fs, max(a.e) AS le FROM turn t JOIN asr a ON a.media = t.media AND t.s < a.e AND a.s < t.e GROUP BY ALL) SELECT t.media, t.pos, coalesce(greatest(t.s, fs - 100), t.s) AS s, coalesce(least(t.e, le + 100), t.e) AS e FROM turn t LEFT JOIN h ON h.media = t.media AND h.pos = t.pos")
def j23(spark, d):
    return iv.refined(turns(spark, d), transcripts(spark, d), 100)


def _day(spark, d):
    rows = segments(spark, d).select("media", "pos", (F.col("s") % 86_400_000).alias("s"), (F.col("s") % 86_400_000 + F.col("e") - F.col("s")).alias("e"))
    return rows, rows.select("media").distinct().select("media", F.lit(86_400_000).cast("long").alias("dur"))


DAYS = "t AS (SELECT media, pos, s % 86400000 AS s, s % 86400000 + e - s AS e FROM seg), "


@query("w11_gaps", DAYS + """c AS (SELECT media, coalesce(max(e) OVER (PARTITION BY media ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gs, s AS ge FROM t
  UNION ALL SELECT media, max(e), 86400000 FROM t GROUP BY media)
SELECT media, gs, ge FROM c WHERE ge > gs AND ge - gs >= 300000""")
def w11(spark, d):
    return iv.gaps(*_day(spark, d), 300_000)


@query("w11_gaps_after_previous", DAYS + """o AS (SELECT *, lag(e) OVER (PARTITION BY media ORDER BY s, e) AS b, row_number() OVER (PARTITION BY media ORDER BY s DESC, e DESC) AS k FROM t)
SELECT media, 0 AS gs, s AS ge FROM o WHERE b IS NULL AND s > 300000 UNION ALL SELECT media, b, s FROM o WHERE s - b >= 300000 UNION ALL SELECT media, e, 86400000 FROM o WHERE k = 1 AND 86400000 - e >= 300000""")
def w11_lag(spark, d):
    return iv.gaps_after_previous(*_day(spark, d), 300_000)


RUNS = """tg AS (SELECT *, CASE WHEN lang = 'other' THEN NULL ELSE lang END AS tag FROM seg),
cf AS (SELECT *, coalesce(last_value(tag IGNORE NULLS) OVER (PARTITION BY media ORDER BY s, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'other') AS lg FROM tg),
ch AS (SELECT *, CASE WHEN lg IS DISTINCT FROM lag(lg) OVER (PARTITION BY media ORDER BY s, pos) THEN 1 ELSE 0 END AS c FROM cf),
rn AS (SELECT *, sum(c) OVER (PARTITION BY media ORDER BY s, pos ROWS UNBOUNDED PRECEDING) AS run FROM ch),
r AS (SELECT media, run, any_value(lg) AS lang, min(s) AS s, max(e) AS e, count(*) AS n, round(sum(conf), 6) AS confidence FROM rn GROUP BY media, run)
"""


def _runs(spark, d):
    rows = segments(spark, d).withColumn("tag", F.when(F.col("lang") != "other", F.col("lang")))
    return runs.carried_runs(rows.drop("lang", "n"), "tag", "conf").withColumn("confidence", F.round("confidence", 6))


@query("w2_carried_runs", RUNS + "SELECT media, run::BIGINT AS run, lang, s, e, n, confidence FROM r")
def w2(spark, d):
    return _runs(spark, d)


@query("w3_merge_adjacent", """c AS (SELECT *, CASE WHEN lang IS DISTINCT FROM lag(lang) OVER w OR speaker IS DISTINCT FROM lag(speaker) OVER w THEN 1 ELSE 0 END AS c FROM seg WINDOW w AS (PARTITION BY media ORDER BY s, pos)),
g AS (SELECT *, sum(c) OVER (PARTITION BY media ORDER BY s, pos ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT media, run::BIGINT AS run, any_value(lang) AS lang, any_value(speaker) AS speaker, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY media, run""")
def w3(spark, d):
    return runs.merged(segments(spark, d).drop("n"), ["lang", "speaker"])


def _as_runs(spark, d):
    return _runs(spark, d).withColumnRenamed("run", "pos").withColumnRenamed("confidence", "conf")


@query("w4_merge_short")
def w4(spark, d):
    return runs.folded(_as_runs(spark, d), runs.merge_short(3), "media long, lang string, s long, e long, n long")


@query("w6_absorb_islands")
def w6(spark, d):
    return runs.folded(_as_runs(spark, d), runs.absorb_islands({"nah": 10, "may": 8, "spa": 1, "eng": 1}), "media long, lang string, s long, e long, n long")


@query("w7_threshold_demotion", """m AS (SELECT *, CASE WHEN conf <= 0.1 THEN 'other' ELSE lang END AS l2, CASE WHEN conf <= 0.1 THEN 0 ELSE conf END AS c2 FROM seg),
ch AS (SELECT *, CASE WHEN l2 IS DISTINCT FROM lag(l2) OVER (PARTITION BY media ORDER BY s, pos) THEN 1 ELSE 0 END AS c FROM m),
g AS (SELECT *, sum(c) OVER (PARTITION BY media ORDER BY s, pos ROWS UNBOUNDED PRECEDING) AS run FROM ch)
SELECT media, run::BIGINT AS run, any_value(l2) AS lang, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY media, run""")
def w7(spark, d):
    rows = segments(spark, d).withColumn("lang", F.when(F.col("conf") <= 0.1, "other").otherwise(F.col("lang"))).drop("n")
    return runs.merged(rows, ["lang"])


@query("w8_ejective_guard", "x AS (SELECT 1) SELECT media, pos, CASE WHEN lang = 'may' AND pos % 3 <> 0 THEN 'other' ELSE lang END AS lang FROM seg")
def w8(spark, d):
    phones = F.when(F.col("pos") % 3 == 0, F.array(F.lit("kʼ"), F.lit("a"))).otherwise(F.array(F.lit("k"), F.lit("a")))
    no_mark = ~F.exists(F.col("phones"), lambda p: F.contains(p, F.lit("ʼ")))
    return segments(spark, d).withColumn("phones", phones).select("media", "pos", F.when((F.col("lang") == "may") & no_mark, "other").otherwise(F.col("lang")).alias("lang"))


@query("w9_file_consolidation", """t AS (SELECT media, lang, sum(n) AS w FROM seg WHERE lang <> 'other' GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY media ORDER BY w DESC, lang) AS rk, sum(w) OVER (PARTITION BY media) AS total FROM t),
b AS (SELECT a.media, a.lang AS main FROM k a LEFT JOIN k c ON c.media = a.media AND c.rk = 2 WHERE a.rk = 1 AND a.total >= 100 AND a.w >= 1.25 * coalesce(c.w, 0))
SELECT s.media, s.pos, CASE WHEN main IS NOT NULL AND lang NOT IN ('eng', 'lat') AND conf < 0.2 THEN main ELSE lang END AS lang FROM seg s LEFT JOIN b ON b.media = s.media""")
def w9(spark, d):
    from pyspark.sql import Window

    rows = segments(spark, d)
    totals = rows.where("lang <> 'other'").groupBy("media", "lang").agg(F.sum("n").alias("w"))
    order = Window.partitionBy("media").orderBy(F.col("w").desc(), "lang")
    ranked = totals.withColumn("rk", F.row_number().over(order)).withColumn("second", F.coalesce(F.lead("w").over(order), F.lit(0))).withColumn("total", F.sum("w").over(Window.partitionBy("media")))
    main = ranked.where("rk = 1 AND total >= 100 AND w >= 1.25D * second").select("media", F.col("lang").alias("main"))
    take = F.col("main").isNotNull() & ~F.col("lang").isin("eng", "lat") & (F.col("conf") < 0.2)
    return rows.join(main, "media", "left").select("media", "pos", F.when(take, F.col("main")).otherwise(F.col("lang")).alias("lang"))


@query("w10_sandwich", "l AS (SELECT media, pos, s, e, lang, lag(lang) OVER w AS a, lead(lang) OVER w AS b FROM seg WINDOW w AS (PARTITION BY media ORDER BY s, pos)) SELECT media, pos, CASE WHEN lang = 'other' AND a = 'nah' AND b = 'nah' AND e - s <= 60000 THEN 'nah' ELSE lang END AS lang FROM l")
def w10(spark, d):
    return runs.sandwiched(segments(spark, d), "nah", "other", 60_000).select("media", "pos", "lang")


@query("w12_inline_prior", """c AS (SELECT *, count(*) OVER w AS k, count(*) FILTER (WHERE lang = 'spa') OVER w AS sp, count(*) FILTER (WHERE lang = 'nah') OVER w AS na
  FROM (SELECT *, pos % 3 AS grp FROM seg) WINDOW w AS (PARTITION BY media, speaker, event_type IN ('click'), grp ORDER BY s, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT media, pos, CASE WHEN k >= 3 AND sp / k >= 0.7 THEN 'spa' WHEN k >= 3 AND na / k >= 0.7 THEN 'nah' END AS prior FROM c""")
def w12(spark, d):
    rows = segments(spark, d).withColumn("grp", F.col("pos") % 3).withColumn("is_click", F.col("event_type") == "click")
    return runs.prior_at_row(rows, ("media", "speaker", "is_click", "grp"), ("s", "pos"), ("spa", "nah")).select("media", "pos", "prior")


@query("w13_collapse", "l AS (SELECT media, pos, lang, lag(lang) OVER (PARTITION BY media ORDER BY s, pos) AS p FROM seg) SELECT media, pos, lang FROM l WHERE lang IS DISTINCT FROM p AND lang <> 'other'")
def w13(spark, d):
    return runs.collapsed(segments(spark, d), "lang", "other").select("media", "pos", "lang")


@query("w14_symbol_spans", """ch AS (SELECT *, CASE WHEN lang IS DISTINCT FROM lag(lang) OVER (PARTITION BY media ORDER BY s, pos) THEN 1 ELSE 0 END AS c FROM seg),
g AS (SELECT *, sum(c) OVER (PARTITION BY media ORDER BY s, pos ROWS UNBOUNDED PRECEDING) AS run FROM ch),
a AS (SELECT media, run, any_value(lang) AS lang, min(s) AS s, max(s) AS last, round(avg(conf), 9) AS conf FROM g GROUP BY media, run)
SELECT media, run::BIGINT AS run, lang, s, last, conf FROM a WHERE lang <> 'other'""")
def w14(spark, d):
    return runs.symbol_spans(segments(spark, d), "lang", "other", "conf").withColumn("conf", F.round("conf", 9))


@query("w15_transitions", "l AS (SELECT media, CASE WHEN conf < 0.05 THEN 0 WHEN conf < 0.15 THEN 1 ELSE 2 END AS st, s, pos FROM seg), p AS (SELECT media, st, lag(st) OVER (PARTITION BY media ORDER BY s, pos) AS b FROM l) SELECT media, count(*) FILTER (WHERE b IS NOT NULL AND b <> st) AS n_events FROM p GROUP BY media")
def w15(spark, d):
    return runs.transitions(segments(spark, d), F.when(F.col("conf") < 0.05, 0).when(F.col("conf") < 0.15, 1).otherwise(2))


@query("w16_event_runs", """ch AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY media ORDER BY s, pos) THEN 1 ELSE 0 END AS c FROM seg),
g AS (SELECT *, sum(c) OVER (PARTITION BY media ORDER BY s, pos ROWS UNBOUNDED PRECEDING) AS run FROM ch),
a AS (SELECT media, run, any_value(event_type) AS kind, min(s) AS s FROM g GROUP BY media, run)
SELECT media, kind, s, coalesce(lead(s) OVER (PARTITION BY media ORDER BY s, run), s + 10) AS e FROM a""")
def w16(spark, d):
    rows = runs.run_ids(segments(spark, d), F.col("event_type")).groupBy("media", "run").agg(F.first("event_type").alias("kind"), F.min("s").alias("s"))
    return runs.until_next(rows, 10, order=("s", "run")).select("media", "kind", "s", "e")


@query("w17_until_next", "x AS (SELECT 1) SELECT media, pos, s, coalesce(lead(s) OVER (PARTITION BY media ORDER BY s, pos), s + 30) AS e FROM seg")
def w17(spark, d):
    return runs.until_next(segments(spark, d).drop("e"), 30).select("media", "pos", "s", "e")


@query("w18_keep_confident")
def w18(spark, d):
    return runs.folded(segments(spark, d).select("media", "pos", "s", "e", "conf"), runs.keep_confident, "media long, pos long, s long, e long, conf double")


@query("w20_keep_apart")
def w20(spark, d):
    return runs.folded(segments(spark, d).select("media", "pos", "s"), runs.keep_apart(50_000), "media long, pos long, s long")


@query("w22_even_spread", "w AS (SELECT pos, s, e, unnest(['a', 'b', 'c'][1 : 1 + pos % 3]) AS part, generate_subscripts(['a', 'b', 'c'][1 : 1 + pos % 3], 1) - 1 AS i, 1 + pos % 3 AS k FROM turn) SELECT pos, i::INT AS i, part, round(s + i * ((e - s)::DOUBLE / k), 3) AS ps FROM w")
def w22(spark, d):
    parts = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (1 + F.col("pos") % 3).cast("int"))
    return runs.spread(turns(spark, d), parts, F.col("s"), F.col("e")).select("pos", "i", "part", F.round("ps", 3).alias("ps"))


@query("w23_synthetic_numbers", "k AS (SELECT *, CASE WHEN pos % 4 = 0 THEN NULL ELSE pos - 50 END AS cue FROM seg) SELECT media, pos, coalesce(cue, least(coalesce(min(cue) OVER (PARTITION BY media), 0), 0) - count(*) FILTER (WHERE cue IS NULL) OVER (PARTITION BY media ORDER BY s, pos ROWS UNBOUNDED PRECEDING)) AS number FROM k")
def w23(spark, d):
    rows = segments(spark, d).withColumn("cue", F.when(F.col("pos") % 4 != 0, F.col("pos") - 50))
    return runs.allocated(rows, "cue").select("media", "pos", "number")


@query("f41_overlap_lengths", "x AS (SELECT 1) SELECT t.media, count(*) AS n, sum(least(a.e, t.e) - greatest(a.s, t.s))::BIGINT AS ov FROM turn t JOIN asr a ON a.media = t.media AND a.s < t.e AND t.s < a.e GROUP BY t.media")
def f41(spark, d):
    return iv.overlap_join(turns(spark, d).select("media", "s", "e"), transcripts(spark, d).select("media", "s", "e")).groupBy("media").agg(F.count("*").alias("n"), F.sum("ov").alias("ov"))
