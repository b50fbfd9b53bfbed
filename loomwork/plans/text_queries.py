"""Queries over symbols, dictionaries and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import symbols as sy
from loomwork.functions import text as tx
from loomwork.operators import lexicon as lx
from loomwork.operators import scoring as sc
from loomwork.plans.base import plain, query, read, segments

#: Markers over letters, so that plain texts can stand in for phoneme streams.
PROFILES = {
    "nah": {"priority": 10, "threshold": 0.5, "markers": {"t l": 1.0, "t z": 0.8, "h u": 0.6, "t h e": 0.9, "w": 0.3}},
    "spa": {"priority": 1, "threshold": 2.25, "markers": {"b": 0.2, "d": 0.05, "o s": 0.5, "e s": 0.4, "c i o": 0.9, "n": 0.1}},
    "eng": {"priority": 1, "threshold": 1.0, "markers": {"t h": 0.7, "i n g": 1.2, "w h": 0.5, "h": 0.1}},
}
LEXICON = ["koali", "tlein", "ken", "amo", "kena", "nikan", "axkan", "teotl", "atl", "calli", "thering", "ouand"]


def letters(spark, d) -> DataFrame:
    t = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return read(spark, d, "benchmark").select(F.col("item_id").alias("media"), F.posexplode(F.split(t, "")).alias("pos", "phoneme"))


MARKERS = ", ".join(f"('{lang}', {len(g.split())}, '{g}', {w}::DOUBLE)" for lang, p in sorted(PROFILES.items()) for g, w in sorted(p["markers"].items()))
LETTERS = f"""WITH t AS (SELECT item_id AS media, regexp_replace(lower(text), '[^a-z]', '', 'g') AS x FROM benchmark),
ph AS (SELECT media, (unnest(range(length(x))))::INT AS pos, unnest(string_split(x, '')) AS phoneme FROM t),
mk(lang, n, gram, weight) AS (VALUES {MARKERS}),
pf(lang, priority, threshold) AS (VALUES {", ".join(f"('{k}', {p['priority']}, {p['threshold']}::DOUBLE)" for k, p in sorted(PROFILES.items()))}),
g AS (SELECT media, pos, phoneme AS g1, phoneme || ' ' || lead(phoneme) OVER w AS g2, phoneme || ' ' || lead(phoneme) OVER w || ' ' || lead(phoneme, 2) OVER w AS g3 FROM ph WINDOW w AS (PARTITION BY media ORDER BY pos)),
h3 AS (SELECT media, pos + k AS pos, lang, sum(weight / 3) AS score FROM g JOIN mk ON n = 3 AND gram = g3, (SELECT unnest([0, 1, 2]) AS k) GROUP BY ALL),
h2 AS (SELECT media, pos + k AS pos, lang, sum(weight / 2) AS score FROM g JOIN mk ON n = 2 AND gram = g2, (SELECT unnest([0, 1]) AS k) GROUP BY ALL),
b2 AS (SELECT * FROM h2 WHERE NOT EXISTS (SELECT 1 FROM h3 WHERE h3.media = h2.media AND h3.pos = h2.pos AND h3.lang = h2.lang)),
h1 AS (SELECT media, pos, lang, weight AS score FROM g JOIN mk ON n = 1 AND gram = g1),
b1 AS (SELECT * FROM h1 WHERE NOT EXISTS (SELECT 1 FROM h3 WHERE h3.media = h1.media AND h3.pos = h1.pos AND h3.lang = h1.lang) AND NOT EXISTS (SELECT 1 FROM h2 WHERE h2.media = h1.media AND h2.pos = h1.pos AND h2.lang = h1.lang)),
hits AS (SELECT * FROM h3 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b1),
tg AS (SELECT media, pos, arg_max(lang, (round(score, 9), priority, lang)) AS tag, max(round(score, 9)) AS score FROM hits JOIN pf USING (lang) WHERE score > 0 GROUP BY media, pos),
tagged AS (SELECT ph.media, ph.pos, phoneme, tag, score FROM ph LEFT JOIN tg ON tg.media = ph.media AND tg.pos = ph.pos),
bags AS (SELECT media, lang, sum(score) AS score FROM hits GROUP BY ALL)
"""


def _tagged(spark, d):
    return sc.tagged(letters(spark, d), sc.marker_table(spark, PROFILES), sc.profile_table(spark, PROFILES))


@plain("w1_position_scores", LETTERS + "SELECT media, pos, tag, round(score, 6) AS score FROM tagged")
def w1(spark, d):
    return _tagged(spark, d).select("media", "pos", "tag", F.round("score", 6).alias("score"))


@plain("w1_w2_language_runs", LETTERS + """, cf AS (SELECT *, coalesce(last_value(tag IGNORE NULLS) OVER (PARTITION BY media ORDER BY pos ROWS UNBOUNDED PRECEDING), 'other') AS lg FROM tagged),
ch AS (SELECT *, CASE WHEN lg IS DISTINCT FROM lag(lg) OVER (PARTITION BY media ORDER BY pos) THEN 1 ELSE 0 END AS c FROM cf),
rn AS (SELECT *, sum(c) OVER (PARTITION BY media ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM ch)
SELECT media, run::BIGINT AS run, any_value(lg) AS lang, min(pos) AS s, max(pos) + 1 AS e, count(*) AS n, round(sum(score), 4) AS confidence FROM rn GROUP BY media, run""")
def w1_runs(spark, d):
    from loomwork.operators.runs import carried_runs

    rows = _tagged(spark, d).withColumn("s", F.col("pos")).withColumn("e", F.col("pos") + 1)
    return carried_runs(rows).withColumn("confidence", F.round("confidence", 4))


@plain("w5_f5_best_language", LETTERS + "SELECT media, arg_max(lang, (round(score, 6), priority, lang)) AS lang, round(max(score), 6) AS score FROM bags JOIN pf USING (lang) WHERE score > threshold GROUP BY media")
def w5(spark, d):
    return sc.best_bag(sc.bag_scores(letters(spark, d), sc.marker_table(spark, PROFILES), sc.profile_table(spark, PROFILES)), digits=6)


@plain("f4_scores_with_negatives", LETTERS + ", ng AS (SELECT media, 'spa' AS lang, -0.05 * count(*) AS score FROM ph WHERE phoneme IN ('w', 'k') GROUP BY media), u AS (SELECT * FROM bags UNION ALL SELECT * FROM ng) SELECT media, lang, round(sum(score), 6) AS score FROM u GROUP BY ALL")
def f4(spark, d):
    negatives = spark.createDataFrame([("spa", "w", 0.05), ("spa", "k", 0.05)], "lang string, gram string, weight double")
    r = sc.bag_scores(letters(spark, d), sc.marker_table(spark, PROFILES), sc.profile_table(spark, PROFILES), negatives)
    return r.select("media", "lang", F.round("score", 6).alias("score"))


@plain("f6_f7_fused_scores", LETTERS + """, n0 AS (SELECT media, lang, CASE WHEN max(score) OVER (PARTITION BY media) > 1 THEN least(greatest(score / 150, 0), 1) ELSE score END AS norm, CASE WHEN lang <> 'eng' THEN (media % 10) / 10.0::DOUBLE END AS prosody FROM (SELECT media, lang, round(score, 9) AS score FROM bags)),
n1 AS (SELECT *, coalesce(lead(lang) OVER w, first_value(lang) OVER w) AS rival FROM n0 WINDOW w AS (PARTITION BY media ORDER BY norm DESC, lang))
SELECT media, lang, rival, round(CASE WHEN prosody IS NULL THEN norm ELSE 0.7 * norm + 0.3 * prosody END, 6) AS fused FROM n1""")
def f7(spark, d):
    bags = sc.bag_scores(letters(spark, d), sc.marker_table(spark, PROFILES), sc.profile_table(spark, PROFILES))
    rows = bags.select("media", "lang", F.round("score", 9).alias("phoneme"), F.when(F.col("lang") != "eng", F.col("media") % 10 / 10.0).alias("prosody"))
    return sc.fused(rows).select("media", "lang", "rival", F.round("fused", 6).alias("fused"))


@plain("f8_prosody_similarity", "SELECT vec_id, round(0.5 * greatest(0, 1 - (least(1, abs(embedding[1]::DOUBLE - 0.1) / 0.5) + least(1, abs(embedding[2]::DOUBLE) / 0.4) + least(1, abs(embedding[3]::DOUBLE + 0.1) / 1.0)) / 3), 5) AS score FROM embeddings")
def f8(spark, d):
    features = {k: F.element_at("embedding", i + 1).cast("double") for i, k in enumerate(("f0_range", "f0_std", "rate"))}
    profile = {"f0_range": (0.0, 0.5, 0.1), "f0_std": (-0.2, 0.2, 0.0), "rate": (-0.5, 0.5, -0.1)}
    return read(spark, d, "embeddings").select("vec_id", F.round(sc.profile_similarity(features, profile, 0.5), 5).alias("score"))


@plain("f9_logistic_prosody", "SELECT vec_id, round(1 / (1 + exp(-(0.2 + 1.5 * (coalesce(embedding[1]::DOUBLE, 0) - 0.01) / 0.1 - 0.7 * (coalesce(embedding[2]::DOUBLE, 0) + 0.02) / 0.2))), 5) AS p FROM embeddings")
def f9(spark, d):
    xs = [F.element_at("embedding", i).cast("double") for i in (1, 2)]
    return read(spark, d, "embeddings").select("vec_id", F.round(sc.logistic(xs, [0.01, -0.02], [0.1, 0.2], [1.5, -0.7], 0.2), 5).alias("p"))


BIGRAMS = """, e AS (SELECT media, lag(phoneme) OVER w AS p, phoneme AS x, lead(phoneme) OVER w AS q FROM ph WINDOW w AS (PARTITION BY media ORDER BY pos)),
bg AS (SELECT media, CASE media % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS lang, coalesce(p, '^') AS a, x AS b FROM e UNION ALL SELECT media, CASE media % 2 WHEN 0 THEN 'even' ELSE 'odd' END, x, '$' FROM e WHERE q IS NULL),
cn AS (SELECT lang, a, b, count(*) AS n FROM bg GROUP BY ALL)
"""


def _streams(spark, d):
    return letters(spark, d).withColumn("lang", F.when(F.col("media") % 2 == 0, "even").otherwise("odd"))


@plain("a12_bigram_counts", LETTERS + BIGRAMS + "SELECT lang, a, b, n FROM cn")
def a12(spark, d):
    return sc.bigram_counts(_streams(spark, d), ["media"], "lang")


@plain("f48_bigram_likelihood", LETTERS + BIGRAMS + """, tt AS (SELECT lang, a, sum(n) AS t FROM cn GROUP BY ALL), md AS (SELECT unnest(['even', 'odd']) AS model)
SELECT bg.media, model AS lang, round(avg(ln((coalesce(cn.n, 0) + 0.1) / (coalesce(t, 0) + 0.1 * 30))), 5) AS loglik FROM bg CROSS JOIN md LEFT JOIN cn ON cn.lang = model AND cn.a = bg.a AND cn.b = bg.b LEFT JOIN tt ON tt.lang = model AND tt.a = bg.a GROUP BY ALL""")
def f48(spark, d):
    from loomwork.operators.metrics import log_likelihood

    rows = _streams(spark, d)
    pairs = sc.edge_bigrams(rows, ["media"], "lang").drop("lang")
    r = log_likelihood(pairs, sc.bigram_counts(rows, ["media"], "lang"), ["even", "odd"], 30, 0.1, ["media"])
    return r.withColumn("loglik", F.round("loglik", 5))


@plain("a11_phoneme_frequency", LETTERS + "SELECT phoneme, count(*) AS n, count(DISTINCT ph.media) AS streams, max((mk.gram IS NOT NULL)::INT) AS marker FROM ph LEFT JOIN mk ON mk.n = 1 AND mk.gram = phoneme GROUP BY phoneme")
def a11(spark, d):
    marks = sc.marker_table(spark, PROFILES).where("n = 1").select(F.col("gram").alias("phoneme"), F.lit(1).alias("m"))
    return letters(spark, d).join(F.broadcast(marks), "phoneme", "left").groupBy("phoneme").agg(F.count("*").alias("n"), F.countDistinct("media").alias("streams"), F.max(F.coalesce("m", F.lit(0))).alias("marker"))


@plain("a27_ngram_discovery", LETTERS + ", c AS (SELECT g2 AS gram, count(*) AS n, count(*) FILTER (WHERE media % 2 = 0) AS own FROM g WHERE g2 IS NOT NULL GROUP BY g2) SELECT gram, n, round(own / n, 6) AS specificity FROM c WHERE n >= 5 AND own / n >= 0.6")
def a27(spark, d):
    c = sc.grams(letters(spark, d), 2).groupBy("gram").agg(F.count("*").alias("n"), F.count_if(F.col("media") % 2 == 0).alias("own"))
    return c.where((F.col("n") >= 5) & (F.col("own") / F.col("n") >= 0.6)).select("gram", "n", F.round(F.col("own") / F.col("n"), 6).alias("specificity"))


def lexicon(spark) -> DataFrame:
    return spark.createDataFrame([(i, w, w) for i, w in enumerate(LEXICON)], "ord int, word string, code string")


def tokens(spark, d) -> DataFrame:
    return read(spark, d, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("i", "text"))


LEX = "lx(ord, word) AS (VALUES " + ", ".join(f"({i}, '{w}')" for i, w in enumerate(LEXICON)) + ")"
TOK = "WITH tk AS (SELECT item_id, (unnest(range(len(w))))::INT AS i, unnest(w) AS text FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark)), " + LEX


@plain("f13_whole_matches", TOK + ", p AS (SELECT item_id, i, word, ord, levenshtein(text, word) AS d, greatest(length(text), length(word)) AS m FROM tk, lx), q AS (SELECT *, 1 - d / m AS score, row_number() OVER (PARTITION BY item_id, i ORDER BY 1 - d / m DESC, ord) AS rk FROM p WHERE d <= floor(0.3 * m)) SELECT item_id, i, word, round(score, 6) AS score FROM q WHERE rk = 1")
def f13(spark, d):
    return lx.whole_matches(tokens(spark, d), lexicon(spark), ["item_id", "i"]).withColumn("score", F.round("score", 6))


@plain("f10_edit_distance", TOK + "SELECT item_id, i, min(levenshtein(text, word)) AS d FROM tk, lx GROUP BY ALL")
def f10(spark, d):
    words = F.array(*map(F.lit, LEXICON))
    return tokens(spark, d).select("item_id", "i", F.array_min(F.transform(words, lambda w: F.levenshtein(F.col("text"), w))).alias("d"))


WINDOWS = """, w AS (SELECT item_id, x, unnest(range(greatest(length(x) - 3, 0) + 1)) AS start FROM (SELECT item_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS x FROM benchmark)),
c AS (SELECT item_id, start, len, word, substr(x, start + 1, len) AS win FROM w, lx, (SELECT unnest(range(2, 9)) AS len) WHERE len BETWEEN length(word) - 1 AND length(word) + 1 AND len >= 3 AND start + len <= length(x)),
d AS (SELECT *, levenshtein(win, word) AS dist, greatest(length(win), length(word)) AS m FROM c),
hits AS (SELECT item_id, word, start, arg_max(len, (1 - dist / m, -len)) AS length, max(1 - dist / m) AS score FROM d WHERE dist <= floor(0.3 * m) GROUP BY item_id, word, start)
"""


def _streams_of_text(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.regexp_replace(F.lower("text"), "[^a-z]", "").alias("text"))


@plain("f14_subsequence_matches", TOK + WINDOWS + "SELECT item_id, word, start::INT AS start, length::INT AS length, round(score, 6) AS score FROM hits")
def f14(spark, d):
    return lx.windows_near(_streams_of_text(spark, d), lexicon(spark), ["item_id"]).withColumn("score", F.round("score", 6))


@plain("f15_lexicon_override", TOK + WINDOWS + ", cv AS (SELECT item_id, unnest(range(start, start + length)) AS pos, score FROM hits) SELECT item_id, pos::INT AS pos, round(min(score), 6) AS score FROM cv GROUP BY ALL")
def f15(spark, d):
    rows = _streams_of_text(spark, d)
    tags = rows.select("item_id", F.posexplode(F.split("text", "")).alias("pos", "x")).select("item_id", "pos", F.lit(None).cast("string").alias("tag"), F.lit(None).cast("double").alias("score"))
    out = lx.overridden(tags, lx.windows_near(rows, lexicon(spark), ["item_id"]), "nah", ["item_id"])
    return out.where("tag = 'nah'").select("item_id", "pos", F.round("score", 6).alias("score"))


@plain("f16_positional_matches", TOK + """, w AS (SELECT item_id, word, start, substr(x, start + 1, length(word)) AS win FROM (SELECT item_id, x, unnest(range(length(x))) AS start FROM (SELECT item_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS x FROM benchmark)), lx WHERE start < greatest(1, length(x) - length(word) - 1)),
s AS (SELECT item_id, word, start, len(list_filter(list_zip(string_split(win, ''), string_split(word, '')), lambda z: z[1] = z[2])) / length(word) AS score FROM w)
SELECT item_id, word, min(start)::INT AS start, round(arg_min(score, start), 6) AS score FROM s WHERE score >= 0.6 GROUP BY ALL""")
def f16(spark, d):
    return lx.positional_matches(_streams_of_text(spark, d), lexicon(spark), ["item_id"]).withColumn("score", F.round("score", 6))


@plain("f17_substring_matches", TOK + " SELECT item_id, word FROM (SELECT item_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS x FROM benchmark), lx WHERE contains(x, word)")
def f17(spark, d):
    words = F.array(*map(F.lit, LEXICON))
    return _streams_of_text(spark, d).select("item_id", F.explode(F.filter(words, lambda w: F.contains(F.col("text"), w))).alias("word"))


@plain("a33_lexicon_coverage", TOK + " SELECT count(*) AS tokens, count(DISTINCT text) AS types, count(*) FILTER (WHERE text IN (SELECT word FROM lx)) AS known FROM tk")
def a33(spark, d):
    return tokens(spark, d).agg(F.count("*").alias("tokens"), F.countDistinct("text").alias("types"), F.count_if(F.col("text").isin(*LEXICON)).alias("known"))


@plain("j15_dictionary_semi_join", "WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations), k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) SELECT conv_id, turn, count(*) AS known FROM t WHERE w IN (SELECT w FROM k) GROUP BY ALL")
def j15(spark, d):
    known = read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    t = read(spark, d, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    return t.join(known, "w", "left_semi").groupBy("conv_id", "turn").agg(F.count("*").alias("known"))


@plain("s11_j16_j17_lexicon_build", """WITH c AS (SELECT w AS word, count(*) AS freq, count(DISTINCT item_id) AS file_count FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) GROUP BY w), l AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations WHERE role = 'system')
SELECT word, freq, file_count, 'corpus' AS source FROM c WHERE freq >= 3 AND word NOT IN (SELECT w FROM l) AND word NOT IN ('the', 'and') UNION ALL SELECT 'The', NULL, NULL, 'curated' UNION ALL SELECT 'AND', NULL, NULL, 'curated'""")
def s11(spark, d):
    corpus = read(spark, d, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"), F.countDistinct("item_id").alias("file_count"))
    loans = read(spark, d, "conversations").where("role = 'system'").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    kept = lx.filtered(corpus.join(loans, "word", "left_anti").withColumn("source", F.lit("corpus")))
    curated = spark.createDataFrame([("The", None, None, "curated"), ("AND", None, None, "curated")], "word string, freq long, file_count long, source string")
    return lx.combined(curated, kept)


@plain("a13_o9_token_tables", "SELECT w AS word, count(*) AS n, count(DISTINCT conv_id) AS files FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations) GROUP BY w")
def a13(spark, d):
    t = read(spark, d, "conversations").select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return t.groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("files"))


@query("p1_confidence_tiers", "x AS (SELECT -conf * 2 AS lp FROM seg) SELECT CASE WHEN lp > -0.3 THEN 'HIGH' WHEN lp < -0.7 THEN 'LOW' ELSE 'MEDIUM' END AS tier, count(*) AS n FROM x GROUP BY tier")
def p1(spark, d):
    return segments(spark, d).select(tx.confidence_tier(-F.col("conf") * 2).alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))


@plain("p2_language_codes", "SELECT doc_id, CASE lang WHEN 'es' THEN 'spa' WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' ELSE 'other' END AS code FROM documents")
def p2(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.language_code(F.col("lang")).alias("code"))


@query("p3_p4_p7_filters", "x AS (SELECT 1) SELECT cue, gt, pred FROM scored WHERE gt <> '' AND pred <> '' AND gt <> pred AND gt NOT IN ('may', 'lat') AND dur BETWEEN 500 AND 30000")
def p3(spark, d):
    from loomwork.plans.metric_queries import _rows

    return _rows(spark, d).where((F.col("gt") != "") & (F.col("pred") != "") & (F.col("gt") != F.col("pred")) & ~F.col("gt").isin("may", "lat") & F.col("dur").between(500, 30000)).select("cue", "gt", "pred")


@plain("p5_noise_gate", "SELECT doc_id, n_chars <= 400 AND len(list_filter(regexp_extract_all(regexp_replace(text, '\\[[^\\]]*\\]', '', 'g'), '[A-Za-z]+'), lambda w: length(w) > 1)) < 2 AS noise FROM documents")
def p5(spark, d):
    words = F.regexp_extract_all(F.regexp_replace("text", "\\[[^\\]]*\\]", ""), F.lit("[A-Za-z]+"), F.lit(0))
    return read(spark, d, "documents").select("doc_id", ((F.col("n_chars") <= 400) & (F.size(F.filter(words, lambda w: F.char_length(w) > 1)) < 2)).alias("noise"))


@query("p6_reject_gate", "x AS (SELECT 1) SELECT pos, CASE WHEN conf < 0.02 AND lang NOT IN ('other', 'silence', 'unknown', 'lat') THEN 'unknown' ELSE lang END AS lang FROM seg")
def p6(spark, d):
    weak = (F.col("conf") < 0.02) & ~F.col("lang").isin("other", "silence", "unknown", "lat")
    return segments(spark, d).select("pos", F.when(weak, "unknown").otherwise(F.col("lang")).alias("lang"))


@query("p8_p9_suppression", "v AS (SELECT speaker, media, count(*) FILTER (WHERE conf >= 0.1) AS ok FROM seg GROUP BY ALL) SELECT pos FROM seg JOIN v USING (speaker, media) WHERE conf < 0.01 AND ok < 30")
def p9(spark, d):
    rows = segments(spark, d)
    ok = rows.groupBy("speaker", "media").agg(F.count_if(F.col("conf") >= 0.1).alias("ok"))
    return rows.join(ok, ["speaker", "media"]).where("conf < 0.01 AND ok < 30").select("pos")


@query("p10_edge_cases", "x AS (SELECT 1) SELECT pos, concat_ws(',', CASE WHEN lang = 'other' THEN 'other' END, CASE WHEN conf < 0.01 THEN 'weak' END, CASE WHEN e - s < 1000 THEN 'short' END, CASE WHEN n > 8 THEN 'long' END) AS reasons FROM seg WHERE lang = 'other' OR conf < 0.01 OR e - s < 1000 OR n > 8")
def p10(spark, d):
    reasons = F.array_compact(F.array(F.when(F.col("lang") == "other", "other"), F.when(F.col("conf") < 0.01, "weak"), F.when(F.col("e") - F.col("s") < 1000, "short"), F.when(F.col("n") > 8, "long")))
    return segments(spark, d).withColumn("r", reasons).where(F.size("r") > 0).select("pos", F.array_join("r", ",").alias("reasons"))


@plain("p11_p12_safe_projection", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_name LIKE 'C%' AND c_name NOT LIKE '_stale_%' AND c_name LIKE '%1'")
def p12(spark, d):
    return read(spark, d, "customer").where("c_name LIKE 'C%' AND c_name NOT LIKE '_stale_%' AND c_name LIKE '%1'").select("c_custkey", "c_mktsegment")


@plain("f1_f2_symbol_normalisation", "SELECT item_id, CASE regexp_replace(substr(text, 1, 1) || 'ʰː', '[ːʲʰˤʼ]', '', 'g') WHEN 'g' THEN 'ɡ' ELSE regexp_replace(substr(text, 1, 1) || 'ʰː', '[ːʲʰˤʼ]', '', 'g') END AS symbol FROM benchmark")
def f1(spark, d):
    return read(spark, d, "benchmark").select("item_id", tx.allophone(tx.strip_modifiers(F.concat(F.substring("text", 1, 1), F.lit("ʰː")))).alias("symbol"))


@plain("f3_accents", "SELECT conv_id, turn, translate(lower(text), 'áàâäãåāéèêëēíìîïīóòôöõōúùûüūñçýÿ', 'aaaaaaaeeeeeiiiiioooooouuuuuncyy') AS plain FROM conversations")
def f3(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", tx.strip_accents(F.col("text")).alias("plain"))


SYMBOLS = """WITH t AS (SELECT item_id, list_transform(list_filter(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ''), lambda c: c <> ' '),
  lambda c: CASE c WHEN 'd' THEN 'ð' WHEN 's' THEN 'ɕ' WHEN 'e' THEN 'eː' WHEN 'h' THEN 'l' WHEN 'n' THEN 'k' WHEN 'i' THEN 'tʃa' WHEN 'o' THEN 'ː' ELSE c END) AS x FROM benchmark)
"""


def _symbols(spark, d) -> DataFrame:
    to = F.create_map(*(F.lit(x) for kv in {"d": "ð", "s": "ɕ", "e": "eː", "h": "l", "n": "k", "i": "tʃa", "o": "ː"}.items() for x in kv))
    letters_ = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), ""), lambda c: ~c.isin(" ", ""))
    return read(spark, d, "benchmark").select("item_id", F.transform(letters_, lambda c: F.coalesce(to[c], c)).alias("x"))


@plain("f18_canonical_symbols", SYMBOLS + """, c AS (SELECT item_id, list_filter(list_transform(x, lambda s: CASE s WHEN 'ð' THEN 'd' WHEN 'ɕ' THEN 'ʃ' WHEN 'eː' THEN 'e' WHEN 'g' THEN 'ɡ' WHEN 'r' THEN 'ɾ' WHEN 'ː' THEN '' ELSE s END), lambda s: s <> '') AS x FROM t),
j AS (SELECT item_id, replace(' ' || array_to_string(x, '  ') || ' ', ' k  w ', ' kʷ ') AS x FROM c)
SELECT item_id, trim(replace(CASE WHEN item_id % 2 = 0 THEN replace(x, ' t  l ', ' tɬ ') ELSE x END, '  ', ' ')) AS x FROM j""")
def f18(spark, d):
    return _symbols(spark, d).select("item_id", F.array_join(sy.canonical(F.col("x"), F.col("item_id") % 2 == 0), " ").alias("x"))


@plain("f28_split_onsets", SYMBOLS + """, s AS (SELECT item_id, flatten(list_transform(x, lambda s: CASE WHEN s = 'tʃa' THEN ['tʃ', 'a'] ELSE [s] END)) AS x FROM t),
e AS (SELECT item_id, generate_subscripts(x, 1) AS k, unnest(x) AS p FROM s),
n AS (SELECT item_id, k, p, lead(p) OVER w AS after, lag(p) OVER w AS before FROM e WINDOW w AS (PARTITION BY item_id ORDER BY k))
SELECT item_id, string_agg(CASE WHEN after = 'ː' AND p IN ('a', 'e', 'i', 'o', 'u') THEN p || 'ː' ELSE p END, ' ' ORDER BY k) AS x
FROM n WHERE NOT (p = 'ː' AND coalesce(before, '') IN ('a', 'e', 'i', 'o', 'u')) GROUP BY item_id""")
def f28(spark, d):
    return _symbols(spark, d).select("item_id", F.array_join(sy.split_onsets(F.col("x")), " ").alias("x"))


@plain("f21_f38_clean_text", "SELECT item_id, trim(regexp_replace(regexp_replace(text || ' (gloss) 12ˈ', '[1-5.ˈˌ]', '', 'g'), '\\s+', ' ', 'g')) AS a, trim(regexp_replace(text || ' (gloss) x', '\\s*\\([^)]+\\)\\s*', ' ', 'g')) AS b FROM benchmark")
def f21(spark, d):
    t = F.col("text")
    return read(spark, d, "benchmark").select("item_id", tx.clean_espeak(F.concat(t, F.lit(" (gloss) 12ˈ"))).alias("a"), tx.without_glosses(F.concat(t, F.lit(" (gloss) x"))).alias("b"))


@plain("f22_transliteration", "SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'sh', 'x', 'g'), 'ts', 'tz', 'g'), 'kw', 'cu', 'g'), 'w', 'hu', 'g'), 'k([eiéí])', 'qu\\1', 'g'), 'k', 'c', 'g'), '\\s+', ' ', 'g')) AS t FROM conversations")
def f22(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", tx.spanish_orthography(F.col("text")).alias("t"))


RULES = {"ch": "tʃ", "qu": "k", "sh": "ʃ", "th": "θ", "a": "a", "e": "e", "i": "i", "o": "o", "u": "u", "n": "n", "t": "t", "r": "ɾ"}


@plain("f24_f26_f27_longest_match", "SELECT item_id, array_to_string(list_transform(regexp_extract_all(lower(text), 'ch|qu|sh|th|a|e|i|o|u|n|t|r'), lambda x: CASE x WHEN 'ch' THEN 'tʃ' WHEN 'qu' THEN 'k' WHEN 'sh' THEN 'ʃ' WHEN 'th' THEN 'θ' WHEN 'r' THEN 'ɾ' ELSE x END), ' ') AS ipa FROM benchmark")
def f24(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.array_join(tx.longest_first(F.col("text"), RULES), " ").alias("ipa"))


VALID = """WITH t AS (SELECT conv_id, turn, text, 0.0 - (turn % 5) / 4.0 AS lp, list_filter(regexp_extract_all(text, '[a-zA-Z0-9_áéíóúüñÁÉÍÓÚÜÑ]+'), lambda w: length(w) >= 2) AS w, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS a, regexp_replace(lower(text), '[^\\p{L}]', '', 'g') AS l FROM conversations),
u AS (SELECT *, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains(['de','la','que','el','en','los','se','del','las','un','por','con','una','su','para','es','al','lo','como','esta'], translate(lower(x), 'áàâäãåāéèêëēíìîïīóòôöõōúùûüūñçýÿ', 'aaaaaaaeeeeeiiiiioooooouuuuuncyy')))) / len(w) ELSE 1.0 END AS lex,
  1 - least(2 * (length(text) - length(replace(text, chr(39), ''))) / length(text) / 0.04, 1.0) AS apo, CASE WHEN length(l) > 0 THEN length(regexp_replace(l, '[^a-záéíóúüñ]', '', 'g')) / length(l) ELSE 1.0 END AS chr_,
  greatest(0.0, least(1.0, (lp + 1.5) / 1.5))::DOUBLE AS lps FROM t),
g AS (SELECT conv_id, turn, max(c) AS most FROM (SELECT conv_id, turn, a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] AS g, count(*) AS c FROM (SELECT conv_id, turn, a, unnest(range(1, len(a) - 1)) AS i FROM t WHERE len(a) >= 6) GROUP BY ALL) GROUP BY ALL),
v AS (SELECT u.*, CASE WHEN g.most IS NULL THEN 1.0 ELSE 1 / g.most END AS rep FROM u LEFT JOIN g ON g.conv_id = u.conv_id AND g.turn = u.turn)
SELECT conv_id, turn, CASE WHEN lex < 0.4 THEN 'lexicon' WHEN rep <= 0.5 THEN 'repetition' WHEN apo < 0.5 AND lex < 0.6 THEN 'apostrophe' WHEN chr_ < 0.7 AND lex < 0.6 THEN 'letters' WHEN lps < 0.3 AND lex < 0.7 THEN 'logprob' END AS reason,
  round(0.4 * lex + 0.15 * apo + 0.15 * chr_ + 0.15 * lps + 0.15 * rep, 5) AS confidence FROM v"""


@plain("f29_transcript_validation", VALID)
def f29(spark, d):
    t = F.col("text")
    lp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (-(F.col("turn") % 5) / 4.0 + 1.5) / 1.5))
    reason, confidence = tx.verdict(tx.share_known(t, tx.SPANISH_WORDS), tx.apostrophe_score(t), tx.letter_score(t), lp, tx.repetition_score(t))
    return read(spark, d, "conversations").select("conv_id", "turn", reason.alias("reason"), F.round(confidence, 5).alias("confidence"))


@plain("f30_f31_second_validator", """WITH t AS (SELECT conv_id, turn, text, -(turn % 5) / 4.0 AS lp, regexp_extract_all(lower(text), '[a-záéíóúüñ]+') AS w FROM conversations),
k AS (SELECT *, len(list_filter(w, lambda x: list_contains(['de','la','que','el','en','los','se','del','las','un','por','con','una','su','para','es','al','lo','como','esta'], x))) / greatest(len(w), 1) AS known FROM t)
SELECT conv_id, turn, NOT (trim(text) = '' OR (length(text) > 10 AND (length(text) - length(replace(text, chr(39), ''))) / length(text) > 0.02) OR (len(w) >= 3 AND known < 0.35 - 0.2 * greatest(0, least(1, (lp + 2) / 2))) OR lp < -1.0) AS ok FROM k""")
def f30(spark, d):
    t, lp = F.col("text"), -(F.col("turn") % 5) / 4.0
    words = F.regexp_extract_all(F.lower(t), F.lit("[a-záéíóúüñ]+"), F.lit(0))
    known = F.size(F.filter(words, lambda w: w.isin(*tx.SPANISH_WORDS))) / F.greatest(F.size(words), F.lit(1))
    marks = F.char_length(t) - F.char_length(F.translate(t, "'’", ""))
    bad = (F.trim(t) == "") | tx.other_script(t) | ((F.char_length(t) > 10) & (marks / F.char_length(t) > 0.02)) | ((F.size(words) >= 3) & (known < 0.35 - 0.2 * tx.logprob_confidence(lp))) | (lp < -1.0)
    return read(spark, d, "conversations").select("conv_id", "turn", (~bad).alias("ok"))


@plain("f32_f33_hint_scores", """WITH t AS (SELECT conv_id, turn, translate(lower(text), 'áàâäãåāéèêëēíìîïīóòôöõōúùûüūñçýÿ', 'aaaaaaaeeeeeiiiiioooooouuuuuncyy') AS t FROM conversations),
a AS (SELECT *, length(t) - length(replace(replace(t, chr(39), ''), '’', '')) AS m, regexp_extract_all(t, '[a-z'']+') AS w FROM t)
SELECT conv_id, turn, len(list_intersect(list_distinct(regexp_extract_all(t, '[a-z]+')), ['ego','te','baptizo','nomine','patris','filii','spiritus','sancti','amen','dominus','deus','pater','noster','maria','gratia'])) AS latin,
  round(CASE WHEN len(w) > 0 THEN (m >= 1)::INT * 0.7 + (m >= 2)::INT * 0.4 + 0.2 * (contains(t, 'k''')::INT + contains(t, 'ts''')::INT + contains(t, 'ch''')::INT + contains(t, 'x')::INT + contains(t, 'j')::INT + contains(t, 'aa')::INT + contains(t, 'oo')::INT + contains(t, 'uu')::INT)
  + 0.25 * len(list_filter(w, lambda x: list_contains(['ba', 'baal', 'kes', 'kes''', 'uchala', 'takin', 'k''an', 'lo'''], x))) ELSE 0 END, 4)::DOUBLE AS maya FROM a""")
def f33(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", tx.latin_matches(F.col("text")).alias("latin"), F.round(tx.maya_hint(F.col("text")), 4).alias("maya"))


@plain("f34_guessed_language", """WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'es' ELSE 'en' END AS asr, translate(lower(text), 'áàâäãåāéèêëēíìîïīóòôöõōúùûüūñçýÿ', 'aaaaaaaeeeeeiiiiioooooouuuuuncyy') AS t FROM conversations),
a AS (SELECT *, regexp_extract_all(t, '[a-z'']+') AS w, len(list_intersect(list_distinct(regexp_extract_all(t, '[a-z]+')), ['ego','te','baptizo','nomine','patris','filii','spiritus','sancti','amen','dominus','deus','pater','noster','maria','gratia'])) AS latin FROM t),
b AS (SELECT *, len(w) AS n, len(list_filter(w, lambda x: list_contains(['de','la','que','el','en','los','se','del','las','un','por','con','una','su','para','es','al','lo','como','esta'], x))) AS sp,
  len(list_filter(w, lambda x: regexp_matches(x, 'tl|tz|hu|cuauh|quauh|teotl|tlatoani|tenochtitlan|mexica|motecuhzoma|xicotencatl|tzintli|itz|xoch|coatl'))) AS na, len(list_filter(w, lambda x: regexp_matches(x, 'k''|ts''|ch''|halach|ajaw|kukul|yuum|uay|kaax|balam|chan|kab'))) AS ma FROM a)
SELECT conv_id, turn, CASE WHEN n = 0 THEN 'other' WHEN latin >= 3 THEN 'lat' WHEN asr = 'es' AND sp / n >= 0.25 AND sp >= 2 THEN 'spa' WHEN ma >= 2 AND ma > na THEN 'may' WHEN na >= 2 THEN 'nah' WHEN asr = 'es' THEN 'spa' ELSE 'other' END AS lang FROM b""")
def f34(spark, d):
    asr = F.when(F.col("role") == "user", "es").otherwise("en")
    return read(spark, d, "conversations").select("conv_id", "turn", tx.guessed_language(F.col("text"), asr).alias("lang"))


@query("f37_density_class", "x AS (SELECT pos, n - 1 AS k, (e - s) / 1000.0 / 20 AS sec FROM seg) SELECT pos, CASE WHEN sec < 0.3 THEN 'SHORT' WHEN k = 0 THEN 'COLLAPSED' WHEN k / sec < 3 THEN 'COLLAPSED' WHEN k / sec > 15 THEN 'HALLUCINATED' ELSE 'OK' END AS density FROM x")
def f37(spark, d):
    return segments(spark, d).select("pos", tx.density_class(F.col("n") - 1, (F.col("e") - F.col("s")) / 1000.0 / 20).alias("density"))


@query("f39_marked_ejectives")
def f39(spark, d):
    return segments(spark, d).select("pos", tx.marked_ejectives(F.lit("k a t i p o ts u"), F.col("n") % 4).alias("ipa"))


@query("f40_timestamps", "x AS (SELECT pos, s % 86400000 AS t FROM seg) SELECT pos, lpad((t // 3600000)::VARCHAR, 2, '0') || ':' || lpad((t // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((t // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((t % 1000)::VARCHAR, 3, '0') AS stamp, t AS ms FROM x")
def f40(spark, d):
    stamp = tx.srt_time(F.col("s") % 86_400_000)
    return segments(spark, d).select("pos", stamp.alias("stamp")).withColumn("ms", tx.srt_ms(F.col("stamp")))


@plain("f42_slugs", "SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM customer")
def f42(spark, d):
    return read(spark, d, "customer").select("c_custkey", tx.slug(F.col("c_name")).alias("slug"))


@plain("f43_letter_labels", "SELECT n_nationkey, CASE WHEN n_nationkey * 2 < 26 THEN chr(65 + n_nationkey * 2) ELSE chr(64 + (n_nationkey * 2) // 26) || chr(65 + (n_nationkey * 2) % 26) END AS label FROM nation")
def f43(spark, d):
    return read(spark, d, "nation").select("n_nationkey", tx.letter_label(F.col("n_nationkey") * 2).alias("label"))


@plain("f44_normalised_words", "SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9áéíóúñ]+', ' ', 'g')) AS t FROM conversations")
def f44(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9áéíóúñ]+", " ")).alias("t"))


@plain("f45_expectations", "SELECT item_id, regexp_matches(text, '(?i)the') AND regexp_matches(text, '(?i)er') AND NOT regexp_matches(text, '(?i)xyz') AND NOT regexp_matches(text, '(?i)\\bwith\\b') AS ok FROM benchmark")
def f45(spark, d):
    return read(spark, d, "benchmark").select("item_id", tx.expectation(F.col("text"), ["the", "er"], ["xyz", "\\bwith\\b"]).alias("ok"))


@plain("f46_name_parts", "SELECT page_id, regexp_extract(url, '//([^./]+)', 1) AS host, regexp_extract(url, '/([a-z]+)/\\d+', 1) AS topic, regexp_extract(url, 'page=(\\d+)', 1) AS page FROM pages")
def f46(spark, d):
    part = lambda p, a: F.regexp_extract("url", p, 1).alias(a)
    return read(spark, d, "pages").select("page_id", part("//([^./]+)", "host"), part("/([a-z]+)/\\d+", "topic"), part("page=(\\d+)", "page"))


@plain("f47_paragraph_scores", """WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark)
SELECT item_id, round(CASE WHEN len(w) < 5 THEN 0 ELSE 0.6 * (len(list_filter(w, lambda x: contains(x, 'tl'))) + len(list_filter(w, lambda x: contains(x, 'hu')))) - 6.0 * len(list_filter(w, lambda x: list_contains(['de', 'la', 'in', 'a'], x))) / len(w) + least(len(w), 30) * 0.03 END, 4)::DOUBLE AS score FROM t""")
def f47(spark, d):
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    count = lambda f: F.size(F.filter(w, f))
    cluster = count(lambda x: F.contains(x, F.lit("tl"))) + count(lambda x: F.contains(x, F.lit("hu")))
    spanish = count(lambda x: x.isin("de", "la", "in", "a")) / F.size(w)
    score = F.when(F.size(w) < 5, 0.0).otherwise(0.6 * cluster - 6.0 * spanish + F.least(F.size(w), F.lit(30)) * 0.03)
    return read(spark, d, "benchmark").select("item_id", F.round(score, 4).alias("score"))


@plain("f50_mention_classes", """WITH t AS (SELECT conv_id, turn, regexp_replace(regexp_replace(CASE WHEN turn % 2 = 0 THEN '- ' ELSE '' END || text, ' (of|der|de) ', ' is coming ', 'g'), ' (the|and|die|le|el|la) ', ' Marina ', 'g') AS x FROM conversations), l AS (SELECT *, lower(x) AS y FROM t)
SELECT conv_id, turn, CASE
  WHEN regexp_matches(y, '^marina[.,!?]?\\s*$') OR regexp_matches(y, 'marina[,!]?\\s*(come|go|tell|translate|help|lend|no)') OR regexp_matches(y, '(talk to|translate,|don.t be afraid,)\\s*marina') OR contains(y, 'what about marina') OR contains(y, 'where is marina') THEN 'SPEAKS_TO'
  WHEN regexp_matches(y, 'marina is (coming|here|the most)') OR regexp_matches(y, '(was that|about) marina') OR contains(y, 'accompanies marina') OR contains(y, 'name will be marina') OR contains(y, 'malinche') OR contains(y, 'malintzin') THEN 'MENTIONED'
  WHEN x LIKE '- %' AND contains(left(y, 20), 'marina') THEN 'SPOKEN_BY'
  WHEN contains(y, 'marina') AND NOT (contains(y, 'marina!') OR contains(y, 'marina?') OR contains(y, 'marina,')) THEN 'MENTIONED' ELSE 'SPEAKS_TO' END AS class FROM l""")
def f50(spark, d):
    t = F.concat(F.when(F.col("turn") % 2 == 0, "- ").otherwise(""), F.col("text"))
    t = F.regexp_replace(F.regexp_replace(t, " (of|der|de) ", " is coming "), " (the|and|die|le|el|la) ", " Marina ")
    return read(spark, d, "conversations").select("conv_id", "turn", sy.mention_class(t).alias("class"))


@plain("f51_repeated_openings", "WITH t AS (SELECT doc_id, lower(text) AS t, regexp_extract(lower(text), '^[^\\s]+ [^\\s]+ [^\\s]+') AS o FROM documents) SELECT doc_id, (o <> '' AND (length(t) - length(replace(t, o, ''))) / greatest(length(o), 1) >= 3) AS loops FROM t")
def f51(spark, d):
    t = F.lower("text")
    o = F.regexp_extract(t, "^[^\\s]+ [^\\s]+ [^\\s]+", 0)
    times = (F.char_length(t) - F.char_length(F.replace(t, o, F.lit("")))) / F.greatest(F.char_length(o), F.lit(1))
    return read(spark, d, "documents").select("doc_id", ((o != "") & (times >= 3)).alias("loops"))


@query("f53_nearest_vowel", "v(v, f1, f2) AS (VALUES ('a', 800, 1300), ('e', 450, 2000), ('i', 300, 2400), ('o', 480, 900), ('u', 320, 750)), p AS (SELECT pos, v, pow(200 + pos % 700 - f1, 2) * 2 + pow(700 + pos % 1900 - f2, 2) AS dist FROM seg, v) SELECT pos, arg_min(v, (dist, v)) AS vowel FROM p GROUP BY pos")
def f53(spark, d):
    vowels = (("a", 800, 1300), ("e", 450, 2000), ("i", 300, 2400), ("o", 480, 900), ("u", 320, 750))
    x, y = 200 + F.col("pos") % 700, 700 + F.col("pos") % 1900
    near = F.array_min(F.array(*(F.struct((F.pow(x - a, F.lit(2)) * 2 + F.pow(y - b, F.lit(2))).alias("d"), F.lit(v).alias("v")) for v, a, b in vowels)))
    return segments(spark, d).select("pos", near["v"].alias("vowel"))


@query("f54_language_confidence", "x AS (SELECT 1) SELECT pos, round(CASE WHEN lang = 'nah' THEN least(1, n / 9.0 / 1.2) ELSE least(1, n / 9.0 / 1.5) END, 6)::DOUBLE AS c FROM seg")
def f54(spark, d):
    raw = F.col("n") / 9.0
    return segments(spark, d).select("pos", F.round(F.least(F.lit(1.0), F.when(F.col("lang") == "nah", raw / 1.2).otherwise(raw / 1.5)), 6).alias("c"))


@plain("f56_first_of", "SELECT conv_id, turn, coalesce(nullif(CASE WHEN turn % 2 = 0 THEN '' ELSE role END, ''), nullif(CASE WHEN turn % 3 = 0 THEN NULL ELSE 'second' END, ''), 'last') AS x FROM conversations")
def f56(spark, d):
    a, b = F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("role")), F.when(F.col("turn") % 3 != 0, "second")
    return read(spark, d, "conversations").select("conv_id", "turn", tx.first_of(a, b, F.lit("last")).alias("x"))


@plain("f57_json_recovery", """SELECT event_id, u.start::DOUBLE + 100 AS start, u.txt AS text FROM (SELECT event_id, unnest(CASE WHEN event_id % 3 = 0 THEN [{'start': event_id % 50, 'txt': event_type}] ELSE [{'start': event_id % 50, 'txt': event_type}, {'start': 7, 'txt': 'second'}] END) AS u FROM events)""")
def f57(spark, d):
    one = F.concat(F.lit('noise [{"Start": '), (F.col("event_id") % 50).cast("string"), F.lit(', "End": 9.5, "Speaker": 1, "Content": "'), F.col("event_type"), F.lit('"}, '))
    two = F.when(F.col("event_id") % 3 == 0, '{"Start time": 7, "Text": "seco').when(F.col("event_id") % 3 == 1, '{"Start time": 7, "Text": "second"}, {"End": 3}]').otherwise('{"Start time": 7, "Text": "second"}, {"Sta')
    rows = read(spark, d, "events").select("event_id", F.explode(sy.recovered_segments(F.concat(one, two), 100.0)).alias("s"))
    return rows.select("event_id", "s.start", "s.text")
