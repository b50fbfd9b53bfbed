import pytest
from pyspark.sql import functions as F

from loomwork.operators import metrics as me
from loomwork.operators import runs, scoring as sc
from loomwork.operators.speakers import smoothed, speaking_shares

R = lambda lang, n, conf=1.0, s=0: {"media": 1, "lang": lang, "n": n, "conf": conf, "s": s, "e": s + n}


@pytest.mark.parametrize(
    "rows,expected",
    [
        ([("deu", 20), ("spa", 2), ("deu", 15)], [("deu", 37)]),
        ([("deu", 2), ("spa", 20)], [("spa", 22)]),
        ([("deu", 20), ("spa", 1)], [("deu", 21)]),
        ([("deu", 9), ("spa", 2), ("ita", 9)], [("deu", 11), ("ita", 9)]),
        ([("deu", 9), ("spa", 2), ("ita", 10)], [("deu", 9), ("ita", 12)]),
        ([("deu", 1)], [("deu", 1)]),
        ([("a", 1), ("b", 1), ("a", 1), ("c", 5)], [("a", 3), ("c", 5)]),
    ],
)
def test_short_runs_merge(rows, expected):
    assert [(r["lang"], r["n"]) for r in runs.merge_short(3)([R(*r) for r in rows])] == expected


def test_islands_are_absorbed_by_priority():
    fold = runs.absorb_islands({"nah": 10, "spa": 1})
    assert [r["lang"] for r in fold([R("nah", 5, 2.0), R("spa", 3, 1.0), R("nah", 5, 2.0)])] == ["nah"]
    assert [r["lang"] for r in fold([R("nah", 5, 2.0), R("spa", 3, 9.0), R("nah", 5, 2.0)])] == ["nah", "spa", "nah"]
    assert [r["lang"] for r in fold([R("spa", 5, 2.0), R("nah", 3, 1.0), R("spa", 5, 2.0)])] == ["spa", "nah", "spa"]


def test_labels_hold_across_passes():
    turn = lambda s, e, k: {"s": s, "e": e, "speaker": k}
    out = runs.stable_labels([[turn(0, 2, "S0"), turn(2.5, 5, "S1")], [turn(0.1, 2.1, "S1"), turn(2.6, 5.1, "S0")]])
    assert out[1] == ["Speaker A", "Speaker B"]
    assert runs.stable_labels([[turn(0, 2, "S0")], [turn(0.1, 2.1, "S0"), turn(5, 7, "S2")]])[1] == ["Speaker A", "Speaker B"]
    assert [runs.letters(i) for i in (0, 25, 26, 27, 701, 702)] == ["A", "Z", "AA", "AB", "ZZ", "AAA"]


def test_confident_and_distant_rows_stay():
    rows = [dict(s=0, e=5, conf=0.5), dict(s=3, e=6, conf=0.9), dict(s=4, e=8, conf=0.9), dict(s=8, e=9, conf=0.1)]
    assert [r["s"] for r in runs.keep_confident(rows)] == [3, 8]
    assert [r["s"] for r in runs.keep_apart(4)(rows)] == [0, 4, 8]


@pytest.mark.parametrize(
    "rows,expected",
    [
        ([("deu", 20, 5.0), ("deu", 20, 6.0), ("spa", 10, 0.5), ("deu", 20, 5.5)], [("deu", 70)]),
        ([("deu", 20, 5.0), ("deu", 20, 6.0), ("spa", 10, 4.0), ("deu", 20, 5.5)], [("deu", 40), ("spa", 10), ("deu", 20)]),
        ([("deu", 20, 5.0), ("other", 3, 0.0), ("deu", 18, 5.0)], [("deu", 41)]),
        ([("deu", 20, 5.0), ("other", 10, 0.0), ("deu", 18, 5.0)], [("deu", 20), ("other", 10), ("deu", 18)]),
        ([("spa", 20, 5.0), ("other", 5, 0.0), ("spa", 18, 5.0)], [("spa", 20), ("other", 5), ("spa", 18)]),
        ([("deu", 20, 5.0), ("other", 2, 0.0), ("deu", 15, 5.0), ("other", 3, 0.0), ("deu", 18, 5.0)], [("deu", 58)]),
    ],
)
def test_smoothing_by_speaker(spark, rows, expected):
    frame = spark.createDataFrame([(1, "S", i, 10 * i, 10 * i + 10, lang, n, c) for i, (lang, n, c) in enumerate(rows)], "media long, speaker string, pos long, s long, e long, lang string, n long, conf double")
    runs_ = smoothed(frame).orderBy("s").collect()
    size = {i: n for i, (_, n, _) in enumerate(rows)}
    at, got = 0, []
    for r in runs_:
        got.append((r.lang, sum(size[k] for k in range(at, at + r.n))))
        at += r.n
    assert got == expected


def tag(spark, profiles, text):
    phones = spark.createDataFrame([(1, i, x) for i, x in enumerate(text.split())], "media long, pos int, phoneme string")
    rows = sc.tagged(phones, sc.marker_table(spark, profiles), sc.profile_table(spark, profiles)).orderBy("pos").collect()
    return [(r.tag, None if r.score is None else round(r.score, 6)) for r in rows]


def test_trigrams_suppress_what_they_cover(spark):
    p = {"x": {"markers": {"a b": 1.0, "a b c": 1.5, "b": 9.0}}}
    assert tag(spark, p, "a b c") == [("x", 0.5)] * 3
    assert tag(spark, p, "a b d") == [("x", 0.5), ("x", 0.5), (None, None)]
    assert tag(spark, p, "d b") == [(None, None), ("x", 9.0)]


def test_priority_breaks_ties_and_scores_win(spark):
    p = {"lang_a": {"priority": 10, "markers": {"x": 1.0}}, "lang_b": {"priority": 1, "markers": {"x": 0.3, "y": 0.3}}}
    assert [t for t, _ in tag(spark, p, "x a a a y b b b")] == ["lang_a", None, None, None, "lang_b", None, None, None]
    assert tag(spark, {"a": {"priority": 1, "markers": {"x": 1.0}}, "b": {"priority": 5, "markers": {"x": 1.0}}}, "x") == [("b", 1.0)]


def test_runs_carry_over_unmarked_symbols(spark):
    rows = spark.createDataFrame([(1, i, i, i + 1, t, 1.0) for i, t in enumerate([None, "a", None, "b", "b", None, "a"])], "media long, pos long, s long, e long, tag string, score double")
    got = [(r.lang, r.n) for r in runs.carried_runs(rows).orderBy("run").collect()]
    assert got == [("other", 1), ("a", 2), ("b", 3), ("a", 1)]


@pytest.mark.parametrize(
    "scores,expected",
    [
        ([("spa", 45.0, 0.8), ("ita", 42.0, 0.3), ("eng", 10.0, 0.2)], lambda f: f["spa"] > f["ita"]),
        ([("nah", 90.0, 0.5), ("spa", 30.0, 0.6)], lambda f: f["nah"] > f["spa"]),
        ([("spa", 60.0, 0.8), ("eng", 90.0, 0.3), ("deu", 75.0, None)], lambda f: f["deu"] == pytest.approx(0.5)),
    ],
)
def test_fusion(spark, scores, expected):
    rows = spark.createDataFrame([(1, *x) for x in scores], "media long, lang string, phoneme double, prosody double")
    fused = {r.lang: r.fused for r in sc.fused(rows).collect()}
    assert expected(fused) and all(0 <= x <= 1 for x in fused.values())


def test_custom_weights(spark):
    rows = spark.createDataFrame([(1, "spa", 60.0, 0.9), (1, "eng", 90.0, 0.1)], "media long, lang string, phoneme double, prosody double")
    got = {r.lang: r.fused for r in sc.fused(rows, weights={("eng", "spa"): (0.1, 0.9)}).collect()}
    assert got == {"spa": pytest.approx(0.85), "eng": pytest.approx(0.15)}


def test_costs_and_wilson(spark):
    pairs = [("nah", "spa", 2.0), ("nah", "unk", 0.5), ("spa", "nah", 1.5), ("unk", "nah", 0.0), ("eng", "unk", 0.5), ("eng", "deu", 1.0), ("eng", "eng", 0.0)]
    rows = spark.createDataFrame(pairs, "gt string, pred string, expected double")
    assert rows.withColumn("c", me.cost_of(F.col("gt"), F.col("pred"))).where("c <> expected").count() == 0
    low, high = me.wilson(F.col("h"), F.col("n"))
    got = spark.createDataFrame([(0, 0), (25, 25), (5, 10)], "h int, n int").select(low.alias("l"), high.alias("u")).collect()
    assert tuple(got[0]) == (0.0, 1.0) and got[1].u == 1.0 and tuple(got[2]) == (pytest.approx(0.23659), pytest.approx(0.76341))


def test_speaking_shares_round_half_to_even(spark):
    rows = spark.createDataFrame([(1, "A", 0, 25), (1, "B", 25, 200), (1, None, 0, 900)], "media long, speaker string, s long, e long")
    assert [(r.speaker, r.percent) for r in speaking_shares(rows).orderBy("rank").collect()] == [("B", 88), ("A", 12)]


def test_cross_validation_predicts_rows_it_was_not_fitted_on(spark):
    """Two separable labels, and one row of the first among the second: it is predicted wrong, all others right."""
    from pyspark.ml.functions import array_to_vector

    from loomwork.plans.pipeline_queries import cross_validated

    rows = [(i, i % 2, [(-1.0) ** i * 5 + i / 100, 1.0]) for i in range(40)] + [(40, 0, [-5.0, 1.0])]
    frame = spark.createDataFrame(rows, "id long, label int, x array<double>").select("id", F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features"))
    got = cross_validated(frame).collect()
    assert {r.id: r.prediction for r in got} == {i: float(i % 2) if i < 40 else 1.0 for i in range(41)} and len(got) == 41
    assert {r.fold for r in got} == set(range(5)) and {round(r.accuracy, 9) for r in got} == {round(40 / 41, 9)}
    assert all(abs(r.fold_accuracy - sum(x.label == x.prediction for x in got if x.fold == r.fold) / sum(x.fold == r.fold for x in got)) < 1e-9 for r in got)


def test_natural_order_ranks_all_recordings(spark, tmp_path):
    import datetime

    from loomwork.plans import load

    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(days=i % 3, seconds=(i * 7) % 50), (i * 5) % 8, "click", 1.0, "") for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    expected = set()
    for day in range(3):
        mine = sorted((r for r in rows if r[0] % 3 == day), key=lambda r: (10000 if r[2] % 4 == 3 else r[2] % 4, r[1], r[0]))
        expected |= {(r[1].date().toordinal() - datetime.date(1970, 1, 1).toordinal(), r[0], k + 1) for k, r in enumerate(mine)}
    got = load()[0]["o1_o3_natural_order_all"](spark, str(tmp_path)).collect()
    assert {(r.media, r.pos, r.rank) for r in got} == expected and len(got) == 60


def test_thresholds_hold_for_scores_before_rounding(spark, tmp_path):
    """The letters add up to a hair more than the threshold of Spanish in the order of the text, and to the threshold itself once rounded."""
    from loomwork.plans import load

    text = "n" * 12 + "d" * 5 + "b" * 4
    spark.createDataFrame([(1, text), (2, "n" * 22), (3, "n" * 23)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    total = 0.0
    for c in text:
        total += {"n": 0.1, "d": 0.05, "b": 0.2}[c]
    expected = {3: ("spa", 2.3)} | ({1: ("spa", 2.25)} if total > 2.25 else {})
    assert total != 2.25
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = load()[0]["w5_f5_best_language"](spark, str(tmp_path)).collect()
        assert {r.media: (r.lang, r.score) for r in got} == expected
    spark.conf.set("spark.sql.shuffle.partitions", "4")
