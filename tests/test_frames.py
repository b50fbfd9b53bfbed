import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomwork.functions import text as tx
from loomwork.operators import frames as fr
from loomwork.operators import runs
from loomwork.sources import media
from loomwork.sources import subtitles as st

SPAN = "media int, pos int, s double, e double"


def test_voice_trim(spark):
    segments = spark.createDataFrame([(1, 1, 1.0, 2.0), (1, 2, 3.0, 4.0), (1, 3, 5.0, 6.0), (1, 4, 7.0, 8.0)], SPAN)
    loud = [(1, 1, 0.7, 60.0), (1, 1, 1.0, 40.0), (1, 1, 1.3, 70.0), (1, 1, 1.8, 55.1), (1, 1, 1.9, 55.0), (1, 2, 3.1, 50.0), (1, 3, 5.5, float("nan")), (1, 3, 5.6, None)]
    rows = fr.voice_trim(segments, spark.createDataFrame(loud, "media int, pos int, t double, db double")).orderBy("pos").collect()
    assert [(r.onset, r.offset_, r.trimmed, r.reason) for r in rows] == [
        (0.9, 1.8, True, None), (3.0, 4.0, False, "too_short_after_trim"), (5.0, 6.0, False, "no_valid_intensity"), (7.0, 8.0, False, "no_valid_intensity"),
    ]


def test_overlapped_speech(spark):
    segments = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 2, 0.0, 0.4), (1, 3, 0.0, 1.0), (1, 4, 0.0, 1.0)], SPAN)
    both = [120.0] * 5 + [220.0] * 5
    frames = [(1, p, f, 5.0, 50.0) for p in (1, 2) for f in both] + [(1, 3, f, 20.0, 50.0) for f in [120.0] * 9 + [220.0]] + [(1, 1, float("nan"), None, None)]
    rows = fr.overlapped_speech(segments, spark.createDataFrame(frames, "media int, pos int, f0 double, hnr double, db double")).orderBy("pos").collect()
    assert [(r.low_ratio, r.high_ratio, r.score, r.overlap) for r in rows] == [(0.5, 0.5, 0.8, True), (0.5, 0.5, 0.0, False), (0.9, 0.1, 0.0, False), (0.0, 0.0, 0.0, False)]


def test_lateral_bursts(spark):
    segments = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 2, 0.0, 31.0), (1, 3, 0.0, 1.0)], SPAN)
    quiet = lambda pos, voicing, friction, centroid, length: [(1, pos, i / 10, 10.0 if i == 2 else 60.0, voicing, friction, centroid, length) for i in range(6)]
    schema = "media int, pos int, t double, db double, voicing double, friction double, centroid double, length double"
    found = lambda *m: fr.lateral_bursts(segments, spark.createDataFrame(quiet(1, *m) + quiet(2, *m), schema))
    assert [(r.pos, r.t, r.phone, r.confidence) for r in found(0.1, 0.5, 3000.0, 0.12).collect()] == [(1, 0.2, "tɬ", 0.9)]
    assert [(r.phone, r.confidence) for r in found(0.1, 0.5, 6000.0, 0.12).collect()] == [("tʃ", 0.675)]
    assert [(r.phone, r.confidence) for r in found(0.1, 0.5, 2000.0, 0.12).collect()] == [("tɬ?", 0.45)]
    assert [(r.phone, r.confidence) for r in found(0.0, 0.9, None, 0.12).collect()] == [("tɬ", 1.0)]
    for m in ((0.3, 0.5, 3000.0, 0.12), (None, 0.5, 3000.0, 0.12), (0.1, 0.25, 3000.0, 0.12), (0.1, None, 3000.0, 0.12), (0.1, 0.5, 3000.0, 0.04)):
        assert found(*m).count() == 0
    told = fr.lateral_segments(segments, found(0.1, 0.5, 3000.0, 0.12)).orderBy("pos").collect()
    assert [(r.tl, r.tl_confidence, r.tl_events) for r in told] == [(True, 0.9, 1), (False, 0.0, 0), (False, 0.0, 0)]


def test_bursts_need_frames_on_either_side(spark):
    segments = spark.createDataFrame([(1, 1, 0.0, 1.0)], SPAN)
    schema = "media int, pos int, t double, db double, voicing double, friction double, centroid double, length double"
    for at in (0, 4):
        frames = [(1, 1, i / 10, 10.0 if i == at else 60.0, 0.1, 0.5, 3000.0, 0.12) for i in range(6)]
        assert fr.lateral_bursts(segments, spark.createDataFrame(frames, schema)).count() == 0


def test_vowels_and_consonants(spark):
    rows = spark.createDataFrame([(750, 1300), (300, 2400), (None, 900), (410, 825)], "f1 int, f2 int")
    assert [r.x for r in rows.select(fr.nearest_vowel(F.col("f1"), F.col("f2")).alias("x")).collect()] == ["a", "i", "?", "o"]
    cases = [(1000, 40, True, "m"), (1300, 40, True, "n"), (1000, 30, True, "β"), (2600, 10, True, "ð"), (2000, 10, True, "ɣ"), (3100, 10, False, "t"), (1000, 10, False, "p"), (2000, 10, False, "k"),
             (4100, 50, False, "s"), (3000, 50, False, "tʃ"), (2000, 50, False, "f"), (3600, 80, False, "s"), (3000, 80, False, "ʃ"), (1000, 80, False, "x")]
    rows = spark.createDataFrame(cases, "c int, ms int, v boolean, want string")
    assert rows.where(fr.consonant(F.col("c"), F.col("ms"), F.col("v")) != F.col("want")).count() == 0


PROFILE = {"code": "nah", "name": "N", "rhythm_class": "mora", "f0_range": {"min": 0, "max": 100, "target": 50}, "f0_std": {"min": 0, "max": 10, "target": 5}, "npvi_v": {"min": 1, "max": 1, "target": 1}, "speech_rate": {"min": 0, "max": 4, "target": 2}, "weight": 0.5}


def test_prosody_profiles(spark, tmp_path):
    for code in ("nah", "deu"):
        (tmp_path / f"{code}.json").write_text(json.dumps({**PROFILE, "code": code}, indent=1))
    profiles = media.prosody_profiles(spark, str(tmp_path))
    assert [(r.code, r.f0_range.target, r.weight) for r in profiles.collect()] == [("deu", 50.0, 0.5), ("nah", 50.0, 0.5)]
    rows = spark.createDataFrame([(1, 75.0, 5.0, 9.0, 2.0), (2, 999.0, 999.0, 0.0, 999.0)], "id int, f0_range double, f0_std double, npvi_v double, speech_rate double")
    scores = fr.prosody_scores(rows, profiles).where("code = 'nah'").orderBy("id").collect()
    assert [r.score for r in scores] == [pytest.approx((1 - 0.25 / 3) * 0.5), 0.0]


def test_prosody_profiles_need_all_fields(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({k: v for k, v in PROFILE.items() if k != "npvi_v"}))
    with pytest.raises(PySparkException):
        media.prosody_profiles(spark, str(tmp_path)).collect()


SRT = "1\n00:00:01,000 --> 00:00:02,500\n[NAH|SPEAKER_03|STEM_A] amo\n♫fused: a m o\n♫conf: 0.5\n[LLM] x\n\n\nx\n00:00:01,000 --> 00:00:02,000\ny\n\n2\n00:00:03.000 --> 00:00:04,000\n\n3\n0:00:03 --> 00:00:04,000\nz\n\n2\n00:00:05,000 --> 00:00:06,000\nhola SPEAKER_9"


def test_annotated_cues(spark):
    rows = st.annotated_cues(spark.createDataFrame([("f", SRT), ("g", ""), ("h", None)], "path string, value string")).orderBy("i").collect()
    assert [(r.path, r.cue, r.start_s, r.end_s, r.text, r.lang, r.speaker, r.stem, r.ipa, r.confidence) for r in rows] == [
        ("f", 1, 1.0, 2.5, "[NAH|SPEAKER_03|STEM_A] amo", "NAH", "SPEAKER_03", "STEM_A", "a m o", 0.5),
        ("f", 2, 3.0, 4.0, "", None, None, None, None, None), ("f", 2, 5.0, 6.0, "hola SPEAKER_9", None, "SPEAKER_9", None, None, None),
    ]


def test_rich_cues(spark):
    text = "7\n00:00:01,000 --> 00:00:02,500\n[NAHUATL|S 1] [IPA] a [FT] b\n♫allo: x y\n♫fused: tɬ tʼ tɬ\n\n8\n00:00:01,000 --> 00:00:02,500"
    a, b = st.rich_cues(spark.createDataFrame([("f", text)], "path string, value string")).orderBy("i").collect()
    assert (a.cue, a.duration, a.speaker, a.lang, a.text, a.source, a.ipa_allo, a.ipa_w2v2, a.ipa_fused, a.nah_markers, a.ejectives) == (7, 1.5, "S 1", "nah", "[IPA] a  b", "ft", "x y", "", "tɬ tʼ tɬ", ["tɬ"], ["tʼ"])
    assert (b.speaker, b.lang, b.text, b.source, b.trim, b.conf, b.nah_markers) == ("?", "oth", "", "whisper", "", "", [])


def test_manifests_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 500, 900), (1, 1, 0, 400)], "media int, pos int, s long, e long")
    st.write_manifests(rows, str(tmp_path / "m"))
    file = next((tmp_path / "m" / "media=1").glob("*.txt"))
    assert json.loads(file.read_text()) == {"version": "1.0", "segment_count": 2, "total_speech_ms": 800, "segments": [{"start_ms": 0, "end_ms": 400, "duration_ms": 400}, {"start_ms": 500, "end_ms": 900, "duration_ms": 400}]}
    notes = [("a", 1, "NAH", None), ("a", 2, "SPA", None), ("a", 3, "UNK", None), ("a", 4, "", None), ("a", 5, None, None), ("a", 6, "NAH", None), ("b", 1, "UNK", None)]
    truth = st.truth_snapshot(spark.createDataFrame(notes, "media string, cue_index int, correct_lang string, correct_speaker string").withColumns({"start_s": F.lit(0.0), "end_s": F.lit(1.0)}))
    assert truth.count() == 5
    cues = [("a", 1, "[NAH|S1] x"), ("a", 2, "[Nahuatl] y"), ("a", 3, "z"), ("b", 1, "[Spanish|x] w")]
    told = spark.createDataFrame(cues, "media string, cue_index int, text string").select("media", "cue_index", st.report_language(F.col("text")).alias("lang"))
    assert [r.lang for r in told.orderBy("media", "cue_index").collect()] == ["nah", "nah", "oth", "spa"]
    a, b = st.snapshot_report(truth, told).orderBy("media").collect()
    assert (a.total, a.unk, a.accuracy_all, a.accuracy_known, a.accuracy_two, a.accuracy_nah, a.nah_precision, a.nah_recall) == (3, 1, 0.3333, 0.5, 0.5, 0.5, 0.5, 1.0)
    assert [tuple(x) for x in a.confusion] == [("nah", "nah", 1), ("spa", "nah", 1)]
    assert (b.total, b.accuracy_all, b.accuracy_known, b.nah_precision, b.confusion) == (1, 0.0, None, 0.0, [])


def test_paragraph_score_and_names(spark):
    score = lambda t: spark.createDataFrame([(t,)], "t string").select(tx.paragraph_score(F.col("t")).alias("x")).first().x
    assert score("in tlacatl de casa") == 0.0 and score(None) == 0.0 and score("") == 0.0
    assert score("In 'tlacatzintzin' huehuetque de casa") == pytest.approx(2 * 2 + 0.6 * 6 - 6 / 5 + 0.15)
    assert score("in auh casa perro gato") == pytest.approx(4.15)
    assert score("tlatzin casa perro gato luna") == pytest.approx(0.6 * 5 + 0.15)
    name = lambda t: spark.createDataFrame([(t,)], "t string").select(tx.recording_name(F.col("t")).alias("x")).first().x
    assert tuple(name("Tepet_Botan_OPH507-VPR522_xAB1234_2008.wav")) == ("Botan", "Tepetzintla", ["OPH507", "VPR522"])
    assert tuple(name("x.wav")) == ("Unknown", "Unknown", [])


def test_bleed(spark):
    schema = "media int, pos int, s double, e double, text string, speaker string, lang string, ipa string"
    long = "él vino por la noche con su perro"
    rows = [
        (1, 1, 0.0, 1.0, "por la noche", "A", "spa", "x"), (1, 2, 1.0, 3.0, long, "A", "spa", "a"), (1, 3, 3.5, 4.5, "Por la noche", "A", "spa", "b"), (1, 4, 4.6, 5.0, "la noche", "A", "spa", ""),
        (2, 1, 0.0, 1.0, long, "A", "spa", "a"), (2, 2, 3.0, 4.0, "por la noche", "A", "spa", "b"), (2, 3, 4.0, 5.0, "noche noche", "A", "spa", None), (2, 4, 5.0, 7.0, "por la noche", "A", "spa", "c"), (2, 5, 7.0, 8.0, None, "A", "spa", None),
    ]
    out = runs.bleed_merged(spark.createDataFrame(rows, schema)).orderBy("media", "pos").collect()
    assert [(r.media, r.pos, r.e, r.text, r.ipa, r.mark) for r in out] == [
        (1, 1, 1.0, "por la noche", "x", ""), (1, 2, 4.5, long, "a b", "+bleed-merged"), (1, 4, 5.0, "la noche", "", ""),
        (2, 1, 1.0, long, "a", ""), (2, 2, 4.0, None, "b", "+bleed-pruned"), (2, 3, 5.0, "noche noche", None, ""), (2, 4, 7.0, "por la noche", "c", ""), (2, 5, 8.0, None, None, ""),
    ]
