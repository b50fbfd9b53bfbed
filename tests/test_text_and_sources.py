import json

import pytest
from pyspark.sql import functions as F

from loomwork.functions import sequences as sq
from loomwork.functions import symbols as sy
from loomwork.functions import text as tx
from loomwork.sources import subtitles as st
from loomwork.streaming import live


def column(spark, expression, values, kind="string"):
    return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_tiers(spark):
    assert column(spark, tx.confidence_tier, [-0.3, -0.7, -0.29, -0.71], "double") == ["MEDIUM", "MEDIUM", "HIGH", "LOW"]


def test_transliteration(spark):
    assert column(spark, tx.spanish_orthography, ["kwali", "tsiki", "shoka", None, ""]) == ["cuali", "tziqui", "xoca", None, ""]


def test_density(spark):
    rows = spark.createDataFrame([(2, 1.0), (20, 1.0), (5, 0.2), (5, 1.0), (0, 1.0)], "n int, d double")
    assert [r.x for r in rows.select(tx.density_class(F.col("n"), F.col("d")).alias("x")).collect()] == ["COLLAPSED", "HALLUCINATED", "SHORT", "OK", "COLLAPSED"]


def test_repetition_and_letters(spark):
    assert column(spark, tx.repetition_score, ["a b c a b c a b c", "one two three four five six", "a b c", ""]) == [pytest.approx(1 / 3), 1.0, 1.0, 1.0]
    assert column(spark, tx.letter_score, ["año", "кот", "", "12"]) == [1.0, 0.0, 1.0, 1.0]
    assert column(spark, tx.other_script, ["abc é", "abc кот", "12"]) == [False, True, False]


def test_small_functions(spark):
    assert column(spark, lambda c: tx.marked_ejectives(c, F.lit(2)), ["k a t i p", ""]) == ["kʼ a tʼ i p", ""]
    assert column(spark, tx.letter_label, [0, 25, 26], "int") == ["A", "Z", "AA"]
    assert column(spark, tx.looks_like_ipa, ["k a t", "hola amigo", "ɬʔɪ", None]) == [True, False, True, False]
    assert column(spark, tx.srt_time, [0, 3723004], "long") == ["00:00:00,000", "01:02:03,004"]
    assert column(spark, tx.without_glosses, ["a (water) b"]) == ["a b"]


def test_alignment_and_vote():
    assert sq.align("abc", "axc") == [(0, 0), (1, 1), (2, 2)]
    assert sq.align("ab", "b") == [(0, None), (1, 0)]
    assert sq.vote(["a", "b"], [0.9, 0.2], ["a", "x", "y"], [0.5, 0.5, 0.9])[0] == ["a", "x", "y"]
    assert sq.vote([], [], [], [])[0] == []


def test_alignment_and_vote_match_brute_force_over_whole_texts(spark, tmp_path):
    """Costs by recursion, the backtrace from the end; the texts have up to 40 words."""
    import functools
    import random

    from loomwork.plans import load

    def brute(a, b):
        @functools.cache
        def cost(i, j):
            return i + j if not i or not j else min(cost(i - 1, j - 1) + (a[i - 1] != b[j - 1]), cost(i - 1, j) + 1, cost(i, j - 1) + 1)

        i, j, out = len(a), len(b), []
        while i or j:
            if i and j and cost(i, j) == cost(i - 1, j - 1) + (a[i - 1] != b[j - 1]):
                i, j, pair = i - 1, j - 1, (i - 1, j - 1)
            elif i and cost(i, j) == cost(i - 1, j) + 1:
                i, pair = i - 1, (i - 1, None)
            else:
                j, pair = j - 1, (None, j - 1)
            out.append(pair)
        return out[::-1]

    def fused(a, b):
        out, sure = [], 0.55 + max(0.0, 0.15 * (0.8 - len(b) / 20) / 0.8)
        for i, j in brute(a, b):
            one, two = i is not None and (0.4 + len(a[i]) / 20, a[i]), j is not None and (sure, b[j])
            if one and two:
                out.append(two[1] if one[1] != two[1] and two[0] + 0.04 > one[0] + 0.02 else one[1])
            else:
                out.append((one or two)[1])
        return out

    rng = random.Random(3)
    texts = [[rng.choice(["a", "bb", "ccc", "dddd", "eeeee"]) for _ in range(rng.choice([1, 5, 20, 40]))] for _ in range(12)]
    for a, b in zip(texts, texts[1:]):
        assert sq.align(a, b) == brute(tuple(a), tuple(b))
    assert sq.align([], ["a"]) == [(None, 0)] and sq.align([], []) == []
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: r.fused for r in load()[0]["f19_f20_phone_vote"](spark, str(tmp_path)).collect()}
    assert got == {i: fused(a, b) for i, (a, b) in enumerate(zip(texts, texts[1:]))}


def test_morphemes_and_sounds():
    tables = ({"ni": ("ni", 1), "ki": ("ki", 2)}, {"itta": "itta", "kali": "kali"}, {"tin": ("tin", 1)})
    assert sq.morphemes("nikitta", *tables) == [("prefix", "ni"), ("rest", "kitta")] or sq.morphemes("nikiitta", *tables) == [("prefix", "ni"), ("prefix", "ki"), ("root", "itta")]
    assert sq.morphemes("kalitin", *tables) == [("root", "kali"), ("suffix", "tin")]
    assert sq.morphemes("kolitin", *tables) == [("root", "kali"), ("suffix", "tin")]
    rules = {"tl": "tɬ", "a": "a", "k": "k", "ch": "tʃ"}
    assert sq.letters_to_sounds("atlakh", rules) == ["a", "tɬ", "a", "k"]
    assert sq.sounds_to_letters(["a", "tɬ", "a"], rules) == "atla" and sq.sounds_to_letters(["x", "y", "z", "q"], rules) == ""
    assert sq.expand_contract(["tɬ", "t", "ɬ", "a"], {"tɬ": ("t", "ɬ")}) == ["t", "ɬ", "tɬ", "a"]
    assert sq.closest_word("sankastelanl", ["arcabuceros", "castelan"]) == "castelan"


SRT = """1
00:00:01,000 --> 00:00:02,500
[NAH|SPEAKER_01] [FT] niltze tlein
♫fused: n i l
♫conf: 0.75

2
00:00:03,000 --> 00:00:04,000
[ESP] hola

2
00:00:05,000 --> 00:00:06,000
no tag here

x
00:00:05,000 --> 00:00:06,000
bad number

7
only two lines"""


def test_subtitles_are_read(spark):
    got = {r.cue: r for r in st.cues(spark.createDataFrame([("f", SRT)], "path string, value string")).collect()}
    assert sorted(got) == [1, 2]
    a, b = got[1], got[2]
    assert (a.s, a.e, a.lang, a.speaker, a.mark, a.conf, a.ipa, a.body) == (1000, 2500, "nah", "SPEAKER_01", "FT", 0.75, ["n", "i", "l"], "niltze tlein")
    assert (b.s, b.lang, b.body, b.mark, b.conf) == (5000, "oth", "no tag here", "whisper", None)


def test_subtitles_survive_a_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(i % 2, i, i * 1000, i * 1000 + 999, "spa", "SPEAKER_01", f"text {i}", 0.5) for i in range(20)], "media long, pos long, s long, e long, lang string, speaker string, text string, conf double")
    st.write_subtitles(rows, f"{tmp_path}/out")
    back = st.cues(st.whole_files(spark, f"{tmp_path}/out/media=1"))
    assert sorted((r.cue, r.s, r.e, r.lang, r.body, r.conf) for r in back.collect()) == [(k + 1, i * 1000, i * 1000 + 999, "spa", f"text {i}", 0.5) for k, i in enumerate(range(1, 20, 2))]


def test_truth_files_of_both_kinds(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"segments": [{"lang": "NAH", "start": 0.0, "end": 1.0, "done": True}, {"lang": "SPA", "start": 1.0, "end": 2.0, "done": False}, {"lang": "SPA", "start": 2.0, "end": 3.0, "done": True}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"cue_index": 4, "correct_lang": "NAH", "start_s": 0.5, "end_s": 1.0}, {"cue_index": 5, "correct_lang": None, "start_s": 1.0, "end_s": 2.0}]))
    assert [(r.cue, r.lang) for r in st.ground_truth(spark, f"{tmp_path}/a.json").collect()] == [(1, "nah"), (3, "spa")]
    assert [(r.cue, r.lang) for r in st.ground_truth(spark, f"{tmp_path}/b.json").collect()] == [(4, "nah")]


def test_corpus_columns_are_found(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("Client_ID\tPath\tSentence\nx\ta.mp3\thola\ny\t\tsin audio\n")
    assert [tuple(r) for r in st.corpus_table(spark, f"{tmp_path}/c.tsv").collect()] == [("hola", "a.mp3", "x")]
    (tmp_path / "d.tsv").write_text("a\tb\n1\t2\n")
    with pytest.raises(ValueError):
        st.corpus_table(spark, f"{tmp_path}/d.tsv")


def test_transcriber_length(spark):
    xml = '<Trans><Episode><Section endTime="5.5"><Turn startTime="0" endTime="5"/></Section><Section endTime="9"><Turn startTime="6" endTime="8"/></Section></Episode></Trans>'
    assert [tuple(r) for r in st.transcriber_length(spark.createDataFrame([("f", xml)], "path string, value string")).collect()] == [("f", 9.0, 2)]


def test_export_counts_and_columns(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "secret"), ("a", 2, "secret"), ("b", 3, "secret")], "media string, cue int, note string")
    counts = {r.media: r.n for r in st.exported(rows, f"{tmp_path}/out", ["cue"], "media").collect()}
    assert counts == {"a": 2, "b": 1}
    assert sorted(spark.read.json(f"{tmp_path}/out").columns) == ["cue", "media"]


def test_paragraphs(spark):
    assert column(spark, st.paragraphs, ["a\nb\n\n \nc", "", "\n\n"]) == [["a b", "c"], [], []]


def test_streamed_runs_equal_batch_runs(spark, tmp_path):
    rows = [(1, i * 10, i * 10 + 9, lang) for i, lang in enumerate(["a", "a", None, "b", "b", "a", "c", "c"])]
    for k in range(4):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], "media long, s long, e long, lang string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    for k in range(4):  # one file of each, in the order of arrival
        part = next((tmp_path / "in" / str(k)).glob("part-*"))
        part.rename(tmp_path / "in" / f"{k}.parquet")
    import os

    for k in range(4):
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_000_000 + k, 1_000_000 + k))
        for x in (tmp_path / "in" / str(k)).iterdir():
            x.unlink()
        (tmp_path / "in" / str(k)).rmdir()
    stream = live.event_stream(spark, f"{tmp_path}/in", "media long, s long, e long, lang string")
    got = sorted(tuple(r) for r in live.collected(live.closed_runs(stream), str(tmp_path), rest=live.last_runs).collect())
    assert got == [(1, "a", 0, 29, 3), (1, "a", 50, 59, 1), (1, "b", 30, 49, 2), (1, "c", 60, 79, 2)]


def test_labels_hold_over_a_stream_of_passes(spark, tmp_path):
    """As over all passes at once, with the state of the last pass only."""
    import os

    from loomwork.operators.runs import stable_labels

    passes = [[("S0", 0.0, 2.0), ("S1", 2.5, 5.0)], [("S1", 0.1, 2.1), ("S0", 2.6, 5.1)], [("S7", 2.4, 5.2), ("S8", 8.0, 9.0)], [("S1", 8.1, 9.1), ("S2", 0.0, 1.0)]]
    for k, turns in enumerate(passes):
        spark.createDataFrame([(1, k, s, e, x) for x, s, e in turns], "media long, pass long, s double, e double, speaker string").coalesce(1).write.parquet(f"{tmp_path}/x{k}")
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        next((tmp_path / f"x{k}").glob("part-*")).rename(tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_000_000 + k, 1_000_000 + k))
    stream = live.event_stream(spark, f"{tmp_path}/in", "media long, pass long, s double, e double, speaker string")
    got = {(r["pass"], r.speaker): r.label for r in live.collected(live.stable_speakers(stream), str(tmp_path)).collect()}
    expected = stable_labels([[{"s": s, "e": e, "speaker": x} for x, s, e in p] for p in passes])
    assert got == {(k, x): label for k, (p, names) in enumerate(zip(passes, expected)) for (x, _, _), label in zip(p, names)}


def test_streamed_windows_close_behind_the_watermark(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0, id * 10) AS ts, id % 2 AS k FROM range(200)").write.parquet(f"{tmp_path}/in")
    stream = live.event_stream(spark, f"{tmp_path}/in", "ts timestamp, k long", 100)
    got = live.collected(live.windowed(stream, "ts", ["k"], "5 minutes", "1 minute"), str(tmp_path)).collect()
    assert {r.n for r in got} == {15} and len(got) >= 2


def test_audio_is_cut_into_chunks(spark, tmp_path):
    import wave

    from loomwork.sources import media

    with wave.open(f"{tmp_path}/a.wav", "wb") as f:
        f.setnchannels(2), f.setsampwidth(2), f.setframerate(100)
        f.writeframes(b"\x00\x40\x00\x00" * 250)
    got = media.audio_chunks(spark, str(tmp_path), 1.0).withColumn("p", media.peak_normalised(F.col("samples"))).orderBy("chunk").collect()
    assert [(r.chunk, r.start_s, len(r.samples)) for r in got] == [(0, 0.0, 100), (1, 1.0, 100), (2, 2.0, 50)]
    assert got[0].samples[0] == 0.25 and got[0].p[0] == pytest.approx(0.9)


def test_profiles_and_rules(spark, tmp_path):
    from loomwork.sources import media

    (tmp_path / "p.json").write_text(json.dumps({"code": "nah", "priority": 10, "marker_phonemes": ["a", "b"], "marker_weights": {"a": 0.5}, "marker_sequences": [["t", "l"]], "sequence_weights": {"['t', 'l']": 0.7}, "negative_markers": {"x": 0.2}}))
    got = {(r.kind, r.gram): r.weight for r in media.profiles(spark, f"{tmp_path}/p.json").collect()}
    assert got == {("uni", "a"): 0.5, ("uni", "b"): 1.0, ("bi", "t l"): 0.7, ("negative", "x"): 0.2}
    (tmp_path / "g.csv").write_text("Orth,Phon\na,a\ntl,t ɬ\n")
    assert [(r.grapheme, r.ipa) for r in media.sound_rules(spark, f"{tmp_path}/g.csv").collect()] == [("tl", ["t", "ɬ"]), ("a", ["a"])]
    with pytest.raises(ValueError):
        media.required(spark.range(1), ["id", "audio"])


def one(spark, make, *values):
    frame = spark.createDataFrame([values], [f"c{k}" for k in range(len(values))])
    return frame.select(make(*(F.col(c) for c in frame.columns)).alias("x")).first().x


def test_canonical_symbols(spark):
    from loomwork.functions import symbols as sy

    tokens = [" t͡ɕ ", "", "ʂ", "k", "w", "kː", "wʰ", "t", "l", "ð", "r", "g"]
    assert one(spark, sy.canonical, tokens, True) == ["tʃ", "ʃ", "kʷ", "kʷ", "tɬ", "d", "ɾ", "ɡ"]
    assert one(spark, sy.canonical, tokens, False) == ["tʃ", "ʃ", "kʷ", "kʷ", "t", "l", "d", "ɾ", "ɡ"]
    assert one(spark, sy.canonical, ["k", "k", "w", "kw"], False) == ["k", "kʷ", "kʷ"] and one(spark, sy.canonical, [" "], True) == []


def test_onsets_are_split_and_vowels_lengthened(spark):
    from loomwork.functions import symbols as sy

    assert one(spark, sy.split_onsets, ["tɬa", "kʷeo", "a", "ː", "ː", "tɬn", "n", "ː", "ts"]) == ["tɬ", "a", "kʷ", "e", "o", "aː", "ː", "tɬn", "n", "ː", "ts"]


def test_parts_of_ejectives():
    from loomwork.functions.sequences import AFFRICATE_PARTS, EJECTIVE_PARTS, expand_contract

    maya = lambda *p: expand_contract(p, EJECTIVE_PARTS, AFFRICATE_PARTS)
    assert maya("kʼ", "a") == ["k", "ʼ", "a"] and maya("k", "ʼ", "a") == ["kʼ", "a"]
    assert maya("t", "s", "ʼ") == ["tsʼ"] and maya("ts", "ʼ") == ["tsʼ"] and maya("tsʼ") == ["t", "s", "ʼ"]
    assert maya("ts", "a") == ["t", "s", "a"] and maya("t", "s", "a") == ["ts", "a"] and maya("a", "tʃ") == ["a", "t", "ʃ"] and maya("t", "ʼ") == ["tʼ"]


def test_nahuatl_forms(spark):
    from loomwork.functions import symbols as sy

    score = lambda t: one(spark, lambda c: sy.nahuatl_form_score(c, ["nikan", "ouan"]), t)
    assert score("Nikan") == pytest.approx(0.5) and score("ouan ni") == pytest.approx(0.2) and score("abc") is None
    assert score("tlaco pil mati ouan") == pytest.approx(0.5) and score("padre brazo") == pytest.approx(-0.4)
    assert one(spark, lambda c: sy.has_nahuatl_forms(c, ["nikan"]), "xx nika") and not one(spark, lambda c: sy.has_nahuatl_forms(c, ["nikan"]), "tres")


def test_mention_classes(spark):
    from loomwork.functions import symbols as sy

    cases = {"Marina!": "SPEAKS_TO", "Marina, come here": "SPEAKS_TO", "Where is Marina": "SPEAKS_TO", "Marina is coming": "SPEAKS_TO", "So Marina is here": "MENTIONED", "The Malinche": "MENTIONED",
             "- Marina: yes": "SPOKEN_BY", "I saw Marina yesterday": "MENTIONED", "Hey Marina, yes": "SPEAKS_TO"}
    cases["Marina is coming"] = "MENTIONED"
    assert {t: one(spark, sy.mention_class, t) for t in cases} == cases


def test_fused_transliterations(spark):
    from loomwork.functions import symbols as sy

    fuse = lambda a, b, heard="": one(spark, lambda x, y, z: sy.fused_transliteration(x, y, z), a, b, heard)
    assert fuse("nikan de", "nika kali tlan") == "nikan kali tlan" and fuse("", "abc") == "abc" and fuse("", "") == ""
    assert fuse("el", "ab") == "ab" and fuse("que", "ab") == "que" and fuse("abc", "abd") == "abc" and fuse("ab", "abd") == "abd"
    assert fuse("neki", "", "n e s k i") == "neizke" and fuse("neke", "", "z k i x") == "nezke" and fuse("ni", "", "ʃ k i") == "nizke" and fuse("neki", "", "s k ia") == "neki"


def test_segments_of_arrays_that_break_off(spark):
    from loomwork.functions import symbols as sy

    read = lambda t: [tuple(x) for x in one(spark, lambda c: sy.recovered_segments(c, 10.0), t)]
    whole = '[{"Start": 1.5, "End": 2, "Speaker": 0, "Content": "a b"}, {"Start time": 3, "End time": 4, "Speaker ID": "x", "Text": "c"}]'
    assert read("ok " + whole + " rest") == [(11.5, 12.0, "0", "a b"), (13.0, 14.0, "x", "c")]
    assert read(whole[:-8]) == [(11.5, 12.0, "0", "a b")] and read("no array") == [] and read('[{"End": 3}]') == []
    loop = " ".join(["one two three four five"] * 4)
    assert read('[{"Start": 0, "Content": "%s"}, {"Start": 1, "Content": "x"}' % loop) == [(11.0, 10.0, "", "x")]


def test_vote_of_two_transcriptions():
    from loomwork.functions.sequences import default_confidences, vote

    assert vote(["a", "b"], [0.1, 0.1], ["a", "c", "d"], [0.1, 0.2, 0.2]) == (["a", "c", "d"], pytest.approx((0.1 + 0.2 + 0.2) / 3))
    assert vote(["a", "b"], [0.3, 0.5], ["a"], [0.6]) == (["a", "b"], pytest.approx(0.55))
    assert vote(["a"], [0.5], ["b"], [0.47]) == (["a"], 0.5) and vote(["a"], [0.5], ["b"], [0.49]) == (["b"], 0.49)
    assert vote([], [], ["b"], [0.9]) == (["b"], 0.0) and vote([], [], [], []) == ([], 0.0)
    assert default_confidences(1.0) == (0.55, 0.38) and default_confidences(0.0) == (pytest.approx(0.7), 0.25) and default_confidences(0.4) == (pytest.approx(0.625), pytest.approx(0.305))


def test_letter_labels_of_any_length(spark):
    from loomwork.operators.runs import letters

    numbers = [0, 25, 26, 51, 52, 701, 702, 18277, 18278, 10**12]
    got = [r.x for r in spark.createDataFrame([(n,) for n in numbers], "i long").select(tx.letter_label(F.col("i")).alias("x")).collect()]
    assert got == [letters(n) for n in numbers] and got[:8] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "ZZZ"]


def test_canonical_symbols_meet_over_bare_marks(spark):
    """A symbol that is only a length mark goes before its neighbours are merged."""
    rows = spark.createDataFrame([(0, ["t", "ː", "l", "a"]), (1, ["k", " ː ", "ʼ", "w"]), (2, ["ː"])], "i int, v array<string>")
    got = rows.orderBy("i").select(sy.canonical(F.col("v"), F.col("i") == 0).alias("x")).collect()
    assert [r.x for r in got] == [["tɬ", "a"], ["kʷ"], []]
