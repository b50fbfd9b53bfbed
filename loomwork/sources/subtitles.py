"""Subtitle files, annotation exports, corpora and lexicons as DataFrames, and back.

Texts are parsed as columns (whole files come from ``spark.read.text(...,
wholetext=True)``), so that readers run where the files are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.text import srt_ms, srt_time

# Fixed values.
ALIASES = {"esp": "spa", "ger": "deu"}
SOURCE_MARKS = ("FT", "LLM", "IPA", "REC", "UNC")
LANGUAGE_NAMES = {"nahuatl": "nah", "español": "spa", "other": "oth", "silence": "sil"}
REPORT_NAMES = {**LANGUAGE_NAMES, "spanish": "spa", "english": "eng"}
NAHUATL_SYMBOLS = ("ts", "tɬ", "kʷ", "tʃʼ", "kʼ", "tɕ")
EJECTIVES = ("kʼ", "tʼ", "tsʼ", "tʃʼ", "pʼ")
TEXT_COLUMNS = ("text", "sentence", "transcription", "transcript")
AUDIO_COLUMNS = ("path", "audio", "audio_file", "file")
SPEAKER_COLUMNS = ("speaker", "client_id", "speaker_id")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, value)``: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def _tag_part(tag: Column, i: int) -> Column:
    return F.get(F.split(tag, "\\s*\\|\\s*"), F.lit(i))


def cues(files: DataFrame, text: str = "value", keys: Sequence[str] = ("path",), least_lines: int = 3, default: str = "oth", blank: str = "\\n\\s*\\n") -> DataFrame:
    """``(keys, cue, s, e, lang, speaker, stem, mark, conf, ipa, body)`` of subtitle texts.

    Blocks of fewer lines than ``least_lines`` or without a whole number first are
    left out; of cues with one number the last counts.  The language is the tag's first part,
    lower-cased, aliases resolved, ``default`` without a tag.  Lines after ♫ are
    no body; of these, fused symbols and the confidence are read.
    """
    blocks = files.select(*keys, F.posexplode(F.split(F.regexp_replace(F.col(text), "\\r", ""), blank)).alias("i", "block"))
    lines = F.filter(F.split(F.trim(F.col("block")), "\\n"), lambda x: F.trim(x) != "")
    rows = blocks.withColumn("lines", lines).where((F.size("lines") >= least_lines) & F.get("lines", F.lit(0)).rlike("^\\s*-?\\d+\\s*$"))
    body = F.array_join(F.filter(F.slice("lines", 3, F.size("lines")), lambda x: ~F.contains(x, F.lit("♫"))), " ")
    rows = rows.select(*keys, "i", F.trim(F.get("lines", F.lit(0))).cast("long").alias("cue"), F.get("lines", F.lit(1)).alias("time"), body.alias("raw"), "block")
    tag = F.regexp_extract("raw", "\\[([^\\]]+)\\]", 1)
    lang = F.lower(_tag_part(tag, 0))
    for a, b in ALIASES.items():
        lang = F.when(lang == a, b).otherwise(lang)
    mark = F.lit("whisper")
    for m in reversed(SOURCE_MARKS):
        mark = F.when(F.contains("raw", F.lit(f"[{m}]")), m).otherwise(mark)
    rows = rows.select(
        *keys, "i", "cue",
        srt_ms(F.regexp_extract("time", "^(\\S+)", 1)).alias("s"), srt_ms(F.regexp_extract("time", "-->\\s*(\\S+)", 1)).alias("e"),
        F.when(tag == "", default).otherwise(lang).alias("lang"),
        F.nullif(F.regexp_extract(tag, "(SPEAKER_\\d+)", 1), F.lit("")).alias("speaker"), F.nullif(F.regexp_extract(tag, "(STEM_\\w+)", 1), F.lit("")).alias("stem"),
        mark.alias("mark"), F.nullif(F.regexp_extract("block", "♫conf:\\s*([0-9.]+)", 1), F.lit("")).cast("double").alias("conf"),
        F.split(F.nullif(F.regexp_extract("block", "♫fused:\\s*([^\\n]*)", 1), F.lit("")), " ").alias("ipa"),
        F.trim(F.regexp_replace("raw", "\\[[^\\]]*\\]", "")).alias("body"),
    )
    last = F.max_by(F.struct(*(c for c in rows.columns if c not in (*keys, "cue", "i"))), "i")
    return rows.groupBy(*keys, "cue").agg(last.alias("m")).select(*keys, "cue", "m.*")


def _blocks(files: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """``(keys, i, cue, start_s, end_s, lines)`` of blocks with a whole number, and times of full length below it."""
    stamp = "\\d{2}:\\d{2}:\\d{2}[,.]\\d{3}"
    stripped = lambda c: F.regexp_replace(c, "^\\s+|\\s+$", "")
    plain = stripped(F.regexp_replace(F.col(text), "\\r\\n?", "\n"))
    rows = files.select(*keys, F.posexplode(F.split(plain, "\\n\\n+")).alias("i", "block")).withColumn("lines", F.split(stripped(F.col("block")), "\\n", -1))
    line = lambda i: F.coalesce(F.get("lines", F.lit(i)), F.lit(""))
    rows = rows.where(line(0).rlike("^\\s*[+-]?\\d+\\s*$") & line(1).rlike(f"^{stamp}\\s*-->\\s*{stamp}"))
    time = lambda pattern: srt_ms(F.regexp_extract(line(1), pattern, 1)) / 1000.0
    return rows.select(*keys, "i", F.trim(line(0)).cast("long").alias("cue"), time(f"^({stamp})").alias("start_s"), time(f"-->\\s*({stamp})").alias("end_s"), "lines")


def annotated_cues(files: DataFrame, text: str = "value", keys: Sequence[str] = ("path",)) -> DataFrame:
    """``(keys, i, cue, start_s, end_s, text, lang, speaker, stem, ipa, confidence, raw)`` of annotators' subtitles, in order ``i``.

    The tag, first in the text, is ``[LANG|SPEAKER_n|STEM_x]``; speaker and stem are else taken from anywhere in the
    text.  Lines after ♫ and what follows ``[LLM]`` on a line are no text.  What is missing is null.
    """
    rows = _blocks(files, text, keys).withColumn("raw", F.array_join(F.slice("lines", 3, F.size("lines")), "\n"))
    found = lambda c, pattern, group=0: F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))
    parts = F.filter(F.transform(F.split(F.regexp_extract("raw", "^\\[([^\\]]+)\\]", 1), "\\|"), lambda p: F.trim(p)), lambda p: p != "")
    rows = rows.withColumn("_parts", parts)
    named = lambda pattern: F.get(F.filter(F.slice("_parts", 2, F.greatest(F.size("_parts"), F.lit(1))), lambda p: p.rlike(f"^{pattern}$")), F.lit(0))
    anywhere = lambda pattern: F.coalesce(named(pattern), found("raw", pattern))
    body = F.regexp_replace(F.regexp_replace("raw", "♫[^\\n]+\\n?", ""), "\\[LLM\\][^\\n]+\\n?", "")
    return rows.select(
        *keys, "i", "cue", "start_s", "end_s", F.regexp_replace(body, "^\\s+|\\s+$", "").alias("text"), found(F.get("_parts", F.lit(0)), "\\b([A-Z]{3})\\b", 1).alias("lang"),
        anywhere("SPEAKER_\\d+").alias("speaker"), anywhere("STEM_[A-Z0-9_+-]+").alias("stem"), F.trim(found("raw", "♫fused:\\s*([^\\n]+)", 1)).alias("ipa"),
        F.expr("try_cast(nullif(regexp_extract(raw, '(?i)conf[:\\\\s]+([0-9.]+)', 1), '') AS DOUBLE)").alias("confidence"), "raw",
    )


def rich_cues(files: DataFrame, text: str = "value", keys: Sequence[str] = ("path",)) -> DataFrame:
    """``(keys, i, cue, start_s, end_s, duration, speaker, lang, text, source, ipa_allo, ipa_w2v2, ipa_fused, trim, conf, nah_markers, ejectives)``.

    Subtitles with three streams of symbols: the third line is tag and text, ♫ lines below it name their kind, and the last
    of a kind counts (empty without one).  Without a tag the language is ``oth`` and the speaker ``?``.  The first
    source mark, in the order of ``SOURCE_MARKS``, is taken out of the text; without one the source is ``whisper``.
    """
    rows = _blocks(files, text, keys).withColumn("_line", F.coalesce(F.get("lines", F.lit(2)), F.lit("")))
    tag = "(?U)^\\[(\\w+)\\|([^\\]]+)\\]\\s*(.*)"
    tagged, part = F.col("_line").rlike(tag), lambda g: F.regexp_extract("_line", tag, g)
    said = F.when(tagged, part(3)).otherwise(F.col("_line"))
    lang = F.lower(part(1))
    for name, code in LANGUAGE_NAMES.items():
        lang = F.when(lang == name, code).otherwise(lang)
    rows = rows.withColumns({"_said": said, "lang": F.when(tagged, lang).otherwise("oth"), "speaker": F.when(tagged, part(2)).otherwise("?")})
    source, body = F.lit("whisper"), F.col("_said")
    for m in reversed(SOURCE_MARKS):
        there = F.contains("_said", F.lit(f"[{m}]"))
        source, body = F.when(there, m.lower()).otherwise(source), F.when(there, F.trim(F.replace("_said", F.lit(f"[{m}]"), F.lit("")))).otherwise(body)
    notes = lambda kind: F.filter(F.slice("lines", 4, F.size("lines")), lambda x: F.startswith(x, F.lit(f"♫{kind}:")))
    last = lambda kind: F.coalesce(F.trim(F.substr(F.get(notes(kind), F.size(notes(kind)) - 1), F.lit(len(kind) + 3))), F.lit(""))
    rows = rows.withColumns({"source": source, "text": body, **{name: last(kind) for name, kind in (("ipa_allo", "allo"), ("ipa_w2v2", "w2v2"), ("ipa_fused", "fused"), ("trim", "trim"), ("conf", "conf"))}})
    marks = lambda known: F.array_sort(F.array_intersect(F.split("ipa_fused", "\\s+"), F.array(*map(F.lit, known))))
    return rows.select(
        *keys, "i", "cue", "start_s", "end_s", F.round(F.col("end_s") - F.col("start_s"), 2).alias("duration"), "speaker", "lang", "text", "source", "ipa_allo", "ipa_w2v2", "ipa_fused", "trim", "conf",
        marks(NAHUATL_SYMBOLS).alias("nah_markers"), marks(EJECTIVES).alias("ejectives"),
    )


def cue_blocks(rows: DataFrame, number: Column) -> Column:
    """One subtitle block: number, times, tag and text, and a confidence line."""
    tag = F.concat(F.lit("["), F.upper("lang"), F.coalesce(F.concat(F.lit("|"), F.col("speaker")), F.lit("")), F.lit("] "))
    conf = F.concat(F.lit("\n♫conf: "), F.col("conf").cast("string")) if "conf" in rows.columns else F.lit("")
    return F.concat(number.cast("string"), F.lit("\n"), srt_time(F.col("s")), F.lit(" --> "), srt_time(F.col("e")), F.lit("\n"), tag, F.coalesce("text", F.lit("")), F.coalesce(conf, F.lit("")))


def subtitle_texts(rows: DataFrame, keys: Sequence[str] = ("media",), order: Sequence[str] = ("s", "pos")) -> DataFrame:
    """``(keys, value)``: a subtitle file of each key, numbered from 1 in order."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    blocks = rows.withColumn("_n", n).withColumn("_block", cue_blocks(rows, F.col("_n")))
    return blocks.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_block"))), lambda x: x["_block"]), "\n\n").alias("value"))


def write_subtitles(rows: DataFrame, path: str, keys: Sequence[str] = ("media",), order: Sequence[str] = ("s", "pos")) -> None:
    """A folder for each key, with one text file in it."""
    subtitle_texts(rows, keys, order).write.mode("overwrite").partitionBy(*keys).text(path)


def retagged(text: Column, changes: dict[str, str]) -> Column:
    """Subtitle text with other language tags."""
    for old, new in changes.items():
        text = F.regexp_replace(text, f"\\[{old}(\\||\\])", f"[{new}$1")
    return text


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """``(cue, lang, s, e)`` of either kind of truth file: exported rows, or an object with segments that are done, numbered from 1 before that."""
    raw = spark.read.json(path, multiLine=True)
    if "segments" in raw.columns:
        rows = raw.select(F.posexplode("segments").alias("i", "x")).where("x.done")
        return rows.select((F.col("i") + 1).cast("long").alias("cue"), F.lower("x.lang").alias("lang"), F.col("x.start").alias("s"), F.col("x.end").alias("e"))
    return raw.where("cue_index IS NOT NULL AND coalesce(correct_lang, '') <> ''").select(F.col("cue_index").cast("long").alias("cue"), F.lower("correct_lang").alias("lang"), F.col("start_s").alias("s"), F.col("end_s").alias("e"))


def first_column(columns: Sequence[str], wanted: Sequence[str]) -> str | None:
    """The first wanted name that is there, in any case."""
    have = {c.lower(): c for c in columns}
    return next((have[w] for w in wanted if w in have), None)


def corpus_table(spark: SparkSession, path: str) -> DataFrame:
    """``(text, audio, speaker)`` of a tab-separated corpus whose columns go by several names; rows without text or audio go."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="")
    text, audio, speaker = (first_column(raw.columns, w) for w in (TEXT_COLUMNS, AUDIO_COLUMNS, SPEAKER_COLUMNS))
    if text is None or audio is None:
        raise ValueError(f"no text or audio column in {raw.columns}")
    return raw.select(F.trim(text).alias("text"), F.trim(audio).alias("audio"), (F.col(speaker) if speaker else F.lit(None).cast("string")).alias("speaker")).where("text <> '' AND audio <> ''")


def manifest(texts: DataFrame, segments: DataFrame) -> DataFrame:
    """Utterances with their times where the segments table has them."""
    return texts.join(segments, "utt_id", "left")


def transcriber_turns(xml: DataFrame, text: str = "value", keys: Sequence[str] = ("path",)) -> DataFrame:
    """``(keys, turn, speaker, s, e)`` of Transcriber files, and ``sections`` ends through ``transcriber_length``."""
    schema = "Episode STRUCT<Section: ARRAY<STRUCT<_endTime: DOUBLE, Turn: ARRAY<STRUCT<_speaker: STRING, _startTime: DOUBLE, _endTime: DOUBLE>>>>>"
    rows = xml.select(*keys, F.from_xml(text, schema).alias("x")).select(*keys, F.posexplode(F.flatten(F.col("x.Episode.Section.Turn"))).alias("turn", "t"))
    return rows.select(*keys, "turn", F.col("t._speaker").alias("speaker"), F.col("t._startTime").alias("s"), F.col("t._endTime").alias("e"))


def transcriber_length(xml: DataFrame, text: str = "value", keys: Sequence[str] = ("path",)) -> DataFrame:
    """``(keys, duration, n_turns)``: the last section's end and the number of turns."""
    ends = F.transform(F.expr(f"xpath({text}, '//Section/@endTime')"), lambda x: x.cast("double"))
    return xml.select(*keys, F.array_max(ends).alias("duration"), F.size(F.expr(f"xpath({text}, '//Turn/@startTime')")).alias("n_turns"))


def elan_annotations(xml: DataFrame, text: str = "value", keys: Sequence[str] = ("path",)) -> DataFrame:
    """``(keys, tier, s, e, value)`` of ELAN files: annotations joined with their time slots; translation tiers are left out."""
    schema = "TIME_ORDER STRUCT<TIME_SLOT: ARRAY<STRUCT<_TIME_SLOT_ID: STRING, _TIME_VALUE: BIGINT>>>, TIER ARRAY<STRUCT<_TIER_ID: STRING, ANNOTATION: ARRAY<STRUCT<ALIGNABLE_ANNOTATION: STRUCT<_TIME_SLOT_REF1: STRING, _TIME_SLOT_REF2: STRING, ANNOTATION_VALUE: STRING>>>>>"
    x = xml.select(*keys, F.from_xml(text, schema).alias("x"))
    slots = x.select(*keys, F.explode("x.TIME_ORDER.TIME_SLOT").alias("s")).select(*keys, F.col("s._TIME_SLOT_ID").alias("slot"), F.col("s._TIME_VALUE").alias("ms"))
    tiers = x.select(*keys, F.explode("x.TIER").alias("t")).where(~F.lower("t._TIER_ID").rlike("transl|traducc"))
    rows = tiers.select(*keys, F.col("t._TIER_ID").alias("tier"), F.explode("t.ANNOTATION.ALIGNABLE_ANNOTATION").alias("a")).select(*keys, "tier", F.col("a._TIME_SLOT_REF1").alias("r1"), F.col("a._TIME_SLOT_REF2").alias("r2"), F.col("a.ANNOTATION_VALUE").alias("value"))
    begin, end = slots.select(*keys, F.col("slot").alias("r1"), F.col("ms").alias("s")), slots.select(*keys, F.col("slot").alias("r2"), F.col("ms").alias("e"))
    return rows.join(begin, [*keys, "r1"]).join(end, [*keys, "r2"]).select(*keys, "tier", "s", "e", "value")


def paragraphs(text: Column) -> Column:
    """Runs of lines that are not blank, each joined by spaces."""
    parts = F.split(text, "\\n[ \\t]*(?:\\n[ \\t]*)+")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, "\\s*\\n\\s*", " "))), lambda p: p != "")


def inventories(rows: DataFrame, iso: str, phoneme: str, wanted: Sequence[str] | None = None) -> DataFrame:
    """``(iso, phonemes)``: the set of each language's phonemes, sorted."""
    rows = rows.select(F.lower(F.trim(iso)).alias("iso"), F.trim(phoneme).alias("p"))
    if wanted:
        rows = rows.where(F.col("iso").isin(*wanted))
    return rows.groupBy("iso").agg(F.array_sort(F.collect_set("p")).alias("phonemes"))


def nested(parents: DataFrame, children: DataFrame, key: str, name: str = "children") -> DataFrame:
    """Parents with their children as an array of structs, empty where there are none, for one JSON object a line."""
    others = [c for c in children.columns if c != key]
    rows = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*others))).alias(name))
    empty = F.array().cast(rows.schema[name].dataType)
    return parents.join(rows, key, "left").withColumn(name, F.coalesce(name, empty))


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows over old ones with the same key; a null in the new row leaves the old value."""
    fields = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in fields if c in new.columns))
    joined = old.join(n, list(keys), "full_outer")
    return joined.select(*keys, *((F.coalesce(f"_n_{c}", c) if c in new.columns else F.col(c)).alias(c) for c in fields))


def exported(rows: DataFrame, path: str, columns: Sequence[str], partition: str) -> DataFrame:
    """Writes the allowed columns as JSON, a folder for each partition, and returns the counts of a manifest."""
    safe = rows.select(*dict.fromkeys([partition, *columns]))
    safe.write.mode("overwrite").partitionBy(partition).json(path)
    return safe.groupBy(partition).agg(F.count("*").alias("n"))


def segment_manifests(rows: DataFrame, keys: Sequence[str] = ("media",), order: Sequence[str] = ("s", "pos")) -> DataFrame:
    """``(keys, value)``: a JSON manifest of each recording's segments ``(s, e)`` in milliseconds, with their number and length in all."""
    one = F.struct(*order, F.struct(F.col("s").alias("start_ms"), F.col("e").alias("end_ms"), (F.col("e") - F.col("s")).alias("duration_ms")).alias("_x"))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("segment_count"), F.sum(F.col("e") - F.col("s")).alias("total_speech_ms"), F.array_sort(F.collect_list(one)).alias("_all"))
    whole = F.struct(F.lit("1.0").alias("version"), "segment_count", "total_speech_ms", F.transform("_all", lambda x: x["_x"]).alias("segments"))
    return sums.select(*keys, F.to_json(whole).alias("value"))


def write_manifests(rows: DataFrame, path: str, keys: Sequence[str] = ("media",), order: Sequence[str] = ("s", "pos")) -> None:
    """A folder for each recording, with one manifest in it."""
    segment_manifests(rows, keys, order).write.mode("overwrite").partitionBy(*keys).text(path)


def truth_snapshot(annotations: DataFrame, keys: Sequence[str] = ("media",)) -> DataFrame:
    """``(keys, cue_index, correct_lang, correct_speaker, start_s, end_s)`` of annotations with a language: what a snapshot holds."""
    return annotations.where("coalesce(correct_lang, '') <> ''").select(*keys, "cue_index", "correct_lang", "correct_speaker", "start_s", "end_s")


def report_language(text: Column) -> Column:
    """The language of a cue's tag in lower case, names as codes; ``oth`` without a tag."""
    code = F.lower(F.regexp_extract(text, "(?U)^\\[(\\w+)(?:\\|[^\\]]+)?\\]", 1))
    names = F.create_map(*(F.lit(x) for kv in REPORT_NAMES.items() for x in kv))
    return F.when(code == "", "oth").otherwise(F.coalesce(names[code], code))


def snapshot_report(truth: DataFrame, predicted: DataFrame, keys: Sequence[str] = ("media",)) -> DataFrame:
    """A row for each subset ``keys`` of a snapshot's rows against predictions ``(keys, cue_index, lang)``; unpredicted rows do not count.

    ``total`` and ``unk`` count rows; shares, rounded to four places and null where nothing counts, are of all rows, of those
    whose truth is known, of Nahuatl and Spanish ones, and of Nahuatl against the rest with its precision and
    recall (0 where nothing counts). ``confusion`` lists (truth, prediction, n) of known ones.
    """
    gt, pred = F.col("gt"), F.col("pred")
    rows = truth.select(*keys, "cue_index", F.lower("correct_lang").alias("gt")).join(predicted.select(*keys, "cue_index", F.col("lang").alias("pred")).where("lang IS NOT NULL"), [*keys, "cue_index"])
    pairs = rows.groupBy(*keys, "gt", "pred").agg(F.count("*").alias("n"))
    of = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    share = lambda hit, cond: F.round(of(cond & hit) / F.nullif(of(cond), F.lit(0)), 4)
    known, right, nah = gt != "unk", gt == pred, (gt == "nah") == (pred == "nah")
    cells = F.array_sort(F.collect_list(F.when(known, F.struct("gt", "pred", "n"))))
    return pairs.groupBy(*keys).agg(
        F.sum("n").alias("total"), of(~known).alias("unk"), share(right, F.lit(True)).alias("accuracy_all"), share(right, known).alias("accuracy_known"), share(right, gt.isin("nah", "spa")).alias("accuracy_two"),
        share(nah, known).alias("accuracy_nah"), F.coalesce(share(gt == "nah", known & (pred == "nah")), F.lit(0.0)).alias("nah_precision"), F.coalesce(share(pred == "nah", known & (gt == "nah")), F.lit(0.0)).alias("nah_recall"), cells.alias("confusion"),
    )
