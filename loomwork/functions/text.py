"""Scalar functions on text and symbols.  All are column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ACCENTED, PLAIN = "áàâäãåāéèêëēíìîïīóòôöõōúùûüūñçýÿ", "aaaaaaaeeeeeiiiiioooooouuuuuncyy"
LANGUAGE_CODES = {"es": "spa", "en": "eng", "de": "deu", "fr": "fra", "it": "ita", "pt": "spa", "ca": "spa", "gl": "spa"}
SPANISH_WORDS = ("de", "la", "que", "el", "en", "los", "se", "del", "las", "un", "por", "con", "una", "su", "para", "es", "al", "lo", "como", "esta")
NAHUATL_MARKS = ("tl", "tz", "hu", "cuauh", "quauh", "teotl", "tlatoani", "tenochtitlan", "mexica", "motecuhzoma", "xicotencatl", "tzintli", "itz", "xoch", "coatl")
MAYA_MARKS = ("k'", "ts'", "ch'", "halach", "ajaw", "kukul", "k'uk", "yuum", "uay", "kaax", "balam", "chan", "k'in", "kab")
MAYA_HINT_WORDS = ("ba", "baal", "kes", "kes'", "uchala", "takin", "k'an", "lo'")
MAYA_PATTERNS = ("k'", "ts'", "ch'", "x", "j", "aa", "oo", "uu")
LATIN_WORDS = ("ego", "te", "baptizo", "nomine", "patris", "filii", "spiritus", "sancti", "amen", "dominus", "deus", "pater", "noster", "maria", "gratia")
IPA_SYMBOLS = "ɪɛæɑɔʊəɜɚʌŋθðʃʒɾβɣχʁɴɲɳɻʂʐɕʑɬɮʔɯɨʉɵɤɘɞɐœøɒɶʋɹɰɥʍʜʢɧɦʙʀɺɭɽɢɠɗɓʛʄǃǀǂǁ"
PARAGRAPH_SPANISH = (
    "de", "la", "el", "los", "las", "y", "que", "en", "un", "una", "por", "para", "con", "se", "es", "del", "al", "como", "más", "mas", "su", "sus", "ya", "pero", "si", "sí", "no", "le", "lo", "a", "o", "u",
    "yo", "tu", "tú", "mi", "me", "te", "nos", "vos", "fue", "era", "son", "ser", "ha", "han",
)
PARAGRAPH_FUNCTION = ("in", "yn", "auh", "ca", "nican", "inic", "ye", "amo", "niman", "ompa", "tlaca", "mexica", "tenochtitlan", "teotl", "teochichimeca", "huehuetque")
PARAGRAPH_CLUSTERS = ("tl", "tz", "hu")
PARAGRAPH_STARTS = ("cuauh", "quauh", "teo", "xoch", "tla")
TOPICS = ("Agric", "Botan", "Comid", "Creer", "Cuent", "MatCl", "Medic", "Narra", "Tradi", "Zoolo")
VILLAGES = {"Omitl": "Omitlan", "Tengo": "Tenango", "Tenti": "Tentizapa", "Tepet": "Tepetzintla", "Xmlpa": "Xonamalpan", "Xonot": "Xonotla", "Xtlax": "Xochitlaxco"}
ALLOPHONES = {"g": "ɡ", "ɹ": "ɾ", "ʀ": "ʁ", "tʃ": "tɕ"}


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in entries.items() for x in kv))


def _any(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts))


def strip_accents(text: Column) -> Column:
    """Lower case without the accents of Western European letters."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def strip_modifiers(symbol: Column) -> Column:
    """Without length, aspiration, pharyngeal and ejective marks and combining marks."""
    return F.regexp_replace(symbol, "[ːʲʰˤʼ\\p{Mn}]", "")


def allophone(symbol: Column) -> Column:
    return F.coalesce(_map(ALLOPHONES)[symbol], symbol)


def language_code(code: Column, default: str = "other") -> Column:
    return F.coalesce(_map(LANGUAGE_CODES)[code], F.lit(default))


def confidence_tier(logprob: Column) -> Column:
    return F.when(logprob > -0.3, "HIGH").when(logprob < -0.7, "LOW").otherwise("MEDIUM")


def logprob_confidence(logprob: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (logprob + 2) / 2))


def spanish_orthography(text: Column) -> Column:
    """sh, ts, kw, w and k as Spanish spelling has them; blanks collapse."""
    out = text
    for pattern, to in (("sh", "x"), ("ts", "tz"), ("kw", "cu"), ("w", "hu"), ("k(?=[eiéí])", "qu"), ("k", "c")):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(F.regexp_replace(out, "\\s+", " "))


def clean_espeak(ipa: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(ipa, "[1-5.ˈˌ]", ""), "\\s+", " "))


def without_glosses(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s*\\([^)]+\\)\\s*", " "))


def looks_like_ipa(text: Column) -> Column:
    """Over 30 % phonetic symbols, or three tokens or more, all of two characters or fewer."""
    marks = F.char_length(F.regexp_replace(text, f"[^{IPA_SYMBOLS}]", ""))
    tokens = F.filter(F.split(text, "\\s+"), lambda t: t != "")
    short = (F.size(tokens) >= 3) & F.forall(tokens, lambda t: F.char_length(t) <= 2)
    return F.when(F.coalesce(text, F.lit("")) == "", False).otherwise((marks / F.char_length(text) > 0.3) | short)


def density_class(n: Column, seconds: Column, low: float = 3.0, high: float = 15.0) -> Column:
    return F.when(seconds < 0.3, "SHORT").when(n == 0, "COLLAPSED").when(n / seconds < low, "COLLAPSED").when(n / seconds > high, "HALLUCINATED").otherwise("OK")


def other_script(text: Column) -> Column:
    """Whether a letter is not Latin."""
    return text.rlike("[\\p{L}&&[^\\p{IsLatin}]]")


def words_of(text: Column, pattern: str = "[a-z']+") -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def share_known(text: Column, known, pattern: str = "[a-zA-Z0-9_áéíóúüñÁÉÍÓÚÜÑ]+") -> Column:
    """Share of the words of two letters or more that are known; 1 without any."""
    words = F.transform(F.filter(words_of(text, pattern), lambda w: F.char_length(w) >= 2), strip_accents)
    hits = F.size(F.filter(words, lambda w: w.isin(*known)))
    return F.when(F.size(words) > 0, hits / F.size(words)).otherwise(1.0)


def apostrophe_score(text: Column) -> Column:
    """1 less twice the density of apostrophes over 0.04, from 0 on; counts each twice as its source's outputs do."""
    n = F.char_length(text)
    density = 2 * (n - F.char_length(F.replace(text, F.lit("'"), F.lit("")))) / n
    return F.when(n > 0, 1 - F.least(density / 0.04, F.lit(1.0))).otherwise(1.0)


def letter_score(text: Column) -> Column:
    """Share of the letters that Spanish has; 1 without letters."""
    letters = F.regexp_replace(F.lower(text), "[^\\p{L}]", "")
    own = F.char_length(F.regexp_replace(letters, "[^a-záéíóúüñ]", ""))
    return F.when(F.char_length(letters) > 0, own / F.char_length(letters)).otherwise(1.0)


def repetition_score(text: Column) -> Column:
    """1 over the highest count of a run of three words; 1 for fewer than six words.

    Only where a run comes up again are the runs sorted and counted.
    """
    words = words_of(F.lower(text), "[\\p{L}\\p{N}_]+")
    shifted = F.arrays_zip(words.alias("a"), F.slice(words, 2, F.size(words)).alias("b"), F.slice(words, 3, F.size(words)).alias("c"))
    runs = F.slice(F.transform(shifted, lambda w: F.concat_ws(" ", w["a"], w["b"], w["c"])), 1, F.greatest(F.size(words) - 2, F.lit(0)))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.lit(1).alias("most"))

    def step(a: Column, x: Column) -> Column:
        n = F.when(x == a["last"], a["n"] + 1).otherwise(1)
        return F.struct(x.alias("last"), n.alias("n"), F.greatest(a["most"], n).alias("most"))

    counts = F.aggregate(F.array_sort(runs), start, step, lambda a: a["most"])
    return F.when((F.size(words) >= 6) & (F.size(F.array_distinct(runs)) < F.size(runs)), 1 / counts).otherwise(1.0)


def verdict(lexicon: Column, apostrophe: Column, letters: Column, logprob: Column, repetition: Column) -> tuple[Column, Column]:
    """Reason for which a transcript is doubted (null if it is not), and its confidence."""
    reason = (
        F.when(lexicon < 0.4, "lexicon")
        .when(repetition <= 0.5, "repetition")
        .when((apostrophe < 0.5) & (lexicon < 0.6), "apostrophe")
        .when((letters < 0.7) & (lexicon < 0.6), "letters")
        .when((logprob < 0.3) & (lexicon < 0.7), "logprob")
    )
    return reason, 0.4 * lexicon + 0.15 * apostrophe + 0.15 * letters + 0.15 * logprob + 0.15 * repetition


def latin_matches(text: Column) -> Column:
    """Number of distinct Latin words."""
    return F.size(F.array_intersect(words_of(strip_accents(text), "[a-z]+"), F.array(*map(F.lit, LATIN_WORDS))))


def maya_hint(text: Column) -> Column:
    """Score of spelling that Maya texts have."""
    t = strip_accents(text)
    marks = F.char_length(t) - F.char_length(F.translate(t, "'’", ""))
    score = F.when(marks >= 1, 0.7).otherwise(0.0) + F.when(marks >= 2, 0.4).otherwise(0.0)
    for p in MAYA_PATTERNS:
        score = score + F.when(F.contains(t, F.lit(p)), 0.2).otherwise(0.0)
    hits = F.size(F.filter(words_of(t), lambda w: w.isin(*MAYA_HINT_WORDS)))
    return F.when(F.size(words_of(t)) > 0, score + 0.25 * hits).otherwise(0.0)


def guessed_language(text: Column, asr: Column) -> Column:
    """Language from words and spelling, the recogniser's where these are weak."""
    words = words_of(strip_accents(text))
    n = F.size(words)
    spa = F.size(F.filter(words, lambda w: w.isin(*SPANISH_WORDS)))
    nah = F.size(F.filter(words, lambda w: _any(w, NAHUATL_MARKS)))
    may = F.size(F.filter(words, lambda w: _any(w, MAYA_MARKS)))
    ratio = spa / F.greatest(n, F.lit(1))
    return (
        F.when(n == 0, "other")
        .when(latin_matches(text) >= 3, "lat")
        .when((asr == "es") & (ratio >= 0.25) & (spa >= 2), "spa")
        .when((may >= 2) & (may > nah), "may")
        .when(nah >= 2, "nah")
        .when(asr == "es", "spa")
        .otherwise("other")
    )


def srt_time(ms: Column) -> Column:
    """``HH:MM:SS,mmm`` of whole milliseconds."""
    part = lambda x, n: F.lpad(F.floor(x).cast("string"), n, "0")
    return F.concat(part(ms / 3600000, 2), F.lit(":"), part(ms / 60000 % 60, 2), F.lit(":"), part(ms / 1000 % 60, 2), F.lit(","), part(ms % 1000, 3))


def srt_ms(stamp: Column) -> Column:
    """Milliseconds of ``HH:MM:SS,mmm`` or with a point."""
    part = lambda i: F.regexp_extract(stamp, "(\\d+):(\\d+):(\\d+)[,.](\\d+)", i).cast("long")
    return part(1) * 3600000 + part(2) * 60000 + part(3) * 1000 + part(4)


def paragraph_score(text: Column) -> Column:
    """How much a paragraph looks like Nahuatl: its function words and letter clusters, less the share of Spanish words; 0 below five words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-záéíóúüñç'\\-]+"), F.lit(0))
    words = F.filter(F.transform(found, lambda w: F.regexp_replace(w, "^'+|'+$", "")), lambda w: w != "")
    flag = lambda c: c.cast("int")
    clusters = lambda w: sum((flag(F.contains(w, F.lit(c))) for c in PARAGRAPH_CLUSTERS), flag(w.rlike(f"^({'|'.join(PARAGRAPH_STARTS)})")) + 2 * flag(F.endswith(w, F.lit("tzin"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("spanish"), F.lit(0).alias("function"), F.lit(0).alias("clusters"))
    step = lambda a, w: F.struct((a["n"] + 1).alias("n"), (a["spanish"] + flag(w.isin(*PARAGRAPH_SPANISH))).alias("spanish"), (a["function"] + flag(w.isin(*PARAGRAPH_FUNCTION))).alias("function"), (a["clusters"] + clusters(w)).alias("clusters"))
    score = lambda a: F.when(a["n"] < 5, 0.0).otherwise(a["function"] * 2.0 + a["clusters"] * 0.6 - a["spanish"] / a["n"] * 6.0 + F.least(a["n"], F.lit(30)) * 0.03)
    return F.coalesce(F.aggregate(words, zero, step, score), F.lit(0.0))


def recording_name(name: Column) -> Column:
    """A struct of a recording's ``topic``, ``village`` and ``speakers`` from its file name; ``Unknown`` where there is none."""
    topic = F.nullif(F.regexp_extract(name, f"_({'|'.join(TOPICS)})_", 1), F.lit(""))
    village = F.nullif(F.regexp_extract(name, f"(?:^|_)({'|'.join(VILLAGES)})_", 1), F.lit(""))
    speakers = F.regexp_extract_all(name, F.lit("(?<![A-Za-z])([A-Z]{2,4}\\d{3,4})(?![A-Za-z])"), F.lit(1))
    return F.struct(F.coalesce(topic, F.lit("Unknown")).alias("topic"), F.coalesce(_map(VILLAGES)[village], F.lit("Unknown")).alias("village"), speakers.alias("speakers"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip_accents(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def letter_label(i: Column) -> Column:
    """A to Z, then AA, AB and so on, of whole numbers of any size."""
    start = F.struct(F.lit("").alias("label"), i.cast("long").alias("rest"))

    def step(a: Column, _: Column) -> Column:
        more = a["rest"] >= 0
        label = F.when(more, F.concat(F.char(65 + a["rest"] % 26), a["label"])).otherwise(a["label"])
        return F.struct(label.alias("label"), F.when(more, F.floor(a["rest"] / 26).cast("long") - 1).otherwise(a["rest"]).alias("rest"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda a: a["label"])  # letters of the largest long


def first_of(*texts: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in texts))


def expectation(text: Column, present: list[str], absent: list[str]) -> Column:
    """All of some patterns and none of others, in any case."""
    yes = reduce(lambda a, b: a & b, (text.rlike(f"(?i){p}") for p in present), F.lit(True))
    return reduce(lambda a, b: a & b, (~text.rlike(f"(?i){p}") for p in absent), yes)


def marked_ejectives(ipa: Column, most: Column) -> Column:
    """An ejective mark after each of the first ``most`` stops."""
    stops = F.array(*(F.lit(x) for x in ("k", "t", "p", "ts", "tʃ", "tɕ")))
    state = F.aggregate(
        F.split(ipa, " "),
        F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out")),
        lambda a, x: F.struct(
            F.when((a["n"] < most) & F.array_contains(stops, x), a["n"] + 1).otherwise(a["n"]).alias("n"),
            F.concat(a["out"], F.array(F.when((a["n"] < most) & F.array_contains(stops, x), F.concat(x, F.lit("ʼ"))).otherwise(x))).alias("out"),
        ),
    )
    return F.array_join(state["out"], " ")


def longest_first(text: Column, rules: dict[str, str]) -> Column:
    """Symbols of the longest rules that fit from left to right; characters without a rule are skipped."""
    import re

    keys = sorted(rules, key=lambda k: (-len(k), k))
    found = F.regexp_extract_all(F.lower(text), F.lit("|".join(map(re.escape, keys))), F.lit(0))
    return F.flatten(F.transform(found, lambda x: F.split(_map(rules)[x], " ")))
