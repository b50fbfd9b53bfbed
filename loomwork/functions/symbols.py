"""Rules on phonetic symbols and transcripts, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.text import _map, strip_modifiers

# Symbols that count as another, Nahuatl onsets, word forms, clusters, cues and patterns.
EQUIVALENT = {"t͡ɕ": "tʃ", "tɕ": "tʃ", "tʂ": "tʃ", "t͡ʃ": "tʃ", "ɕ": "ʃ", "ʂ": "ʃ", "k̟ʲ": "kʷ", "kw": "kʷ", "ð": "d", "β": "b", "ɣ": "ɡ", "ɸ": "f", "ɻ": "ɾ", "r": "ɾ", "g": "ɡ"}
ONSETS = ("tɬ", "ts", "tʃ", "kʷ")
NAHUATL_FORMS = (
    "nik[aeiou]|tik[aeiou]|mik[aeiou]|tict|ticm|ticn|nicn|nicm|nict|ichi|pil|neci|mati|caci|pano|mict|tequi|chiua|cipac|mani|tonan|nican|tlaco|acal|cali|ichan|ipan|ican"
    "|isti|lis|ilia|ilis|teca|tlaca|xica|naca|meca|titec|teka|tlaka|xika|naka|meka|titek|iske|isce|monec|monek|oneki|oneci|otl|utl|pach"
)
SPANISH_CLUSTERS = "[bcdfgp][rl]|str|ntr"
FUSION_STOPWORDS = ("de", "del", "la", "el", "y", "que", "en", "por", "para", "con", "no", "es", "un", "una")
FUSION_CUES = ("tl", "tz", "hu", "qu", "cu", "x", "z", "k", "tlan", "meh")
ADDRESSED = ("^{name}[.,!?]?\\s*$", "{name}[,!]?\\s*(come|go|tell|translate|help|lend|no)", "(talk to|translate,|don't be afraid,)\\s*{name}", "what about {name}", "where is {name}")
MENTIONED = ("{name} is (coming|here|the most)", "(was that|about) {name}", "accompanies {name}", "name will be {name}")

_ALONE = "(?<![^ ]){}(?![^ ])"  # a whole symbol among symbols joined by blanks


def _merged(symbols: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    joined = reduce(lambda t, p: F.regexp_replace(t, _ALONE.format(p[0]), p[1]), pairs, F.array_join(symbols, " "))
    return F.filter(F.split(joined, " "), lambda x: x != "")


def canonical(symbols: Column, lateral: Column) -> Column:
    """Symbols without modifiers, by their equivalents; k w becomes one, t l only where ``lateral`` says so; blank ones go."""
    plain = F.filter(F.transform(symbols, lambda x: strip_modifiers(F.trim(x))), lambda x: x != "")
    plain = F.transform(plain, lambda x: F.coalesce(_map(EQUIVALENT)[x], x))
    return F.when(lateral, _merged(plain, [("k w", "kʷ"), ("t l", "tɬ")])).otherwise(_merged(plain, [("k w", "kʷ")]))


def split_onsets(symbols: Column) -> Column:
    """Onsets written together with vowels are taken apart, and a vowel takes the length mark after it."""
    pattern = f"^({'|'.join(ONSETS)})([aeiou]+)$"
    apart = lambda x: F.when(
        x.rlike(pattern), F.concat(F.array(F.regexp_extract(x, pattern, 1)), F.regexp_extract_all(F.regexp_extract(x, pattern, 2), F.lit("[aeiou]"), F.lit(0)))
    ).otherwise(F.array(x))
    return _merged(F.flatten(F.transform(symbols, apart)), [("([aeiou]) ː", "$1ː")])


def nahuatl_form_score(text: Column, words: Sequence[str]) -> Column:
    """0.35 for a known word of five letters or more in the text, else 0.2 for one of four; 0.15 for each Nahuatl form up to 0.3, less 0.2 for each Spanish cluster.

    Texts under four characters have none (null).
    """
    t = F.lower(text)
    has = lambda xs: reduce(lambda a, b: a | b, (F.contains(t, F.lit(w)) for w in xs), F.lit(False))
    known = F.when(has([w for w in words if len(w) >= 5]), 0.35).when(has([w for w in words if len(w) == 4]), 0.2).otherwise(0.0)
    forms = F.least(F.lit(0.3), F.regexp_count(t, F.lit(NAHUATL_FORMS)) * 0.15)
    return F.when(F.char_length(t) >= 4, known + forms - 0.2 * F.regexp_count(t, F.lit(SPANISH_CLUSTERS)))


def has_nahuatl_forms(text: Column, words: Sequence[str]) -> Column:
    return F.coalesce(nahuatl_form_score(text, words) >= 0.15 - 1e-9, F.lit(False))


def mention_class(text: Column, name: str = "marina", titles: Sequence[str] = ("malinche", "malintzin")) -> Column:
    """Whether a line speaks to a person, mentions or is spoken by them: the first kind of pattern that fits, in this order."""
    t = F.lower(text)
    any_of = lambda patterns: reduce(lambda a, b: a | b, (t.rlike(p.format(name=name)) for p in patterns), F.lit(False))
    called = reduce(lambda a, b: a | b, (F.contains(t, F.lit(name + c)) for c in "!?,"))
    return (
        F.when(any_of(ADDRESSED), "SPEAKS_TO")
        .when(any_of([*MENTIONED, *titles]), "MENTIONED")
        .when(F.startswith(text, F.lit("- ")) & F.contains(F.substring(t, 1, 20), F.lit(name)), "SPOKEN_BY")
        .when(F.contains(t, F.lit(name)) & ~called, "MENTIONED")
        .otherwise("SPEAKS_TO")
    )


def word_score(word: Column) -> Column:
    """How much a word looks like Nahuatl: cues and length for it, Spanish function words against it."""
    w = F.lower(word)
    score = F.when(w.isin(*FUSION_STOPWORDS), -0.3).otherwise(0.0) + F.when(F.char_length(w) >= 6, 0.1).otherwise(0.0)
    return reduce(lambda s, c: s + F.when(F.contains(w, F.lit(c)), 0.25).otherwise(0.0), FUSION_CUES, score)


def with_recovered_suffix(text: Column, symbols: Column, spanish: bool = False) -> Column:
    """The last word's ending -zke where the symbols of both recognisers have a sibilant, k and i at the end of a word."""
    heard = F.lower(symbols).rlike("(s|z|ʃ)\\s*k\\s*i(?![\\p{L}\\p{N}_])")
    words = F.filter(F.split(text, "\\s+"), lambda x: x != "")
    last = F.element_at(words, -1)
    low, tail = F.lower(last), "zque" if spanish else "zke"
    last = (
        F.when(F.endswith(low, F.lit("ki")), F.regexp_replace(last, "(?i)ki$", "i" + tail))
        .when(F.endswith(low, F.lit("ke")), F.regexp_replace(last, "(?i)ke$", tail))
        .when(F.endswith(low, F.lit("i")), F.concat(last, F.lit(tail)))
        .otherwise(last)
    )
    whole = F.array_join(F.concat(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.array(last)), " ")
    return F.when(F.size(words) == 0, F.lit("")).when(heard, whole).otherwise(F.array_join(words, " "))


def fused_transliteration(first: Column, second: Column, symbols: Column, spanish: bool = False) -> Column:
    """Word by word the one of two transliterations that looks more like Nahuatl, by over 0.05, else the longer, the first on ties; then its suffix."""
    split = lambda t: F.filter(F.split(F.coalesce(t, F.lit("")), "\\s+"), lambda x: x != "")
    pairs = F.arrays_zip(split(first).alias("a"), split(second).alias("b"))

    def better(p: Column) -> Column:
        a, b = p["a"], p["b"]
        ahead = word_score(a) - word_score(b)
        return F.when(a.isNull(), b).when(b.isNull(), a).when(ahead < -0.05 - 1e-9, b).when(ahead > 0.05 + 1e-9, a).when(F.char_length(a) >= F.char_length(b), a).otherwise(b)

    return with_recovered_suffix(F.array_join(F.transform(pairs, better), " "), symbols, spanish)


def recovered_segments(text: Column, offset: Column | float = 0.0) -> Column:
    """``array<struct<start, end, speaker, text>>``: the flat objects of an array of segments in a model's output, also of one that breaks off.

    Keys go by several names.  What is no whole object with a start is left out, as is a text of over
    15 words whose first five come up three times.
    """
    at = F.instr(text, "[{")
    objects = F.regexp_extract_all(F.when(at > 0, F.substring(text, at, F.char_length(text))).otherwise(""), F.lit("\\{[^{}]+\\}"), F.lit(0))
    names = "Start DOUBLE, `Start time` DOUBLE, End DOUBLE, `End time` DOUBLE, Speaker STRING, `Speaker ID` STRING, Content STRING, Text STRING"
    read = F.transform(objects, lambda x: F.from_json(x, names))
    begun = F.filter(read, lambda s: F.coalesce(s["Start"], s["Start time"]).isNotNull())
    first = lambda s, *keys: F.coalesce(*(s[k] for k in keys))
    named = F.transform(
        begun,
        lambda s: F.struct(
            (first(s, "Start", "Start time") + offset).alias("start"),
            (F.coalesce(s["End"], s["End time"], F.lit(0.0)) + offset).alias("end"),
            F.coalesce(s["Speaker"], s["Speaker ID"], F.lit("")).alias("speaker"),
            F.coalesce(s["Content"], s["Text"], F.lit("")).alias("text"),
        ),
    )

    def loops(s: Column) -> Column:
        words = F.filter(F.split(s["text"], "\\s+"), lambda w: w != "")
        opening = F.array_join(F.slice(words, 1, 5), " ")
        times = (F.char_length(s["text"]) - F.char_length(F.replace(s["text"], opening, F.lit("")))) / F.char_length(opening)
        return (F.size(words) > 15) & (times >= 3)

    return F.filter(named, lambda s: ~loops(s))
