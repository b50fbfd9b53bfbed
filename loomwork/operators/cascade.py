"""Decision cascades over rows with several kinds of evidence; every decision keeps its provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _decided(lang: Column | str, conf: Column | float, source: str) -> Column:
    lang = F.lit(lang) if isinstance(lang, str) else lang
    conf = F.lit(conf) if isinstance(conf, float) else conf
    return F.struct(lang.alias("lang"), conf.cast("double").alias("conf"), F.lit(source).alias("source"))


def turn_decision(rows: DataFrame, hint: float = 1.2) -> DataFrame:
    """Language of a turn: a lateral affricate (unless turns overlap or the text is Spanish), Latin, a Maya hint, trusted text, symbols, else none.

    Needs tl, overlaps, text_lang, latin, maya, asr_lang, asr_ok, asr_conf, ipa_lang, ipa_conf; adds lang, conf, source.
    """
    spanish_text = F.col("text_lang") == "spa"
    d = (
        F.when(F.col("tl") & ~F.col("overlaps") & ~spanish_text, _decided("nah", 0.9, "tl"))
        .when(F.col("latin") >= 3, _decided("lat", 0.95, "latin"))
        .when((F.col("maya") >= hint) & (F.col("asr_lang") != "spa"), _decided("may", F.least(F.lit(0.9), F.col("maya") / 2), "maya_hint"))
        .when(F.col("asr_ok") & spanish_text, _decided("spa", F.col("asr_conf"), "asr_text"))
        .when(F.col("asr_ok"), _decided(F.col("asr_lang"), F.col("asr_conf"), "asr"))
        .when(F.col("ipa_lang").isNotNull(), _decided(F.col("ipa_lang"), F.col("ipa_conf"), "ipa"))
        .otherwise(_decided("other", 0.0, "none"))
    )
    return rows.withColumn("_d", d).withColumns({k: F.col(f"_d.{k}") for k in ("lang", "conf", "source")}).drop("_d")


def ejective_vote(heuristic: Column, cluster: Column, model: Column, weights: tuple[float, float, float] = (0.4, 0.3, 0.3), least: float = 0.5) -> Column:
    """Weighted vote of three detectors; a detector that is missing leaves its weight to the others."""
    votes = [(v, w) for v, w in zip((heuristic, cluster, model), weights)]
    total = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in votes), F.lit(0.0))
    yes = sum((F.when(F.coalesce(v, F.lit(False)), w).otherwise(0.0) for v, w in votes), F.lit(0.0))
    return F.when(total > 0, yes / total >= least).otherwise(False)


def voted(rows: DataFrame, lang: str, voter: str, conf: str, sure: float = 0.9, boost: float = 0.1, weak: float = 0.5) -> DataFrame:
    """A second voter that agrees raises the confidence; a sure one overrides a weak decision."""
    agree = F.col(voter) == F.col(lang)
    override = ~agree & (F.col(f"{voter}_conf") >= sure) & (F.col(conf) < weak)
    return rows.withColumns(
        {
            lang: F.when(override, F.col(voter)).otherwise(F.col(lang)),
            conf: F.when(agree, F.least(F.lit(1.0), F.col(conf) + boost)).when(override, F.col(f"{voter}_conf")).otherwise(F.col(conf)),
            "voted": F.when(agree, "agree").when(override, "override").otherwise("none"),
        }
    )


def spanish_reclaim(rows: DataFrame, least: float = 0.35, morphology: str = "nik[aeiou]|tik[aeiou]|mik[aeiou]|tict|nicn") -> DataFrame:
    """Rows not Spanish whose text is, and which show no word forms or symbols of the other language, become Spanish."""
    take = (F.col("lang") != "spa") & (F.col("spanish_share") >= least) & ~F.lower("text").rlike(morphology) & ~F.col("exclusive")
    return rows.withColumn("reclaimed", take).withColumn("lang", F.when(take, "spa").otherwise(F.col("lang")))


def output_text(rows: DataFrame) -> DataFrame:
    """The text that is shown: recovered, uncertain, fine-tuned, by symbols' order, model's, symbols, recogniser's."""
    options = (("rec", "REC"), ("unc", "UNC"), ("ft", "FT"), ("llm", "LLM"), ("ipa", "IPA"), ("text", "whisper"))
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    shown, mark = F.lit(""), F.lit("none")
    for c, m in reversed(options):
        shown, mark = F.when(some(c), F.col(c)).otherwise(shown), F.when(some(c), m).otherwise(mark)
    return rows.withColumn("shown", shown).withColumn("mark", mark)


def separated_pick(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the sources of a turn the one that is not ``nah`` where they disagree, else the most confident, the first on ties."""
    kinds = F.size(F.collect_set("lang"))
    best = F.max_by(F.struct("lang", "conf", "src"), F.struct("conf", (-F.col("src")).alias("o")))
    other = F.max_by(F.when(F.col("lang") != "nah", F.struct("lang", "conf", "src")), F.when(F.col("lang") != "nah", F.struct("conf", (-F.col("src")).alias("o"))))
    return rows.groupBy(*keys).agg(F.when((kinds > 1) & other.isNotNull(), other).otherwise(best).alias("m")).select(*keys, "m.*")


def third_class(rows: DataFrame) -> DataFrame:
    """Six ordered rules for rows of unknown language: affricate, ejective, dictionary, text, likelihood margin, else unknown."""
    c = (
        F.when(F.col("tl"), "nah")
        .when(F.col("ejective"), "may")
        .when(F.col("lexicon_hits") >= 2, "nah")
        .when(F.col("text_lang").isNotNull(), F.col("text_lang"))
        .when(F.col("margin") > 0.5, F.col("likeliest"))
        .otherwise("oth")
    )
    return rows.withColumn("lang", c)
