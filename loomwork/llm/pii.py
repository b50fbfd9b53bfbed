"""Personal data by weak supervision, in DataFrame functions only.

Base patterns find emails, IP addresses, card and phone numbers; broad patterns
add candidates that base patterns miss (an address written with "[at]", a
number with dots or without its country code).  Labelers vote on every candidate:
its pattern, a strict shape, a gazetteer, the words before it, and
its check digits or value ranges.  Candidates are counted by kind and votes over all
documents, together with what a span looks like and stands in (characters beside it, length, context of
other kinds); expectation-maximisation on the counts of votes estimates how reliable each labeler is and how
likely each pattern of votes, and a logistic classifier of votes, span and context, trained on these
likelihoods, decides which spans are added.
Base spans always stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm._spark import settle, table

KINDS = ("email", "ip", "card", "phone")

# Possessive and anchored forms of the base patterns: the same leftmost matches, in time linear in the text.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\\.{_LABEL}++)++",
    "ip": "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
BROAD = {
    "email": f"(?<!{_LOCAL}){_LOCAL}{{2,64}}+\\x20?(?:\\[at\\]|\\(at\\)|\\{{at\\}}|\\[AT\\]|\\(AT\\)|＠)\\x20?{_LABEL}{{1,63}}+(?:\\x20?(?:\\[dot\\]|\\(dot\\)|\\.)\\x20?{_LABEL}{{2,63}}+){{1,4}}+",
    "ip": "(?<![0-9.])[0-9]{1,3}+(?:\\[\\.\\]|\\(\\.\\)|\\[dot\\])[0-9]{1,3}+(?:(?:\\[\\.\\]|\\(\\.\\)|\\[dot\\]|\\.)[0-9]{1,3}+){2}(?![0-9])",
    "card": "(?<![0-9._/-])[0-9]{4}(?:[._/\\u00A0\\u2013][0-9]{4}){2}[._/\\u00A0\\u2013][0-9]{1,7}(?![0-9])",
    "phone": "(?<![0-9+.-])(?:00[0-9]{1,3}[\\x20.-])?\\(?[0-9]{2,4}\\)?[\\x20.-][0-9]{3,4}[\\x20.-][0-9]{3,5}(?![0-9.-])",
}
# What a kind's text must have, so that most documents are not searched at all.
_NEEDS = {
    ("email", "base"): "@",
    ("email", "broad"): "(?i)[\\[({]at[\\])}]|＠",
    ("ip", "base"): "[0-9]\\.[0-9]",
    ("ip", "broad"): "[0-9][\\[(](?:\\.|dot)[\\])]",
    ("card", "base"): "[0-9][\\x20-]?[0-9]",
    ("card", "broad"): "[0-9]{4}[._/\\u00A0\\u2013][0-9]{4}",
    ("phone", "base"): "\\+[0-9]",
    ("phone", "broad"): "[0-9][\\x20.)-]{1,2}[0-9]{3}",
}
# Gazetteers and context words.
_GAZETTEER = {
    "email": "(?i)(?:\\.|dot[\\])]\\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|eu|uk|mx|at|ch|be|it|nl)$",
    "ip": "^(?!0|127|255|22[4-9]|23[0-9]|24[0-9]|25[0-5])[0-9]",
    "card": "^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": "^\\+?(?:00)?\\(?(?:1[\\x20(.-]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58]|[2-9][0-9]{2}\\)?[\\x20.-])",
}
_CONTEXT = {
    "email": "(?i)(?:mail|contact|write|reach|kontakt|schreib|correo|escrib|courriel|adresse|écri)",
    "ip": "(?i)(?:\\bip\\b|address|server|host|adresse|servidor|serveur|dirección|login)",
    "card": "(?i)(?:card|visa|master|amex|credit|karte|tarjeta|carte|pay|zahl|pag)",
    "phone": "(?i)(?:phone|\\btel|call|mobile|fax|anruf|rufnummer|teléfono|llam|téléphone|appel|portable)",
}
_SHAPE = {
    "email": f"^[A-Za-z0-9]{_LOCAL}*[A-Za-z0-9]\\W*(?:at\\W*|AT\\W*)?[A-Za-z0-9]",
    "ip": "^[0-9]{1,3}\\D{1,5}[0-9]{1,3}\\D{1,5}[0-9]{1,3}\\D{1,5}[0-9]{1,3}$",
    "card": "^(?:[0-9]{13,19}|(?:[0-9]{4}\\D){3}[0-9]{1,7}|[0-9]{4}\\D[0-9]{6}\\D[0-9]{5})$",
    "phone": "^\\+?[0-9]*[\\x20.-]?\\(?[0-9]{2,4}\\)?[\\x20.-]?[0-9]{3,4}[\\x20.-]?[0-9]{3,5}$",
}
VOTES = 5


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)
    one = lambda i: F.substring(backwards, i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    places = F.sequence(F.lit(1), F.greatest(F.char_length(digits), F.lit(1)))
    return F.aggregate(places, F.lit(0), lambda s, i: s + F.when(i % 2 == 0, doubled(one(i))).otherwise(one(i))) % 10 == 0


def _octets(m: Column) -> Column:
    return m.rlike("^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:[\\[(]?(?:\\.|dot)[\\])]?|$)){4}$")


def _valid(kind: str, m: Column) -> Column:
    """Whether a match passes its kind's check."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets(m)
    digits = _digits(m)
    if kind == "card":
        return F.char_length(digits).between(13, 19) & luhn(digits)
    return F.char_length(digits).between(9, 15)


def _valid_only(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda x: _valid(kind, x["m"]))


_SPAN = "array<struct<s:int,e:int,m:string>>"


def matches(text: Column, pattern: str, needs: str) -> Column:
    """Leftmost matches that do not overlap: start, end (exclusive, code points) and string of each.

    The strings between matches and the matches themselves alternate, so that
    their lengths add up to the positions.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("g"), found.alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(state: Column, pair: Column) -> Column:
        s = state["at"] + F.char_length(pair["g"])
        e = s + F.char_length(pair["m"])
        return F.struct(e.alias("at"), F.concat(state["out"], F.array(F.struct(s.alias("s"), e.alias("e"), pair["m"].alias("m")))).alias("out"))

    return F.when(text.rlike(needs), F.aggregate(pairs, start, step)["out"]).otherwise(F.array().cast(_SPAN))


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, "+").otherwise(F.lit("0") if no is None else F.when(no, "-").otherwise("0"))


def _beside(c: Column) -> Column:
    """Class of the character beside a span: a blank or none, a letter or digit, or another mark."""
    return F.when(F.coalesce(c, F.lit("")).rlike("^\\s?$"), "s").when(c.rlike("[\\p{L}\\p{N}]"), "w").otherwise("p")


def _candidates(text: Column, kind: str, base: Column, broad: Column, every_base: Column) -> Column:
    """Spans with the pattern of votes on each; broad ones only where no base span of any kind is."""
    apart = F.filter(broad, lambda c: ~F.exists(every_base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))

    def judged(span: Column, is_base: bool) -> Column:
        m = span["m"]
        before = F.substring(text, F.greatest(span["s"] - 39, F.lit(1)), F.least(span["s"], F.lit(40)))
        votes = [
            F.lit("+" if is_base else "-"),
            _vote(m.rlike(_SHAPE[kind]), F.lit(True)),
            _vote(m.rlike(_GAZETTEER[kind]), F.lit(True)),
            _vote(before.rlike(_CONTEXT[kind])),
            _vote(_valid(kind, m), F.lit(True)),
        ]
        other = F.lit(False)
        for k in KINDS:
            if k != kind:
                other = other | before.rlike(_CONTEXT[k])
        size = F.char_length(m)
        marks = [
            _beside(F.when(span["s"] > 0, F.substring(text, span["s"], F.lit(1)))),
            _beside(F.substring(text, span["e"] + 1, F.lit(1))),
            F.when(size <= 12, "1").when(size <= 18, "2").otherwise("3"),
            F.when(other, "o").otherwise("-"),
        ]
        return F.struct(span["s"].alias("s"), span["e"].alias("e"), F.lit(is_base).alias("base"), F.concat(F.lit(kind + ":"), *votes, F.lit("/"), *marks).alias("votes"))

    return F.concat(F.transform(base, lambda x: judged(x, True)), F.transform(apart, lambda x: judged(x, False)))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, email, ip, card, phone)``: judged candidates of each kind, for every row's whole text."""
    text = F.col("text")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    for kind in KINDS:
        rows = rows.withColumn(f"{kind}_base", _valid_only(kind, matches(text, BASE[kind], _NEEDS[kind, "base"])))
        rows = rows.withColumn(f"{kind}_broad", matches(text, BROAD[kind], _NEEDS[kind, "broad"]))
    every = F.concat(*(F.col(f"{k}_base") for k in KINDS))
    return rows.select("doc_id", *(_candidates(text, k, F.col(f"{k}_base"), F.col(f"{k}_broad"), every).alias(k) for k in KINDS))


def reliabilities(counts: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """Expectation-maximisation for one kind: the likelihood of each pattern of votes to be real.

    Given the class, labelers vote independently; each has a distribution over
    its votes in either class, smoothed by one vote of each.  The majority is the first guess.
    """
    real = {v: 1 / (1 + math.exp(-1.5 * (v.count("+") - v.count("-")))) for v in counts}
    for _ in range(rounds):
        share = [1.0, 1.0]
        seen = [[{"+": 1.0, "0": 1.0, "-": 1.0} for _ in range(VOTES)] for _ in (0, 1)]
        for votes, n in counts.items():
            for cls, p in enumerate((1 - real[votes], real[votes])):
                share[cls] += n * p
                for labeler, vote in enumerate(votes):
                    seen[cls][labeler][vote] += n * p
        after = {}
        for votes in counts:
            log = [math.log(share[cls]) + sum(math.log(seen[cls][i][v] / sum(seen[cls][i].values())) for i, v in enumerate(votes)) for cls in (0, 1)]
            after[votes] = 1 / (1 + math.exp(min(500.0, log[0] - log[1])))
        change = max((abs(after[v] - real[v]) for v in counts), default=0.0)
        real = after
        if change < 1e-9:
            break
    return real


def _features(pattern: str) -> list[float]:
    """Of a pattern ``votes/marks``: the votes, how they agree, and the span's own marks."""
    votes, marks = pattern.split("/")
    left, right, size, other = marks
    return [
        1.0,
        *(float(v == "+") - float(v == "-") for v in votes),
        float(votes[1:].count("+") >= 3),
        float("-" in votes[1:]),
        *(float(side == c) for side in (left, right) for c in "wp"),
        float(size == "2"),
        float(size == "3"),
        float(other == "o"),
    ]


def span_classifier(counts: dict[str, int], real: dict[str, float], rounds: int = 400, rate: float = 0.5) -> list[float]:
    """Weights of a logistic classifier of patterns ``votes/marks``, trained on the votes' likelihoods, each pattern weighing the root of its count."""
    rows = [(_features(p), real[p.split("/")[0]], math.sqrt(n)) for p, n in sorted(counts.items())]
    total = sum(r[2] for r in rows) or 1.0
    w = [0.0] * (len(rows[0][0]) if rows else 0)
    for _ in range(rounds):
        gradient = [0.01 * x for x in w]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x))))))
            for i, a in enumerate(x):
                gradient[i] += n / total * (p - y) * a
        w = [a - rate * g for a, g in zip(w, gradient)]
    return w


def accepted(counts: dict[str, int], threshold: float = 0.5) -> list[str]:
    """The ``kind:votes/marks`` that the classifier takes, of those counted."""
    out = []
    for kind in KINDS:
        own = {k.split(":")[1]: n for k, n in counts.items() if k.startswith(kind + ":")}
        if own:
            by_votes: dict[str, int] = {}
            for pattern, n in own.items():
                votes = pattern.split("/")[0]
                by_votes[votes] = by_votes.get(votes, 0) + n
            w = span_classifier(own, reliabilities(by_votes))
            out += [f"{kind}:{p}" for p in own if 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, _features(p))))) >= threshold]
    return sorted(out)


def find_pii(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of ``docs``: doc_id, and for each kind an array of ``(s, e, base)`` in order.

    Positions are code points, ends exclusive.  Base spans are there whatever the
    votes; others are there if the classifier takes their votes, and overlap no base
    span.  A null text is empty and has none; repeated rows have equal results;
    an empty table gives an empty result; other columns are not read.
    """
    judged = settle(candidates(docs, id_col, text_col))
    votes = judged.select(F.explode(F.concat(*(F.col(k) for k in KINDS))).alias("c")).groupBy("c.votes").agg(F.count("*").alias("n"))
    counts = {r.votes: r.n for r in votes.collect()}  # at most 4 kinds * 2 ** 5 votes * 54 marks rows
    taken = F.array(*map(F.lit, accepted(counts, threshold))).cast("array<string>")
    keep = lambda c: c["base"] | F.array_contains(taken, c["votes"])
    shape = lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["base"].alias("base"))
    return judged.select("doc_id", *(F.array_sort(F.transform(F.filter(F.col(k), keep), shape)).alias(k) for k in KINDS))


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def _listed(only_base: bool) -> Column:
    parts = []
    for kind in KINDS:
        spans = F.filter(F.col(kind), lambda x: x["base"]) if only_base else F.col(kind)
        parts.append(_named(kind, spans))
    return F.array_join(F.concat(*parts), ",")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter(F.col(k), lambda x: x["base"])).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(True).cast("binary"), 256).alias("base_sha256"), _listed(False).alias("spans"))
