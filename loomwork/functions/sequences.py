"""Sequence functions whose steps depend on each other: alignment, fusion of two transcriptions, morphemes, letters to sounds.

They run as vectorised Python functions on Arrow batches, row by row within a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def align(a: Sequence[str], b: Sequence[str]) -> list[tuple[int | None, int | None]]:
    """Pairs of positions of a cheapest alignment; on ties both advance, else the first does."""
    n, m = len(a), len(b)
    number: dict = {}
    x, y = (np.array([number.setdefault(s, len(number)) for s in t], np.int64) for t in (a, b))
    ramp = np.arange(m + 1, dtype=np.int32)
    cost = np.empty((n + 1, m + 1), np.int32)
    cost[0] = ramp
    for i in range(1, n + 1):  # a whole row at once: what comes from the left is a running minimum
        cost[i, 0] = i
        cost[i, 1:] = np.minimum(cost[i - 1, :-1] + (y != x[i - 1]), cost[i - 1, 1:] + 1)
        cost[i] = np.minimum.accumulate(cost[i] - ramp) + ramp
    out: list[tuple[int | None, int | None]] = []
    i, j = n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def vote(a: Sequence[str], ca: Sequence[float], b: Sequence[str], cb: Sequence[float], second_bias: float = 0.04, margin: float = 0.02) -> tuple[list[str], float]:
    """Symbols of two aligned transcriptions, and the mean confidence of what was taken.

    Where both have a symbol the surer one counts, the second with a bias and beyond a margin; a symbol that only one
    has stays.  If either is empty, the other is taken with confidence 0.
    """
    if not a or not b:
        return list(a or b), 0.0
    out, sure = [], []
    for i, j in align(a, b):
        if j is None or (i is not None and a[i] != b[j] and not cb[j] + second_bias > ca[i] + margin):
            out.append(a[i]), sure.append(ca[i])
        elif i is None or a[i] != b[j]:
            out.append(b[j]), sure.append(cb[j])
        else:
            out.append(a[i]), sure.append(max(ca[i], cb[j]))
    return out, max(0.0, min(1.0, sum(sure) / len(sure)))


def default_confidences(seconds: float, other: float = 0.38) -> tuple[float, float]:
    """Of the recogniser that holds up on short segments and of the other one: under 0.8 s the first gains up to 0.15, and the second loses it, down to 0.25."""
    boost = 0.15 * (0.8 - seconds) / 0.8 if seconds < 0.8 else 0.0
    return 0.55 + boost, max(0.25, other - boost)


def morphemes(phones: Sequence[str], prefixes: dict, roots: dict, suffixes: dict, most_prefixes: int = 4) -> list[tuple[str, str]]:
    """``(kind, form)`` of a word: prefixes of different slots, the longest root (one change is allowed from four symbols on), suffixes, and what is left."""
    out, at, slots = [], 0, set()
    phones = list(phones)

    def longest(table: dict, used: set) -> tuple[str, int, int] | None:
        found = [(f, len(p), s) for f, (p, s) in table.items() if s not in used and phones[at : at + len(p)] == list(p)]
        return max(found, key=lambda x: (x[1], x[0]), default=None)

    while len(out) < most_prefixes and (hit := longest(prefixes, slots)) and at + hit[1] < len(phones):
        out.append(("prefix", hit[0]))
        at += hit[1]
        slots.add(hit[2])
    best = None
    for form, p in roots.items():
        window = phones[at : at + len(p)]
        wrong = sum(x != y for x, y in zip(window, p)) if len(window) == len(p) else 99
        if wrong == 0 or (wrong == 1 and len(p) >= 4):
            best = max(best or (0, 0, ""), (len(p), -wrong, form))
    if best:
        out.append(("root", best[2]))
        at += best[0]
    used: set = set()
    while at < len(phones) and (hit := longest(suffixes, used)):
        out.append(("suffix", hit[0]))
        at += hit[1]
        used.add(hit[2])
    if at < len(phones):
        out.append(("rest", "".join(phones[at:])))
    return out


def letters_to_sounds(word: str, rules: dict[str, str], vowels: str = "aeiou") -> list[str]:
    """Longest rule at each place; h is silent at the end of a word and before a consonant, letters without a rule are skipped."""
    out, at, longest = [], 0, max(map(len, rules), default=1)
    word = word.lower()
    while at < len(word):
        if word[at] == "h" and word[at : at + 2] not in rules and (at + 1 == len(word) or word[at + 1] not in vowels):
            at += 1
            continue
        size = next((n for n in range(min(longest, len(word) - at), 0, -1) if word[at : at + n] in rules), 0)
        if size:
            out += rules[word[at : at + size]].split(" ")
        at += size or 1
    return out


def sounds_to_letters(phones: Sequence[str], rules: dict[str, str], least: float = 0.3) -> str:
    """Text of symbols by the longest rules; empty if fewer of them than ``least`` have one."""
    back = {}
    for letters, sounds in sorted(rules.items(), key=lambda kv: (len(kv[0]), kv[0])):
        back.setdefault(tuple(sounds.split(" ")), letters)
    longest = max(map(len, back), default=1)
    out, at, known = [], 0, 0
    while at < len(phones):
        size = next((n for n in range(min(longest, len(phones) - at), 0, -1) if tuple(phones[at : at + n]) in back), 0)
        if size:
            out.append(back[tuple(phones[at : at + size])])
            known += size
        at += size or 1
    return "".join(out) if phones and known / len(phones) >= least else ""


# Maya ejectives and affricates in parts.
EJECTIVE_PARTS = {"kʼ": [("k", "ʼ")], "pʼ": [("p", "ʼ")], "tʼ": [("t", "ʼ")], "tsʼ": [("t", "s", "ʼ"), ("ts", "ʼ")], "tʃʼ": [("t", "ʃ", "ʼ"), ("tʃ", "ʼ")]}
AFFRICATE_PARTS = {"ts": [("t", "s")], "tʃ": [("t", "ʃ")]}


def expand_contract(phones: Sequence[str], expand: dict[str, tuple[str, ...] | list[tuple[str, ...]]], late: dict[str, list[tuple[str, ...]]] | None = None) -> list[str]:
    """One pass from the left: a symbol with parts becomes the first of its ways to be in parts, and parts in a row, in any of these ways, become their symbol.

    Of the ways that fit the longest counts, and of symbols with the same parts the first.  Symbols of ``late``
    are only taken apart where they are no part of anything.
    """
    ways = {k: [v] if isinstance(v, tuple) else list(v) for k, v in expand.items()}
    late = late or {}
    whole: dict[tuple[str, ...], str] = {}
    for k, parts in [*ways.items(), *late.items()]:
        for p in parts:
            whole.setdefault(p, k)
    longest = max(map(len, whole), default=0)
    out, at = [], 0
    while at < len(phones):
        size = next((n for n in range(min(longest, len(phones) - at), 1, -1) if tuple(phones[at : at + n]) in whole), 0)
        if phones[at] in ways:
            out += ways[phones[at]][0]
            at += 1
        elif size:
            out.append(whole[tuple(phones[at : at + size])])
            at += size
        elif phones[at] in late:
            out += late[phones[at]][0]
            at += 1
        else:
            out.append(phones[at])
            at += 1
    return out


def closest_word(text: str, words: Sequence[str], least: float = 0.75) -> str | None:
    """The first of the words that a window of as many letters of the text resembles."""
    joined = "".join(c for c in text.lower() if c.isalpha())
    for w in words:
        for i in range(max(1, len(joined) - len(w) + 1)):
            if SequenceMatcher(None, joined[i : i + len(w)], w).ratio() >= least:
                return w
    return None


def vectorised(f: Callable, returns: str) -> Callable[..., Column]:
    """A function of plain values as a column function; nulls go to ``f`` as None.  For a struct ``f`` returns its fields by name."""
    if returns.startswith("struct"):

        @F.pandas_udf(returns)
        def run_struct(*columns: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([f(*row) for row in zip(*columns)], dtype=object)

        return run_struct

    @F.pandas_udf(returns)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([f(*row) for row in zip(*columns)], dtype=object)

    return run
