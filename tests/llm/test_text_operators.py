import collections
import hashlib
import json
import random
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from loomwork.llm import mixing, pii, spotsigs
from loomwork.llm._text import buffers, shingles, split_words


def test_words_and_shingles_match_python(rows):
    import pyarrow as pa

    texts = [t for _, t, *_ in rows]
    for block in (64, 1 << 20):
        words = split_words(*buffers(pa.array(texts)), block=block)
        own = [(t or "").encode().lower().split() for t in texts]
        assert words.counts.tolist() == [len(x) for x in own]
        flat = [w for x in own for w in x]
        assert len(set(zip(flat, words.hashes.tolist()))) == len(set(flat)) == len(set(words.hashes.tolist()))
    for width in (1, 2, 5):
        _, at = shingles(words, width)
        expected = [len(set(zip(*[x[k:] for k in range(width)]))) if len(x) >= width else int(bool(x)) for x in own]
        assert np.diff(at).tolist() == expected


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def test_bpe_equals_the_library(vocabulary, rows):
    from tokenizers import Tokenizer

    from loomwork.llm.bpe import Codec

    theirs, ours = Tokenizer.from_file(vocabulary), Codec(vocabulary)
    theirs.no_truncation(), theirs.no_padding()
    rng = random.Random(1)
    alphabet = "aB'sTrêÉΣςσ ßİ\n\t\x1c\x1f\x85 ​12٣½Ⅷ日本é한ᄒ\U0001F600!?.<|endoftext|>-_"
    texts = [t or "" for _, t, *_ in rows if len(t or "") < 50000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>", "<|startoftext|>x"]) for _ in range(2000)]
    for text in texts:
        expected = theirs.encode(text, add_special_tokens=False).ids
        got = ours.encode(text)
        assert got.tolist() == expected, text
        assert ours.decode(got) == theirs.decode(expected, skip_special_tokens=False)


def test_bpe_of_very_long_texts_equals_the_library(vocabulary):
    """Whole texts, also of one word; long words are not kept in memory."""
    from tokenizers import Tokenizer

    from loomwork.llm import bpe

    theirs, ours = Tokenizer.from_file(vocabulary), bpe.Codec(vocabulary)
    rng = random.Random(3)
    for text in ("a" * 100000, " ".join("word" + str(rng.randrange(9999)) for _ in range(30000)), "".join(rng.choice("abcdefgh") for _ in range(60000)), "é" * 70000):
        assert ours.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert max(len(k) for table in (ours.words, ours.pieces) for part in (table.young, table.old) for k in part) <= bpe.LONGEST


def test_bpe_of_rows_without_ids_and_repeated_rows(spark, vocabulary):
    from loomwork.llm.bpe import round_trip_digests

    rows = [(None, "one two"), (None, None), (1, "one two"), (1, "one two"), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS ids", "1 AS n_tokens")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in round_trip_digests(docs, vocabulary).collect())
    assert [x[:2] for x in got] == [("1", 2), ("1", 2), ("2", 0), ("None", 0), ("None", 2)] and got[0][2] == got[1][2] == got[4][2]


def test_bpe_documents(vocabulary, docs, nothing):
    from loomwork.llm.bpe import decode_documents, encode_documents, round_trip_digests

    encoded = encode_documents(docs, vocabulary)
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    texts = {r.doc_id: r.text for r in decode_documents(encoded, vocabulary).collect()}
    for r in round_trip_digests(docs, vocabulary).collect():
        assert r.n_tokens == len(ids[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(ids[r.doc_id], "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert ids[200] == [] and encode_documents(nothing, vocabulary).count() == 0


def test_mix_follows_the_rules(docs, rows, nothing):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = {i: len((t or "").encode().split()) for i, t, *_ in rows}
    by_source = collections.defaultdict(int)
    for i, t, s, _ in rows:
        by_source[s] += size[i]
    total, source = sum(by_source.values()), {i: s for i, _, s, _ in rows}
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, full = {}, set()
    while True:  # share, stop what is above its limit, share again
        rest = total - sum(3 * by_source[s] for s in full)
        shares = sum(weight[s] for s in order if s not in full)
        target = {s: 3 * by_source[s] if s in full else rest * weight[s] / shares for s in order}
        above = {s for s in order if s not in full and target[s] > 3 * by_source[s]}
        if not above:
            break
        full |= above
    taken = collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], by_source[s])
        assert r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 4 * 64
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(2)).collect()))
    assert mixing.mix(nothing).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


def test_offsets_do_not_depend_on_ranges(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id AS doc_id", "md5(cast(id AS string)) AS key", "id % 7 AS size", "0L AS si")
    whole = sorted(map(tuple, mixing.offsets(rows, 1).select("doc_id", "at").collect()))
    assert whole == sorted(map(tuple, mixing.offsets(rows, 10**6).select("doc_id", "at").collect()))


ANCHORS = set(spotsigs.ANCHORS.split())


def spots(text, chain=2):
    """Signatures written plainly: every common word with the content words after it; without any, the words."""
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    out = set()
    for k, w in enumerate(words):
        if w in ANCHORS:
            after = [x for x in words[k + 1 :] if x not in ANCHORS][:chain]
            if len(after) == chain:
                out.add("|" + " ".join([w, *after]))
    return out or {"|" + w if w in ANCHORS else w for w in words}


def test_signatures_match_brute_force(spark):
    rng = random.Random(9)
    pool = ["the", "of", "que", "für", "The", "cat", "dog", "Wörd", "x1", "den", "a", "und"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    texts += ["", "cat", "the", "the of", "the cat", "cat dog", "the " * 18 + "cat " + "of " * 30 + "dog", "the cat, of\nthe;dog  x!", "the of " * 20000, "of the " * 20000 + "cat dog", "\t|the 1 2"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for chain in (1, 2, 3):
        got = {r.i: r.s for r in frame.select("i", spotsigs.signatures(F.col("t"), chain).alias("s")).collect()}
        for i, t in enumerate(texts):
            if len(t) > 1000:
                continue
            assert got[i] == sorted(got[i]) and set(got[i]) == hashed_once(spark, spots(t, chain))
        assert set(got[len(texts) - 2]) == (hashed_once(spark, {f"|{w} " + "cat dog"[: 3 if chain == 1 else 7] for w in ("of", "the")} if chain < 3 else {"|of", "|the", "cat", "dog"}))


_HASHES: dict = {}


def hashed_once(spark, words):
    missing = [w for w in words if w not in _HASHES]
    if missing:
        rows = spark.createDataFrame([(w,) for w in missing], "w string").select("w", F.hash("w").alias("h")).collect()
        _HASHES.update({r.w: r.h for r in rows})
    return {_HASHES[w] for w in words}


def test_fingerprints_match_brute_force(spark, docs, rows, nothing, monkeypatch):
    monkeypatch.setattr(spotsigs, "ROWS_A_BLOCK", 16)
    got = {r.doc_id: r for r in spotsigs.edited_fingerprints(docs).collect()}
    order = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    as_set = lambda s: {s[k : k + 8] for k in range(0, len(s), 8)}
    for k, (i, text, *_) in enumerate(order):
        if i == 207:
            continue  # the repeated row has two next texts
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        assert got[i].edited_text == text[: len(text) - cut] + after[:cut]
        assert got[i].n_chars == len(text)
        own, edited, following = spots(text), spots(got[i].edited_text), spots(after)
        assert len(as_set(got[i].fingerprint)) == len(own) and len(as_set(got[i].edited_fingerprint)) == len(edited)
        assert got[i].near_edited == pytest.approx(likeness(own, edited))
        assert got[i].near_next == pytest.approx(likeness(own, following))
    assert got[151].fingerprint == got[153].fingerprint == got[152].fingerprint
    assert spotsigs.edited_fingerprints(nothing).count() == 0


def test_fingerprints_of_rows_without_ids(spark, monkeypatch):
    """Each of 100 rows without an id, over several ranges, and of five with one is the next text of one other row."""
    monkeypatch.setattr(spotsigs, "ROWS_A_BLOCK", 8)
    rows = [(None, f"text number {i} of the large cat dog") for i in range(100)] + [(None, None)] + [(i, f"own {i}") for i in range(5)]
    frame, _ = spotsigs.with_next_text(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS place", "2 AS block", "3 AS guest"))
    got = [r for r in frame.collect() if not r.guest]
    assert sorted(r.next_text for r in got) == sorted(r.text for r in got) == sorted(t or "" for _, t in rows)
    assert {r.doc_id: r.next_text for r in got if r.doc_id} == {4: "own 3", 3: "own 2", 2: "own 1", 1: "own 0"}


def test_similar_fingerprints_are_all_found(docs):
    sets = {r.doc_id: frozenset(r.s) for r in docs.select("doc_id", spotsigs.signatures(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    expected = {(a, b) for x, a in first.items() for y, b in first.items() if a < b and x and y and len(x & y) / len(x | y) >= 0.7}
    got = {(r.a, r.b) for r in spotsigs.similar_pairs(docs, 0.7).collect()}
    assert got == expected and expected


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum((2 * int(c) - 9 * (c > "4")) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def test_pii_keeps_all_base_spans_and_adds_likely_ones(spark, nothing):
    rng = random.Random(5)
    texts = ["".join(rng.choice("a.b-@%+1 2é3(4)\U0001F600 0.99@x.com ") for _ in range(rng.randint(0, 120))) for _ in range(800)]
    texts += [None, "", "1" * 20000, "1 " * 20000, "a" * 50000 + "@", "1.2.3.4 " * 500, "+1 (385) 555-1563 and 4111 1111 1111 1111, bob@mail.com"]
    texts += ["mail me: bob [at] mail [dot] com", "call 385-555-1563 today", "card 4111.1111.1111.1111"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    added = set()
    for r in pii.find_pii(frame).collect():
        text = texts[r.doc_id] or ""
        for kind in pii.KINDS:
            base = [(m.start(), m.end()) for m in re.finditer(BASE[kind], text) if passes(kind, m[0])]
            assert [(x.s, x.e) for x in r[kind] if x.base] == base, (kind, text[:99])
            added |= {(kind, text[x.s : x.e]) for x in r[kind] if not x.base}
    assert added >= {("card", "4111.1111.1111.1111"), ("phone", "385-555-1563")} and ("phone", "4111 1111 1111") not in added
    assert pii.find_pii(nothing).count() == 0


def planted_texts(rng, n):
    """Texts with a span each that base patterns miss, its kind and characters, and texts with what only looks alike."""
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    filler = lambda: " ".join(rng.choice("wind water stone light river tree house field green old".split()) for _ in range(rng.randint(5, 60)))
    out = []
    for _ in range(n):
        kind = rng.choice(["email", "ip", "card", "phone", "none", "base"])
        name = rng.choice(["bob", "anna.lee", "k_meier", "sales"]) + digits(2)
        if kind == "email":
            lead, span = rng.choice(["write to ", "my e-mail: ", "contact ", "mail me at "]), f"{name} [at] mail{digits(1)} [dot] {rng.choice(['com', 'org', 'de'])}"
        elif kind == "ip":
            lead, span = rng.choice(["the server ", "login from ", "host address "]), f"{rng.randint(1, 126)}[.]{rng.randint(0, 255)}[.]{rng.randint(0, 255)}[.]{rng.randint(0, 255)}"
        elif kind == "card":
            lead, body = rng.choice(["my card ", "pay by visa ", "credit card "]), "4" + digits(14)
            total = sum((2 * int(c) - 9 * (c > "4")) if k % 2 == 0 else int(c) for k, c in enumerate(body[::-1]))
            body += str(-total % 10)
            span = ".".join(body[k : k + 4] for k in range(0, 16, 4))
        elif kind == "phone":
            lead, span = rng.choice(["call me: ", "my phone is ", "tel. ", "mobile "]), f"{rng.choice(['385', '212', '415'])}-{digits(3)}-{digits(4)}"
        elif kind == "base":
            lead, span = "", rng.choice([f"{name}@mail.com", f"+1 (385) 555-{digits(4)}", "10.1.2.3", "4111 1111 1111 1111"])
        else:
            lead, span = rng.choice(["chapter ", "see part ", "in the year ", "version "]), rng.choice([f"{digits(2)} of {digits(4)}", f"{digits(1)}.{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"9999.{digits(4)}.{digits(4)}.99"])
        text = f"{filler()} {lead}"
        out.append((f"{text}{span} {filler()}", kind, len(text), len(text) + len(span)))
    return out


def test_added_spans_on_planted_texts(spark):
    """Nine in ten of the planted spans of each kind are added with their exact ends, and texts without any get none."""
    rows = planted_texts(random.Random(12), 900)
    frame = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "doc_id long, text string").selectExpr("*", "'x' AS email", "1 AS votes", "2 AS s")
    found, planted, wrong = collections.Counter(), collections.Counter(), 0
    for r in pii.find_pii(frame).collect():
        text, kind, s, e = rows[r.doc_id]
        added = {(k, x.s, x.e) for k in pii.KINDS for x in r[k] if not x.base}
        if kind in pii.KINDS:
            planted[kind] += 1
            found[kind] += (kind, s, e) in added
            wrong += len(added - {(kind, s, e)})
        else:
            wrong += len(added)
    assert all(found[k] >= 0.9 * planted[k] for k in pii.KINDS), (found, planted)
    assert wrong <= 0.02 * len(rows)


def test_pii_of_rows_without_ids_and_repeated_rows(spark):
    rows = [(None, "a@b.de"), (None, None), (2, "1.2.3.4 x"), (2, "1.2.3.4 x"), (3, "n@m.fr " * 20000)]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), len(r.email), len(r.ip)) for r in got) == [("2", 0, 1), ("2", 0, 1), ("3", 20000, 0), ("None", 0, 0), ("None", 1, 0)]


def test_reliabilities_find_the_labelers_that_agree():
    """Two labelers of five are noise; the estimate follows the other three."""
    rng = random.Random(3)
    counts, truth = collections.Counter(), {}
    for _ in range(5000):
        real = rng.random() < 0.4
        votes = "".join(("+" if real == (rng.random() < 0.9) else "-") if k < 3 else rng.choice("+-") for k in range(5))
        counts[votes] += 1
        truth.setdefault(votes, []).append(real)
    real = pii.reliabilities(dict(counts))
    right = sum(sum(1 for t in truth[v] if t == (real[v] > 0.5)) for v in counts)
    assert right / 5000 > 0.93
