import collections
import hashlib
import random

from pyspark.sql import functions as F

from loomwork.llm import components as components_module
from loomwork.llm import exact_dedup as exact_dedup_module
from loomwork.llm import minhash
from loomwork.llm.components import components
from loomwork.llm.exact_dedup import CuckooIndex, digests, exact_dedup, keep_exact, live_index
from loomwork.llm.line_dedup import OP3_SQL, line_dedup
from loomwork.llm.minhash import keep_one_of_near, near_duplicates
from loomwork.llm.suffix_dedup import extended, repeated_passages

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_cuckoo_index_survives_overflow_and_deletion():
    index = CuckooIndex(2)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        assert index.get(k) is None
        index.insert(k, i)
    assert [index.get(k) for k in keys] == list(range(3000)) and index.live == 3000
    for k in keys[::3]:
        assert index.delete(k) is not None and index.delete(k) is None
    assert all((index.get(k) is None) == (i % 3 == 0) for i, k in enumerate(keys))
    assert sorted(x[1] for x in index.items()) == [i for i in range(3000) if i % 3]


def test_cuckoo_index_with_equal_marks():
    """Digests that share both buckets and the mark are told apart by the stored content."""
    index = CuckooIndex(4)
    keys = [b"\1" * 10 + bytes([i]) * 22 for i in range(6)]
    for i, k in enumerate(keys):
        index.insert(k, i)
    assert [index.get(k) for k in keys] == list(range(6))


def test_cuckoo_index_loses_nothing_when_resettling_overflows():
    """Digests of a few buckets and marks, as hard to place as it gets, in indexes of a few buckets."""
    rng = random.Random(6)
    for trial in range(300):
        index, live = CuckooIndex(2), {}
        for i in range(rng.randint(10, 80)):
            digest = bytes([rng.randrange(4), rng.randrange(2)]) + b"\0" * 6 + bytes([1 + rng.randrange(3), 0]) + i.to_bytes(6, "little")
            index.insert(digest, i)
            live[digest] = i
            if rng.random() < 0.2:
                gone = rng.choice(list(live))
                assert index.delete(gone) == live.pop(gone)
        assert dict(index.items()) == live and index.live == len(live)
        assert all(index.get(k) == v for k, v in live.items())


def test_index_of_many_tasks(docs, rows, monkeypatch):
    """Indexes that are emptied on the way and digests over many tasks give the same groups."""
    expected = sorted(map(tuple, exact_dedup(docs).select("doc_id", "keep_id", "group_size").collect()))
    monkeypatch.setattr(exact_dedup_module, "LIVE_A_TASK", 5)
    assert sorted(map(tuple, exact_dedup(docs).select("doc_id", "keep_id", "group_size").collect())) == expected


def test_exact_dedup_matches_brute_force(docs, rows):
    groups = collections.defaultdict(list)
    for i, text, *_ in rows:
        groups[(text or "").translate(UPPER)].append(i)
    expected = sorted((i, max(g), len(g), i == max(g)) for i, text, *_ in rows for g in [groups[(text or "").translate(UPPER)]])
    assert sorted(tuple(r)[:4] for r in exact_dedup(docs).collect()) == expected


def test_keep_exact_keeps_columns_and_one_of_repeated_rows(docs, rows, nothing):
    kept = keep_exact(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) == len({(t or "").translate(UPPER) for _, t, *_ in rows})
    assert keep_exact(nothing).count() == 0


def test_keep_exact_tells_rows_without_or_with_equal_ids_by_text(spark):
    rows = [(None, "one"), (None, "two"), (None, "Two"), (None, None), (None, "copy"), (5, "COPY"), (7, "three"), (7, "four"), (7, "four"), (7, "late"), (9, "late"), (8, "lone")]
    kept = keep_exact(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), (r.text or "").lower()) for r in kept) == [
        ("5", "copy"), ("7", "four"), ("7", "three"), ("8", "lone"), ("9", "late"), ("None", ""), ("None", "one"), ("None", "two"),
    ]


def test_deleted_digests_leave_the_index(docs):
    found = digests(docs)
    gone = found.where("doc_id IN (1, 150)").select("digest")
    left = live_index(found, gone)
    assert left.join(gone, "digest").count() == 0
    assert left.count() == found.select("digest").distinct().count() - gone.distinct().count()


def test_line_dedup_matches_brute_force(docs, rows, nothing):
    blank = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(blank).translate(UPPER)
    seen = collections.Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")})
    expected = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (key(x) and seen[key(x)] >= 10)]
        expected.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    assert sorted(tuple(r) for r in line_dedup(docs).collect()) == sorted(expected)
    assert line_dedup(nothing).count() == 0


def test_line_dedup_counts_documents_not_rows(spark):
    """A line of five documents, each there twice, and one of 12 rows without an id stay; one of ten documents goes everywhere."""
    rows = [(i, f"five\nown {i}") for i in range(5)] * 2 + [(None, f"none\nown {i}") for i in range(12)] + [(i, f"ten\nown {i}") for i in range(10, 20)] + [(None, "ten\nlast")]
    got = sorted((str(r.doc_id), r.n_dropped, r.text) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((str(i), int("ten" in t), t.replace("ten\n", "")) for i, t in rows)


def test_line_dedup_agrees_with_its_sql_on_repeated_rows(spark):
    """Nine documents and one repeated row of them: the line stays, as count(DISTINCT doc_id) has it."""
    import duckdb

    rows = [(i, f"nine\nten\nOwn {i}") for i in range(9)] + [(9, " TEN\nother"), (10, None), (11, "")]
    twice = rows + [rows[4]]
    got = {(r.doc_id, r.n_dropped, r.text) for r in line_dedup(spark.createDataFrame(twice, "doc_id long, text string")).collect()}
    assert {(i, n) for i, n, _ in got} == {(i, int(i < 10)) for i in range(12)}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", twice)
    kept = {i: hashlib.sha256(t.encode()).hexdigest() for i, _, t in got}
    for i, _, _, sha in con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({OP3_SQL})").fetchall():
        assert i == 4 or kept[i] == sha  # the SQL takes the lines of equal ids together


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (200, 202), (7, 7)]
    got = {r.node: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in (200, 201, 202)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_over_many_tasks(spark, monkeypatch):
    """Chains, stars with large and small centres and random links, dealt over many tasks; nodes may be structs."""
    monkeypatch.setattr(components_module, "LINKS_A_TASK", 50)
    rng = random.Random(8)
    order = list(range(1000, 1300))
    rng.shuffle(order)
    links = list(zip(order, order[1:])) + [(5000, i) for i in range(4000, 4200)] + [(1, i) for i in range(2000, 2200)]
    links += [(rng.randint(6000, 6400), rng.randint(6000, 6400)) for _ in range(300)] + [(None, 3), (9, 9)]
    parent = {x: x for pair in links[:-2] for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links[:-2]:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    touched = {x for a, b in links[:-2] if a != b for x in (a, b)}
    frame = spark.createDataFrame(links, "a long, b long").repartition(7)
    assert {r.node: r.component_id for r in components(frame).collect()} == {x: find(x) for x in touched}
    node = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col(c) % 10).alias("k"), (F.col(c) - 3000).alias("at"))).alias(c)
    groups = collections.defaultdict(set)
    for r in components(frame.select(node("a"), node("b"))).collect():
        groups[tuple(r.component_id)].add(tuple(r.node))
    expected = collections.defaultdict(set)
    for x in touched:
        expected[find(x)].add((x % 10, x - 3000))
    assert dict(groups) == {min(g): g for g in expected.values()}


def brute_components(rows, width):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(zip(*[w[k:] for k in range(width)])) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates_match_brute_force(docs, rows, nothing, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 4)  # so that the blocks of large buckets are used, too
    monkeypatch.setattr(minhash, "BLOCK", 3)
    for width in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, width).collect()}
        assert got == brute_components(rows, width)
    assert near_duplicates(nothing).count() == 0


def test_near_duplicates_with_null_ids(spark):
    frame = spark.createDataFrame([(None, "a b c d e f"), (None, None), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_duplicates(frame).collect())
    assert got == [("1", 1, True), ("2", 1, False), ("None", None, False), ("None", None, False)]


def test_keep_one_of_near(docs, rows):
    kept = keep_one_of_near(docs)
    assert kept.columns == docs.columns
    expected = {i for i, (_, _, k) in brute_components(rows, 5).items() if k}
    assert {r.doc_id for r in kept.collect()} == expected


def test_repeated_passages_match_brute_force(spark, nothing):
    rng = random.Random(2)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    shared = [fresh(n) for n in (50, 60, 120, 49, 300)]
    texts = {}
    for i in range(60):
        w = fresh(rng.randint(0, 200))
        for s in rng.sample(shared, rng.randint(0, 2)):
            w += s + fresh(rng.randint(0, 60))
        texts[i] = w
    texts[60], texts[61] = list(texts[5]), ["same"] * 400
    occurs = collections.defaultdict(set)
    for i, w in texts.items():
        for k in range(len(w) - 49):
            occurs[tuple(w[k : k + 50])].add(i)
    expected = collections.defaultdict(set)
    for i, w in texts.items():
        for k in range(len(w) - 49):
            if len(occurs[tuple(w[k : k + 50])]) > 1:
                expected[i].update(range(k, k + 50))
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()] + [(99, None), (None, " ".join(shared[2]))], "doc_id long, text string")
    got = collections.defaultdict(set)
    for r in repeated_passages(frame).collect():
        got[r.doc_id].update(range(r.start, r.end))
    assert got == expected
    assert repeated_passages(nothing).count() == 0


def by_word(passages):
    got = collections.defaultdict(set)
    for r in passages.collect():
        got[r.doc_id].update(range(r.start, r.end))
    return got


def test_passages_around_the_words_of_a_very_large_group(spark):
    """40 words that 3,000 documents have, and six passages of 50 around them that only two have each."""
    boiler = [f"b{i}" for i in range(40)]
    own = lambda i, k: [f"o{i}x{k}x{j}" for j in range(30)]
    texts = {i: own(i, 0) + boiler + own(i, 1) for i in range(3000)}
    for k in range(6):
        for i in (10 + k, 2900 + k):
            texts[i] = own(i, 0) + [f"l{k}x{j}" for j in range(5)] + boiler + [f"r{k}x{j}" for j in range(5)] + own(i, 1)
    got = by_word(repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")))
    assert got == {i: set(range(30, 80)) for k in range(6) for i in (10 + k, 2900 + k)}


def test_passage_at_two_places_of_a_document(spark):
    """The second place and a passage whose minimiser stood earlier in other words are found."""
    passage, short = [f"p{i}" for i in range(70)], [f"s{i}" for i in range(30)]
    own = lambda k: [f"o{k}x{j}" for j in range(40)]
    wide = [f"a{i}" for i in range(15)] + short + [f"z{i}" for i in range(15)]
    texts = {1: own(1) + passage + own(2) + passage + own(3), 2: own(4) + passage, 3: own(5) + short + own(6) + wide + own(7), 4: wide + own(8), 5: ["same"] * 300, 6: own(9) + ["same"] * 60 + own(10) + ["same"] * 55}
    got = by_word(repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")))
    assert got == {
        1: set(range(40, 110)) | set(range(150, 220)),
        2: set(range(40, 110)),
        3: set(range(110, 170)),
        4: set(range(60)),
        5: set(range(300)),
        6: set(range(40, 100)) | set(range(140, 195)),
    }


def test_one_document_of_a_chain_is_first(spark):
    """A passage of 60 words in 400 documents, each with words of its own around it, and a second chain."""
    passage, other = [f"p{i}" for i in range(60)], [f"q{i}" for i in range(60)]
    own = lambda i, k: [f"o{i}x{k}x{j}" for j in range(30)]
    texts = {i: own(i, 0) + passage + own(i, 1) for i in range(1, 401)} | {i: own(i, 0) + other for i in (900, 950, 1000)}
    rows = [(i, " ".join(w)) for i, w in texts.items()] + [(1, " ".join(texts[1]))]
    got = {r.doc_id: (r.start, r.end, r.other_id, r.first) for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (30, 90, 2 if i == 1 else 1, i == 1) for i in range(1, 401)} | {i: (30, 90, 950 if i == 900 else 900, i == 900) for i in (900, 950, 1000)}


def test_extension_stops_at_the_texts_ends():
    import numpy as np

    x, y = np.arange(100, dtype="<u4"), np.arange(20, 90, dtype="<u4")
    assert extended(x, y, [(40, 20), (60, 40)], 50) == [(20, 0, 70)]
    assert extended(x, y, [(40, 20)], 71) == []
