import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loomwork.operators import intervals as iv
from loomwork.plans import load

MS = 1000


def frame(spark, rows, names="media long, pos long, s long, e long"):
    return spark.createDataFrame([(1, i, int(s * MS), int(e * MS)) for i, (s, e) in enumerate(rows)], names)


GAPS = [
    ([(0, 5), (5, 10)], 10, []),
    ([(3, 5), (5, 10)], 10, [(0, 3)]),
    ([(0, 3), (3, 7)], 10, [(7, 10)]),
    ([(0, 3), (7, 10)], 10, [(3, 7)]),
    ([(1, 3), (5, 7), (9, 10)], 12, [(0, 1), (3, 5), (7, 9), (10, 12)]),
    ([], 10, [(0, 10)]),
    ([(0, 3), (3.1, 10)], 10, []),
    ([(0, 5), (4, 8), (7, 10)], 10, []),
]


@pytest.mark.parametrize("rows,dur,expected", GAPS)
def test_gaps(spark, rows, dur, expected):
    got = iv.gaps(frame(spark, rows), spark.createDataFrame([(1, dur * MS)], "media long, dur long"), 300)
    assert sorted((r.gs / MS, r.ge / MS) for r in got.collect()) == expected


MATCHES = [
    ([(0, 2)], [(0, 2)], {0: 0}),
    ([(0, 2), (2, 4), (4, 6)], [(0, 2), (2, 4), (4, 6)], {0: 0, 1: 1, 2: 2}),
    ([], [(0, 2), (2, 4), (4, 6)], {0: None, 1: None, 2: None}),
    ([(10, 12)], [(0, 2)], {0: None}),
    ([(0, 3), (2.5, 5)], [(0, 4)], {0: 0}),
    ([(1, 3)], [(2, 5)], {0: 0}),
]


@pytest.mark.parametrize("asr,turns,expected", MATCHES)
def test_one_to_one(spark, asr, turns, expected):
    got = iv.one_to_one(frame(spark, asr), frame(spark, turns))
    assert {r.best: r.pos for r in got.collect()} == expected


def some(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        s = rng.randint(0, 3_000)
        out.append((s, s + rng.choice([0, 1, 5, 40, 900])))
    return out


@pytest.mark.parametrize("bucket", [1_000, 60_000, 10**9])
def test_bucketed_joins_equal_nested_loops(spark, bucket):
    a, b = some(60, 1), some(60, 2)
    x, y = frame(spark, a), frame(spark, b)
    got = {(r.l_pos, r.r_pos, r.ov) for r in iv.overlap_join(x, y, bucket=bucket).collect()}
    expected = {(i, j, (min(p[1], q[1]) - max(p[0], q[0])) * MS) for i, p in enumerate(a) for j, q in enumerate(b) if p[0] < q[1] and q[0] < p[1]}
    assert got == {(i, j, max(0, o)) for i, j, o in expected}
    kept = {r.pos for r in iv.without_overlaps(x, y, bucket=bucket).collect()}
    assert kept == {i for i, p in enumerate(a) if not any(p[0] < q[1] and p[1] > q[0] for q in b)}
    points = x.selectExpr("media", "pos", "s AS t")
    inside = {(r.pos, r.span) for r in iv.points_in(points, y, bucket=bucket).collect()}
    assert inside == {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if q[0] <= p[0] <= q[1]}


def test_nearest_and_ties(spark):
    a, b = some(50, 3), some(50, 4)
    x, y = (frame(spark, r).selectExpr("media", "pos", "s AS t") for r in (a, b))
    got = {r.pos: (r.near, r.dist) for r in iv.nearest(x, y, 20_000).collect()}
    for i, p in enumerate(a):
        best = min((abs(p[0] - q[0]) * MS, j) for j, q in enumerate(b))
        assert got[i] == ((best[1], best[0]) if best[0] < 20_000 else (None, None))


def test_best_overlap_takes_the_first_on_ties(spark):
    got = iv.best_overlap(frame(spark, [(0, 4)]), frame(spark, [(2, 4), (0, 2), (3, 3)]))
    assert [(r.best, r.ov) for r in got.collect()] == [(1, 2000)]


def test_greedy_pairs_use_each_row_once(spark):
    rows = [(1, 0, 0, 0.9, 9), (1, 0, 1, 0.8, 8), (1, 1, 0, 0.7, 7), (1, 1, 1, 0.6, 6), (1, 2, 1, 0.4, 4)]
    pairs = spark.createDataFrame(rows, "media long, l_pos long, r_pos long, score double, ov long")
    assert sorted((r.l_pos, r.r_pos) for r in iv.greedy_pairs(pairs, ["media"], 0.5).collect()) == [(0, 0), (1, 1)]


def test_results_do_not_depend_on_partitions(spark):
    x, y = frame(spark, some(80, 5)), frame(spark, some(80, 6))
    seen = set()
    for n in ("1", "3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(tuple(sorted(map(tuple, iv.best_overlap(x, y).na.fill(-1).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1


def consumed(turns, asr, least=0.3):
    """All pairs in the order of the turns, then of the transcripts; each position once."""
    found = [(t, a, min(t[2], a[2]) - max(t[1], a[1])) for t in turns for a in asr if t[1] < a[2] and a[1] < t[2]]
    done, used, out = set(), set(), []
    for t, a, ov in sorted(found, key=lambda p: (p[0][1], p[0][0], p[1][1], p[1][0])):
        if ov / max(min(t[2] - t[1], a[2] - a[1]), 1) > least and t[0] not in done and a[0] not in used:
            done.add(t[0]), used.add(a[0])
            out.append((t[0], a[0], ov))
    return sorted(out)


@pytest.mark.parametrize("seed,repeats", [(7, 1), (8, 2), (9, 2)])
def test_consume_once_equals_all_pairs_in_order(spark, seed, repeats):
    """Ties, repeated positions, empty intervals and two recordings, in batches of few rows."""
    rng = random.Random(seed)
    sides = [[(i // repeats, s, s + rng.choice([0, 1, 5, 40, 900, -3])) for i in range(150) for s in [rng.randint(0, 600)]] for _ in range(2)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    x, y = (spark.createDataFrame([(m, *r) for m in (1, 2) for r in rows] + [(None, 0, 0, 9), (1, 999, None, 9)], "media long, pos long, s long, e long") for rows in sides)
    try:
        spark.conf.set(name, "7")
        got = iv.consume_once(x, y, 0.3).collect()
    finally:
        spark.conf.set(name, before)
    expected = consumed(*sides)
    assert len(expected) > 30
    for media in (1, 2):
        assert sorted((r.l_pos, r.r_pos, r.ov) for r in got if r.media == media) == expected
    assert len(got) == 2 * len(expected)


def test_consume_once_keeps_open_rows_only(spark, tmp_path):
    """No join and no group of a whole recording: 3,000 copies of a turn and of a transcript have 9 million pairs."""
    rows = "SELECT id AS event_id, timestamp_ntz'2024-01-01 10:00:00' AS ts, id AS user_id, if(id % 2 = 0, 'click', 'error') AS event_type, 30.0D AS value, '' AS props FROM range(6000)"
    spark.sql(rows).write.parquet(f"{tmp_path}/events.parquet")
    got = load()[0]["j10_consume_once"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "InPandas" not in plan
    assert sorted((r.l_pos, r.r_pos) for r in got.collect()) == [(i, i + 1) for i in range(0, 6000, 2)]


def odd_events(spark, folder):
    """Empty segments inside longer ones, a segment that ends before it starts, one without a length and one without a time, and two rows of one id."""
    rows = [
        (1, "10:00:00", "click", 30.0), (2, "10:00:10", "error", 0.0), (3, "10:01:00", "view", 30.0), (4, "10:01:05", "signup", -3.0), (5, "10:02:00", "purchase", 30.0), (6, "10:02:10", "signup", 5.0),
        (6, "10:02:12", "error", 0.0), (7, "10:03:00", "error", None), (8, None, "error", 9.0), (9, "10:02:05", "click", 20.0), (10, "10:02:06", "view", 40.0), (11, "10:05:00", "error", 400.0), (12, "10:05:01", "click", 2.0),
    ]
    frame = spark.createDataFrame([(i, t and f"2024-01-01 {t}", i, k, v, "") for i, t, k, v in rows], "event_id long, ts string, user_id long, event_type string, value double, props string")
    frame.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def both(spark, folder, name):
    """Rows of a query and of its SQL."""
    queries, sql = load()
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    found = con.execute(sql[name])
    got = queries[name](spark, folder).select(*(x[0] for x in found.description))
    return sorted(map(tuple, got.collect()), key=str), sorted(found.fetchall(), key=str)


def test_one_to_one_counts_empty_intervals(spark, tmp_path):
    got = iv.one_to_one(frame(spark, [(3, 3), (20, 22)]), frame(spark, [(0, 4), (21, 25)]))
    assert {r.best: (r.pos, r.ov) for r in got.collect()} == {0: (0, 0), 1: (1, 1000)}
    got, expected = both(spark, odd_events(spark, tmp_path), "c7_tier_routing")
    assert got == expected and sum(r[3] == "whisper" for r in got) == 3


def test_best_overlap_counts_empty_intervals(spark, tmp_path):
    got, expected = both(spark, odd_events(spark, tmp_path), "j3_best_overlap")
    assert got == expected and any(r[1:] == (2, 1, 0) for r in got)


def test_best_overlap_before_1970(spark, tmp_path):
    """SQL cuts times toward 1970: a part of a millisecond, and the two days around it are one recording."""
    rows = [
        (1, "1969-12-31 10:00:00.000500", "click", 30.0), (2, "1969-12-31 10:00:10.0007", "error", 5.0), (3, "1969-12-31 23:59:50", "view", 30.0), (4, "1970-01-01 00:00:05.0004", "signup", 8.0),
        (5, "1960-02-03 23:59:59.9999", "purchase", 4.0), (6, "1960-02-04 00:00:01", "error", 2.0), (7, "2024-01-01 10:00:00.0009", "click", 9.0), (8, "2024-01-01 10:00:01.0001", "error", 2.5),
    ]
    frame = spark.createDataFrame([(i, t, i, k, v, "") for i, t, k, v in rows], "event_id long, ts string, user_id long, event_type string, value double, props string")
    frame.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got, expected = both(spark, str(tmp_path), "j3_best_overlap")
    assert got == expected and (0, 4, 3, 8000) in got


def test_best_by_ratio_puts_empty_intervals_first(spark, tmp_path):
    """Of the two rows of id 6 the empty one has no ratio, which SQL takes as the greatest."""
    got, expected = both(spark, odd_events(spark, tmp_path), "j7_best_by_ratio")
    assert got == expected and [r[3] for r in got if r[1] == 6] == [0, 0]


def test_fixture_prediction_keeps_every_row_once(spark, tmp_path):
    got, expected = both(spark, odd_events(spark, tmp_path), "j8_fixture_prediction")
    assert got == expected and len(got) == 7 and any(r[0] is None for r in got)
