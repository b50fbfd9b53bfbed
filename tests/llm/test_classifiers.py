import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomwork.llm import quality, toxicity
from loomwork.llm._learn import fitted, fold_of, in_fold, labelled_sample
from loomwork.llm._text import buffers, split_words
from pyspark.sql import functions as F


def test_factorisation_identity():
    """The linear-time sum equals the sum over all pairs."""
    model = quality.FactorisationMachine(3)
    rng = np.random.default_rng(0)
    model.weight[:] = rng.normal(size=len(model.weight))
    bucket, at = np.array([3, 9, 50, 2, 7]), np.array([0, 3, 3, 5])
    stats = rng.normal(size=(3, quality.STATS))
    x = model.standard(stats)
    for i, got in enumerate(model.logits(bucket, at, stats)):
        own = bucket[at[i] : at[i + 1]]
        index = [*own, *range(quality.BUCKETS, quality.BUCKETS + quality.STATS)]
        value = [*[1 / np.sqrt(max(len(own), 1))] * len(own), *x[i]]
        expected = model.bias + sum(model.weight[j] * v for j, v in zip(index, value))
        expected += sum(model.vector[index[p]] @ model.vector[index[q]] * value[p] * value[q] for q in range(len(index)) for p in range(q))
        assert got == pytest.approx(expected)


def test_gradients_of_the_network_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    m = toxicity.ToxicityNetwork(3)
    m.p = {k: v.astype(float) for k, v in m.p.items()}
    x = rng.normal(size=(50, toxicity.WIDTH))
    length, index = np.array([48, 30, 5, 1]), rng.integers(0, 50, (4, toxicity.WINDOW))
    y, w = np.array([1.0, 0, 1, 0]), np.ones(4)

    def loss():
        logit = m.forward(x, index, length).astype(float)
        return (np.logaddexp(0, logit) - y * logit).sum()

    grads, dx = m.gradients(x, index, length, y, w)
    for k, g in [*grads.items(), ("x", dx)]:
        values = x.reshape(-1) if k == "x" else m.p[k].reshape(-1)
        for i in rng.integers(0, len(values), 3):
            kept = values[i]
            values[i] = kept + 1e-2
            up = loss()
            values[i] = kept - 1e-2
            down = loss()
            values[i] = kept
            assert (up - down) / 2e-2 == pytest.approx(float(np.asarray(g).reshape(-1)[i]), abs=5e-3)


def test_all_windows_overlap_and_cover():
    counts = np.array([0, 1, 47, 48, 49, 81, 500])
    text, start, length = toxicity.windows(counts)
    begin = np.concatenate([[0], np.cumsum(counts)])
    for i, n in enumerate(counts):
        spans = [(s - begin[i], s - begin[i] + l) for t, s, l in zip(text, start, length) if t == i]
        assert {w for a, b in spans for w in range(a, b)} == set(range(n))
        assert all(c < b for (a, b), (c, d) in zip(spans, spans[1:]))


def frames(spark, words, n=600, every=3):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        bad = i % every == 0
        w = [f"{rng.choice(['ba', 'ko', 'tu', 'mi'])}{rng.choice(['lo', 'ra', 'ne'])}{rng.integers(0, 30)}" for _ in range(rng.integers(5, 200))]
        for _ in range(4 * bad):
            w.insert(rng.integers(0, len(w)), f"{rng.choice(words)}{rng.integers(0, 1000)}")
        rows.append((i, " ".join(w), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(9998, None), (9999, "")], "doc_id long, text string").selectExpr("*", "1 AS y", "'q' AS t", "0 AS label_id")
    return docs, spark.createDataFrame([(r[0], r[2], 1 - r[2]) for r in rows], "doc_id long, toxic int, quality int"), {r[0]: r[2] for r in rows}


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = frames(spark, ["vexul", "grimna"])
    model = toxicity.fit_toxicity(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == truth[i] for i in held]) > 0.9
    assert got[9998] == got[9999] < 0.1
    clean = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert clean == {i for i, s in got.items() if s < 0.7} and toxicity.drop_toxic(docs, labels).columns == docs.columns
    empty = docs.where("doc_id < 0")
    assert toxicity.score_toxicity(empty, model).count() == 0
    assert toxicity.fit_toxicity(docs, labels.where("toxic > 1")).fitted is False


def test_quality_on_held_out_rows(spark):
    docs, labels, truth = frames(spark, ["%%%", "###"])
    model = quality.fit_quality(docs, labels)
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) != truth[i] for i in held]) > 0.9
    assert 0 <= got[9998] == got[9999] <= 1
    assert quality.score_quality(docs.where("doc_id < 0"), model).count() == 0


def test_sample_is_bounded_and_leaves_out_the_fold(spark):
    docs, labels, _ = frames(spark, ["x"])
    docs = docs.unionByName(docs.where("doc_id < 300").withColumn("text", F.lit("0")))  # the larger text of an id counts
    rows = labelled_sample(docs, labels, "toxic", fold_of(F.col("doc_id"), 3) != 1, 20).collect()
    assert len({r.label_id for r in rows}) == len(rows) and all(bytes(r.t) > b"0" for r in rows)
    assert sum(r.y == 0 for r in rows) == sum(r.y == 1 for r in rows) == 20
    assert all(zlib.crc32(str(r.label_id).encode()) % 3 != 1 for r in rows)


def test_fitting_in_a_task_holds_a_bounded_number_of_bytes(spark):
    sample = spark.createDataFrame([(k, bytearray(b"x" * (10 + k)), k % 2, 100 - k) for k in range(20)], "label_id long, t binary, y int, place long")
    texts, y = fitted(sample.repartition(3), lambda t, y: (t, y), 10**6)
    assert [len(t) for t in texts] == [10 + k for k in range(20)] and y == [k % 2 for k in range(20)]
    texts, y = fitted(sample, lambda t, y: (t, y), 120)
    assert [len(t) for t in texts] == [26, 27, 28, 29] and y == [0, 1, 0, 1]  # two of each label fit into 60 bytes
    assert fitted(sample.where("y > 5"), lambda t, y: (t, y), 120) == ([], [])


def slow_logit(model, text):
    """The network a word at a time: the highest window of a text."""
    words = [w.lower() for w in text.split()]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    tail = toxicity.WINDOW
    best = -30.0
    starts = range(0, max(1, len(words) - tail + toxicity.STRIDE), toxicity.STRIDE) if words else []
    for s in starts:
        window = words[s : s + tail]
        vectors = []
        for w in window:
            one = split_words(*buffers(pa.array([w])))
            _, bucket, grams, _ = toxicity.distinct_words(np.frombuffer(w.encode(), np.uint8), one)
            vectors.append(model.word[bucket[0]] + np.mean([model.gram[g] for g in grams], axis=0))
        states = {}
        for side, order in (("f", range(len(vectors))), ("b", range(len(vectors) - 1, -1, -1))):
            h, n, p = np.zeros(toxicity.HIDDEN), toxicity.HIDDEN, model.p
            for t in order:
                g, u = vectors[t] @ p["w" + side] + p["c" + side], h @ p["u" + side]
                r, z = sigmoid(g[:n] + u[:n]), sigmoid(g[n : 2 * n] + u[n : 2 * n])
                new = np.tanh(g[2 * n :] + r * u[2 * n :])
                h = (1 - z) * new + z * h
                states[side, t] = h
        both = [np.concatenate([states["f", t], states["b", t]]) for t in range(len(vectors))]
        energy = np.array([np.tanh(x @ model.p["a"]) @ model.p["v"] for x in both])
        share = np.exp(energy - energy.max())
        pooled = sum(a * x for a, x in zip(share / share.sum(), both))
        best = max(best, float(pooled @ model.p["o"] + model.p["d"][0]))
    return best


def test_network_equals_one_that_reads_word_by_word():
    model = toxicity.ToxicityNetwork(5)
    rng = np.random.default_rng(2)
    model.word[:], model.gram[:] = rng.normal(size=model.word.shape), rng.normal(size=model.gram.shape)
    texts = [" ".join(f"{rng.choice(['Ab', 'kö', 'x', 'longerword'])}{rng.integers(0, 50)}" for _ in range(n)) for n in (1, 5, 47, 48, 49, 80, 81, 200)] + [""]
    got = model.text_logits(*buffers(pa.array(texts)))
    assert got == pytest.approx([slow_logit(model, t) for t in texts], abs=1e-3)


def test_toxicity_from_few_labels(spark):
    """A tenth of the rows are toxic, 30 in all: most of the held-out ones are found, and the clean ones left alone."""
    docs, labels, truth = frames(spark, ["vexul", "grimna"], n=600, every=20)
    got = {r.doc_id: r.score >= 0.7 for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    toxic = [i for i in held if truth[i]]
    assert sum(got[i] for i in toxic) > 0.6 * len(toxic)
    assert sum(got[i] for i in held if not truth[i]) < 0.03 * len(held)


def test_rows_without_ids_repeated_rows_and_long_texts_are_scored(spark):
    rows = [(None, "a b c"), (None, None), (3, "a b c"), (3, "a b c"), (4, "word " * 60000), (5, "x" * 300000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0.1 AS score", "'x' AS predicted", "true AS held_out")
    for model, score in ((toxicity.ToxicityNetwork(1), toxicity.score_toxicity), (quality.FactorisationMachine(1), quality.score_quality)):
        model.fitted = True
        got = score(docs, model).collect()
        assert sorted(str(r.doc_id) for r in got) == ["3", "3", "4", "5", "None", "None"]
        assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 3}) == 1
    assert [r.x for r in docs.select(in_fold(F.col("doc_id"), 3, 1).alias("x")).collect()] == [zlib.crc32(str(i).encode()) % 3 == 1 if i else False for i, _ in rows]
