"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Features of a text are the distinct buckets of its words, weighted by their
number, and standardised statistics of its structure and length.  Besides a
weight, each feature has a vector of rank ``RANK``; all pairs interact through the products of
their vectors, which the identity

    sum_{i<j} <v_i, v_j> x_i x_j = ((sum_i v_i x_i)^2 - sum_i v_i^2 x_i^2) / 2

gives in time linear in the features.  Language, source, id and labels are no inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm._learn import fitted, fold_of, in_fold, labelled_sample
from loomwork.llm._spark import doc_text, pieces, table
from loomwork.llm._text import U64, Words, buffers, split_words

BUCKETS, RANK, STATS = 1 << 15, 8, 14


def distinct_buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct buckets of each text's words, and n+1 offsets."""
    bucket = (words.hashes % U64(BUCKETS)).astype(np.int32)
    at = words.offsets.tolist()
    for a, b in zip(at[:-1], at[1:]):
        bucket[a:b].sort()
    fresh = np.ones(len(bucket), bool)
    fresh[1:] = bucket[1:] != bucket[:-1]
    fresh[words.offsets[:-1][words.counts > 0]] = True
    return bucket[fresh], np.concatenate([[0], np.cumsum(fresh)])[words.offsets]


def structure(data: np.ndarray, offsets: np.ndarray, words: Words, n_distinct: np.ndarray) -> np.ndarray:
    """(texts x STATS) numbers about letters, marks, words and lines of each text, and its length."""
    kinds = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 blank, 5 pipe, 6 repeated marks, 7 other ASCII
    kinds[0x21:0x7F] = 7
    kinds[ord("a") : ord("z") + 1], kinds[ord("A") : ord("Z") + 1], kinds[ord("0") : ord("9") + 1] = 1, 2, 3
    kinds[[9, 10, 11, 12, 13, 32]], kinds[ord("|")] = 4, 5
    kinds[[ord(c) for c in "!#$%&*"]] = 6
    seen = kinds[data]

    def per_text(mask: np.ndarray) -> np.ndarray:
        places = np.flatnonzero(mask)
        return np.diff(np.searchsorted(places, offsets)).astype(np.float64)

    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    n = words.counts.astype(np.float64)
    some = np.maximum(n, 1)
    lengths = np.concatenate([[0], np.cumsum(words.ends - words.starts)])[words.offsets]
    same = np.zeros(len(words.hashes), bool)
    same[1:] = words.hashes[1:] == words.hashes[:-1]
    first = np.zeros(len(data) + 1, bool)
    first[words.starts] = True
    lines = per_text(data == 10)
    return np.column_stack(
        [
            per_text(seen == 2) / size,
            per_text((seen == 2) & first[:-1]) / some,
            per_text(seen == 3) / size,
            per_text(seen == 4) / size,
            per_text(seen == 5) / some,
            per_text(seen == 6) / some,
            per_text(seen == 7) / some,
            per_text(seen == 0) / size,
            n_distinct / some,
            np.diff(np.concatenate([[0], np.cumsum(same)])[words.offsets]) / some,
            np.diff(lengths) / some,
            np.log1p(n),
            np.log1p(lines),
            lines / some,
        ]
    )


class FactorisationMachine:
    """Weights and vectors of the buckets, then of the statistics; ``score`` is a probability."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.weight = np.zeros(BUCKETS + STATS)
        self.vector = rng.normal(0, 0.02, (BUCKETS + STATS, RANK))
        self.mean, self.scale = np.zeros(STATS), np.ones(STATS)

    def features(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets with offsets, and standardised statistics, cut off at 6 deviations."""
        words = split_words(data, offsets)
        bucket, at = distinct_buckets(words)
        return bucket, at, structure(data, offsets, words, np.diff(at))

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -6, 6) / np.sqrt(STATS)

    def logits(self, bucket: np.ndarray, at: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """In linear time: sums of weights, vectors and squared vectors over each text's features."""
        each = 1 / np.sqrt(np.maximum(np.diff(at), 1))
        table_ = np.column_stack([self.weight[:BUCKETS], self.vector[:BUCKETS], (self.vector[:BUCKETS] ** 2).sum(1)])
        total = np.zeros((len(at) - 1, RANK + 2))
        full = np.flatnonzero(np.diff(at) > 0)
        if len(full):
            total[full] = np.add.reduceat(table_[bucket], at[:-1][full], axis=0)
        x = self.standard(stats)
        w, v = self.weight[BUCKETS:], self.vector[BUCKETS:]
        summed = total[:, 1:-1] * each[:, None] + x @ v
        squares = total[:, -1] * each**2 + (x**2) @ (v**2).sum(1)
        return self.bias + total[:, 0] * each + x @ w + 0.5 * ((summed**2).sum(1) - squares)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*self.features(data, offsets)), -40, 40)))

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = 12, rate: float = 0.05, decay: float = 2e-4, seed: int = 7) -> "FactorisationMachine":
        """Adagrad on the log loss, a text at a time within each shuffled pass; labels weigh as they come."""
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        bucket, at, stats = self.features(np.frombuffer(b"".join(texts), np.uint8), offsets)
        self.mean, self.scale = stats.mean(0), np.maximum(stats.std(0), 1e-6)
        x = self.standard(stats)
        dense = np.arange(BUCKETS, BUCKETS + STATS)
        gw, gv, gb = np.full(len(self.weight), 1e-2), np.full(self.vector.shape, 1e-2), 1e-2
        rng = np.random.default_rng(seed)
        share = np.clip(y.mean(), 0.01, 0.99)
        self.bias = float(np.log(share / (1 - share)))
        for _ in range(epochs):
            for i in rng.permutation(len(texts)):
                own = bucket[at[i] : at[i + 1]]
                index = np.concatenate([own, dense])
                value = np.concatenate([np.full(len(own), 1 / np.sqrt(max(len(own), 1))), x[i]])
                v, w = self.vector[index], self.weight[index]
                summed = value @ v
                logit = self.bias + value @ w + 0.5 * (summed @ summed - (value**2) @ (v**2).sum(1))
                error = 1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y[i]
                dw = error * value + decay * w
                dv = error * (value[:, None] * summed - v * (value**2)[:, None]) + decay * v
                gw[index] += dw**2
                gv[index] += dv**2
                gb += error**2
                self.weight[index] -= rate * dw / np.sqrt(gw[index])
                self.vector[index] -= rate * dv / np.sqrt(gv[index])
                self.bias -= rate * error / np.sqrt(gb)
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1500, folds: int = 5, held_out: int = 0, most_bytes: int = 64 << 20) -> FactorisationMachine:
    """Fitted, in one task, on at most ``2 * per_class`` labelled rows and ``most_bytes`` of text outside the held-out fold; without labels it scores 0.5."""
    sample = labelled_sample(docs, labels, "quality", fold_of(F.col("doc_id"), folds) != held_out, per_class)

    def fit(texts: list[bytes], y: list[int]) -> FactorisationMachine:
        model = FactorisationMachine()
        return model.fit(texts, np.array(y, float)) if texts else model

    return fitted(sample, fit, most_bytes)


def score_quality(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row's whole text, null as empty; higher is likelier to be good.

    Rows are independent: repeated rows have equal scores, null ids stay null,
    an empty table gives an empty result, and other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS and RANK

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(*buffers(part.column(1))))], ["doc_id", "score"])

    return doc_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
