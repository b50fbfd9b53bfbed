"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word's input is the vector of its hash bucket plus the mean of the vectors of
its character 4-grams, a start mark included.  Two gated recurrent networks
read a window of words in both directions, attention pools their states, and a text's
score is that of its highest window, all overlapping windows being scored.
Everything is numpy: training unrolls the network through time by hand, on
the windows that score highest so far, after starting the vectors from
the log-odds of buckets and 4-grams in the labelled texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm._learn import fitted, fold_of, in_fold, labelled_sample
from loomwork.llm._spark import bounded_batches, doc_text, pieces, table
from loomwork.llm._text import U64, Words, buffers, mix, split_words

WINDOW, STRIDE = 48, 32
WORD_BUCKETS, GRAM_BUCKETS, GRAM = 1 << 16, 1 << 15, 4
WIDTH, HIDDEN, ATTENTION = 8, 8, 8
PIECE = 1 << 20  # bytes of text that are scored together
CHUNK = 4096  # windows that run through the network together
SURE = 2.5  # standard errors that a bucket's log-odds must have to be where its vector starts
OFTEN = 5  # labelled texts that must have another bucket for training to move its vector

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def distinct_words(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index of each word among the distinct ones; their word buckets, their 4-gram buckets end to end, and offsets of these."""
    hashes, first, index = np.unique(words.hashes, return_index=True, return_inverse=True)
    start, length = words.starts[first], (words.ends - words.starts)[first]
    n_grams = np.maximum(length + 2 - GRAM, 1)  # of the word with a mark before it
    at = np.concatenate([[0], np.cumsum(n_grams)])
    low = _LOWER[data]
    gram = np.zeros(at[-1], np.int32)
    for i in range(0, len(first), 1 << 15):  # in blocks of words, for the temporary arrays
        j = min(len(first), i + (1 << 15))
        n = n_grams[i:j]
        place = np.arange(at[j] - at[i]) - np.repeat(at[i:j] - at[i], n)
        begin, left = np.repeat(start[i:j], n), np.repeat(length[i:j], n)
        code = np.zeros(len(place), U64)
        for k in range(GRAM):
            spot = place + k - 1  # -1 is the mark
            byte = np.where(spot < 0, 1, np.where(spot < left, low[np.minimum(begin + np.maximum(spot, 0), len(low) - 1)], 0))
            code = code * U64(257) + byte.astype(U64)
        gram[at[i] : at[j]] = (mix(code) % U64(GRAM_BUCKETS)).astype(np.int32)
    return index.ravel().astype(np.int32), (hashes % U64(WORD_BUCKETS)).astype(np.int32), gram, at


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word (of the batch) and length of every window; a text without words has none."""
    n = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(counts)), n)
    place = (np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)) * STRIDE
    return text, np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), n) + place, np.minimum(WINDOW, counts[text] - place)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(np.minimum(x, 30, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class ToxicityNetwork:
    """Parameters and passes of the network."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        f32 = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        self.word, self.gram = f32(WORD_BUCKETS, WIDTH, s=0.02), f32(GRAM_BUCKETS, WIDTH, s=0.02)
        self.p: dict[str, np.ndarray] = {}
        for side in "fb":
            self.p[f"w{side}"] = f32(WIDTH, 3 * HIDDEN, s=0.4)
            self.p[f"u{side}"] = f32(HIDDEN, 3 * HIDDEN, s=0.3)
            self.p[f"c{side}"] = np.zeros(3 * HIDDEN, np.float32)
        self.p["a"], self.p["v"] = f32(2 * HIDDEN, ATTENTION, s=0.4), f32(ATTENTION, s=0.4)
        self.p["o"], self.p["d"] = f32(2 * HIDDEN, s=0.4), np.zeros(1, np.float32)
        self.scale, self.shift = 1.0, 0.0
        self.fitted = False

    def inputs(self, word: np.ndarray, gram: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Vectors of distinct words."""
        if not len(word):
            return np.zeros((0, WIDTH), np.float32)
        out = self.word[word]
        for i in range(0, len(word), 1 << 15):  # so that the 4-grams' vectors are never all there at once
            j = min(len(word), i + (1 << 15))
            ends = at[i : j + 1]
            out[i:j] += np.add.reduceat(self.gram[gram[ends[0] : ends[-1]]], ends[:-1] - ends[0], axis=0) / np.diff(ends)[:, None].astype(np.float32)
        return out

    def _run(self, side: str, projected: np.ndarray, index: np.ndarray, active: np.ndarray, keep: bool):
        """States (steps, windows, HIDDEN); windows are sorted by falling length, ``active`` of them at each step."""
        steps, n = index.shape[1], len(index)
        u = self.p[f"u{side}"]
        states = np.zeros((steps + 1, n, HIDDEN), np.float32)
        kept = []
        for t in range(steps):
            k = active[t]
            h = states[t, :k]
            g = projected[index[:k, t]]
            hu = h @ u
            gates = _sigmoid(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            states[t + 1, :k] = new + z * (h - new)
            if keep:
                kept.append((h, hu, r, z, new))
        return states[1:], kept

    def forward(self, x: np.ndarray, index: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logits of windows: ``index`` (windows x WINDOW) of distinct words with vectors ``x``, sorted by falling length."""
        steps = int(length[0])
        active = np.searchsorted(-length, -np.arange(steps), side="left")
        index = index[:, :steps]
        turn = np.maximum(length[:, None] - 1 - np.arange(steps), 0)
        back = np.take_along_axis(index, turn, 1)
        forth, kept_f = self._run("f", x @ self.p["wf"] + self.p["cf"], index, active, keep)
        rev, kept_b = self._run("b", x @ self.p["wb"] + self.p["cb"], back, active, keep)
        rev = np.take_along_axis(rev, turn.T[:, :, None], 0)
        states = np.concatenate([forth, rev], 2)
        hidden = np.tanh(states @ self.p["a"])
        energy = hidden @ self.p["v"]
        energy[np.arange(steps)[:, None] >= length[None, :]] = -1e9
        energy -= energy.max(0)
        share = np.exp(energy)
        share /= share.sum(0)
        pooled = (share[:, :, None] * states).sum(0)
        logit = pooled @ self.p["o"] + self.p["d"][0]
        return (logit, (index, back, turn, active, length, kept_f, kept_b, states, hidden, share, pooled)) if keep else logit

    def _back_run(self, side: str, d_states: np.ndarray, index: np.ndarray, active: np.ndarray, kept: list, grads: dict, d_projected: np.ndarray) -> None:
        u = self.p[f"u{side}"]
        du = np.zeros_like(u)
        carry = np.zeros(d_states.shape[1:], np.float32)
        for t in range(len(kept) - 1, -1, -1):
            k = active[t]
            h, hu, r, z, new = kept[t]
            dh = d_states[t, :k] + carry[:k]
            dnew = dh * (1 - z) * (1 - new**2)
            dz = dh * (h - new) * z * (1 - z)
            dr = dnew * hu[:, 2 * HIDDEN :] * r * (1 - r)
            dhu = np.concatenate([dr, dz, dnew * r], 1)
            np.add.at(d_projected, index[:k, t], np.concatenate([dr, dz, dnew], 1))
            du += h.T @ dhu
            carry[:k] = dh * z + dhu @ u.T
        grads[f"u{side}"] = du

    def gradients(self, x: np.ndarray, index: np.ndarray, length: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the weighted log loss, by parameter, and with respect to the vectors ``x``."""
        logit, (index, back, turn, active, length, kept_f, kept_b, states, hidden, share, pooled) = self.forward(x, index, length, keep=True)
        error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight).astype(np.float32)
        grads = {"o": pooled.T @ error, "d": error.sum(keepdims=True)}
        d_pooled = error[:, None] * self.p["o"]
        d_share = (states * d_pooled).sum(2)
        d_energy = share * (d_share - (share * d_share).sum(0))
        grads["v"] = np.einsum("tn,tna->a", d_energy, hidden)
        d_hidden = d_energy[:, :, None] * self.p["v"] * (1 - hidden**2)
        grads["a"] = np.einsum("tnh,tna->ha", states, d_hidden)
        d_states = share[:, :, None] * d_pooled + d_hidden @ self.p["a"].T
        d_back = np.zeros_like(d_states[:, :, HIDDEN:])
        valid = np.arange(len(d_states))[:, None] < length[None, :]
        t, n = np.nonzero(valid)
        d_back[turn[n, t], n] = d_states[t, n, HIDDEN:]
        dx = np.zeros_like(x)
        for side, ds, own, kept in (("f", d_states[:, :, :HIDDEN], index, kept_f), ("b", d_back, back, kept_b)):
            dp = np.zeros((len(x), 3 * HIDDEN), np.float32)
            self._back_run(side, ds, own, active, kept, grads, dp)
            grads[f"w{side}"], grads[f"c{side}"] = x.T @ dp, dp.sum(0)
            dx += dp @ self.p[f"w{side}"].T
        return grads, dx

    def window_logits(self, x: np.ndarray, index: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), np.float32)
        order = np.argsort(-length, kind="stable")
        padded = np.concatenate([index, np.zeros(WINDOW, index.dtype)])
        for at in range(0, len(order), CHUNK):
            part = order[at : at + CHUNK]
            out[part] = self.forward(x, padded[start[part][:, None] + np.arange(WINDOW)], length[part])
        return out

    def text_logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The highest window's logit of every text; -30 for a text without words."""
        words = split_words(data, offsets)
        out = np.full(len(offsets) - 1, -30.0)
        if len(words.hashes):
            index, *rest = distinct_words(data, words)
            text, start, length = windows(words.counts)
            logits = self.window_logits(self.inputs(*rest), index, start, length)
            full = np.flatnonzero(words.counts > 0)
            out[full] = np.maximum.reduceat(logits, np.searchsorted(text, full))
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(offsets) - 1, 0.0)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.text_logits(data, offsets) + self.shift, -40, 40)))

    def _start(self, y: np.ndarray, text_of_word: np.ndarray, index: np.ndarray, word: np.ndarray, gram: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Log-odds of the texts that have a bucket or a 4-gram, where they are sure, as first vectors; returns what training may move."""
        size = np.diff(at)
        seen = {"word": np.zeros((2, WORD_BUCKETS)), "gram": np.zeros((2, GRAM_BUCKETS))}
        bounds = np.searchsorted(text_of_word, np.arange(len(y) + 1))
        for i in range(len(y)):  # texts that have a bucket, one text at a time
            own = np.unique(index[bounds[i] : bounds[i + 1]])
            seen["word"][int(y[i] > 0), np.unique(word[own])] += 1
            spots = np.repeat(at[:-1][own], size[own]) + np.arange(size[own].sum()) - np.repeat(np.cumsum(size[own]) - size[own], size[own])
            seen["gram"][int(y[i] > 0), np.unique(gram[spots])] += 1
        learn = []
        prior, bad, good = y.mean(), (y > 0).sum() + 1, (y == 0).sum() + 1
        for column, (own_table, (clean, toxic)) in enumerate(((self.word, seen["word"]), (self.gram, seen["gram"]))):
            odds = np.log((toxic + 8 * prior + 0.02) / bad / ((clean + 8 * (1 - prior) + 0.02) / good))
            sure = np.abs(odds) >= SURE * np.sqrt(1 / (toxic + 8 * prior + 0.02) + 1 / (clean + 8 * (1 - prior) + 0.02))
            own_table[:, column] += 0.5 * np.where(sure, np.clip(odds, -2, 4), 0).astype(np.float32)
            learn.append((sure | (toxic + clean >= OFTEN)).astype(np.float32))
        return learn

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = 8, rate: float = 0.02, batch: int = 256, seed: int = 11) -> "ToxicityNetwork":
        """Adam on the highest window of each text, and as many others of texts that are not toxic, both classes weighing the same."""
        rng = np.random.default_rng(seed)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        words = split_words(data, offsets)
        if not len(words.hashes):
            return self
        index, word, gram, at = distinct_words(data, words)
        counts = words.counts
        text, start, length = windows(counts)
        del words, data
        learn_word, learn_gram = self._start(y, np.repeat(np.arange(len(texts), dtype=np.int32), counts), index, word, gram, at)
        x = self.inputs(word, gram, at)
        evidence = np.concatenate([[0], np.cumsum(np.maximum(x[:, 0] + x[:, 1], 0)[index] ** 2)])
        logits = evidence[start + length] - evidence[start]
        del evidence
        full = np.flatnonzero(counts > 0)
        first = np.searchsorted(text, full)
        padded = np.concatenate([index, np.zeros(WINDOW, index.dtype)])
        moments: dict[str, list[np.ndarray]] = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        g_word, g_gram = np.full(WORD_BUCKETS, 1e-3, np.float32), np.full(GRAM_BUCKETS, 1e-3, np.float32)
        step = 0
        for epoch in range(epochs):
            if epoch:
                x = self.inputs(word, gram, at)
                logits = self.window_logits(x, index, start, length)
            top = np.array([a + int(np.argmax(logits[a:b])) for a, b in zip(first, [*first[1:], len(text)])])
            clean = np.flatnonzero(y[text] == 0)
            chosen = np.unique(np.concatenate([top, rng.choice(clean, min(len(clean), len(full)), replace=False)])) if len(clean) else np.unique(top)
            label = y[text[chosen]]
            balance = np.where(label > 0, 0.5 / max(1, (label > 0).sum()), 0.5 / max(1, (label == 0).sum())) * len(chosen)
            order = rng.permutation(len(chosen))
            for b in range(0, len(order), batch):
                own = order[b : b + batch]
                own = own[np.argsort(-length[chosen[own]], kind="stable")]
                spots = chosen[own]
                ids = padded[start[spots][:, None] + np.arange(WINDOW)]
                used, local = np.unique(ids, return_inverse=True)
                count = np.diff(at)[used]
                grams = gram[np.repeat(at[:-1][used], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
                vectors = self.inputs(word[used], grams, np.concatenate([[0], np.cumsum(count)]))
                grads, dx = self.gradients(vectors, local.reshape(ids.shape), length[spots], label[own], balance[own] / len(own))
                step += 1
                for k, g in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
                for rows, grad, memory, own_table, learn in ((word[used], dx, g_word, self.word, learn_word), (grams, np.repeat(dx / count[:, None], count, 0), g_gram, self.gram, learn_gram)):
                    np.add.at(memory, rows, (grad**2).mean(1))
                    np.add.at(own_table, rows, -0.05 * grad * (learn[rows] / np.sqrt(memory[rows]))[:, None])
        self.fitted = True
        logits = self.window_logits(self.inputs(word, gram, at), index, start, length)
        self._calibrate(np.maximum.reduceat(logits, first).astype(float), y[full])
        return self

    def _calibrate(self, logits: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression on the texts' logits, both classes weighing the same, with a small ridge."""
        weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (y == 0).sum()))
        middle, spread = float(np.median(logits)), float(max(logits.std(), 1e-3))
        z = (logits - middle) / spread
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            error, curve = weight * (p - y), weight * p * (1 - p) + 1e-9
            gradient = np.array([error @ z + 1e-3 * a, error.sum() + 1e-4 * b])
            hessian = np.array([[curve @ z**2 + 1e-3, curve @ z], [curve @ z, curve.sum() + 1e-4]])
            change = np.linalg.solve(hessian, gradient)
            a, b = a - change[0], b - change[1]
            if np.abs(change).max() < 1e-6:
                break
        self.scale, self.shift = a / spread, b - a * middle / spread


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2000, folds: int = 3, held_out: int = 1, most_bytes: int = 64 << 20) -> ToxicityNetwork:
    """Fitted, in one task, on at most ``2 * per_class`` labelled rows and ``most_bytes`` of text outside the held-out fold; without labels of both kinds it scores 0."""
    sample = labelled_sample(docs, labels, "toxic", fold_of(F.col("doc_id"), folds) != held_out, per_class)

    def fit(texts: list[bytes], y: list[int]) -> ToxicityNetwork:
        model = ToxicityNetwork()
        return model.fit(texts, np.array(y, float)) if len(set(y)) > 1 else model

    return fitted(sample, fit, most_bytes)


def score_toxicity(docs: DataFrame, model: ToxicityNetwork, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row's whole text; a null, empty or blank text has the score of no evidence, 0.

    Rows are independent: repeated rows have equal scores, null ids stay null,
    an empty table gives an empty result, and other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by the numbers of buckets and units

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(*buffers(part.column(1))))], ["doc_id", "score"])

    return doc_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with all their columns.  Rows are scored where they are: no shuffle.

    A null, empty or blank text scores 0 and stays; null ids and repeated rows are scored like any other
    row; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels))
    text = docs.schema.names.index(text_col)
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text_col, PIECE):
                score = model.value.score(*buffers(part.column(text)))
                yield part.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
