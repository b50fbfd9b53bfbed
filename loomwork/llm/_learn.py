"""Labelled rows to fit a classifier on, a bounded, reproducible sample, and the task that fits it."""

from __future__ import annotations

import gc
import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm._spark import bounded_batches, give_back_memory


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids are in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether an id is in the fold; false for a null id."""
    return F.coalesce(fold_of(doc_id, folds) == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(label_id, t, y, place)``: up to ``per_class`` documents of each label, one row each.

    The rows are those whose ids have the smallest hashes (``place``), so that a sample of a
    larger table is spread over all of it.  Only labels of rows for which
    ``learn_from`` holds are looked at; an id with two labels has the larger one, and of rows
    that share an id the largest text counts.
    """
    rows = labels.where(learn_from & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(label).cast("int").alias("y"))
    rows = rows.withColumn("place", F.xxhash64("label_id"))
    picked = [rows.where(F.col("y") == y).orderBy("place", "label_id").limit(per_class) for y in (0, 1)]
    texts = docs.select(docs[id_col].cast("long").alias("label_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("t"))
    found = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "label_id")  # at most 2 * per_class rows of three numbers
    return found.groupBy("label_id", "y", "place").agg(F.max("t").alias("t")).select("label_id", "t", "y", "place")


def fitted(sample: DataFrame, fit: Callable[[list[bytes], list[int]], object], most_bytes: int) -> object:
    """What ``fit`` makes of the sample's texts and labels, in the order of their ids, in one task of the cluster.

    The driver only gets the model, and a lost executor's task runs again.  The task holds ``most_bytes`` of text
    at most, half of it for each label: in the order of ``place``, a text that goes beyond that is left out.
    """

    def run(batches):
        held, used = [], [0, 0]
        for batch in batches:
            for label_id, text, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                size = text.as_buffer().size
                if used[y] + size <= most_bytes // 2:
                    used[y] += size
                    held.append((label_id, text.as_buffer().to_pybytes(), y))
        held.sort()
        model = fit([x[1] for x in held], [x[2] for x in held])
        del held
        gc.collect()
        give_back_memory()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    bounded_batches(sample.sparkSession)
    rows = sample.repartition(1).sortWithinPartitions("place", "label_id").select("label_id", "t", "y").mapInArrow(run, "model binary").collect()
    return pickle.loads(rows[0].model) if rows else fit([], [])
