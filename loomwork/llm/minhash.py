"""MinHash near-dedup on SetSketch registers.

1.  Every text becomes the set of its word shingles, and the set a sketch.
    Documents with the same set are one class from then on.
2.  Bands of register values are buckets.  In each the smallest id is linked with
    all others, so that the candidates grow with the documents and not with
    their pairs.  Candidates are estimated jointly by likelihood, and those that
    may reach the threshold are verified on the full sets.
3.  A bucket whose documents are not all connected by then may hold links that a
    star does not see.  In small buckets all pairs of different components are
    candidates, at most half of ``SMALL`` a document.  Large buckets that share documents form a
    cluster; those of its documents that are outside the cluster's main
    component are compared with all its documents in blocks of about ``BLOCK``,
    cut by set size, each pair of blocks a task that returns connecting links only.
4.  Links give components.

Bands are chosen so that a pair at the threshold shares a bucket with a
probability of 1 - 10**-5 at least, and candidates are only discarded five
standard deviations below the threshold.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import setsketch
from loomwork.llm._spark import discard, doc_text, pieces, settle, table
from loomwork.llm._text import U64, buffers, mix, shingles, split_words
from loomwork.llm.components import components

SMALL, BLOCK = 64, 256


def plan_bands(threshold: float, missed: float = 1e-5) -> tuple[int, int]:
    """(bands, registers a band) that lose a pair at the threshold with probability ``missed`` at most."""
    rows = max(1, int(math.log(0.25) / math.log(threshold)))
    return math.ceil(math.log(missed) / math.log(1 - threshold**rows)), rows


def _sums(elements: np.ndarray, offsets: np.ndarray, salt: int) -> np.ndarray:
    """Order-free 64-bit hash of each set."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(elements ^ U64(salt)), dtype=U64)])
    return mix(total[offsets[1:]] - total[offsets[:-1]]).view(np.int64)


def sketches(docs: DataFrame, width: int, registers: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, k1, k2, registers)``; ``k1, k2`` are a 128-bit hash of the set."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                sets, at = shingles(split_words(*buffers(part.column(1))), width)
                found = setsketch.sketch(sets, at, registers)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(at)), pa.array(_sums(sets, at, 0x5EED)), pa.array(_sums(sets, at, 0xFACE)), pa.array([x.tobytes() for x in found], pa.binary())],
                    ["doc_id", "n_shingles", "k1", "k2", "registers"],
                )

    return doc_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, registers binary")


def _payload(docs: DataFrame, ids: DataFrame, width: int, registers: int, id_col: str, text_col: str) -> DataFrame:
    """Sketch and full set, as bytes, of the documents in ``ids``."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                sets, at = shingles(split_words(*buffers(part.column(1))), width)
                found = setsketch.sketch(sets, at, registers)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(at)), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([sets[x:y].tobytes() for x, y in zip(at[:-1], at[1:])], pa.binary())],
                    ["doc_id", "n", "registers", "elements"],
                )

    rows = doc_text(docs, id_col, text_col).join(ids, "doc_id", "left_semi")
    return rows.mapInArrow(run, "doc_id long, n long, registers binary, elements binary")


def _bytes(column: pa.Array, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) for x in column]


def _least(threshold: float, registers: int) -> float:
    return threshold - 5 * math.sqrt(threshold * (1 - threshold) / registers)


def _similar(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Verified on the full sets, which are sorted, in whole numbers."""
    common = np.searchsorted(y, x)
    common[common == len(y)] = 0
    shared = int((y[common] == x).sum()) if len(y) else 0
    return 1000 * shared >= round(1000 * threshold) * (len(x) + len(y) - shared)


def _verified(pairs: DataFrame, payload: DataFrame, threshold: float, registers: int) -> DataFrame:
    """Those of the pairs ``(a, b, ...)`` that reach the threshold."""
    one, two = (payload.select(F.col("doc_id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("n", "registers", "elements"))) for k in "ab")
    near = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-6
    rows = pairs.join(one, "a").join(two, "b").where(near)
    least = _least(threshold, registers)
    columns = pairs.columns

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
            sketch = [np.stack(_bytes(col[f"registers_{k}"], np.uint8)) for k in "ab"]
            size = [col[f"n_{k}"].to_numpy() for k in "ab"]
            likely = np.flatnonzero(setsketch.jaccard(*sketch, *size) >= least)
            sets = [_bytes(col[f"elements_{k}"].take(pa.array(likely)), U64) for k in "ab"]
            good = likely[[_similar(x, y, threshold) for x, y in zip(*sets)]] if len(likely) else likely
            yield pa.RecordBatch.from_arrays([col[k].take(pa.array(good)) for k in columns], columns)

    return rows.select(*columns, *(f"{c}_{k}" for c in ("n", "registers", "elements") for k in "ab")).mapInArrow(run, ", ".join(f"{c} long" for c in columns))


def _within_blocks(threshold: float, registers: int):
    """Links between the labels of a task's documents, one for each two components that it connects.

    Registers agree at least as often as sets do, so that pairs whose registers agree less than the
    bound of the estimate by 0.1 are not estimated.
    """
    least = _least(threshold, registers)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        label, n = rows["label"].to_numpy(), rows["n"].to_numpy()
        left, right = np.flatnonzero(rows["left"].to_numpy()), np.flatnonzero(rows["right"].to_numpy())
        sketch = np.stack([np.frombuffer(x, np.uint8) for x in rows["registers"]])
        root = {x: x for x in set(label.tolist())}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i in left:
            j = right[(label[right] != label[i]) & (np.minimum(n[right], n[i]) >= threshold * np.maximum(n[right], n[i]) - 1e-6)]
            j = j[(sketch[j] == sketch[i]).mean(1) >= least - 0.1] if len(j) else j
            if not len(j):
                continue
            j = j[setsketch.jaccard(np.broadcast_to(sketch[i], (len(j), registers)), sketch[j], np.full(len(j), n[i]), n[j]) >= least]
            mine = np.frombuffer(rows["elements"].iat[i], U64)
            for k in j:
                p, q = find(label[i]), find(label[k])
                if p != q and _similar(mine, np.frombuffer(rows["elements"].iat[k], U64), threshold):
                    root[p] = q
                    out.append((label[i], label[k]))
        return pd.DataFrame(out, columns=["la", "lb"], dtype="int64")

    return run


def _clusters(members: DataFrame) -> DataFrame:
    """``(doc_id, label, cluster)`` of the documents of ``(bucket, hub, doc_id, label)``: buckets with a document in common are one cluster.

    Only hubs are linked, each document's smallest with its others; it has one a band at most.
    """
    own = settle(members.groupBy("doc_id").agg(F.min("hub").alias("own"), F.collect_set("hub").alias("hubs"), F.any_value("label").alias("label")))
    found = components(own.select(F.col("own").alias("a"), F.explode("hubs").alias("b")).where("a <> b").distinct())
    return own.join(found, own["own"] == found["node"], "left").select("doc_id", "label", F.coalesce("component_id", "own").alias("cluster"))


def _block_links(members: DataFrame, payload: DataFrame, threshold: float, registers: int) -> DataFrame:
    """Links ``(la, lb)`` between the labels of documents within clusters of large buckets ``(bucket, hub, doc_id, label)``.

    What is joined with a cluster's documents is settled first, so that the join can split a large cluster.
    """
    rows = settle(_clusters(members).join(payload.select("doc_id", "n"), "doc_id"))
    sizes = rows.groupBy("cluster", "label").agg(F.count("*").alias("size"))
    main = settle(sizes.groupBy("cluster").agg(F.max(F.struct("size", "label")).alias("m")).select("cluster", F.col("m.label").alias("main")))
    # ln n / ln (1/t): sets that reach the threshold t are in the same class or the next one
    rows = settle(rows.join(main, "cluster").select("doc_id", "label", "cluster", (F.col("label") != F.col("main")).alias("stray"), F.floor(F.log("n") / F.lit(-math.log(threshold))).alias("cls")))
    group = ["cluster", "stray", "cls"]
    cuts = settle(rows.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("cuts")))
    rows = settle(rows.join(cuts, group).select("doc_id", "label", *group, F.pmod(F.xxhash64("doc_id"), "cuts").alias("cut")))
    blocks = cuts.select(*group, F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut"))
    x, y = (blocks.select("cluster", *(F.col(c).alias(f"{c}_{k}") for c in ("stray", "cls", "cut"))) for k in "xy")
    order = F.struct("cls_x", "cut_x") <= F.struct("cls_y", "cut_y")
    pairs = x.where("stray_x").join(y, "cluster").where((F.abs(F.col("cls_x") - F.col("cls_y")) <= 1) & (~F.col("stray_y") | order))
    pairs = pairs.withColumn("pair", F.xxhash64("cluster", "cls_x", "cut_x", "stray_y", "cls_y", "cut_y"))
    same = F.col("stray_y") & (F.col("cls_x") == F.col("cls_y")) & (F.col("cut_x") == F.col("cut_y"))
    left = pairs.select("pair", "cluster", F.lit(True).alias("stray"), F.col("cls_x").alias("cls"), F.col("cut_x").alias("cut"), F.lit(True).alias("left"), same.alias("right"))
    right = pairs.where(~same).select("pair", "cluster", F.col("stray_y").alias("stray"), F.col("cls_y").alias("cls"), F.col("cut_y").alias("cut"), F.lit(False).alias("left"), F.lit(True).alias("right"))
    tasks = left.unionByName(right).join(rows, [*group, "cut"]).select("pair", "doc_id", "label", "left", "right").join(payload, "doc_id")
    return tasks.groupBy("pair").applyInPandas(_within_blocks(threshold, registers), "la long, lb long")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs outside ``[\\x20\\x09-\\x0D]``, A-Z lower-cased; a set holds the
    distinct runs of ``width`` words, a shorter text being one run.  Documents
    whose sets have a Jaccard similarity of ``threshold`` (three decimals) or more
    are linked; component_id is the smallest id reachable, the document's own
    included, and kept marks the document that has it.  A null, empty or blank
    text has an empty set and no links.  Ids are those of documents: repeated
    rows get the same answer, a null id gets a null component_id and is not kept.
    An empty table gives an empty result; other columns are not read.
    """
    bands, rows = plan_bands(threshold)
    registers = bands * rows
    base = settle(sketches(docs, width, registers, id_col, text_col))
    classes = settle(
        base.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("doc_id"), F.any_value("registers").alias("registers"))
    )
    buckets = classes.select("doc_id", F.explode(F.expr(f"transform(sequence(0, {bands - 1}), i -> xxhash64(i, substring(registers, i * {rows} + 1, {rows})))")).alias("bucket"))
    # settled, as is what is joined by key below, so that the join can split a bucket of very many documents
    shared = settle(buckets.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.count("*").alias("size")).where("size > 1"))
    members = settle(buckets.join(shared, "bucket"))
    discard(shared)
    payload = settle(_payload(docs, members.select("doc_id").distinct(), width, registers, id_col, text_col).dropDuplicates(["doc_id"]))
    stars = members.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    found = components(_verified(stars, payload, threshold, registers))
    labels = found.select(F.col("node").alias("doc_id"), F.col("component_id").alias("label"))
    seen = settle(members.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")))
    discard(members)
    apart = settle(seen.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket"))
    open_ = settle(seen.join(apart, "bucket", "left_semi"))
    discard(seen), discard(apart)
    small = open_.where(F.col("size") <= SMALL)
    one = small.select("bucket", "hub", F.col("doc_id").alias("a"), F.col("label").alias("la"))
    two = small.select("bucket", F.col("doc_id").alias("b"), F.col("label").alias("lb"))
    pairs = one.join(two, "bucket").where("a < b AND la <> lb AND a <> hub").select("a", "b", "la", "lb").distinct()
    more = _verified(pairs, payload, threshold, registers).select("la", "lb")
    large = open_.where(F.col("size") > SMALL)
    if not large.isEmpty():
        more = more.unionByName(_block_links(large, payload, threshold, registers))
    # what is left to connect are the components found so far
    joined = components(more.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    found = found.join(joined.select(F.col("node").alias("component_id"), F.col("component_id").alias("joined")), "component_id", "left").select("node", F.coalesce("joined", "component_id").alias("component_id"))
    alone = joined.join(labels, joined["node"] == labels["doc_id"], "left_anti")  # components of one document so far
    found = found.unionByName(alone)
    discard(payload), discard(open_)
    answer = classes.join(found, F.col("doc_id") == F.col("node"), "left").select("k1", "k2", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = base.select("doc_id", "n_shingles", F.when(F.expr("n_shingles > 0 AND doc_id IS NOT NULL"), F.col("k1")).alias("k1"), "k2").join(answer, ["k1", "k2"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one_of_near(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is kept, with all their columns; rows with a null id stay."""
    gone = near_duplicates(docs, width, threshold, id_col, text_col).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__gone_id"))
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone_id"], "left_anti")


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


OP1_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS sh
  FROM d),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND a.n * 100 >= 80 * b.n AND b.n * 100 >= 80 * a.n
  GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.doc_id = s.doc_id
"""
