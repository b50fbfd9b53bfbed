"""Connected components over a table of links, by union-find within partitions and jumps between them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm._spark import discard, settle

LINKS_A_TASK = 1 << 18  # links whose nodes a task holds at once; so few in all are one task's work


def _fields(column: pa.Array) -> list[np.ndarray]:
    return [x.to_numpy(zero_copy_only=False) for x in (column.flatten() if pa.types.is_struct(column.type) else [column])]


def _ranked(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Index of each end among the distinct nodes in order, and these nodes."""
    nodes = pa.concat_arrays([a, b])
    fields = _fields(nodes)
    order = np.lexsort(fields[::-1])
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for x in fields:
        fresh[1:] |= x[order[1:]] != x[order[:-1]]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh) - 1
    return rank[: len(a)], rank[len(a) :], nodes.take(pa.array(order[fresh]))


def roots(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of ``n`` nodes is connected with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        after = root.copy()
        np.minimum.at(after, root[x], low)
        np.minimum.at(after, root[y], low)
        while (after[after] != after).any():
            after = after[after]
        if (after == root).all():
            return root
        root = after


def _stars(links: DataFrame, whole: bool) -> DataFrame:
    """``(a, b, home, moved)``: what a task's links ``(a, b)`` connect, as links from the smallest node.

    ``home`` tells that b was the larger end of a link here, ``moved`` that the link is new.  Unless its
    links must be seen as a ``whole``, a task takes them by portions.
    """
    node = links.schema["a"].dataType.simpleString()

    def stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (pa.concat_arrays([x.column(i) for x in batches]) for i in (0, 1))
        x, y, nodes = _ranked(a, b)
        root = roots(x, y, len(nodes))
        leaf = np.flatnonzero(root != np.arange(len(nodes)))
        new = ~np.isin(root[leaf] * len(nodes) + leaf, x * len(nodes) + y)
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(root[leaf])), nodes.take(pa.array(leaf)), pa.array(np.isin(leaf, y)), pa.array(new)], ["a", "b", "home", "moved"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= LINKS_A_TASK and not whole:
                yield stars(held)
                held, n = [], 0
        if held:
            yield stars(held)

    return links.select("a", "b").mapInArrow(run, f"a {node}, b {node}, home boolean, moved boolean")


def _round(links: DataFrame, parts: int) -> tuple[DataFrame, bool]:
    """Links after the tasks of their larger ends have made stars of them, and after smaller ends have given way to their own smaller ones; whether any changed.

    A node that is the larger end of a link has its one parent where it is at home.  It follows that if no
    link moved, every node but a centre has one link, to a centre.
    """
    stars = settle(_stars(links.repartition(parts, "b"), True))
    parents = stars.where("home").select(F.col("b").alias("node"), F.col("a").alias("parent"))
    jumped = stars.join(parents, stars["a"] == parents["node"], "left")
    after = settle(jumped.select(F.coalesce("parent", "a").alias("a"), "b", (F.col("moved") | F.col("parent").isNotNull()).alias("moved")))
    discard(stars)
    return after, not after.where("moved").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``(node, component_id)`` of every node that a link ``(a, b)`` touches; the id is the smallest node reachable.

    Nodes are whole numbers or structs of them.  Where the links are, each task first replaces its own by
    stars, after which no node is the larger end of more links than there are tasks.  Up to
    ``LINKS_A_TASK`` links are then one task's work; more are dealt by their larger ends to tasks
    of that size, round after round, until nothing moves.  A centre's links are never gathered: they are
    dealt by their other ends, and the join on centres splits skewed ones.
    Links whose ends are equal or null are ignored; no links give no rows.
    """
    # settled, so that what makes the links and what joins them don't have Python workers at a time
    ordered = settle(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    now = settle(_stars(ordered, False))
    discard(ordered)
    n = now.count()
    if n <= LINKS_A_TASK:
        after = settle(_stars(now.coalesce(1), True))
        discard(now)
        now = after
    else:
        changed = True
        while changed:
            before = now
            now, changed = _round(before, math.ceil(n / LINKS_A_TASK))
            discard(before)
    centres = now.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("component_id"))
    return now.select(F.col("b").alias("node"), F.col("a").alias("component_id")).unionByName(centres)
