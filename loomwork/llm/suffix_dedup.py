"""Suffix-array dedup over sparse suffixes.

1.  Of every ``GRAM`` words a hash; of every run of grams that a passage of
    ``least`` words spans, the one with the smallest hash is its minimiser.  Equal passages
    have equal minimisers, so that a minimiser of one document only rules out all
    passages around it: about one gram in thirteen is looked at across documents.
2.  Around the minimisers that are left, at each of their places, the suffix from every word whose
    first ``least`` words have that minimiser is kept.  Suffixes that are neighbours in the
    suffix array with ``least`` words or more in common are those with the same first
    ``least`` words: they are grouped by these, in linear time and whatever the size of a group.
3.  Kept suffixes of a document that overlap are one passage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm._spark import discard, doc_text, pieces, settle, table
from loomwork.llm._text import U64, Words, _power_tables, buffers, mix, split_words
from loomwork.llm.components import components

GRAM = 25


def gram_hashes(words: Words, gram: int) -> np.ndarray:
    """Hash of the ``gram`` words from each word of the batch on; those that leave their text mean nothing."""
    n = len(words.hashes)
    power, inverse = _power_tables(n + 1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(words.hashes * power[:n], dtype=U64)])
    ends = np.minimum(np.arange(n) + gram, n)
    return mix((total[ends] - total[:n]) * inverse[:n])


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, from running minima within blocks in both directions."""
    n = len(x)
    padded = np.concatenate([x, np.full(-n % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    forth = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], forth[width - 1 : n])


def minimisers(words: Words, gram: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word (of the batch) and hash of the minimiser of every passage of ``least`` words."""
    n, span = len(words.hashes), least - gram + 1
    if n < least:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, U64)
    hashes = gram_hashes(words, gram)
    places = np.arange(n, dtype=U64)
    low = U64((1 << max(1, int(n).bit_length())) - 1)
    smallest = sliding_minimum((hashes & ~low) | places, span)
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    inside = np.flatnonzero(np.arange(len(smallest)) + least <= words.offsets[1:][text[: len(smallest)]])
    return text[inside], inside, hashes[(smallest[inside] & low).astype(np.int64)]


def keys(docs: DataFrame, least: int, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(key, doc_id)``: the minimisers of each document, each once a text."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                text, _, key = minimisers(split_words(*buffers(part.column(1))), gram, least)
                if not len(text):
                    continue
                fresh = np.ones(len(text), bool)
                fresh[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
                text, key = text[fresh], key[fresh]
                order = np.lexsort((key, text))
                text, key = text[order], key[order]
                fresh = np.ones(len(text), bool)
                fresh[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(key[fresh].view(np.int64)), part.column(0).take(pa.array(text[fresh]))], ["key", "doc_id"])

    rows = doc_text(docs, id_col, text_col).where("doc_id IS NOT NULL")
    return rows.mapInArrow(run, "key long, doc_id long")


def suffixes(docs: DataFrame, least: int, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, hash)``: every suffix whose first ``least`` words, hashed in 64 bits, have a minimiser that several documents have."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                words = split_words(*buffers(part.column(1)))
                text, start, key = minimisers(words, gram, least)
                wanted = np.isin(key.view(np.int64), part.column(2).flatten().to_numpy(zero_copy_only=False))
                text, start = text[wanted], start[wanted]
                if not len(text):
                    continue
                columns = [part.column(0).take(pa.array(text)), pa.array((start - words.offsets[:-1][text]).astype(np.int64)), pa.array(gram_hashes(words, least)[start].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "hash"])

    found = settle(keys(docs, least, gram, id_col, text_col))
    # settled, so that the join reads it from a shuffle of its own and can split the documents of a key
    often = settle(found.groupBy("key").agg(F.min("doc_id").alias("least_id"), F.max("doc_id").alias("most_id")).where("least_id < most_id").select("key"))
    wanted = found.join(often, "key", "left_semi").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    # repeated rows go while the rows are still where the join has put and sorted them
    rows = doc_text(docs, id_col, text_col).join(wanted, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "keys")
    out = settle(rows.mapInArrow(run, "doc_id long, start long, hash long"), "zstd")  # places go up by one, which it packs well
    discard(found), discard(often)
    return out


def repeated_suffixes(docs: DataFrame, least: int = 50, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """``(doc_id, start, least)``: suffixes whose first ``least`` words several documents have, and the smallest ``(doc_id, start)`` of those.

    With them come the settled tables that they are read from, for the caller to discard.
    """
    rows = suffixes(docs, least, gram, id_col, text_col)
    groups = rows.groupBy("hash").agg(F.min(F.struct("doc_id", "start")).alias("least"), F.max("doc_id").alias("most_id"))
    groups = settle(groups.where("least.doc_id < most_id").select("hash", "least"))
    return rows.join(groups, "hash").select("doc_id", "start", "least"), [rows, groups]


def _run_length(same: np.ndarray) -> int:
    differ = np.flatnonzero(~same[:64])
    if len(differ):
        return int(differ[0])
    differ = np.flatnonzero(~same)
    return int(differ[0]) if len(differ) else len(same)


def extended(x: np.ndarray, y: np.ndarray, places: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Maximal matches ``(start in x, start in y, words)`` of ``least`` words or more around the places, each once."""
    out, covered = [], {}
    for p, q in sorted(places):
        if p < covered.get(p - q, 0):
            continue
        n = min(len(x) - p, len(y) - q)
        right = _run_length(x[p : p + n] == y[q : q + n])
        m = min(p, q)
        left = _run_length((x[p - m : p] == y[q - m : q])[::-1])
        covered[p - q] = p + right
        if left + right >= least:
            out.append((p - left, q - left, left + right))
    return out


def repeated_passages(docs: DataFrame, least: int = 50, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, end, other_id, first)``: passages of ``least`` or more words that other documents have too.

    Words are runs outside ``[\\x20\\x09-\\x0D]``, A-Z lower-cased; positions count
    words, ends are exclusive.  Every place at which a document has ``least`` words that another one has
    is found, also several of the same words.  Matches of a document that overlap or touch are one
    passage, and passages with a match in common are chained.  One document of each chain
    keeps its passages: the smallest, there first is true and other_id the next one; elsewhere other_id is
    the smallest.  What only others of a chain have in common, they have not from that document.
    Texts of fewer words, null and empty ones and rows with a null id
    have none; repeated rows are one document; an empty table gives an empty result;
    other columns are not read.
    """
    order = Window.partitionBy("doc_id").orderBy("start")
    before, same = F.lag("start").over(order), F.lag("least").over(order)
    rows, read = repeated_suffixes(docs, least, gram, id_col, text_col)
    rows = rows.withColumn("new", F.coalesce(F.col("start") > before + least, F.lit(True)))
    rows = rows.withColumn("goes_on", F.coalesce((before == F.col("start") - 1) & (same["doc_id"] == F.col("least.doc_id")) & (same["start"] == F.col("least.start") - 1), F.lit(False)))
    begun = F.max(F.when(F.col("new"), F.col("start"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = settle(rows.select("doc_id", "start", "least", "goes_on", begun.alias("passage")), "zstd")
    for x in read:
        discard(x)

    node = F.struct("doc_id", F.col("passage").alias("start"))
    own = (F.col("doc_id") == F.col("least.doc_id")) & (F.col("start") == F.col("least.start"))
    centres = rows.where(own).select("least", node.alias("a"))
    links = components(rows.where(~own & ~F.col("goes_on")).select("least", node.alias("b")).distinct().join(centres, "least").select("a", "b"))
    chains = links.select(F.col("node.doc_id").alias("doc_id"), F.col("node.start").alias("start"), F.col("component_id").alias("chain"))
    passages = rows.groupBy("doc_id", F.col("passage").alias("start")).agg((F.max("start") + least).alias("end"))
    passages = settle(passages.join(chains, ["doc_id", "start"]))

    first = F.col("doc_id") == F.col("chain.doc_id")
    others = passages.where(~first)
    following = others.groupBy("chain").agg(F.min("doc_id").alias("other_id"))
    kept = passages.where(first).join(following, "chain").select("doc_id", "start", "end", "other_id", F.lit(True).alias("first"))
    return kept.unionByName(others.select("doc_id", "start", "end", F.col("chain.doc_id").alias("other_id"), F.lit(False).alias("first")))


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
