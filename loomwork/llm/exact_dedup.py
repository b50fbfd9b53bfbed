"""Exact dedup through a cuckoo-filter index of live digests.

``CuckooIndex`` keeps a 16-bit fingerprint of every live digest in one of two
buckets of four slots, and beside each the full digest and its record.  A probe
that hits a fingerprint is verified against the content of that slot; an insert
that finds no room after a bounded number of evictions doubles the table and
resettles it from the stored digests, as often as it takes; a deletion clears the slot of the
verified digest.  Digests that share buckets and fingerprint with many others, which
no size of the table would part, are kept beside it.

``exact_dedup`` hashes every text once and runs the index twice: over each input partition, so that a
group of any size leaves one row (digest, largest id, count) a task, and, after
a shuffle of those rows by digest, over each partition of digests.  An index holds
``LIVE_A_TASK`` digests at most in the first run, and about as many in the second, for which the digests
are dealt out by their number.  A join by
digest brings the outcome back to the documents; its rows are an id and a
digest, and a large group is split by the adaptive skew join.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm._spark import doc_text, pieces, settle, table

LIVE_A_TASK = 1 << 17

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class CuckooIndex:
    """Digests (16 bytes at least, uniformly spread) to records, with insertion, lookup and deletion."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 1024):
        self._size(1 << max(1, (buckets - 1).bit_length()))
        self.live = 0
        self.rest: dict = {}

    def _size(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.marks = array("H", bytes(2 * self.SLOTS * buckets))
        self.content: list = [None] * (self.SLOTS * buckets)

    def _home(self, digest: bytes) -> tuple[int, int]:
        return int.from_bytes(digest[:8], "little") & self.mask, int.from_bytes(digest[8:10], "little") or 1

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) >> 4 & self.mask)

    def _slot(self, digest: bytes) -> int:
        bucket, mark = self._home(digest)
        for at in (bucket, self._other(bucket, mark)):
            for slot in range(at * self.SLOTS, (at + 1) * self.SLOTS):
                if self.marks[slot] == mark and self.content[slot][0] == digest:
                    return slot
        return -1

    def get(self, digest: bytes):
        slot = self._slot(digest)
        return self.rest.get(digest) if slot < 0 else self.content[slot][1]

    def insert(self, digest: bytes, record) -> None:
        """The digest must not be live."""
        self.live += 1
        waiting = [(digest, record)]
        while waiting:
            left = self._settle(waiting.pop())
            if left is None:
                continue
            if self.live * 16 < len(self.content):  # more room would not part digests that share both buckets
                self.rest[left[0]] = left[1]
                continue
            # overflow: twice the buckets, filled from the stored digests; those still waiting are stored, too
            waiting += [x for x in self.content if x is not None] + [left]
            self._size(2 * (self.mask + 1))

    def _settle(self, entry: tuple):
        """The entry that found no room, or None.  Evictions are undone then, so that nothing is lost."""
        moved = []
        bucket, mark = self._home(entry[0])
        for at in (bucket, self._other(bucket, mark)):
            for slot in range(at * self.SLOTS, (at + 1) * self.SLOTS):
                if not self.marks[slot]:
                    self.marks[slot], self.content[slot] = mark, entry
                    return None
        at = self._other(bucket, mark)
        for kick in range(self.KICKS):
            slot = at * self.SLOTS + (kick * 7 + mark) % self.SLOTS
            moved.append((slot, self.marks[slot], self.content[slot]))
            self.marks[slot], mark = mark, self.marks[slot]
            self.content[slot], entry = entry, self.content[slot]
            at = self._other(at, mark)
            for slot in range(at * self.SLOTS, (at + 1) * self.SLOTS):
                if not self.marks[slot]:
                    self.marks[slot], self.content[slot] = mark, entry
                    return None
        # Undo: the table holds what it held, and the newcomer is what is left.
        newcomer = self.content[moved[0][0]] if len(moved) == 1 else None
        for slot, old_mark, old in reversed(moved):
            newcomer = self.content[slot]
            self.marks[slot], self.content[slot] = old_mark, old
        return newcomer

    def delete(self, digest: bytes):
        """The record that was live, or None."""
        slot = self._slot(digest)
        if slot < 0:
            record = self.rest.pop(digest, None)
            self.live -= record is not None
            return record
        record = self.content[slot][1]
        self.marks[slot], self.content[slot] = 0, None
        self.live -= 1
        return record

    def items(self) -> Iterator[tuple]:
        yield from (x for x in self.content if x is not None)
        yield from self.rest.items()


def _digests(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(x.as_buffer().to_pybytes().translate(_FOLD)).digest() for x in texts], pa.binary())


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, digest)``: SHA-256 of each whole text with A-Z lower-cased; a null text is empty."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), _digests(part.column(1))], ["doc_id", "digest"])

    return doc_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, digest binary")


def _merged(rows: DataFrame, most: int | None = None) -> DataFrame:
    """One index over each partition of ``(digest, keep_id, group_size)``; a group_size of 0 deletes the digest.

    An index of ``most`` digests is emptied and begun anew, so that a digest may be in several rows.
    """

    def emptied(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
        left = list(index.items())
        for at in range(0, len(left), 8192):
            part = left[at : at + 8192]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in part], pa.binary()), pa.array([x[1][0] for x in part], pa.int64()), pa.array([x[1][1] for x in part], pa.int64())],
                ["digest", "keep_id", "group_size"],
            )

    def run(batches):
        index = CuckooIndex()
        gone = []
        for batch in batches:
            for digest, keep, size in zip(*(c.to_pylist() for c in batch.columns)):
                if size == 0:
                    gone.append(digest)
                    continue
                record = index.get(digest)
                if record is None:
                    index.insert(digest, [keep, size])
                else:
                    if keep is not None and (record[0] is None or keep > record[0]):
                        record[0] = keep
                    record[1] += size
            if most and index.live >= most:
                yield from emptied(index)
                index = CuckooIndex()
        for digest in gone:
            index.delete(digest)
        yield from emptied(index)

    return rows.mapInArrow(run, "digest binary, keep_id long, group_size long")


def live_index(found: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """``(digest, keep_id, group_size)`` of every live digest.

    ``found`` has ``(doc_id, digest)``, ``deleted`` digests that are to go, whichever documents have them.
    """
    rows = settle(_merged(found.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")), LIVE_A_TASK))
    parts = -(-rows.count() // LIVE_A_TASK) or 1
    if deleted is not None:
        rows = rows.unionByName(deleted.select("digest", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size")).distinct())
    return _merged(rows.repartition(parts, "digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    Texts are equal when identical after lower-casing A-Z; a null text counts as
    empty.  Of equal texts the largest id stays.  A null id is smaller than any
    other, and rows that share the largest id (repeated rows) all stay.  An empty
    table gives an empty result; other columns are not read.
    """
    found = settle(digests(docs, id_col, text_col))
    return found.join(live_index(found), "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that stay and share id and text, one does.

    Rows that share an id, or have none, and differ in text are documents of their own.
    """
    found = exact_dedup(docs, id_col, text_col)
    kept = settle(found.groupBy(F.col("doc_id").alias("__kept_id")).agg(F.count("*").alias("n"), F.count_if("kept").alias("stay")).where("stay > 0"))
    if kept.where("n > 1").isEmpty():
        return docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["__kept_id"]), "left_semi")
    # only then is a second look at the texts due
    pairs = settle(found.where("kept").select(F.col("doc_id").alias("__kept_id"), F.col("digest").alias("__kept_digest")).distinct())
    digest = F.arrow_udf(_digests, "binary")
    rows = docs.withColumns({"__id": docs[id_col].cast("long"), "__digest": digest(F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary"))})
    rows = rows.join(pairs, (F.col("__digest") == F.col("__kept_digest")) & F.col("__id").eqNullSafe(F.col("__kept_id")), "left_semi")
    return rows.dropDuplicates(["__id", "__digest"]).drop("__id", "__digest")


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
