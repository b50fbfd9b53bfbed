"""Line dedup in DataFrame functions only.

Lines are exploded as the hashes of their keys, each key once a row; a
count by hash finds the keys of many rows, partial counts being summed
before the shuffle, so that a line that every document has costs one row a task.  Only for
these the distinct documents are counted.  The keys of many rows and those of many documents are
settled before they meet the lines, so that the join can split the documents of a key in
as many tasks as their number asks for.  Where frequent keys occur, they return to their documents as one array of hashes a
document, and the text is filtered and joined again in the order of its lines.
A text crosses the network once, and only beside the frequent keys of its own.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm._spark import settle, table

BLANKS = " \t\n\x0b\x0c\r"


def fold(text: Column) -> Column:
    """A-Z lower-cased.  lower() does that on ASCII text, and far faster than translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def key_hash(key: Column) -> Column:
    """128 bits: with 64, some of 10**12 lines would share a hash by chance."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b"))


def _keys(text: Column, min_chars: int) -> Column:
    return F.filter(F.array_distinct(F.transform(F.split(fold(text), "\n"), line_key)), lambda k: F.char_length(k) >= min_chars)


def frequent_keys(rows: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """``(k)``: hashes of the keys that at least ``min_docs`` rows of ``(doc_id, text)`` have."""
    keys = rows.select(F.explode(F.transform(_keys(F.col("text"), min_chars), key_hash)).alias("k"))
    return keys.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("k")


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of ``docs``: doc_id, n_lines (before), n_dropped, text (what is left).

    Lines are what ``\\n`` separates; a null or empty text is one empty line.  A
    line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z
    lower-cased.  A key of at least ``min_chars`` code points (1 or more) that at
    least ``min_docs`` documents have loses all its lines.  Rows that share an id are
    one document; rows with a null id count as none, but lose their lines, too.  An empty table gives
    an empty result; other columns are not read.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    own = F.when(docs[id_col].isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))  # tells rows without an id apart
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), own.alias("own"), text.alias("text"))
    maybe = settle(frequent_keys(rows, min_docs, min_chars))
    lines = rows.select("doc_id", "own", F.explode(F.transform(_keys(F.col("text"), min_chars), key_hash)).alias("k"))
    pairs = settle(lines.join(maybe, "k", "left_semi"))
    often = pairs.where("doc_id IS NOT NULL").select("k", "doc_id").distinct().groupBy("k").agg(F.count("*").alias("n"))
    often = settle(often.where(F.col("n") >= min_docs).select("k"))
    hits = pairs.join(often, "k", "left_semi").groupBy("doc_id", "own").agg(F.collect_set("k").alias("hits"))
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("own").alias("hit_own"), "hits")
    whole = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("own") == F.col("hit_own")), "left")
    parts = F.split("text", "\n")
    left = F.filter(parts, lambda x: ~F.array_contains(F.col("hits"), key_hash(line_key(fold(x)))))
    return (
        whole.select("doc_id", F.size(parts).cast("long").alias("n_lines"), F.when(F.col("hits").isNotNull(), left).alias("left"), "text")
        .select(
            "doc_id",
            "n_lines",
            F.when(F.col("left").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("left")).cast("long").alias("n_dropped"),
            F.when(F.col("left").isNull(), F.col("text")).otherwise(F.array_join("left", "\n")).alias("text"),
        )
    )


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
often AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, often.key IS NOT NULL AS gone FROM k LEFT JOIN often ON k.key = often.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
