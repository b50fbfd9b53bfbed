"""Document fingerprints by SpotSigs, in DataFrame functions only.

Wherever a common word stands in a text, the next content words after it form a
chain; the chains are the text's spot signatures.  A fingerprint is the sorted set of their
32-bit hashes, and two fingerprints are as alike as their sets (Jaccard).
``similar_pairs`` searches a table: sets are partitioned by length, so that only
sets of lengths that can reach the threshold meet, and meet on one of the rare
signatures that any similar pair must share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm._spark import settle, table

# Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in is that it for was on are as with be this by at from or an "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine "
    "le la les et en un une du que est pour qui dans par sur pas au de "
    "el los y por con para su se del las al una"
)
CHAIN = 2
ROWS_A_BLOCK, MOST_BLOCKS = 512, 10_000


def marked_words(text: Column) -> Column:
    """Lower-cased words, each with a space before it, common words with a mark."""
    words = F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), "[^\\p{L}\\p{N}]+", " ")
    return F.regexp_replace(words, f"(?<= )(?:{'|'.join(sorted(set(ANCHORS.split())))})(?= )", "|$0")


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct hashes of the spot signatures; of the words where there is no chain.

    A run of common words is taken as one, whatever its length, and so is what follows it: ``chain`` content words
    and the common words between them, of any number.  Each of the run's common words then has a signature.
    """
    words = marked_words(text)
    following = "(?: \\|[^ ]++)*+ ([^| ][^ ]*+)" * chain
    content = "".join(f" ${i + 2}" for i in range(chain))
    # a line "run TAB content words" for each run that has enough of these behind it
    lines = F.split(F.regexp_replace(words, f"((?: \\|[^ ]++)++)(?:(?={following})|)", f"\n$1\t{content}\n"), "\n")
    runs = F.filter(lines, lambda x: F.contains(x, F.lit("\t ")) & ~F.endswith(x, F.lit(" ")))
    spots = lambda x: F.transform(F.split(F.ltrim(F.substring_index(x, "\t", 1)), " "), lambda w: F.concat(w, F.substring_index(x, "\t", -1)))
    found = F.flatten(F.transform(runs, spots))
    plain = F.filter(F.split(words, " "), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.transform(F.when(F.size(found) > 0, found).otherwise(plain), lambda x: F.hash(x))))


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; two empty ones are alike."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - shared
    return F.when(either == 0, F.lit(1.0)).otherwise(shared.cast("double") / either)


def similar_pairs(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(a, b, likeness)`` with a < b: representatives (smallest ids of equal
    fingerprints) whose sets reach the threshold.  A set's rarest signatures,
    as many as one more than it can miss, are its index entries; two sets that
    reach the threshold share one.  Sets of length n only meet sets of lengths in
    [n t, n / t].  Null and empty texts have empty sets and no links; null ids are left out.
    """
    rows = docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("doc_id"), signatures(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("sigs"))
    classes = settle(rows.where(F.size("sigs") > 0).groupBy("sigs").agg(F.min("doc_id").alias("doc_id")).withColumn("n", F.size("sigs")))
    each = classes.select("doc_id", "n", F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").agg(F.count("*").alias("df"))
    order = Window.partitionBy("doc_id").orderBy("df", "sig")
    prefix = each.join(often, "sig").withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold)) + 1)
    cls = lambda n: F.floor(F.log(n.cast("double")) / F.lit(-math.log(threshold)) + 1e-9)
    one = prefix.select("sig", F.col("doc_id").alias("a"), F.col("n").alias("na"), cls(F.col("n")).alias("part"))
    two = prefix.select("sig", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.explode(F.array(cls(F.col("n")) - 1, cls(F.col("n")), cls(F.col("n")) + 1)).alias("part"))
    pairs = one.join(two, ["sig", "part"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold))).select("a", "b").distinct()
    x, y = (classes.select(F.col("doc_id").alias(k), F.col("sigs").alias(f"s{k}")) for k in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= threshold)


def _block(key: Column, points: list[int]) -> Column:
    """How many of the sorted points are at most ``key``, in two steps of about a square root of them each."""
    if not points:
        return F.lit(0).cast("long")
    width = max(1, int(math.sqrt(len(points))))
    coarse, fine = points[::width], [points[i : i + width] for i in range(0, len(points), width)]
    part = F.size(F.filter(F.array(*map(F.lit, coarse)), lambda p: p <= key))
    inner = F.element_at(F.array(*(F.array(*map(F.lit, x)) for x in fine)), F.greatest(part, F.lit(1)))
    return F.when(part == 0, F.lit(0)).otherwise((part - 1) * width + F.size(F.filter(inner, lambda p: p <= key))).cast("long")


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple:
    """Rows with ``next_text`` and the window that they are in order of: the next text by descending id, after the last the first.

    Ids are cut into ranges of about equal numbers of rows; a window runs over each, and
    each range has as guest the first document of the range after it.
    Null ids come last, cut and ordered by a hash of their texts; equal ids go by text.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[id_col].cast("long"), F.xxhash64(text)).alias("place"), text.alias("text"))
    counts = rows.agg(F.count("doc_id").alias("ids"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    blocks, null_blocks = (max(1, min(MOST_BLOCKS, math.ceil(n / ROWS_A_BLOCK))) for n in (counts.ids, counts.nulls))
    points: list[int] = []
    if blocks > 1:
        shares = [i / blocks for i in range(1, blocks)]
        points = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, 10 * blocks).alias("p")).first().p))
    block = F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.col("place"), F.lit(null_blocks))).otherwise(_block(F.col("doc_id"), points))
    rows = rows.withColumn("block", block).withColumn("guest", F.lit(False))
    heads = rows.groupBy("block").agg(F.max("place").alias("head"))  # 2 * MOST_BLOCKS rows at most
    following = Window.orderBy(F.col("block").desc())
    whole = following.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(following), F.first(c).over(whole))
    heads = heads.select(F.col("block").alias("host"), after("block").alias("guest_block"), after("head").alias("guest_place"))
    guests = rows.join(F.broadcast(heads), (F.col("block") == F.col("guest_block")) & (F.col("place") == F.col("guest_place")))
    guests = guests.select("doc_id", "place", "text", F.col("host").alias("block"), F.lit(True).alias("guest"))
    order = Window.partitionBy("block").orderBy("guest", F.col("place").desc(), "text")
    return rows.unionByName(guests).withColumn("next_text", F.lead("text").over(order)), order


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of ``docs``: fingerprints of its text and of its edited text, and how alike they are.

    The edited text has its last third of code points, rounded down, replaced by the first as many of
    the next document by descending id.  Returns doc_id, n_chars, edited_text,
    fingerprint, edited_fingerprint, near_edited, near_next.  A null text is
    empty; the only document of a table is its own next one; an empty table
    gives an empty result; other columns are not read.  Which fingerprints are compared is given here,
    each document's with two others, so that there is nothing to search; ``similar_pairs``
    searches a table by length partitions and pruned Jaccard.
    """
    rows, order = with_next_text(docs, id_col, text_col)
    rows = rows.withColumn("sigs", signatures(F.col("text"))).withColumn("next_sigs", F.lead("sigs").over(order)).where("NOT guest")
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sigs", "next_sigs", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)).alias("edited_text"))
    rows = rows.withColumn("edited", signatures(F.col("edited_text")))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_text",
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def op4_spot_fingerprints(spark, sf_dir: str) -> DataFrame:
    rows = edited_fingerprints(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
