"""Threshold-scaled document sketches, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WHITE = r"[\x20\x09-\x0D]+"
#: A sketch keeps the hashes whose first KEEP_BITS bits are zero, one in 2 ** KEEP_BITS.
KEEP_BITS = 2
#: Bits of a kept hash that the sketch holds, a multiple of 24 (so of whole base64 characters).
HELD_BITS = 48
SHINGLE_WORDS = 5


def sketch(text: Column) -> Column:
    """struct(whole, hashes): a hash of the word sequence, and the sorted distinct shingle hashes below the fixed fraction.

    Shingles are SHINGLE_WORDS consecutive words (of fewer: all of them; of none:
    nothing). The threshold is the same for every text, so sketches merge by union
    (``merged``) and containment between texts of any two lengths can be estimated from
    them. A quarter of the shingles is kept, 48 bits of each, so a sketch has a third of
    a text's characters. An estimate of J from n distinct shingles errs by about
    sqrt(3 J (1 - J) / n): coarse below a hundred shingles, whatever the other text.
    """

    def of(words: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (SHINGLE_WORDS - 1)))
        all_ = F.transform(places, lambda i: F.xxhash64(F.slice(words, i, SHINGLE_WORDS)))
        kept = F.transform(F.filter(all_, lambda h: F.shiftrightunsigned(h, 64 - KEEP_BITS) == 0), lambda h: h.bitwiseAND(F.lit((1 << HELD_BITS) - 1)))
        none = F.array().cast("array<bigint>")
        return F.struct(F.xxhash64(words).alias("whole"), F.when(F.size(words) == 0, none).otherwise(F.sort_array(F.array_distinct(kept))).alias("hashes"))

    # the one-element array binds the words once; a plain reference would be split again per shingle
    return F.element_at(F.transform(F.array(F.array_remove(F.split(text, WHITE), "")), of), 1)


def as_text(s: Column) -> Column:
    """A sketch as a string: the hash of the whole in hex, a colon, the kept hashes in order, HELD_BITS each, in base64."""
    digits = HELD_BITS // 4
    packed = F.unhex(F.array_join(F.transform(s["hashes"], lambda h: F.lpad(F.hex(h), digits, "0")), ""))
    # base64 breaks lines after 76 characters
    return F.concat(F.hex(s["whole"]), F.lit(":"), F.translate(F.base64(packed), "\r\n", ""))


def from_text(t: Column) -> Column:
    """The sketch that as_text wrote."""
    digits = HELD_BITS // 4
    held = F.hex(F.unbase64(F.substring_index(t, ":", -1)))
    places = F.sequence(F.lit(1), F.length(held), F.lit(digits))
    hashes = F.when(F.length(held) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(places, lambda i: F.conv(F.substring(held, i, F.lit(digits)), 16, 10).cast("long")))
    whole = F.lpad(F.substring_index(t, ":", 1), 16, "0")
    # conv() is unsigned: the upper half is read as 32 bits and shifted into place
    high, low = (F.conv(F.substring(whole, at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.struct(F.shiftleft(high, 32).bitwiseOR(low).alias("whole"), hashes.alias("hashes"))


def same_whole(a: Column, b: Column) -> Column:
    """Whether two sketches are of one word sequence; a merge of different ones (whole 0) is of none."""
    return (a["whole"] == b["whole"]) & (a["whole"] != 0)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate of two sketches: 1 for equal word sequences, 0 if nothing was kept of either."""
    both = F.size(F.array_intersect(a["hashes"], b["hashes"]))
    either = F.size(a["hashes"]) + F.size(b["hashes"]) - both
    return F.when(same_whole(a, b), 1.0).when(either == 0, 0.0).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds too; null if nothing was kept of a."""
    return F.when(same_whole(a, b), 1.0).when(F.size(a["hashes"]) > 0, F.size(F.array_intersect(a["hashes"], b["hashes"])) / F.size(a["hashes"]))


def merged(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles together, in any order and grouping; merging a sketch with itself changes nothing.

    Its ``whole`` stays where both are of one word sequence, else it is 0: of no single text.
    """
    return F.struct(F.when(a["whole"] == b["whole"], a["whole"]).otherwise(0).alias("whole"), F.sort_array(F.array_union(a["hashes"], b["hashes"])).alias("hashes"))


def fingerprint_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likenesses.

    The edited text of a document of n code points has its last floor(n / 3) replaced
    by the first as many (or all) of the next document by descending doc_id; after the
    last comes the first. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, contained_edited.

    A null text counts as empty. Null doc_ids come last; rows of equal doc_id follow
    each other by a hash of the text; a lone document is its own next. An empty table
    gives no rows; columns other than doc_id and text are not read.

    Rows are sorted into ranges of near-equal size by (doc_id, hash of the text), so
    null ids and many rows of one id spread like any others; each range gets the next
    one's first row as a guest, the last range the first one's.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = base.withColumns({"_null": F.col("doc_id").isNull(), "_down": F.bitwise_not(F.col("doc_id")), "_hash": F.xxhash64("text")})
    order = ["_null", "_down", "_hash"]
    dealt = ordered.repartitionByRange(parts or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    ranges = materialize(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    heads = ranges.groupBy("_part").agg(F.min(F.struct(*order, "doc_id", "text")).alias("head"))
    # over one row a range
    around = Window.orderBy("_part")
    before = F.coalesce(F.lag("_part").over(around), F.last("_part").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    guests = heads.select(F.col("head.doc_id").alias("doc_id"), F.col("head.text").alias("text"), *[F.col(f"head.{c}").alias(c) for c in order], before.alias("_part"), F.lit(True).alias("_guest"))
    both = ranges.withColumn("_guest", F.lit(False)).unionByName(guests).repartition("_part").withColumn("mine", sketch(F.col("text")))
    along = Window.partitionBy("_part").orderBy("_guest", *order)
    near = both.select("*", F.lead("text").over(along).alias("next_text"), F.lead("mine").over(along).alias("next")).where("not _guest")
    n, cut = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = near.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))).withColumn("theirs", sketch(F.col("edited")))
    mine, theirs, after = F.col("mine"), F.col("theirs"), F.col("next")
    return edited.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(mine).alias("fingerprint"),
        as_text(theirs).alias("edited_fingerprint"),
        likeness(mine, theirs).alias("near_edited"),
        likeness(mine, after).alias("near_next"),
        containment(mine, theirs).alias("contained_edited"),
    )
