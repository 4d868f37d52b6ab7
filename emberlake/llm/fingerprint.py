"""Bottom-k sketches of word shingles.

Native DataFrame operations only. A sketch is the sorted array of the ``K`` smallest
64-bit hashes of a text's distinct shingles of ``SHINGLE`` words (a shorter text has
its whole word sequence as one, a text without words none). Sketches of parts merge
into that of the whole, and give resemblance, containment and distinct count.

Defined results: a null text is empty; two empty sketches are alike (1.0), an empty
and another are not (0.0); equal texts have equal sketches; rows that share a doc_id
follow each other by a hash of their text; a null doc_id comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm.shared import cut, let

K = 128
SHINGLE = 5
#: Stands for a null doc_id among the keys.
NO_ID = -(2**63)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(words: Column, n: int = SHINGLE) -> Column:
    """One signed 64-bit hash for each run of n words, repeats included."""

    def of(w: Column) -> Column:
        whole = F.array(F.xxhash64(F.array_join(w, " "), F.lit(0)))
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(n))))
        return F.when(F.size(w) >= n, runs).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return let(words, of)


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.array_distinct(F.sort_array(hashes)), 1, k)


def sketch(text: Column, k: int = K) -> Column:
    return bottom_k(shingle_hashes(words_of(text)), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the k smallest hashes of the union that both have."""
    shared = lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b)))
    return let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(shared(u) / F.greatest(F.size(u), F.lit(1)).cast("double")))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    largest = lambda x: (F.element_at(x, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return let(a, lambda x: F.when(F.size(x) < k, F.size(x).cast("double")).otherwise((k - 1) / largest(x)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: resemblance times union size over a's size, at most 1."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / distinct_count(a, k)))


def to_text(a: Column) -> Column:
    """16 hexadecimal digits a hash, in order."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, fingerprint (array of k hashes at most), n_distinct (estimate)."""
    out = docs.select("doc_id", sketch(F.coalesce(F.col("text"), F.lit("")), k).alias("fingerprint"))
    return out.withColumn("n_distinct", distinct_count(F.col("fingerprint"), k))


#: A document's place in the order, and what tells texts of one doc_id apart.
_PLACE = ("key", "text_hash")


def _placed(docs: DataFrame) -> DataFrame:
    """key (never null), text_hash, body."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(body).alias("text_hash"), body.alias("body"))


def next_links(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(key, text_hash, prev_key, prev_text_hash, prev_n): each distinct row and the one before it, the last coming before the first; whether rows repeat.

    Rows are dealt into ranges of equal size by (key, text_hash), so rows that share a
    doc_id, or have none, are spread too; only the first and last of each range (a few
    rows for many thousands) meet in one place.
    """
    narrow = _placed(docs).select(*_PLACE, F.length("body").cast("long").alias("n")).groupBy(*_PLACE).agg(F.first("n").alias("n"), F.count("*").alias("copies"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(narrow.repartitionByRange(parts, *_PLACE).withColumn("part", F.spark_partition_id()), "ids")
    inside = Window.partitionBy("part").orderBy(*_PLACE)
    fields = (*_PLACE, "n")
    rows = ranged.select(*_PLACE, "part", *(F.lag(c).over(inside).alias(f"prev_{c}") for c in fields))
    ends = ranged.groupBy("part").agg(F.max(F.struct(*fields)).alias("last"))
    order = Window.orderBy("part")
    everything = Window.partitionBy()
    joints = ends.select(F.col("part").alias("_part"), F.coalesce(F.lag("last").over(order), F.max("last").over(everything)).alias("_prev"))
    rows = rows.join(F.broadcast(joints), F.col("part") == F.col("_part"))  # one row for each shuffle partition
    pick = lambda c: F.when(F.col("prev_key").isNull(), F.col(f"_prev.{c}")).otherwise(F.col(f"prev_{c}")).alias(f"prev_{c}")
    return rows.select(*_PLACE, *(pick(c) for c in fields)), bool(ranged.where("copies > 1").take(1))


def edited_pairs(docs: DataFrame, k: int = K) -> DataFrame:
    """Each document with its edited text: the last quarter replaced by as much of the next document's beginning.

    Texts are shuffled once by place. To the document before it each one sends its sketch
    and only as much of its text as that edit takes. Rows with equal doc_id and text, if
    there are any, are one row with a count on the way: each but the last is followed by
    its like.
    """
    links, repeated = next_links(docs)
    links = links.select(F.col("key").alias("_key"), F.col("text_hash").alias("_hash"), "prev_key", "prev_text_hash", "prev_n")
    own = _placed(docs)
    if repeated:
        own = own.groupBy(*_PLACE).agg(F.first("body").alias("body"), F.count("*").alias("copies"))
    else:
        own = own.repartition(*_PLACE)  # by what both joins below ask for, so that one exchange of the texts alone serves both
    own = own.withColumn("sketch", sketch(F.col("body"), k))
    at = lambda key, text: (F.col("key") == F.col(key)) & (F.col("text_hash") == F.col(text))
    sent = own.join(links, at("_key", "_hash")).select(F.col("prev_key").alias("_to"), F.col("prev_text_hash").alias("_to_hash"), F.expr("left(body, cast(prev_n div 4 as int))").alias("prefix"), F.col("sketch").alias("next_sketch"))
    both = own.join(sent, at("_to", "_to_hash")).select("key", "body", "sketch", "prefix", "next_sketch", F.lit(1).cast("long").alias("times"))
    if repeated:
        both = both.union(own.where("copies > 1").select("key", "body", "sketch", F.expr("left(body, length(body) div 4)").alias("prefix"), F.col("sketch").alias("next_sketch"), F.col("copies") - 1))
    both = both.withColumn("n", F.length("body")).withColumn("edited", F.expr("concat(left(body, n - n div 4), prefix)"))
    return both.select(F.nullif("key", F.lit(NO_ID)).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "body", "edited", "sketch", sketch(F.col("edited"), k).alias("edited_sketch"), "next_sketch", "times")


def op8_fingerprint(docs: DataFrame) -> DataFrame:
    out = edited_pairs(docs.select("doc_id", "text")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), to_text(F.col("sketch")).alias("fingerprint"), to_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"), "times")
    return out.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times", "time")
