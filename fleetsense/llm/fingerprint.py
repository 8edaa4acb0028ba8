"""Document fingerprints: bottom-k sketches of hashed word shingles, as DataFrame expressions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's shingles. Sketches of parts merge into
the sketch of the whole. Two sketches estimate resemblance, containment and distinct counts; where both hold all their
shingles (fewer than k) the estimates are exact.

A shingle is five words (longest runs without space and 0x09-0x0D, A-Z lower-cased together with all other letters); a
text of fewer words is one shingle; a text without words, null or empty, has the empty sketch. Two empty sketches
resemble each other fully. Extra columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WORDS = 128, 5
WIDTH = 256                     # ids in a block of the neighbour search


def with_sketch(rows: DataFrame, text: str, out: str, k: int = K, n: int = WORDS) -> DataFrame:
    """rows with the bottom-k sketch (array<long>) of a text column.

    The hashed words are a column of their own that the shingles index many times, so Spark computes it once a row."""
    words = F.filter(F.split(F.lower(text), "[ \t\n\x0b\f\r]+", -1), lambda w: w != "")
    rows = rows.withColumn("hashed_", F.transform(words, lambda w: F.xxhash64(w)))
    places = F.when(F.size("hashed_") > 0, F.sequence(F.lit(0), F.greatest(F.size("hashed_") - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    grams = F.transform(places, lambda i: F.xxhash64(*(F.get("hashed_", i + j) for j in range(n))))
    return rows.withColumn(out, F.slice(F.sort_array(F.array_distinct(grams)), 1, k)).drop("hashed_")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sets of shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of common shingles among all: the part of the merged sketch that is in both."""
    both = F.array_intersect(merge(a, b, k), F.array_intersect(a, b))
    whole = F.size(merge(a, b, k))
    return F.when(whole == 0, F.lit(1.0)).otherwise(F.size(both) / whole)


def distinct(a: Column, k: int = K) -> Column:
    """Distinct shingles: exact below k, else (k - 1) over the share of the hash range that k hashes take."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of the shingles of a that are in b: resemblance times the union, over the size of a."""
    size = distinct(a, k)
    return F.when(size == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * distinct(merge(a, b, k), k) / size))


def merged(sketches: DataFrame, by: str, column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each value of `by` from the sketches of its parts. Only the k smallest hashes of a group remain after
    each partial step: ranks are taken within salted parts first, so no group meets in one task as a whole."""
    rows = sketches.select(by, F.explode(column).alias("hash"), F.pmod(F.xxhash64(column), F.lit(64)).alias("salt")).distinct()
    part = Window.partitionBy(by, "salt").orderBy("hash")
    rows = rows.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k).select(by, "hash").distinct()
    whole = Window.partitionBy(by).orderBy("hash")
    rows = rows.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k)
    return rows.groupBy(by).agg(F.sort_array(F.collect_list("hash")).alias(column))


def as_text(a: Column) -> Column:
    """A sketch as a string: 16 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def block_starts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, before): the largest id of each block of ids, and the block that comes before it in descending order.

    The neighbour of a block is found among blocks of blocks of blocks, so the only window without a key runs over ids
    divided by width cubed. The first block of all follows the last."""
    blocks = docs.where("doc_id is not null").groupBy(F.expr(f"doc_id div {width} - if(doc_id < 0, 1, 0)").alias("b0")).agg(F.max("doc_id").alias("top"))
    blocks = blocks.withColumn("b1", F.floor(F.col("b0") / width)).withColumn("b2", F.floor(F.col("b1") / width))

    def previous(rows: DataFrame, key: str, group: str | None) -> DataFrame:
        """The next larger value of key, within the group if there is one."""
        w = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy(F.desc(key))
        return rows.withColumn("before", F.lag(key).over(w))

    top2 = previous(blocks.groupBy("b2").agg(F.min("b1").alias("low1")), "b2", None)
    low2 = top2.select(F.col("b2").alias("before"), F.col("low1").alias("far1"))
    top2 = top2.join(low2, "before", "left").select("b2", "far1")
    level1 = previous(blocks.groupBy("b1", "b2").agg(F.min("b0").alias("low0")), "b1", "b2")
    level1 = level1.join(top2, "b2").withColumn("before", F.coalesce("before", "far1"))
    low1 = level1.select(F.col("b1").alias("before"), F.col("low0").alias("far0"))
    level1 = level1.select("b1", "before").join(low1, "before", "left").select("b1", "far0")
    level0 = previous(blocks, "b0", "b1").join(level1, "b1").withColumn("before", F.coalesce("before", "far0"))
    ends = blocks.agg(F.min("b0").alias("lowest"))
    return level0.crossJoin(F.broadcast(ends)).select(F.col("top").alias("doc_id"), F.coalesce("before", "lowest").alias("before"))


def with_next(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text, next_text: the text of the next document in descending order of doc_id; the first follows the last.

    Ids are cut into blocks of `width` values, so a window holds few texts; the first text of a block is also sent to the
    block before it. The texts are shuffled once. Rows that share an id follow each other by the hash of their texts; rows
    with null ids come after the last id, before the first one."""
    block = F.expr(f"if(doc_id is null, null, doc_id div {width} - if(doc_id < 0, 1, 0))")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    starts = block_starts(rows.select("doc_id"), width)
    ghosts = rows.join(starts, "doc_id").groupBy("doc_id", "before").agg(F.min_by("text", "tie").alias("text"), F.min("tie").alias("tie"))
    both = rows.select("doc_id", "text", "tie", block.alias("block"), F.lit(False).alias("ghost")).union(
        ghosts.select("doc_id", "text", "tie", F.col("before").alias("block"), F.lit(True).alias("ghost")))
    order = Window.partitionBy("block").orderBy("ghost", F.desc("doc_id"), "tie")
    out = both.withColumn("next_text", F.lead("text").over(order)).where("not ghost")
    return out.select("doc_id", "text", F.coalesce("next_text", F.lit("")).alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """The last third of a text replaced by as many code points from the start of another."""
    cut = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(following, F.lit(1), cut))
