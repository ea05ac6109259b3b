"""Document fingerprints (operator 2), DataFrame functions only.

The fingerprint of a text is the bottom-k sketch of its word shingles: the ``k`` smallest distinct hashes, ascending. It
depends on the set of shingles alone, so sketches of parts merge into the sketch of the whole, and two
sketches estimate, over the ``k`` smallest hashes of their union, the sets' resemblance, containment and sizes. Sets of
fewer than ``k`` shingles are compared exactly.

Words are the runs of characters other than space, tab and line ends, lower-cased; a shingle is ``shingle_words`` words, or
all words of a shorter text.

Cases: a null text is the empty text, whose sketch is empty; two empty sketches are alike (1.0), an empty and another one
are not (0.0). Equal texts have equal sketches. Repeated rows stay. Empty tables give empty results. Columns other than
those named are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import text_of

#: Hashes of a sketch.
K = 256
#: Characters of the texts of a range, about.
RANGE_CHARS = 16_000_000
#: Hashes are signed 64-bit integers; this many lie between the least and the greatest.
SPAN = 2.0**64


def sketch(text: Column, k: int = K, shingle_words: int = 5) -> Column:
    """Bottom-k sketch of a text column, an ascending array of at most ``k`` hashes.

    Words are hashed once each, and a shingle's hash is taken of its words' hashes.
    """
    words = F.filter(F.split(F.lower(text), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(own: Column) -> Column:
        at = lambda i: F.xxhash64(*(F.get(own, i + j) for j in range(shingle_words)))
        several = F.transform(F.sequence(F.lit(0), F.size(own) - shingle_words), at)
        return F.when(F.size(own) >= shingle_words, several).when(F.size(own) > 0, F.array(F.xxhash64(own))).otherwise(F.array().cast("array<long>"))

    # the hashes of words are computed once: ``transform`` over a one-element array names them
    every = F.flatten(F.transform(F.array(hashed), shingles))
    return F.slice(F.sort_array(F.array_distinct(every)), 1, k)


def merge_sketches(sketches: DataFrame, keys: list[str], k: int = K, column: str = "fingerprint") -> DataFrame:
    """One sketch per ``keys`` from those of its parts. Only the ``k`` smallest hashes per key and task are shuffled."""
    hashes = sketches.select(*keys, F.explode_outer(column).alias("hash")).distinct()
    first = hashes.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("hash").asc_nulls_last()))).filter(F.col("nth") <= k)
    return first.groupBy(*keys).agg(F.sort_array(F.collect_list("hash")).alias(column))


def _union(a: Column, b: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the union's shingles that both texts have, 0 to 1."""
    union = _union(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.coalesce(F.try_divide(both.cast("double"), F.size(union).cast("double")), F.lit(0.0)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else from the place of the k-th smallest hash."""
    share = (F.element_at(a, -1).cast("double") + SPAN / 2) / SPAN
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / F.greatest(share, F.lit(1.0 / SPAN)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that the second has too, 0 to 1; 1.0 for an empty first text."""
    both = resemblance(a, b, k) * distinct_shingles(_union(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def _literal(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _number_above(edges: list[int], x: Column) -> Column:
    """How many of the descending ``edges`` lie above ``x``: first among every n-th of them, then within one run of n."""
    step = max(1, math.isqrt(len(edges)))
    above = lambda own: F.size(F.filter(own, lambda e: e > x))
    run = (F.greatest(above(_literal(edges[::step])) - 1, F.lit(0)) * step).cast("int")
    return run + above(F.slice(_literal(edges), run + 1, step))


def with_next(docs: DataFrame, least_ranges: int) -> DataFrame:
    """Every row's ``doc_id, text`` and the ``next_text`` by descending ``doc_id`` (nulls last), after the last the first;
    with ``range`` and ``copy``, by which rows that are only copies can be told.

    Rows are dealt by ranges of ``doc_id`` that hold about as many rows each, so that a window finds the next one in the
    same range; of each range's first row a copy goes to the range before. There are as many ranges as the texts have times
    ``RANGE_CHARS`` characters, at least ``least_ranges``. The driver sees the ranges' bounds only. Rows of one ``doc_id`` are
    ordered by their text's hash.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    chars = rows.agg(F.sum(F.char_length("text").cast("long")).alias("n")).first()["n"] or 0
    buckets = max(least_ranges, -(-chars // RANGE_CHARS))
    shares = [i / buckets for i in range(1, buckets)]
    bounds = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 8 * buckets)).alias("p")).first()["p"] if shares else []
    edges = sorted(set(bounds or []), reverse=True)  # a range ends where the next bound is passed; null ids fall in the last
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(edges))).otherwise(_number_above(edges, F.col("doc_id")))

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("h")).withColumn("bucket", bucket)
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), (-F.col("h").cast("decimal(20,0)")).alias("h"))
    heads = ids.groupBy("bucket").agg(F.max(key).alias("head")).orderBy("bucket").collect()  # a row per range
    none = F.lit(None).cast("struct<id:long,h:long,to:int>")
    marks = [none] * (len(edges) + 1)  # of each range: its first row, and the range before, which gets a copy
    for i, r in enumerate(heads):
        first = r["head"]["id"] if r["head"]["known"] else None
        marks[r["bucket"]] = F.struct(F.lit(first).cast("long").alias("id"), F.lit(-int(r["head"]["h"])).cast("long").alias("h"), F.lit(heads[i - 1]["bucket"]).alias("to"))
    mark = F.get(F.array(*marks), F.col("bucket"))
    is_first = mark["id"].eqNullSafe(F.col("doc_id")) & (mark["h"] == F.xxhash64("text"))
    own = F.struct(F.col("bucket").alias("range"), F.lit(False).alias("copy"))
    sent = F.when(is_first, F.array(own, F.struct(mark["to"].alias("range"), F.lit(True).alias("copy")))).otherwise(F.array(own))
    dealt = rows.withColumn("bucket", bucket).select("doc_id", "text", F.explode(sent).alias("c")).select("doc_id", "text", "c.range", "c.copy")
    return dealt.withColumn("next_text", F.lead("text").over(following()))


def following() -> Window:
    """Rows of a range by descending ``doc_id``, and after them the copy of the next range's first."""
    return Window.partitionBy("range").orderBy("copy", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))


def edited(text: Column, following: Column) -> Column:
    """``text`` whose last half (rounded down, in code points) is replaced by as much of the start of ``following`` as there is."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def compare_with_next(docs: DataFrame, least_ranges: int, k: int = K, shingle_words: int = 5) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, sketch, edited_sketch, next_sketch`` of every row."""
    rows = with_next(docs, least_ranges).withColumn("edited", edited(F.col("text"), F.col("next_text"))).drop("next_text")
    rows = rows.withColumn("sketch", sketch(F.col("text"), k, shingle_words)).withColumn("edited_sketch", sketch(F.col("edited"), k, shingle_words))
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(following())).filter("NOT copy")
    return rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sketch", "edited_sketch", "next_sketch")


def as_text(values: Column) -> Column:
    """A sketch as a string of 16 hexadecimal digits per hash."""
    return F.array_join(F.transform(values, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")
