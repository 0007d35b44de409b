"""Benchmark passages in documents, by SimHash over item-sized windows.

A window is a run of as many words as a benchmark item has. Windows are formed
where the document shares a word shingle with an item of that size (any other
window has similarity 0), and start at the shared shingle: moving a window
right to the first shared shingle never loses one. The 64-bit SimHash of a
window meets the items of its size in a multi-index: fingerprints within
``RADIUS`` bits agree in at least one of eight 8-bit blocks up to
``BLOCK_RADIUS`` bits. Candidates are then checked exactly by the similarity of
the two bags of shingles. Everything is column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import BROADCAST_BYTES, WORD, attach, measured_bytes, staged

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Bags with similarity 0.8 differ in 10 bits on average (deviation 3), so 23 bits miss about one window in 10^5.
RADIUS = 23
BLOCKS, BLOCK_BITS = 8, 8
BLOCK_RADIUS = RADIUS // BLOCKS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: str = "text") -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))


def shingles(word_array: Column, k: int) -> Column:
    """Hashes of the runs of ``k`` words in order; of the whole sequence where it is shorter."""

    def runs(hashes: Column) -> Column:
        n = F.size(hashes)
        run = lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)])
        return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), run)).when(
            n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<long>"))

    return let(F.transform(word_array, lambda w: F.xxhash64(w)), runs)


def simhash(hashes: Column) -> Column:
    """Fingerprint whose bit is 1 if it is set in over half of the array's hashes.

    Two bits are counted at a time, in the halves of a long.
    """
    n = F.size(hashes)
    half = F.lit(0xFFFFFFFF)

    def both(acc: Column, s: Column) -> Column:
        counts = F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.call_function(
            "shiftrightunsigned", h, s).bitwiseAND(F.lit(0x100000001)))
        one = F.lit(1).cast("long")
        return let(counts, lambda c: acc.bitwiseOR(
            F.when(2 * c.bitwiseAND(half) > n, F.call_function("shiftleft", one, s)).otherwise(F.lit(0).cast("long"))
        ).bitwiseOR(
            F.when(2 * F.shiftrightunsigned(c, 32) > n, F.call_function("shiftleft", one, s + 32)).otherwise(F.lit(0).cast("long"))))

    return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), both)


def bag(hashes: Column) -> Column:
    """The array with repeats told apart by their count, so that bags can be intersected as sets."""
    marked = F.transform(hashes, lambda h, i: let(
        F.size(F.filter(F.slice(hashes, F.lit(1), i), lambda x: x == h)),
        lambda seen: F.when(seen > 0, F.xxhash64(h, seen)).otherwise(h)))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), hashes).otherwise(marked)


def block_value(fp: Column, block: Column) -> Column:
    return F.call_function("shiftrightunsigned", fp, (block * BLOCK_BITS).cast("int")).bitwiseAND(F.lit(2**BLOCK_BITS - 1))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """``(item_id, k, n, shingles, fp)`` of each item with a word; ``k`` words a shingle, ``n`` shingles."""
    split = benchmark.select(F.col("item_id").cast("long"), words().alias("w")).filter(F.size("w") > 0)
    sizes = [F.when(F.size("w") == k, shingles(F.col("w"), k)) for k in range(1, SHINGLE_WORDS)]
    items = split.select("item_id", F.least(F.size("w"), F.lit(SHINGLE_WORDS)).alias("k"),
                         F.coalesce(*sizes, shingles(F.col("w"), SHINGLE_WORDS)).alias("s"))
    return items.select("item_id", "k", F.size("s").alias("n"), F.col("s").alias("shingles"), simhash(F.col("s")).alias("fp"))


def multi_index(items: DataFrame) -> DataFrame:
    """``(k, n, block, value)`` of every block value within ``BLOCK_RADIUS`` bits of an item's."""
    flips = [v for v in range(2**BLOCK_BITS) if v.bit_count() <= BLOCK_RADIUS]
    rows = items.select("k", "n", "item_id", "fp", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    rows = rows.withColumn("flip", F.explode(F.array(*[F.lit(v) for v in flips])))
    value = block_value(F.col("fp"), F.col("block")).bitwiseXOR(F.col("flip")).cast("int")
    return rows.select("k", "n", "block", value.alias("value"), "item_id", F.col("fp").alias("item_fp"))


def _marked(docs: DataFrame) -> DataFrame:
    """``mark``, a hash of the text, tells rows with the same id apart."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text")


def anchors(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """``(doc_id, mark, at)``: positions of shingles shared with an item, each with the item's number of shingles."""
    shared = items.filter(F.col("k") == k).select(F.explode("shingles").alias("h"), "n").distinct()
    hashed = _marked(docs).select("doc_id", "mark", F.posexplode(shingles(words(), k)).alias("pos", "h"))
    met = hashed.join(F.broadcast(shared), "h")
    return met.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("n", "pos")).alias("at"))


def windows(docs: DataFrame, at: DataFrame, k: int) -> DataFrame:
    """``(doc_id, n, window, fp)``: runs of ``n`` shingles that start at a shared one, and their SimHash.

    Near the end of a document a window starts early enough to fit.
    """

    def of_document(hashes: Column) -> Column:
        start = lambda a: F.greatest(F.lit(0), F.least(a["pos"], F.size(hashes) - a["n"]))
        starts = F.array_distinct(F.transform("at", lambda a: F.struct(a["n"].alias("n"), start(a).alias("start"))))
        return F.transform(starts, lambda a: let(F.slice(hashes, a["start"] + 1, a["n"]), lambda w: F.struct(
            a["n"].alias("n"), w.alias("window"), simhash(w).alias("fp"))))

    rows = attach(_marked(docs), at, ["doc_id", "mark"], "inner")
    found = rows.select("doc_id", F.explode(let(shingles(words(), k), of_document)).alias("w"))
    return found.select("doc_id", "w.n", "w.window", "w.fp")


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, item_id, similarity)`` of each document and benchmark item that share a passage.

    The shared shingles of the benchmark are broadcast in blocks of items whose
    measured size stays under ``BROADCAST_BYTES``; each block is one pass over
    the documents, and one more over those that share a shingle.
    """
    items = staged(benchmark_items(benchmark), "items")
    bags = staged(items.select("item_id", "k", F.col("n").alias("item_n"), bag(F.col("shingles")).alias("item_bag")), "bags")
    parts = max(1, -(-measured_bytes(items) * 3 // BROADCAST_BYTES))
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most SHINGLE_WORDS values
    found = None
    for part in range(parts):
        block = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        index = staged(multi_index(block), "index")
        for k in sizes:
            at = staged(anchors(docs, block, k), "anchors")
            rows = windows(docs, at, k).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
            rows = rows.withColumn("value", block_value(F.col("fp"), F.col("block")).cast("int"))
            near = attach(rows, index.filter(F.col("k") == k).drop("k"), ["n", "block", "value"], "inner")
            near = near.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
            near = attach(near, bags.filter(F.col("k") == k).drop("k"), ["item_id"], "inner")
            common = F.size(F.array_intersect(bag(F.col("window")), F.col("item_bag")))
            exact = near.withColumn("similarity", common / (F.size("window") + F.col("item_n") - common))
            exact = exact.filter(F.col("similarity") >= similarity).select("doc_id", "item_id", "similarity")
            found = exact if found is None else found.unionAll(exact)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double")
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, contaminated, n_items, item_id, similarity)`` for each row of ``docs(doc_id, text)``.

    A document is contaminated if a window of as many words as an item has
    reaches ``similarity`` with it: shared over all five-word shingles, repeats
    counted, letters lower-cased. ``item_id`` is the most similar item (the
    smallest of equal ones); null where there is none.

    Null and empty texts, and items without a word, match nothing. An item of
    fewer than five words is one shingle, and matches a run of exactly its
    words. Rows that share a doc_id share their result; null ids count as one
    id. Other columns are not read. Empty tables give no matches.
    """
    best = F.struct(F.col("similarity"), -F.col("item_id"))
    hits = matches(docs, benchmark, similarity).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.max_by("item_id", best).alias("item_id"),
        F.max("similarity").alias("similarity"))
    rows = attach(docs.select(F.col("doc_id").cast("long")), staged(hits, "hits"), ["doc_id"])
    return rows.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"),
                       F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), "item_id", "similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage."""
    hits = staged(matches(docs, benchmark, similarity).select("doc_id").distinct(), "hits")
    return attach(docs, hits, ["doc_id"], "left_anti")
