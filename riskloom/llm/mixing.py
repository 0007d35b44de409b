"""Mixing of sources to target weights by weighted sampling without replacement.

Each document draws an exponential key at the rate of its quality weight
(Efraimidis and Spirakis); the order of the keys is a weighted sample of every
length. A source first repeats whole epochs while its target allows, and the
rest of the target is the start of the key order, cut by a prefix sum of sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import WORD, attach, staged

#: Weights of the sources in code point order of their names, repeating; null comes last.
SOURCE_WEIGHTS = (5, 2, 1)
#: Share of all words that the mix holds, and the most epochs of a source, in halves and wholes.
BUDGET_HALVES = 3
MAX_EPOCHS = 2
#: Rows of one source that share a block of the prefix sum.
BLOCK_ROWS = 2_000
NOISE = "[0-9#*$%&|<>=_+@{}~^]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: str = "text") -> Column:
    """1 for plain prose, less by four times the share of digits and symbols, at least 0.05; 1 without text."""
    n = F.length(text)
    noise = (n - F.length(F.regexp_replace(text, NOISE, ""))).cast("double")
    return F.when(n > 0, F.greatest(F.lit(0.05), 1.0 - 4.0 * noise / n)).otherwise(1.0)


def draw(*columns: str) -> Column:
    """A number in (0, 1) that depends on the row's values only."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sources: DataFrame) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size, n_docs)``.

    Shares follow the weights; a target stops at ``MAX_EPOCHS`` times its
    source's size and the excess is shared again. The level of this water
    filling is found in one pass over the sources sorted by limit per weight.
    The table has one row per source, so its windows do too.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in SOURCE_WEIGHTS])
    ranked = sources.withColumn("weight", F.element_at(
        weights, ((F.row_number().over(every) - 1) % len(SOURCE_WEIGHTS) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("limit", F.col("source_size") * MAX_EPOCHS)
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Twice the level at which the sources before this row are at their limits and the rest share.
    level = (F.sum("source_size").over(whole) * BUDGET_HALVES - 2 * F.coalesce(F.sum("limit").over(before), F.lit(0))
             ).cast("double") / F.sum("weight").over(rest).cast("double")
    levelled = ranked.withColumn("level2", level)
    open_level = F.min(F.when(F.col("level2") * F.col("weight") <= 2.0 * F.col("limit"), F.struct(
        F.col("limit") / F.col("weight"), F.col("level2")))).over(whole)["level2"]
    target = F.least(F.col("limit").cast("double"), F.coalesce(open_level, F.lit(0.0)) * F.col("weight") / 2.0)
    return levelled.withColumn("target", target).select("source", "source_size", "n_docs", "target")


def mix(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` for each row of ``docs(doc_id, text, source)``.

    ``size`` is the number of words, ``taken`` the words the mix takes from the
    row with repeats: ``size`` times its whole epochs, plus ``size`` once more
    for rows at the start of the source's key order. A row whose middle lies
    before the end of the target is in, so a source misses its target by half
    a document at most.

    Null and empty texts have size 0 and are never taken. Null sources are one
    source, last in order. Null ids are drawn by their text; equal rows share a
    key and stand next to each other in the order. Draws depend on the rows'
    values only, so reruns and retried tasks agree. An empty table gives an
    empty table.
    """
    rows = staged(docs.select(
        F.col("doc_id").cast("long"), "source", word_count().alias("size"),
        (-F.log(draw("doc_id", "text")) / quality_weight()).alias("key")), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    goals = staged(targets(sources), "targets")
    rows = attach(rows, goals, ["source"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    # 1 - exp(-key) is near uniform and grows with the key: its blocks are ranges of the order.
    blocks = F.ceil(F.col("n_docs") / block_rows)
    rows = rows.withColumns({
        "epochs": epochs.cast("long"),
        "block": F.floor((1.0 - F.exp(-F.col("key"))) * blocks).cast("long")})
    sums = rows.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(sums.select("source", "block", F.coalesce(
        F.sum("block_size").over(earlier), F.lit(0)).alias("offset")), "offsets")
    rows = attach(rows, offsets, ["source", "block"])
    inside = Window.partitionBy("source", "block").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # Twice the position of the row's middle against twice the rest of the target.
    middle = 2 * (F.col("offset") + F.sum("size").over(inside)) - F.col("size")
    rest = 2.0 * (F.col("target") - F.col("epochs") * F.col("source_size"))
    once_more = (middle.cast("double") <= rest).cast("long")
    return rows.withColumn("taken", F.col("size") * (F.col("epochs") + once_more)).select(
        "doc_id", "source", "size", "source_size", "target", "taken")
