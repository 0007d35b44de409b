"""Pairs and triples of columns: separation, hotspots, odds, strength, stability.

All pairs share one scan: the columns are binned once, and cells are counted by
integer codes in matrix products per slice of rows.  The number of cells is at
most bins x bins per pair, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.bands import classify
from riskloom.operators.bins import Edges
from riskloom.operators.correlation import pearson_pairs
from riskloom.operators.drift import CELLS, divergence, side_counts, two_sided
from riskloom.operators.rows import largest, with_row
from riskloom.operators.stats import _plug_in_mi, bin_columns

PAIR = ["left", "right"]
#: Rows that meet in one matrix product.
SLICE_ROWS = 8192


def pairs_of(columns: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(columns, 2))


def _pair_rows(labels: Mapping[str, str | Column], pairs: Sequence[tuple[str, str]]) -> Column:
    name = lambda c: F.col(labels[c]) if isinstance(labels[c], str) else labels[c]
    return F.array(
        *[
            F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.concat(name(a), F.lit("_"), name(b)).alias("cell"))
            for a, b in pairs
        ]
    )


Bins = Mapping[str, Edges]


def _binned(df: DataFrame, columns: Sequence[str], keep: Sequence[Column], bins: Bins | None = None) -> DataFrame:
    return bin_columns(df, columns, fitted=bins).select(*keep, *[f"__b_{c}" for c in columns])


def _names(columns: Sequence[str]) -> dict[str, str]:
    return {c: f"__b_{c}" for c in columns}


def _cube(df: DataFrame, columns: Sequence[str], target: str, degree: int, bins: Bins | None = None) -> tuple[DataFrame, Callable[[str], Column], Callable[[str], Column]]:
    """Counts of all cells of two or three columns, and functions that name a code's column and its bin.

    The frame has ``f`` (-1 for pairs), ``a``, ``b``, ``n`` and ``positives``. A
    bin of a column has one code over all columns; rows become rows of zeros
    and ones, and a matrix product per slice of them counts all cells at once.
    A task sends one row per cell, whatever its number of rows; it holds
    (columns x bins) to the power ``degree`` numbers. Names are attached last.
    """
    binned = _binned(df, columns, [F.col(target).alias("y")], bins)
    seen = binned.agg(*[F.array_sort(F.collect_set(f"__b_{c}")).alias(c) for c in columns]).first()
    bins = [list(seen[c]) or [""] for c in columns]  # a few bins a column
    base = max(len(b) for b in bins)
    width = len(columns) * base
    codes = [F.array_position(F.array(*map(F.lit, b)), F.col(f"__b_{c}")).cast("int") - 1 + i * base for i, (c, b) in enumerate(zip(columns, bins))]
    blocks = [(-1, 0)] if degree == 2 else [(f, (f // base + 1) * base) for f in range(width - base)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            y = batch.column(0).to_numpy(zero_copy_only=False)
            weights = np.stack([np.ones(len(y)), ~np.isnan(y), np.nan_to_num(y)])
            for start in range(0, len(y), SLICE_ROWS):
                piece = at[start : start + SLICE_ROWS]
                hot = np.zeros((len(piece), width))
                np.put_along_axis(hot, piece, 1.0, axis=1)
                for first, low in blocks:
                    rows = np.arange(len(piece)) if first < 0 else np.flatnonzero(hot[:, first])
                    if len(rows):
                        part = hot[rows, low:]
                        more = np.stack([part.T @ (part * w[start + rows, None]) for w in weights])
                        sums[first] = sums[first] + more if first in sums else more
        for first, low in blocks:
            if first in sums:
                a, b = np.nonzero(sums[first][0])
                pair = (a + low) // base < (b + low) // base
                a, b = a[pair], b[pair]
                _, n, positives = sums[first][:, a, b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(a), first, dtype=np.int32)), pa.array((a + low).astype(np.int32)), pa.array((b + low).astype(np.int32)),
                     pa.array(n.astype(np.int64)), pa.array(positives)], names=["f", "a", "b", "n", "positives"])

    parts = binned.select(F.col("y").cast("double").alias("y"), F.array(*codes).alias("codes")).mapInArrow(
        run, "f int, a int, b int, n long, positives double")
    kind = "double" if dict(df.dtypes)[target] in ("float", "double") else "long"
    total = F.when(F.sum("n") > 0, F.sum("positives")).cast(kind)
    cells = parts.groupBy("f", "a", "b").agg(F.sum("n").alias("n"), total.alias("positives"))
    names = F.array(*map(F.lit, columns))
    labels = F.array(*[F.lit(x) for b in bins for x in b + [""] * (base - len(b))])
    return cells, lambda c: F.get(names, F.floor(F.col(c) / base).cast("int")), lambda c: F.get(labels, F.col(c))


def pair_cells(df: DataFrame, columns: Sequence[str], target: str, bins: Bins | None = None) -> DataFrame:
    """``(left, right, cell, n, positives)`` of every pair; rows without a label count in neither, NaN labels as none.

    Here and below, ``bins`` are those of ``fit_bins`` on ``df`` and ``cells`` these cells, if they are there.
    """
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "left string, right string, cell string, n long, positives long")
    cells, name, label = _cube(df, columns, target, 2, bins)
    return cells.select(name("a").alias("left"), name("b").alias("right"), F.concat(label("a"), F.lit("_"), label("b")).alias("cell"), "n", "positives")


def class_separation(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Distance of the two class centroids per pair, Pearson r and overlap index."""
    zero = F.lit(0.0)
    filled = df.select(F.col(target).alias("__y"), *[F.coalesce(F.col(c).cast("double"), zero).alias(c) for c in columns])
    sizes = [F.count(F.when(F.col("__y") == k, 1)).alias(f"n{k}") for k in (0, 1)]
    gaps = [(F.avg(F.when(F.col("__y") == 1, F.col(c))) - F.avg(F.when(F.col("__y") == 0, F.col(c)))).alias(c) for c in columns]
    one = filled.agg(*sizes, *gaps)
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b)).alias("d"))
            for a, b in pairs_of(columns)
        ]
    )
    dist = one.select("n0", "n1", F.explode(rows).alias("p")).select(
        "p.left", "p.right", F.when((F.col("n0") > 5) & (F.col("n1") > 5), F.col("p.d")).otherwise(0.0).alias("distance")
    )
    return dist.join(pearson_pairs(filled, columns), PAIR).withColumn("overlap_index", F.lit(1.0) / (F.lit(1.0) + F.col("distance")))


def _hot(cells: DataFrame, keys: Sequence[str], df: DataFrame, target: str, support: int) -> DataFrame:
    rate = F.col("positives") / F.col("n")
    enough = cells.filter(F.col("n") >= support)
    best = F.min_by(F.struct("cell", "n", rate.alias("rate")), F.struct(-rate, F.col("cell"))).alias("b")
    overall = df.agg(F.avg(target).alias("__rate"))
    return (
        enough.groupBy(*keys).agg(best).select(*keys, "b.*").transform(with_row, overall)
        .withColumn("lift", F.try_divide(F.col("rate"), F.col("__rate"))).drop("__rate")
    )


def pair_hotspots(df: DataFrame, columns: Sequence[str], target: str, support: int = 15, *, cells: DataFrame | None = None) -> DataFrame:
    """Cell with the highest rate per pair, its lift, and its rate over the mean of the other cells."""
    cells = pair_cells(df, columns, target) if cells is None else cells
    hot = _hot(cells, PAIR, df, target, support)
    sums = cells.groupBy(*PAIR).agg(F.sum(F.col("positives") / F.col("n")).alias("s"), F.count(F.lit(1)).alias("k"))
    out = hot.join(sums, PAIR)
    outside = F.when(F.col("k") > 1, F.try_divide(F.col("s") - F.col("rate"), F.col("k") - 1)).otherwise(F.col("s"))
    risk = F.when(outside > 0, F.col("rate") / outside).otherwise(1.0)
    return out.withColumn("relative_risk", risk).drop("s", "k")


def triple_hotspots(df: DataFrame, columns: Sequence[str], target: str, support: int = 10, *, bins: Bins | None = None) -> DataFrame:
    """Cell with the highest rate of every triple of columns, and its lift."""
    cells, name, label = _cube(df, columns, target, 3, bins)
    keys = ["first", "second", "third"]
    named = cells.select(
        *[name(c).alias(k) for c, k in zip("fab", keys)], F.concat_ws("_", *map(label, "fab")).alias("cell"), "n", "positives",
    )
    return _hot(named, keys, df, target, support)


def cell_odds(
    df: DataFrame, columns: Sequence[str], target: str, support: int = 10, top: int | None = None, *, cells: DataFrame | None = None
) -> DataFrame:
    """Odds ratio (plus one half in every cell) and lift of all cells, or of the ``top`` by lift."""
    cells = (pair_cells(df, columns, target) if cells is None else cells).filter(F.col("n") >= support)
    overall = df.agg(F.sum(target).alias("p"), F.count(F.lit(1)).alias("rows"))
    a = F.col("positives") + 0.5
    b = F.col("n") - F.col("positives") + 0.5
    c = F.col("p") - F.col("positives") + 0.5
    d = (F.col("rows") - F.col("p")) - (F.col("n") - F.col("positives")) + 0.5
    rate = F.col("positives") / F.col("n")
    out = cells.transform(with_row, overall).select(
        *PAIR, "cell", "positives", (F.col("n") - F.col("positives")).alias("negatives"), rate.alias("rate"),
        F.coalesce(F.try_divide(rate * F.col("rows"), F.col("p")), F.lit(1.0)).alias("lift"), ((a / b) / (c / d)).alias("odds_ratio"),
    )
    return largest(out, [F.col("lift").desc(), *PAIR, "cell"], top)


def interaction_strength(
    df: DataFrame, columns: Sequence[str], target: str, *, bins: Bins | None = None, cells: DataFrame | None = None
) -> DataFrame:
    """Joint mutual information with the label beyond the two single ones."""
    cells = pair_cells(df, columns, target, bins) if cells is None else cells
    labelled = cells.select(
        *PAIR, "cell",
        F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col("positives").alias("n")), F.struct(F.lit(0).alias("y"), (F.col("n") - F.col("positives")).alias("n")))).alias("x"),
    ).select(*PAIR, "cell", "x.y", "x.n").filter("n > 0")
    joint = _plug_in_mi(labelled, PAIR).withColumnRenamed("mi", "joint_mi")
    binned = _binned(df, columns, [F.col(target).alias("y")], bins)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"__b_{c}").alias("cell")) for c in columns])
    single = _plug_in_mi(
        binned.select("y", F.explode(rows).alias("r")).select("y", "r.*").groupBy("feature", "cell", "y").agg(F.count(F.lit(1)).alias("n")),
        ["feature"],
    )
    left = single.select(F.col("feature").alias("left"), F.col("mi").alias("left_mi"))
    right = single.select(F.col("feature").alias("right"), F.col("mi").alias("right_mi"))
    return joint.join(left, "left").join(right, "right").withColumn("strength", F.col("joint_mi") - F.col("left_mi") - F.col("right_mi"))


def recommended_interactions(strength: DataFrame, k: int | None = None) -> DataFrame:
    """A product and a ratio of every pair, or of the ``k`` strongest."""
    top = largest(strength, [F.col("strength").desc(), *PAIR], k)
    recipes = F.array(
        F.concat(F.lit("Product: "), F.col("left"), F.lit(" * "), F.col("right")),
        F.concat(F.lit("Ratio: "), F.col("left"), F.lit(" / ("), F.col("right"), F.lit(" + 1e-5)")),
    )
    return top.select(*PAIR, "strength", F.explode(recipes).alias("recipe"))


def interaction_stability(train: DataFrame, test: DataFrame, columns: Sequence[str], *, bins: Bins | None = None) -> DataFrame:
    """PSI of the joint cells; each frame is binned by its own quartiles, ``bins`` are those of ``train``."""
    a, b = _binned(train, columns, [], bins), _binned(test, columns, [])
    names = _names(columns)
    long = two_sided(a, b, list(names.values())).select("side", F.explode(_pair_rows(names, pairs_of(columns))).alias("p")).select("side", "p.*")
    counts = side_counts(long, [*PAIR, "cell"])
    totals = counts.groupBy(*PAIR).agg(F.sum("n_train").alias("t_train"), F.sum("n_test").alias("t_test"))
    return divergence(counts, totals, CELLS, PAIR).withColumn("stability", classify("psi_level", "psi"))


def production_screen(
    train: DataFrame, stability: DataFrame, columns: Sequence[str], target: str, *, cells: DataFrame | None = None
) -> DataFrame:
    """REMOVE drifting pairs, MERGE sparse ones, RETAIN the rest."""
    cells = pair_cells(train, columns, target) if cells is None else cells
    size = train.agg(F.count(F.lit(1)).alias("rows"))
    sparse = (
        cells.transform(with_row, size).groupBy(*PAIR)
        .agg((F.avg((F.col("n") < F.col("rows") * 0.01).cast("double")) * 100.0).alias("sparse_pct"))
    )
    action = F.when(F.col("psi") >= 0.25, "REMOVE").when(F.col("sparse_pct") >= 60, "MERGE").otherwise("RETAIN")
    return stability.join(sparse, PAIR).select(*PAIR, "psi", "sparse_pct", action.alias("action"))


def interaction_inventory(df: DataFrame, columns: Sequence[str], mi: DataFrame, k: int | None = None) -> DataFrame:
    """Candidates with their distinct values: all, or the ``k`` most informative."""
    seen = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_unique")) for c in columns])
    long = seen.select(F.explode(rows).alias("r")).select("r.*")
    return largest(long.join(mi, "feature").filter("n_unique > 1"), [F.col("mi").desc(), "feature"], k)
