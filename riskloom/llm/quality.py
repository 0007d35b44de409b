"""Quality rules: fixed limits, then robust outliers per language and source.

Each document becomes a vector of transformed statistics. Per language and
source, concentration steps approach the minimum covariance determinant: mean
and covariance of the three quarters of the documents that lie closest, again
and again. Documents far off by the resulting Mahalanobis distance go. All of
it is grouped aggregates and column expressions; quantiles are taken of rounded
values, so a group needs one count per rounded value however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import WORD, WORD_SPACES, attach, staged
from riskloom.llm.decontam import let

SYMBOLS = "[#*$%&|<>]"
WINDOW_WORDS = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
#: Share of a group that the estimate rests on, and concentration steps.
SUBSET = 0.75
STEPS = 3
#: Groups below this size share the estimate of their language's small groups, and pools below it that of all documents.
MIN_GROUP = 50
#: The group number of the estimate from all documents.
EVERYONE = 0
#: Standard deviations added to each statistic: differences of this size are never telling.
FLOORS = {"x_words": 0.1, "x_length": 0.05, "x_symbols": 0.1, "x_lines": 0.1, "x_repeats": 0.15}
DIMS = list(FLOORS)
#: A covariance determinant is defined from more than twice as many rows as statistics.
MIN_ROWS = 2 * len(DIMS) + 1
#: Median and 1 - 10^-6 quantile of the chi-square distribution with five degrees of freedom.
CHI_MEDIAN, CHI_LIMIT = 4.3515, 35.89


def repeat_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW_WORDS`` words that occur at least twice in the array."""
    k = WINDOW_WORDS

    def covered(starts: Column) -> Column:
        last = F.size(starts) - 1
        steps = F.transform(starts, lambda s, i: F.when(i == last, F.lit(k)).otherwise(
            F.least(F.lit(k), F.get(starts, i + 1) - s)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def in_order(pairs: Column) -> Column:
        again = F.filter(pairs, lambda p, i: (F.get(pairs, i + 1)["h"] == p["h"]) | (
            (i > 0) & (F.get(pairs, F.greatest(i - 1, F.lit(0)))["h"] == p["h"])))
        return let(F.array_sort(F.transform(again, lambda p: p["i"])), covered)

    def of_windows(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, in_order))

    def of_hashes(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: F.xxhash64(F.slice(hashes, i + 1, k)))
        return F.when(F.size(hashes) > k, let(windows, of_windows)).otherwise(F.lit(0))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines)``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    of_words = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeat_words(w).cast("long").alias("n_repeat_words")))
    of_lines = let(F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(f"[^{WORD_SPACES}]"))), lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")
    rows = docs.select(F.col("doc_id").cast("long"), "lang", "source", of_words.alias("w"), of_lines.alias("l"),
                       symbols.alias("n_symbols"))
    return rows.select("doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines",
                       "w.n_repeat_words", "l.n_lines")


def vectors() -> dict[str, Column]:
    """Logarithms of counts and square roots of shares, which are close to symmetric for prose.

    One repeated line is no sign of an outlier, so lines count from the second repeat.
    """
    words, chars = F.col("n_words"), F.col("word_chars")
    return {
        "x_words": F.log(1.0 + words),
        "x_length": F.log((1.0 + chars) / (1.0 + words)),
        "x_symbols": F.sqrt(F.col("n_symbols") / (1.0 + chars)),
        "x_lines": F.sqrt(F.greatest(F.col("n_dup_lines") - 1, F.lit(0)) / (1.0 + F.col("n_lines"))),
        "x_repeats": F.sqrt(F.col("n_repeat_words") / (1.0 + words)),
    }


def _exact_sum(value: Column) -> Column:
    """Sum in fixed point: the same in every order of the rows."""
    return F.sum(F.round(value * (1 << 20)).cast("long")) / float(1 << 20)


def _group_ids(rows: DataFrame) -> DataFrame:
    """``(lang, source, gid)``: own group, or the pool of its language's small ones, or ``EVERYONE``."""
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = sizes.filter(F.col("n") < MIN_GROUP).groupBy("lang").agg(F.sum("n").alias("pool"))
    small = small.withColumnRenamed("lang", "__lang")
    sizes = sizes.join(small, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    gid = F.when(F.col("n") >= MIN_GROUP, F.xxhash64(F.lit(2), "lang", "source")).when(
        F.col("pool") >= MIN_GROUP, F.xxhash64(F.lit(1), "lang")).otherwise(F.lit(EVERYONE).cast("long"))
    return sizes.select("lang", "source", gid.alias("gid"))


def _fit(rows: DataFrame) -> DataFrame:
    """Per group: mean and lower Cholesky factor of the covariance of ``rows``."""
    sums = [F.count(F.lit(1)).alias("m")] + [_exact_sum(F.col(d)).alias(f"s_{d}") for d in DIMS]
    pairs = [(a, b) for i, a in enumerate(DIMS) for b in DIMS[: i + 1]]
    sums += [_exact_sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a, b in pairs]
    fit = rows.groupBy("gid").agg(*sums)
    fit = fit.withColumns({f"mean_{d}": F.col(f"s_{d}") / F.col("m") for d in DIMS})
    for i, a in enumerate(DIMS):
        for j, b in enumerate(DIMS[: i + 1]):
            rest = F.col(f"s_{a}_{b}") / F.col("m") - F.col(f"mean_{a}") * F.col(f"mean_{b}")
            if a == b:
                rest = F.greatest(rest, F.lit(0.0)) + FLOORS[a] ** 2
            for c in DIMS[:j]:
                rest = rest - F.col(f"l_{a}_{c}") * F.col(f"l_{b}_{c}")
            value = F.sqrt(F.greatest(rest, F.lit(1e-9))) if a == b else rest / F.col(f"l_{b}_{b}")
            fit = fit.withColumn(f"l_{a}_{b}", value)
    return fit.select("gid", *[f"mean_{d}" for d in DIMS], *[f"l_{a}_{b}" for a, b in pairs])


def _distance(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """``rows`` with ``d2``, the squared Mahalanobis distance by forward substitution."""
    out = attach(rows, fit, ["gid"])
    for i, a in enumerate(DIMS):
        rest = F.col(a) - F.col(f"mean_{a}")
        for b in DIMS[:i]:
            rest = rest - F.col(f"l_{a}_{b}") * F.col(f"z_{b}")
        out = out.withColumn(f"z_{a}", rest / F.col(f"l_{a}_{a}"))
    square = sum((F.col(f"z_{d}") * F.col(f"z_{d}") for d in DIMS), F.lit(0.0))
    return out.withColumn("d2", square).select(*rows.columns, "d2")


def _log_d2() -> Column:
    return F.round(F.log(F.col("d2") + 1e-6), 2)


def _closest(rows: DataFrame) -> DataFrame:
    """The rows of each group whose rounded distance is within its ``SUBSET`` quantile."""
    limits = staged(rows.groupBy("gid").agg(F.percentile(_log_d2(), F.lit(SUBSET)).alias("limit")), "limits")
    near = attach(rows, limits, ["gid"])
    return near.filter(_log_d2() <= F.col("limit")).drop("limit", "d2")


def outliers(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``gid`` and the vector) with the scaled squared distance ``d2``."""
    middle = staged(rows.groupBy("gid").agg(*[F.percentile(F.round(d, 2), F.lit(0.5)).alias(f"mid_{d}") for d in DIMS]), "middle")
    centred = attach(rows, middle, ["gid"])
    spread = staged(centred.groupBy("gid").agg(*[
        F.percentile(F.round(F.abs(F.col(d) - F.col(f"mid_{d}")), 2), F.lit(0.5)).alias(f"mad_{d}") for d in DIMS]), "spread")
    start = attach(centred, spread, ["gid"])
    scaled = [(F.col(d) - F.col(f"mid_{d}")) / (1.4826 * F.col(f"mad_{d}") + FLOORS[d]) for d in DIMS]
    now = start.withColumn("d2", sum((z * z for z in scaled), F.lit(0.0))).select(*rows.columns, "d2")
    for _ in range(STEPS):
        now = _distance(rows, staged(_fit(_closest(now)), "fit"))
    # The covariance of the closest rows is too small; the median distance gives the factor.
    factor = staged(now.groupBy("gid").agg(
        F.count(F.lit(1)).alias("size"), (F.exp(F.percentile(_log_d2(), F.lit(0.5))) / CHI_MEDIAN).alias("factor")), "factor")
    out = attach(now, factor, ["gid"])
    return out.withColumn("d2", F.when(F.col("size") >= MIN_ROWS, F.col("d2") / F.greatest(F.col("factor"), F.lit(1.0))).otherwise(0.0))


def _with_everyone(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with ``judged``; if a group needs the estimate of all documents, the other rows join it unjudged."""
    rows = rows.withColumn("judged", F.lit(True))
    if groups.filter(F.col("gid") == EVERYONE).isEmpty():
        return rows
    others = rows.filter(F.col("gid") != EVERYONE)
    return rows.unionByName(others.withColumns({"gid": F.lit(EVERYONE).cast("long"), "judged": F.lit(False)}))


def judge(docs: DataFrame, limit: float = CHI_LIMIT) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2)`` for each row.

    ``base_failed`` holds below ``MIN_WORDS`` words or above ``REPEAT_PERCENT``
    percent of repeated words. Other documents are kept unless their scaled
    squared distance ``d2`` exceeds ``limit``. Estimates rest on all documents
    of the group, also on those that failed.

    Null and empty texts have no words and fail. A null language or source is
    a group like any other. Groups below ``MIN_GROUP`` rows share the estimate
    of the small groups of their language; where these are fewer too, that of
    all documents. Only a table below ``MIN_ROWS`` rows, for which the
    determinant is not defined, rejects nothing. Null and repeated ids keep a
    row each.
    """
    stats = statistics(docs)
    rows = staged(stats.select("*", *[c.alias(n) for n, c in vectors().items()]), "statistics")
    groups = staged(_group_ids(rows), "groups")
    far = outliers(_with_everyone(attach(rows, groups, ["lang", "source"]), groups)).filter("judged")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return far.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), (~failed & (F.col("d2") <= limit)).alias("kept"), F.col("d2").alias("distance"))
