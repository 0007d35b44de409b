"""The block-wise forms must equal the plain windows they replace, also under skew."""

from itertools import combinations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators import correlation, drift, encode, evaluate, interact, joins, profile, quantiles, sets, stats, temporal
from riskloom.operators.ordered import prefix_sums, trailing, with_ordinal


@pytest.fixture(scope="module")
def skewed(spark):
    """2,000 rows; a third share one key, and a third share one timestamp."""
    df = spark.range(2000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("key"),
        F.when(F.col("id") % 3 == 1, 500).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000))).cast("long").alias("dt"),
        F.when(F.col("id") % 11 == 0, None).otherwise(F.pmod(F.col("id") * 37, F.lit(101)).cast("double")).alias("x"),
        (F.pmod(F.col("id") * 13, F.lit(7)) < 2).cast("int").alias("y"),
        F.pmod(F.col("id") * 7, F.lit(13)).cast("double").alias("z"),
    )
    return df.cache()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("keys", [[], ["key"]])
@pytest.mark.parametrize("inclusive", [True, False])
def test_prefix_sums(skewed, keys, inclusive):
    w = Window.partitionBy(*keys).orderBy("dt", "id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = skewed.withColumn("s", F.coalesce(F.sum("z").over(w), F.lit(0.0)))
    got = prefix_sums(skewed, keys, ["dt", "id"], {"s": F.col("z")}, inclusive=inclusive, rows_per_block=60)
    assert rows(got, "id") == rows(want, "id")


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_trailing(skewed, keys):
    w = Window.partitionBy(*keys).orderBy("dt", "id")
    columns = {
        "m": lambda s: F.avg("x").over(s.rowsBetween(-5, -1)),
        "gap": lambda s: F.col("dt") - F.lag("dt").over(s),
    }
    want = skewed.withColumns({k: f(w) for k, f in columns.items()})
    assert rows(trailing(skewed, keys, ["dt", "id"], 5, columns, rows_per_block=60), "id") == rows(want, "id")


def test_trailing_with_blocks_shorter_than_the_frame(skewed):
    w = Window.orderBy("id")
    columns = {"m": lambda s: F.sum("z").over(s.rowsBetween(-5, -1))}
    few = skewed.filter("id < 40")
    want = few.withColumns({k: f(w) for k, f in columns.items()})
    assert rows(trailing(few, [], ["id"], 5, columns, rows_per_block=2), "id") == rows(want, "id")


def test_ordinal(skewed):
    got = with_ordinal(skewed, ["dt", "id"], rows_per_block=50)
    assert [r[0] for r in got.orderBy("dt", "id").select("ordinal").collect()] == list(range(2000))


def test_exact_quantiles(skewed):
    probs = [0, 0.01, 0.25, 0.5, 0.9, 1]
    plain = quantiles.exact_quantiles(skewed, ["x", "z", "dt"], probs)
    blocks = quantiles.exact_quantiles(skewed, ["x", "z", "dt"], probs, rows_per_block=100)
    for c, values in plain.items():
        assert blocks[c] == pytest.approx(values)


def test_grouped_quantiles(skewed):
    named = {"q1": 0.25, "median": 0.5}
    plain = quantiles.grouped_quantiles(skewed, ["key"], "x", named)
    blocks = quantiles.grouped_quantiles(skewed, ["key"], "x", named, rows_per_block=40)
    for a, b in zip(rows(plain, "key"), rows(blocks, "key")):
        assert a == pytest.approx(b)


def test_prior_windows(skewed):
    plain = temporal.prior_windows(skewed, "key", ["id"], "x")
    blocks = temporal.prior_windows(skewed, "key", ["id"], "x", rows_per_block=50)
    for a, b in zip(rows(plain, "id"), rows(blocks, "id")):
        assert a == pytest.approx(b)


def test_ks_ranks_curves(skewed):
    for fn in (
        lambda n: drift.ks_by_side(skewed, ["x", "z"], "y", rows_per_block=n),
        lambda n: stats.rank_tests(skewed, ["x", "z"], "y", rows_per_block=n),
    ):
        for a, b in zip(rows(fn(None), "feature"), rows(fn(5), "feature")):
            assert a == pytest.approx(b)
    scored = skewed.select("y", (F.col("dt") / 1000.0).alias("p"))
    a = evaluate.curve_metrics(evaluate.score_curve(scored)).first()
    b = evaluate.curve_metrics(evaluate.score_curve(scored, rows_per_block=20)).first()
    assert tuple(a) == pytest.approx(tuple(b))


def brute_tau(pairs):
    c = d = tx = ty = 0
    for i, (x1, y1) in enumerate(pairs):
        for x2, y2 in pairs[i + 1 :]:
            s = (x1 - x2) * (y1 - y2)
            c, d = c + (s > 0), d + (s < 0)
            tx, ty = tx + (x1 == x2), ty + (y1 == y2)
    n = len(pairs) * (len(pairs) - 1) / 2
    return (c - d) / ((n - tx) * (n - ty)) ** 0.5


@pytest.mark.parametrize("block", [None, 10])
def test_kendall(skewed, block):
    few = skewed.filter("id < 150").select("x", "z").dropna()
    want = brute_tau([(r.x, r.z) for r in few.collect()])
    got = correlation.kendall_pairs(few, [("x", "z")], rows_per_block=block).first()["tau"]
    assert got == pytest.approx(want)


def test_kendall_of_several_pairs_in_one_job(spark):
    data = [(float(i * 37 % 101), float(i * i % 53), None if i % 7 == 0 else float(i % 5), float("nan") if i % 9 == 0 else 1.0, None) for i in range(100)]
    frame = spark.createDataFrame(data, "a double, b double, c double, k double, e double")
    got = {(r["left"], r["right"]): r["tau"] for r in correlation.kendall_pairs(frame, list(combinations("abcke", 2)), rows_per_block=20).collect()}
    assert len(got) == 10
    for (i, x), (j, y) in combinations(enumerate("abc"), 2):
        known = [(r[i], r[j]) for r in data if r[i] is not None and r[j] is not None]
        assert got[x, y] == pytest.approx(brute_tau(known))
    assert all(tau == 0 for pair, tau in got.items() if set(pair) & set("ke"))
    assert correlation.kendall_pairs(frame, []).count() == 0
    assert [r["tau"] for r in correlation.kendall_pairs(frame.limit(0), [("a", "b")]).collect()] == [0.0]


def test_lookup_join_measures_bytes(skewed):
    mapping = skewed.groupBy("key").agg(F.repeat(F.lit("x"), 1000).alias("note"), F.collect_set("y").alias("seen"))
    base = skewed.select("id", "key")
    few, many = (joins.lookup_join(base, mapping, ["key"], broadcast_bytes=b) for b in (2000, 1 << 30))
    hinted = [out._jdf.queryExecution().analyzed().toString().count("ResolvedHint") for out in (few, many)]
    assert hinted == [0, 1] and rows(few.select("id", "note"), "id") == rows(many.select("id", "note"), "id")


def test_lookup_join_forms_agree(skewed):
    mapping = skewed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    base = skewed.select("id", "key")
    plain = joins.lookup_join(base, mapping, ["key"])
    shuffled = joins.lookup_join(base, mapping, ["key"], broadcast_rows=5)
    salted = joins.lookup_join(base, mapping, ["key"], broadcast_rows=5, hot_rows=100, salts=4)
    assert rows(plain, "id") == rows(shuffled, "id") == rows(salted, "id")


def test_stratified_folds_stay_balanced(skewed):
    out = encode.stratified_folds(skewed, "y", F.xxhash64("id"), 5, rows_per_block=100)
    sizes = out.groupBy("y", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in sizes if r["y"] == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_recent_count_matches_brute_force(spark):
    data = [(i, i % 3 if i % 2 else 0, (i * 97) % 5000) for i in range(300)]
    df = spark.createDataFrame(data, "id long, key long, dt long")
    got = {r["id"]: r["c"] for r in temporal.recent_count(df, "key", "dt", 600, "c").collect()}
    for i, k, t in data:
        assert got[i] == sum(1 for _, k2, t2 in data if k2 == k and t - 600 <= t2 <= t - 1)


def test_connected_groups(spark):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}", 0.9) for i in range(12)] + [("z1", "z2", 0.95)]
    got = correlation.connected_groups(spark.createDataFrame(chain, "left string, right string, r double")).collect()
    groups = {r["feature"]: r["component"] for r in got}
    assert set(groups.values()) == {"n00", "z1"} and groups["n12"] == "n00" and groups["z2"] == "z1"


def test_label_encoder_ranges(spark):
    df = spark.range(500).select(F.concat(F.lit("Customer#"), F.col("id") * 7919 % 500).alias("c"))
    plain, ranged = encode.fit_label(df, "c"), encode.fit_label(df, "c", rows_per_block=30)
    assert rows(plain, "value") == rows(ranged, "value")


NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def odd(spark):
    """Columns that are all null, infinite, NaN or of one value, texts, and a null key."""
    data = [
        (i, None if i % 4 == 0 else i % 3, None, [INF, -INF, NAN, 1.5, None][i % 5], 7.0, f"t{i % 6}" if i % 7 else None, float(i % 10))
        for i in range(200)
    ]
    return spark.createDataFrame(data, "id long, key int, nothing double, wild double, same double, name string, v double").cache()


@pytest.mark.parametrize("lead", ["nothing", "wild", "same", "name"])
@pytest.mark.parametrize("keys", [[], ["key"]])
def test_ranges_follow_any_order_column(odd, lead, keys):
    w = Window.partitionBy(*keys).orderBy(lead, "id")
    columns = {"m": lambda s: F.sum("v").over(s.rowsBetween(-3, -1)), "before": lambda s: F.lag("id").over(s)}
    sums = odd.withColumn("s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("id", "s")
    frames = odd.select("id", *[f(w).alias(k) for k, f in columns.items()])
    for block in (None, 20):
        assert rows(prefix_sums(odd, keys, [lead, "id"], {"s": F.col("v")}, rows_per_block=block).select("id", "s"), "id") == rows(sums, "id")
        assert rows(trailing(odd, keys, [lead, "id"], 3, columns, rows_per_block=block).select("id", *columns), "id") == rows(frames, "id")


def same(a, b):
    return a is b or (a is not None and b is not None and (a == b or (a != a and b != b) or a == pytest.approx(b)))


@pytest.mark.parametrize("block", [None, 20])
def test_quantiles_of_odd_columns(odd, block):
    probs = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = quantiles.exact_quantiles(odd, ["nothing", "wild", "same", "v"], probs, rows_per_block=block)
    assert got["nothing"] == [None] * 5 and got["same"] == [7.0] * 5
    assert got["wild"][0] == -INF and got["wild"][1] == -INF and got["wild"][4] != got["wild"][4]
    want = odd.agg(F.percentile("v", F.array(*[F.lit(p) for p in probs]))).first()[0]
    assert got["v"] == pytest.approx(want)
    infinite = odd.withColumn("i", F.lit(INF))
    assert rows(quantiles.grouped_quantiles(infinite, ["key"], "i", {"q": 0.3}, rows_per_block=block), "key") == [(None, INF), (0, INF), (1, INF), (2, INF)]
    assert quantiles.exact_quantiles(odd.limit(0), ["v"], probs) == {"v": [None] * 5}


@pytest.fixture(scope="module")
def sparse(spark):
    """Columns with nulls in different rows."""
    data = [
        (float(i * 37 % 101), float((i * i) % 53) if i % 3 else None, float(i % 17) if i % 10 == 0 else None, float(i % 17) * 2 if i % 10 == 0 else None, 1.0)
        for i in range(300)
    ]
    return spark.createDataFrame(data, "a double, b double, c double, d double, one double").cache()


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlation_of_complete_pairs(sparse, method):
    names = ["a", "b", "c", "d", "one"]
    want = sparse.toPandas()[names].corr(method=method)
    find = correlation.pearson_pairs if method == "pearson" else correlation.spearman_pairs
    got = find(sparse, names).collect()
    assert len(got) == 10
    for r in got:
        w = want.loc[r["left"], r["right"]]
        assert r["r"] == pytest.approx(0.0 if w != w else w, abs=1e-9)


def test_asked_pairs_only(sparse):
    assert correlation.pearson_pairs(sparse, ["a", "b"], []).collect() == []
    assert [tuple(r)[:2] for r in correlation.pearson_pairs(sparse, ["a", "b", "c"], [("c", "a")]).collect()] == [("c", "a")]


def test_many_columns(spark):
    wide = spark.range(50).select(*[F.sin(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(400)])
    assert correlation.pearson_pairs(wide, wide.columns).count() == 400 * 399 // 2


def test_bootstrap_does_not_depend_on_partitions(skewed):
    draw = lambda df: sorted(r["id"] for r in sets.bootstrap(df, ["id"], 3).collect())
    first = draw(skewed)
    assert first == draw(skewed.repartition(7)) and abs(len(first) - 2000) < 200 and len(set(first)) < 1400


def test_category_frequencies_rank_ties_by_name(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("c",), (None,)], "x string")
    for block in (None, 1):
        got = rows(profile.category_frequencies(df, ["x"], rows_per_block=block), "rank")
        assert got == [("x", "a", 2, 50.0, 50.0, 1), ("x", "b", 1, 25.0, 75.0, 2), ("x", "c", 1, 25.0, 100.0, 3)]
    assert rows(profile.categorical_inventory(df, ["x"]), "feature") == [("x", 3, 1, 20.0, "a", 50.0)]


def test_cells_of_pairs_and_triples_equal_plain_counts(spark):
    data = [(i % 3, "ab"[i % 2], None if i % 5 == 0 else i % 4, i * 7 % 90, None if i % 11 == 0 else int(i % 6 == 0)) for i in range(600)]
    frame = spark.createDataFrame(data, "p int, q string, r int, s int, y int").drop("q")
    columns = ["p", "r", "s"]
    binned = stats.bin_columns(frame, columns)
    for a, b in interact.pairs_of(columns):
        cell = F.concat(f"__b_{a}", F.lit("_"), f"__b_{b}").alias("cell")
        want = binned.groupBy(cell).agg(F.count("y").alias("n"), F.sum("y").alias("positives"))
        got = interact.pair_cells(frame, columns, "y").filter(f"left = '{a}' AND right = '{b}'").select("cell", "n", "positives")
        assert rows(got, "cell") == rows(want, "cell")
    rate = F.sum("y") / F.count("y")
    cell = F.concat_ws("_", *[f"__b_{c}" for c in columns]).alias("cell")
    best = binned.groupBy(cell).agg(F.count("y").alias("n"), rate.alias("rate")).filter("n >= 10").orderBy(F.desc("rate"), "cell").first()
    hot = interact.triple_hotspots(frame, columns, "y").collect()
    assert [(r["first"], r["second"], r["third"]) for r in hot] == [("p", "r", "s")]
    assert (hot[0]["cell"], hot[0]["n"], hot[0]["rate"]) == (best["cell"], best["n"], pytest.approx(best["rate"]))
    assert interact.pair_cells(frame.limit(0), columns, "y").count() == 0
    assert interact.pair_cells(frame, ["p"], "y").count() == 0


@pytest.mark.parametrize("rows", [100, 2_000_000])
def test_quantiles_rank_only_the_values_near_their_ranks(spark, monkeypatch, rows):
    """Few values are ranked, whatever the sketch saw, and a wrong sketch changes nothing."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 7 > 0, F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 7.0).alias("x"), (F.col("id") % 3).alias("k"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 900).otherwise(F.lit(float("nan"))).alias("z"),
    )
    probs = [0.0, 0.1, 0.333, 0.5, 0.9, 1.0]
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, probs))).alias(c) for c in "xkz"]).first()
    values = df.select(*[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate("xkz")])
    if rows > 20_000:
        kept = quantiles._narrowed(values, quantiles._brackets(values, probs))
        assert kept.filter("feature = 0").count() < 500 and kept.agg(F.sum("__c")).first()[0] == 20_000 * 3 - 2858
    monkeypatch.setattr(quantiles, "SKETCH_ROWS", rows)
    got = quantiles.exact_quantiles(df, list("xkz"), probs)
    assert all(same(a, b) for c in "xkz" for a, b in zip(got[c], want[c]))
    monkeypatch.setattr(quantiles, "_brackets", lambda v, p: [quantiles.np.array([5.0, 6.0])] * 3)
    got = quantiles.exact_quantiles(df, list("xkz"), probs)
    assert all(same(a, b) for c in "xkz" for a, b in zip(got[c], want[c]))


def test_shared_counts_and_bins_change_no_report(skewed):
    """KS, rank tests and pairs of columns from shared counts, bins and cells are those from their own."""
    running, bins = drift.running_counts(skewed, ["x", "z"], "y"), stats.fit_bins(skewed, ["x", "z"])
    cells = interact.pair_cells(skewed, ["x", "z"], "y", bins)
    pairs = [
        (drift.ks_by_side(skewed, ["x", "z"], "y", running=running), drift.ks_by_side(skewed, ["x", "z"], "y")),
        (stats.rank_tests(skewed, ["x", "z"], "y", running=running), stats.rank_tests(skewed, ["x", "z"], "y")),
        (interact.pair_hotspots(skewed, ["x", "z"], "y", cells=cells), interact.pair_hotspots(skewed, ["x", "z"], "y")),
        (interact.interaction_strength(skewed, ["x", "z"], "y", bins=bins, cells=cells), interact.interaction_strength(skewed, ["x", "z"], "y")),
    ]
    for shared, own in pairs:
        for a, b in zip(rows(shared, shared.columns[0]), rows(own, own.columns[0]), strict=True):
            assert all(same(x, y) for x, y in zip(a, b))
