"""Small exact cases with results known by hand."""

import math

import pytest
from pyspark.sql import functions as F

from riskloom.functions import bands, binning, scalars, tails, text
from riskloom.operators import (
    aggregates, correlation, drift, encode, evaluate, joins, profile, quality, segments, select, stats, temporal, vectors,
)
from riskloom.streaming import scoring


def one(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_identity_merge(spark):
    t = frame(spark, [(1,), (2,), (3,)], "id long")
    i = frame(spark, [(1, "a"), (3, "b")], "id long, d string")
    out = joins.merge_identity(t, i, "id").orderBy("id").collect()
    assert [r["has_identity"] for r in out] == [1, 0, 1]
    with pytest.raises(ValueError):
        joins.merge_identity(t, i.withColumnRenamed("id", "x"), "id")


def test_infinities_constants_and_narrow_types(spark):
    df = frame(spark, [(1.0, "A", 5), (math.inf, "A", 100), (math.nan, "A", -7)], "v double, c string, n long")
    assert quality.drop_infinities(df).filter("v IS NULL").count() == 2
    assert {r.feature for r in quality.constant_columns(quality.dominance_report(df, ["c", "n"])).collect()} == {"c"}
    kinds = dict(quality.narrow_types(df.select("n")).dtypes)
    assert kinds == {"n": "tinyint"}


def test_psi_and_ks_of_equal_frames(spark):
    df = frame(spark, [(float(i),) for i in range(1, 11)], "v double")
    for rule in (drift.HISTOGRAM, drift.OPEN_LEFT, drift.MONITOR):
        assert drift.numeric_psi(df, df, ["v"], rule).first()["psi"] < 0.1
    ks = drift.ks_two_sample(df, df, ["v"]).first()
    assert ks["ks"] == 0 and ks["ks_p"] == 1


def test_categorical_psi(spark):
    a = frame(spark, [("A",)] * 70 + [("B",)] * 30, "c string")
    b = frame(spark, [("A",)] * 20 + [("B",)] * 80, "c string")
    assert drift.categorical_psi(a, b, ["c"]).first()["psi"] == pytest.approx(1.1168, abs=1e-4)


def test_total_variation(spark):
    a, b = frame(spark, [("x",), ("y",)], "c string"), frame(spark, [("u",), ("v",)], "c string")
    assert drift.total_variation(a, a, ["c"]).first()["tv_distance"] == 0
    far = drift.total_variation(a, b, ["c"]).first()
    assert far["tv_distance"] == 1 and far["new_categories"] == 2 and far["missing_categories"] == 2


def test_psi_with_bins_empty_on_both_sides(spark):
    # Two values only: nine of ten decile bins are empty and still take part.
    a = frame(spark, [(0.0,), (100.0,)], "v double")
    assert drift.numeric_psi(a, a, ["v"]).first()["psi"] == pytest.approx(0.0)


def test_all_null_column(spark):
    df = frame(spark, [(1.0, None), (2.0, None)], "a double, b double")
    assert {r["feature"]: r["psi"] for r in drift.numeric_psi(df, df, ["a", "b"]).collect()} == {"a": pytest.approx(0.0)}
    assert quality.missing_report(df).filter("feature = 'b'").first()["missing_pct"] == 100.0


def test_leakage(spark):
    df = frame(spark, [(0, 0.0, 0.2), (0, 0.0, 0.5), (1, 1.0, 0.1), (1, 1.0, 0.9)], "y int, leak double, safe double")
    assert [r["feature"] for r in correlation.leaking_columns(df, ["leak", "safe"], "y").collect()] == ["leak"]


KEYS = [101, 101, 102, 101, 102, 103, 101, 102, 103, 101]
AMOUNTS = [100.0, 150.0, 200.0, 120.0, 250.0, 300.0, 110.0, 210.0, 310.0, 130.0]


def test_prior_windows(spark):
    rows = [(1001 + i, k, a) for i, (k, a) in enumerate(zip(KEYS, AMOUNTS))]
    df = frame(spark, rows + [(2000, None, 5.0)], "id long, card1 long, amt double")
    out = {r["id"] - 1001: r for r in temporal.prior_windows(df, "card1", ["id"], "amt", 2).collect()}
    assert [out[i]["card1_amt_prior_count"] for i in (0, 1, 3)] == [0, 1, 2]
    assert out[1]["card1_amt_prior_mean"] == 100 and out[3]["card1_amt_prior_mean"] == 125
    assert out[6]["card1_amt_roll_mean"] == 135 and out[9]["card1_amt_roll_mean"] == 115
    assert out[999]["card1_amt_prior_count"] == 0


def test_feature_gate(spark):
    df = frame(spark, [(1.0, 3.0, 1.0), (2.0, 4.0, 1.0), (None, 5.0, 1.0)], "a double, b double, c double")
    out = {r["feature"]: r for r in quality.feature_gate(df).collect()}
    assert out["a"]["status"] == "WARN" and out["b"]["status"] == "PASS"
    assert out["c"]["is_constant"] and out["c"]["status"] == "PASS"


def test_frequency_and_count_encoders(spark):
    df = frame(spark, [("apple",), ("apple",), ("banana",), ("cherry",)], "f string")
    freq = {r["value"]: r["f_freq"] for r in encode.fit_frequency(df, "f").collect()}
    assert freq == {"apple": 0.5, "banana": 0.25, "cherry": 0.25}
    pct = {r["value"]: r["f_percentile"] for r in encode.fit_count(df, "f", "percentile").collect()}
    assert pct == {"apple": 1.0, "banana": 0.5, "cherry": 0.5}
    logs = {r["value"]: r["f_log"] for r in encode.fit_count(df, "f", "log").collect()}
    assert logs["apple"] == pytest.approx(math.log1p(2))
    with pytest.raises(ValueError):
        encode.fit_count(df, "f", "other")


def test_label_encoder(spark):
    df = frame(spark, [(0, "yes"), (1, "no"), (2, "yes"), (3, "maybe"), (4, None)], "i int, s string")
    out = encode.transform_label(df, "s", encode.fit_label(df, "s")).orderBy("i").collect()
    assert [r["s_label"] for r in out] == [2, 1, 2, 0, -1]


def test_one_hot(spark):
    df = frame(spark, [("apple",)] * 20 + [("banana",)] * 10 + [("cherry",)], "f string")
    cats = encode.fit_one_hot(df, "f", 0.1)
    out = encode.transform_one_hot(df, "f", cats)
    assert cats == ["apple", "banana"]
    assert out.filter("f = 'cherry'").first()["f_unknown"] == 1


def test_target_encoder_uses_train_only(spark):
    train = frame(spark, [("a", 1), ("a", 0), ("b", 1)], "c string, y int")
    mapping, prior = encode.fit_target(train, "c", "y")
    out = encode.transform_target(frame(spark, [("zzz",)], "c string"), "c", mapping, prior).first()
    assert out["c_target"] == pytest.approx(2 / 3)


def test_missing_features(spark):
    df = frame(spark, [(1.0, 2.0), (None, None), (3.0, None), (4.0, 8.0)], "a double, b double")
    s = scalars.row_missing_stats(df, ["a", "b"])
    assert one(df, s["missing_count"]) == [0, 2, 1, 0] and one(df, s["missing_ratio"]) == [0, 1, 0.5, 0]
    p = frame(spark, [(1.0, 2.0), (None, 4.0), (3.0, None), (None, None)], "x double, y double")
    assert one(p, scalars.missing_pattern(p, ["x", "y"])) == [0, 1, 2, 3]
    d = frame(spark, [(None if i < 8 else 1.0, None if i < 1 else 1.0, 1.0) for i in range(10)], "a double, b double, c double")
    assert {r["feature"] for r in quality.discover_indicators(d).collect()} == {"a", "b"}


def test_bands(spark):
    df = frame(spark, [(10.0,), (50.0,), (250.0,), (1000.0,), (5000.0,)], "v double")
    assert one(df, binning.amount_bin("v")) == ["Very Low", "Low", "Medium", "High", "Very High"]
    r = frame(spark, [(2.0,), (5.0,), (12.0,), (20.0,), (21.0,)], "v double")
    assert one(r, bands.classify("imbalance", "v")) == ["Low", "Moderate", "Moderate", "Moderate", "Severe"]


def test_ratio_and_interaction(spark):
    df = frame(spark, [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (None, 3.0)], "a double, b double")
    assert one(df, scalars.safe_ratio("a", "b")) == [0.0, 1.0, 2.0, 0.0]
    assert one(df, scalars.interaction("a", "b", "divide")) == [0.0, 0.0, 2.0, 0.0]
    with pytest.raises(ValueError):
        scalars.interaction("a", "b", "power")


def test_text(spark):
    df = frame(spark, [("  Google   CHROME 70",), ("Trident/7.0",), ("ios  11",), (None,)], "v string")
    assert one(df, text.normalize_device_os("v")) == ["Chrome", "Trident/7.0", "iOS", None]
    assert one(df, text.browser_family("v")) == ["Chrome", "IE", "Other", "Unknown"]
    mail = frame(spark, [("bob@x.org",), ("b@x.org",), ("nobody",), (None,)], "m string")
    assert one(mail, text.mask_email("m")) == ["b***@x.org", "***@x.org", "***", "***"]
    secret = frame(spark, [("abcd",), ("abcdefg",)], "s string")
    assert one(secret, text.mask_secret("s")) == ["****", "ab***fg"]


def test_gates(spark):
    df = frame(spark, [(1.0, 2.0), (2.0, math.inf), (3.0, 4.0), (4.0, 5.0)], "a double, b double")
    assert {r["feature"]: r["status"] for r in quality.missing_gate(df).collect()} == {"a": "PASS", "b": "FAIL"}
    v = frame(spark, [(1.0,), (2.0,), (100.0,)], "v double")
    assert quality.sigma_gate(v, ["v"], 4.0, {"v": (1.0, 10.0)}).first()["n_out_of_bounds"] == 1
    assert quality.sigma_gate(v, ["v"], 1.1).first()["n_sigma"] == 1


def test_schema_validation(spark):
    df = frame(spark, [("a", 1)], "x string, n int")
    assert profile.validate_schema(df, {"x": True, "n": True}) == ["x should be numeric"]


def test_redundancy(spark):
    rows = [(float(i), 2.0 * i, v) for i, v in zip(range(1, 6), (1.0, 5.0, 2.0, 8.0, 3.0))]
    df = frame(spark, rows, "a double, b double, c double")
    for method in ("pearson", "spearman"):
        assert [(r["left"], r["right"]) for r in correlation.redundancy(df, ["a", "b", "c"], 0.9, method).collect()] == [("a", "b")]


def test_correlation_with_constant_and_nulls(spark):
    df = frame(spark, [(1.0, 5.0, None), (2.0, 5.0, 1.0), (3.0, 5.0, 3.0), (None, 5.0, 9.0)], "a double, k double, b double")
    got = {(r["left"], r["right"]): r["r"] for r in correlation.pearson_pairs(df, ["a", "k", "b"]).collect()}
    assert got == {("a", "k"): 0.0, ("a", "b"): pytest.approx(1.0), ("k", "b"): 0.0}


Y = [0, 1, 0, 1, 0, 0, 1, 1, 0, 1]
P = [0.1, 0.9, 0.2, 0.85, 0.3, 0.15, 0.7, 0.95, 0.05, 0.88]
AMT = [50.0, 120.0, 10.0, 200.0, 45.0, 30.0, 150.0, 300.0, 25.0, 80.0]


@pytest.fixture(scope="module")
def scored(spark):
    return frame(spark, list(zip(range(10), Y, P, AMT)), "id long, y int, p double, amt double")


def test_metrics(scored):
    m = evaluate.threshold_metrics(scored).first()
    assert (m["tp"], m["tn"]) == (5, 5) and m["precision"] == m["recall"] == m["f1"] == 1 and m["mcc"] == pytest.approx(1)
    c = evaluate.curve_metrics(evaluate.score_curve(scored)).first()
    assert c["roc_auc"] == c["pr_auc"] == c["ks"] == 1
    b = evaluate.business_value(scored, "amt").first()
    assert b["prevented"] == 850 and b["net_savings"] == 840


def test_one_class_scores(spark):
    c = evaluate.curve_metrics(evaluate.score_curve(frame(spark, [(1, 0.5)], "y int, p double"))).first()
    assert (c["roc_auc"], c["pr_auc"], c["ks"], c["ks_threshold"]) == (0.5, 0.0, 0.0, 0.5)


def test_null_score_stops(spark):
    with pytest.raises(Exception, match="null label or score"):
        evaluate.validated(frame(spark, [(1, None)], "y int, p double")).collect()


def test_best_threshold(spark):
    df = frame(spark, list(zip([0, 0, 0, 1, 1, 1], [0.1, 0.2, 0.3, 0.7, 0.8, 0.9])), "y int, p double")
    best = evaluate.best_thresholds(evaluate.threshold_sweep(df)).first()
    assert 0.3 < best["best_threshold"] < 0.7 and best["best_score"] == 1


def test_last_calibration_bin_is_closed(spark):
    out = evaluate.calibration(frame(spark, [(0, 1.0), (1, 1.0)], "y int, p double")).first()
    assert out["ece"] == pytest.approx(0.5)


def test_service_metrics(spark):
    df = frame(spark, [(10.0, 0, 0), (50.0, 0, 1), (100.0, 1, 2)], "ms double, e int, s long")
    m = evaluate.service_metrics(df, "ms", F.col("e") == 1, F.col("s")).first()
    assert m["requests"] == 3 and m["error_rate"] == pytest.approx(1 / 3) and m["p50"] == 50


def test_average_vectors(spark):
    df = frame(spark, [([1.0, 1.0],), ([3.0, 3.0],)], "v array<double>")
    assert vectors.average_vectors(df, "v").first()["mean_vector"] == [2.0, 2.0]


def test_adaptive_threshold(spark):
    df = frame(spark, [(1, 0, 0.08), (1, 1, 0.03), (1, 2, 0.0)], "policy int, bucket long, rate double")
    got = [r["threshold"] for r in scoring.thresholds_over_time(df, "policy", "bucket", "rate").orderBy("bucket").collect()]
    assert got == pytest.approx([0.45, 0.45, 0.5])


def test_selectors(spark):
    rows = [(None if i < 6 else 1.0, 7.0, float(i), float(i)) for i in range(10)]
    df = frame(spark, rows, "gaps double, flat double, a double, b double")
    assert select.dropped(select.null_selector(df, df.columns)) == ["gaps"]
    assert "flat" in select.dropped(select.variance_selector(df, ["flat", "a"]))
    assert select.dropped(select.correlation_selector(df, ["a", "b"])) == ["b"]


@pytest.mark.parametrize("columns, message", [([], "no features"), (["a", "a"], "duplicate"), (["flat"], "variance"), (["a", "b"], "collinear")])
def test_selection_gate(spark, columns, message):
    df = frame(spark, [(float(i), 2.0 * i, 1.0, i % 2) for i in range(10)], "a double, b double, flat double, y int")
    with pytest.raises(ValueError, match=message):
        select.selection_gate(df, columns, "y")


def test_null_keys_are_not_a_segment(spark):
    df = frame(spark, [("a", 1), (None, 0), ("a", 0)], "k string, y int")
    out = segments.segment_rates(df, ["k"], "y").collect()
    assert [(r["k"], r["total"], r["rate_pct"]) for r in out] == [("a", 2, 50.0)]


def test_null_safe_duplicates(spark):
    a = frame(spark, [(None, 1), ("x", 1)], "s string, n int")
    assert joins.duplicate_overlap(a, a, ["s", "n"]).first()["duplicate_matches"] == 2


def test_identical_columns_treat_null_as_equal(spark):
    df = frame(spark, [(1, 1, 1), (None, None, 2)], "a int, b int, c int")
    assert [tuple(r) for r in quality.identical_columns(df).collect()] == [("a", "b")]


def test_entity_stats_of_unseen_keys(spark):
    train = frame(spark, [("a", 1.0), ("a", 3.0), ("b", 10.0)], "k string, v double")
    out = aggregates.attach_entity_stats(frame(spark, [("zz",), (None,)], "k string"), aggregates.entity_stats(train, "k", "v"), "k")
    for r in out.collect():
        assert (r["k_v_count"], r["k_v_std"], r["k_v_mean"], r["k_v_median"]) == (0, 0.0, 6.0, 6.0)


def test_chi_square_yates(spark):
    rows = [("a", 0)] * 10 + [("a", 1)] * 20 + [("b", 0)] * 30 + [("b", 1)] * 15
    out = stats.chi_square_p(stats.chi_square(frame(spark, rows, "c string, y int"), ["c"], "y")).first()
    expected = sum((abs(o - e) - 0.5) ** 2 / e for o, e in ((10, 16), (20, 14), (30, 24), (15, 21)))
    assert out["chi2"] == pytest.approx(expected) and out["dof"] == 1
    assert out["p_value"] == pytest.approx(math.erfc(math.sqrt(expected / 2)), rel=1e-8)


def test_cliffs_delta_matches_all_pairs(spark):
    pos, neg = [3.0, 5.0, 5.0, 9.0, 1.0, 4.0], [2.0, 5.0, 1.0, 8.0, 0.0, 3.0, 3.0]
    df = frame(spark, [(1, v) for v in pos] + [(0, v) for v in neg], "y int, v double")
    want = sum((a > b) - (a < b) for a in pos for b in neg) / (len(pos) * len(neg))
    out = stats.rank_tests(df, ["v"], "y").first()
    assert out["cliffs_delta"] == pytest.approx(want) and out["rank_biserial"] == pytest.approx(-want)


def test_corrections(spark):
    df = frame(spark, [("a", 0.01), ("b", 0.04), ("c", 0.03)], "feature string, p_value double")
    out = {r["feature"]: r for r in stats.corrected_p_values(df).collect()}
    assert [round(out[k]["holm"], 6) for k in "acb"] == [0.03, 0.06, 0.06]
    assert [round(out[k]["fdr"], 6) for k in "acb"] == [0.03, 0.04, 0.04]
    assert [round(out[k]["bonferroni"], 6) for k in "acb"] == [0.03, 0.09, 0.12]


def test_tail_probabilities(spark):
    z = frame(spark, [(v,) for v in (-2.0, 0.0, 1.0, 4.0)], "z double")
    for r in z.select("z", tails.normal_sf("z").alias("p")).collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(r["z"] / math.sqrt(2)), rel=1e-8)
    f = frame(spark, [(4.964602743730711, 1.0, 10.0)], "f double, a double, b double")
    assert f.select(tails.f_sf("f", "a", "b")).first()[0] == pytest.approx(0.05, abs=1e-8)


def test_skewness_and_kurtosis(spark):
    df = frame(spark, [(v,) for v in (1.0, 2.0, 3.0, 4.0, 20.0)], "v double")
    s = profile.numeric_statistics(df, ["v"]).first()
    assert (round(s["skew"], 4), round(s["kurt"], 4)) == (2.1251, 4.6061)
    assert (round(s["skew_pop"], 4), round(s["kurt_pop"], 4)) == (1.4255, 0.1515)


def test_trend_row(spark):
    # Two days with 112 and 123 positives.
    rows = [(d * 86400 + i, 1) for d, n in ((1, 112), (2, 123)) for i in range(n)]
    out = temporal.trends(frame(spark, rows, "dt long, y int"), "dt", "y").orderBy("day").collect()[1]
    assert out["rolling_positives"] == 117.5 and round(out["rolling_std"], 4) == 7.7782 and round(out["growth"], 4) == 0.0982


def test_anomaly_row(spark):
    rows = [(d * 86400,) for d, n in ((1, 5122), (2, 3730)) for _ in range(n)]
    out = temporal.temporal_anomalies(frame(spark, rows, "dt long"), "dt").orderBy("day").collect()[1]
    assert out["rolling_mean"] == 4426 and round(out["rolling_std"], 4) == 984.2926 and round(out["z"], 4) == -0.7071


def test_tampered_chain(spark):
    base = frame(spark, [("c", 0, "t0", "u", "a", "r", "S", vectors.GENESIS)], "chain string, pos long, ts string, user string, action string, resource string, status string, previous_hash string")
    log = base.withColumn("event_hash", vectors.event_hash(F.col("previous_hash")))
    assert vectors.verify_chain(log, "pos").count() == 0
    assert vectors.verify_chain(log.withColumn("status", F.lit("X")), "pos").first()["problem"] == "changed content"


def test_audit_chain_holds_every_event(spark, small_dir, monkeypatch):
    from riskloom.plans import evaluation_queries

    seen, verify = [], vectors.verify_chain
    monkeypatch.setattr(vectors, "verify_chain", lambda log, *a, **k: seen.append(log) or verify(log, *a, **k))
    evaluation_queries.audit_chain(spark, small_dir)
    events = spark.read.parquet(f"{small_dir}/events.parquet")
    assert seen[0].count() == events.count()
    late = seen[0].withColumn("status", F.when(F.col("position") == 4, "FAILURE").otherwise(F.col("status")))
    found = verify(late, "position").filter("position = 4").count()
    assert found == seen[0].filter("position = 4").count() > 0


def test_model_queries_fit_whole_models(monkeypatch):
    from riskloom.plans import model_queries

    seen = []
    monkeypatch.setattr(model_queries, "_parts", lambda spark, d: (None, None))
    monkeypatch.setattr(model_queries, "_report", lambda *a: None)
    monkeypatch.setattr(model_queries.model, "fit_forest", lambda df, f, trees=50: seen.append(trees))
    monkeypatch.setattr(model_queries.model, "fit_boosted", lambda df, f, rounds=100: seen.append(rounds))
    model_queries.forest_model(None, None)
    model_queries.boosted_model(None, None)
    assert seen == [50, 100]
