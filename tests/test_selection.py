from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.functions.compositions import arg_max, closure, ilr
from topicloom.operators import evaluate, split, topics
from topicloom.operators.levels import level_index
from topicloom.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("direct", [100_000, 0])
def test_quantiles_equal_numpy(spark, direct):
    rng = np.random.default_rng(5)
    for sample in (
        rng.normal(size=3000),
        np.repeat(rng.normal(size=7), 300),
        np.array([2.5]),
        np.array([1.0, 4.0]),
        np.concatenate([np.zeros(2000), rng.random(1000)]),
    ):
        df = spark.createDataFrame([(float(v),) for v in sample] + [(None,)], "x double")
        probabilities = (0.0, 0.25, 0.5, 0.75, 1.0)
        got = exact_quantiles(df, "x", probabilities, first_slack=direct)
        assert got == pytest.approx(list(np.quantile(sample, probabilities)), rel=1e-12)


def test_quantiles_recover_from_a_bad_sketch(spark, monkeypatch):
    """Brackets that miss their ranks are widened until the exact value is found."""
    from topicloom.operators import quantiles

    monkeypatch.setattr(quantiles, "MIN_ACCURACY", 5)
    monkeypatch.setattr(quantiles, "MAX_ACCURACY", 5)
    df = spark.range(2000).select((F.col("id") * 1.0).alias("x"))
    assert exact_quantiles(df, "x", (0.1, 0.9)) == pytest.approx([199.9, 1799.1])


def expected_split(rows, seed):
    out, groups = {}, {}
    for doc, label in rows:
        groups.setdefault(label, []).append((hashlib.md5(f"{seed}:{doc}".encode()).hexdigest(), doc))
    for members in groups.values():
        quota = math.ceil(0.75 * len(members))
        for i, (_, doc) in enumerate(sorted(members)):
            out[doc] = i < quota
    return out


@pytest.mark.parametrize("digits", [4, 1])
def test_split_equals_ranking_whole_classes(spark, monkeypatch, digits):
    monkeypatch.setattr(split, "BUCKET_DIGITS", digits)
    rows = [(i, "hot" if i % 10 else f"c{i % 70}") for i in range(3000)] + [(9001, "single")]
    df = spark.createDataFrame(rows, "doc_id long, label string")
    got = {r.doc_id: r.is_train for r in split.stratified_split(df.repartition(5), 7).collect()}
    assert got == expected_split(rows, 7)


def test_largest_classes_break_ties_by_label(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate("bbaaccd")], "doc_id long, label string")
    assert [tuple(r) for r in split.largest_classes(df, 2).collect()] == [("a", 2), ("b", 2)]
    assert {r.label for r in split.keep_largest_classes(df, 2).collect()} == {"a", "b"}


def test_one_se_rule_hand_case(spark):
    rows = [(0.4, 0.30, 0.03), (0.2, 0.22, 0.03), (0.1, 0.20, 0.03)]
    summary = spark.createDataFrame(rows, "lambda double, cvm double, cvsd double")
    got = evaluate.lambda_rules(summary).first()
    assert (got.lambda_min, got.lambda_1se) == (0.1, 0.2)


def test_fold_weights(spark):
    rows = [(0.1, 0, 10, 0.1), (0.1, 1, 30, 0.3)]
    got = evaluate.cv_summary(spark.createDataFrame(rows, "lambda double, fold int, n long, error double")).first()
    assert got.cvm == pytest.approx(0.25)
    assert got.cvsd == pytest.approx(math.sqrt((10 * 0.15**2 + 30 * 0.05**2) / 40))


def test_ties(spark):
    accuracy = spark.createDataFrame([(0.1, 0.9), (0.3, 0.9), (0.2, 0.8)], "lambda double, accuracy double")
    assert evaluate.best_train_lambda(accuracy).first()["lambda"] == 0.3
    rows = [(3, 0.2, None), (2, 0.2, None), (4, 0.5, None), (1, None, "failed")]
    sweep = spark.createDataFrame(rows, "k int, e1_test double, error string")
    assert evaluate.best_k(sweep).first()["k"] == 2


def test_confusion_is_a_full_square(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "c"), ("a", "a")], "pred string, truth string")
    cells = {(r.pred, r.truth): r.n for r in evaluate.confusion_table(rows).collect()}
    assert len(cells) == 9 and sum(cells.values()) == 4 and cells[("a", "a")] == 2
    overall = evaluate.overall_stats(evaluate.confusion_table(rows)).first()
    assert overall.accuracy == 0.5 and overall.no_information_rate == 0.5
    assert overall.kappa == pytest.approx(0.0)
    rates = {r.label: r for r in evaluate.class_stats(evaluate.confusion_table(rows)).collect()}
    assert rates["a"].sensitivity == 1.0 and rates["a"].specificity == 0.0
    assert rates["b"].pos_pred_value is None


def test_rates_from_occurring_cells_equal_those_of_the_square(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "b"), ("a", "a"), ("d", "d")], "pred string, truth string")
    sparse, square = evaluate.confusion_cells(rows), evaluate.confusion_table(rows)
    assert sparse.count() == 4 and square.count() == 16
    assert sorted(evaluate.class_stats(sparse).collect()) == sorted(evaluate.class_stats(square).collect())
    assert evaluate.overall_stats(sparse).collect() == evaluate.overall_stats(square).collect()


def test_rates_of_very_many_labels(spark):
    rows = spark.range(200_000).selectExpr("id % 100000 AS truth", "(id + id div 100000) % 100000 AS pred")
    rates = evaluate.class_stats(evaluate.confusion_cells(rows))
    assert rates.count() == 100_000 and rates.where("sensitivity = 0.5 AND pos_pred_value = 0.5").count() == 100_000


def test_ilr_is_an_isometry(spark):
    rng = np.random.default_rng(3)
    for k in (2, 3, 7):
        parts = rng.random(k) + 0.01
        df = spark.createDataFrame([(parts.tolist(),)], "p array<double>")
        closed, z = df.select(closure(F.col("p")), ilr(F.col("p"))).first()
        assert sum(closed) == pytest.approx(1.0)
        clr = np.log(parts) - np.log(parts).mean()
        assert len(z) == k - 1
        assert np.square(z).sum() == pytest.approx(np.square(clr).sum())
        for i in range(1, k):
            expected = math.sqrt(i / (i + 1)) * (np.log(parts[i]) - np.log(parts[:i]).mean())
            assert z[i - 1] == pytest.approx(expected)


def test_arg_max_and_top_terms(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4],)], "p array<double>")
    assert df.select(arg_max(F.col("p"))).first()[0] == 1
    phi = [(0, t, v) for t, v in (("b", 0.3), ("a", 0.3), ("c", 0.4))]
    got = topics.top_terms(spark.createDataFrame(phi, "topic int, term string, phi double"), 2)
    assert [(r["rank"], r.term) for r in got.orderBy("rank").collect()] == [(1, "c"), (2, "a")]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_level_index(spark):
    words = [f"w{i:04d}" for i in range(500)]
    df = spark.createDataFrame([(w,) for w in words * 2] + [(None,)], "v string").repartition(7)
    got = {r.v: r.ix for r in level_index(df, "v").collect()}
    assert got == {w: i for i, w in enumerate(words)}
