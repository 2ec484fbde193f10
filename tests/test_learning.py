"""Quantile learner: split, fit, predict, persist."""

import bisect
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftspark import config as C
from liftspark.operators import evaluate as E
from liftspark.operators import histograms as H
from liftspark.operators import quantile as Q
from liftspark.operators import scoring

PARAMS = C.BoostConfig(
    rounds=8, learning_rate=0.3, max_depth=3, min_rows_per_leaf=10, patience=8, cut_every=3
)


@pytest.fixture(scope="module")
def labelled(spark):
    """Lift depends on one feature, with noise that grows with it."""
    rng = random.Random(11)
    rows = []
    for i in range(900):
        features = [rng.random() for _ in C.FEATURE_COLUMNS]
        level = features[1]
        rows.append((f"vid_{i:05d}", *features, level * 4 + rng.random() * (0.5 + 2 * level)))
    schema = ", ".join(
        ["video_id string", *[f"{c} double" for c in C.FEATURE_COLUMNS], f"{C.LABEL} double"]
    )
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="module")
def models(labelled):
    return Q.fit(labelled, PARAMS)


def test_split_is_stable(labelled):
    train, valid = Q.split(labelled, 0.8, 42)
    assert train.count() + valid.count() == labelled.count()
    assert 0.74 < train.count() / labelled.count() < 0.86
    again, _ = Q.split(labelled.repartition(7), 0.8, 42)
    assert train.select("video_id").exceptAll(again.select("video_id")).count() == 0


def test_predictions_are_ordered_and_beat_constants(labelled, models):
    scored = Q.predict(labelled, models).cache()
    assert scored.count() == labelled.count()
    assert scored.filter(
        "p10_demand_lift IS NULL OR p10_demand_lift < 0 OR p10_demand_lift > p50_demand_lift"
        " OR p50_demand_lift > p90_demand_lift"
    ).count() == 0
    metrics = E.evaluate(scored).first()
    y = F.col(C.LABEL)
    for q, alpha in C.QUANTILES.items():
        constant = labelled.agg(F.percentile_approx(C.LABEL, alpha, 10_000)).first()[0]
        flat = labelled.agg(E.pinball(y, F.lit(constant), alpha)).first()[0]
        assert metrics[f"{q}_pinball_loss"] < 0.8 * flat
        assert abs(metrics[f"{q}_coverage"] - alpha) < 0.12


def test_validation_stops_training(labelled):
    noise = labelled.withColumn(C.LABEL, F.rand(3))
    rows = Q.assemble(noise)
    train, valid = Q.split(rows)
    params = C.BoostConfig(rounds=6, learning_rate=1.0, max_depth=4, min_rows_per_leaf=2, patience=2)
    model = Q.fit_quantile_gbt(train, valid, 0.5, params)
    assert len(model.trees) < 6
    assert min(model.losses) == model.losses[-1]


def test_saved_models_predict_the_same(spark, labelled, models, folder):
    Q.save_models(spark, models, folder)
    loaded = Q.load_models(spark, folder)
    a, b = Q.predict(labelled, models), Q.predict(labelled, loaded)
    assert a.exceptAll(b).count() == 0
    chosen = scoring.lift(labelled, folder)
    assert a.exceptAll(chosen).count() == 0


def test_without_saved_model_the_rule_applies(spark, folder):
    df = spark.sql("SELECT 0.30D engagement_score, 2.5D sku_viral_sensitivity, 1 is_on_foryou")
    assert scoring.lift(df, f"{folder}/none").first().p50_demand_lift == 8.0


def test_empty_input(labelled, models):
    assert Q.predict(labelled.limit(0), models).count() == 0
    with pytest.raises(ValueError):
        Q.fit(labelled.limit(0), PARAMS)
    with pytest.raises(ValueError, match="like_rate"):
        Q.fit(labelled.drop("like_rate"), PARAMS)


def plain_fit(rows, cuts, alpha, params):
    """The boosting of one quantile in plain Python; rows are (id, features, label)."""

    def quantile(values):
        return sorted(values)[max(0, math.ceil(alpha * len(values)) - 1)]

    binned = [[bisect.bisect_left(list(c), x) for c, x in zip(cuts, features)] for _, features, _ in rows]
    labels = [r[2] for r in rows]
    preds = [quantile(labels)] * len(rows)
    trees = []
    for i in range(params.rounds):
        columns = Q.columns_of(i, len(params.features), params)

        def score(ids):
            g = sum(alpha if labels[k] > preds[k] else alpha - 1 for k in ids)
            return g * g / len(ids)

        def grow(ids, depth):
            best = None
            for f in columns if depth else []:
                for b in range(H.BINS):
                    low = [k for k in ids if binned[k][f] <= b]
                    high = [k for k in ids if binned[k][f] > b]
                    if min(len(low), len(high)) < params.min_rows_per_leaf:
                        continue
                    gain = round(score(low) + score(high) - score(ids), 9)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, f, b, low, high)
            if best is None:
                value = Q.shrunken(quantile([labels[k] - preds[k] for k in ids]), len(ids), params)
                return [(ids, value)]
            return grow(best[3], depth - 1) + grow(best[4], depth - 1)

        leaves = grow(list(range(len(rows))), params.max_depth)
        trees.append(sorted(len(ids) for ids, _ in leaves))
        for ids, value in leaves:
            for k in ids:
                preds[k] += value
    return preds, trees


def test_fit_equals_plain_boosting(spark, labelled):
    params = C.BoostConfig(
        rounds=3, learning_rate=0.3, max_depth=3, min_rows_per_leaf=7, patience=9, cut_every=2, subsample=1.0
    )
    some = labelled.filter("video_id < 'vid_00150'").cache()
    rows = [(r.video_id, [r[c] for c in C.FEATURE_COLUMNS], r[C.LABEL]) for r in some.collect()]
    cuts = H.cuts_of(some, params.features)
    models = Q.fit_models(some, some, {"low": 0.1, "high": 0.9}, params)
    for name, alpha in (("low", 0.1), ("high", 0.9)):
        preds, trees = plain_fit(rows, cuts, alpha, params)
        model = models[name]
        assert [sum(f < 0 for f in t.feature) for t in model.trees] == [len(t) for t in trees]
        forest = Q.Forest({name: model})
        got = forest.predict(np.array([r[1] for r in rows]))[:, 0]
        assert np.allclose(got, preds, atol=1e-9)


def test_a_round_takes_few_jobs(spark, labelled):
    """Depth plus two jobs for all quantiles, as many stages as the rounds have."""
    tracker = spark.sparkContext.statusTracker()

    def jobs(rounds):
        group = f"rounds-{rounds}"
        spark.sparkContext.setJobGroup(group, "fit")
        Q.fit(labelled, C.BoostConfig(rounds=rounds, max_depth=3, min_rows_per_leaf=5, cut_every=99))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    # Adaptive execution runs each shuffle stage of a query as a job of its own.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert jobs(3) - jobs(1) <= 2 * (3 + 2)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_unknown_values_go_high_in_fit_and_prediction(spark, labelled):
    some = labelled.withColumn("like_rate", F.when(F.col("share_rate") > 0.3, F.col("like_rate")))
    models = Q.fit(some, PARAMS)
    assert Q.predict(some, models).filter("p50_demand_lift IS NULL").count() == 0
