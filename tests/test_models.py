"""Folds, counted rows and binned trees of the model catalogue."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tabloom.operators import evaluate, forest, models, perceptron


def table(spark, n=4000, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 200, (n, 2)) / 10.0
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 2.0, n) > 15).astype(int)
    return spark.createDataFrame(pd.DataFrame({"i": range(n), "a": x[:, 0], "b": x[:, 1], "c": np.where(x[:, 0] > 19, "rare", "common"), "y": y}))


@pytest.fixture(scope="module")
def parts(spark):
    return models.prepare(table(spark), "y", ["a", "b", "c"], ["i"])


@pytest.mark.parametrize("folds", [2, 3, 5])
def test_folds_of_training_rows_are_even(parts, folds):
    """The split takes the smallest draws of a row; the same draws left the last fold almost empty."""
    train = parts[0]
    sizes = {r["fold"]: r["count"] for r in models._folds(train, ["i"], folds, 42).groupBy("fold").count().collect()}
    n = sum(sizes.values())
    assert set(sizes) == set(range(folds)) and all(0.8 * n / folds < s < 1.2 * n / folds for s in sizes.values())


def test_cross_validation_scores_every_fold(parts):
    r = models.cross_validate("logreg", parts[0], ["i"]).first()
    assert r["folds"] == 5 and r["score"] > 0.85 and r["spread"] < 0.1


def test_counted_outcomes_measure_like_rows(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"label": rng.integers(0, 2, 500) * 1.0, "p": rng.integers(0, 20, 500) / 20.0})
    rows = spark.createDataFrame(pdf).withColumn("prediction", (F.col("p") > 0.5).cast("double"))
    counts = rows.groupBy("label", "prediction", "p").agg(F.count("*").alias("n"))
    assert evaluate.classification_metrics(counts, "label", "prediction", "n").first() == evaluate.classification_metrics(rows, "label", "prediction").first()
    assert tuple(evaluate.ranking_metrics(counts, "label", "p", times="n").first()) == pytest.approx(tuple(evaluate.ranking_metrics(rows, "label", "p").first()))


def test_trees_train_on_counted_bins(spark, parts):
    """Copies of all rows add nothing to what a tree trains on, and leave it as it is."""
    train, test, prep = parts
    cuts = models.bin_cuts(train, len(prep.names))
    # both values of a one-hot column stay apart, however rare one is
    assert max(map(len, cuts)) < models.BINS and cuts[prep.names.index("c_rare")] == [0.5]
    once, twice = models._binned(train, cuts, None), models._binned(train.unionAll(train), cuts, None)
    assert once.count() == twice.count() < train.count()
    assert (once.agg(F.sum("weight")).first()[0], twice.agg(F.sum("weight")).first()[0]) == (train.count(), 2 * train.count())
    one, two = models.fit_model("dt", train), models.fit_model("dt", train.unionAll(train))
    flat = two.transform(one.transform(test).select("features", "label", F.col("prediction").alias("first")))
    sql = models.tree_sql(one, [f"v[{i}]" for i in range(len(prep.names))])
    flat = flat.withColumn("v", vector_to_array("features")).withColumn("sql", F.expr(sql))
    assert flat.where("sql <> first").count() == 0 and flat.where("prediction = first").count() > 0.98 * flat.count()
    assert flat.where("first = label").count() > 0.8 * flat.count()


@pytest.mark.parametrize("key", ["logreg", "et"])
def test_models_score_rows_after_an_observation(spark, parts, key):
    """A session that has observed a table can't be serialised, and a training summary of two classes holds it."""
    seen = Observation()
    spark.range(10).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 10}
    train, test, _ = parts
    assert models.scored(models.fit_model(key, train), test).agg(F.sum(F.col("probs")[1])).first()[0] > 0


def test_logistic_fits_share_their_passes(spark, parts):
    """Every fold and strength of one run of passes equals MLlib's fit of its own rows, and its curve the exact area."""
    train, _, prep = parts
    marked = models._folds(train, ["i"], 2, 42)
    jobs = [(0, 1e-4), (1, 1e-4), (0, 0.1)]
    rows = models._fit_rows(marked, fold="fold")
    found = models._newton(rows, len(prep.names), jobs)
    areas = models._fold_areas(rows, found, jobs)
    for (fold, strength), w, area in zip(jobs, found, areas):
        est = models.estimator("logreg", "classification").setRegParam(strength).setTol(1e-12)
        one = models._fitted(est, marked.where(F.col("fold") != fold))
        assert [*one.coefficients, one.intercept] == pytest.approx(list(w), abs=1e-4)
        held = models.scored(models.LogisticModel(w), marked.where(F.col("fold") == fold)).withColumn("p", F.col("probs")[1])
        assert evaluate.ranking_metrics(held, "label", "p").first()["roc_auc"] == pytest.approx(area, abs=1e-3)


def test_few_valued_features_are_not_sketched(spark, parts, monkeypatch):
    """One-hot columns are cut between their values, so ranks are taken of the other features alone."""
    sketched, real = [], models.F.percentile_approx
    monkeypatch.setattr(models.F, "percentile_approx", lambda *a: sketched.append(a) or real(*a))
    cuts = models.bin_cuts(parts[0], len(parts[2].names))
    assert len(sketched) == 2 and [len(c) for c in cuts[2:]] == [1, 1]


def test_perceptron_steps_over_counted_rows(spark, parts):
    """Copies of all rows are one counted table and one model; the gradient is that of the loss, and MLlib reads the weights as they were fitted."""
    train, test, prep = parts
    once, twice = models.equal_rows(train), models.equal_rows(train.unionAll(train))
    assert once.count() == twice.count() and twice.agg(F.sum("n")).first()[0] == 2 * train.count()
    layers, rng = [len(prep.names), 4, 3, 2], np.random.default_rng(2)
    w = rng.normal(size=sum(a * b + b for a, b in zip(layers, layers[1:])))
    block = [(rng.normal(size=(50, layers[0])), rng.integers(0, 2, 50), rng.integers(1, 4, 50) * 1.0)]
    at = lambda x: perceptron.loss_and_gradient(x, layers, block)
    for i in range(0, len(w), 5):
        e = 1e-6 * (np.arange(len(w)) == i)
        assert (at(w + e)[1] - at(w - e)[1]) / 2e-6 == pytest.approx(at(w)[2 + i], abs=1e-4)
    one, two = models.fit_model("mlp", train), models.fit_model("mlp", train.unionAll(train))
    rows = [models.scored(m, test).select("label", F.col("probs")[1].alias("p")) for m in (one, two)]
    areas = [evaluate.ranking_metrics(r, "label", "p").first()["roc_auc"] for r in rows]
    assert min(areas) > 0.85 and areas[0] == pytest.approx(areas[1], abs=0.02)
    first = test.select(vector_to_array("features").alias("v")).first()["v"]
    x, steps = np.array([first]), perceptron.layers_of(one.weights.toArray(), list(one.getLayers()))
    for a, b in steps[:-1]:
        x = 1.0 / (1.0 + np.exp(-(x @ a + b)))
    z = np.exp(x @ steps[-1][0] + steps[-1][1])
    assert rows[0].first()["p"] == pytest.approx(float((z / z.sum())[0, 1]), abs=1e-9)


def test_forest_draws_rows_by_their_number(spark, parts):
    """Copies of all rows add nothing to what a forest reads; it scores and explains like MLlib's, and its SQL is the model."""
    train, test, prep = parts
    width = len(prep.names)
    one, two = models.fit_model("rf", train), models.fit_model("rf", train.unionAll(train))
    theirs = models._fitted(models.estimator("rf", "classification"), train)
    area = {}
    for name, m in (("one", one), ("two", two), ("mllib", theirs)):
        s = models.scored(m, test).withColumn("p", F.col("probs")[1])
        area[name] = evaluate.ranking_metrics(s, "label", "p").first()["roc_auc"]
    assert area["one"] == pytest.approx(area["mllib"], abs=0.01) and area["two"] == pytest.approx(area["mllib"], abs=0.01)
    assert isinstance(one.model, forest.ForestModel) and one.model.nodes.feature.shape[0] == 100
    # counted bins have the outcomes of the rows behind them
    counted, rows = (evaluate.classification_metrics(x, "label", "prediction", n).first() for x, n in ((models._outcomes(one, train, own=True), "n"), (models.scored(one, train), None)))
    assert counted == rows
    assert list(one.featureImportances) == pytest.approx(list(theirs.featureImportances), abs=0.1)
    again = models.scored(models.fit_model("rf", train.repartition(3)), test).select("i", F.col("probs")[1].alias("q"))
    near = models.scored(one, test).join(again, "i").agg(F.max(F.abs(F.col("probs")[1] - F.col("q")))).first()[0]
    assert near < 1e-9
    small = forest.fit(models._binned(train, one.cuts, None), width, 2, models.BINS, trees=5, depth=3)
    small = models.BinnedModel(small, one.cuts, one.rows)
    flat = small.transform(test).withColumn("v", vector_to_array("features"))
    flat = flat.withColumn("sql", F.expr(models.tree_sql(small, [f"v[{i}]" for i in range(width)])))
    assert flat.where("sql <> prediction").count() == 0 and flat.count() > 0


def test_draws_are_poisson():
    n = np.repeat([1.0, 7.0, 4000.0], 40_000)
    keys = np.random.default_rng(3).integers(0, 2**63, len(n)).astype(np.uint64)
    d = forest.Draws(n)(forest._uniform(keys, 42), np.arange(len(n)))
    for mean in (1.0, 7.0, 4000.0):
        mine = d[n == mean]
        assert mine.mean() == pytest.approx(mean, rel=0.02) and mine.var() == pytest.approx(mean, rel=0.05)
    assert np.mean(d[n == 1.0] == 0) == pytest.approx(np.exp(-1.0), abs=0.01)


def test_trees_of_one_table_share_their_bins(spark, parts, monkeypatch):
    """Trees of a fold and of a leaderboard cut and count their rows once, and fit as they do alone."""
    train, test, _ = parts
    cut, real = [], models.bin_cuts
    alone = models.leaderboard(train, test, ["dt"])[0].first()
    monkeypatch.setattr(models, "bin_cuts", lambda *a: cut.append(a) or real(*a))
    table = {r["model"]: r for r in models.leaderboard(train, test, ["dt", "et"])[0].collect()}
    assert len(cut) == 1 and tuple(table["dt"]) == pytest.approx(tuple(alone))


def test_hinge_fits_share_their_passes(spark, parts, monkeypatch):
    """Every fold of one run of passes comes as near to the least hinge of its own rows as MLlib, which isn't asked."""
    train, _, prep = parts
    marked = models._folds(train, ["i"], 2, 42)
    jobs = [(0, 1e-3), (1, 1e-3)]
    with models._fit_rows(marked, fold="fold") as rows:
        found = models._hinge(rows, len(prep.names), jobs)
    for (fold, strength), w in zip(jobs, found):
        own = marked.where(F.col("fold") != fold)
        pdf = own.select(vector_to_array("features").alias("v"), "label").toPandas()
        x, sign = np.array(pdf.v.tolist()), 2 * pdf.label.to_numpy() - 1
        cost = lambda w, b: np.maximum(0, 1 - sign * (x @ w + b)).mean() + 0.5 * strength * ((w * x.std(0, ddof=1)) ** 2).sum()  # noqa: B023, E731
        theirs = models._fitted(models.estimator("svm", "classification").setRegParam(strength), own)
        assert cost(w[:-1], w[-1]) <= cost(theirs.coefficients.toArray(), theirs.intercept) * (1 + 1e-5)
    monkeypatch.setattr(models.mc.LinearSVC, "fit", lambda *_: 1 / 0)
    model = models.fit_model("svm", train)
    s = models.scored(model, parts[1]).select("label", "prediction", F.col("probs")[1].alias("p"))
    assert s.where("prediction <> cast(p > 0.5 as double)").count() == 0
    assert evaluate.ranking_metrics(s, "label", "p").first()["roc_auc"] > 0.85


def test_a_feature_without_spread_has_no_weight(spark):
    rows = spark.createDataFrame([([x / 10.0, 3.0], float(x + x % 3 > 20)) for x in range(40)], "v array<double>, label double").withColumn("features", array_to_vector("v"))
    model = models.fit_model("svm", rows)
    assert model.coefficients[1] == 0.0 and model.coefficients[0] > 0.0
    assert models.scored(model, rows).where("prediction = label").count() > 35


def test_members_score_in_matrices(spark, parts):
    """Shares of a matrix of features are what the models give row by row, and the ensemble is their mean."""
    train, test, _ = parts
    fits = [models.fit_model(k, train) for k in ("logreg", "dt", "svm")]
    fits.append(models.BinnedModel(forest.fit(fits[1].rows, 4, 2, models.BINS, trees=5, depth=3), fits[1].cuts, fits[1].rows))
    x = np.array(test.orderBy("i").select(vector_to_array("features").alias("v")).toPandas().v.tolist())
    each = []
    for m in fits:
        own = np.array(models.scored(m, test).orderBy("i").select("probs").toPandas().probs.tolist())
        assert np.allclose(m.shares(x), own, atol=1e-12)
        each.append(own)
    together = models.ensemble(fits, test).orderBy("i").toPandas()
    assert set(together.columns) == {*test.columns, "probs", "prediction"}
    assert np.allclose(np.array(together.probs.tolist()), np.mean(each, axis=0))
    assert (together.prediction == np.mean(each, axis=0).argmax(1)).all()


def test_areas_of_folds_are_exact(spark, parts, monkeypatch):
    """Held-out rows of linear models are ranked exactly in stretches, however few scores a stretch holds; ties count half."""
    train, _, prep = parts
    marked = models._folds(train.withColumn("features", array_to_vector(F.transform(vector_to_array("features"), lambda x: F.round(x, 1)))), ["i"], 2, 42)
    monkeypatch.setattr(models, "AREA_ROWS", 100)
    with models._fit_rows(marked, fold="fold") as rows:
        fits = models._linear("logreg", rows, [(0, 1e-3), (1, 1e-3)])
        areas = models._exact_areas(rows, fits, [0, 1])
        assert models._exact_areas(rows, fits[:1], [7]) == [None]
    for f in (0, 1):
        held = models.scored(fits[f], marked.where(F.col("fold") == f)).withColumn("p", F.col("probs")[1])
        assert evaluate.ranking_metrics(held, "label", "p").first()["roc_auc"] == pytest.approx(areas[f], abs=1e-12)


def test_linear_members_of_all_folds_are_fitted_together(spark, parts, monkeypatch):
    packed, real = [], models._fit_rows
    monkeypatch.setattr(models, "_fit_rows", lambda *a, **k: packed.append(a) or real(*a, **k))
    out, best = models.best_ensemble(parts[0], parts[1], ["logreg", "dt", "svm"], ["i"], top=2, folds=2)
    assert len(packed) == 1 and len(best) == 2
    assert evaluate.classification_metrics(out, "label", "prediction").first()["accuracy"] > 0.8


def test_perceptron_rows_in_single_precision(spark, parts):
    """Passes take rows as they are where hardly any are equal, in single precision, and count the outcomes of the fit's rows."""
    train, test, prep = parts
    layers, rng = [len(prep.names), 4, 3, 2], np.random.default_rng(2)
    w = rng.normal(size=sum(a * b + b for a, b in zip(layers, layers[1:])))
    x, label = rng.normal(size=(3000, layers[0])), rng.integers(0, 2, 3000)
    one, half = (perceptron.loss_and_gradient(w, layers, [(x.astype(k), label, np.ones(3000))]) for k in (float, np.float32))
    assert one == pytest.approx(half, abs=1e-6 * np.abs(one).max())
    n = train.count()
    apart = train.withColumn("features", array_to_vector(F.array(F.col("i").cast("double"), F.lit(0.0))))
    assert models._perceptron_rows(apart, n).count() == n and models._perceptron_rows(train.unionAll(train), 2 * n).count() <= n
    kinds = [b[0].dtype for b in models._perceptron_rows(apart, n).mapInArrow(perceptron._packed, "v binary, label binary, n binary").rdd.map(perceptron._block).collect()]
    assert set(kinds) == {np.dtype(np.float32)}
    model = models.fit_model("mlp", train)
    known = {(r["label"], r["prediction"]): r["n"] for r in models._outcomes(model, train, own=True, ranked=False).collect()}
    rows = models.scored(model, train).groupBy("label", "prediction").count().collect()
    assert sum(known.values()) == n and all(abs(known[r["label"], r["prediction"]] - r["count"]) <= 2 for r in rows)
    theirs = model.model.transform(test).select("i", vector_to_array("probability")[1].alias("q"))
    near = models.scored(model, test).join(theirs, "i").agg(F.max(F.abs(F.col("probs")[1] - F.col("q"))), F.count("*")).first()
    assert near[0] < 1e-12 and near[1] == test.count()
