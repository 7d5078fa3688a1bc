import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Observation
from pyspark.sql import functions as F

from corridor.common import Refused
from corridor.operators import gates, models, ranking


def _rows(n=120, width=5, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * [1, 3, 0.5, 2, 1][:width] + 1
    return x, x @ np.arange(1, width + 1) / 4 + rng.normal(size=n) * 0.1


def test_probe_is_ridge_on_standardised_columns(spark):
    x, y = _rows()
    fold = [k % 5 for k in range(len(y))]
    df = spark.createDataFrame([(k, x[k].tolist(), float(y[k]), fold[k]) for k in range(len(y))], "id long, e array<double>, y double, fold int").withColumn("v", array_to_vector("e"))
    got = {r.id: r.oof for r in models.probe(df, "id", "v", "y", "rate").collect()}
    for f in range(5):
        train = np.array([k for k in range(len(y)) if fold[k] != f])
        z = (x - x[train].mean(0)) / x[train].std(0, ddof=1)
        a = z[train] - z[train].mean(0)
        beta = np.linalg.solve(a.T @ a + np.eye(5), a.T @ (y[train] - y[train].mean()))
        for k in range(len(y)):
            if fold[k] == f:
                assert got[k] == pytest.approx((z[k] - z[train].mean(0)) @ beta + y[train].mean(), abs=2e-3)


def test_probe_says_yes_or_no(spark):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3  # from here on the session can't be sent to tasks, nor a model that holds it
    x, y = _rows()
    df = spark.createDataFrame([(k, x[k].tolist(), float(y[k] > np.median(y)), k % 5) for k in range(len(y))], "id long, e array<double>, y double, fold int").withColumn("v", array_to_vector("e"))
    out = models.probe(df, "id", "v", "y", "yes").join(df.select("id", "y"), "id").toPandas()
    assert ((out.oof > 0.5) == (out.y > 0.5)).mean() > 0.9
    assert models.probe(df.withColumn("y", F.lit(1.0)), "id", "v", "y", "yes").count() == 0


def test_pca_against_numpy(spark):
    x, _ = _rows()
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, e array<double>").withColumn("v", array_to_vector("e"))
    got = np.array([r.p for r in models.centred_pca(df, "v", 3).orderBy("id").select(vector_to_array("pca").alias("p")).collect()])
    a = x - x.mean(0)
    want = a @ np.linalg.svd(a, full_matrices=False)[2][:3].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_held_out_predictions_never_saw_their_fold(spark):
    """A row's own label, changed, must not change what is predicted for its fold."""
    rng = random.Random(5)
    data = [(k, float(rng.randrange(20)), float(rng.randrange(10)), k % 3) for k in range(60)]
    base = spark.createDataFrame(data, "id long, age double, y double, fold int")
    other = base.withColumn("y", F.when(F.col("fold") == 0, 1000.0).otherwise(F.col("y")))
    first, second = ({r.id: r.oof for r in models.oof(d, "id", ["age"], [], "y", "rate", folds=3, iterations=2).where("fold = 0").collect()} for d in (base, other))
    assert first == second and len(first) == 20
    none = models.oof(base.withColumn("y", F.lit(0)), "id", ["age"], [], "y", "yes", folds=3, iterations=1)
    assert none.count() == 0  # one class: nothing to learn from


def _learnable(spark, kind):
    rng = random.Random(6)
    rows = [(k, float(rng.randrange(9)), None if k % 17 == 0 else float(rng.randrange(25)), k % 3, rng.gauss(0, 2)) for k in range(700)]
    rows = [(k, a, b, f, (a * 1.7 - (b or 0) * 0.37 + e) if kind == "rate" else float(a * 1.7 - (b or 0) * 0.37 + e > 3)) if k % 23 else (k, a, b, f, None) for k, a, b, f, e in rows]
    return spark.createDataFrame(rows, "id long, age double, other double, fold int, y double")


@pytest.mark.parametrize("kind", ["rate", "yes"])
def test_trees_on_counted_rows_are_those_of_spark_ml(spark, monkeypatch, kind):
    df = _learnable(spark, kind)
    taken = lambda rows, c: {r.id: r[c] for r in rows.collect()}
    how = {"key": "id", "numbers": ["age", "other"], "words": [], "label": "y", "kind": kind, "iterations": 6}
    whole = {"train": df.where("fold < 2"), "rows": df.where("fold = 2")}
    by_rows = []
    monkeypatch.setattr(models, "Pipeline", lambda stages, _p=models.Pipeline: (by_rows.append(1), _p(stages=stages))[1])
    got = taken(models.oof(df, folds=3, **how), "oof"), taken(models.fit_predict(**whole, **how), "full")
    assert not by_rows  # no job a level of a tree
    monkeypatch.setattr(models, "MOST_COUNTED", 0)  # too many to count
    want = taken(models.oof(df, folds=3, **how), "oof"), taken(models.fit_predict(**whole, **how), "full")
    assert len(by_rows) == 4 and len(got[0]) == 700 and got[0].keys() == want[0].keys() and got[1].keys() == want[1].keys()
    for a, b in zip(got, want, strict=True):
        near = [abs(a[k] - b[k]) < 1e-6 for k in a]
        assert sum(near) > 0.9 * len(near) and len(set(a.values())) > 20  # of splits equally good either may be taken, and later trees follow it


def test_quantile_cuts_and_trip_wires(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(100)] + [(100, None)], "id long, s double")
    got = {r.id: r.part for r in ranking.cut_by_quantiles(df, "s", 4, "part").collect()}
    assert got[0] == 1 and got[99] == 4 and got[100] is None and {got[k] for k in range(100)} == {1, 2, 3, 4}
    assert gates.not_too_good("rho", 0.5, 0.95) == 0.5 and gates.not_too_good("rho", None, 0.95) is None
    with pytest.raises(Refused):
        gates.not_too_good("rho", 0.96, 0.95)


def test_gates_refuse_more(spark):
    twice = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    once = spark.createDataFrame([("a", 5)], "k string, w int")
    with pytest.raises(Refused):
        gates.merge_one_to_one(twice, once, "k")  # the left key counts too
    with pytest.raises(Refused):
        gates.merge_one_to_one(once, twice, "k")
    with pytest.raises(Refused):
        gates.merge_one_to_one(once, once, "k")
    assert gates.check_features(["age", "pv_thickness"]) and gates.check_features(["y_own"], frozenset(), ())
    for bad in ("pv_AVERAGE_IRI", "pv_asph_RTG_NBR", "in_helene_zone", "n_points", "im_vit_3"):
        with pytest.raises(Refused):
            gates.check_features(["age", bad])
    with pytest.raises(Refused):
        gates.clean_numbers(spark.createDataFrame([(float("inf"),)], "x double"))
    with pytest.raises(Refused):
        gates.clean_numbers(spark.sql("select timestamp_ntz'2024-01-01' as t"))
    with pytest.raises(Refused):
        gates.assert_contract(spark.createDataFrame([("a", 1.0, 1.0, "0_0", 9)], "seg_id string, mid_x double, mid_y double, split_block string, fold int"), [])
    with pytest.raises(Refused):
        gates.contract_report(once, ["z"])
    h = spark.createDataFrame([("code", "1"), ("table", "2"), ("manifest", "")], "name string, hash string")
    with pytest.raises(Refused):
        gates.comparable(h, h)  # a missing hash is a difference
    reports = spark.createDataFrame([("s", None), ("s", "duplicate")], "source string, reason string")
    with pytest.raises(Refused):
        gates.assert_few_repeats(reports)
