"""Exact quantiles by rank, and bootstraps of rank metrics against draws made row by row."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corridor.common import Refused
from corridor.operators import metrics
from corridor.operators.order_stats import quantiles


def test_quantiles_of_groups_and_of_all(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.choice([None, r.gauss(0, 9), 1.5, 1.5, -0.0, 0.0])) for _ in range(3000)] + [("lone", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    asked = {"q50": (F.col("v"), 0.5), "q90": (F.col("v"), 0.9), "size": (F.abs("v"), 0.25), "least": (F.col("v"), 0.0), "most": (F.col("v"), 1.0)}

    def want(values):
        v = np.array([x for x in values if x is not None])
        return [np.percentile(v, 50), np.percentile(v, 90), np.percentile(abs(v), 25), v.min(), v.max()]

    got = {x[0]: list(x[1:]) for x in quantiles(df, ["g"], asked).collect()}
    assert set(got) == {"a", "b", None, "lone"}
    for g in got:
        assert got[g] == pytest.approx(want([v for k, v in rows if k == g]))
    assert list(quantiles(df, [], asked).first()) == pytest.approx(want([v for _, v in rows]))
    assert list(quantiles(df.limit(0), [], asked).first()) == [None] * 5 and quantiles(df.limit(0), ["g"], asked).count() == 0


def test_no_percentile_of_a_whole_table_is_left(spark):
    df = spark.range(10).select(F.col("id").alias("y"), (F.col("id") + 1).alias("p"))
    plan = metrics.error_summary(df, "y", "p")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "percentile(" not in plan and "median(" not in plan


def _ap(y, s):
    if not len(y) or y.sum() in (0, len(y)):
        return np.nan
    out, upto, n = 0.0, 0.0, 0
    for v in sorted(set(s), reverse=True):
        t, c = y[s == v].sum(), (s == v).sum()
        upto, n = upto + t, n + c
        out += t * upto / n
    return out / y.sum()


def _rho(y, s):
    ranks = [np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v]) for v in (y, s)]
    return np.nan if min(r.std() for r in ranks) == 0 else np.corrcoef(*ranks)[0, 1]


@pytest.mark.parametrize("metric", ["ap", "rho"])
def test_rank_bootstrap_against_rows_drawn_again(spark, metric, monkeypatch):
    monkeypatch.setattr(metrics, "AT_ONCE", 3)
    r = random.Random(6)
    rows = [(f"b{r.randrange(7)}", float(r.random() < 0.2), float(r.randrange(12)), r.choice([None, r.random()])) for _ in range(240)] + [(None, 1.0, 3.0, 0.5), ("b1", None, 2.0, 0.1)]
    df = spark.createDataFrame(rows, "block string, y double, a double, b double").repartition(5)
    got = metrics.rank_bootstrap(df, "block", "y", "a", "b", metric, 25).first()
    ok = [x for x in rows if None not in x]
    names = sorted({x[0] for x in ok})
    f = _ap if metric == "ap" else _rho

    def difference(some):
        y, a, b = (np.array([x[k] for x in some]) for k in (1, 2, 3))
        return f(y, a) - f(y, b)

    drawn = []
    for d in range(25):
        picks = [names[int(hashlib.md5(f"42:{d}:{k}".encode()).hexdigest()[:12], 16) % len(names)] for k in range(len(names))]
        drawn.append(difference([x for p in picks for x in ok if x[0] == p]))
    drawn = [x for x in drawn if x == x]
    assert (got.n_blocks, got.draws) == (len(names), len(drawn))
    assert [got.value, got.low, got.high] == pytest.approx([difference(ok), *np.percentile(drawn, [2.5, 97.5])])
    alone = metrics.rank_bootstrap(df, "block", "y", "a", None, metric, 3).first()
    assert alone.value == pytest.approx(f(*(np.array([x[k] for x in rows if x[0] and x[1] is not None]) for k in (1, 2))))


def test_rank_bootstrap_of_nothing_and_of_too_much(spark, monkeypatch):
    df = spark.createDataFrame([("b", 1.0, 2.0)], "block string, y double, a double")
    assert metrics.rank_bootstrap(df.limit(0), "block", "y", "a", None, "ap", 5).first()["n_blocks"] == 0
    assert metrics.rank_bootstrap(df, "block", "y", "a", None, "rho", 5).first()["value"] is None
    monkeypatch.setattr(metrics, "MOST_CELLS", 3)
    with pytest.raises(Refused):
        metrics.rank_bootstrap(df, "block", "y", "a", None, "ap", 5)
