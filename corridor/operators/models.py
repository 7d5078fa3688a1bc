"""Held-out predictions with spark.ml: a model for each fold, never fitted on the rows that it predicts."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA, Bucketizer, Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.common import checkpointed
from corridor.operators.gates import check_features
from corridor.operators.order_stats import quantiles


def _prepared(numbers: list[str], words: list[str]) -> list:
    steps = [Imputer(inputCols=numbers, outputCols=[f"{c}__in" for c in numbers])] if numbers else []
    steps += [StringIndexer(inputCol=c, outputCol=f"{c}__ix", handleInvalid="keep") for c in words]
    return [*steps, VectorAssembler(inputCols=[*(f"{c}__in" for c in numbers), *(f"{c}__na" for c in numbers), *(f"{c}__ix" for c in words)], outputCol="features")]


def _with_blanks(df: DataFrame, numbers: list[str], words: list[str]) -> DataFrame:
    df = df.withColumns({f"{c}__na": F.col(c).isNull().cast("double") for c in numbers} | {c: F.col(c).cast("double") for c in numbers})
    return df.fillna("missing", words) if words else df


def estimator(kind: str, label: str, iterations: int = 30):
    if kind == "rate":
        return GBTRegressor(labelCol=label, lossType="absolute", maxIter=iterations, maxDepth=5, seed=7)
    return GBTClassifier(labelCol=label, maxIter=iterations, maxDepth=4, seed=7)


def _predicted(out: DataFrame, kind: str, name: str) -> DataFrame:
    return out.withColumn(name, F.col("prediction") if kind == "rate" else F.get(vector_to_array("probability"), 1))


#: Most counted rows that one model is fitted on in one task; finer shares than bins at which a number's values are looked at.
MOST_COUNTED, SHARES = 4_000_000, 256


def _cuts(df: DataFrame, numbers: list[str], those: list[Column], bins: int) -> list[dict[str, tuple[float, list[float]]]]:
    """For each of ``those`` rows: a number's mean and the least values of its bins but the first, in one go over ``df``."""
    known = {c: F.when(~F.isnan(c), F.col(c)) for c in numbers}
    shares = F.array(*[F.lit(k / SHARES) for k in range(SHARES + 1)])
    each = [[f.alias(f"{k}_{n}_{what}") for n, c in enumerate(numbers) for what, f in (("m", F.avg(F.when(on, known[c]))), ("b", F.count_if(on & known[c].isNull())), ("q", F.percentile_approx(F.when(on, known[c]), shares)))] for k, on in enumerate(those)]
    row = df.agg(F.count("*").alias("n"), *[f for one in each for f in one]).first()

    def ends(values: list[float] | None, mean: float, blanks: int) -> list[float]:
        own = sorted({*(values or []), *([mean] if blanks else [])})
        return own[1:] if len(own) <= bins else sorted({values[k * SHARES // bins] for k in range(1, bins)} - {own[0]})

    return [{c: (row[f"{k}_{n}_m"] or 0.0, ends(row[f"{k}_{n}_q"], row[f"{k}_{n}_m"] or 0.0, row[f"{k}_{n}_b"])) for n, c in enumerate(numbers)} for k in range(len(those))]


def _binned(df: DataFrame, numbers: list[str], cuts: dict[str, tuple[float, list[float]]], names: list[str]) -> DataFrame:
    """``df`` with the bin of each number, blanks being its mean, under the first of ``names``, and of its blanks under the others."""
    df = df.withColumns({f"{n}v": F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(float(cuts[c][0]))) for c, n in zip(numbers, names, strict=False)})
    many = [(f"{n}v", f"{n}d", [-math.inf, *cuts[c][1], math.inf]) for c, n in zip(numbers, names, strict=False) if cuts[c][1]]
    if many:
        df = Bucketizer(inputCols=[m[0] for m in many], outputCols=[m[1] for m in many], splitsArray=[m[2] for m in many]).transform(df)
    bins = {n: (F.col(f"{n}d") if cuts[c][1] else F.lit(0)).cast("int") for c, n in zip(numbers, names, strict=False)}
    return df.withColumns(bins | {n: F.col(f"{c}__na").cast("int") for c, n in zip(numbers, names[len(numbers) :], strict=True)})


def _tree(bins: np.ndarray, w: np.ndarray, g: np.ndarray, depth: int) -> np.ndarray:
    """What a tree of least squares makes of each row, given weights and weighted targets: splits by bin, level by level."""
    node, width = np.zeros(len(w), dtype=np.int64), int(bins.max(initial=0)) + 1
    for _ in range(depth):
        n = int(node.max()) + 1
        best, at, cut = np.full(n, 1e-12), np.full(n, -1), np.zeros(n, dtype=np.int64)
        for k in range(bins.shape[1]):
            where = node * width + bins[:, k]
            sw, sg = (np.cumsum(np.bincount(where, v, n * width).reshape(n, width), axis=1) for v in (w, g))
            lw, lg, tw, tg = sw[:, :-1], sg[:, :-1], sw[:, -1:], sg[:, -1:]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((lw > 0) & (tw - lw > 0), lg**2 / lw + (tg - lg) ** 2 / (tw - lw) - tg**2 / tw, 0.0) / np.maximum(tw, 1e-300)
            if width > 1:
                top = gain.argmax(axis=1)
                own = gain[np.arange(n), top]
                more = own > best
                best[more], at[more], cut[more] = own[more], k, top[more]
        if (at < 0).all():
            break
        up = (at[node] >= 0) & (bins[np.arange(len(w)), at[node]] > cut[node])
        node = np.unique(node * 2 + up, return_inverse=True)[1]
    return (np.bincount(node, g) / np.bincount(node, w))[node]


def _boost(bins: np.ndarray, row: np.ndarray, y: np.ndarray, w: np.ndarray, kind: str, rounds: int, depth: int, step: float) -> np.ndarray:
    """Boosted trees as spark.ml fits them, on counted rows: ``bins`` are the rows alike to a tree, ``row`` says which of
    them a label ``y`` of weight ``w`` belongs to. Gives each of ``bins`` its prediction; those without labels too."""
    total = np.bincount(row, w, len(bins))
    if kind != "rate":
        y = 2 * y - 1
    some = np.flatnonzero(total > 0)
    out = np.zeros(len(bins))

    def grown(g: np.ndarray) -> np.ndarray:
        # rows without weight follow the splits that the others make
        return _tree(bins, total, g, depth) if len(some) else out

    out = grown(np.bincount(row, w * y, len(bins)))
    for _ in range(rounds - 1):
        f = out[row]
        pull = np.where(y < f, -1.0, 1.0) if kind == "rate" else 4 * y / (1 + np.exp(2 * y * f))
        out = out + step * grown(np.bincount(row, w * pull, len(bins)))
    return out if kind == "rate" else 1 / (1 + np.exp(-2 * out))


def _by_bins(models: list[tuple[DataFrame, DataFrame]], numbers: list[str], label: str, kind: str, est, cuts: list[dict], name: str) -> Callable[[DataFrame, Column], DataFrame] | None:
    """Gives rows ``name``: what the model of a row's number makes of it, null without one. The k-th model learns from the
    first and answers for the second of the k-th pair of frames. None where one of them has more than ``MOST_COUNTED`` rows
    that differ in bins or label.

    Trees split a number at the ends of its bins, so rows of equal bins are one to them but for their labels: these are
    counted, and each model is fitted on its counts in one task. Rows get the prediction of their bins.
    """
    inputs = [f"_b{k}" for k in range(2 * len(numbers))]
    of = lambda df, k, y: _binned(df, numbers, cuts[k], inputs).select(F.lit(k).alias("_k"), *inputs, y.cast("double").alias("_y"))
    train, asked = [of(t, k, F.col(label)) for k, (t, _) in enumerate(models)], [of(r, k, F.lit(None)) for k, (_, r) in enumerate(models)]
    counted = checkpointed(reduce(DataFrame.unionAll, train + asked).groupBy("_k", *inputs, "_y").agg(F.count("*").cast("double").alias("_w")))
    if any(r["count"] > MOST_COUNTED for r in counted.groupBy("_k").count().collect()):
        return None
    rounds, depth, step = est.getMaxIter(), est.getMaxDepth(), est.getStepSize()

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        of, bins = rows.groupby(inputs, sort=True).ngroup().to_numpy(), rows[inputs].drop_duplicates().sort_values(inputs).reset_index(drop=True)
        known = rows["_y"].notna().to_numpy()
        bins[name] = _boost(bins[inputs].to_numpy(), of[known], rows["_y"].to_numpy()[known], rows["_w"].to_numpy()[known], kind, rounds, depth, step)
        bins["_k"] = rows["_k"].iloc[0]
        return bins.loc[np.unique(of[~known])]

    answers = checkpointed(counted.groupBy("_k").applyInPandas(fit, f"_k int, {', '.join(f'{c} int' for c in inputs)}, {name} double"))
    few = answers.count() <= MOST_COUNTED // 4
    own = [[f"{c}_{k}" for c in inputs] for k in range(len(cuts))]

    def attached(to: DataFrame, which: Column) -> DataFrame:
        rows = to
        for c, names in zip(cuts, own, strict=True):
            rows = _binned(rows, numbers, c, names)
        by = [reduce(lambda v, k: F.when(F.col("_k") == k, F.col(own[k][n])).otherwise(v), range(len(own)), F.lit(None).cast("int")).alias(c) for n, c in enumerate(inputs)]
        rows = rows.withColumn("_k", which.cast("int")).select(*to.columns, "_k", *by)
        return rows.join(F.broadcast(answers) if few else answers, ["_k", *inputs], "left").drop("_k", *inputs)  # just counted

    return attached


def held_out(d: DataFrame, name: str, key: str, numbers: list[str], words: list[str], label: str, kind: str, fold: str = "fold", folds: int = 5, iterations: int = 30) -> Callable[[DataFrame], DataFrame]:
    """Gives rows of ``d``, which have its columns, ``name``: each fold predicted by a model of the other folds of ``d``, null
    where there is nothing to learn from.

    Numbers alone are learned from counts of their bins, where these are few enough; words, and numbers with too many
    different rows, by spark.ml from the rows, the models side by side. ``d`` is read several times.
    """
    check_features([*numbers, *words])
    known, d = F.col(label).isNotNull(), _with_blanks(d, numbers, words)
    stats = {r[fold]: (r["n"], r["s"]) for r in d.where(known).groupBy(fold).agg(F.count("*").alias("n"), F.sum(label).alias("s")).collect()}
    learned = []
    for k in range(folds):
        rest = [v for f, v in stats.items() if f != k]
        n, s = sum(v[0] for v in rest), sum(v[1] for v in rest)
        if n and not (kind != "rate" and (s == 0 or s == n)):
            learned.append(k)
    if not learned:
        return lambda to: to.withColumn(name, F.lit(None).cast("double"))
    est = estimator(kind, label, iterations)
    if numbers and not words:
        cuts = _cuts(d, numbers, [known & (F.col(fold) != k) for k in learned], est.getMaxBins())
        pairs = [(d.where(known & (F.col(fold) != k)), d.where(F.col(fold) == k)) for k in learned]
        which = reduce(lambda v, k: F.when(F.col(fold) == learned[k], k).otherwise(v), range(len(learned)), F.lit(None))
        held = _by_bins(pairs, numbers, label, kind, est, cuts, name)
        if held is not None:
            return lambda to: held(_with_blanks(to, numbers, []), which).select(*[c for c in to.columns if c != name], name)

    def fold_of(k: int) -> DataFrame:
        model = Pipeline(stages=[*_prepared(numbers, words), estimator(kind, label, iterations)]).fit(d.where(known & (F.col(fold) != k)))
        return checkpointed(_predicted(model.transform(d.where(F.col(fold) == k)), kind, name).select(key, name))

    with ThreadPoolExecutor(len(learned)) as pool:
        held = reduce(DataFrame.unionAll, pool.map(inheritable_thread_target(d.sparkSession)(fold_of), learned))
    return lambda to: to.join(held, key, "left").select(*to.columns, name)


def oof(df: DataFrame, key: str, numbers: list[str], words: list[str], label: str, kind: str, fold: str = "fold", folds: int = 5, iterations: int = 30) -> DataFrame:
    """key, fold and oof: each fold predicted by a model of the other folds. Folds with nothing to learn from are left out."""
    d = checkpointed(df.select(*dict.fromkeys([key, *numbers, *words, label, fold])))
    return held_out(d, "oof", key, numbers, words, label, kind, fold, folds, iterations)(d).where("oof is not null").select(key, fold, "oof")


def fit_predict(train: DataFrame, rows: DataFrame, key: str, numbers: list[str], words: list[str], label: str, kind: str, iterations: int = 30) -> DataFrame:
    """key and full: ``rows`` predicted by one model of all labelled rows of ``train``; none where these are of one class."""
    check_features([*numbers, *words])
    t, rows = _with_blanks(train, numbers, words).where(F.col(label).isNotNull()), _with_blanks(rows, numbers, words)
    n, s = t.agg(F.count("*"), F.coalesce(F.sum(label), F.lit(0))).first()
    if not n or (kind != "rate" and (s == 0 or s == n)):
        return rows.select(key, F.lit(None).cast("double").alias("full")).limit(0)
    est = estimator(kind, label, iterations)
    if numbers and not words:
        out = _by_bins([(t, rows)], numbers, label, kind, est, _cuts(t, numbers, [F.lit(True)], est.getMaxBins()), "full")
        if out is not None:
            return out(rows, F.lit(0)).select(key, "full")
    model = Pipeline(stages=[*_prepared(numbers, words), est]).fit(t)
    return _predicted(model.transform(rows), kind, "full").select(key, "full")


def heldout_then_model(df: DataFrame, oof_rows: DataFrame, full: DataFrame, key: str) -> DataFrame:
    """pred: the held-out value where there is one, else the full model's; heldout says which."""
    both = df.select(key).join(oof_rows.select(key, "oof"), key, "left").join(full.select(key, "full"), key, "left")
    return both.select(key, F.coalesce("oof", "full").alias("pred"), F.col("oof").isNotNull().alias("heldout"))


def naive_prediction(df: DataFrame, key: str, label: str, fold: str = "fold", folds: int = 5) -> DataFrame:
    """The median label of the other folds."""
    m = quantiles(df, [], {f"m{k}": (F.when(F.col(fold) != k, F.col(label)), 0.5) for k in range(folds)})
    return df.crossJoin(F.broadcast(m)).select(key, fold, F.coalesce(*[F.when(F.col(fold) == k, F.col(f"m{k}")) for k in range(folds)]).alias("naive"))  # one row of medians


def _bare(model: PipelineModel) -> PipelineModel:
    """``model`` without the summaries of its training: these hold the session, which no task can take along once it has
    observed a metric."""
    for stage in model.stages:
        if getattr(stage, "hasSummary", False):
            stage._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return model


def probe(df: DataFrame, key: str, vector: str, label: str, kind: str, fold: str = "fold", folds: int = 5, alpha: float = 1.0) -> DataFrame:
    """Out-of-fold ridge (rate) or logistic regression on standardised vectors.

    Folds are counted once over settled rows; each fold's predictions are settled before they are put together.
    """
    d = checkpointed(df.select(key, vector, label, fold))
    known, v = d.where(F.col(label).isNotNull()), F.col(label).cast("double")
    sums = known.groupBy(fold).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"), F.min(v).alias("low"), F.max(v).alias("high")).collect()  # a row a fold
    parts = []
    for k in range(folds):
        rest = [r for r in sums if r[fold] is not None and r[fold] != k]
        n = sum(r["n"] for r in rest)
        if not n or min(r["low"] for r in rest) == max(r["high"] for r in rest):
            continue
        mean = sum(r["s"] for r in rest) / n
        sd = max(sum(r["ss"] for r in rest) / n - mean * mean, 0.0) ** 0.5
        scaled = StandardScaler(inputCol=vector, outputCol="features", withMean=True)
        if kind == "rate":
            est = LinearRegression(labelCol=label, solver="normal", elasticNetParam=0.0, standardization=False, regParam=alpha * sd / n)
        else:
            est = LogisticRegression(labelCol=label, standardization=False, regParam=1 / (alpha * n))
        model = _bare(Pipeline(stages=[scaled, est]).fit(known.where(F.col(fold) != k)))
        parts.append(checkpointed(_predicted(model.transform(d.where(F.col(fold) == k)), kind, "oof").select(key, "oof")))
    return reduce(DataFrame.unionAll, parts) if parts else df.select(key, F.lit(None).cast("double").alias("oof")).limit(0)


def centred_pca(df: DataFrame, vector: str, k: int = 16) -> DataFrame:
    stages = [StandardScaler(inputCol=vector, outputCol="_c", withMean=True, withStd=False), PCA(k=k, inputCol="_c", outputCol="pca")]
    return Pipeline(stages=stages).fit(df).transform(df).drop("_c")


def shuffled_labels(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """Labels dealt anew among the labelled rows: the k-th row by id gets the label of the k-th row by hash."""
    from corridor.operators.ranking import draw, global_rank

    known = checkpointed(df.where(F.col(label).isNotNull()).select(key, label))  # ranked twice, each with a look ahead for its ranges
    a = global_rank(known.select(key), [F.asc(key)], "_k")
    b = global_rank(known.withColumn("_h", draw(seed, F.col(key))), [F.asc("_h"), F.asc(key)], "_k").select("_k", label)
    return a.join(b, "_k").select(key, label)
