"""Comparisons of models: growing groups of columns, ranges of a change, a model moved to another place, rescaled estimates."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridor.common import checkpointed
from corridor.operators import metrics, models
from corridor.operators.gates import not_too_good

# Fewest pairs that a curve of its own is fitted on; rank correlation over which an input must be leaking.
LEAST_PAIRS, LEAK_RHO = 50, 0.95


def rescale(df: DataFrame, est: str, count: str, group: str, out: str = "rescaled", least: int = LEAST_PAIRS) -> DataFrame:
    """``df`` with the estimate on the scale of the counts: a rising curve in log10 for each group, flat past its ends.

    Curves are fitted on rows with both values above 0. A group with fewer than ``least`` of them uses the curve of all
    rows; with fewer than ``least`` in all, the estimate stays as it is. Null groups and estimates give null, and so do
    estimates of 0 or less. Groups are few: road systems.
    """
    both = F.col(est).isNotNull() & F.col(count).isNotNull() & (F.col(est) > 0) & (F.col(count) > 0)
    # a curve through equal estimates goes by their mean: rows with one estimate are one row of their weight
    sums = [F.count_if(both).alias("_n"), F.sum(F.when(both, F.log10(count))).alias("_s")]
    seen = checkpointed(df.groupBy(group, est).agg(*sums).withColumn("_x", F.when(F.col(est) > 0, F.log10(est))))
    sizes = {r[group]: r["n"] for r in seen.groupBy(group).agg(F.sum("_n").alias("n")).collect()}
    if sum(sizes.values()) < least:
        return df.withColumn(out, F.col(est).cast("double"))
    pairs = seen.where("_n > 0")
    steps = [VectorAssembler(inputCols=["_x"], outputCol="_v"), IsotonicRegression(featuresCol="_v", labelCol="_y", weightCol="_w", predictionCol="_p")]

    def fit(rows: DataFrame):
        means = rows.groupBy("_x").agg((F.sum("_s") / F.sum("_n")).alias("_y"), F.sum("_n").cast("double").alias("_w"))
        return Pipeline(stages=steps).fit(means)

    own = [g for g, n in sizes.items() if g is not None and n >= least]
    fits = [(F.col(group) == g, fit(pairs.where(F.col(group) == g))) for g in own]
    fits.append((~F.col(group).isin(own) if own else F.lit(True), fit(pairs)))
    known = seen.where(F.col("_x").isNotNull() & F.col(group).isNotNull()).select(group, est, "_x")
    parts = [model.transform(known.where(rows)).select(F.col(group).alias("_g"), F.col(est).alias("_e"), F.pow(F.lit(10.0), "_p").alias(out)) for rows, model in fits]
    curve = reduce(DataFrame.unionAll, parts)
    return df.join(curve, (F.col(group) == F.col("_g")) & (F.col(est) == F.col("_e")), "left").select(*df.columns, out)


def change_range(df: DataFrame, key: str, block: str, y: str, old: str, new: str, draws: int, seed: int = 42) -> DataFrame:
    """Mean absolute error of ``new`` less that of ``old`` over rows with both: value, low and high over drawn blocks."""
    ok = df.where(F.col(y).isNotNull() & F.col(old).isNotNull() & F.col(new).isNotNull())
    gain = F.abs(F.col(new) - F.col(y)) - F.abs(F.col(old) - F.col(y))
    return metrics.block_bootstrap(ok.select(block, gain.alias("_g"), F.lit(1).alias("_one")), block, "_g", "_one", draws, seed)


def ablation(df: DataFrame, key: str, ladder: list[tuple[str, list[str]]], label: str, kind: str, block: str, fold: str = "fold", draws: int = 300, iterations: int = 30, top: int = 50, most_rho: float = LEAK_RHO) -> DataFrame:
    """A row for each arm of the ladder: its inputs, rows scored, held-out metrics, and its change from the first arm with
    the range of the change over drawn blocks.

    ``rate`` labels have mae (whose change it is) and rho; ``yes`` labels have ap (whose change it is) and the precision of
    the ``top`` rows. Every arm works on the same rows and folds. An arm of rates whose rank correlation is over
    ``most_rho`` is refused: an input gives the label away. Arms are few, and each is one row of the result.
    """
    d = checkpointed(df.select(*dict.fromkeys([key, block, label, fold, *[c for _, columns in ladder for c in columns]])))
    side = inheritable_thread_target(df.sparkSession)  # arms are worked out side by side: each is many small jobs
    with ThreadPoolExecutor(len(ladder)) as pool:
        learned = list(pool.map(side(lambda k: models.held_out(d, f"_p{k}", key, ladder[k][1], [], label, kind, fold, iterations=iterations)), range(len(ladder))))
    held = reduce(lambda rows, give: give(rows), learned, d).where(F.col(label).isNotNull())
    held = checkpointed(held.select(key, block, label, *[f"_p{k}" for k in range(len(ladder))]))

    def row(k: int) -> DataFrame:
        name, columns = ladder[k]
        scored = held.where(F.col(f"_p{k}").isNotNull()).withColumn("_p", F.col(f"_p{k}"))
        both, arm = scored.where("_p0 is not null"), [F.lit(name).alias("arm"), F.lit(len(columns)).alias("n_inputs")]
        if kind == "rate":
            change = change_range(both, key, block, label, "_p0", "_p", draws)
            rho = checkpointed(metrics.spearman(scored, label, "_p").select("rho"))
            not_too_good(f"rank correlation of {name}", rho.first()["rho"], most_rho)
            m = metrics.error_summary(scored, label, "_p").select("n", "mae").crossJoin(rho)  # one row each
            own = ["n", "mae", "rho"]
        else:
            change = metrics.rank_bootstrap(both, block, label, "_p", "_p0", "ap", draws)
            m = scored.agg(F.count("_p").alias("n")).crossJoin(metrics.average_precision(scored, label, "_p"))  # one row each
            m = m.crossJoin(metrics.precision_at_k(scored, label, "_p", top, key).withColumnRenamed("precision", "top_precision"))  # one row each
            own = ["n", "ap", "top_precision"]
        return m.crossJoin(change.select(F.col("value").alias("change"), "low", "high")).select(*arm, *own, "change", "low", "high")  # one row each

    with ThreadPoolExecutor(len(ladder)) as pool:
        return reduce(DataFrame.unionAll, pool.map(side(row), range(len(ladder))))


def ablations(df: DataFrame, key: str, ladder: list[tuple[str, list[str]]], targets: dict[str, tuple[str, str]], block: str, fold: str = "fold", draws: int = 300, iterations: int = 30, top: int = 50, most_rho: float = LEAK_RHO) -> DataFrame:
    """The ladder for several labels (name to label and kind) side by side: a row for each arm, columns by name of label."""
    out, d = None, checkpointed(df.select(*dict.fromkeys([key, block, fold, *[label for label, _ in targets.values()], *[c for _, columns in ladder for c in columns]])))
    for name, (label, kind) in targets.items():
        one = ablation(d, key, ladder, label, kind, block, fold, draws, iterations, top, most_rho)
        one = one.select("arm", "n_inputs", *[F.col(c).alias(f"{name}_{c}") for c in one.columns if c not in ("arm", "n_inputs")])
        out = one if out is None else out.join(one.drop("n_inputs"), "arm")
    return out


def transfer_test(df: DataFrame, key: str, columns: list[str], plain: list[str], label: str, place: str, train: str, test: str, usable: Column, other: str, fold: str = "fold", iterations: int = 30) -> DataFrame:
    """Average precision of three methods, held out where they learn and moved to another place.

    Methods: a model of ``columns``, one of ``plain`` columns, and the given score ``other``. ``usable`` marks rows that
    were watched for the whole window. A row for each part and method: n and ap on its own rows, and on rows that all
    three score.
    """
    d = checkpointed(df.where(usable & F.col(label).isNotNull()))
    home, away = d.where(F.col(place) == train), d.where(F.col(place) == test)
    parts = []
    for part, rows in (("held out", home), ("moved", away)):
        scored = rows.select(key, label, F.col(other).alias("given score"))
        for name, inputs in (("model", columns), ("plain model", plain)):
            p = models.oof(home, key, inputs, [], label, "yes", fold, iterations=iterations) if part == "held out" else models.fit_predict(home, rows, key, inputs, [], label, "yes", iterations)
            scored = scored.join(p.select(key, F.col(p.columns[-1]).alias(name)), key, "left")
        scored = checkpointed(scored)
        common = reduce(lambda a, b: a & b, [F.col(f"`{m}`").isNotNull() for m in ("model", "plain model", "given score")])
        for m in ("model", "plain model", "given score"):
            s = scored.withColumn("_p", F.col(f"`{m}`")).withColumn("_c", common)
            n = s.agg(F.count("_p").alias("n"), F.count_if("_c").alias("n_common"))
            both = metrics.average_precision(s, label, "_p").crossJoin(metrics.average_precision(s.where("_c"), label, "_p").withColumnRenamed("ap", "ap_common"))  # one row each
            parts.append(n.crossJoin(both).select(F.lit(part).alias("part"), F.lit(m).alias("method"), "n", "ap", "n_common", "ap_common"))
    return reduce(DataFrame.unionAll, parts)
