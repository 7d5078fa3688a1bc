"""Metrics of predictions, by distinct score or by block, and their bootstrap ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridor.common import Refused, checkpointed
from corridor.operators.order_stats import quantiles, running_sums, same
from corridor.operators.ranking import drawn


def error_summary(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """n, mae, bias and exact quantiles of the absolute error over pairs with both values."""
    by = by or []
    e = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(*by, (F.col(p) - F.col(y)).alias("_e"))
    agg = [F.count("*").alias("n"), F.avg(F.abs("_e")).alias("mae"), F.avg("_e").alias("bias")]
    q = quantiles(e, by, {name: (F.abs("_e"), share) for name, share in (("p50", 0.5), ("p75", 0.75), ("p90", 0.9))})
    return same((e.groupBy(*by) if by else e).agg(*agg), q, by).select(*by, "n", "mae", "bias", "p50", "p75", "p90")


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with their average rank: rows before, plus half of those equal."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    return running_sums(counts, [F.col(value).asc()], ["n"]).select(value, (F.col("before_n") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks over pairs with both values; null where one is constant."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    grouped = both.groupBy("_a", "_b").agg(F.count("*").alias("_n"))
    for c in ("_a", "_b"):
        grouped = grouped.join(average_ranks(both, c).withColumnRenamed("rank", f"{c}_rank"), c)
    n, x, y = F.col("_n"), F.col("_a_rank"), F.col("_b_rank")
    s = grouped.agg(F.sum(n).alias("n"), F.sum(n * x).alias("x"), F.sum(n * y).alias("y"), F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"))
    cov = F.col("n") * F.col("xy") - F.col("x") * F.col("y")
    var = (F.col("n") * F.col("xx") - F.col("x") * F.col("x")) * (F.col("n") * F.col("yy") - F.col("y") * F.col("y"))
    return s.select("n", F.when(var > 0, cov / F.sqrt(var)).alias("rho"))


def average_precision(df: DataFrame, y: str, score: str, weight: str | None = None) -> DataFrame:
    """Step area under precision and recall, equal scores together; null where only one class is present."""
    w = F.col(weight) if weight else F.lit(1.0)
    counts = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("_s")).agg(F.sum(w * F.col(y)).alias("tp"), F.sum(w).alias("all"))
    run = running_sums(counts, [F.col("_s").desc()], ["tp", "all"])
    precision = (F.col("before_tp") + F.col("tp")) / (F.col("before_all") + F.col("all"))
    out = run.agg(F.sum(F.col("tp") * precision).alias("_a"), F.sum("tp").alias("_t"), F.sum("all").alias("_n"))
    return out.select(F.when((F.col("_t") > 0) & (F.col("_t") < F.col("_n")), F.col("_a") / F.col("_t")).alias("ap"))


def precision_at_k(df: DataFrame, y: str, score: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.col(score).desc_nulls_last(), tie).limit(k).agg(F.avg(F.col(y).cast("double")).alias("precision"))


def binary_score(df: DataFrame, y: str, p: str, cut: float, by: list[str] | None = None) -> DataFrame:
    """Precision and recall at a cut; null where nothing is predicted or present."""
    hit = F.count_if((F.col(p) >= cut) & (F.col(y) == 1))
    agg = [(hit / F.nullif(F.count_if(F.col(p) >= cut), F.lit(0))).alias("precision"), (hit / F.nullif(F.count_if(F.col(y) == 1), F.lit(0))).alias("recall"), F.count("*").alias("n")]
    return (df.groupBy(*by) if by else df).agg(*agg)


def flood_score(df: DataFrame, y_cm: str, p: str, depth_cm: str, flooded: float = 2.0, by: list[str] | None = None) -> DataFrame:
    """n, n_flooded, precision and recall at one half, and mean depth errors, of all and of flooded rows (null without any).

    Precision is 0 where nothing is called flooded, and recall where nothing is.
    """
    wet, hit = F.col(y_cm) >= flooded, F.col(p) >= 0.5
    miss = F.abs(F.col(depth_cm) - F.col(y_cm))
    both, one = F.count_if(wet & hit), F.lit(1)
    agg = [
        F.count("*").alias("n"), F.count_if(wet).alias("n_flooded"), (both / F.greatest(F.count_if(hit), one)).alias("precision"), (both / F.greatest(F.count_if(wet), one)).alias("recall"),
        F.avg(miss).alias("depth_mae"), F.avg(F.when(wet, miss)).alias("depth_mae_flooded"),
    ]
    return (df.groupBy(*by) if by else df).agg(*agg)


def mae_by_fold(df: DataFrame, y: str, p: str, fold: str) -> DataFrame:
    """fold and m, the mean absolute error of its rows with both values, null where it has none."""
    return df.groupBy(fold).agg(F.avg(F.abs(F.col(y) - F.col(p))).alias("m"))


def paired_diff(a: DataFrame, b: DataFrame, fold: str) -> DataFrame:
    """One row: the mean over folds of a's metric less b's, and folds up and down; folds where either is null are left out."""
    d = a.select(fold, F.col("m").alias("_a")).join(b.select(fold, F.col("m").alias("_b")), fold).select((F.col("_a") - F.col("_b")).alias("d"))
    return d.agg(F.avg("d").alias("mean"), F.count_if(F.col("d") > 0).alias("folds_up"), F.count_if(F.col("d") < 0).alias("folds_down"))


# Fewest blocks of a range that says something; how near chance a control with shuffled labels must be.
LEAST_BLOCKS, CHANCE_SPEARMAN, CHANCE_AP = 30, 0.05, 0.02


def verdict(ranges: DataFrame, spread: Column | None = None, need_spread: bool = False) -> DataFrame:
    """``ranges`` (value, low, high, n_blocks) with real: the range leaves out 0, and the value is over the seeds' spread.

    Too few blocks or no range make nothing real, nor does a missing spread where one is needed.
    """
    clear = F.coalesce((F.col("n_blocks") >= LEAST_BLOCKS) & ((F.col("low") > 0) | (F.col("high") < 0)), F.lit(False))
    s = F.lit(None).cast("double") if spread is None else spread
    return ranges.withColumn("real", clear & F.when(s.isNull(), F.lit(not need_spread)).otherwise(F.abs("value") > s))


def seed_spread(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The greatest gap of runs that differ in their seed alone; null where there is one run."""
    return df.groupBy(*by).agg(F.when(F.count(value) >= 2, F.max(value) - F.min(value)).alias("spread"))


def at_chance(rho: Column, ap: Column, prevalence: Column) -> Column:
    return F.coalesce((F.abs(rho) < CHANCE_SPEARMAN) & (F.abs(ap - prevalence) < CHANCE_AP), F.lit(False))


def lift(df: DataFrame, fifth: str, events: str, exposure: str, k: int = 5) -> DataFrame:
    """Events per exposure in the worst part over the best; null where either has none."""
    rate = [F.sum(F.when(F.col(fifth) == f, F.col(events))) / F.nullif(F.sum(F.when(F.col(fifth) == f, F.col(exposure))), F.lit(0)) for f in (1, k)]
    return df.agg((rate[0] / F.nullif(rate[1], F.lit(0))).alias("lift"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Raw agreement and kappa of two passes."""
    pairs = df.groupBy(a, b).agg(F.count("*").alias("n"))
    left = pairs.groupBy(F.col(a).alias("c")).agg(F.sum("n").alias("l"))
    right = pairs.groupBy(F.col(b).alias("c")).agg(F.sum("n").alias("r"))
    chance = left.join(right, "c").agg(F.coalesce(F.sum(F.col("l").cast("double") * F.col("r")), F.lit(0.0)).alias("e"))
    got = pairs.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col(a) == F.col(b), F.col("n"))), F.lit(0)).alias("s"))
    out = got.crossJoin(chance)  # one row each
    po, pe = F.col("s") / F.col("n"), F.col("e") / (F.col("n").cast("double") * F.col("n"))
    return out.select(po.alias("agreement"), ((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def _draws(totals: DataFrame, block: str, draws: int, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """Blocks with their number _k by name; how often (count) draw _d takes each; and how many blocks there are.

    Slot s of draw d takes block number hash(seed, d, s) modulo their count.
    """
    numbered = totals.withColumn("_k", F.row_number().over(Window.orderBy(block)) - 1)  # blocks are few: thousands at most
    n = totals.count()
    slots = totals.sparkSession.range(draws).select(F.col("id").alias("_d")).withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))))
    return numbered, slots.groupBy("_d", drawn(F.lit(max(n, 1)), seed, F.col("_d"), F.col("_slot")).alias("_k")).count(), n


def block_bootstrap(df: DataFrame, block: str, a: str, b: str, draws: int, seed: int = 42) -> DataFrame:
    """value, sum(a)/sum(b) over all rows, n_blocks, and low and high, its 2.5 and 97.5 percentiles over draws of whole blocks with replacement.

    Blocks are summed once; the work of the draws is draws times blocks small rows, whatever the rows.
    """
    totals = checkpointed(df.groupBy(block).agg(F.sum(a).alias("_a"), F.sum(b).alias("_b")))
    numbered, slots, _ = _draws(totals, block, draws, seed)
    each = slots.join(numbered, "_k").groupBy("_d").agg((F.sum(F.col("_a") * F.col("count")) / F.nullif(F.sum(F.col("_b") * F.col("count")), F.lit(0))).alias("m"))
    point = totals.agg((F.sum("_a") / F.nullif(F.sum("_b"), F.lit(0))).alias("value"), F.count("*").alias("n_blocks"))
    return point.crossJoin(_range_of(each)).select("value", "low", "high", "draws", "n_blocks")  # one row each


def _range_of(each: DataFrame) -> DataFrame:
    """One row: draws that have a value m, and its 2.5 and 97.5 percentiles over them; draws are few."""
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return each.agg(F.count("m").alias("draws"), q.alias("_q")).select("draws", F.get("_q", 0).alias("low"), F.get("_q", 1).alias("high"))


#: Cells of the table of blocks by draws that tasks hold, at most (4 bytes each).
MOST_CELLS = 1 << 26
#: Values whose running sums of all draws are held at once.
AT_ONCE = 256


def _weights(df: DataFrame, block: str, draws: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """The blocks of ``df`` with their number _k, and how often each draw takes each: a row a block, a column a draw, the
    first column being all rows once."""
    blocks = checkpointed(df.select(block).distinct())
    numbered, slots, n = _draws(blocks, block, draws, seed)
    if n * (draws + 1) > MOST_CELLS:
        raise Refused(f"{n} blocks by {draws} draws: draw fewer, or larger blocks")
    out = np.zeros((n, draws + 1), np.int32)
    out[:, 0] = 1
    for d, k, count in slots.collect() if n else []:  # as many as the cells, at most
        out[k, d + 1] = count
    return numbered, out


def _by_value(rows: DataFrame, value: str, order: Column, sums: list[str]) -> DataFrame:
    """Distinct values with c, what each block has of the sums there, dealt and sorted by ranges of ``order``; before each
    range a row with what the blocks have in the ranges before it. Columns: _p, first, value, c."""
    counts = rows.groupBy(F.col(value).cast("double").alias("value"), "_k").agg(*[F.sum(s).cast("double").alias(s) for s in sums])
    cell = F.struct("_k", *sums)
    placed = counts.groupBy("value").agg(F.collect_list(cell).alias("c"))  # an entry a block, at most
    placed = checkpointed(placed.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()))
    parts = placed.select("_p", F.explode("c").alias("e")).groupBy("_p", "e._k").agg(*[F.sum(f"e.{s}").alias(s) for s in sums])
    ranges = F.explode(F.sequence(F.lit(0), F.lit(max(placed.rdd.getNumPartitions() - 1, 0))))
    parts = parts.select("_k").distinct().withColumn("_p", ranges).join(parts, ["_k", "_p"], "left")  # a row for each range and block
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({s: F.sum(s).over(before) for s in sums}).where(F.col(sums[-1]) > 0)
    head = parts.groupBy("_p").agg(F.collect_list(cell).alias("c")).select("_p", F.lit(True).alias("first"), F.lit(None).cast("double").alias("value"), "c")
    every = head.unionByName(placed.select("_p", F.lit(False).alias("first"), "value", "c"))
    return every.repartition(F.col("_p")).sortWithinPartitions("_p", F.desc("first"), order).select("_p", "first", "value", "c")


def _cells(b: pa.RecordBatch, weights: np.ndarray, sums: list[str]) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """For AT_ONCE rows of ``b`` at a time: their place, and of each of the sums its rows by draws."""
    c = b.column(3)
    at = c.offsets.to_numpy()
    k = c.values.field("_k").to_numpy(zero_copy_only=False)
    parts = [c.values.field(s).to_numpy(zero_copy_only=False) for s in sums]
    for low in range(0, b.num_rows, AT_ONCE):
        high = min(low + AT_ONCE, b.num_rows)
        span = slice(at[low], at[high])
        w = weights[k[span]]
        yield slice(low, high), [np.add.reduceat(p[span, None] * w, at[low:high] - at[low], axis=0) for p in parts]


def _drawn_precision(rows: DataFrame, score: str, weights) -> DataFrame:
    """_d (-1 for all rows once) and m, the average precision of each draw; rows: _k, tp, n and the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        part, upto = None, np.zeros((2, w.shape[1]))
        area, total = np.zeros(w.shape[1]), np.zeros((2, w.shape[1]))
        for b in batches:
            ps, first = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            for span, (tp, n) in _cells(b, w, ["tp", "n"]):
                for i in range(span.stop - span.start):
                    if ps[span.start + i] != part:
                        part, upto = ps[span.start + i], np.zeros((2, w.shape[1]))
                    upto += (tp[i], n[i])
                    if not first[span.start + i]:
                        total += (tp[i], n[i])
                        area += np.divide(tp[i] * upto[0], upto[1], out=np.zeros(w.shape[1]), where=upto[1] > 0)
        d = np.arange(w.shape[1]) - 1
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(area), pa.array(total[0]), pa.array(total[1])], ["_d", "area", "tp", "n"])

    placed = _by_value(rows, score, F.col("value").desc(), ["tp", "n"])
    each = placed.mapInArrow(run, "_d long, area double, tp double, n double").groupBy("_d").agg(*[F.sum(c).alias(c) for c in ("area", "tp", "n")])
    return each.select("_d", F.when((F.col("tp") > 0) & (F.col("tp") < F.col("n")), F.col("area") / F.col("tp")).alias("m"))


def _drawn_ranks(rows: DataFrame, value: str, weights) -> DataFrame:
    """Distinct values with ranks: the average rank of the value in each draw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        part, upto = None, np.zeros(w.shape[1])
        for b in batches:
            ps, first, values = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_pylist()
            for span, (n,) in _cells(b, w, ["n"]):
                said, ranks = [], []
                for i in range(span.stop - span.start):
                    if ps[span.start + i] != part:
                        part, upto = ps[span.start + i], np.zeros(w.shape[1])
                    if not first[span.start + i]:
                        said.append(values[span.start + i])
                        ranks.append(upto + (n[i] + 1) / 2)
                    upto = upto + n[i]
                flat = pa.array(np.concatenate(ranks) if ranks else np.zeros(0))
                ends = pa.array(np.arange(len(ranks) + 1, dtype=np.int32) * w.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(said, pa.float64()), pa.ListArray.from_arrays(ends, flat)], ["value", "ranks"])

    return _by_value(rows, value, F.col("value").asc(), ["n"]).mapInArrow(run, "value double, ranks array<double>")


def _drawn_spearman(rows: DataFrame, y: str, p: str, weights) -> DataFrame:
    """_d and m, the correlation of average ranks of each draw; null where one is constant."""
    counts = rows.groupBy(F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_x"), "_k").agg(F.sum("n").cast("double").alias("n"))
    for c, source in (("_y", y), ("_x", p)):
        ranks = _drawn_ranks(rows, source, weights)
        counts = counts.join(ranks.withColumnsRenamed({"value": c, "ranks": f"{c}_ranks"}), c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        size = w.shape[1]
        sums = np.zeros((6, size))
        for b in batches:
            for low in range(0, b.num_rows, AT_ONCE):
                cut = b.slice(low, AT_ONCE)
                n = cut.column(1).to_numpy()[:, None] * w[cut.column(0).to_numpy()]
                x, yy = (cut.column(k).flatten().to_numpy().reshape(-1, size) for k in (2, 3))
                sums += np.stack([s.sum(0) for s in (n, n * x, n * yy, n * x * yy, n * x * x, n * yy * yy)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size) - 1), *map(pa.array, sums)], ["_d", "n", "x", "y", "xy", "xx", "yy"])

    sums = counts.select("_k", "n", "_x_ranks", "_y_ranks").mapInArrow(run, "_d long, n double, x double, y double, xy double, xx double, yy double")
    s = sums.groupBy("_d").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xy", "xx", "yy")])
    cov = F.col("n") * F.col("xy") - F.col("x") * F.col("y")
    vx, vy = (F.col("n") * F.col(f"{c}{c}") - F.col(c) * F.col(c) for c in "xy")
    flat = (vx <= 1e-9 * F.col("n") * F.col("xx")) | (vy <= 1e-9 * F.col("n") * F.col("yy"))  # equal ranks up to rounding
    return s.select("_d", F.when(~flat, cov / F.sqrt(vx) / F.sqrt(vy)).alias("m"))


def rank_bootstrap(df: DataFrame, block: str, y: str, a: str, b: str | None, metric: str, draws: int, seed: int = 42) -> DataFrame:
    """value, the metric of ``a`` (less that of ``b``, if given) over rows with all of them, with low, high, draws and n_blocks.

    metric: ``ap`` (y is 0 or 1) or ``rho``. The range is of draws of whole blocks with replacement, the same draws as
    block_bootstrap's; a draw without a value counts nowhere. No row is drawn again: rows are counted by distinct value
    and block, dealt by ranges of the value, and the running sums of all draws go over the counts at once, each block's
    weighted with how often a draw takes it. So the counts move once, and the work is values times draws.
    """
    given = [y, a, *([b] if b else [])]
    rows = df.where(F.concat(*[F.col(c).cast("string") for c in (block, *given)]).isNotNull()).select(block, *[F.col(c).cast("double").alias(c) for c in given])
    numbered, table = _weights(rows, block, draws, seed)
    rows = checkpointed(rows.join(F.broadcast(numbered), block).select("_k", *given, F.lit(1).alias("n"), F.col(y).alias("tp")))  # few: cells are bounded
    weights = df.sparkSession.sparkContext.broadcast(table)
    score = (lambda c: _drawn_precision(rows, c, weights)) if metric == "ap" else (lambda c: _drawn_spearman(rows, y, c, weights))
    each = score(a)
    if b:
        each = each.join(score(b).withColumnRenamed("m", "_b"), "_d").select("_d", (F.col("m") - F.col("_b")).alias("m"))
    each = checkpointed(each)
    point = each.agg(F.max(F.when(F.col("_d") == -1, F.col("m"))).alias("value"), F.lit(len(table)).cast("long").alias("n_blocks"))
    return point.crossJoin(_range_of(each.where("_d >= 0"))).select("value", "low", "high", "draws", "n_blocks")  # one row each
