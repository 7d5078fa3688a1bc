"""Runs of marks along a line: each starts at the first mark that is far enough from where the run before it started."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridor.common import checkpointed

KEY = ["stream", "_chain"]
FAN = 16


def _farthest(box: Column) -> Column:
    """From (x, y) to the farthest corner of a box; of a single mark's box it is the distance to that mark."""
    side = lambda v: F.greatest(F.abs(F.col(v) - box[f"{v}1"]), F.abs(F.col(v) - box[f"{v}2"]))
    return F.hypot(side("x"), side("y"))


def _next_far(dense: DataFrame, merge: float) -> DataFrame:
    """stream, _chain, _r and to: the first later place of the chain that is ``merge`` or more away, where there is one.

    Blocks of 1, FAN, FAN * FAN, ... places have their bounds, FAN of them to a row; a place passes whole blocks that are
    near it and goes into those that may not be. All places that still look go on at once, a join a round: no mark meets
    every other.
    """
    top, most = 0, dense.agg(F.max("_r")).first()[0] or 0
    while FAN ** (top + 1) <= most:
        top += 1
    size = lambda level: F.pow(F.lit(FAN), level).cast("long")
    each = dense.select(*KEY, "_r", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("_l"))
    each = each.groupBy(*KEY, "_l", F.floor(F.col("_r") / size(F.col("_l"))).alias("b")).agg(*[f(c).alias(f"{c}{k}") for c in ("x", "y") for k, f in ((1, F.min), (2, F.max))])
    blocks = each.groupBy(*KEY, "_l", F.floor(F.col("b") / FAN).alias("_g")).agg(F.array_sort(F.collect_list(F.struct("b", "x1", "x2", "y1", "y2"))).alias("_boxes"))
    blocks = checkpointed(blocks)
    looking = dense.select(*KEY, "_r", "x", "y", (F.col("_r") + 1).alias("_p"), F.lit(0).alias("_l"))
    found, level = [], F.col("_l")
    while True:
        at = looking.withColumn("_g", F.floor(F.col("_p") / size(level + 1))).join(blocks, [*KEY, "_l", "_g"])  # past the end there are none
        ahead = F.filter("_boxes", lambda e: (e["b"] * size(level) >= F.col("_p")) & F.coalesce(_farthest(e) >= merge, F.lit(False)))
        at = at.select(*KEY, "_r", "x", "y", "_l", "_g", F.get(ahead, 0)["b"].alias("_b")).where(F.col("_b").isNotNull() | (level < top))
        on, into = (F.col("_g") + 1) * size(level + 1), F.col("_b") * size(level)
        at = checkpointed(at.select(*KEY, "_r", "x", "y", F.coalesce(into, on).alias("_p"), F.when(F.col("_b").isNotNull(), level - 1).otherwise(level + 1).alias("_l")))
        found.append(at.where("_l < 0").select(*KEY, "_r", F.col("_p").alias("to")))
        looking = at.where("_l >= 0")
        if looking.isEmpty():
            break
    return checkpointed(reduce(DataFrame.unionAll, found))


def _reached(jumps: DataFrame) -> DataFrame:
    """stream, _chain, _r of the places that jumps lead to from a chain's first: every round doubles the jumps' length."""
    start = reached = checkpointed(jumps.where("_r = 0").select(*KEY, "_r").distinct())
    while not jumps.isEmpty():
        new = reached.join(jumps, [*KEY, "_r"]).select(*KEY, F.col("to").alias("_r"))
        reached = checkpointed(reached.unionAll(new).distinct())
        onward = jumps.select(*KEY, F.col("_r").alias("to"), F.col("to").alias("_end"))
        jumps = checkpointed(jumps.join(onward, [*KEY, "to"]).select(*KEY, "_r", F.col("_end").alias("to")))
    return reached.join(start, [*KEY, "_r"], "left_anti")


def run_places(marks: DataFrame, merge: float = 1.0) -> DataFrame:
    """``marks`` (stream, mark, order_key, x, y) with k, the place of their run along the stream (long, from 0).

    Marks go by order_key and then mark. A run starts where a mark lies ``merge`` metres or more from the first of the run
    before; a mark without x or y starts none but its stream's first. A mark twice that far from the one before it starts a
    run whatever came earlier, so chains between such marks stand alone. In a chain every place finds its next far one, and
    doubled jumps from the first find all starts: rounds grow with the logarithm of a chain, and no task folds a stream.
    """
    w = Window.partitionBy("stream").orderBy("order_key", "mark")
    gap = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    sure = (F.row_number().over(w) == 1) | F.coalesce(gap >= 2 * merge, F.lit(False))
    chained = marks.withColumn("_sure", sure).withColumn("_chain", F.sum(F.col("_sure").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    placed = chained.withColumn("_r", F.row_number().over(Window.partitionBy(*KEY).orderBy("order_key", "mark")).cast("long") - 1)
    placed = checkpointed(placed.withColumn("_alone", F.col("_sure") & (F.coalesce(F.lead("_chain").over(w), F.lit(-1)) != F.col("_chain"))))
    starts = F.col("_sure").cast("long")
    dense = placed.where(~F.col("_alone"))
    if not dense.isEmpty():
        dense = dense.select(*KEY, "_r", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        found = _reached(_next_far(dense, merge)).withColumn("_start", F.lit(1).cast("long"))
        by = F.struct("_chain", "_r")
        placed = placed.join(found.withColumnsRenamed({c: f"_f{c}" for c in [*KEY, "_r"]}), F.col("stream").eqNullSafe(F.col("_fstream")) & (by == F.struct("_f_chain", "_f_r")), "left")
        starts = F.greatest(starts, F.coalesce("_start", F.lit(0)))
    k = F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return placed.withColumn("k", k).select(*marks.columns, "k")
