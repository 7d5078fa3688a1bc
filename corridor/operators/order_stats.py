"""Running sums over an order and exact quantiles by rank, without a task that holds all values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridor.common import checkpointed


def running_sums(counts: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """``counts`` with before_<column>: sums of the rows before each in an order of distinct values.

    Rows are dealt by ranges of the order; sums run within a range and then over the ranges, a row for each of them.
    """
    placed = checkpointed(counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_p").agg(*[F.sum(c).alias(c) for c in columns])
    over = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_p", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"_{c}") for c in columns])
    out = placed.join(F.broadcast(parts), "_p")
    return out.withColumns({f"before_{c}": F.col(f"_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns}).drop("_p", *[f"_{c}" for c in columns])


def same(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` on equal ``by``, nulls being equal; one row each where ``by`` is empty."""
    if not by:
        return a.crossJoin(b)  # one row each
    b = b.withColumnsRenamed({c: f"_by_{c}" for c in by})
    return a.join(b, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], how).drop(*[f"_by_{c}" for c in by])


def quantiles(df: DataFrame, by: list[str], asked: dict[str, tuple[Column, float]]) -> DataFrame:
    """``by`` and each asked quantile (name to value and share), interpolated between the two ranks around it.

    A row for each group that has a value of any; one row, of nulls where there is none, without ``by``. All values of all
    groups are counted, ordered by ranges once, and the asked ranks picked out of the ranges: neither a group of any size
    nor the whole table is one task's, as it is with a percentile that merges every distinct value.
    """
    texts = list(dict.fromkeys(str(c) for c, _ in asked.values()))
    columns = {str(c): c for c, _ in asked.values()}
    each = F.array(*[F.struct(F.lit(k).alias("_of"), columns[t].cast("double").alias("_v")) for k, t in enumerate(texts)])
    counts = df.select(*by, F.explode(each).alias("_e")).select(*by, "_e.*").where("_v is not null").groupBy(*by, "_of", "_v").agg(F.count("*").alias("n"))
    run = running_sums(counts, [*map(F.asc, by), F.asc("_of"), F.asc("_v")], ["n"])
    groups = run.groupBy(*by, "_of").agg(F.min("before_n").alias("_first"), F.sum("n").alias("_total"))
    run = same(run, groups, [*by, "_of"]).withColumn("_before", F.col("before_n") - F.col("_first"))
    picks, out = [], []
    for name, (c, share) in asked.items():
        own, at = F.col("_of") == texts.index(str(c)), (F.col("_total") - 1) * F.lit(float(share))
        for k, rank in enumerate((F.floor(at), F.ceil(at))):
            held = own & (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("n"))
            picks.append(F.max(F.when(held, F.col("_v"))).alias(f"_{name}_{k}"))
        picks.append(F.max(F.when(own, at - F.floor(at))).alias(f"_{name}_at"))
        part = F.col(f"_{name}_at")
        out.append(((1 - part) * F.col(f"_{name}_0") + part * F.col(f"_{name}_1")).alias(name))
    return (run.groupBy(*by) if by else run).agg(*picks).select(*by, *out)
