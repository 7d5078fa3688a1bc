"""Ranks, thirds and fifths, top lists, pages, histograms, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridor.common import checkpointed
from corridor.functions.keys import parse_seg_id, route_label


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1 for the first row of a total order, without one task that holds every row.

    Rows are dealt by ranges of the order and sorted; each adds the sizes of the partitions before its own. There is a
    row for each partition in the small side.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = checkpointed(placed)
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_p")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_p", before.alias("_before"))
    return placed.join(F.broadcast(sizes), part == F.col("_p")).withColumn(name, (F.col("_before") + at + 1).cast("long")).drop("_id", "_p", "_before")


#: Groups whose sizes every task may hold; of more, rows go to their group's size by a shuffle.
FEW_GROUPS = 50_000


def ntile_by_rank(df: DataFrame, score: str, k: int, group: list[str], tie: str, least: int, name: str) -> DataFrame:
    """Rows with a score and their part of the group, ceil(k * rank / n) by score, then ``tie``; 0 in groups under ``least``.

    Ranks run over ranges of all groups together, so a group of any size is many tasks; so it is where few groups' sizes
    come beside their rows, which are not dealt by group then.
    """
    known = global_rank(df.where(F.col(score).isNotNull()), [F.asc(c) for c in (*group, score, tie)], "_r")
    sizes = known.groupBy(*group).agg(F.min("_r").alias("_first"), F.count("*").alias("_n"))
    sizes = sizes.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_first", "_n")
    sizes = checkpointed(sizes)
    sizes = F.broadcast(sizes) if sizes.count() <= FEW_GROUPS else sizes
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]  # a null group is a group
    part = F.ceil(k * (F.col("_r") - F.col("_first") + 1) / F.col("_n"))
    out = known.join(sizes, same).withColumn(name, F.when(F.col("_n") < least, 0).otherwise(part).cast("int"))
    return out.drop("_r", "_first", "_n", *[f"_g{i}" for i in range(len(group))])


def traffic_band(df: DataFrame, traffic: str, city: str, tie: str, name: str = "band") -> DataFrame:
    """``df`` with t1 to t3, the third of a row's traffic within its city by rank, and ``none`` where either is blank."""
    known = F.col(traffic).isNotNull() & F.col(city).isNotNull()
    thirds = ntile_by_rank(df.where(known), traffic, 3, [city], tie, 0, "_third")
    banded = thirds.withColumn(name, F.concat(F.lit("t"), F.col("_third"))).drop("_third")
    return banded.unionByName(df.where(~known).withColumn(name, F.lit("none")))


def cut_by_quantiles(df: DataFrame, score: str, k: int, name: str, accuracy: int = 10_000) -> DataFrame:
    """Like ntile over one large group, by approximate cuts: no task sorts it all. Null scores get null."""
    cuts = df.agg(F.percentile_approx(score, [i / k for i in range(1, k)], accuracy).alias("_cuts"))
    at = F.size(F.filter("_cuts", lambda c: F.col(score) > c)) + 1
    return df.crossJoin(F.broadcast(cuts)).withColumn(name, F.when(F.col(score).isNotNull(), at)).drop("_cuts")  # one row of cuts


def dedup_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``; ties by all columns. Copies meet on the map side first."""
    rest = [c for c in df.columns if c not in key and c not in order]
    return df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("m")).select(*key, "m.*").select(df.columns)


#: Rows of a page, at most.
MOST_ROWS = 500


def worklist(df: DataFrame, sort: str, descending: bool, limit: int, offset: int, allowed: tuple[str, ...], tie: str = "seg_id", where: dict[str, object] | None = None) -> DataFrame:
    """A page of a list by one of the allowed columns, blanks last either way, ties by id; MOST_ROWS rows at most.

    ``where`` holds values that columns must have; a null value asks for nothing.
    """
    if sort not in allowed:
        raise ValueError(f"sort must be one of {allowed}")
    if limit < 1 or offset < 0:
        raise ValueError("limit must be at least 1 and offset at least 0")
    c = F.col(sort)
    return having(df, where).orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), tie).offset(offset).limit(min(limit, MOST_ROWS))


def having(df: DataFrame, where: dict[str, object] | None) -> DataFrame:
    for name, value in (where or {}).items():
        df = df if value is None else df.where(F.col(name) == F.lit(value))
    return df


def worklist_page(df: DataFrame, sort: str, descending: bool, limit: int, offset: int, allowed: tuple[str, ...], tie: str = "seg_id", where: dict[str, object] | None = None) -> DataFrame:
    """The page with its rows' place (from 1) and the total of all rows that ``where`` lets through, the page's own or not."""
    page = worklist(df, sort, descending, limit, offset, allowed, tie, where)
    c = F.col(sort)
    place = F.row_number().over(Window.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), tie))  # MOST_ROWS rows
    total = having(df, where).agg(F.count("*").alias("total"))
    return page.withColumn("place", (place + offset).cast("long")).crossJoin(F.broadcast(total))  # one row


#: How the queue sorts, worst first: the column, and whether more is worse.
QUEUE_SORTS = {"score": ("score", True), "ytp": ("years", False), "crack": ("crack", True), "flood": ("flood", True), "rating": ("rating", False), "aadt": ("traffic", True), "cost": ("cost", True)}


def queue_sort(df: DataFrame, key: str, flip: bool, n: int, tie: str = "seg_id") -> DataFrame:
    """The first ``n`` rows (score, years, crack, flood, in_zone, rating, traffic, cost) worst first, or best first if flipped.

    Blanks stay last either way; a flood score outside the zone and a cost of 0 are blanks.
    """
    name, more_is_worse = QUEUE_SORTS[key]
    v = {"flood": F.when(F.col("in_zone"), F.col("flood")), "cost": F.when(F.col("cost") > 0, F.col("cost"))}.get(name, F.col(name))
    return df.orderBy(v.desc_nulls_last() if more_is_worse != flip else v.asc_nulls_last(), tie).limit(n)


#: The bit of heldout_bits that a mode asks for.
HELDOUT_BIT = {"years": 1, "crack": 2, "flood": 4}


def queue_filter(df: DataFrame, mode: str, tiers: tuple[int, ...] = (), min_crack: float = 0.0, zone_only: bool = False, heldout_only: bool = False, classes: tuple[str, ...] = (), county: int | None = None, route: str | None = None) -> DataFrame:
    """Rows (seg_id, tier, crack, in_zone, heldout bits) that pass every filter set; held out means by the mode's own model."""
    p = parse_seg_id(F.col("seg_id"))
    tests = [F.col("crack") >= min_crack]
    tests += [F.col("tier").isin(*tiers)] if tiers else []
    tests += [F.col("in_zone")] if zone_only else []
    tests += [F.col("heldout").bitwiseAND(F.lit(HELDOUT_BIT[mode])) > 0] if heldout_only else []
    tests += [p["class"].isin(*classes)] if classes else []
    tests += [p["county"] == county] if county is not None else []
    tests += [route_label(F.col("seg_id")) == route] if route is not None else []
    for t in tests:
        df = df.where(t)
    return df


def keyset_page(df: DataFrame, key: str, after: str | None, size: int) -> DataFrame:
    return (df.where(F.col(key) > after) if after is not None else df).orderBy(key).limit(size)


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int, name: str = "place") -> DataFrame:
    """The feature is a top-n report; Spark keeps n rows of a group on each side of the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(name) <= n)


def overview(df: DataFrame, tier: str, order: list[Column], n: int, storm: list[Column], in_zone: Column, n_storm: int, key: str = "seg_id") -> DataFrame:
    """The best ``n`` rows of each tier and the ``n_storm`` first of the zone by another order, each row once."""
    best = top_per_group(df, tier, order, n).select(key)
    listed = df.where(in_zone).orderBy(*storm).limit(n_storm).select(key)
    return df.join(best.union(listed).distinct(), key, "left_semi")


def histogram(df: DataFrame, value: str, step: float, top: float, at_most: bool = True) -> DataFrame:
    """Dense bins 0..top/step: bins closed above (at_most) or below, so that thresholds at multiples count exactly."""
    n = round(top / step)
    at = F.ceil(F.col(value) / step - 1e-9) if at_most else F.floor(F.col(value) / step + 1e-9)
    counts = df.where(F.col(value).isNotNull()).groupBy(F.least(F.greatest(at, F.lit(0)), F.lit(n)).cast("long").alias("bin")).count()
    return df.sparkSession.range(n + 1).withColumnRenamed("id", "bin").join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("n"))


def count_at_most(hist: Column, step: float, x: float) -> Column:
    """How many values are at most x, from dense closed-above counts."""
    return F.aggregate(F.slice(hist, F.lit(1), F.lit(int(x / step + 1e-9) + 1)), F.lit(0).cast("long"), lambda a, b: a + b)


def count_at_least(hist: Column, step: float, x: float) -> Column:
    """How many values are at least x, from dense closed-below counts."""
    k = int(x / step + 1 - 1e-9)
    return F.aggregate(F.slice(hist, F.lit(k + 1), F.greatest(F.size(hist) - k, F.lit(0))), F.lit(0).cast("long"), lambda a, b: a + b)


def draw(seed: int, key: Column) -> Column:
    """A hash of seed and key to order draws by, that any engine can compute."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def drawn(n: Column, *parts: Column | int | str) -> Column:
    """A whole number from 0 to n - 1 by a hash of the parts, the same in any engine."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"), n)


def reproducible_sample(df: DataFrame, key: str, n: int, seed: int, exclude: DataFrame | None = None) -> DataFrame:
    """n rows by a hash of the key and seed: the same whatever the partitions. Keys of ``exclude`` are not drawn."""
    left = df if exclude is None else df.join(exclude.select(key), key, "left_anti")
    return left.orderBy(draw(seed, F.col(key)), key).limit(n)


def repeat_set(sample: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows of a sample drawn again, with repeat_index from 0 in another order than the sample's, to be graded twice."""
    again = reproducible_sample(sample, key, n, seed + 1)
    at = F.row_number().over(Window.orderBy(draw(seed + 2, F.col(key)), key)) - 1  # n rows
    return again.withColumn("repeat_index", at.cast("int"))


def percent_top(df: DataFrame, value: str, x: float) -> DataFrame:
    return df.agg(F.avg((F.col(value) >= x).cast("double")).alias("share"))


def pair_min(value: Column, neighbours) -> Column:
    """The lesser of a value and the next one of its window; null for the last, which has none."""
    after = F.lead(value).over(neighbours)
    return F.when(after.isNotNull(), F.least(value, after))


def round_robin(df: DataFrame, host: str, key: str) -> DataFrame:
    """The place of each row within its host: ordering by it interleaves the hosts."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(host).orderBy(key)))
