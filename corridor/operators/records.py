"""Answers of the road service: one road's record, totals, tables by county and route, labels from reports, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.common import Refused
from corridor.functions.keys import SEG_ID, parse_seg_id, record_json, route_label
from corridor.functions.measures import exposure_years, repair_bucket
from corridor.operators.order_stats import quantiles
from corridor.operators.ranking import global_rank

BUCKETS = ("fix_now", "1y", "5y", "later", "unknown")
# How far a report may be from its road, and since when reports are collected, by source; metres of a mile.
REACH_M, WINDOW_START, MILE = {"charlotte": 60, "raleigh": 30}, {"charlotte": "2023-01-01", "raleigh": "2025-06-18"}, 1609.344


def by_source(source: Column, values: dict) -> Column:
    """A value for each source, null for others."""
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(source == name, F.lit(value)).otherwise(out)
    return out


# totals


def summary(roads: DataFrame) -> DataFrame:
    """One row over roads (years, len, in_zone, heldout bits, cost): counts, sums, every bucket's count, what is to fix now costs.

    fix_now_cost is null where no such road has an estimate; fix_now_unknown counts those without.
    """
    bucket = repair_bucket(F.col("years"))
    now = bucket == "fix_now"
    return roads.agg(
        F.count("*").alias("n"), F.sum("len").alias("length"), F.count_if("in_zone").alias("in_zone"), F.sum(F.when(F.col("in_zone"), F.col("len"))).alias("zone_length"),
        *[F.count_if(F.col("heldout").bitwiseAND(F.lit(b)) > 0).alias(f"heldout_{name}") for b, name in ((1, "rate"), (2, "crack"), (4, "flood"))],
        F.sum(F.when(now, F.col("cost"))).alias("fix_now_cost"), F.count_if(now & F.col("cost").isNull()).alias("fix_now_unknown"),
        *[F.count_if(bucket == b).alias(f"n_{b}") for b in BUCKETS],
    )


def state_stats(roads: DataFrame) -> DataFrame:
    """Medians, mean years with those under 0 as 0, and counts of roads with and without a held-out value, and of zone roads."""
    q = quantiles(roads, [], {"median_rating": (F.col("rating"), 0.5), "median_years": (F.col("years"), 0.5)})
    counts = roads.agg(
        F.count("*").alias("n"), F.avg(F.greatest("years", F.lit(0.0))).alias("mean_years"),
        F.avg("crack").alias("mean_crack"), F.avg(F.when(F.col("in_zone"), F.col("flood"))).alias("mean_flood"), F.count_if(F.col("heldout") > 0).alias("heldout"),
        F.count_if(F.col("years").isNull()).alias("no_forecast"), F.count_if("in_zone").alias("in_zone"),
    )
    return counts.crossJoin(q)  # one row each


def _extent() -> list[Column]:
    return [F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy")]


def county_table(roads: DataFrame, high: float) -> DataFrame:
    """Per county of roads (seg_id, tier, in_zone, flood, minx to maxy): rows, each tier's, zone's, high flood's, and bounds."""
    county = parse_seg_id(F.col("seg_id"))["county"].alias("county")
    tiers = [F.count_if(F.col("tier") == k).alias(f"tier_{k}") for k in range(1, 6)]
    high_flood = F.count_if(F.col("in_zone") & (F.col("flood") >= high)).alias("high_flood")
    return roads.groupBy(county).agg(F.count("*").alias("n"), *tiers, F.count_if("in_zone").alias("in_zone"), high_flood, *_extent())


def route_bounds(roads: DataFrame) -> DataFrame:
    """label, n and bounds of every route but secondary ones; several codes of one class and number are one."""
    p = parse_seg_id(F.col("seg_id"))
    return roads.where(p["class"] != "SR").groupBy(route_label(F.col("seg_id")).alias("label")).agg(F.count("*").alias("n"), *_extent())


def secondary_counties(roads: DataFrame) -> DataFrame:
    """number and its counties' codes in order, as text: where a secondary road of that number may be."""
    p = parse_seg_id(F.col("seg_id"))
    pairs = roads.where(p["class"] == "SR").select(p["number"].alias("number"), F.lpad(p["county"].cast("string"), 3, "0").alias("code")).distinct()
    return pairs.groupBy("number").agg(F.array_join(F.sort_array(F.collect_set("code")), " ").alias("counties"))  # at most the counties there are


def order_rollup(roads: DataFrame, order: str) -> DataFrame:
    """Per work order: the worst tier, miles given or else measured along the line, and the costs that are known, or null."""
    return roads.groupBy(order).agg(F.min("tier").alias("tier"), F.sum(F.coalesce("miles", "measured_miles")).alias("miles"), F.sum("cost").alias("cost"), F.count("*").alias("n"))


def top_by_county(roads: DataFrame, score: str, n: int) -> DataFrame:
    top = roads.select("seg_id", score).orderBy(F.desc_nulls_last(score), "seg_id").limit(n)
    return top.groupBy(parse_seg_id(F.col("seg_id"))["county"].alias("county")).agg(F.count("*").alias("n"))


def storm_list(roads: DataFrame, score: str, n: int) -> DataFrame:
    """The zone's ``n`` roads of highest unrounded score, with their place."""
    top = roads.where("in_zone").select("seg_id", score).orderBy(F.desc(score), "seg_id").limit(n)
    return global_rank(top, [F.desc(score), F.asc("seg_id")], "place")


def backtest(roads: DataFrame, score: str, damaged: str, n: int) -> DataFrame:
    """Among held-out zone roads: how many of the ``n`` first by score were damaged, and how many by chance."""
    z = roads.where("in_zone and heldout").select("seg_id", score, F.col(damaged).cast("int").alias("_bad"))
    top = z.orderBy(F.desc(score), "seg_id").limit(n).agg(F.count("*").alias("n"), F.sum("_bad").alias("damaged"))
    return top.crossJoin(F.broadcast(z.agg((n * F.avg("_bad")).alias("expected"))))  # one row each


def over_threshold(roads: DataFrame, column: str, least: float) -> DataFrame:
    return roads.where(F.col(column) >= least).orderBy(F.desc(column), "seg_id")


def near_me(roads: DataFrame, d2: Column, k: int) -> DataFrame:
    """The ``k`` nearest roads, then those sooner Poor first, blanks last."""
    return roads.withColumn("d2", d2).orderBy("d2", "seg_id").limit(k).orderBy(F.asc_nulls_last("years"), "seg_id")


def labels_check(roads: DataFrame, depth: str, failed: str, wet_m: float = 0.3) -> DataFrame:
    """The share that failed among roads under ``wet_m`` of water or more, and among those that stayed dry."""
    bad, wet = F.col(failed).cast("int"), F.col(depth) >= wet_m
    dry = F.col(depth) == 0
    return roads.agg(F.count_if(wet).alias("n_wet"), F.count_if(dry).alias("n_dry"), F.avg(F.when(wet, bad)).alias("wet"), F.avg(F.when(dry, bad)).alias("dry"))


def ratio_quantiles(df: DataFrame, a: str, b: str, inside: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """Of the ratios of two values, where both are there and neither is 0: count, quartiles, and the share inside a range."""
    r = df.select((F.col(a) / F.nullif(F.col(b), F.lit(0))).alias("r")).where("r is not null and r != 0")
    q = quantiles(r, [], {name: (F.col("r"), share) for name, share in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))})
    out = r.agg(F.count("*").alias("n"), F.avg(F.col("r").between(*inside).cast("int")).alias("inside")).crossJoin(q)  # one row each
    return out.select("n", "q25", "q50", "q75", "inside")


def latest_reading(*streams: DataFrame) -> DataFrame:
    """The newest time of several streams, replayed rows included; null where all are empty."""
    newest = [s.agg(F.max("time").alias("t")) for s in streams]
    out = newest[0]
    for n in newest[1:]:
        out = out.unionAll(n)
    return out.agg(F.max("t").alias("latest"))


# labels from reports


def match_summary(reports: DataFrame, matched: DataFrame) -> DataFrame:
    """Per source and type: reports, those matched to a road, and those not."""
    hit = matched.where("seg_id is not null").select("report_id").distinct().withColumn("_hit", F.lit(1))
    by = reports.join(hit, "report_id", "left").groupBy("source", "type").agg(F.count("*").alias("reports"), F.count("_hit").alias("matched"))
    return by.withColumn("unmatched", F.col("reports") - F.col("matched"))


def report_labels(roads: DataFrame, reports: DataFrame, matched: DataFrame, types: dict[str, str], pulled_at: Column, starts: dict[str, str]) -> DataFrame:
    """Per road (seg_id, city, rehab_year, miles): what was reported since its city watches it and its surface is there.

    n_reports, one count a type (type to column) and all_time are 0 where nothing was; rate and any are null outside a
    city and where no time was watched. A report counts if it came between the road's start and ``pulled_at``.
    """
    window = by_source(F.col("city"), starts).cast("date")
    after = F.make_date(F.col("rehab_year") + 1, F.lit(1), F.lit(1))
    start = F.when(window.isNotNull(), F.greatest(window, after))
    base = roads.select("seg_id", "city", "miles", start.alias("_start"), F.when(window.isNotNull(), exposure_years(window, F.col("rehab_year"), pulled_at.cast("date"))).alias("exposure_years"))
    m = matched.where("seg_id is not null").select("report_id", "seg_id").join(reports.select("report_id", "type", "time"), "report_id").join(base.select("seg_id", "_start"), "seg_id")
    watched = F.coalesce((F.col("time") >= F.col("_start").cast("timestamp")) & (F.col("time") <= pulled_at), F.lit(False))
    kinds = [F.count_if(watched & (F.col("type") == t)).alias(c) for t, c in types.items()]
    n = m.groupBy("seg_id").agg(F.count_if(watched).alias("n_reports"), *kinds, F.count("*").alias("n_all_time"))
    out = base.join(n, "seg_id", "left").fillna(0, ["n_reports", *types.values(), "n_all_time"])
    covered = F.col("city").isNotNull() & (F.col("exposure_years") > 0)
    miles = F.col("miles") * F.col("exposure_years")
    out = out.withColumns({"rate": F.when(covered & (miles > 0), F.col("n_reports") / miles), "any": F.when(covered, (F.col("n_reports") > 0).cast("double"))})
    return out.select("seg_id", "city", "exposure_years", "n_reports", *types.values(), "n_all_time", "rate", "any")


def evidence_flags(points: DataFrame, key: Column, name: str, kinds: dict[str, str], sources: list[str]) -> DataFrame:
    """Per place: whether any point is of each kind of evidence (name to kind), whether any at all, and a count per source."""
    flags = [F.bool_or(F.col("evidence") == k).alias(f"any_{n}") for n, k in kinds.items()]
    counts = [F.count_if(F.col("source") == s).alias(f"n_{s}") for s in sources]
    return points.groupBy(key.alias(name)).agg(*flags, F.bool_or(F.col("evidence").isin(*kinds.values())).alias("any_evidence"), *counts)


# one road


def road_record(seg_id: str, roads: DataFrame, monthly: DataFrame, cameras: DataFrame, hours: DataFrame) -> DataFrame:
    """A row of JSON texts: the road, its reports by month, and its cameras with the latest hour of each (null without one).

    ``roads`` has the record's columns; ``monthly`` seg_id, source, bucket, n; ``hours`` camera_id, bucket and maxima,
    without replays. An id of another shape refuses; no such road, no row.
    """
    pattern = SEG_ID.replace(r"\d", "[0-9]")
    if not roads.sparkSession.range(1).where(F.lit(seg_id).rlike(pattern)).count():
        raise Refused("a segment's id looks like ncdot:40002748092:0.940")
    one = roads.where(F.col("seg_id") == seg_id)
    plain = [c for c in one.columns if c != "line"]
    shape = {"shape": F.transform("line", lambda p: F.array(F.round(p["x"], 6), F.round(p["y"], 6)))} if "line" in one.columns else {}
    record = one.select(record_json(**{c: F.col(c) for c in plain}, **shape).alias("road"))
    months = monthly.where(F.col("seg_id") == seg_id).agg(F.sort_array(F.collect_list(F.struct(F.col("bucket").cast("string").alias("month"), "source", "n"))).alias("m"))
    own = cameras.where(F.col("seg_id") == seg_id)
    some = hours.join(own.select("camera_id"), "camera_id", "left_semi")  # before they are summed: other cameras' hours are not
    latest = some.groupBy("camera_id").agg(F.max_by(F.struct(*[c for c in hours.columns if c != "camera_id"]), "bucket").alias("h"))
    own = own.join(latest, "camera_id", "left")
    hour = [F.col(f"h.{c}").cast("string" if c == "bucket" else hours.schema[c].dataType).alias("latest_hour" if c == "bucket" else c) for c in hours.columns if c != "camera_id"]
    seen = own.agg(F.sort_array(F.collect_list(F.struct("camera_id", "known_dry", *hour))).alias("c"))  # a road's cameras are few
    out = record.crossJoin(months).crossJoin(seen)  # one row each
    return out.select("road", F.to_json("m").alias("by_month"), F.to_json("c").alias("cameras"))
