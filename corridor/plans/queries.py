"""Queries over the derived road tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corridor.common import shared_folder
from corridor.functions import geo, keys, measures
from corridor.operators import checks, depth, gates, linref, metrics, models, ranking, spatial, timeseries
from corridor.plans import fixtures as fx
from corridor.sources import readers
from corridor.streaming import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
WORST = ["rating", "ytp_milli", "crack_mil", "flood_mil"]


def query(sql: str | None = None):
    """Registers a query under its function's name; its SQL may use the derived tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {fx.SQL} {sql}"
        return f

    return add


# keys and cleaning


@query("SELECT seg_id, substr(seg_id, 7, 8) AS route, CAST(substr(seg_id, 15, 3) AS INTEGER) AS county, CAST(split_part(seg_id, ':', 3) AS DOUBLE) AS milepost, 'SR' AS class, CAST(substr(seg_id, 10, 5) AS INTEGER) AS number FROM seg")
def prj5_parse_seg_id(spark, d):
    return fx.segments(spark, d).select("seg_id", keys.parse_seg_id(F.col("seg_id")).alias("p")).select("seg_id", "p.*")


@query("SELECT o_orderkey, CAST(round_even(o_custkey / 2.0, 0) AS BIGINT) AS rid, right(CAST(o_custkey + 30000000 AS VARCHAR), 8) || lpad(CAST(o_custkey % 100 AS VARCHAR), 3, '0') AS composed FROM orders")
def prj1_route_keys(spark, d):
    c = F.col("o_custkey")
    return fx.table(spark, d, "orders").select("o_orderkey", keys.route_key((c / 2).cast("string")).alias("rid"), keys.compose_route((c + 30000000).cast("double").cast("decimal(10,1)"), c % 100).alias("composed"))


@query("SELECT seg_id, CASE WHEN rating NOT IN (0, 55) THEN rating END AS rating FROM seg")
def prj11_missing_to_null(spark, d):
    return fx.segments(spark, d).select("seg_id", keys.missing_to_null(F.col("rating"), (0, 55)).alias("rating"))


@query("SELECT doc_id, regexp_matches(lower(text), 'secret|password|token') AS evidence FROM documents")
def prj13_contains_any(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", keys.contains_any("secret|password|token", F.col("text")).alias("evidence"))


@query("SELECT seg_id, CAST((heldout::INT) + 2 * (in_zone::INT) + 4 * (coalesce(ytp_milli <= 1000, false)::INT) AS INTEGER) AS bits FROM pred")
def prj20_heldout_bits(spark, d):
    return fx.predictions(spark, d).select("seg_id", keys.heldout_bits(F.col("heldout"), F.col("in_zone"), F.col("ytp_milli") <= 1000).alias("bits"))


# gates


@query("SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_null, (SELECT count(*) FROM (SELECT seg_id FROM seg GROUP BY 1 HAVING count(*) > 1) z) AS n_repeated FROM seg")
def qlt1_key_report(spark, d):
    return gates.key_report(fx.segments(spark, d), "seg_id")


@query("""SELECT (SELECT count(*) FROM (SELECT DISTINCT rid FROM seg) a WHERE rid NOT IN (SELECT rid FROM pt)) AS missing,
  (SELECT count(*) FROM (SELECT DISTINCT rid FROM pt) a WHERE rid NOT IN (SELECT rid FROM seg)) AS extra""")
def qlt2_same_ids(spark, d):
    return gates.same_ids(fx.segments(spark, d), fx.points(spark, d), "rid")


@query("""SELECT 'rating' AS rule, count(*) FILTER (rating NOT BETWEEN 0 AND 95) AS broken FROM pred
  UNION ALL SELECT 'zone', count(*) FILTER (NOT in_zone AND flood_mil > 900) FROM pred""")
def qlt6_domain_report(spark, d):
    return gates.domain_report(fx.predictions(spark, d), {"rating": F.col("rating").between(0, 95), "zone": F.col("in_zone") | (F.col("flood_mil") <= 900)})


@query("SELECT camera_id, count(*) AS n_values FROM (SELECT DISTINCT camera_id, depth_cm < 0 AS s, known_dry, p_mil > 990 AS h FROM reading) z GROUP BY 1 HAVING count(*) > 1")
def qlt7_functional_dependency(spark, d):
    r = fx.readings(spark, d).select("camera_id", (F.col("depth_cm") < 0).alias("s"), "known_dry", (F.col("p_mil") > 990).alias("h"))
    return gates.functional_dependency(r, "camera_id", "s", "known_dry", "h")


@query("""WITH a AS (SELECT seg_id, rating, age FROM pred), b AS (SELECT seg_id, CASE WHEN age = 7 THEN rating + 1 ELSE rating END AS rating, age FROM pred WHERE rid % 7 <> 0)
  SELECT 'missing' AS what, (SELECT count(*) FROM a) - (SELECT count(*) FROM b) AS n UNION ALL SELECT 'extra', 0
  UNION ALL SELECT 'rating', count(*) FROM b WHERE age = 7 UNION ALL SELECT 'age', 0""".replace("WITH a AS", ", a AS", 1))
def qlt13_compare_tables(spark, d):
    p = fx.predictions(spark, d).select("seg_id", "rating", "age")
    other = fx.predictions(spark, d).where("rid % 7 <> 0").select("seg_id", F.when(F.col("age") == 7, F.col("rating") + 1).otherwise(F.col("rating")).alias("rating"), "age")
    return gates.compare_tables(p, other, "seg_id")


# linear referencing


@query("SELECT seg_id, pb, pe, least(\"end\", pe) - greatest(beg, pb) AS ov FROM seg JOIN piece USING (rid) WHERE greatest(beg, pb) < least(\"end\", pe)")
def jon1_interval_overlaps(spark, d):
    return linref.interval_overlaps(fx.segments(spark, d), fx.pieces(spark, d)).select("seg_id", "pb", "pe", "ov")


@query("SELECT pt_id, seg_id FROM (SELECT pt_id, seg_id, row_number() OVER (PARTITION BY pt_id ORDER BY beg, seg_id) AS k FROM pt LEFT JOIN seg ON pt.rid = seg.rid AND mp BETWEEN beg AND \"end\") z WHERE k = 1")
def jon2_points_on_segments(spark, d):
    return linref.points_on_segments(fx.segments(spark, d), fx.points(spark, d), "pt_id")


@query("""SELECT seg_id, cnt, ov, pb FROM (SELECT seg_id, CASE WHEN cnt > 50 THEN cnt END AS cnt, pb, least("end", pe) - greatest(beg, pb) AS ov,
  row_number() OVER (PARTITION BY seg_id ORDER BY cnt <= 50, least("end", pe) - greatest(beg, pb) DESC, pb) AS k FROM seg JOIN piece USING (rid) WHERE greatest(beg, pb) < least("end", pe)) z WHERE k = 1""")
def jon4_best_overlap(spark, d):
    p = fx.pieces(spark, d).withColumn("cnt", F.when(F.col("cnt") > 50, F.col("cnt")))
    return linref.best_overlap(fx.segments(spark, d), p, "cnt")


@query("""SELECT seg_id, round(sum(cnt * (least("end", pe) - greatest(beg, pb)) / (pe - pb)::DOUBLE), 4) AS cnt FROM seg JOIN piece USING (rid) WHERE greatest(beg, pb) < least("end", pe) GROUP BY 1""")
def agg1_apportion(spark, d):
    over = linref.interval_overlaps(fx.segments(spark, d), fx.pieces(spark, d))
    return linref.apportion(over, ["cnt"], F.col("pe") - F.col("pb")).withColumn("cnt", F.round("cnt", 4))


@query("""SELECT seg_id, round(sum(CASE WHEN cnt > 50 THEN cnt END * ov) / sum(CASE WHEN cnt > 50 THEN ov END), 7) AS mean FROM
  (SELECT seg_id, cnt, least("end", pe) - greatest(beg, pb) AS ov FROM seg JOIN piece USING (rid)) z WHERE ov > 0 GROUP BY 1""")
def agg2_weighted_mean(spark, d):
    p = fx.pieces(spark, d).withColumn("cnt", F.when(F.col("cnt") > 50, F.col("cnt")))
    return linref.interval_overlaps(fx.segments(spark, d), p).groupBy("seg_id").agg(F.round(linref.weighted_mean("cnt", "ov"), 7).alias("mean"))


@query("""SELECT seg_id, round(least(coalesce(o.ov / len::DOUBLE, 0), 1), 6) AS covered FROM seg LEFT JOIN
  (SELECT seg_id, sum(ov) AS ov FROM (SELECT seg_id, least("end", pe) - greatest(beg, pb) AS ov FROM seg JOIN piece USING (rid)) z WHERE ov > 0 GROUP BY 1) o USING (seg_id)""")
def agg3_coverage(spark, d):
    s = fx.segments(spark, d)
    return linref.coverage(linref.interval_overlaps(s, fx.pieces(spark, d)), s, "len").withColumn("covered", F.round("covered", 6))


@query("""SELECT seg_id, count(*) FILTER (sev = 'K') AS "K", count(*) FILTER (sev = 'A') AS "A" FROM
  (SELECT pt_id, sev, seg_id, row_number() OVER (PARTITION BY pt_id ORDER BY beg, seg_id) AS k FROM pt JOIN seg ON pt.rid = seg.rid AND mp BETWEEN beg AND "end") z WHERE k = 1 GROUP BY 1""")
def agg4_crosstab(spark, d):
    on = linref.points_on_segments(fx.segments(spark, d), fx.points(spark, d), "pt_id").where("seg_id is not null")
    return linref.crosstab(on.join(fx.points(spark, d), "pt_id"), "seg_id", "sev", ["K", "A"])


@query("""SELECT rid, round(n / nullif(mi * 5.0, 0), 6) AS per_mile_year, round(n * 1e6 / nullif(365.0 * traffic * mi, 0), 6) AS per_mvm FROM
  (SELECT rid, sum(len) / 1000.0 AS mi FROM seg GROUP BY 1) s JOIN (SELECT rid, count(*) AS n FROM pt GROUP BY 1) p USING (rid) JOIN (SELECT rid, sum(cnt) AS traffic FROM piece GROUP BY 1) t USING (rid)""")
def agg5_rates(spark, d):
    s = fx.segments(spark, d).groupBy("rid").agg((F.sum("len") / 1000.0).alias("mi"))
    p = fx.points(spark, d).groupBy("rid").agg(F.count("*").alias("n"))
    t = fx.pieces(spark, d).groupBy("rid").agg(F.sum("cnt").alias("traffic"))
    both = s.join(p, "rid").join(t, "rid")
    return both.select("rid", F.round(measures.guarded(F.col("n"), F.col("mi") * 5.0), 6).alias("per_mile_year"), F.round(measures.guarded(F.col("n") * 1e6, 365.0 * F.col("traffic") * F.col("mi")), 6).alias("per_mvm"))


@query("SELECT seg_id, coalesce(CASE WHEN cnt > 250 THEN cnt END, CASE WHEN rating > 50 THEN rating END) AS value, CASE WHEN cnt > 250 THEN 'count' WHEN rating > 50 THEN 'estimate' ELSE 'none' END AS label FROM seg JOIN (SELECT rid, min(cnt) AS cnt FROM piece GROUP BY 1) p USING (rid)")
def agg6_best_value(spark, d):
    both = fx.segments(spark, d).join(fx.pieces(spark, d).groupBy("rid").agg(F.min("cnt").alias("cnt")), "rid")
    v, n = measures.best_value(count=F.when(F.col("cnt") > 250, F.col("cnt")), estimate=F.when(F.col("rating") > 50, F.col("rating")))
    return both.select("seg_id", v.alias("value"), n.alias("label"))


# measures, ranks, lists


BUCKET = "CASE WHEN ytp_milli IS NULL THEN 'unknown' WHEN ytp_milli <= 0 THEN 'fix_now' WHEN ytp_milli <= 1000 THEN '1y' WHEN ytp_milli <= 5000 THEN '5y' ELSE 'later' END"


@query("""SELECT seg_id, CASE WHEN rating = 0 THEN NULL WHEN rating < 60 THEN 0 ELSE round(least((rating - 60) / greatest((100 - rating) / age::DOUBLE, 0.1), 50), 4) END AS years,
  round((100 - rating) / age::DOUBLE, 6) AS rate FROM seg""")
def mth1_years_to_poor(spark, d):
    rate = measures.wear_rate(F.col("rating"), F.col("age"))
    return fx.segments(spark, d).select("seg_id", F.round(measures.years_to_poor(F.col("rating"), rate), 4).alias("years"), F.round(rate, 6).alias("rate"))


@query(f"SELECT bucket, count(*) AS n FROM (SELECT {BUCKET} AS bucket FROM pred) z GROUP BY 1")
def mth3_repair_buckets(spark, d):
    return fx.predictions(spark, d).groupBy(measures.repair_bucket(F.col("ytp_milli") / 1000).alias("bucket")).agg(F.count("*").alias("n"))


TIERS = {"now": 0, "soon": 2, "crack": 0.7, "flood": 0.8}
TIER = """CASE WHEN coalesce(ytp_milli <= 0, false) AND (crack_mil >= 700 OR in_zone AND flood_mil >= 800) THEN 1 WHEN coalesce(ytp_milli <= 0, false) THEN 2
  WHEN coalesce(ytp_milli <= 2000, false) OR in_zone AND flood_mil >= 800 THEN 3 WHEN crack_mil >= 700 THEN 4 ELSE 5 END"""


def _tier():
    return measures.tier(F.col("ytp_milli") / 1000, F.col("crack_mil") / 1000, F.col("flood_mil") / 1000, F.col("in_zone"), TIERS)


@query(f"SELECT seg_id, {TIER} AS tier, round(0.45 * (1 - coalesce(ytp_milli, 50000) / 50000.0) + 0.35 * crack_mil / 1000.0 + CASE WHEN in_zone THEN 0.2 * flood_mil / 1000.0 ELSE 0 END, 6) AS score FROM pred")
def mth4_tier_and_score(spark, d):
    score = measures.priority_score(F.col("ytp_milli") / 1000, F.col("crack_mil") / 1000, F.col("flood_mil") / 1000, F.col("in_zone"))
    return fx.predictions(spark, d).select("seg_id", _tier().alias("tier"), F.round(score, 6).alias("score"))


ORDER_SQL = "ytp_milli ASC NULLS LAST, rating ASC, crack_mil DESC, seg_id"


def _order():
    return [F.asc_nulls_last("ytp_milli"), F.asc("rating"), F.desc("crack_mil"), F.asc("seg_id")]


@query(f"SELECT seg_id, row_number() OVER (ORDER BY {ORDER_SQL}) AS rank FROM pred")
def win1_priority_rank(spark, d):
    return ranking.global_rank(fx.predictions(spark, d).select("seg_id", "ytp_milli", "rating", "crack_mil"), _order()).select("seg_id", "rank")


@query("""SELECT seg_id, fifth FROM (SELECT seg_id, CASE WHEN count(*) OVER (PARTITION BY rid) < 30 THEN 0 ELSE CAST(ceil(5 * row_number() OVER (PARTITION BY rid ORDER BY rating, seg_id) / (count(*) OVER (PARTITION BY rid))::DOUBLE) AS INTEGER) END AS fifth FROM pred) z""")
def win2_fifths(spark, d):
    return ranking.ntile_by_rank(fx.predictions(spark, d), "rating", 5, ["rid"], "seg_id", 30, "fifth").select("seg_id", "fifth")


@query("SELECT rid, pb, pe, cnt FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY cnt, pb, pe) AS k FROM piece) z WHERE k = 1")
def win4_dedup_first(spark, d):
    return ranking.dedup_first(fx.pieces(spark, d), ["rid"], ["cnt"])


@query("SELECT seg_id FROM seg WHERE seg_id > 'ncdot:40000050' ORDER BY seg_id LIMIT 100")
def win6_keyset_page(spark, d):
    return ranking.keyset_page(fx.segments(spark, d).select("seg_id"), "seg_id", "ncdot:40000050", 100)


@query(f"SELECT seg_id, tier, place FROM (SELECT seg_id, tier, row_number() OVER (PARTITION BY tier ORDER BY ytp_milli ASC NULLS LAST, seg_id) AS place FROM (SELECT *, {TIER} AS tier FROM pred) y) z WHERE place <= 20")
def win7_top_per_tier(spark, d):
    p = fx.predictions(spark, d).withColumn("tier", _tier())
    return ranking.top_per_group(p, "tier", [F.asc_nulls_last("ytp_milli"), F.asc("seg_id")], 20).select("seg_id", "tier", "place")


@query("SELECT round(avg((crack_mil >= 900)::INT), 6) AS share FROM pred")
def win12_percent_top(spark, d):
    return ranking.percent_top(fx.predictions(spark, d), "crack_mil", 900).withColumn("share", F.round("share", 6))


@query("SELECT b AS bin, count(p.seg_id) AS n FROM (SELECT unnest(range(0, 21)) AS b) x LEFT JOIN pred p ON b = CAST(ceil(crack_mil / 50.0) AS BIGINT) AND crack_mil <= 1000 GROUP BY 1")
def agg12_histogram(spark, d):
    return ranking.histogram(fx.predictions(spark, d), "crack_mil", 50, 1000)


@query("SELECT concat(CAST(CAST(floor(mid_x / 5000) AS BIGINT) AS VARCHAR), '_', CAST(CAST(floor(mid_y / 5000) AS BIGINT) AS VARCHAR)) AS block, count(*) AS n FROM seg GROUP BY 1")
def fld1_blocks(spark, d):
    return fx.segments(spark, d).groupBy(keys.block_id(F.col("mid_x"), F.col("mid_y")).alias("block")).agg(F.count("*").alias("n"))


@query("SELECT camera_id, (row_number() OVER (ORDER BY n DESC, camera_id) - 1) % 5 AS fold FROM (SELECT camera_id, count(*) AS n FROM reading GROUP BY 1) z")
def fld3_group_folds(spark, d):
    sizes = fx.readings(spark, d).groupBy("camera_id").agg(F.count("*").alias("n"))
    return ranking.global_rank(sizes, [F.desc("n"), F.asc("camera_id")]).select("camera_id", ((F.col("rank") - 1) % 5).alias("fold"))


# spatial


@query("SELECT report_id, seg_id, CAST(dist2 AS BIGINT) AS dist2 FROM near WHERE dist2 <= 3600")
def jon5_dwithin(spark, d):
    s = fx.segments(spark, d).select("seg_id", F.col("mid_x").alias("x"), F.col("mid_y").alias("y"))
    r = fx.reports(spark, d).select("report_id", F.col("x").alias("px"), F.col("y").alias("py"))
    return spatial.points_within(s, r, 60).select("report_id", "seg_id", F.col("dist2").cast("long").alias("dist2"))


@query("""SELECT report_id, seg_id, dist2 FROM report LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY dist2, seg_id) AS k FROM near WHERE dist2 <= 3600) m USING (report_id) WHERE coalesce(k, 1) = 1""")
def jon6_nearest(spark, d):
    r = fx.reports(spark, d).select("report_id", "x", "y")
    s = fx.segments(spark, d).select("seg_id", F.col("mid_x").alias("px"), F.col("mid_y").alias("py"))
    return spatial.nearest_point(r, s, 60, "report_id", "seg_id")


@query("SELECT seg_id, h.seg_id IS NOT NULL AS near FROM seg LEFT JOIN (SELECT DISTINCT seg_id FROM near WHERE dist2 <= 1600) h USING (seg_id)")
def jon13_zone_flag(spark, d):
    s = fx.segments(spark, d).select("seg_id", F.col("mid_x").alias("x"), F.col("mid_y").alias("y"))
    r = fx.reports(spark, d).select(F.col("x").alias("px"), F.col("y").alias("py"))
    return spatial.within_any(s, r, 40, "seg_id", "near").select("seg_id", "near")


@query("""SELECT a.report_id AS id1, b.report_id AS id2 FROM report a JOIN report b ON a.report_id < b.report_id AND a.report_id % 5 <> b.report_id % 5 AND abs(a.x - b.x) < 77 AND abs(a.y - b.y) < 77""")
def jon17_overlapping_pairs(spark, d):
    r = fx.reports(spark, d).select(F.col("report_id").alias("id"), (F.col("report_id") % 5).alias("fold"), "x", "y")
    return spatial.overlapping_pairs(r, 77)


@query("""SELECT seg_id, CASE WHEN mid_x + mid_y < 350000 AND mid_x >= 200000 AND mid_y >= 100000 THEN 'low' END AS area FROM seg""")
def jon9_point_in_polygon(spark, d):
    s = fx.segments(spark, d).select("seg_id", (F.col("mid_x") + 0.0).alias("x"), (F.col("mid_y") + 0.0).alias("y"))
    corner = [F.lit(v) for v in (199999.5, 99999.5, 250000.5)]
    ring = geo.line_of((corner[0], corner[1]), (corner[2], corner[1]), (corner[0], F.lit(150000.5)), (corner[0], corner[1]))
    area = spark.range(1).select(F.lit("low").alias("area"), ring.alias("ring"))
    return spatial.point_in_polygon(s, area, "seg_id", "area", 10000)


# a triangle with a hole that holds an island, a second part, and a square that overlaps them
HOLED_SQL = """SELECT seg_id, CASE WHEN ((mid_x + mid_y < 350000 AND mid_x >= 200000 AND mid_y >= 100000)::INT + (mid_x BETWEEN 210001 AND 225000 AND mid_y BETWEEN 105001 AND 120000)::INT + (mid_x BETWEEN 214001 AND 219000 AND mid_y BETWEEN 108001 AND 118000)::INT
  + (mid_x BETWEEN 250001 AND 258000 AND mid_y BETWEEN 140001 AND 159000)::INT) % 2 = 1 THEN 'city' WHEN mid_x BETWEEN 205001 AND 255000 AND mid_y BETWEEN 102001 AND 150000 THEN 'town' END AS area FROM seg"""


@query(HOLED_SQL)
def jon9_polygons_with_holes(spark, d):
    def box(x0, y0, x1, y1):
        x0, y0, x1, y1 = (F.lit(v + 0.5) for v in (x0, y0, x1, y1))
        return geo.line_of((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))

    s = fx.segments(spark, d).select("seg_id", (F.col("mid_x") + 0.0).alias("x"), (F.col("mid_y") + 0.0).alias("y"))
    a, b, c = (F.lit(v) for v in (199999.5, 99999.5, 250000.5))
    triangle = geo.line_of((a, b), (c, b), (a, F.lit(150000.5)), (a, b))
    city = F.array(box(210000, 105000, 225000, 120000), triangle, box(214000, 108000, 219000, 118000), box(250000, 140000, 258000, 159000))
    areas = spark.range(1).select(F.explode(F.array(F.struct(F.lit("city").alias("area"), city.alias("rings")), F.struct(F.lit("town").alias("area"), F.array(box(205000, 102000, 255000, 150000)).alias("rings")))).alias("p")).select("p.*")
    return spatial.point_in_polygon(s, areas, "seg_id", "area", 1000)


@query("SELECT seg_id FROM pred WHERE mid_x BETWEEN 210000 AND 215000 AND mid_y BETWEEN 110000 AND 118000")
def jon10_box_query(spark, d):
    x, y = F.col("mid_x"), F.col("mid_y")
    s = fx.predictions(spark, d).select("seg_id", geo.line_of((x, y), (x, y)).alias("line"))
    return spatial.box_query(s, 210000, 110000, 215000, 118000).select("seg_id")


@query("SELECT CAST(floor(mid_x / 2500) AS BIGINT) AS cx, CAST(floor(mid_y / 2500) AS BIGINT) AS cy, count(*) AS n FROM seg GROUP BY ALL")
def geo10_cells(spark, d):
    return fx.segments(spark, d).groupBy(geo.cell_key(F.col("mid_x"), F.col("mid_y"), 2500).alias("c")).agg(F.count("*").alias("n")).select("c.cx", "c.cy", "n")


@query("SELECT seg_id, round(len + sqrt(len * len + 9.0), 6) AS length, round(sqrt(9.0 + (len / 2.0) * (len / 2.0)), 6) AS dist FROM seg")
def geo3_length_and_distance(spark, d):
    n, zero = F.col("len").cast("double"), F.lit(0.0)
    line = geo.line_of((zero, zero), (n, zero), (zero, F.lit(3.0)))
    s = fx.segments(spark, d).select("seg_id", line.alias("line"), n.alias("n"))
    return s.select("seg_id", F.round(geo.length(F.col("line")), 6).alias("length"), F.round(geo.distance(F.col("n") / 2, F.lit(-1.0) * F.hypot(F.lit(3.0), zero), F.col("line")) ** 2 + (F.col("n") / 2) ** 2, 6).alias("d2")).select("seg_id", "length", F.round(F.sqrt("d2"), 6).alias("dist"))


# time series


@query("SELECT camera_id, date_trunc('hour', time) AS bucket, max(p_mil) AS max_p_mil, max(depth_cm) AS max_depth_cm, count(*) AS n, min(time) AS first, max(time) AS last FROM reading GROUP BY 1, 2")
def agg15_hourly(spark, d):
    return timeseries.hourly(fx.readings(spark, d), "camera_id", ["p_mil", "depth_cm"])


@query("SELECT source, date_trunc('month', time) AS bucket, count(*) AS n FROM report GROUP BY 1, 2")
def agg17_monthly(spark, d):
    return fx.reports(spark, d).groupBy("source", F.date_trunc("month", "time").alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT e.event_id, rtime, value FROM (SELECT event_id FROM reading WHERE p_mil >= 500) e LEFT JOIN (SELECT event_id, rtime, value FROM (SELECT a.event_id, b.time AS rtime, b.depth_cm AS value,
  row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(a.time) - epoch_us(b.time)), b.time, b.depth_cm) AS k FROM reading a JOIN reading b ON a.camera_id = b.camera_id AND a.p_mil >= 500 AND b.p_mil < 500
  AND abs(epoch_us(a.time) - epoch_us(b.time)) <= 7200000000) z WHERE k = 1) m USING (event_id)""")
def jon11_asof_nearest(spark, d):
    r = fx.readings(spark, d)
    a = r.where("p_mil >= 500").select("event_id", "camera_id", F.col("time").alias("ltime"))
    b = r.where("p_mil < 500").select("camera_id", F.col("time").alias("rtime"), F.col("depth_cm").alias("value"))
    return timeseries.asof_nearest(a, b, "camera_id", "event_id", 7200)


@query("""SELECT event_id AS id, coalesce(n, 0) AS n_near, round(coalesce(s, alls) / coalesce(n, alln)::DOUBLE, 6) AS mean_depth, round(coalesce(f, allf) / coalesce(n, alln)::DOUBLE, 6) AS flooded_share FROM reading t LEFT JOIN
  (SELECT a.event_id, count(*) AS n, sum(b.depth_cm) AS s, count(*) FILTER (b.depth_cm >= 2) AS f FROM reading a JOIN reading b ON a.camera_id <> b.camera_id
   AND abs(epoch_us(date_trunc('minute', a.time)) - epoch_us(date_trunc('minute', b.time))) <= 1200000000 GROUP BY 1) m USING (event_id), (SELECT count(*) AS alln, sum(depth_cm) AS alls, count(*) FILTER (depth_cm >= 2) AS allf FROM reading) w""")
def jon12_neighbourhood(spark, d):
    r = fx.readings(spark, d)
    out = timeseries.neighbourhood(r.withColumnRenamed("event_id", "id"), r, 20)
    return out.select("id", "n_near", F.round("mean_depth", 6).alias("mean_depth"), F.round("flooded_share", 6).alias("flooded_share"))


@query("SELECT camera_id, time, event_id, p_mil FROM (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY time DESC, event_id DESC) AS k FROM reading) z WHERE k = 1")
def jon14_latest(spark, d):
    return timeseries.latest_per_key(fx.readings(spark, d), "camera_id", "time", "event_id", "p_mil")


@query("""SELECT bucket, coalesce(flagged, 0) AS flagged, coalesce(dry_flagged, 0) AS dry_flagged, coalesce(wet, 0) AS wet FROM
  (SELECT date_trunc('hour', time) AS bucket, count(DISTINCT camera_id) FILTER (NOT known_dry) AS flagged, count(DISTINCT camera_id) FILTER (known_dry) AS dry_flagged FROM reading WHERE p_mil >= 500 GROUP BY 1) a
  FULL JOIN (SELECT date_trunc('hour', time) AS bucket, count(DISTINCT camera_id) AS wet FROM reading WHERE depth_cm >= 2 AND NOT known_dry GROUP BY 1) b USING (bucket)""")
def str8_alert_peaks(spark, d):
    return timeseries.alert_peaks(fx.readings(spark, d))


@query("SELECT date_trunc('hour', time) AS bucket, max(p_mil) AS max_p_mil, count(*) AS n FROM reading WHERE camera_id = 'C7' AND time >= TIMESTAMP '2024-01-05' AND time < TIMESTAMP '2024-01-25' GROUP BY 1 ORDER BY 1 LIMIT 2000")
def str9_camera_history(spark, d):
    r = fx.readings(spark, d).where("camera_id = 'C7' and time >= timestamp'2024-01-05' and time < timestamp'2024-01-25'")
    return timeseries.hourly(r, "camera_id", ["p_mil"]).select("bucket", "max_p_mil", "n").orderBy("bucket").limit(2000)


LOG_SQL = """log AS (SELECT camera_id, event_id AS round, CASE WHEN p_mil < 50 THEN 500 ELSE 200 END AS http, p_mil % 11 <> 0 AS is_image, (p_mil * 7) % 1000 AS age_s, 's' || CAST(depth_cm % 3 AS VARCHAR) AS sha1, (p_mil * 3) % 256 AS luma FROM reading)"""


def _log(spark, d):
    p = F.col("p_mil")
    return fx.readings(spark, d).select("camera_id", F.col("event_id").alias("round"), F.when(p < 50, 500).otherwise(200).alias("http"), (p % 11 != 0).alias("is_image"), ((p * 7) % 1000).alias("age_s"), F.concat(F.lit("s"), (F.col("depth_cm") % 3).cast("string")).alias("sha1"), ((p * 3) % 256).alias("luma"))


@query(f""", {LOG_SQL}, g AS (SELECT *, CASE WHEN http <> 200 THEN 'http_error' WHEN NOT is_image THEN 'not_image' WHEN age_s > 900 THEN 'stale' END AS bad FROM log),
  p AS (SELECT *, last_value(CASE WHEN bad IS NULL THEN sha1 END IGNORE NULLS) OVER (PARTITION BY camera_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM g)
  SELECT camera_id, round, coalesce(bad, CASE WHEN sha1 = prev THEN 'duplicate' WHEN luma < 40 THEN 'dark' ELSE 'ok' END) AS status FROM p""")
def str10_still_log(spark, d):
    return timeseries.still_log_status(_log(spark, d)).select("camera_id", "round", "status")


@query(f""", {LOG_SQL}, r AS (SELECT *, CAST(floor(round / 50) AS BIGINT) AS r FROM log) SELECT r.camera_id, r.round FROM r JOIN (SELECT r, sha1 FROM r GROUP BY 1, 2 HAVING count(DISTINCT camera_id) >= 20) m USING (r, sha1)""")
def str11_placeholder_cards(spark, d):
    log = _log(spark, d).withColumnRenamed("round", "attempt").withColumn("round", F.floor(F.col("attempt") / 50))
    return timeseries.placeholder_cards(log, 20).select("camera_id", F.col("attempt").alias("round"))


@query(""", r AS (SELECT CAST(floor(event_id / 500) AS BIGINT) AS round, event_id AS attempt, p_mil % 2 = 0 AS failed FROM reading),
  x AS (SELECT *, row_number() OVER w AS n, sum(failed::INT) OVER w AS f FROM r WINDOW w AS (PARTITION BY round ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  SELECT round, min(CASE WHEN n >= 40 AND f > 0.5 * n THEN attempt END) AS stop_at FROM x GROUP BY 1""")
def str12_circuit_check(spark, d):
    log = fx.readings(spark, d).select(F.floor(F.col("event_id") / 500).alias("round"), F.col("event_id").alias("attempt"), (F.col("p_mil") % 2 == 0).alias("failed"))
    return timeseries.circuit_check(log)


# a table that holds replays already: those of a seventh of its rows, three days on
PLAYED_SQL = """, played AS (SELECT camera_id, time, p_mil, NULL::TIMESTAMP AS replay_of FROM reading UNION ALL SELECT camera_id, time + INTERVAL 3 DAY, p_mil, time FROM reading WHERE event_id % 7 = 0),
  again AS (SELECT camera_id, time + INTERVAL 3 DAY AS time, p_mil, time AS replay_of FROM played WHERE replay_of IS NULL AND time BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' AND (camera_id, time + INTERVAL 3 DAY) NOT IN (SELECT camera_id, time FROM played))"""


def _again(spark, d):
    ts = lambda s: F.lit(s).cast("timestamp")
    r = fx.readings(spark, d).select("camera_id", "time", "p_mil", F.lit(None).cast("timestamp").alias("replay_of"), "event_id")
    later = r.where("event_id % 7 = 0").withColumns({"time": F.col("time") + F.expr("interval 3 days"), "replay_of": F.col("time")})
    return timeseries.replay(r.unionByName(later).drop("event_id"), ts("2024-01-10"), ts("2024-01-12"), ts("2024-01-15"), ["camera_id", "time"])


@query(f"{PLAYED_SQL} SELECT * FROM again")
def str5_replay(spark, d):
    return _again(spark, d)


@query(f"""{PLAYED_SQL} SELECT CAST(least(greatest(ceil((epoch_us(replay_of) - epoch_us(TIMESTAMP '2024-01-10')) / 28800000000.0::DOUBLE), 1), 6) AS INTEGER) AS batch, count(*) AS n, min(time) AS first, max(time) AS last FROM again GROUP BY 1""")
def str5_replay_batches(spark, d):
    ts = lambda s: F.lit(s).cast("timestamp")
    out = timeseries.replay_batches(_again(spark, d), 6, ts("2024-01-10"), ts("2024-01-12"))
    return out.groupBy("batch").agg(F.count("*").alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))


# the store of readings: two thirds of the keys come in two batches and again, hours before the 15th are closed, days
# before the 13th packed, then the rest comes, among it rows for closed hours, which count when refreshed
STORE_SCHEMA = "event_id long, camera_id string, time timestamp, p_mil long"


def _store(spark, d) -> str:
    from datetime import datetime

    root, r = shared_folder(spark, "store"), fx.readings(spark, d).select("event_id", "camera_id", "time", "p_mil")
    add = store.append_once(spark, root, STORE_SCHEMA, ["camera_id", "time", "event_id"])
    early = r.where("event_id % 3 > 0 and time < timestamp '2024-01-15 08:00:00'")
    add(early.where("event_id % 2 = 0"), 0)
    add(early, 1)
    add(early, 1)
    store.close_hours(spark, root, STORE_SCHEMA, _hour_sums, datetime(2024, 1, 15, 6))
    store.pack(spark, root, STORE_SCHEMA, ["camera_id", "time"], F.col("day") < F.lit("2024-01-13").cast("date"))
    add(r.unionByName(r.where("event_id % 5 = 0")), 2)
    return root


def _hour_sums(df):
    return timeseries.hourly(df, "camera_id", ["p_mil"])


@query("SELECT event_id, camera_id, time, p_mil, CAST(time AS DATE) AS day FROM reading")
def str1_store_rows(spark, d):
    return store.rows_of(spark, _store(spark, d), STORE_SCHEMA)


@query("""SELECT camera_id, date_trunc('hour', time) AS bucket, max(p_mil) AS max_p_mil, count(*) AS n, min(time) AS first, max(time) AS last FROM reading
  WHERE time >= TIMESTAMP '2024-01-15 06:00:00' OR event_id % 3 > 0 GROUP BY 1, 2""")
def str3_hours_with_tail(spark, d):
    return store.hours_of(spark, _store(spark, d), STORE_SCHEMA, _hour_sums)


@query("""SELECT camera_id, date_trunc('hour', time) AS bucket, max(p_mil) AS max_p_mil, count(*) AS n, min(time) AS first, max(time) AS last FROM reading
  WHERE time >= TIMESTAMP '2024-01-15 06:00:00' OR event_id % 3 > 0 OR CAST(time AS DATE) IN (DATE '2024-01-11', DATE '2024-01-14') GROUP BY 1, 2""")
def str4_hours_refreshed(spark, d):
    from datetime import date

    root = _store(spark, d)
    store.refresh_hours(spark, root, STORE_SCHEMA, _hour_sums, [date(2024, 1, 11), date(2024, 1, 14)])
    return store.hours_of(spark, root, STORE_SCHEMA, _hour_sums)


# metrics


SCORED_SQL = "scored AS (SELECT l.doc_id, quality AS y, n_chars AS s, n_chars % 2 AS f FROM labels l JOIN documents USING (doc_id))"


def _scored(spark, d):
    return fx.table(spark, d, "labels").join(fx.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("y"), F.col("n_chars").alias("s"), (F.col("n_chars") % 2).alias("f"))


@query(f", {SCORED_SQL} SELECT f, count(*) AS n, round(avg(abs(s / 1000.0 - y)), 6) AS mae, round(avg(s / 1000.0 - y), 6) AS bias, round(quantile_cont(abs(s / 1000.0 - y), 0.5), 6) AS p50 FROM scored GROUP BY 1")
def met1_errors(spark, d):
    out = metrics.error_summary(_scored(spark, d).withColumn("p", F.col("s") / 1000.0), "y", "p", ["f"])
    return out.select("f", "n", *[F.round(c, 6).alias(c) for c in ("mae", "bias", "p50")])


@query(f", {SCORED_SQL}, r AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS a, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS b FROM scored) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r")
def met2_spearman(spark, d):
    return metrics.spearman(_scored(spark, d), "y", "s").withColumn("rho", F.round("rho", 6))


@query(f", {SCORED_SQL}, g AS (SELECT s, sum(y) AS tp, count(*) AS n FROM scored GROUP BY 1), c AS (SELECT tp, sum(tp) OVER w / (sum(n) OVER w)::DOUBLE AS p FROM g WINDOW w AS (ORDER BY s DESC)) SELECT round(sum(tp * p) / sum(tp), 6) AS ap FROM c")
def met3_average_precision(spark, d):
    return metrics.average_precision(_scored(spark, d), "y", "s").withColumn("ap", F.round("ap", 6))


@query(f", {SCORED_SQL} SELECT round(avg(y), 6) AS precision FROM (SELECT y FROM scored ORDER BY s DESC, doc_id LIMIT 50) z")
def met4_precision_at_k(spark, d):
    return metrics.precision_at_k(_scored(spark, d), "y", "s", 50, "doc_id").withColumn("precision", F.round("precision", 6))


@query(f""", {SCORED_SQL}, p AS (SELECT y AS a, f AS b, count(*) AS n FROM scored GROUP BY 1, 2), t AS (SELECT sum(n) AS n, sum(n) FILTER (a = b) AS s FROM p),
  e AS (SELECT sum(l * r) AS e FROM (SELECT a AS c, sum(n) AS l FROM p GROUP BY 1) x JOIN (SELECT b AS c, sum(n) AS r FROM p GROUP BY 1) z USING (c))
  SELECT round(s / n::DOUBLE, 6) AS agreement, round((s / n::DOUBLE - e / (n * n)::DOUBLE) / (1 - e / (n * n)::DOUBLE), 6) AS kappa FROM t, e""")
def met9_kappa(spark, d):
    return metrics.cohen_kappa(_scored(spark, d), "y", "f").select(F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query("""SELECT round(sum(bad) FILTER (fifth = 1) / (count(*) FILTER (fifth = 1))::DOUBLE / (sum(bad) FILTER (fifth = 5) / (count(*) FILTER (fifth = 5))::DOUBLE), 6) AS lift FROM
  (SELECT (crack_mil > 800)::INT AS bad, CASE WHEN count(*) OVER (PARTITION BY rid) < 30 THEN 0 ELSE CAST(ceil(5 * row_number() OVER (PARTITION BY rid ORDER BY rating, seg_id) / (count(*) OVER (PARTITION BY rid))::DOUBLE) AS INTEGER) END AS fifth FROM pred) z""")
def agg19_lift(spark, d):
    p = ranking.ntile_by_rank(fx.predictions(spark, d), "rating", 5, ["rid"], "seg_id", 30, "fifth")
    p = p.select("fifth", (F.col("crack_mil") > 800).cast("int").alias("bad"), F.lit(1).alias("one"))
    return metrics.lift(p, "fifth", "bad", "one").withColumn("lift", F.round("lift", 6))


@query("""SELECT label, k, round(avg(v), 6) AS mean FROM (SELECT label, unnest(range(0, len(e))) AS k, unnest(e) AS v FROM (SELECT label, embedding AS e FROM embeddings) x) z GROUP BY 1, 2""")
def mod7_mean_of_views(spark, d):
    e = fx.table(spark, d, "embeddings")
    vec = next(f.name for f in e.schema if f.dataType.typeName() == "array")
    return e.select("label", F.posexplode(vec).alias("k", "v")).groupBy("label", "k").agg(F.round(F.avg("v"), 6).alias("mean"))


# ground samples and models


@query("SELECT pt_id AS pt, z FROM pt LEFT JOIN (SELECT CAST(floor(mid_x / 250) AS BIGINT) AS c, CAST(floor(mid_y / 250) AS BIGINT) AS r, max(rating) AS z FROM seg GROUP BY 1, 2) g ON c = CAST(floor((200000 + (pt_id * 31) % 60000) / 250) AS BIGINT) AND r = CAST(floor((100000 + (pt_id * 17) % 60000) / 250) AS BIGINT)")
def ras1_sample_nearest(spark, d):
    cells = fx.segments(spark, d).groupBy(F.floor(F.col("mid_x") / 250).alias("col"), F.floor(F.col("mid_y") / 250).alias("row")).agg(F.max("rating").alias("z"))
    pts = fx.points(spark, d).select(F.col("pt_id").alias("pt"), (200000 + (F.col("pt_id") * 31) % 60000).alias("x"), (100000 + (F.col("pt_id") * 17) % 60000).alias("y"))
    return depth.sample_nearest(cells, pts, 250)


@query()
def mod1_oof(spark, d):
    p = fx.predictions(spark, d).withColumn("fold", keys.fold_of(keys.block_id(F.col("mid_x"), F.col("mid_y"))))
    p = p.withColumn("wear", (100 - F.col("rating")) / F.col("age"))
    return models.oof(p, "seg_id", ["age", "crack_mil", "flood_mil"], [], "wear", "rate")


@query()
def mod6_pca(spark, d):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = fx.table(spark, d, "embeddings")
    vec = next(f.name for f in e.schema if f.dataType.typeName() == "array")
    out = models.centred_pca(e.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>"))), "_v", 16)
    return out.select(*[c for c in e.columns if c != vec], vector_to_array("pca").alias("pca"))


@query("""SELECT rid, n, coverage, seg_id FROM (SELECT rid, count(*) AS n, round(least(sum(coalesce(ov, 0)) / sum(len)::DOUBLE, 1), 6) AS coverage, arg_min(seg_id, (coalesce(ytp_milli, 1000000), seg_id)) AS seg_id FROM
  (SELECT rid, seg_id, len, ytp_milli, ov FROM pred LEFT JOIN
   (SELECT seg_id, sum(least("end", pe) - greatest(beg, pb)) AS ov FROM seg JOIN piece USING (rid) WHERE greatest(beg, pb) < least("end", pe) GROUP BY 1) o USING (seg_id)) z GROUP BY 1) y""")
def flagship_route_worklist(spark, d):
    s = fx.segments(spark, d)
    ov = linref.interval_overlaps(s, fx.pieces(spark, d)).groupBy("seg_id").agg(F.sum("ov").alias("ov"))
    p = fx.predictions(spark, d).select("seg_id", "rid", "len", "ytp_milli").join(ov, "seg_id", "left")
    covered = F.least(F.sum(F.coalesce("ov", F.lit(0))) / F.sum("len"), F.lit(1.0))
    first = F.min(F.struct(F.coalesce("ytp_milli", F.lit(1000000)).alias("y"), "seg_id"))["seg_id"]
    return p.groupBy("rid").agg(F.count("*").alias("n"), F.round(covered, 6).alias("coverage"), first.alias("seg_id"))


# sets, lists and shares


@query("SELECT source, count(*) AS n, count(DISTINCT x) AS places FROM (SELECT source, x FROM report UNION ALL SELECT 'segment', mid_x FROM seg) z GROUP BY 1")
def set1_union_evidence(spark, d):
    s = fx.segments(spark, d).select(F.lit("segment").alias("source"), F.col("mid_x").alias("x"))
    both = fx.reports(spark, d).select("source", "x").unionByName(s, allowMissingColumns=True)
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("x").alias("places"))


@query("SELECT rid, 'both' AS side FROM (SELECT rid FROM seg INTERSECT SELECT rid FROM pt) a UNION ALL SELECT rid, 'left' FROM (SELECT rid FROM seg EXCEPT SELECT rid FROM pt) b")
def set2_key_sets(spark, d):
    a, b = fx.segments(spark, d).select("rid"), fx.points(spark, d).select("rid")
    return a.intersect(b).withColumn("side", F.lit("both")).unionAll(a.subtract(b).withColumn("side", F.lit("left")))


@query("SELECT camera_id, event_id, row_number() OVER (PARTITION BY camera_id ORDER BY event_id) AS turn FROM reading WHERE p_mil >= 900")
def win16_round_robin(spark, d):
    return ranking.round_robin(fx.readings(spark, d).where("p_mil >= 900").select("camera_id", "event_id"), "camera_id", "event_id").withColumn("turn", F.col("turn").cast("long"))


@query("SELECT count(*) FILTER (crack_mil <= 300) AS n FROM pred WHERE crack_mil <= 1000")
def agg13_count_at_most(spark, d):
    h = ranking.histogram(fx.predictions(spark, d).where("crack_mil <= 1000"), "crack_mil", 50, 1000)
    counts = F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"])
    return h.agg(counts.alias("h")).select(ranking.count_at_most(F.col("h"), 50, 300).alias("n"))


@query("""SELECT bucket, coalesce(a.n, 0) AS cameras, coalesce(b.n, 0) AS reports FROM (SELECT date_trunc('month', time) AS bucket, count(*) AS n FROM reading GROUP BY 1) a
  FULL JOIN (SELECT date_trunc('month', time) AS bucket, count(*) AS n FROM report GROUP BY 1) b USING (bucket)""")
def jon15_full_outer(spark, d):
    month = F.date_trunc("month", "time").alias("bucket")
    a = fx.readings(spark, d).groupBy(month).agg(F.count("*").alias("cameras"))
    b = fx.reports(spark, d).groupBy(month).agg(F.count("*").alias("reports"))
    return a.join(b, "bucket", "full").select("bucket", F.coalesce("cameras", F.lit(0)).alias("cameras"), F.coalesce("reports", F.lit(0)).alias("reports"))


# reports that hold scores against what was seen


CHECK_SQL = """, long AS (SELECT seg_id, CASE WHEN rid % 3 = 0 THEN 'raleigh' ELSE 'charlotte' END AS city, age % 3 AS band, flood_mil % 7 AS events, age AS exposure, unnest(['rating', 'crack']) AS score,
  unnest([100 - rating, crack_mil]) AS s FROM pred),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY city, score ORDER BY s, seg_id) AS r, count(*) OVER (PARTITION BY city, score) AS n,
    row_number() OVER (PARTITION BY city, score, band ORDER BY s, seg_id) AS rb, count(*) OVER (PARTITION BY city, score, band) AS nb FROM long),
  cut AS (SELECT *, CASE WHEN n < 50 THEN 0 ELSE ceil(5 * r / n::DOUBLE) END AS f, CASE WHEN nb < 50 THEN 0 ELSE ceil(5 * rb / nb::DOUBLE) END AS fb FROM ranked)"""


def _checked(spark, d):
    p = fx.predictions(spark, d)
    pairs = F.array(F.struct(F.lit("rating").alias("score"), (100 - F.col("rating")).cast("long").alias("s")), F.struct(F.lit("crack").alias("score"), F.col("crack_mil").cast("long").alias("s")))
    city = F.when(F.col("rid") % 3 == 0, "raleigh").otherwise("charlotte").alias("city")
    long = p.select("seg_id", city, (F.col("age") % 3).alias("band"), (F.col("flood_mil") % 7).alias("events"), F.col("age").alias("exposure"), keys.block_id(F.col("mid_x"), F.col("mid_y")).alias("block"), F.explode(pairs).alias("p"))
    return long.select("*", "p.*").drop("p")


@query(f"""{CHECK_SQL} SELECT city, score, count(*) AS n, CAST(sum(events) AS BIGINT) AS events, CAST(sum(exposure) AS BIGINT) AS exposure, count(*) FILTER (fb = 0) AS n_left_out,
  round(sum(events) FILTER (f = 5) / (sum(exposure) FILTER (f = 5))::DOUBLE / (sum(events) FILTER (f = 1) / (sum(exposure) FILTER (f = 1))::DOUBLE), 6) AS raw_lift,
  round(sum(events) FILTER (fb = 5) / (sum(exposure) FILTER (fb = 5))::DOUBLE / (sum(events) FILTER (fb = 1) / (sum(exposure) FILTER (fb = 1))::DOUBLE), 6) AS adjusted_lift FROM cut GROUP BY 1, 2""")
def qry7_report_check(spark, d):
    out = checks.report_check(_checked(spark, d), ["city", "score"], "band", "s", "events", "exposure", "seg_id")
    return out.withColumns({c: F.round(c, 6) for c in ("raw_lift", "adjusted_lift")})


@query(f"""{CHECK_SQL}, g AS (SELECT score, unnest([city, 'all']) AS roads, s, seg_id, (events > 4)::INT::DOUBLE AS hit FROM long),
  t AS (SELECT *, ceil(3 * row_number() OVER (PARTITION BY score, roads ORDER BY s, seg_id) / (count(*) OVER (PARTITION BY score, roads))::DOUBLE) AS third FROM g)
  SELECT score, roads, count(*) AS n, count(*) < 30 AS too_few, round(avg(hit), 6) AS share_damaged, round(avg(hit) FILTER (third = 3), 6) AS worst_third, round(avg(hit) FILTER (third = 1), 6) AS best_third,
  round(avg(hit) FILTER (third = 3) / avg(hit) FILTER (third = 1), 6) AS ratio FROM t GROUP BY 1, 2""")
def qry8_camera_check(spark, d):
    graded = _checked(spark, d).withColumnRenamed("city", "roads").withColumn("hit", F.col("events") > 4)
    out = checks.damage_shares(graded, "score", "roads", "s", "hit", "seg_id")
    return out.withColumns({c: F.round(c, 6) for c in ("share_damaged", "worst_third", "best_third", "ratio")})


@query("""SELECT camera_id, min(file) AS file, arg_min(damage, file) AS damage FROM (SELECT doc_id % 97 AS camera_id, doc_id AS file, CASE WHEN toxic = 1 THEN 'pothole' WHEN doc_id % 5 = 0 THEN 'cant_tell' ELSE 'none' END AS damage
  FROM labels WHERE quality = 1) z WHERE damage <> 'cant_tell' GROUP BY 1""")
def met10_decided(spark, d):
    labels = fx.table(spark, d, "labels")
    damage = F.when(F.col("toxic") == 1, "pothole").when(F.col("doc_id") % 5 == 0, "cant_tell").otherwise("none")
    view = F.when(F.col("quality") == 1, "clear").otherwise("unusable")
    grades = labels.select((F.col("doc_id") % 97).alias("camera_id"), F.col("doc_id").alias("file"), F.lit(1).alias("pass"), view.alias("view"), F.when(F.col("quality") == 1, damage).otherwise("").alias("damage"))
    return checks.decided(grades)


STATS = ("orders", "lineitem", "events", "documents", "pages")


@query(" SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows FROM {t}" for t in STATS) + ") z")
def str14_table_stats(spark, d):
    return checks.table_stats({t: fx.table(spark, d, t) for t in STATS}).select("table", "n_rows")


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders")
def src1_read_table(spark, d):
    return readers.read_table(spark, f"{d}/orders.parquet", ["o_orderkey", "o_custkey", "o_orderdate"])
