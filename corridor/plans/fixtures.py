"""Road tables derived from the given ones: segments on routes, pieces, points, reports, readings, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corridor.functions.geo import line_of
from corridor.functions.measures import depth_on_road


def sql_distance(px: str, py: str, a: tuple[str, str], b: tuple[str, str]) -> str:
    """SQL for the distance from a point to the piece from a to b."""
    dx, dy = f"({b[0]} - {a[0]})", f"({b[1]} - {a[1]})"
    t = f"coalesce(greatest(least((({px} - {a[0]}) * {dx} + ({py} - {a[1]}) * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0), 1), 0), 0)"
    return f"sqrt(pow({px} - {a[0]} - {t} * {dx}, 2) + pow({py} - {a[1]} - {t} * {dy}, 2))"


def sql_line_distance(px: str, py: str) -> str:
    return f"least({sql_distance(px, py, ('ax', 'ay'), ('bx', 'b_y'))}, {sql_distance(px, py, ('bx', 'b_y'), ('cx', 'cy'))})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").repartition("l_partkey")  # one shuffle for the copies and for the windows over parts
    return li.groupBy("l_partkey", "l_orderkey", "l_linenumber").agg(
        F.min("l_suppkey").alias("l_suppkey"), F.min("l_quantity").cast("long").alias("q"), F.min("l_shipdate").alias("sd"), F.round(F.min("l_extendedprice")).cast("long").alias("px")
    )


def _before(size, *order: str):
    w = Window.partitionBy("l_partkey").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _lines(spark, sf_dir).withColumn("len", F.col("q") * 20)
    df = df.withColumn("beg", _before(F.col("len"), "l_orderkey", "l_linenumber"))
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    return df.select(
        F.concat(F.lit("ncdot:"), (F.col("l_partkey") + 40000000).cast("string"), F.lpad((F.col("l_suppkey") % 100 + 1).cast("string"), 3, "0"), F.lit(":"), F.col("beg").cast("string")).alias("seg_id"),
        F.col("l_partkey").alias("rid"),
        "beg",
        (F.col("beg") + F.col("len")).alias("end"),
        "len",
        (200000 + (o * 7919 + n * 104729) % 60000).alias("mid_x"),
        (100000 + (o * 6271 + n * 15485863) % 60000).alias("mid_y"),
        (F.col("px") % 101).alias("rating"),
        (F.year("sd") - 1992 + 2).cast("long").alias("age"),
    )


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _lines(spark, sf_dir).withColumn("w", 100 + F.col("px") % 700)
    df = df.withColumn("pb", _before(F.col("w"), "sd", "l_orderkey", "l_linenumber"))
    return df.select(F.col("l_partkey").alias("rid"), "pb", (F.col("pb") + F.col("w")).alias("pe"), (F.col("px") % 500).alias("cnt"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        o.alias("pt_id"), (F.col("o_custkey") % 2000).alias("rid"), ((o * 37) % 16000).alias("mp"), F.when(o % 4 == 0, "K").otherwise("A").alias("sev")
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        o.alias("report_id"), F.when(o % 3 == 0, "raleigh").otherwise("charlotte").alias("source"), F.col("o_orderdate").cast("timestamp").alias("time"),
        (200000 + (o * 7919 + c * 31) % 60000).alias("x"), (100000 + (o * 6271 + c * 17) % 60000).alias("y"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("time"), F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("camera_id"),
        (F.floor(F.col("value") * 100) % 1001).cast("long").alias("p_mil"), F.floor("value").cast("long").alias("depth_cm"), (F.col("user_id") % 3 == 0).alias("known_dry"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with a line of three vertices: half its length to either side of its middle, which lies off the chord."""
    half, x, y = F.col("len") / 2, F.col("mid_x").cast("double"), F.col("mid_y").cast("double")
    line = line_of((x - half, y), (x, y + F.col("age") * 5.0), (x + half, y))
    return segments(spark, sf_dir).select("seg_id", (F.col("rid") % 7).alias("route"), line.alias("line"))


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select(u).distinct().select(
        F.concat(F.lit("C"), u.cast("string")).alias("camera_id"), (u % 3 == 0).alias("known_dry"), (u % 7).alias("named_route"),
        (200000 + u * 7919 % 60000).cast("double").alias("x"), (100000 + u * 6271 % 60000).cast("double").alias("y"),
    )


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Water levels of forty stations, some without a road level and some always dry."""
    st = F.col("user_id") % 40
    road = F.when(st % 7 != 0, (100 + st * 3) / 100.0)
    df = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("time"), F.concat(F.lit("S"), st.cast("string")).alias("station"), (F.floor(F.col("value") * 10) % 400 / 100.0).alias("level_m"), road.alias("road_level_m"), (st % 5 == 0).alias("always_dry"))
    return df.withColumn("depth_on_road_cm", depth_on_road(F.col("level_m"), F.col("road_level_m"), F.col("always_dry")))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("rating")
    left = F.least(F.floor((r - 60) * F.col("age") * 1000.0 / F.greatest(100 - r, F.lit(1))).cast("long"), F.lit(50000).cast("long"))
    return segments(spark, sf_dir).select(
        "seg_id", "rid", "mid_x", "mid_y", "rating", "age", F.when(r == 0, None).when(r < 60, F.lit(0).cast("long")).otherwise(left).alias("ytp_milli"),
        ((F.col("rid") * 37 + F.col("beg")) % 1001).alias("crack_mil"), (F.col("mid_x") < 230000).alias("in_zone"),
        ((F.col("rid") * 53 + F.col("beg")) % 1001).alias("flood_mil"), (F.col("rid") % 2 == 0).alias("heldout"), "len",
    )


#: The same derivations for the SQL check.
SQL = """
l0 AS (SELECT l_partkey, l_orderkey, l_linenumber, min(l_suppkey) l_suppkey, CAST(min(l_quantity) AS BIGINT) q,
  min(l_shipdate) sd, CAST(round(min(l_extendedprice)) AS BIGINT) px FROM lineitem GROUP BY l_partkey, l_orderkey, l_linenumber),
l1 AS (SELECT *, q*20 AS len_m, coalesce(sum(q*20) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM l0),
seg AS MATERIALIZED (SELECT concat('ncdot:', CAST(40000000+l_partkey AS VARCHAR), lpad(CAST(l_suppkey%100+1 AS VARCHAR),3,'0'), ':', CAST(CAST(b AS BIGINT) AS VARCHAR)) AS seg_id,
  l_partkey AS rid, CAST(b AS BIGINT) AS beg, CAST(b+len_m AS BIGINT) AS "end", CAST(len_m AS BIGINT) AS len,
  200000 + (l_orderkey*7919 + l_linenumber*104729) % 60000 AS mid_x, 100000 + (l_orderkey*6271 + l_linenumber*15485863) % 60000 AS mid_y,
  px % 101 AS rating, year(sd) - 1992 + 2 AS age FROM l1),
piece AS MATERIALIZED (SELECT rid, b AS pb, b+w AS pe, cnt FROM (SELECT l_partkey rid, px % 500 AS cnt, CAST(100+px%700 AS BIGINT) w,
  CAST(coalesce(sum(100+px%700) OVER (PARTITION BY l_partkey ORDER BY sd, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) b FROM l0) z),
pt AS (SELECT o_orderkey AS pt_id, o_custkey % 2000 AS rid, (o_orderkey*37) % 16000 AS mp, CASE WHEN o_orderkey % 4 = 0 THEN 'K' ELSE 'A' END AS sev FROM orders),
report AS (SELECT o_orderkey AS report_id, CASE WHEN o_orderkey % 3 = 0 THEN 'raleigh' ELSE 'charlotte' END AS source, o_orderdate AS time,
  200000 + (o_orderkey*7919 + o_custkey*31) % 60000 AS x, 100000 + (o_orderkey*6271 + o_custkey*17) % 60000 AS y FROM orders),
reading AS (SELECT event_id, ts AS time, concat('C', CAST(user_id AS VARCHAR)) AS camera_id, CAST(floor(value*100) AS BIGINT) % 1001 AS p_mil,
  CAST(floor(value) AS BIGINT) AS depth_cm, user_id % 3 = 0 AS known_dry FROM events),
pred AS (SELECT seg_id, rid, mid_x, mid_y, rating, age, CASE WHEN rating=0 THEN NULL WHEN rating<60 THEN CAST(0 AS BIGINT)
  ELSE least(CAST(floor((rating-60)*age*1000.0/greatest(100-rating,1)) AS BIGINT), 50000) END AS ytp_milli,
  (rid*37+beg) % 1001 AS crack_mil, mid_x < 230000 AS in_zone, (rid*53+beg) % 1001 AS flood_mil, rid % 2 = 0 AS heldout, len FROM seg),
ln AS (SELECT seg_id, rid % 7 AS route, mid_x - len / 2.0::DOUBLE AS ax, mid_y::DOUBLE AS ay, mid_x::DOUBLE AS bx, mid_y + age * 5.0::DOUBLE AS b_y, mid_x + len / 2.0::DOUBLE AS cx, mid_y::DOUBLE AS cy FROM seg),
lc AS (SELECT ln.*, CAST(floor(bx / 800) AS BIGINT) + i AS gx, CAST(floor(ay / 800) AS BIGINT) + j AS gy FROM ln, unnest([-1, 0, 1]) AS a(i), unnest([-1, 0, 1]) AS b(j)),
camera AS (SELECT DISTINCT concat('C', CAST(user_id AS VARCHAR)) AS camera_id, user_id % 3 = 0 AS known_dry, user_id % 7 AS named_route, 200000 + user_id * 7919 % 60000 AS x, 100000 + user_id * 6271 % 60000 AS y FROM events),
level0 AS (SELECT event_id, ts AS time, user_id % 40 AS st, CAST(floor(value * 10) AS BIGINT) % 400 / 100.0::DOUBLE AS level_m FROM events),
level AS (SELECT event_id, time, concat('S', CAST(st AS VARCHAR)) AS station, level_m, CASE WHEN st % 7 <> 0 THEN (100 + st * 3) / 100.0::DOUBLE END AS road_level_m,
  CASE WHEN st % 5 = 0 THEN 0 WHEN st % 7 <> 0 THEN greatest((level_m - (100 + st * 3) / 100.0::DOUBLE) * 100, 0) END AS depth_on_road_cm FROM level0),
sg AS (SELECT *, CAST(floor(mid_x / 60) AS BIGINT) + i AS gx, CAST(floor(mid_y / 60) AS BIGINT) + j AS gy FROM seg, unnest([-1, 0, 1]) AS a(i), unnest([-1, 0, 1]) AS b(j)),
near AS (SELECT report_id, seg_id, (mid_x - x) * (mid_x - x) + (mid_y - y) * (mid_y - y) AS dist2 FROM report JOIN sg ON gx = CAST(floor(x / 60) AS BIGINT) AND gy = CAST(floor(y / 60) AS BIGINT))
"""
