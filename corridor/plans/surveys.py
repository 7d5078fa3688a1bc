"""Queries over chips, surveyed marks and compared models, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corridor.functions import keys
from corridor.operators import ablation, chips, depth, depth_checks
from corridor.plans import fixtures as fx
from corridor.plans.queries import query

# chips: the 64 values of an embedding as four bands of four by four bytes

CHIP_SQL = """, chip AS (SELECT vec_id, [CAST(floor(abs(CAST(v AS DOUBLE)) * 1000) AS BIGINT) % 256 FOR v IN embedding] AS b FROM embeddings)"""


def _chips(spark, d):
    byte = lambda v: F.lpad(F.hex(F.pmod(F.floor(F.abs(v.cast("double")) * 1000), F.lit(256))), 2, "0")
    return fx.table(spark, d, "embeddings").select("vec_id", F.unhex(F.array_join(F.transform("embedding", byte), "")).alias("chip"))


@query(f"""{CHIP_SQL}, px AS (SELECT vec_id, b[i] AS red, b[16 + i] AS green, b[32 + i] AS blue, b[48 + i] AS nir FROM chip, unnest(range(1, 17)) AS r(i)),
  v AS (SELECT *, CASE WHEN nir + red = 0 THEN 0 ELSE (nir - red) / (nir + red)::DOUBLE END AS ndvi, red + green + blue + nir = 0 AS blank FROM px)
  SELECT vec_id, round(avg(ndvi), 6) AS ndvi_mean, round(stddev_pop(ndvi), 6) AS ndvi_std, avg((ndvi < 0.1)::INT) AS impervious, round(var_pop((red + green + blue) / 3::DOUBLE), 4) AS bright_var,
  avg(blank::INT) AS blank, avg(blank::INT) <= 0.05 AS usable FROM v GROUP BY 1""")
def img1_chip_stats(spark, d):
    return chips.chip_stats(_chips(spark, d), "vec_id").withColumns({"ndvi_mean": F.round("ndvi_mean", 6), "ndvi_std": F.round("ndvi_std", 6), "bright_var": F.round("bright_var", 4)})


@query(f"""{CHIP_SQL}, spot AS (SELECT view, r, c, CASE view % 4 WHEN 0 THEN r WHEN 1 THEN c WHEN 2 THEN 3 - r ELSE 3 - c END AS sr, CASE view % 4 WHEN 0 THEN c WHEN 1 THEN 3 - r WHEN 2 THEN 3 - c ELSE r END AS sc
    FROM unnest(range(8)) AS a(view), unnest(range(4)) AS b(r), unnest(range(4)) AS e(c)),
  moved AS (SELECT view, band * 16 + r * 4 + c AS i, band * 16 + sr * 4 + CASE WHEN view >= 4 THEN 3 - sc ELSE sc END + 1 AS src FROM spot, unnest(range(4)) AS k(band))
  SELECT vec_id, CAST(view AS INTEGER) AS view, string_agg(printf('%02X', b[src]), '' ORDER BY i) AS chip FROM chip, moved GROUP BY 1, 2""")
def img2_expand_views(spark, d):
    return chips.expand_views(_chips(spark, d), "vec_id").withColumn("chip", F.hex("chip"))


@query()
def img3_augment(spark, d):
    return chips.augment(_chips(spark, d), "vec_id", 42, 1, chips.PRESETS["full"]).withColumn("chip", F.hex("chip"))


TILE_SQL = ", tile AS (SELECT s_suppkey AS tile, 200000 + s_suppkey * 7919 % 60000 AS x0, 100000 + s_suppkey * 6271 % 60000 AS y0 FROM supplier)"


def _plan(spark, d):
    s = F.col("s_suppkey")
    x0, y0 = 200000 + s * 7919 % 60000, 100000 + s * 6271 % 60000
    tiles = fx.table(spark, d, "supplier").select(s.alias("tile"), x0.alias("x0"), y0.alias("y0"), (x0 + 6000).alias("x1"), (y0 + 7000).alias("y1"))
    return chips.chip_plan(fx.segments(spark, d).select("seg_id", F.col("mid_x").alias("x"), F.col("mid_y").alias("y")), tiles, "seg_id")


@query(f"{TILE_SQL} SELECT seg_id, mid_x AS x, mid_y AS y, min(tile) AS tile FROM seg LEFT JOIN tile ON mid_x BETWEEN x0 AND x0 + 6000 AND mid_y BETWEEN y0 AND y0 + 7000 GROUP BY 1, 2, 3")
def img4_chip_plan(spark, d):
    return _plan(spark, d)


@query(f"""{TILE_SQL} SELECT count(*) AS total, count(tile) AS with_tile, count(*) - count(tile) AS without_tile FROM
  (SELECT seg_id, min(tile) AS tile FROM seg LEFT JOIN tile ON mid_x BETWEEN x0 AND x0 + 6000 AND mid_y BETWEEN y0 AND y0 + 7000 GROUP BY 1) z""")
def img4_chip_census(spark, d):
    return chips.chip_census(_plan(spark, d))


# surveyed marks: a customer is a straight stream, its orders are marks along it

MARK_SQL = """, m0 AS (SELECT o_custkey AS stream, o_orderkey AS mark, sum(o_orderkey * 31 % 400 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS y FROM orders),
  mark AS (SELECT *, (y // 2 + mark * 13 % 100) / 100.0::DOUBLE AS z, mark % 10 <> 0 AS draws FROM m0)"""


def _marks(spark, d):
    from pyspark.sql import Window

    o = F.col("o_orderkey")
    y = F.sum(o * 31 % 400 + 1).over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    m = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("stream"), o.alias("mark"), o.alias("order_key"), (F.col("o_custkey") * 2000).cast("double").alias("x"), y.alias("_y"))
    z = (F.floor(F.col("_y") / 2) + F.col("mark") * 13 % 100) / 100.0
    return m.withColumns({"y": F.col("_y").cast("double"), "z": z, "draws": F.col("mark") % 10 != 0}).drop("_y")


def _surveyed(spark, d):
    """Marks with taped depths at every fourth, and ground under them of two kinds."""
    m, k = _marks(spark, d), F.col("mark")
    tape = F.when(k % 4 == 0, (k % 50) / 20.0)
    ground = F.col("z") - (k % 50) / 20.0 + (k * 7 % 21 - 10) / 100.0
    return m.withColumns({"tape": tape, "ground": ground, "ground30": ground + (k * 11 % 41 - 20) / 20.0})


# On a straight line the guess is between the two nearest marks left, or one of them up to 100 m past the end.
HIDDEN_SQL = f"""{MARK_SQL}, held AS (SELECT stream, mark, y, z, unnest([0, 250, 500]) AS stretch FROM mark WHERE draws UNION ALL SELECT stream, mark, y, z, -1 FROM mark WHERE NOT draws),
  side AS (SELECT h.stream, h.mark, h.stretch, h.y, h.z, max(CASE WHEN m.y < h.y THEN m.y END) AS ya, min(CASE WHEN m.y > h.y THEN m.y END) AS yb, arg_max(m.z, m.y) FILTER (m.y < h.y) AS za, arg_min(m.z, m.y) FILTER (m.y > h.y) AS zb
    FROM held h LEFT JOIN mark m ON m.stream = h.stream AND m.draws AND m.mark <> h.mark AND (h.stretch <= 0 OR abs(m.y - h.y) > h.stretch) GROUP BY 1, 2, 3, 4, 5),
  g AS (SELECT stream, mark, stretch, z, least(y - ya, yb - y)::DOUBLE AS along,
    CASE WHEN ya IS NULL AND yb - y <= 100 THEN zb WHEN yb IS NULL AND y - ya <= 100 THEN za
    WHEN ya IS NOT NULL AND yb IS NOT NULL AND least(y - ya, yb - y) <= 1000 AND least(y - ya, yb - y) * abs(zb - za) / (yb - ya)::DOUBLE <= 2 THEN za + (y - ya) / (yb - ya)::DOUBLE * (zb - za) END AS guess FROM side),
  hidden AS (SELECT stream, mark, CAST(stretch AS INTEGER) AS stretch, guess, CASE WHEN guess IS NOT NULL THEN along END AS along, guess - z AS miss FROM g)"""


@query(f"{HIDDEN_SQL} SELECT stream, mark, stretch, round(guess + 1e-9, 6) AS guess, round(along + 1e-9, 6) AS along, round(miss + 1e-9, 6) AS miss FROM hidden")
def dep9_hidden_marks(spark, d):
    out = depth_checks.hidden_mark_test(_marks(spark, d))
    return out.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("guess", "along", "miss")})  # away from halves


@query(f"""{HIDDEN_SQL}, banded AS (SELECT *, CASE WHEN along <= 100 THEN 0 WHEN along <= 250 THEN 100 WHEN along <= 500 THEN 250 WHEN along <= 1000 THEN 500 END AS lo FROM hidden WHERE stretch >= 0 AND guess IS NOT NULL),
  once AS (SELECT stream, mark, lo, abs(arg_min(miss, stretch)) AS a FROM banded WHERE lo IS NOT NULL GROUP BY 1, 2, 3), b AS (SELECT unnest([0, 100, 250, 500]) AS lo, unnest([100, 250, 500, 1000]) AS hi)
  SELECT lo, hi, count(a) AS n, round(median(a), 6) AS median, round(quantile_cont(a, 0.9), 6) AS p90, count(a) < 30 AS too_few FROM b LEFT JOIN once USING (lo) GROUP BY 1, 2""")
def dep10_band_table(spark, d):
    out = depth_checks.band_table(depth_checks.hidden_mark_test(_marks(spark, d)))
    return out.withColumns({c: F.round(c, 6) for c in ("median", "p90")})


TAPE_SQL = f"""{HIDDEN_SQL}, taped AS (SELECT *, (mark % 50) / 20.0::DOUBLE AS tape, z - (mark % 50) / 20.0::DOUBLE + (mark * 7 % 21 - 10) / 100.0::DOUBLE AS ground FROM mark WHERE mark % 4 = 0)"""


@query(f"""{TAPE_SQL}, t AS (SELECT 'own level' AS test, z - ground AS d, tape FROM taped UNION ALL SELECT 'end to end', guess - ground, tape FROM taped JOIN hidden USING (stream, mark) WHERE draws AND stretch = 0 AND guess IS NOT NULL)
  SELECT test, count(*) AS n, round(median(abs(d - tape)), 6) AS median, round(quantile_cont(abs(d - tape), 0.75), 6) AS p75, round(quantile_cont(abs(d - tape), 0.9), 6) AS p90, round(median(d - tape), 6) AS bias, round(corr(d, tape), 6) AS corr FROM t GROUP BY 1""")
def dep10_tape_tests(spark, d):
    m = _surveyed(spark, d)
    out = depth_checks.tape_tests(m, depth_checks.hidden_mark_test(m.select("stream", "mark", "order_key", "x", "y", "z", "draws")))
    return out.withColumns({c: F.round(c, 6) for c in ("median", "p75", "p90", "bias", "corr")})


@query(f"""{HIDDEN_SQL}, s AS (SELECT *, CASE WHEN mark % 4 = 0 THEN (mark % 50) / 20.0::DOUBLE END AS tape, z - (mark % 50) / 20.0::DOUBLE + (mark * 7 % 21 - 10) / 100.0::DOUBLE AS ground FROM mark),
  c AS (SELECT *, ground + (mark * 11 % 41 - 20) / 20.0::DOUBLE AS ground30 FROM s)
  SELECT round(median(z - ground) FILTER (draws), 6) AS water_over_ground, count(tape) AS n_taped, round(median(abs(z - ground - tape)), 6) AS miss_fine, round(median(abs(z - ground30 - tape)), 6) AS miss_coarse,
  (SELECT count(*) FROM hidden WHERE stretch = 0 AND guess IS NOT NULL) AS n_guessed FROM c""")
def dep11_gate_report(spark, d):
    m = _surveyed(spark, d)
    out = depth_checks.gate_report(m, depth_checks.hidden_mark_test(m.select("stream", "mark", "order_key", "x", "y", "z", "draws")))
    return out.withColumns({c: F.round(c, 6) for c in ("water_over_ground", "miss_fine", "miss_coarse")})


ASIDE_SQL = """, g AS (SELECT camera_id AS seg_id, CAST(row_number() OVER (PARTITION BY camera_id ORDER BY time, event_id) AS INTEGER) AS step, depth_cm / 10.0::DOUBLE AS ground, p_mil < 50 AS bridge FROM reading),
  n AS (SELECT *, lag(ground) OVER w AS a1, lead(ground) OVER w AS b1, lag(ground, 2) OVER w AS a2, lead(ground, 2) OVER w AS b2 FROM g WINDOW w AS (PARTITION BY seg_id ORDER BY step)),
  s AS (SELECT *, bridge OR coalesce(a1 - ground >= 3 AND b1 - ground >= 3, false) OR coalesce(a2 - ground >= 3 AND b2 - ground >= 3, false) AS seed, coalesce(b1 - ground > 2, false) AS up, coalesce(a1 - ground > 2, false) AS down FROM n),
  far AS (SELECT p.seg_id, p.step FROM s p JOIN s q ON p.seg_id = q.seg_id AND q.seed AND q.step <> p.step JOIN s r ON r.seg_id = p.seg_id AND r.step BETWEEN least(p.step, q.step) AND greatest(p.step, q.step)
    GROUP BY p.seg_id, p.step, q.step HAVING bool_and(CASE WHEN q.step < p.step THEN r.up ELSE r.down END))"""


@query(f"{ASIDE_SQL} SELECT seg_id, step, seed OR (seg_id, step) IN (SELECT (seg_id, step) FROM far) AS aside FROM s")
def dep5_set_aside(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("camera_id").orderBy("time", "event_id"))
    g = fx.readings(spark, d).select(F.col("camera_id").alias("seg_id"), place.alias("step"), (F.col("depth_cm") / 10.0).alias("ground"), (F.col("p_mil") < 50).alias("bridge"), F.lit(30.0).alias("step_m"))
    return depth.set_aside(g, F.col("bridge"), ["seg_id"], "step").select("seg_id", "step", "aside")


# compared models


def _folded(spark, d):
    p = fx.predictions(spark, d).withColumn("block", keys.block_id(F.col("mid_x"), F.col("mid_y")))
    return p.withColumns({"fold": keys.fold_of(F.col("block")), "wear": (100 - F.col("rating")) / F.col("age"), "bad": (F.col("rating") < 25).cast("int"), "place": F.when(F.col("mid_x") < 240000, "west").otherwise("east")})


@query()
def mod3_ablation(spark, d):
    ladder = [("age", ["age"]), ("+ cracks", ["age", "crack_mil"]), ("+ flood", ["age", "crack_mil", "flood_mil"])]
    return ablation.ablation(_folded(spark, d), "seg_id", ladder, "bad", "yes", "block")


@query()
def qry9_traffic_crash_ablation(spark, d):
    from corridor.operators import linref

    s = fx.segments(spark, d)
    traffic = linref.interval_overlaps(s, fx.pieces(spark, d)).groupBy("seg_id").agg(F.max("cnt").alias("traffic"))
    crashes = linref.points_on_segments(s, fx.points(spark, d), "pt_id").where("seg_id is not null").groupBy("seg_id").agg(F.count("*").alias("crashes"))
    df = _folded(spark, d).join(traffic, "seg_id", "left").join(crashes, "seg_id", "left").withColumn("crashes", F.coalesce("crashes", F.lit(0)))
    ladder = [("map", ["age"]), ("+ traffic", ["age", "traffic"]), ("+ crashes", ["age", "crashes"]), ("+ both", ["age", "traffic", "crashes"])]
    df = df.withColumns({"cracked": (F.col("crack_mil") >= 850).cast("int"), "failed": F.when(F.col("in_zone"), (F.col("flood_mil") >= 900).cast("int"))})
    targets = {"rate": ("wear", "rate"), "crack": ("cracked", "yes"), "flood": ("failed", "yes")}
    return ablation.ablations(df, "seg_id", ladder, targets, "block", draws=300)


@query()
def mod4_rescale(spark, d):
    p = fx.predictions(spark, d)
    road = (F.col("rid") % 5).cast("int")
    df = p.select("seg_id", road.alias("road"), F.when(F.col("rating") > 0, F.col("rating") * 100.0).alias("est"), F.when(F.col("crack_mil") % 4 == 0, F.col("rating") * (50.0 + F.col("crack_mil") % 100)).alias("counted"))
    return ablation.rescale(df, "est", "counted", "road")


@query()
def mod8_transfer(spark, d):
    return ablation.transfer_test(_folded(spark, d), "seg_id", ["age", "crack_mil", "flood_mil"], ["age"], "bad", "place", "west", "east", F.col("age") < 11, "crack_mil")
