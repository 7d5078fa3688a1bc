"""What failed on larger tables: each held to its SQL or to brute force on the rows that showed it."""

import hashlib
import inspect
import math
import random

import pandas as pd
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from corridor.functions import geo, keys
from corridor.operators import ablation, chips, depth, depth_checks, gates, linref, models, near, ranking, spatial, timeseries
from corridor.plans import fixtures as fx
from corridor.plans import queries, surface  # noqa: F401  registers its queries


def rows_joined(df):
    """Rows of ``df``, and how many rows its joins gave out together."""
    rows = df.collect()

    def walk(plan):
        name = plan.nodeName()
        inner = [plan.executedPlan()] if name.startswith("AdaptiveSparkPlan") else [plan.plan()] if "QueryStage" in name else []
        children = plan.children()
        inner += [children.apply(k) for k in range(children.size())]
        own = plan.metrics().get("numOutputRows")
        return (own.get().value() if "Join" in name and own.isDefined() else 0) + sum(map(walk, inner))

    return rows, walk(df._jdf.queryExecution().executedPlan())


def test_road_names_of_numbers_over_five_digits(spark):
    df = spark.createDataFrame([("ncdot:40119999007:940", 119999), ("ncdot:40002748092:940", 2748)], "seg_id string, rid long")
    rows = df.select(keys.route_label(F.col("seg_id"), F.col("rid")), keys.road_name(F.col("seg_id"), F.col("rid")), keys.route_label(F.col("seg_id"))).collect()
    assert tuple(rows[0]) == ("SR 119999", "SR 119999, Beaufort County (mp 940.00)", "SR 19999")
    assert tuple(rows[1]) == ("SR 2748", "SR 2748, Wake County (mp 940.00)", "SR 2748")


def test_fingerprint_of_the_lowest_bits_of_a_place(spark):
    df = spark.range(40).withColumn("v", F.col("id") * 7 % 11)
    own = [int(hashlib.md5(f"={k}|={k * 7 % 11}".encode()).hexdigest()[:12], 16) for k in range(40)]

    def by_hand(bits):
        return "-".join(str(sum(h % p * pow(b, (k + 1) % 2**bits, p) % p for k, h in enumerate(own)) % p) for p, b in zip(gates.MODULI, gates.BASES, strict=True))

    for bits in (3, 5, 24):
        assert tuple(gates.ordered_fingerprint(df.repartition(5), ["id"], bits).first()) == (40, by_hand(bits))
    assert gates.ordered_fingerprint(df, ["id"]).first().h == by_hand(48) != by_hand(5)


def test_the_fingerprint_query_counts_every_bit_of_a_place(spark, sf, monkeypatch):
    taken = []

    def fingerprint(df, order, bits=inspect.signature(gates.ordered_fingerprint).parameters["bits"].default):
        taken.append(bits)
        return df

    monkeypatch.setattr(gates, "ordered_fingerprint", fingerprint)
    queries.QUERIES["qlt9_ordered_fingerprint"](spark, sf)
    steps = queries.ORACLE_SQL["qlt9_ordered_fingerprint"].count(f"list_filter(range({gates.PLACE_BITS})")
    assert taken == [63] and steps == 2


def test_time_of_day_sends_no_readings_to_every_executor(spark):
    at = "timestamp '2024-01-01 23:50:00' + make_interval(0, 0, 0, cast(id % 5 as int), 0, cast(id * 37 % 60 as int), 0)"
    r = spark.range(60).selectExpr("id", "concat('C', id % 3) as camera_id", f"{at} as time", "id % 4 as depth_cm")
    out = timeseries.by_time_of_day(r, r, 20)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    rows = r.selectExpr("id", "camera_id", "to_date(time) as day", "hour(time) * 60 + minute(time) as m", "depth_cm").collect()
    got = {x.id: x for x in out.collect()}
    for a in rows:
        near = [b.depth_cm for b in rows if b.camera_id == a.camera_id and b.day != a.day and min((a.m - b.m) % 1440, (b.m - a.m) % 1440) <= 20]
        assert got[a.id].n_near == len(near) and got[a.id].mean_depth == (sum(near) / len(near) if near else None)


def test_chip_plan_does_not_meet_every_tile(spark):
    tiles = spark.range(400).selectExpr("id as tile", "id * 7 % 40 as x0", "id * 11 % 40 as y0", "id * 7 % 40 + 300 as x1", "id * 11 % 40 + 350 as y1")
    pts = spark.range(500).selectExpr("id", "id * 13 % 450 as x", "id * 29 % 450 as y")
    rows, n = rows_joined(chips.chip_plan(pts, tiles, "id", cell=800))
    box = {r.tile: r for r in tiles.collect()}
    for r in rows:
        assert r.tile == min((k for k, b in box.items() if b.x0 <= r.x <= b.x1 and b.y0 <= r.y <= b.y1), default=None)
    assert n < 60_000  # points with all tiles that hold them are over 100,000


def test_lengths_of_lines_are_worked_out_once(spark):
    line = geo.line_of((F.col("id"), F.lit(0.0)), (F.col("id"), F.lit(3.0)), (F.col("id") + 4, F.lit(3.0)))
    df = spark.range(2).select(line.alias("line"))
    said = lambda c, word: df.select(c.alias("v"))._jdf.queryExecution().analyzed().toString().lower().count(word)
    line = F.col("line")
    assert said(geo.sample_stations(line, 2.0), "hypot") == 1
    assert said(geo.midpoint_of_parts(F.array(line, line)), "array_max") == 1
    assert said(geo.encode_path(line), "round(") == 2
    row = df.select(geo.sample_stations(line, 2.0), geo.encode_path(line, 1.0), geo.midpoint_of_parts(F.array(line, line))).first()
    assert row[0] == [0.0, 1.75, 3.5, 5.25, 7.0] and row[1] == [0, 0, 0, 3, 4, 0] and tuple(row[2]) == (0.5, 3.0)


def test_points_meet_only_segments_that_hold_them(spark):
    segs = spark.range(200).selectExpr("1L as rid", "concat('s', id) as seg_id", "id * 10 as beg", "id * 10 + 10 as end")
    pts = spark.range(100).selectExpr("id as pt", "1L as rid", "id * 20 + 5 as mp")
    rows, n = rows_joined(linref.points_on_segments(segs, pts, "pt"))
    assert {r.pt: r.seg_id for r in rows} == {k: f"s{2 * k}" for k in range(100)} and n == 100


def test_rescale_goes_over_its_rows_twice(spark):
    df = spark.range(300).selectExpr("id", "cast(id % 20 + 1 as double) as est", "if(id % 4 = 0, cast(id % 17 + id % 20 + 1 as double), null) as n", "cast(id % 2 as int) as g")
    out = ablation.rescale(df, "est", "n", "g")
    assert out.count() == 300 and out._jdf.queryExecution().analyzed().toString().count("Range (") == 1
    one = IsotonicRegression(featuresCol="v", labelCol="y", predictionCol="p")
    want = df.where("n is not null and g = 0").selectExpr("log10(est) as v", "log10(n) as y")
    model = one.fit(want)
    got = model.transform(out.where("g = 0").withColumn("v", F.log10("est"))).collect()
    assert all(abs(10**r.p - r.rescaled) < 1e-9 for r in got)


def test_nearest_meets_few_of_a_dense_table(spark, monkeypatch):
    """Copies of a place or a shape ask and answer once, and nothing far is met where something near was found."""
    met = []

    def counted(left, right, *how, _f=spatial.points_within):
        near = _f(left, right, *how)
        met.append(near.count())
        return near

    monkeypatch.setattr(spatial, "points_within", counted)
    pts = spark.range(1200).selectExpr("id % 400 as k", "id", "id % 20 * 3 as x", "int(id % 400 / 20) * 3 as y")
    spots = spark.range(2000).selectExpr("concat('s', id) as s", "id % 400 % 20 * 3 + 1 as px", "int(id % 400 / 20) * 3 as py")
    got = {r.id: (r.s, r.dist2) for r in spatial.nearest_point(pts.select("id", "x", "y"), spots, 60, "id", "s").collect()}
    own = {}
    for k in range(2000):
        own[k % 400] = min(own.get(k % 400, "t"), f"s{k}")
    assert all(got[i] == (own[i % 400], 1) for i in range(1200)) and sum(met) < 10_000  # 1,200 x 2,000 pairs lie within 60


def test_far_points_are_found_in_later_rounds(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 0.0, 55.0), (4, 0.0, 900.0), (5, None, 1.0)], "id long, x double, y double")
    line = geo.line_of((F.lit(-500.0), F.col("id").cast("double")), (F.lit(500.0), F.col("id").cast("double")))
    lines = spark.range(3).select(F.concat(F.lit("l"), F.col("id")).alias("seg_id"), line.alias("line"))
    got = {r.id: (r.seg_id, r.dist) for r in spatial.nearest(pts, lines, 60.0, "id").collect()}
    assert got == {1: ("l0", 0.0), 2: ("l1", 0.0), 3: ("l2", 53.0), 4: (None, None), 5: (None, None)}


def counted(df):
    """``df``, and how many rows of it were worked out in all."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_a_side_table_is_worked_out_once(spark):
    table = spark.range(300).select("id", (F.col("id") * 2).alias("a"))
    side, seen = counted(spark.range(200).select("id", (F.col("id") * 3).alias("b")))
    other, also = counted(spark.range(100).select("id", (F.col("id") * 5).alias("c")))
    got = {r.id: (r.a, r.b, r.c) for r in gates.side_tables(table, "id", side, other).collect()}
    assert got == {k: (2 * k, 3 * k if k < 200 else None, 5 * k if k < 100 else None) for k in range(300)}
    assert (seen.value, also.value) == (200, 100)


def test_labels_to_deal_anew_are_worked_out_once(spark):
    df, seen = counted(spark.range(400).select("id", F.when(F.col("id") % 4 != 0, F.col("id") % 7).alias("y")))
    out = models.shuffled_labels(df, "id", "y", 3).collect()
    assert len(out) == 300 and sorted(r.y for r in out) == sorted(k % 7 for k in range(400) if k % 4)
    assert seen.value == 400


def test_rows_of_few_groups_are_not_dealt_by_group(spark):
    df = spark.range(600).select("id", (F.col("id") % 2).alias("g"), (F.col("id") * 37 % 100).alias("s"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = ranking.ntile_by_rank(df, "s", 5, ["g"], "id", 50, "part")
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan
    for g in (0, 1):
        order = sorted((r.s, r.id, r.part) for r in rows if r.g == g)
        assert [p for _, _, p in order] == [-(-5 * (k + 1) // 300) for k in range(300)]


def test_a_round_of_matches_writes_its_pairs_once(spark, monkeypatch):
    master = spark.createDataFrame([(1, f"m{k}", 100 * k, 100 * k + 50) for k in range(9)], "rid long, master_id string, beg long, end long")
    detail = spark.createDataFrame([(1, f"d{k}", 100 * k + k % 3, 100 * k + 50) for k in range(9)], "rid long, detail_id string, pb long, pe long")
    written, plain = [], linref.checkpointed
    monkeypatch.setattr(linref, "checkpointed", lambda df: (written.append(1), plain(df))[1])
    got = sorted(map(tuple, linref.tolerance_match(master, detail, 5).collect()))
    assert got == [(f"m{k}", f"d{k}", k % 3) for k in range(9)] and len(written) == 2  # the pairs, and one round


def _apart(a, b, p, q):
    """Between two straight pieces that do not cross."""

    def to(u, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = min(max(((u[0] - a[0]) * dx + (u[1] - a[1]) * dy) / (dx * dx + dy * dy), 0.0), 1.0) if dx or dy else 0.0
        return math.hypot(u[0] - a[0] - t * dx, u[1] - a[1] - t * dy)

    return min(to(a, p, q), to(b, p, q), to(p, a, b), to(q, a, b))


PIECE = "stream string, k long, x double, y double, x2 double, y2 double"
ROAD = "seg_id string, line array<struct<x:double,y:double>>"


def test_roads_among_dense_lines_meet_no_piece(spark, monkeypatch):
    monkeypatch.setattr(depth, "piece_distance", lambda *_: F.raise_error(F.lit("a road met a piece")).cast("double"))
    pieces = spark.createDataFrame([("s", k, 13.0 * k, 0.0, 13.0 * k, 900.0) for k in range(60)], PIECE)
    roads = spark.createDataFrame([(f"r{k}", [(10.0 * k, 5.0), (10.0 * k + 5, 400.0 + k), (10.0 * k + 10, 800.0)]) for k in range(60)], ROAD)
    assert depth.candidates(roads, pieces).select("seg_id").distinct().count() == 60


def test_candidates_are_those_of_every_pair(spark):
    rng = random.Random(3)
    xs = [(200.0 + 37 * k, rng.uniform(-3000, 3000)) for k in range(80)]
    pieces = [("s", k, x, y, x, y + rng.uniform(0, 1900)) for k, (x, y) in enumerate(xs)] + [("t", 0, 9000.0, 0.0, 9000.0, 5000.0), ("u", 0, 7000.0, 7000.0, 7000.0, 7000.0), ("v", 0, None, 0.0, 1.0, 0.0)]
    parts = [(p[2:4], p[4:6]) for p in pieces[:80] + pieces[81:82]] + [((9000.0, 0.0), (9000.0, 1000.0)), ((9000.0, 4000.0), (9000.0, 5000.0))]  # the middle of a long one is not live
    roads = {}
    for k in range(500):
        x, y = rng.choice((rng.uniform(-800, 4200), 9000 + rng.uniform(-700, 700), 7000 + rng.uniform(-400, 400))), rng.uniform(-4000, 8000)
        roads[f"r{k}"] = [(x, y), (x + rng.uniform(0, 250), y), (x + 500, y)][: rng.choice((2, 3))]
    roads |= {"at": [(9300.0, 500.0), (9400.0, 500.0)], "past": [(9300.001, 500.0), (9400.0, 500.0)], "dot": [(9000.0, 500.0)]}
    want = {n for n, line in roads.items() if any(_apart(a, b, p, q) <= 300 for a, b in zip(line, line[1:], strict=False) for p, q in parts)}
    want |= {n for n, line in roads.items() for (ax, y), (bx, _) in zip(line, line[1:], strict=False) for (x, y1), (_, y2) in parts if min(ax, bx) <= x <= max(ax, bx) and y1 <= y <= y2}
    rows = [*roads.items(), ("none", None), ("at", [(99000.0, 0.0), (99030.0, 0.0)])]
    got = [(r.seg_id, r.step) for r in depth.candidates(spark.createDataFrame(rows, ROAD), spark.createDataFrame(pieces, PIECE)).collect()]
    assert {s for s, _ in got} == want and "at" in want and "past" not in want and 100 < len(want) < 400
    assert sum(s == "at" for s, _ in got) == 5 + 2  # both rows of the road


def test_marks_are_dealt_to_pieces_once(spark):
    rows = [(f"s{k % 5}", k, k, 80.0 * (k % 5), 97.0 * k, 10.0, k % 7 != 0) for k in range(60)]
    marks = spark.createDataFrame(rows, "stream string, mark int, order_key int, x double, y double, z double, draws boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on tables of any size
    try:
        plan = depth_checks.hidden_mark_test(marks)._jdf.queryExecution().sparkPlan().toString()
        dealt = depth_checks.hidden_mark_test(marks)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 1  # for every stretch, line and mark, however many
    assert dealt <= 4  # marks by stream for either side, marks and pieces by cell


def test_hidden_marks_are_worked_out_once_for_their_bands(spark):
    rows = spark.range(200).select(F.lit("s").alias("stream"), F.col("id").alias("mark"), F.lit(0).alias("stretch"), F.lit(1.0).alias("guess"), F.col("id").cast("double").alias("along"), (F.col("id") / 100).alias("miss"))
    hidden, seen = counted(rows)
    got = {r.lo: (r.n, r.median) for r in depth_checks.band_table(hidden).collect()}
    assert got == {0: (101, 0.5), 100: (99, 1.5), 250: (0, None), 500: (0, None)}
    assert seen.value == 200


def test_hidden_marks_are_worked_out_once_for_taped_depths(spark):
    marks = spark.range(40).select(F.lit("s").alias("stream"), F.col("id").alias("mark"), (F.col("id") % 2 == 0).alias("draws"), F.lit(3.0).alias("z"), F.lit(2.0).alias("ground"), (F.col("id") / 40).alias("tape"))
    hidden, seen = counted(spark.range(0, 40, 2).select(F.lit("s").alias("stream"), F.col("id").alias("mark"), F.lit(0).alias("stretch"), F.lit(3.5).alias("guess")))
    got = {r.test: (r.n, r.bias) for r in depth_checks.tape_tests(marks, hidden).collect()}
    assert got == {"own level": (40, pytest.approx(1 - 19.5 / 40)), "end to end": (20, pytest.approx(1.5 - 19 / 40))}
    assert seen.value == 20


def _lined(rng, n):
    """Lines of two to four vertices, some alike, some of one vertex, none or a blank one."""
    rows = [(f"l{k:03d}", rng.randrange(3), [(rng.uniform(-50, 2050), rng.uniform(-50, 2050)) for _ in range(rng.choice((2, 3, 4)))]) for k in range(n)]
    rows += [(f"k{k:03d}", rng.randrange(3), rows[k][2]) for k in range(n // 4)] + [("one", 0, [(5.0, 5.0)]), ("none", 0, None), ("gap", 1, [(0.0, 0.0), (None, 1.0), (40.0, 30.0), (40.0, 90.0)]), ("dot", 2, [(70.0, 70.0), (70.0, 70.0)])]
    return rows


def _off(x, y, line):
    out = []
    for a, b in zip(line or [], (line or [])[1:], strict=False):
        if None not in (*a, *b):
            dx, dy = b[0] - a[0], b[1] - a[1]
            t = min(max(((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy), 0.0), 1.0) if dx or dy else 0.0
            out.append(math.sqrt((x - a[0] - t * dx) ** 2 + (y - a[1] - t * dy) ** 2))
    return min(out, default=math.inf)


LINED = "seg_id string, route int, line array<struct<x:double,y:double>>"


def _spots(rng, n):
    spots = [(k, rng.uniform(0, 2000), rng.uniform(0, 2000)) for k in range(n)]
    return spots + [(n, 70.0, 70.0), (n + 1, *spots[0][1:]), (n + 2, None, 5.0), (n + 3, 9000.0, 9000.0), (n + 4, math.nan, 1.0)]


@pytest.mark.parametrize("block", [7, 100_000])
def test_nearest_and_near_lines_are_those_of_every_pair(spark, monkeypatch, block):
    def written(*_):
        raise AssertionError("rows were written on the way")

    for m in (spatial, ranking):
        monkeypatch.setattr(m, "checkpointed", written)
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "PAIRS", 50)
    rng = random.Random(8)
    rows, spots = _lined(rng, 40), _spots(rng, 150)
    lines, pts = spark.createDataFrame(rows, LINED), spark.createDataFrame(spots, "id long, x double, y double")
    reach = {i: 90.0 if i % 2 else 40.0 for i, *_ in spots}
    off = {(i, s): d for i, x, y in spots if x is not None and x == x for s, _, line in rows if (d := _off(x, y, line)) <= 90}
    want = {i: min(((d, s) for (j, s), d in off.items() if j == i and d <= reach[i]), default=(None, None)) for i, *_ in spots}
    got = {r.id: (r.dist, r.seg_id) for r in spatial.nearest(pts, lines, 90.0, "id", reach=F.when(F.col("id") % 2 == 1, 90.0).otherwise(40.0)).collect()}
    assert got == want and 20 < sum(s is not None for _, s in want.values()) < 150
    assert {(r.id, r.seg_id): r.dist for r in spatial.dwithin(pts, lines, 90.0, "id").collect()} == off and ("gap" in {s for _, s in off}) and len(off) > 300


@pytest.mark.parametrize("block", [7, 100_000])
def test_cameras_take_their_route_first(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rng = random.Random(9)
    rows, spots = _lined(rng, 40), _spots(rng, 120)
    cameras = [(f"C{k}", x, y, None if k % 11 == 0 else k % 4) for k, x, y in spots]
    want = {}
    for c, x, y, route in cameras:
        near_by = sorted((r != route, d, s) for s, r, line in rows if x is not None and (d := _off(x, y, line)) <= 100)
        want[c] = (near_by[0][2], near_by[0][1], "nearest" if near_by[0][0] else "named route") if near_by else (None, None, "none")
    got = spatial.match_cameras(spark.createDataFrame(cameras, "camera_id string, x double, y double, named_route int"), spark.createDataFrame(rows, LINED))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert {r.camera_id: (r.seg_id, r.dist, r.match_rule) for r in got.collect()} == want
    assert {m for *_, m in want.values()} == {"named route", "nearest", "none"} and plan.count("Exchange") == 1


def test_lines_equally_far_are_told_apart_as_sql_does(spark):
    """Two pieces of one straight line, whose distances SQL takes as the root of the sum of squares; hypot may miss it by a bit."""
    import duckdb

    rng = random.Random(1)
    rows = []
    for k in range(3000):
        p, q, m = rng.randint(3, 60), rng.randint(1, 9), rng.randint(1, 3)
        rows.append((k, 1000.0 * k + rng.randint(p, 3 * p), float(rng.randint(-20, 20)), 1000.0 * k, 0.0, 1000.0 * k + 4.0 * p, 4.0 * q, 1000.0 * k + m * p, float(m * q), 1000.0 * k + 5.0 * p, 5.0 * q))
    df = spark.createDataFrame(rows, "id long, x double, y double, ax double, ay double, b_x double, b_y double, cx double, cy double, dx double, dy double")
    line = lambda a, b: geo.line_of((F.col(a[0]), F.col(a[1])), (F.col(b[0]), F.col(b[1])))
    each = [df.select(F.concat(F.lit(n), F.col("id")).alias("seg_id"), line(*ends).alias("line")) for n, ends in (("b", (("ax", "ay"), ("b_x", "b_y"))), ("a", (("cx", "cy"), ("dx", "dy"))))]
    got = {r.id: r.seg_id for r in spatial.nearest(df.select("id", "x", "y"), each[0].unionAll(each[1]), 60.0, "id").collect()}
    t = pd.DataFrame(rows, columns=df.columns)  # noqa: F841  SQL reads it
    first, other = fx.sql_distance("x", "y", ("ax", "ay"), ("b_x", "b_y")), fx.sql_distance("x", "y", ("cx", "cy"), ("dx", "dy"))
    want = dict(duckdb.sql(f"SELECT id, CASE WHEN least({first}, {other}) > 60 THEN NULL WHEN {other} <= {first} THEN 'a' || id ELSE 'b' || id END FROM t").fetchall())
    assert got == want and len({(v or "")[:1] for v in want.values()}) > 1
