import datetime as dt
import json
import math
import random
import struct
import zlib

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corridor.common import Refused
from corridor.functions import geo, keys, measures
from corridor.operators import depth, gates, linref, metrics, ranking, timeseries
from corridor.sources import readers, sinks
from corridor.streaming import streams


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.fixture(scope="module")
def segs(spark):
    """Route 1: 0 to 1, 1 to 2, a gap, 3 to 4 miles; route 2: 0 to 0.5. Mileposts in thousandths."""
    return spark.createDataFrame([("a", 1, 0, 1000), ("b", 1, 1000, 2000), ("c", 1, 3000, 4000), ("d", 2, 0, 500)], "seg_id string, rid long, beg long, end long")


def test_overlaps_do_not_count_touching_ends(spark, segs):
    parts = spark.createDataFrame([(1, 500, 1500, 10), (1, 2000, 3000, 7), (2, 0, 2000, 8)], "rid long, pb long, pe long, n long")
    for width in (300, 5000):
        over = linref.interval_overlaps(segs, parts, bin_width=width)
        assert sorted((r.seg_id, r.ov) for r in over.collect()) == [("a", 500), ("b", 500), ("d", 500)]
    shared = {r.seg_id: r.n for r in linref.apportion(over, ["n"], F.col("pe") - F.col("pb")).collect()}
    assert shared == {"a": 5.0, "b": 5.0, "d": 2.0}
    cover = {r.seg_id: r.covered for r in linref.coverage(over, segs.withColumn("len", F.col("end") - F.col("beg")), "len").collect()}
    assert cover == {"a": 0.5, "b": 0.5, "c": 0.0, "d": 1.0}


def test_points_go_to_the_earlier_segment(spark, segs):
    pts = spark.createDataFrame([(1, 1, 1000), (2, 1, 2500), (3, 2, 0), (4, 9, 5), (5, 1, 4000)], "pt_id long, rid long, mp long")
    got = {r.pt_id: r.seg_id for r in linref.points_on_segments(segs, pts, "pt_id", bin_width=400).collect()}
    assert got == {1: "a", 2: None, 3: "d", 4: None, 5: "c"}


def test_tolerance_match_is_greedy_and_one_to_one(spark):
    rng = random.Random(4)
    m = [(k % 3, k, b := rng.randrange(200 if k % 3 else 1500), b + rng.randrange(30)) for k in range(60)]
    d = [(k % 3, 100 + k, b := rng.randrange(200 if k % 3 else 1500), b + rng.randrange(30)) for k in range(60)]
    got = linref.tolerance_match(spark.createDataFrame(m, "rid long, master_id long, beg long, end long"), spark.createDataFrame(d, "rid long, detail_id long, pb long, pe long"), 10)
    pairs = sorted((abs(a[2] - b[2]) + abs(a[3] - b[3]), a[1], b[1]) for a in m for b in d if a[0] == b[0] and abs(a[2] - b[2]) <= 10 and abs(a[3] - b[3]) <= 10)
    left, right, want = set(), set(), []
    for dist, a, b in pairs:
        if a not in left and b not in right:
            left.add(a), right.add(b), want.append((a, b, dist))
    assert sorted((r.master_id, r.detail_id, r.d) for r in got.collect()) == sorted(want)


def test_keys(spark):
    r = one(spark, keys.route_key(F.lit("2.5")), keys.route_key(F.lit("x")), keys.norm_route(F.lit(" 30000040.0")), keys.make_seg_id(F.lit("40001234092"), F.lit(1.5)), keys.parse_highway(F.lit("sr2748")), keys.parse_highway(F.lit("Main St")), keys.parse_time(F.lit("2024-01-01T00:00:00")), keys.split_county(F.lit("092-Wake")), keys.is_bridge(F.lit(None).cast("string")))
    assert tuple(r[:4]) == (2, None, "30000040", "ncdot:40001234092:1.500") and tuple(r[4]) == ("SR", 2748) and r[5] is None and r[6] is None and tuple(r[7]) == ("092", "Wake") and r[8]
    blocks = [f"{x}_{y}" for x in range(-20, 20) for y in range(-5, 5)]
    df = spark.createDataFrame([(b,) for b in blocks], "b string").select("b", keys.fold_of(F.col("b")).alias("f"))
    assert all(x.f == zlib.crc32(x.b.encode()) % 5 for x in df.collect())
    assert one(spark, keys.block_id(F.lit(-1), F.lit(4999)))[0] == "-1_0"


def test_measures(spark):
    y = lambda r, rate: measures.years_to_poor(F.lit(r).cast("double"), F.lit(rate).cast("double"))
    assert list(one(spark, y(80, 2), y(59, 2), y(0, 2), y(99, 0), y(None, 1))) == [10.0, 0.0, None, 50.0, None]
    assert list(one(spark, *[measures.repair_bucket(F.lit(v).cast("double")) for v in (None, 0, 1, 5, 5.1)])) == ["unknown", "fix_now", "1y", "5y", "later"]
    assert list(one(spark, measures.wear_rate(F.lit(90), F.lit(5)), measures.wear_rate(F.lit(90), F.lit(1)), measures.guarded(F.lit(1), F.lit(0)))) == [2.0, None, None]


def test_projection_round_trip(spark):
    pts = [(-79.0, 33.75), (-78.64, 35.78), (-83.9, 35.1), (-75.6, 36.4)]
    df = spark.createDataFrame(pts, "lon double, lat double").withColumn("p", geo.to_state_plane(F.col("lon"), F.col("lat")))
    df = df.withColumn("q", geo.from_state_plane(F.col("p.x"), F.col("p.y")))
    for r in df.collect():
        assert abs(r.q.lon - r.lon) < 1e-9 and abs(r.q.lat - r.lat) < 1e-9
    assert df.first().p.x == pytest.approx(609601.22) and df.first().p.y == pytest.approx(0, abs=1e-6)


def test_geometry(spark):
    line = geo.line_of(*[(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (4, 0), (4, 3))])
    r = one(spark, geo.length(line).alias("l"), geo.midpoint(line).alias("m"), geo.distance(F.lit(5.0), F.lit(1.0), line).alias("d"), geo.hits_box(line, 3.5, 0.5, 5, 1).alias("h"), geo.hits_box(line, 0, 1, 3, 2).alias("n"), geo.sample_stations(line, 2.0).alias("s"), geo.decode_path(geo.encode_path(line)).alias("p"), geo.simplify(line, 10.0).alias("f"))
    assert (r.l, tuple(r.m), r.d, r.h, r.n) == (7.0, (3.5, 0.0), 1.0, True, False) and r.s == pytest.approx([0, 1.75, 3.5, 5.25, 7])
    assert [tuple(map(round, p)) for p in r.p] == [(0, 0), (4, 0), (4, 3)] and len(r.f) == 2
    wkb = struct.pack("<BII", 1, 5, 2) + b"".join(struct.pack("<BII4d", 1, 2, 2, *c) for c in ((0, 1, 2, 3), (4, 5, 6, 7)))
    parts = spark.createDataFrame([(bytearray(wkb),), (None,)], "w binary").select(geo.wkb_to_parts(F.col("w")).alias("p")).collect()
    assert [[tuple(v) for v in p] for p in parts[0].p] == [[(0, 1), (2, 3)], [(4, 5), (6, 7)]] and parts[1].p is None


def a_shape(rng, kind, little):
    """Bytes of a shape of random vertices, of shapes of both byte orders where it has several, and its parts."""
    e = "<" if little else ">"
    head = struct.pack(f"{e}BI", little, kind)

    def run(n):
        spots = [(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(n)]
        return struct.pack(f"{e}{2 * n}d", *[v for spot in spots for v in spot]), spots

    if kind == 1:
        data, spots = run(1)
        return head + data, [spots]
    if kind == 2:
        data, spots = run(n := rng.randrange(6))
        return head + struct.pack(f"{e}I", n) + data, [spots]
    if kind == 3:
        rings = [run(rng.randrange(7)) for _ in range(rng.randrange(4))]
        return head + struct.pack(f"{e}I", len(rings)) + b"".join(struct.pack(f"{e}I", len(p)) + d for d, p in rings), [p for _, p in rings]
    all_ = [a_shape(rng, kind - 3, rng.choice((little, 1 - little))) for _ in range(rng.randrange(5))]
    return head + struct.pack(f"{e}I", len(all_)) + b"".join(d for d, _ in all_), [p for _, parts in all_ for p in parts]


def test_shapes_of_all_kinds_come_out_of_one_buffer():
    rng = random.Random(3)
    shapes = [None if rng.random() < 0.1 else a_shape(rng, rng.randrange(1, 7), rng.randrange(2)) for _ in range(800)]
    data = pa.array([None if s is None else s[0] for s in shapes], pa.binary())
    plain = lambda rows: [None if r is None else [[(v["x"], v["y"]) for v in p] for p in r] for r in rows.to_pylist()]
    want = [None if s is None else s[1] for s in shapes]
    assert plain(geo.parts_of_wkb(data)) == want and plain(geo.parts_of_wkb(data.slice(90, 40))) == want[90:130]
    assert plain(geo.parts_of_wkb(data.slice(0, 0))) == [] and plain(geo.parts_of_wkb(pa.array([None], pa.binary()))) == [None]
    for bad, words in ((struct.pack("<BI", 1, 9), "kind 9"), (struct.pack("<BII", 1, 2, 5), "ends"), (b"\x01\x02", "ends"), (b"", "ends")):
        with pytest.raises(ValueError, match=words):
            geo.parts_of_wkb(pa.array([bad], pa.binary()))


def fewer(line, tolerance):
    """The line by halves: the vertex furthest from the chord stays where it is too far."""
    if len(line) < 3:
        return line
    (ax, ay), (bx, by) = line[0], line[-1]
    dx, dy = bx - ax, by - ay
    share = lambda x, y: min(max(((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy), 0), 1) if dx or dy else 0
    off = [math.hypot(x - ax - t * dx, y - ay - t * dy) for x, y in line[1:-1] for t in [share(x, y)]]
    at = off.index(max(off)) + 1
    return fewer(line[: at + 1], tolerance)[:-1] + fewer(line[at:], tolerance) if max(off) > tolerance else [line[0], line[-1]]


def test_lines_of_a_batch_are_simplified_together():
    rng, lines = random.Random(5), [None, []]
    for n in [1, 2, 3, 5, 20, 200] * 40:
        x = y = 0.0
        line = [(x := x + rng.choice((0, 1, 2, -1)), y := y + rng.choice((0, 1, -1, 3))) for _ in range(n)]
        lines.append(line[:-1] + line[:1] if n > 3 and rng.random() < 0.3 else line)
    data = pa.array([None if s is None else [{"x": x, "y": y} for x, y in s] for s in lines], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    plain = lambda rows: [None if r is None else [(v["x"], v["y"]) for v in r] for r in rows.to_pylist()]
    want = [None if s is None else fewer(s, 1.0) for s in lines]
    assert plain(geo.simplified(data, 1.0)) == want and plain(geo.simplified(data.slice(7, 30), 1.0)) == want[7:37] and plain(geo.simplified(data.slice(0, 0), 1.0)) == []


def test_gates_refuse(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k long, v string")
    with pytest.raises(Refused):
        gates.assert_key(df, "k")
    with pytest.raises(Refused):
        gates.check_features(["age", "y_failed"])
    with pytest.raises(Refused):
        gates.assert_domain(df, {"small": F.col("k") > 1})
    good = df.where("v = 'a'")
    assert gates.attach_with_rename(good, good.withColumn("v", F.lit("z")), "k").first().asDict() == {"k": 1, "v_d8": "a", "v": "z"}
    assert gates.fingerprint(df).first() == gates.fingerprint(df.repartition(3)).first() != gates.fingerprint(good).first()


def test_rank_does_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(50)) for k in range(500)]
    for n in (1, 7):
        got = ranking.global_rank(spark.createDataFrame(rows, "k long, v long").repartition(n), [F.asc("v"), F.asc("k")])
        assert {r.k: r["rank"] for r in got.collect()} == {k: i for i, (_, k) in enumerate(sorted((v, k) for k, v in rows), 1)}


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, s double")
    assert metrics.average_precision(df, "y", "s").first().ap == pytest.approx((0.5 + 2 / 3) / 2)
    assert metrics.average_precision(df.where("y = 1"), "y", "s").first().ap is None
    rng = random.Random(2)
    pairs = [(rng.randrange(9), rng.randrange(9)) for _ in range(200)]
    rho = metrics.spearman(spark.createDataFrame(pairs, "a long, b long"), "a", "b").first().rho
    p = pd.DataFrame(pairs).rank()
    assert rho == pytest.approx(p[0].corr(p[1]))
    boot = metrics.block_bootstrap(spark.createDataFrame([(f"b{k}", k % 3, 10) for k in range(60)], "block string, a long, b long"), "block", "a", "b", 200).first()
    assert boot.value == pytest.approx(0.1) and boot.low < 0.1 < boot.high and boot.draws == 200


def test_asof_takes_the_earlier_at_equal_gaps(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    left = spark.createDataFrame([(1, "a", at(6)), (2, "a", at(40)), (3, "b", at(6))], "id long, k string, ltime timestamp")
    right = spark.createDataFrame([("a", at(0), 1.0), ("a", at(12), 2.0)], "k string, rtime timestamp, value double")
    assert {r.id: r.value for r in timeseries.asof_nearest(left, right, "k", "id", 600).collect()} == {1: 1.0, 2: None, 3: None}


def test_water_lines(spark):
    marks = spark.createDataFrame([("s", f"m{k}", k, 200.0 * k, 0.0, 10.0 + k) for k in range(4)] + [("s", "m9", 9, 600.5, 0.0, 15.0), ("t", "m5", 0, 0.0, 5000.0, 1.0)], "stream string, mark string, order_key int, x double, y double, z double")
    lines = depth.build_lines(marks.repartition(4))
    assert {(r.k, r.marks): r.z for r in lines.where("stream = 's'").collect()} == {(0, 1): 10, (1, 1): 11, (2, 1): 12, (3, 2): 14}
    pts = spark.createDataFrame([(1, 100.0, 50.0), (2, 100.0, 400.0), (3, -150.0, 0.0), (4, 10.0, 5000.0)], "pt long, x double, y double")
    got = {r.pt: (r.stream, r.level, r.dist) for r in depth.locate(pts, depth.line_pieces(lines)).collect()}
    assert got == {1: ("s", 10.5, 50.0), 2: (None, None, None), 3: (None, None, None), 4: ("t", 1.0, 10.0)}


def test_raster_samples(spark):
    cells = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(5) for c in range(5)], "row long, col long, z double")
    pts = spark.createDataFrame([(1, 25.0, 15.0), (2, 1.0, 1.0), (3, 20.0, 20.0)], "pt long, x double, y double")
    assert {r.pt: r.z for r in depth.sample_nearest(cells, pts, 10).collect()} == {1: 12.0, 2: 0.0, 3: 22.0}
    assert {r.pt: r.z for r in depth.sample_bilinear(cells, pts, 10).collect()} == {1: 12.0, 2: None, 3: pytest.approx(16.5)}
    t = {r.pt: r for r in depth.terrain_window(cells, pts, 10, 1).collect()}
    assert (t[1].elev, t[1].relief, t[1].above_low) == (12.0, 22.0, 11.0) and t[1].slope == pytest.approx(math.hypot(0.1, 1)) and t[2].elev is None


def test_sources_and_sinks(spark, tmp_path):
    page = {"fields": [{"name": "ID"}], "features": [{"attributes": {"ID": 7}, "geometry": {"x": 1.5, "y": 2}}, {"attributes": {"ID": "x"}}]}
    (tmp_path / "p").mkdir()
    (tmp_path / "p/1.json").write_text(json.dumps(page))
    assert [tuple(r) for r in readers.ingest_pages(spark, str(tmp_path / "p"), {"ID": "long"}, 2).collect()] == [(7, 1.5, 2.0), (None, None, None)]
    assert readers.ingest_points(spark, str(tmp_path / "p"), {"ID": "long"}).count() == 1
    for fields, n in (({"NO": "long"}, 2), ({"ID": "long"}, 3)):
        with pytest.raises(Refused):
            readers.ingest_pages(spark, str(tmp_path / "p"), fields, n)
    (tmp_path / "f").mkdir()
    (tmp_path / "f/s.json").write_text(json.dumps({"station": "S", "params": [{"name": "other"}, {"name": "water_level_raw", "times": ["2024-01-01T00:00:00Z", "2024-01-01T00:06:00Z"], "values": ["1.5", "bad"]}]}))
    assert [(r.level_m, r.bad) for r in readers.read_sensor_feed(spark, str(tmp_path / "f")).orderBy("time").collect()] == [(1.5, False), (None, True)]
    df = spark.createDataFrame([("b", 1.5, True), ("a", None, None), ("c", 1 / 3, False)], "id string, v double, f boolean")
    sinks.write_fixed_csv(df, str(tmp_path / "csv"), {"id": "text", "v": "float", "f": "bool"}, "id")
    text = "".join(p.read_text().split("\n", 1)[1] for p in sorted((tmp_path / "csv").glob("part-*")))
    assert text == "a,,\nb,1.5,true\nc,0.333333,false\n"
    with pytest.raises(Exception):
        sinks.read_versioned(spark, str(tmp_path / "v"), "t")
    sinks.write_versioned(df, str(tmp_path / "v"), "t")
    assert sinks.read_versioned(spark, str(tmp_path / "v"), "t").count() == 3
    assert sinks.markdown(df.orderBy("id").limit(1)) == "| id | v | f |\n| --- | --- | --- |\n| a |  |  |"


def test_streams(spark, tmp_path):
    log = [("c", k, 200, True, 0, s, luma) for k, (s, luma) in enumerate([("a", 90), ("a", 90), ("b", 10), ("a", 90)])] + [("d", 0, 500, True, 0, "a", 90), ("d", 1, 200, True, 1000, "a", 90)]
    schema = "camera_id string, round long, http int, is_image boolean, age_s int, sha1 string, luma int"
    df = spark.createDataFrame(log, schema)
    want = {(r.camera_id, r["round"]): r.status for r in timeseries.still_log_status(df).collect()}
    assert list(want[k] for k in sorted(want)) == ["ok", "duplicate", "dark", "ok", "http_error", "stale"]
    for part in ("round < 2", "round >= 2"):
        df.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    q = streams.still_status_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))).writeStream.format("memory").queryName("stills").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.camera_id, r["round"]): r.status for r in spark.table("stills").collect()} == want
    r = spark.createDataFrame([("c", dt.datetime(2024, 1, 1, 0, 10), 5), ("c", dt.datetime(2024, 1, 1, 0, 10), 5), ("c", dt.datetime(2024, 1, 1, 0, 50), 9), ("c", dt.datetime(2024, 1, 1, 2), 1)], "k string, time timestamp, v int")
    r.coalesce(1).write.parquet(str(tmp_path / "r"))
    s = streams.continuous_hourly(streams.readings_stream(spark, str(tmp_path / "r"), "k string, time timestamp, v int", ["k", "time"]), "k", ["v"])
    q = s.writeStream.outputMode("append").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    assert [(x.max_v, x.n) for x in spark.table("hours").collect()] == [(9, 2)]
