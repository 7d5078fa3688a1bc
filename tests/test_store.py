"""The store of readings by day, typed stream state, replays, ordered fingerprints, exact pages, covered polygons, match rounds."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from corridor.common import Refused
from corridor.operators import gates, linref, spatial, timeseries
from corridor.sources import sinks
from corridor.streaming import store, streams

SCHEMA = "camera_id string, time timestamp, p_mil long"
KEY = ["camera_id", "time"]


def at(day, hour, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def sums(df):
    return timeseries.hourly(df, "camera_id", ["p_mil"])


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _all(df):
    return sorted((r.camera_id, r.time, r.p_mil) for r in df.collect())


def test_appends_are_unique_for_ever(spark, tmp_path):
    """A stream that is stopped and started again, a batch that comes twice, and a duplicate ten days late."""
    inbox, root = str(tmp_path / "in"), str(tmp_path / "store")

    def land(rows):
        _rows(spark, rows).coalesce(1).write.mode("append").parquet(inbox)
        s = spark.readStream.schema(SCHEMA).parquet(inbox)
        streams.store_stream(s, root, SCHEMA, KEY, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    first = [("a", at(1, 1), 5), ("a", at(1, 1), 5), ("b", at(1, 2), 6), (None, at(2, 0), 7)]
    land(first)
    land([("a", at(11, 1), 8), ("b", at(1, 2), 99), ("b", at(1, 3), 9), (None, at(2, 0), 70)])
    want = [(c, t, p) for c, t, p in dict.fromkeys(first)] + [("a", at(11, 1), 8), ("b", at(1, 3), 9)]
    got = store.rows_of(spark, root, SCHEMA)
    assert sorted(map(str, [(r.camera_id, r.time, r.p_mil) for r in got.collect()])) == sorted(map(str, want))
    again = store.append_once(spark, root, SCHEMA, KEY)
    again(_rows(spark, [("a", at(11, 1), 8), ("b", at(1, 3), 9)]), 1)  # the second batch, run anew
    assert got.count() == store.rows_of(spark, root, SCHEMA).count() == len(want)
    (tmp_path / "store/live/batch=1/_SUCCESS").unlink()  # as if it had failed at its end
    again(_rows(spark, [("a", at(11, 1), 8), ("b", at(1, 3), 9), ("b", at(1, 2), 6)]), 1)
    assert store.rows_of(spark, root, SCHEMA).count() == len(want)
    with pytest.raises(Refused):
        again(_rows(spark, [("a", None, 1)]), 2)
    with pytest.raises(Refused):
        store.append_once(spark, root, SCHEMA, ["camera_id"])
    again(_rows(spark, []), 3)


def test_packed_days_are_what_readers_see(spark, tmp_path):
    root = str(tmp_path / "s")
    add = store.append_once(spark, root, SCHEMA, KEY)
    past = F.col("day") < F.lit("2024-01-03").cast("date")
    assert store.rows_of(spark, root, SCHEMA).count() == 0 and store.pack(spark, root, SCHEMA, KEY, past) == []
    add(_rows(spark, [(c, at(d, h), d * h) for c in "ab" for d in (1, 2, 3) for h in range(9)]).repartition(5), 0)
    before = _all(store.rows_of(spark, root, SCHEMA))
    assert store.pack(spark, root, SCHEMA, KEY, past) == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    assert _all(store.rows_of(spark, root, SCHEMA)) == before and store.pack(spark, root, SCHEMA, KEY, past) == []
    assert len(list((tmp_path / "s/packed/version=0/day=2024-01-01").glob("part-*.parquet"))) == 1
    add(_rows(spark, [("late", at(1, 5), 1), ("a", at(2, 3), 0)]), 1)  # one new, one that is packed
    after = sorted([*before, ("late", at(1, 5), 1)])
    assert _all(store.rows_of(spark, root, SCHEMA)) == after
    add(_rows(spark, [("late", at(1, 5), 1)]), 1)
    assert store.pack(spark, root, SCHEMA, KEY, past) == [dt.date(2024, 1, 1)] and _all(store.rows_of(spark, root, SCHEMA)) == after
    one = store.rows_of(spark, root, SCHEMA).where(F.col("day") == F.lit("2024-01-02").cast("date"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("FileScan parquet")[1:] if "camera_id" in x.split("\n")[0]]
    assert len(scans) == 2 and all("PartitionFilters: [isnotnull(day" in x or "day" in x.split("PartitionFilters:")[1].split("]")[0] for x in scans) and one.count() == 18


def test_hours_with_a_live_tail(spark, tmp_path):
    """Nothing twice and nothing lost at the mark; late rows of closed hours wait for a refresh."""
    root = str(tmp_path / "s")
    add = store.append_once(spark, root, SCHEMA, KEY)
    add(_rows(spark, [("a", at(1, h, m), h) for h in range(24) for m in (0, 59)]), 0)
    hours = lambda: {(r.camera_id, r.bucket): (r.max_p_mil, r.n) for r in store.hours_of(spark, root, SCHEMA, sums).collect()}
    whole = hours()
    assert len(whole) == 24
    for h in (5, 5, 11):
        store.close_hours(spark, root, SCHEMA, sums, at(1, h))
        assert hours() == whole and store.closed_upto(spark, root) == at(1, h)
    with pytest.raises(Refused):
        store.close_hours(spark, root, SCHEMA, sums, at(1, 2))
    add(_rows(spark, [("a", at(1, 3, 30), 90), ("a", at(1, 11), 1), ("a", at(1, 11, 30), 91), ("a", at(2, 0), 7)]), 1)
    live = whole | {("a", at(1, 11)): (91, 3), ("a", at(2, 0)): (7, 1)}
    assert hours() == live
    store.refresh_hours(spark, root, SCHEMA, sums, [dt.date(2024, 1, 1)])
    assert hours() == live | {("a", at(1, 3)): (90, 3)}
    store.close_hours(spark, root, SCHEMA, sums, at(2, 1))
    assert hours() == live | {("a", at(1, 3)): (90, 3)} and spark.read.parquet(f"{root}/hourly").count() == 25


def test_replays_of_a_table_with_replays(spark):
    rows = [("a", at(1, 1), 1, None), ("a", at(1, 2), 2, None), ("a", at(1, 3), 3, None), ("b", at(1, 2), 4, None), ("a", at(5, 2), 1, at(1, 2)), ("a", at(1, 2, 30), 9, at(1, 0))]
    df = spark.createDataFrame(rows, SCHEMA + ", replay_of timestamp")
    ts = lambda t: F.lit(t).cast("timestamp")
    args = (ts(at(1, 1)), ts(at(1, 3)), ts(at(5, 3)), KEY)
    out = timeseries.replay(df, *args)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == [("a", at(5, 1), 1, at(1, 1)), ("a", at(5, 3), 3, at(1, 3)), ("b", at(5, 2), 4, at(1, 2))]
    assert tuple(timeseries.replay_counts(df, *args).first()) == (3, 1)
    batches = {(r.camera_id, r.replay_of.hour): r.batch for r in timeseries.replay_batches(out, 4, *args[:2]).collect()}
    assert batches == {("a", 1): 1, ("b", 2): 2, ("a", 3): 4}
    with pytest.raises(Refused):
        timeseries.replay(df, *args, complete=False)


def test_last_status_of_loads(spark, tmp_path):
    sinks.write_versioned(spark.range(3).toDF("a"), str(tmp_path), "x")
    assert sinks.last_status(spark, str(tmp_path)) == "complete"


def test_ordered_fingerprints(spark):
    df = spark.createDataFrame([(k, k * 7 % 5, None if k % 3 else "x") for k in range(200)], "k long, v long, s string")
    h = gates.ordered_fingerprint(df.repartition(7), ["k"])
    gates.unchanged(h, gates.ordered_fingerprint(df.repartition(2), ["k"]))
    for other in (df.withColumn("v", F.when(F.col("k") == 9, 99).otherwise(F.col("v"))), df.where("k != 50"), df.withColumn("k", 199 - F.col("k"))):
        with pytest.raises(Refused):
            gates.unchanged(h, gates.ordered_fingerprint(other, ["k"]))
    swapped = df.withColumn("k", F.when(F.col("k") == 3, 4).when(F.col("k") == 4, 3).otherwise(F.col("k")))
    with pytest.raises(Refused):
        gates.unchanged(gates.ordered_fingerprint(df.select("k", "s", F.lit(1).alias("v")), ["k"]), gates.ordered_fingerprint(swapped.drop("v"), ["k"]))
    assert tuple(gates.ordered_fingerprint(df.limit(0), ["k"]).first()) == (0, "0-0")


def test_exports_are_the_same_bytes_however_dealt(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).cast("string").alias("seg_id"), (F.col("id") / 7).alias("v"), (F.col("id") % 2 == 0).alias("b"))
    df = df.unionByName(df.where("v < 3"))  # keys that repeat
    files = []
    for n in (1, 3, 8):
        sinks.write_fixed_csv(df.repartition(n), str(tmp_path / str(n)), {"seg_id": "text", "v": "float", "b": "bool"}, "seg_id", page=300)
        files.append([p.read_bytes() for p in sorted((tmp_path / str(n)).glob("part-*"))])
    assert files[0] == files[1] == files[2] and [x.count(b"\n") for x in files[0]] == [301, 301, 301, 122]
    sinks.write_fixed_csv(df.limit(0), str(tmp_path / "none"), {"seg_id": "text"}, "seg_id")


def test_pages_of_an_export_share_tasks(spark, tmp_path, monkeypatch):
    """Eleven pages by three tasks are the same pages, byte for byte, as by eleven; a task a page makes tasks grow with the rows."""
    df = spark.range(1050).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("seg_id"), (F.col("id") / 7).alias("v"))
    pages = {}
    for most in (100, 3):
        monkeypatch.setattr(sinks, "MOST_WRITERS", most)
        each = sinks.write_fixed_csv(df, str(tmp_path / str(most)), {"seg_id": "text", "v": "float"}, "seg_id", page=100)
        names = {p: re.search(r"part-(\d+)-.*-c(\d+)\.", p.name) for p in (tmp_path / str(most)).glob("part-*")}
        pages[most] = {int(m[1]) * each + int(m[2]): p.read_bytes() for p, m in names.items()}
        assert len({m[1] for m in names.values()}) == {100: 11, 3: 3}[most]
    assert pages[3] == pages[100] and sorted(pages[3]) == list(range(11))


def test_polygons_with_holes_parts_and_any_cells(spark):
    r = random.Random(8)

    def star(cx, cy, size, n):
        import math

        spots = [(cx + size * r.uniform(0.4, 1) * math.cos(6.2831853 * k / n), cy + size * r.uniform(0.4, 1) * math.sin(6.2831853 * k / n)) for k in range(n)]
        return [*spots, spots[0]]

    def square(x, y, s):
        return [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]

    shapes = [("a", [star(0, 0, 50, 17), star(3, 2, 12, 9)]), ("b", [square(-30.0, -30.0, 60.0), square(-20.0, -20.0, 40.0), square(-10.0, -10.0, 20.0)]), ("c", [star(70, 70, 30, 5)]), ("c", [square(-90.0, 60.0, 8.0)]), ("d", [[]])]
    spots = [(k, r.uniform(-100, 100), r.uniform(-100, 100)) for k in range(900)] + [(900 + k, float(x), float(y)) for k, (x, y) in enumerate((x, y) for x in range(-40, 41, 10) for y in range(-40, 41, 10))]

    def inside(x, y, rings):
        n = 0
        for ring in rings:
            for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
                if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                    n += 1
        return n % 2 == 1

    want = {k: min((name for name, rings in shapes if inside(x, y, rings)), default=None) for k, x, y in spots}
    polygons = spark.createDataFrame([(name, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for name, rings in shapes], "name string, rings array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame(spots, "id long, x double, y double")
    for cell in (3.0, 10.0, 1000.0):
        got = {row.id: row.name for row in spatial.point_in_polygon(points, polygons, "id", "name", cell).collect()}
        assert got == want
    cover = spatial.covering(polygons, "name", 3.0)
    assert cover.where("not edge").count() > 200 and cover.count() == cover.select("name", "cx", "cy").distinct().count()


def test_matches_by_rounds_are_the_greedy_ones(spark):
    r = random.Random(9)
    master = [(1, f"m{k}", b := r.randrange(300), b + 50 + r.randrange(4)) for k in range(80)]
    detail = [(1, f"d{k}", b := r.randrange(300), b + 50 + r.randrange(4)) for k in range(90)]
    pairs = sorted((abs(b - x) + abs(e - y), m, n) for _, m, b, e in master for _, n, x, y in detail if abs(b - x) <= 9 and abs(e - y) <= 9)
    left, right, want = set(), set(), []
    for d, m, n in pairs:
        if m not in left and n not in right:
            left.add(m)
            right.add(n)
            want.append((m, n, d))
    got = linref.tolerance_match(spark.createDataFrame(master, "rid long, master_id string, beg long, end long"), spark.createDataFrame(detail, "rid long, detail_id string, pb long, pe long"), 9)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want) and len(want) > 40
    assert "MapInPandas" not in got._jdf.queryExecution().executedPlan().toString()
