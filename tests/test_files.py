import datetime as dt
import json
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corridor.common import Refused
from corridor.operators import timeseries
from corridor.sources import readers, sinks
from corridor.streaming import streams


def _geo(path, column):
    line = struct.pack("<BII4d", 1, 2, 2, -79.0, 35.0, -78.9, 35.1)
    table = pa.table({"seg_id": ["a"], "geometry": pa.array([line], pa.binary())})
    meta = {} if column is None else {b"geo": json.dumps({"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": column}}).encode()}
    pq.write_table(table.replace_schema_metadata(meta), path)
    return str(path)


def test_shapes_in_another_system_refuse(spark, tmp_path):
    good = _geo(tmp_path / "good.parquet", {"encoding": "WKB", "crs": {"id": {"authority": "EPSG", "code": 4326}}})
    plain = _geo(tmp_path / "plain.parquet", {"encoding": "WKB"})
    for p in (good, plain):
        assert [tuple(v) for v in readers.read_geo(spark, p).first().parts[0]] == [(-79.0, 35.0), (-78.9, 35.1)]
    metres = _geo(tmp_path / "metres.parquet", {"encoding": "WKB", "crs": {"id": {"authority": "EPSG", "code": 32119}}})
    for p in (metres, _geo(tmp_path / "silent.parquet", None)):
        with pytest.raises(Refused):
            readers.read_geo(spark, p)
    pq.write_table(pa.table({"geometry": pa.array([None], pa.binary())}).replace_schema_metadata(pq.read_schema(good).metadata), tmp_path / "empty.parquet")
    with pytest.raises(Refused):
        readers.read_geo(spark, str(tmp_path / "empty.parquet"))


def test_marks_files_and_grades(spark, tmp_path):
    f = {"features": [{"properties": {"id": "m1", "h": "2.5"}, "geometry": {"type": "Point", "coordinates": [-82.5, 35.5]}}, {"properties": {"id": "m2"}, "geometry": {"type": "LineString", "coordinates": []}}]}
    (tmp_path / "marks.json").write_text(json.dumps(f))
    assert [tuple(r) for r in readers.read_marks(spark, str(tmp_path / "marks.json"), {"id": "string", "h": "double"}).collect()] == [("m1", 2.5, -82.5, 35.5)]
    with pytest.raises(Refused):
        readers.read_marks(spark, str(tmp_path / "marks.json"), {"id": "string", "no": "double"})
    (tmp_path / "img").mkdir()
    (tmp_path / "img/DE_20240102T030405Z.jpg").write_bytes(b"x")
    (tmp_path / "img/readme.txt").write_bytes(b"x")
    got = {r.station: r.time for r in readers.index_files(spark, str(tmp_path / "img")).collect()}
    assert got == {"DE": dt.datetime(2024, 1, 2, 3, 4, 5), "": None}
    (tmp_path / "g.csv").write_text("file,damage\na.jpg,\nb.jpg,pothole\n")
    assert [tuple(r) for r in readers.read_grades(spark, str(tmp_path / "g.csv"), ["file", "damage"]).collect()] == [("a.jpg", ""), ("b.jpg", "pothole")]
    assert readers.read_table(spark, "/root/testdata/sf0.001/nation.parquet", ["n_name"]).columns == ["n_name"]


def test_shards_hold_every_row_once(spark, tmp_path):
    df = spark.range(400).select(F.concat(F.lit("s"), "id").alias("seg_id"), (F.col("id") % 3).alias("c"), (F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    sinks.write_shards(df, str(tmp_path / "s"), F.col("c"), F.col("k"), ["seg_id"], pieces=2)
    small, detail, county = (spark.read.json(str(tmp_path / f"s/{n}")) for n in ("map", "detail", "county"))
    assert sorted(small.columns) == ["cell", "seg_id"] and small.count() == small.select("seg_id").distinct().count() == 400
    assert detail.agg(F.sum("v")).first()[0] == county.agg(F.sum("v")).first()[0] == 399 * 200
    assert county.where("county_code != k").count() == 0 and detail.where("cell != c").count() == 0


def test_dumps_and_dictionary(spark, tmp_path):
    df = spark.sql("select 1 as id, cast(null as string) as b, timestamp'2024-01-02 03:04:05' as t")
    sinks.dump_tables({"x": df}, str(tmp_path / "d"))
    assert next((tmp_path / "d/x").glob("part-*")).read_text() == "id,b,t\n1,,2024-01-02T03:04:05Z\n"
    said = sinks.data_dictionary(df, {"id": ("Id of a row", ""), "t": ("When", "UTC")})
    assert [tuple(r) for r in said.collect()] == [("id", "Id of a row", ""), ("b", "", ""), ("t", "When", "UTC")]
    sinks.write_laid_out(spark.sql("select 'b' as seg_id, 0.5 as pred_crack, true as flood_scored union all select 'a', null, false"), str(tmp_path / "risk"), sinks.RISK)
    lines = "".join(p.read_text() for p in sorted((tmp_path / "risk").glob("part-*"))).splitlines()
    assert lines[0] == ",".join(sinks.RISK) and [x for x in lines if x[1:2] == ","] == ["a" + "," * 20 + "false,", "b" + "," * 17 + "0.5,,,true,"]
    assert [len(x) for x in (sinks.RISK, sinks.QUEUE, sinks.STORM, sinks.ORDER)] == [22, 19, 14, 23]


def _readings(spark, rows):
    return spark.createDataFrame(rows, "camera_id string, time timestamp, p_mil long, replay_of string")


def at(day, hour, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def test_late_rows_refresh_their_days_alone(spark, tmp_path):
    schema = "camera_id string, time timestamp, p_mil long, replay_of string"
    raw, target = str(tmp_path / "raw"), str(tmp_path / "hours")
    sums = lambda df: timeseries.hourly(df, "camera_id", ["p_mil"])
    refresh = streams.refresh_touched(lambda: spark.read.parquet(raw), target, sums)
    q = None
    for rows in ([("c", at(1, 1), 5, None), ("c", at(2, 1), 7, None)], [("c", at(1, 1, 30), 9, None)]):
        _readings(spark, rows).coalesce(1).write.mode("append").parquet(raw)
        q = spark.readStream.schema(schema).parquet(raw).writeStream.option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(refresh).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.bucket, r.max_p_mil, r.n) for r in spark.read.parquet(target).collect()}
    assert got == {(at(1, 1), 9, 2), (at(2, 1), 7, 1)}


def test_clearing_replays_and_compacting(spark, tmp_path):
    df = _readings(spark, [("c", at(1, 1), 5, None), ("c", at(1, 1, 5), 900, "storm"), ("c", at(1, 2), 800, "storm"), ("c", at(1, 3), 7, None)])
    sums = lambda d: timeseries.hourly(d, "camera_id", ["p_mil"])
    kept, hours = streams.clear_replay(df, sums(df), sums)
    assert kept.count() == 2 and {(r.bucket.hour, r.max_p_mil) for r in hours.collect()} == {(1, 5), (3, 7)}
    df.repartition(4).write.parquet(str(tmp_path / "r/day=2024-01-01"))
    before = sorted(p.name for p in (tmp_path / "r/day=2024-01-01").iterdir())
    streams.compact(spark, str(tmp_path / "r"), "2024-01-01", str(tmp_path / "v"), "camera_id")
    again = sinks.read_versioned(spark, str(tmp_path / "v"), "day=2024-01-01")
    assert sorted(map(str, again.collect())) == sorted(map(str, df.collect())) and before == sorted(p.name for p in (tmp_path / "r/day=2024-01-01").iterdir())


def test_alert_rules(spark):
    r = _readings(spark, [("a", at(1, 9, 10), 600, None), ("a", at(1, 9, 20), 600, None), ("a", at(1, 10, 5), 100, None), ("b", at(1, 10, 40), 900, None), ("z", at(1, 10, 1), 700, None), ("z", at(1, 10, 2), 800, "storm"), ("d", at(1, 8, 59), 990, None), ("k", at(1, 10, 3), 999, None)])
    cams = spark.createDataFrame([("a", False, "s1"), ("b", False, None), ("d", False, None), ("k", True, None)], "camera_id string, known_dry boolean, seg_id string")
    roads = spark.createDataFrame([("s1", 40)], "seg_id string, rating int")
    now = F.lit(at(1, 10, 30)).cast("timestamp")
    got = timeseries.camera_alerts(r.withColumn("depth_cm", F.lit(0)), cams, roads, now).collect()
    assert [(x.camera_id, x.is_replay, x.known_dry) for x in got] == [("z", True, False), ("z", False, False), ("a", False, False), ("k", False, True)]
    a = got[2]  # the first of equal readings; the newest; b's flag came later and d's before the window
    assert (a.worst.time, a.latest.time, a.latest.p_mil, a.rating) == (at(1, 9, 10), at(1, 10, 5), 100, 40)
    with pytest.raises(ValueError):
        timeseries.camera_alerts(r.withColumn("depth_cm", F.lit(0)), cams, roads, now, 3)
