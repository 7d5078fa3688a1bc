import pytest
from pyspark.sql import functions as F

from corridor.common import Refused
from corridor.operators import checks, ranking


def test_group_parts_and_small_groups(spark):
    df = spark.createDataFrame([("a", k, k % 7) for k in range(60)] + [("b", 100 + k, k) for k in range(3)] + [("a", 99, None)], "g string, id long, s long")
    got = {r.id: r.part for r in ranking.ntile_by_rank(df, "s", 5, ["g"], "id", 10, "part").collect()}
    order = sorted(range(60), key=lambda k: (k % 7, k))
    assert got == {k: -(-5 * (i + 1) // 60) for i, k in enumerate(order)} | {100: 0, 101: 0, 102: 0}


def test_lift_range_needs_events_in_the_best_fifth(spark):
    rows = [("x", b, f, e, 2) for b in range(8) for f, e in ((5, 6), (1, 2))] + [("y", b, f, 6 if f == 5 else 0, 2) for b in range(8) for f in (1, 5)]
    got = {r.c: r for r in checks.lift_range(spark.createDataFrame(rows, "c string, block long, fifth int, e long, m long"), ["c"], "fifth", "e", "m", "block", 600).collect()}
    assert (got["x"].low, got["x"].high, got["x"].draws) == (3.0, 3.0, 600) and got["y"].low is None and got["y"].draws == 0


def test_grades(spark):
    manifest = spark.createDataFrame([(1, "c1", "a"), (2, "c1", "b"), (3, "c2", "c"), (4, "c3", "d")], "index long, camera_id string, file string")
    triage = spark.createDataFrame([(1, "unusable"), (2, "clear"), (3, "clear"), (4, "clear")], "index long, view string")
    damage = spark.createDataFrame([(2, "cracks_or_patches"), (3, "cant_tell")], "index long, damage string")
    g = checks.grades_from_sheets(manifest, triage, damage)
    assert sorted((r.file, r.view, r.damage) for r in g.collect()) == [("a", "unusable", ""), ("b", "clear", "cracks_or_patches"), ("c", "clear", "cant_tell")]
    assert checks.checked_grades(g, manifest) is g
    assert [tuple(r) for r in checks.decided(g).collect()] == [("c1", "b", "cracks_or_patches")]
    for bad in (triage.unionAll(triage.limit(1)), triage.withColumn("index", F.col("index") + 1)):
        with pytest.raises(Refused):
            checks.grades_from_sheets(manifest, bad, damage)
    with pytest.raises(Refused):
        checks.checked_grades(g, manifest.where("camera_id = 'c2'"))
    places = spark.createDataFrame([(0, "c1", "b")], "repeat_index long, camera_id string, file string")
    twice = checks.grades_from_sheets(manifest, triage, damage, spark.createDataFrame([(0, "none")], "repeat_index long, damage string"), places)
    assert [tuple(r) for r in twice.where("pass = 2").collect()] == [("c1", "b", 2, "clear", "none")]
    odd = spark.createDataFrame([("c1", "a", 1, "clear", ""), ("c1", "b", 3, "far", "none"), ("c9", "a", 1, None, None), ("c1", "a", 1, "clear", "none")], g.schema)
    assert {r.rule: r.broken for r in checks.grade_report(odd, manifest).collect()} == {"view": 1, "damage": 2, "pass": 1, "camera": 1, "repeated": 1}


def test_a_summary_is_held_against_one_made_anew(spark):
    anew = spark.createDataFrame([("a", 1, 2, 0.1 + 0.2), ("b", 1, 1, None), (None, 1, 4, 5.0), ("c", 2, 1, 1.0)], "k string, hour int, n long, mean double")
    good = spark.createDataFrame([("a", 1, 2, 0.3), ("b", 1, 1, None), (None, 1, 4, 5.0), ("c", 2, 1, 1.0)], anew.schema)
    raw = spark.range(8).withColumn("replay_of", F.lit(None).cast("long"))
    replayed = raw.unionAll(spark.range(5).withColumn("replay_of", F.col("id")))
    report = lambda s, *more: {r.what: r.broken for r in checks.verify_summary(s, anew, ["k", "hour"], *more).collect()}
    assert set(report(good, replayed).values()) == {0} and set(report(good)) == {"missing", "extra", "repeated", "value: n", "value: mean"}
    bad = spark.createDataFrame([("a", 1, 3, 0.3), ("a", 1, 3, 0.3), ("b", 1, 1, 7.0), (None, 1, 4, 5.1), ("d", 2, 1, 1.0)], anew.schema)
    assert report(bad, raw) == {"missing": 1, "extra": 1, "repeated": 1, "value: n": 1, "value: mean": 2, "rows told of": 4}
    none = anew.limit(0)
    assert {r.what: r.broken for r in checks.verify_summary(none, none, ["k", "hour"], raw.limit(0)).collect()}.keys() == report(good, raw).keys()
    times = raw.select(F.timestamp_seconds("id").alias("time"), "replay_of")
    later = times.unionAll(spark.range(9, 10).select(F.timestamp_seconds("id").alias("time"), F.lit(3).cast("long").alias("replay_of")))
    at = lambda a, b: [r.broken for r in checks.verify_times(a, b).collect()]
    assert at(later, times) == [0, 0] and at(times.where("time > timestamp_seconds(0)"), times) == [1, 0] and at(times.limit(0), times) == [1, 1] and at(times.limit(0), times.limit(0)) == [0, 0]
