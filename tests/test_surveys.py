import inspect
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corridor.common import Refused
from corridor.operators import ablation, chips, depth, depth_checks, models
from corridor.plans import queries as road
from corridor.plans import surveys  # noqa: F401  registers its queries


def chips_of(spark, n, side=8, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 256, (n, 4, side, side), dtype=np.uint8)
    return x, spark.createDataFrame([(k, bytearray(c.tobytes())) for k, c in enumerate(x)] + [(n, None)], "id long, chip binary")


def test_views_are_eight_and_turn_back(spark):
    x, df = chips_of(spark, 3)
    got = {(r.id, r.view): np.frombuffer(r.chip, np.uint8).reshape(4, 8, 8) for r in chips.expand_views(df, "id").collect()}
    assert len(got) == 24 and len({v.tobytes() for (i, _), v in got.items() if i == 0}) == 8
    assert all((chips.turned_back(v, k) == x[i]).all() for (i, k), v in got.items())


def test_chip_stats(spark):
    flat = np.zeros((4, 2, 2), np.uint8)
    flat[chips.NIR, 0, 0], flat[chips.RED, 0, 1] = 30, 60
    df = spark.createDataFrame([("a", bytearray(flat.tobytes()))], "id string, chip binary")
    r = chips.chip_stats(df, "id").first()
    assert (r.ndvi_mean, r.ndvi_std, r.impervious, r.blank, r.usable) == (0.0, pytest.approx(math.sqrt(0.5)), 0.75, 0.5, False) and r.bright_var == pytest.approx(75.0)
    with pytest.raises(Exception, match="four square bands"):
        chips.chip_stats(spark.createDataFrame([(1, bytearray(7))], "id long, chip binary"), "id").collect()
    assert chips.chip_stats(df.limit(0), "id").count() == 0


def test_augment_repeats_and_keeps_to_its_preset(spark):
    x, df = chips_of(spark, 40)
    rows = chips.augment(df, "id", 1, 2, chips.PRESETS["full"]).collect()
    again = {r.id: bytes(r.chip) for r in chips.augment(df.repartition(7), "id", 1, 2, chips.PRESETS["full"]).collect()}
    assert {r.id: bytes(r.chip) for r in rows} == again and len(rows) == 40
    assert len({r["view"] for r in rows}) > 4 and all(abs(r.dx) <= 4 and abs(r.dy) <= 4 and 0.9 <= r.gain <= 1.1 and 0.9 <= r.contrast <= 1.1 for r in rows)
    for r in rows:
        pad = np.pad(np.rot90(x[r.id][:, :, ::-1] if r["view"] >= 4 else x[r.id], r["view"] % 4, (1, 2)), ((0, 0), (4, 4), (4, 4)), mode="edge")
        out = np.clip(np.rint(pad[:, 4 - r.dy : 12 - r.dy, 4 - r.dx : 12 - r.dx] * np.float32(r.gain)), 0, 255).astype(np.uint8)
        grey = np.float32(out.mean())
        assert (np.clip(np.rint((out - grey) * np.float32(r.contrast) + grey), 0, 255).astype(np.uint8).tobytes()) == bytes(r.chip)
    same = chips.augment(df, "id", 1, 2, chips.PRESETS["none"]).collect()
    assert all(r.n_ops == 0 and bytes(r.chip) == x[r.id].tobytes() for r in same)
    with pytest.raises(Refused):
        chips.Preset((0,), gain=0.3)


def test_chip_plan_takes_one_tile(spark):
    tiles = spark.createDataFrame([(2, 0, 0, 10, 10), (1, 10, 0, 25, 10)], "tile long, x0 long, y0 long, x1 long, y1 long")
    pts = spark.createDataFrame([(1, 5, 5), (2, 10, 5), (3, 20, 10), (4, 30, 5)], "id long, x long, y long")
    plan = chips.chip_plan(pts, tiles, "id", cell=7)
    assert {r.id: r.tile for r in plan.collect()} == {1: 2, 2: 1, 3: 1, 4: None}
    assert tuple(chips.chip_census(plan).first()) == (4, 3, 1)


def walked(ground, seeds, steep=2.0):
    """Points set aside by walking from each seed, point by point."""
    aside, n = set(seeds), len(ground)
    for s in seeds:
        for way in (-1, 1):
            j = s
            while 0 <= j + 2 * way < n and ground[j + way] - ground[j] > steep and ground[j + 2 * way] - ground[j + way] > steep:
                j += way
                aside.add(j)
    return aside


def test_banks_are_walked_from_seeds_alone(spark):
    rng = random.Random(5)
    roads = {k: [float(rng.choice((0, 0, 3, 6, 9, 12, 15))) for _ in range(rng.randrange(1, 25))] for k in range(60)}
    bridge = {(k, i) for k, g in roads.items() for i in range(len(g)) if rng.random() < 0.2}
    rows = [(k, i, z, (k, i) in bridge, 30.0) for k, g in roads.items() for i, z in enumerate(g)]
    df = spark.createDataFrame(rows, "seg long, step int, ground double, bridge boolean, step_m double")
    got = {(r.seg, r.step) for r in depth.set_aside(df, F.col("bridge"), ["seg"], "step").where("aside").collect()}
    want = set()
    for k, g in roads.items():
        cut = {i for i in range(len(g)) for d in (1, 2) if i >= d and i + d < len(g) and g[i] <= min(g[i - d], g[i + d]) - 3}
        want |= {(k, i) for i in walked(g, cut | {i for i in range(len(g)) if (k, i) in bridge})}
    assert got == want and len(want - bridge) > 20


def test_a_silent_line_is_not_answered_for_by_a_farther_spot(spark):
    marks = [("a", "1", 0, 0.0, 0.0, 5.0), ("a", "2", 1, 0.0, 100.0, 50.0), ("a", "3", 2, 200.0, 100.0, 50.0), ("b", "4", 0, -250.0, 0.0, 1.0), ("b", "5", 1, -250.0, 400.0, 2.0)]
    lines = depth.build_lines(spark.createDataFrame(marks, "stream string, mark string, order_key int, x double, y double, z double"))
    pts = spark.createDataFrame([(1, 10.0, 50.0), (2, 100.0, 110.0), (3, 0.0, -90.0), (4, 0.0, -110.0)], "pt long, x double, y double")
    got = {r.pt: r for r in depth.locate(pts, depth.line_pieces(lines)).collect()}
    assert (got[1].stream, got[1].level) == ("b", 1.125) and (got[2].stream, got[2].level, got[2].close) == ("a", 50.0, True)
    assert (got[3].stream, got[3].level, got[3].close) == ("a", 5.0, False) and got[4].stream is None


def test_runs_start_from_their_first_mark(spark):
    marks = spark.createDataFrame([("s", k, k, 0.6 * k, 0.0, float(k), True) for k in range(6)], "stream string, mark int, order_key int, x double, y double, z double, draws boolean")
    assert {r.mark: r.k for r in depth_checks.runs_of_marks(marks).collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2}


def walk(rng, n, steps, stream, at):
    """Marks of a stream that wanders: (stream, mark, order_key, x, y, z, draws), some order keys equal."""
    x, y, out = at, at / 2, []
    for k in range(n):
        step = rng.choice(steps)
        x, y = x + step * rng.uniform(-0.5, 1), y + step * rng.uniform(-0.5, 1)
        out.append((stream, k, k // 2, x, y, 10 + 1.5 * rng.random(), rng.random() > 0.1))
    return out


MARKS = "stream string, mark int, order_key int, x double, y double, z double, draws boolean"


def folded(rows, merge=1.0):
    """stream and mark to the place of the run, mark by mark."""
    first, k = {}, {}
    for s, m, _, x, y, *_ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if s not in first or math.hypot(x - first[s][0], y - first[s][1]) >= merge:
            first[s], k[s] = (x, y), k.get(s, -1) + 1
        yield (s, m), k[s]


def test_runs_are_those_of_a_walk_from_mark_to_mark(spark):
    rng = random.Random(11)
    rows = [r for s in range(12) for r in walk(rng, rng.choice((1, 2, 3, 40)), (0.0, 0.2, 0.5, 0.9, 1.3, 2.5), f"s{s}", 90.0 * s)]
    rows += walk(rng, 700, (0.02, 0.06), "dense", 0.0) + [("same", k, k, 5.0, 5.0, 1.0, True) for k in range(300)]
    got = {(r.stream, r.mark): r.k for r in depth_checks.runs_of_marks(spark.createDataFrame(rows, MARKS)).collect()}
    assert got == dict(folded(rows)) and max(k for (s, _), k in got.items() if s == "dense") > 3 and got["same", 299] == 0
    lines = depth.build_lines(spark.createDataFrame(rows, MARKS))
    assert sum(r.marks for r in lines.collect()) == len(rows) and lines.count() == len(set((s, k) for (s, _), k in got.items()))


def test_a_mark_without_a_place_starts_no_run(spark):
    rows = [("s", 0, 0, 0.0, 0.0, 1.0, True), ("s", 1, 1, None, 0.0, 1.0, True), ("s", 2, 2, 0.5, 0.0, 1.0, True), ("s", 3, 3, 9.0, 0.0, 1.0, True)]
    assert [r.k for r in depth_checks.runs_of_marks(spark.createDataFrame(rows, MARKS)).orderBy("mark").collect()] == [0, 0, 0, 1]
    assert depth_checks.hidden_mark_test(spark.createDataFrame([], MARKS)).count() == 0


def guesses(rows):
    """stream, mark and stretch to guess and distance along: every line built anew from the marks that are left."""
    k, drawn = dict(folded([r for r in rows if r[6]])), [r for r in rows if r[6]]
    mean = lambda ms: [sum(m[c] for m in ms) / len(ms) for c in (3, 4, 5)]

    def line(ms):
        places = sorted({k[m[:2]] for m in ms})
        return [mean([m for m in ms if k[m[:2]] == p]) for p in places]

    def say(x, y, spots):
        best = None
        pieces = list(zip(spots, spots[1:], strict=False)) or [(spots[0], spots[0])]
        for i, (p, q) in enumerate(pieces):
            dx, dy = q[0] - p[0], q[1] - p[1]
            gap = math.hypot(dx, dy)
            ahead = ((x - p[0]) * dx + (y - p[1]) * dy) / gap if gap else 0.0
            foot = min(max(ahead, 0.0), gap)
            t = foot / gap if gap else 0.0
            end = (i == 0 and ahead < 0) or (i == len(pieces) - 1 and ahead > gap) or gap <= 0
            along = min(foot, gap - foot)
            lift = 0.0 if end or not gap else along * abs(q[2] - p[2]) / gap
            d = math.hypot(x - p[0] - t * dx, y - p[1] - t * dy)
            if best is None or d < best[0] - 1e-9:
                best = (d, p[2] + t * (q[2] - p[2]), math.hypot(along, d), d <= 100 if end else along <= 1000 and lift <= 2)
        return best if best[0] <= 300 and best[3] else None

    streams = {s: [m for m in drawn if m[0] == s] for s in {m[0] for m in drawn}}
    station = {}
    for s, ms in streams.items():
        spots = line(ms)
        ends = [0.0]
        for p, q in zip(spots, spots[1:], strict=False):
            ends.append(ends[-1] + math.hypot(q[0] - p[0], q[1] - p[1]))
        station |= {m[:2]: ends[k[m[:2]]] for m in ms}
    for m in rows:
        for stretch in (0, 250, 500) if m[6] else (-1,):
            own = [o for o in streams.get(m[0], []) if stretch < 0 or (o[1] != m[1] if stretch == 0 else abs(station[o[:2]] - station[m[:2]]) > stretch)]
            found = [(v[0], s, v) for s, ms in (streams | {m[0]: own}).items() if ms for v in [say(m[3], m[4], line(ms))] if v]
            yield (m[0], m[1], stretch), min(found)[2][1:3] if found else (None, None)


def test_hidden_marks_are_guessed_as_if_every_line_were_built_anew(spark):
    rng = random.Random(7)
    rows = [r for s in range(9) for r in walk(rng, (1, 2, 3, 6, 25)[s % 5], (0.0, 0.3, 0.8, 40, 150, 300), f"s{s}", 70.0 * s)]
    got = {(r.stream, r.mark, r.stretch): (r.guess, r.along) for r in depth_checks.hidden_mark_test(spark.createDataFrame(rows, MARKS)).collect()}
    want = dict(guesses(rows))
    assert set(got) == set(want) and sum(v[0] is not None for v in want.values()) > 100
    assert all((v[0] is None) == (w[0] is None) and (v[0] is None or v == pytest.approx(w, abs=1e-6)) for key, w in want.items() for v in [got[key]])


def test_hidden_marks_bands_and_gates(spark):
    rows = [("s", k, k, 0.0, 200.0 * k, 10.0 + k, True) for k in range(8)] + [("s", 9, 9, 20.0, 500.0, 13.0, False), ("lone", 20, 0, 150.0, 400.0, 12.5, True)]
    marks = spark.createDataFrame(rows, "stream string, mark int, order_key int, x double, y double, z double, draws boolean")
    hidden = depth_checks.hidden_mark_test(marks)
    got = {(r.mark, r.stretch): (r.guess, r.along, r.miss) for r in hidden.collect()}
    assert got[3, 0] == (13.0, 200.0, 0.0) and got[3, 250] == (13.0, 400.0, 0.0) and got[3, 500] == (None, None, None)  # the level moves 3 m
    assert got[0, 0] == (None, None, None) and got[9, -1][0] == 12.5 and got[20, 0][0] == 12.0 and len(got) == 9 * 3 + 1
    bands = {r.lo: (r.n, r.median, r.too_few) for r in depth_checks.band_table(hidden).collect()}
    assert bands[0][0] == 0 and bands[100][0] == 7 and bands[100][2] and bands[250][0] == 4 and bands[500][0] == 0
    taped = marks.withColumns({"tape": F.when(F.col("mark") % 2 == 0, F.lit(1.0)), "ground": F.col("z") - 1.1, "ground30": F.col("z") - 2.0})
    tests = {r.test: r for r in depth_checks.tape_tests(taped, hidden).collect()}
    assert tests["own level"].median == pytest.approx(0.1) and tests["own level"].n == 5 and tests["own level"].corr is None
    with pytest.raises(Refused, match="too few"):
        depth_checks.gates(taped, hidden)
    many = hidden.unionAll(hidden).unionAll(hidden).unionAll(hidden).unionAll(hidden)
    assert depth_checks.gates(taped, many)["miss_fine"] == pytest.approx(0.1)
    for changed, words in (({"ground": F.col("z") - 9}, "units"), ({"ground30": F.col("z") - 1.0}, "coarse"), ({"ground": F.col("z") - 1.6}, "misses")):
        with pytest.raises(Refused, match=words):
            depth_checks.gates(taped.withColumns(changed), many)


def test_rescale_by_group(spark):
    rng = random.Random(1)
    rows = [("a", float(x), x * 2.0) for x in range(1, 61)] + [("b", float(x), x * 3.0) for x in rng.sample(range(1, 60), 5)] + [("a", 500.0, None), ("a", None, 9.0), (None, 5.0, None)]
    df = spark.createDataFrame(rows, "g string, est double, n double")
    got = {(r.g, r.est): r.rescaled for r in ablation.rescale(df, "est", "n", "g").collect()}
    assert got["a", 30.0] == pytest.approx(60.0) and got["a", 500.0] == pytest.approx(120.0) and got["a", None] is None and got[None, 5.0] is None
    b = sorted((e, v) for (g, e), v in got.items() if g == "b")
    assert all(v > 0 for _, v in b) and all(x[1] <= y[1] + 1e-9 for x, y in zip(b, b[1:], strict=False))
    few = ablation.rescale(df.limit(20), "est", "n", "g")
    assert few.where("est is not null and rescaled != est").count() == 0


def test_ablation_and_transfer(spark):
    rng = random.Random(2)
    rows = [(k, rng.random(), rng.random(), f"b{k % 12}", k % 12 % 5, "w" if k % 12 < 8 else "e", 2000 + k % 3) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double, block string, fold int, place string, year int")
    df = df.withColumns({"y": F.col("a") * 4 + F.col("b"), "hit": (F.col("a") > 0.7).cast("int")})
    arms = {r.arm: r for r in ablation.ablation(df, "id", [("b", ["b"]), ("+ a", ["a", "b"])], "y", "rate", "block", draws=100, iterations=5, most_rho=1.0).collect()}
    assert arms["b"].change == 0 and arms["+ a"].mae < arms["b"].mae / 2 and arms["+ a"].low < arms["+ a"].change < arms["+ a"].high < 0
    assert arms["+ a"].change == pytest.approx(arms["+ a"].mae - arms["b"].mae)
    with pytest.raises(Refused):
        ablation.ablation(df, "id", [("+ a", ["a", "b"])], "y", "rate", "block", draws=5, iterations=5)
    both = ablation.ablations(df, "id", [("b", ["b"]), ("+ a", ["a", "b"])], {"y": ("y", "rate"), "hit": ("hit", "yes")}, "block", draws=60, iterations=5, most_rho=1.0)
    last = {r.arm: r for r in both.collect()}["+ a"]
    assert last.hit_low <= last.hit_change <= last.hit_high and last.hit_low > 0.2 and last.hit_top_precision == 1.0 and last.hit_n == 600 and last.y_mae == pytest.approx(arms["+ a"].mae)
    got = {(r.part, r.method): r for r in ablation.transfer_test(df, "id", ["a", "b"], ["b"], "hit", "place", "w", "e", F.col("year") < 2002, "b", iterations=5).collect()}
    assert got["moved", "model"].ap > 0.95 > 0.6 > got["moved", "plain model"].ap and got["held out", "model"].n == df.where("place = 'w' and year < 2002").count()
    one_class = models.fit_predict(df.where("hit = 1"), df, "id", ["a"], [], "hit", "yes")
    assert one_class.count() == 0


@pytest.mark.parametrize("name", ["mod1_oof", "mod3_ablation", "qry9_traffic_crash_ablation", "mod8_transfer"])
def test_fitted_queries_run_the_default_rounds(spark, sf, monkeypatch, name):
    class Reached(Exception):
        pass

    def estimator(kind, label, iterations):
        raise Reached(iterations)

    monkeypatch.setattr(models, "estimator", estimator)
    with pytest.raises(Reached) as e:
        road.QUERIES[name](spark, sf)
    assert e.value.args == (inspect.signature(models.oof).parameters["iterations"].default,) == (30,)


def test_the_ablation_query_scores_every_label(spark, sf, monkeypatch):
    asked = []

    def one(df, key, ladder, label, kind, *how):
        asked.append((label, kind, df.where(F.col(label).isNotNull()).agg(F.count("*"), F.min(label), F.max(label)).first()))
        return spark.createDataFrame([(name, len(columns), 1.0) for name, columns in ladder], "arm string, n_inputs int, change double")

    monkeypatch.setattr(ablation, "ablation", one)
    out = road.QUERIES["qry9_traffic_crash_ablation"](spark, sf)
    assert [a[:2] for a in asked] == [("wear", "rate"), ("cracked", "yes"), ("failed", "yes")] and out.count() == 4
    assert {"rate_change", "crack_change", "flood_change"} < set(out.columns)
    assert all(tuple(a[2][1:]) == (0, 1) for a in asked[1:]) and asked[0][2][0] > asked[2][2][0] > 0  # floods in the zone alone
