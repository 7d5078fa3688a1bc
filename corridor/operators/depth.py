"""Flood depth along streams: water lines through surveyed marks, points placed on them, depth over ground, raster samples."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridor.common import Refused, checkpointed
from corridor.functions.geo import piece_distance, point_at, sample_stations
from corridor.functions.measures import depth_band, typical_miss
from corridor.operators.gates import assert_key, domain_report, orphans
from corridor.operators.mark_runs import run_places

# Fixed values, metres: to the side of a line, past its end, along it to a mark, moved from the nearer mark's level,
# to a mark that is close by, water over ground that is still believed, to a listed bridge, depth of a notch, and the
# climb of a bank in BANK_STEP metres.
SIDE, END, REACH, LIFT, CLOSE, TOO_DEEP = 300.0, 100.0, 1000.0, 2.0, 250.0, 15.0
# Fixed value: the share of points that may be too deep.
MOST_TOO_DEEP = 0.005
BRIDGE, NOTCH, BANK, BANK_STEP = 60.0, 3.0, 2.0, 30.0
# Cells in which any two spots are within SIDE, and a bound of coordinates that leaves out what is no number.
COARSE, FAR_OUT = 200.0, 1e12


def build_lines(marks: DataFrame, merge: float = 1.0) -> DataFrame:
    """Marks (stream, mark, order_key, x, y, z) to water lines (stream, k, x, y, z, station, marks).

    Along a stream, marks closer than ``merge`` metres to the first of their run become one with their means.
    """
    means = [F.avg(F.col(c).cast("double")).alias(c) for c in ("x", "y", "z")]
    spots = run_places(marks, merge).groupBy("stream", "k").agg(*means, F.count("*").alias("marks"))
    return cumulative_station(spots, ["stream"], "k").select("stream", "k", "x", "y", "z", "station", "marks")


def line_pieces(lines: DataFrame) -> DataFrame:
    """A row for each piece with both ends; a stream of one mark is one piece of length 0."""
    w = Window.partitionBy("stream").orderBy("station")
    nxt = {f"{c}2": F.lead(c).over(w) for c in ("x", "y", "z", "station")}
    p = lines.withColumns({**nxt, "first": F.row_number().over(w) == 1, "n": F.count("*").over(Window.partitionBy("stream"))})
    p = p.where(F.col("x2").isNotNull() | (F.col("n") == 1)).withColumns({c: F.coalesce(c, c[:-1]) for c in nxt})
    return p.withColumn("final", F.lead("k").over(w).isNull())


def meetings(points: DataFrame, pieces: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Points (x, y) beside the pieces (ends x1, y1, z1 and x2, y2, z2) whose grid cells hold them: all within SIDE and more."""
    size = 2 * SIDE
    box = [F.floor((F.least(a, b) - SIDE) / size) for a, b in (("x1", "x2"), ("y1", "y2"))] + [F.floor((F.greatest(a, b) + SIDE) / size) for a, b in (("x1", "x2"), ("y1", "y2"))]
    cells = F.flatten(F.transform(F.sequence(box[0], box[2]), lambda i: F.transform(F.sequence(box[1], box[3]), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    b = pieces.withColumnsRenamed({"x": "x1", "y": "y1", "z": "z1"}).withColumn("_c", F.explode(cells))
    a = points.withColumn("_c", F.struct(F.floor(F.col("x") / size).alias("i"), F.floor(F.col("y") / size).alias("j")))
    return a.join(b, ["_c", *on]).drop("_c")


def spot_on(x: Column, y: Column, of: Callable[[str], Column]) -> Column:
    """Of a piece (k, ends x1, y1, z1 and x2, y2, z2, first, final): its nearest spot to (x, y), ordered by distance and k."""
    dx, dy = of("x2") - of("x1"), of("y2") - of("y1")
    gap = F.hypot(dx, dy)
    ahead = F.coalesce(((x - of("x1")) * dx + (y - of("y1")) * dy) / F.nullif(gap, F.lit(0.0)), F.lit(0.0))
    foot = F.least(F.greatest(ahead, F.lit(0.0)), gap)
    t = F.coalesce(foot / F.nullif(gap, F.lit(0.0)), F.lit(0.0))
    along = F.least(foot, gap - foot)
    at_end = (of("first") & (ahead < 0)) | (of("final") & (ahead > gap)) | (gap <= 0)
    lift = F.when(at_end, 0.0).otherwise(F.coalesce(along * F.abs(of("z2") - of("z1")) / F.nullif(gap, F.lit(0.0)), F.lit(0.0)))
    dist = F.hypot(x - of("x1") - t * dx, y - of("y1") - t * dy)
    return F.struct(dist.alias("dist"), of("k").alias("k"), (of("z1") + t * (of("z2") - of("z1"))).alias("level"), along.alias("along"), lift.alias("lift"), at_end.alias("at_end"))


def speaks(of: Callable[[str], Column]) -> Column:
    """Whether a line speaks at its nearest spot."""
    return F.when(of("at_end"), of("dist") <= END).otherwise((of("along") <= REACH) & (of("lift") <= LIFT))


def spoken(met: DataFrame) -> DataFrame:
    """For each point (pt, x, y) and line of ``meetings`` within SIDE: the line's nearest spot to it, and whether it speaks there.

    It speaks past an end up to END metres; between marks where the nearer one is within REACH along the line and the
    level has moved LIFT at most from that mark's. mark_dist goes along to the nearer mark and across to the point.
    """
    spot = spot_on(F.col("x"), F.col("y"), F.col)
    near = met.groupBy("pt", "stream").agg(F.min(spot).alias("m")).select("pt", "stream", "m.*").where(F.col("dist") <= SIDE)
    return near.withColumns({"speaks": speaks(F.col), "mark_dist": F.hypot("along", "dist")})


def answers(points: DataFrame, pieces: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """What lines say at points: pieces meet points by grid cells, and by the columns ``on`` where a point is for some lines only."""
    return spoken(meetings(points, pieces, on))


def nearest_answer(found: DataFrame) -> DataFrame:
    """pt with the nearest line that speaks (ties: the first stream), its level, distances, and whether a mark is close."""
    best = found.where("speaks").groupBy("pt").agg(F.min(F.struct("dist", "stream", "level", "mark_dist", "at_end")).alias("b"))
    return best.select("pt", "b.stream", "b.level", "b.dist", "b.mark_dist", (~F.col("b.at_end") & (F.col("b.mark_dist") <= CLOSE)).alias("close"))


def locate(points: DataFrame, pieces: DataFrame) -> DataFrame:
    """Points (pt, x, y) with the level of the nearest line that speaks there; nulls where none does.

    A line that may not speak at its own nearest spot is silent: no farther spot of it answers instead.
    """
    return points.select("pt").join(nearest_answer(answers(points, pieces)), "pt", "left")


def notch(ground: str, seg: list[str], order: str, drop: float = NOTCH) -> Column:
    """Ground at least ``drop`` below both neighbours one place away, or both two places away: a bridge or culvert cut."""
    w = Window.partitionBy(*seg).orderBy(order)
    below = [F.least(F.lag(ground, k).over(w), F.lead(ground, k).over(w)) - F.col(ground) >= drop for k in (1, 2)]
    whole = [F.lag(ground, k).over(w).isNotNull() & F.lead(ground, k).over(w).isNotNull() for k in (1, 2)]
    return F.coalesce(whole[0] & below[0], F.lit(False)) | F.coalesce(whole[1] & below[1], F.lit(False))


def set_aside(points: DataFrame, near_bridge: Column, seg: list[str], order: str, ground: str = "ground", step_m: str = "step_m") -> DataFrame:
    """``points`` with aside: by a bridge, in a notch, or on a bank that climbs away from such a point.

    A bank point is set aside while the ground climbs over BANK metres in BANK_STEP from the seed through to the point
    after it, on either side, so that the top is kept. With the places of the last seed and of the last step that does
    not climb, this is two running maxima a side; ``order`` numbers the points of a part and ``step_m`` is one for it.
    """
    w = Window.partitionBy(*seg).orderBy(order)
    df = points.withColumn("_seed", F.coalesce(near_bridge, F.lit(False)) | notch(ground, seg, order))
    banks = []
    for nxt, way in ((F.lead, w), (F.lag, Window.partitionBy(*seg).orderBy(F.desc(order)))):
        place = F.col(order) if nxt is F.lead else -F.col(order)
        climbs = F.coalesce(nxt(ground, 1).over(w) - F.col(ground) > F.lit(BANK / BANK_STEP) * F.col(step_m), F.lit(False))
        c = f"_climbs{len(banks)}"
        df = df.withColumn(c, climbs)
        seed = F.max(F.when(F.col("_seed"), place)).over(way.rowsBetween(Window.unboundedPreceding, -1))
        stop = F.max(F.when(~F.col(c), place)).over(way.rowsBetween(Window.unboundedPreceding, 0))
        banks.append(seed.isNotNull() & (stop.isNull() | (seed > stop)))
    return df.withColumn("aside", F.col("_seed") | banks[0] | banks[1]).drop("_seed", "_climbs0", "_climbs1")


def depth(level: Column, ground: Column) -> Column:
    """Water over ground, 0 at least; null without either, and where over TOO_DEEP, which is no road flood."""
    d = F.greatest(level - ground, F.lit(0.0))
    return F.when(level.isNotNull() & ground.isNotNull() & (d <= TOO_DEEP), d)


def kept_points(points: DataFrame) -> DataFrame:
    """Points (level, ground, aside) with depth, too_deep and kept: those that have a depth, are not aside and not too deep."""
    usable = F.col("level").isNotNull() & F.col("ground").isNotNull()
    water = F.when(usable, F.greatest(F.col("level") - F.col("ground"), F.lit(0.0)))
    deep = usable & ~F.col("aside") & (water > TOO_DEEP)
    return points.withColumns({"depth": water, "too_deep": deep}).withColumn("kept", usable & ~F.col("aside") & ~F.col("too_deep"))


def assert_few_too_deep(points: DataFrame) -> DataFrame:
    """``kept_points``, refused where over MOST_TOO_DEEP of those with a depth are too deep: then an input is wrong."""
    n, deep = points.agg(F.count_if(F.col("kept") | F.col("too_deep")), F.count_if("too_deep")).first()
    if deep > MOST_TOO_DEEP * max(1, n):
        raise Refused(f"{deep} of {n} road points are deeper than {TOO_DEEP} m")
    return points


def summarise(points: DataFrame, bands: list[tuple[float, float, float | None, bool]] = ()) -> DataFrame:
    """A row for each segment of kept_points (seg_id, part, step, depth, kept, aside, along, close, stream, marks).

    The headline is the greatest depth that two neighbouring kept points of a part share; the first such pair in road
    order also gives distance, confidence (high where both are close to a mark) and stream (the deeper point's). Where it
    is 0, the median distance, the more common confidence and the most common stream (the first by name) stand in. A
    segment without a pair is not assessed: its values are null, its counts are not.
    """
    w = Window.partitionBy("seg_id", "part").orderBy("step")
    nxt = {c: F.lead(c).over(w) for c in ("depth", "kept", "along", "close", "stream")}
    df = points.withColumns({f"_{c}": v for c, v in nxt.items()})
    pair = F.when(F.col("kept") & F.coalesce("_kept", F.lit(False)), F.least("depth", "_depth"))
    deeper = F.when(F.col("depth") >= F.col("_depth"), F.col("stream")).otherwise(F.col("_stream"))
    found = F.struct(pair.alias("head"), (-F.col("part")).alias("p"), (-F.col("step")).alias("s"), F.greatest("along", "_along").alias("dist"), (F.col("close") & F.col("_close")).alias("high"), deeper.alias("stream"))
    kept = F.col("kept")
    per = df.groupBy("seg_id").agg(
        F.max(F.when(pair.isNotNull(), found)).alias("m"), F.max(F.when(kept, F.col("depth"))).alias("point_max"), F.avg(F.when(kept, (F.col("depth") > 0).cast("double"))).alias("wet_share"),
        F.median(F.when(kept, F.col("along"))).alias("mid"), (F.avg(F.when(kept, F.col("close").cast("double"))) >= 0.5).alias("mostly"),
        F.count_if(kept).alias("n_points"), F.count_if("aside").alias("n_set_aside"), F.size(F.array_distinct(F.flatten(F.collect_set(F.when(kept, F.col("marks")))))).alias("n_marks"),
    )
    named = points.where("kept").groupBy("seg_id", "stream").agg(F.count("*").alias("n")).groupBy("seg_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "stream"))["stream"].alias("common"))
    out = per.join(named, "seg_id", "left")
    wet, there = F.col("m.head") > 0, F.col("m").isNotNull()
    dist = F.when(wet, F.col("m.dist")).when(there, F.col("mid"))
    high = F.when(wet, F.col("m.high")).otherwise(F.col("mostly"))
    return out.select(
        "seg_id", there.alias("assessed"), F.col("m.head").alias("headline"), *[F.when(there, F.col(c)).alias(c) for c in ("point_max", "wet_share")], depth_band(F.col("m.head")).alias("band"),
        F.when(there, F.when(high, "high").otherwise("low")).alias("confidence"), dist.alias("mark_dist"), typical_miss(dist, list(bands)).alias("typical_miss"),
        F.when(wet, F.col("m.stream")).when(there, F.col("common")).alias("stream"), F.when(there, F.col("n_marks")).otherwise(0).alias("n_marks"), "n_points", "n_set_aside",
    )


def live_parts(pieces: DataFrame) -> DataFrame:
    """The parts of pieces (x, y, x2, y2) within REACH along the line of a mark: a long gap gives its first and last REACH."""
    gap = F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))
    far = gap > 2 * REACH
    ux, uy = (F.col("x2") - F.col("x")) / gap * REACH, (F.col("y2") - F.col("y")) / gap * REACH
    part = lambda a, b, c, d: F.struct(a.alias("lx1"), b.alias("ly1"), c.alias("lx2"), d.alias("ly2"))
    x, y, x2, y2 = (F.col(c) for c in ("x", "y", "x2", "y2"))
    parts = F.when(far, F.array(part(x, y, x + ux, y + uy), part(x2 - ux, y2 - uy, x2, y2))).otherwise(F.array(part(x, y, x2, y2)))
    return pieces.select("stream", "k", F.explode(parts).alias("p")).select("stream", "k", "p.*")


def _spots_of(live: DataFrame) -> DataFrame:
    """i, j and spots: for every cell of COARSE metres that a live part's sampled spots lie in, the outermost of them."""
    ends = [F.col(c) for c in ("lx1", "ly1", "lx2", "ly2")]
    sound = reduce(lambda u, v: u & v, [F.abs(c) < FAR_OUT for c in ends])
    n = F.greatest(F.ceil(F.hypot(ends[2] - ends[0], ends[3] - ends[1]) / COARSE), F.lit(1))
    t = F.col("_k") / n
    each = live.where(sound).select(*ends, F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("_k"))
    each = each.select((ends[0] + t * (ends[2] - ends[0])).alias("x"), (ends[1] + t * (ends[3] - ends[1])).alias("y"))
    outer = [F.struct(f("x", by).alias("x"), f("y", by).alias("y")) for by in ("x", "y") for f in (F.min_by, F.max_by)]
    return each.groupBy(*_coarse(F.col("x"), F.col("y"))).agg(F.array(*outer).alias("spots"))


def _coarse(x: Column, y: Column) -> list[Column]:
    return [F.floor(x / COARSE).alias("i"), F.floor(y / COARSE).alias("j")]


def candidates(lines: DataFrame, pieces: DataFrame, spacing: float = 30.0) -> DataFrame:
    """Every sampled point (seg_id, step, x, y, step_m) of every road (seg_id, line) within SIDE of a live part of a water line.

    A road that shares a cell of COARSE metres with a live part, or lies within SIDE of one of the outermost spots of the
    cells around it, is near for certain and meets no piece. Exact distances to the pieces decide the rest, so where water
    lines are dense few roads meet any.
    """
    size = 2 * SIDE

    def cells(x1: Column, y1: Column, x2: Column, y2: Column, pad: float) -> Column:
        i = F.sequence(F.floor((F.least(x1, x2) - pad) / size), F.floor((F.greatest(x1, x2) + pad) / size))
        j = F.sequence(F.floor((F.least(y1, y2) - pad) / size), F.floor((F.greatest(y1, y2) + pad) / size))
        return F.explode(F.flatten(F.transform(i, lambda a: F.transform(j, lambda b: F.struct(a.alias("i"), b.alias("j"))))))

    live = checkpointed(live_parts(pieces).select("lx1", "ly1", "lx2", "ly2"))
    spots = checkpointed(_spots_of(live))
    n = F.size("line")
    # a vertex of a piece with both its ends
    middle = F.floor((n - 1) / 2).cast("int")
    at, onward = F.get("line", middle), F.get("line", middle + 1)
    sound = reduce(lambda u, v: u & v, [F.abs(e[c]) < FAR_OUT for e in (at, onward) for c in "xy"])
    roads = lines.select("seg_id", "line", F.when(sound, at).alias("_m"))
    held = roads.withColumns({k: v for k, v in zip(("i", "j"), _coarse(F.col("_m.x"), F.col("_m.y")), strict=True)})
    held = held.join(spots.select("i", "j", F.lit(True).alias("_sure")), ["i", "j"], "left")
    held = checkpointed(held.select("seg_id", "line", "_m", "i", "j", F.coalesce("_sure", F.lit(False)).alias("_sure")))

    rest = held.where(~F.col("_sure"))
    reach = int(SIDE // COARSE) + 1
    around = F.explode(F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]))
    by = F.exists("spots", lambda e: F.hypot(e["x"] - F.col("_m.x"), e["y"] - F.col("_m.y")) <= SIDE * (1 - 1e-9))
    asked = rest.where("_m is not null").select("seg_id", "_m", around.alias("_c")).select("seg_id", "_m", "_c.*")
    sure = checkpointed(asked.join(spots, ["i", "j"]).where(by).select("seg_id").distinct())

    own = rest.join(sure, "seg_id", "left_anti").select("seg_id", F.explode(F.arrays_zip(F.slice("line", F.lit(1), n - 1).alias("a"), F.slice("line", F.lit(2), n - 1).alias("b"))).alias("z")).select("seg_id", "z.a", "z.b")
    own = own.withColumn("_c", cells(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"), 0.0))
    p = F.struct(F.col("lx1").alias("x"), F.col("ly1").alias("y"))
    q = F.struct(F.col("lx2").alias("x"), F.col("ly2").alias("y"))
    apart = lambda a, b, c, d: F.greatest(F.least(a, b) - F.greatest(c, d), F.least(c, d) - F.greatest(a, b))
    bounds = F.greatest(*[apart(F.col(f"a.{v}"), F.col(f"b.{v}"), F.col(f"l{v}1"), F.col(f"l{v}2")) for v in "xy"])
    live = live.withColumn("_c", cells(*(F.col(c) for c in ("lx1", "ly1", "lx2", "ly2")), SIDE))
    own = checkpointed(own.join(live.select("_c").distinct(), "_c", "left_semi"))
    live = live.join(own.select("_c").distinct(), "_c", "left_semi")
    met = own.join(live, "_c").where(bounds <= SIDE)  # before the exact distance, which costs more
    near = met.where(piece_distance(F.col("a"), F.col("b"), p, q) <= SIDE).select("seg_id")
    # rows of one seg_id are near together
    near = checkpointed(near.union(sure).distinct())
    near = near.union(held.where("_sure").select("seg_id"))
    s = held.where("_sure").select("seg_id", "line").union(rest.select("seg_id", "line").join(near, "seg_id", "left_semi"))
    s = s.withColumn("_s", sample_stations(F.col("line"), spacing))
    s = s.select("seg_id", "line", F.posexplode("_s").alias("step", "_at"), (F.get("_s", 1) - F.get("_s", 0)).alias("step_m"))
    return s.withColumn("_p", point_at(F.col("line"), F.col("_at"))).select("seg_id", "step", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"), "step_m")


def cumulative_station(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """``df`` (x, y) with station: the running length along each line."""
    w = Window.partitionBy(*by).orderBy(order)
    far = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return df.withColumn("_d", F.coalesce(far, F.lit(0.0))).withColumn("station", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def depth_table(per: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each id: values stay blank where not assessed, counts become 0; ids that are repeated or unknown refuse."""
    strange = orphans(assert_key(per, "seg_id"), "seg_id", assert_key(ids.select("seg_id"), "seg_id"), "seg_id").limit(3).collect()
    if strange:
        raise Refused(f"segments that are not in the table: {[r['seg_id'] for r in strange]}")
    counts = [c for c in per.columns if c.startswith("n_")]
    return ids.select("seg_id").join(per, "seg_id", "left").fillna(0, counts).fillna(False, ["assessed"])


def sample_nearest(cells: DataFrame, points: DataFrame, size: float) -> DataFrame:
    """Points (pt, x, y) with the value of the cell (row, col, z) that holds them."""
    p = points.select("pt", F.floor(F.col("x") / size).alias("col"), F.floor(F.col("y") / size).alias("row"))
    return p.join(cells.select("row", "col", "z"), ["row", "col"], "left").select("pt", "z")


def sample_bilinear(cells: DataFrame, points: DataFrame, size: float) -> DataFrame:
    """Weights of the four cells around; null if one of them is missing or blank."""
    gx, gy = F.col("x") / size - 0.5, F.col("y") / size - 0.5
    fx, fy = gx - F.floor(gx), gy - F.floor(gy)
    corner = F.explode(F.array(*[F.struct((F.floor(gx) + i).alias("col"), (F.floor(gy) + j).alias("row"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w")) for i in (0, 1) for j in (0, 1)]))
    four = points.select("pt", corner.alias("c")).select("pt", "c.*").join(cells.where("z is not null").select("row", "col", "z"), ["row", "col"], "left")
    return four.groupBy("pt").agg(F.when(F.count("z") == 4, F.sum(F.col("w") * F.col("z"))).alias("z"))


def _spread(cells: DataFrame, along: str, reach: int, block: int) -> DataFrame:
    """Cells with _b, a block of places along a row or column, each put also into the blocks that its window reaches into."""
    blocks = F.array_distinct(F.array(*[F.floor((F.col(along) + k) / block) for k in (-reach, 0, reach)]))
    return cells.withColumn("_own", F.floor(F.col(along) / block)).withColumn("_b", F.explode(blocks))


def terrain_window(cells: DataFrame, points: DataFrame, size: float, reach: int = 17, block: int = 1024) -> DataFrame:
    """Centre elevation, slope from the four neighbours, relief and height over the lowest cell in a square window.

    Blank where a cell of the window is missing. Lowest, highest and number are taken along the rows and then, of those,
    along the columns, in blocks with a margin: the work is a few passes over the cells, whatever ``reach``.
    """
    df = cells.where("z is not null").select("row", "col", "z", F.col("z").alias("_lo"), F.col("z").alias("_hi"), F.lit(1).cast("long").alias("_n"))
    slope = {}
    for across, along in (("row", "col"), ("col", "row")):
        w = Window.partitionBy(across, "_b").orderBy(along)
        span = w.rangeBetween(-reach, reach)
        slope[along] = (F.max("z").over(w.rangeBetween(1, 1)) - F.max("z").over(w.rangeBetween(-1, -1))) / (2 * size)
        df = _spread(df, along, max(reach, 1), block)
        df = df.withColumns({f"_s{along}": slope[along], "_lo": F.min("_lo").over(span), "_hi": F.max("_hi").over(span), "_n": F.sum("_n").over(span)})
        df = df.where("_b = _own").drop("_b", "_own")
    whole = F.col("_n") == (2 * reach + 1) ** 2
    values = {"elev": F.col("z"), "slope": F.hypot("_scol", "_srow"), "relief": F.col("_hi") - F.col("_lo"), "above_low": F.col("z") - F.col("_lo")}
    seen = df.where(whole).select("row", "col", *[v.alias(k) for k, v in values.items()])
    p = points.select("pt", F.floor(F.col("x") / size).alias("col"), F.floor(F.col("y") / size).alias("row"))
    return p.join(seen, ["row", "col"], "left").select("pt", *values)


def tile_report(tiles: DataFrame, listed: DataFrame, step: float, px: float, margin: int = 1) -> DataFrame:
    """rule and broken for ground tiles (name, tx, ty, sha256, west, north, cols, rows, px) against the list (name, sha256).

    A tile must be listed, of the listed content, of the right resolution, and reach ``margin`` cells past its bounds.
    """
    both = tiles.join(listed.select("name", F.col("sha256").alias("_listed")), "name", "left")
    pad, east, south = margin * px - 1e-9, F.col("west") + F.col("cols") * F.col("px"), F.col("north") - F.col("rows") * F.col("px")
    covers = (F.col("west") <= F.col("tx") * step - pad) & (east >= (F.col("tx") + 1) * step + pad) & (south <= F.col("ty") * step - pad) & (F.col("north") >= (F.col("ty") + 1) * step + pad)
    rules = {"listed": F.col("_listed").isNotNull(), "content": F.col("sha256") == F.col("_listed"), "resolution": F.abs(F.col("px") - px) <= px * 1e-3, "coverage": covers}
    return domain_report(both, rules)
