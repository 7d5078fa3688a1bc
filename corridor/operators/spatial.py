"""Spatial joins: the smaller side is put into every grid cell within reach, the other side into one, and exact distances
decide. A cell is as wide as the search radius or wider."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.common import checkpointed
from corridor.functions import geo
from corridor.operators.near import lines_within, nearest_lines
from corridor.operators.ranking import global_rank


def _cell(x: Column, y: Column, size: float) -> list[Column]:
    return [F.floor(x / size).alias("_cx"), F.floor(y / size).alias("_cy")]


def points_within(left: DataFrame, right: DataFrame, radius: float, cell: float | None = None) -> DataFrame:
    """Pairs of ``left`` (x, y, others) and ``right`` (px, py, others) at most ``radius`` apart, with ``dist2``.

    ``right`` is repeated in nine cells: let it be the smaller side.
    """
    size = cell or radius
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = left.select("*", *_cell(F.col("x"), F.col("y"), size))
    b = right.withColumn("_n", around).select("*", (F.floor(F.col("px") / size) + F.col("_n.i")).alias("_cx"), (F.floor(F.col("py") / size) + F.col("_n.j")).alias("_cy"))
    d2 = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
    return a.join(b, ["_cx", "_cy"]).withColumn("dist2", d2).where(F.col("dist2") <= radius * radius).drop("_cx", "_cy", "_n")


def dwithin(points: DataFrame, lines: DataFrame, radius: float, pt_id: str, line_id: str = "seg_id") -> DataFrame:
    """pt_id, line_id and dist of every line (column ``line``) within ``radius`` of a point (x, y)."""
    return lines_within(points, lines, radius, pt_id, line_id)


#: Least part of the radius that a first search may take.
LEAST_STEP = 1 / 64


def _by_rounds(places: DataFrame, spots: DataFrame, radius: float, step: float, find: Callable[[DataFrame, float], DataFrame]) -> DataFrame:
    """``places`` (x, y, others, each once) with m, the least of what ``find`` gives within ``radius``; others are left out.

    The first search goes ``step`` times as far as ``spots`` (x, y) lie apart on average, the next four times as far for
    places that found nothing, up to the radius. What is found is the nearest of all, as nothing nearer was left out, and
    where tables are dense no place meets all that lies within the radius.
    """
    n, *ends = spots.agg(F.count("*"), *[f(c) for c in ("x", "y") for f in (F.min, F.max)]).first()
    if not n:
        return find(places, radius).limit(0)
    apart = (max(float(ends[1] - ends[0]), 1.0) * max(float(ends[3] - ends[2]), 1.0) / n) ** 0.5
    reach, left, found = min(max(step * apart, radius * LEAST_STEP), radius), places, []
    while True:
        got = checkpointed(find(left, reach))
        found.append(got)
        if reach >= radius:
            return reduce(DataFrame.unionAll, found)
        left = checkpointed(left.join(got, places.columns, "left_anti"))
        if left.isEmpty():
            return reduce(DataFrame.unionAll, found)
        reach = min(4 * reach, radius)


def nearest(points: DataFrame, lines: DataFrame, radius: float, pt_id: str, line_id: str = "seg_id", reach: Column | None = None) -> DataFrame:
    """Each point with its nearest line within reach, the lower id at equal distance; null where none is.

    ``reach``, where given, is a point's own limit, at most ``radius``.
    """
    limit = F.lit(float(radius)) if reach is None else reach
    out = nearest_lines(points.withColumn("_reach", limit), lines, radius, [pt_id, "_reach"], line_id)
    held = F.col("near_dist") <= F.col("_reach")
    return out.select(pt_id, F.when(held, F.col("near_id")).alias(line_id), F.when(held, F.col("near_dist")).alias("dist"))


def nearest_point(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str) -> DataFrame:
    """Each row of ``left`` (x, y) with its nearest of ``right`` (px, py) within ``radius``, the lower id at equal distance.

    Rows at one place ask once, and those of ``right`` at one place are one of the lower id.
    """
    places = checkpointed(left.select("x", "y").dropna().distinct())
    spots = checkpointed(right.select(F.col("px").alias("x"), F.col("py").alias("y"), right_id).dropna().groupBy("x", "y").agg(F.min(right_id).alias(right_id)))
    asked = lambda p: p.select(F.col("x").alias("px"), F.col("y").alias("py"))
    best = lambda near: near.groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.min(F.struct("dist2", right_id)).alias("m"))
    found = _by_rounds(places, spots, radius, 1.0, lambda p, reach: best(points_within(spots, asked(p), reach)))
    return left.join(found, ["x", "y"], "left").select(left_id, f"m.{right_id}", "m.dist2")


def match_cameras(cameras: DataFrame, lines: DataFrame, radius: float = 100.0) -> DataFrame:
    """camera_id, seg_id, dist and match_rule: on the named route first, then the nearest, then the lower id."""
    c = cameras.select("camera_id", "x", "y", F.col("named_route").alias("route"))
    m = nearest_lines(c, lines, radius, ["camera_id"], "seg_id", on="route")
    rule = F.when(F.col("own_id").isNotNull(), "named route").when(F.col("near_id").isNotNull(), "nearest").otherwise("none")
    return m.select("camera_id", F.coalesce("own_id", "near_id").alias("seg_id"), F.coalesce("own_dist", "near_dist").alias("dist"), rule.alias("match_rule"))


def override_match(found: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    """Another matcher's answer for the keys it knows, a null answer included."""
    k = known.select(key, F.col(value).alias("_v"), F.lit(True).alias("_k"))
    return found.join(k, key, "left").withColumn(value, F.when(F.col("_k"), F.col("_v")).otherwise(F.col(value))).drop("_v", "_k")


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule over a closed ring of vertices."""

    def crosses(a: Column, b: Column) -> Column:
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    n = F.size(ring)
    hits = F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda a, b: F.coalesce(crosses(a, b), F.lit(False)).cast("int"))
    return F.aggregate(hits, F.lit(0), lambda s, h: s + h) % 2 == 1


def _edges(polygons: DataFrame, name: str) -> DataFrame:
    """name, a and b: every edge of every ring, its lower end first; level edges never cross a level ray."""
    ring = F.explode("rings").alias("r")
    pieces = F.zip_with(F.slice("r", F.lit(1), F.size("r") - 1), F.slice("r", F.lit(2), F.size("r") - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    each = polygons.select(name, ring).where("size(r) > 1").select(name, F.explode(pieces).alias("e")).select(name, "e.p", "e.q")
    up = F.col("p")["y"] <= F.col("q")["y"]
    return each.select(name, F.when(up, F.col("p")).otherwise(F.col("q")).alias("a"), F.when(up, F.col("q")).otherwise(F.col("p")).alias("b"))


def _crossing(y: Column) -> Column:
    """Where an edge meets the level line at y, if it does: its lower end counts as on it, its upper end does not."""
    a, b = F.col("a"), F.col("b")
    return F.when((a["y"] <= y) & (y < b["y"]), a["x"] + (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]))


def covering(polygons: DataFrame, name: str, cell: float) -> DataFrame:
    """name, cx, cy and edge of every grid cell that a polygon (name, rings) has a part in: edge where its outline passes.

    Rings are outlines of any parts and of holes, in any order: what lies inside an odd number of them is inside. Edges
    are taken one by one through the columns that they cross, and the cells between two crossings of a row's middle are
    inside: no polygon is tested cell by cell, however large.
    """
    e = _edges(polygons, name)
    a, b, near = F.col("a"), F.col("b"), cell * 1e-9
    low, high = F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])
    column = e.withColumn("cx", F.explode(F.sequence(F.floor((low - near) / cell), F.floor((high + near) / cell))))
    slope = F.coalesce((b["y"] - a["y"]) / F.nullif(b["x"] - a["x"], F.lit(0.0)), F.lit(0.0))
    ends = [a["y"] + slope * (F.least(F.greatest(F.col("cx") * cell + k * cell, low), high) - a["x"]) for k in (0, 1)]
    upright = a["x"] == b["x"]
    bottom, top = F.when(upright, a["y"]).otherwise(F.least(*ends)), F.when(upright, b["y"]).otherwise(F.greatest(*ends))
    rows = F.explode(F.sequence(F.floor((bottom - near) / cell), F.floor((top + near) / cell))).alias("cy")
    outline = column.select(name, "cx", rows).distinct()

    across = e.withColumn("cy", F.explode(F.sequence(F.floor(a["y"] / cell), F.floor(b["y"] / cell))))
    met = across.withColumn("x", _crossing((F.col("cy") + 0.5) * cell)).where("x is not null").groupBy(name, "cy").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda k: F.struct(F.get("xs", k * 2).alias("l"), F.get("xs", k * 2 + 1).alias("r")))
    spans = met.where("size(xs) >= 2").select(name, "cy", F.explode(pairs).alias("s"))
    first, last = F.ceil(F.col("s.l") / cell - 0.5), F.floor(F.col("s.r") / cell - 0.5)
    inner = spans.select(name, "cy", first.alias("f"), last.alias("t")).where("f <= t").select(name, F.explode(F.sequence("f", "t")).alias("cx"), "cy")
    inner = inner.join(outline, [name, "cx", "cy"], "left_anti").distinct()
    return outline.withColumn("edge", F.lit(True)).unionByName(inner.withColumn("edge", F.lit(False)))


def point_in_polygon(points: DataFrame, polygons: DataFrame, pt_id: str, name: str, cell: float) -> DataFrame:
    """The first polygon by name that holds each point, else null.

    ``polygons``: name and rings (closed, of all parts and holes), or name and one ring. Names that repeat are parts of
    one polygon. A point of an inner cell is inside without a test. In a cell of the outline the edges that reach into the
    cell's row are met, and the crossings to the right of the point counted: odd is inside.
    """
    if "rings" not in polygons.columns:
        polygons = polygons.select(name, F.array("ring").alias("rings"))
    spot = geo.cell_key(F.col("x"), F.col("y"), cell)
    a = points.select(pt_id, "x", "y", spot["cx"].alias("cx"), spot["cy"].alias("cy"))
    met = a.join(covering(polygons, name, cell), ["cx", "cy"])
    whole = met.where("not edge").select(pt_id, name)
    e = _edges(polygons, name)
    rows = e.withColumn("cy", F.explode(F.sequence(F.floor(F.col("a")["y"] / cell), F.floor(F.col("b")["y"] / cell))))
    tried = met.where("edge").select(pt_id, "x", "y", "cy", name).join(rows, [name, "cy"])
    right = F.count_if(F.coalesce(_crossing(F.col("y")) > F.col("x"), F.lit(False)))
    exact = tried.groupBy(pt_id, name).agg(right.alias("n")).where("n % 2 = 1").select(pt_id, name)
    held = whole.unionByName(exact).groupBy(pt_id).agg(F.min(name).alias(name))
    return points.select(pt_id).join(held, pt_id, "left")


def overlapping_pairs(points: DataFrame, side: float, pt_id: str = "id") -> DataFrame:
    """Pairs of different folds whose points are closer than ``side`` on both axes."""
    b = points.select(F.col(pt_id).alias("id2"), F.col("fold").alias("fold2"), F.col("x").alias("px"), F.col("y").alias("py"))
    near = points_within(points, b, side * 2**0.5, side * 1.5)
    apart = (F.abs(F.col("x") - F.col("px")) < side) & (F.abs(F.col("y") - F.col("py")) < side)
    return near.where((F.col(pt_id) < F.col("id2")) & (F.col("fold") != F.col("fold2")) & apart).select(F.col(pt_id).alias("id1"), "id2")


def within_any(left: DataFrame, right: DataFrame, radius: float, left_id: str, name: str) -> DataFrame:
    """Every row of ``left`` with whether any point of ``right`` is within ``radius``."""
    hit = points_within(left, right, radius).select(left_id).distinct().withColumn(name, F.lit(True))
    return left.join(hit, left_id, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def box_query(df: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """Rows whose line enters or touches a box; the cheap test of the bounds comes first."""
    b = geo.bounds(F.col("line"))
    return df.where((b["minx"] <= maxx) & (b["maxx"] >= minx) & (b["miny"] <= maxy) & (b["maxy"] >= miny)).where(geo.hits_box(F.col("line"), minx, miny, maxx, maxy))


def box_page(df: DataFrame, box: tuple[float, float, float, float], limit: int, order: str = "seg_id", spread: bool = False) -> DataFrame:
    """At most ``limit`` rows whose line touches the box, in order of id or spread evenly over all that match, with matched.

    Spread takes the places floor(k * matched / limit), so that a crowded box is thinned and not cut off.
    """
    hit = global_rank(box_query(df, *box), [F.asc(order)], "_place")
    hit = hit.crossJoin(F.broadcast(hit.agg(F.count("*").alias("matched"))))  # one row
    at, n = F.col("_place") - 1, F.col("matched")
    if not spread:
        return hit.where(at < limit).drop("_place")
    k = F.ceil(at * limit / n)  # the first k whose place is at or past this row's
    return hit.where((n <= limit) | (F.floor(k * n / limit) == at) & (k < limit)).drop("_place")


def box_select(df: DataFrame, box: tuple[float, float, float, float], score: str, most: int, key: str = "seg_id") -> DataFrame:
    """The ``most`` rows of highest score whose line touches the box, blanks last, ties by id."""
    return box_query(df, *box).orderBy(F.col(score).desc_nulls_last(), key).limit(most)
