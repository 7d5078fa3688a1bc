"""Planar and geographic geometry over arrays of vertices: ``array<struct<x,y>>`` in one coordinate system."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80 ellipsoid; parallels, origin and easting of the state's conformal conic projection.
A, FLAT = 6378137.0, 1 / 298.257222101
LAT1, LAT2, LAT0, LON0, EASTING = map(math.radians, (34 + 20 / 60, 36 + 10 / 60, 33.75, -79.0, 0.0))
FALSE_EASTING = 609601.22
E2 = FLAT * (2 - FLAT)
ECC = math.sqrt(E2)
VERTICES = "array<struct<x:double,y:double>>"


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - E2 * math.sin(lat) ** 2)


def _t(lat: float) -> float:
    s = ECC * math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (ECC / 2)


N = (math.log(_m(LAT1)) - math.log(_m(LAT2))) / (math.log(_t(LAT1)) - math.log(_t(LAT2)))
SCALE = A * _m(LAT1) / (N * _t(LAT1) ** N)
RHO0 = SCALE * _t(LAT0) ** N


def to_state_plane(lon: Column, lat: Column) -> Column:
    """Degrees to metres: struct of x and y."""
    phi, s = F.radians(lat), ECC * F.sin(F.radians(lat))
    t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(ECC / 2))
    rho, theta = SCALE * F.pow(t, F.lit(N)), N * (F.radians(lon) - LON0)
    return F.struct((FALSE_EASTING + rho * F.sin(theta)).alias("x"), (RHO0 - rho * F.cos(theta)).alias("y"))


def from_state_plane(x: Column, y: Column) -> Column:
    """Metres to degrees: struct of lon and lat; five rounds reach far under a millimetre."""
    dx, dy = x - FALSE_EASTING, RHO0 - y
    t = F.pow(F.sqrt(dx * dx + dy * dy) / SCALE, F.lit(1 / N))
    lat = math.pi / 2 - 2 * F.atan(t)
    for _ in range(5):
        s = ECC * F.sin(lat)
        lat = math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(ECC / 2)))
    return F.struct(F.degrees(F.atan2(dx, dy) / N + LON0).alias("lon"), F.degrees(lat).alias("lat"))


def line_of(*points: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def once(value: Column, f) -> Column:
    """f(value) with the value worked out once, however often f names it and in whatever inner function."""
    return F.get(F.transform(F.array(value), f), 0)


def _pieces(line: Column, f) -> Column:
    """f(a, b) over the neighbouring vertices."""
    n = F.size(line)
    return F.zip_with(F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(0))), f)


def length(line: Column) -> Column:
    return F.aggregate(_pieces(line, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])), F.lit(0.0), lambda s, d: s + d)


def miles(line: Column) -> Column:
    return length(line) / 1609.344


def bounds(line: Column) -> Column:
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def _nearest(px: Column, py: Column, a: Column, b: Column) -> tuple[Column, Column]:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.coalesce(((px - a["x"]) * dx + (py - a["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(px - a["x"] - t * dx, py - a["y"] - t * dy), t


def distance(px: Column, py: Column, line: Column) -> Column:
    """From a point to the nearest spot of a line."""
    return F.array_min(_pieces(line, lambda a, b: _nearest(px, py, a, b)[0]))


def piece_distance(a: Column, b: Column, p: Column, q: Column) -> Column:
    """Between two straight pieces: 0 where they cross, else the least of their ends' distances to the other piece."""

    def side(u: Column, v: Column, w: Column) -> Column:
        return (v["x"] - u["x"]) * (w["y"] - u["y"]) - (v["y"] - u["y"]) * (w["x"] - u["x"])

    cross = (side(a, b, p) * side(a, b, q) < 0) & (side(p, q, a) * side(p, q, b) < 0)
    ends = [_nearest(s["x"], s["y"], u, v)[0] for s, u, v in ((a, p, q), (b, p, q), (p, a, b), (q, a, b))]
    return F.when(cross, 0.0).otherwise(F.least(*ends))


def midpoint(line: Column) -> Column:
    """The spot half-way along a line, as a struct."""
    return point_at(line, length(line) / 2)


def point_at(line: Column, station: Column) -> Column:
    n = F.size(line)
    start = F.struct(station.alias("left"), F.lit(None).cast("struct<x:double,y:double>").alias("at"))

    def step(s: Column, k: Column) -> Column:
        a, b = F.get(line, k), F.get(line, k + 1)

        def on(d: Column) -> Column:
            t = F.coalesce(F.least(s["left"] / F.nullif(d, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
            here = F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y"))
            return F.struct((s["left"] - d).alias("left"), F.when(s["at"].isNull() & ((s["left"] <= d) | (k == n - 2)), here).otherwise(s["at"]).alias("at"))

        return once(F.hypot(b["x"] - a["x"], b["y"] - a["y"]), on)

    return F.aggregate(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), start, step)["at"]


def sample_stations(line: Column, spacing: float) -> Column:
    """Even stations at most ``spacing`` apart, both ends included."""
    even = lambda s: F.transform(F.sequence(F.lit(0).cast("long"), s["k"].cast("long")), lambda i: s["long"] * i / s["k"])
    return once(length(line), lambda long: once(F.struct(long.alias("long"), F.greatest(F.ceil(long / spacing), F.lit(1)).alias("k")), even))


def snapped(line: Column, places: int = 6) -> Column:
    return F.transform(line, lambda p: F.struct(F.round(p["x"], places).alias("x"), F.round(p["y"], places).alias("y")))


def encode_path(line: Column, unit: float = 1e-5) -> Column:
    """Whole units as differences, x and y in turn, repeats dropped but two points kept."""
    whole = F.transform(line, lambda p: F.struct(F.round(p["x"] / unit).cast("long").alias("x"), F.round(p["y"] / unit).cast("long").alias("y")))
    moved = once(whole, lambda w: F.filter(w, lambda p, k: (k == 0) | (p != F.get(w, k - 1))))
    kept = once(moved, lambda m: F.when(F.size(m) >= 2, m).otherwise(F.concat(m, m)))
    zero = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    less = lambda p, q: F.array(p["x"] - q["x"], p["y"] - q["y"])
    return once(kept, lambda v: F.flatten(F.transform(v, lambda p, k: less(p, F.coalesce(F.get(v, k - 1), zero)))))


def decode_path(path: Column, unit: float = 1e-5) -> Column:
    n = (F.size(path) / 2).cast("int")
    start = F.array().cast("array<struct<x:bigint,y:bigint>>")

    def step(a: Column, k: Column) -> Column:
        last = F.coalesce(F.get(a, F.size(a) - 1), F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")))
        return F.concat(a, F.array(F.struct((last["x"] + F.get(path, 2 * k)).alias("x"), (last["y"] + F.get(path, 2 * k + 1)).alias("y"))))

    whole = F.aggregate(F.sequence(F.lit(0), n - 1), start, step)
    return F.transform(whole, lambda p: F.struct((p["x"] * unit).alias("x"), (p["y"] * unit).alias("y")))


def hits_box(line: Column, minx: float, miny: float, maxx: float, maxy: float) -> Column:
    """Whether some piece of a line enters or touches a box: the stretch of each piece inside all four sides is not empty."""

    def inside(a: Column, b: Column) -> Column:
        lo, hi, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
        for c, low, high in (("x", minx, maxx), ("y", miny, maxy)):
            d = b[c] - a[c]
            t1, t2 = (low - a[c]) / F.nullif(d, F.lit(0.0)), (high - a[c]) / F.nullif(d, F.lit(0.0))
            lo, hi = F.greatest(lo, F.least(t1, t2)), F.least(hi, F.greatest(t1, t2))
            ok = ok & ((d != 0) | a[c].between(low, high))
        return ok & (lo <= hi)

    return F.exists(_pieces(line, inside), lambda x: x)


def cell_key(x: Column, y: Column, size: float) -> Column:
    return F.struct(F.floor(x / size).alias("cx"), F.floor(y / size).alias("cy"))


def cells_for_bounds(box: Column, size: float) -> Column:
    """Every grid cell that a box touches."""
    xs = F.sequence(F.floor(box["minx"] / size), F.floor(box["maxx"] / size))
    ys = F.sequence(F.floor(box["miny"] / size), F.floor(box["maxy"] / size))
    return once(ys, lambda rows: F.flatten(F.transform(xs, lambda x: F.transform(rows, lambda y: F.struct(x.alias("cx"), y.alias("cy"))))))


def cells_by_distance(box: Column, size: float, pad: float = 0.0) -> Column:
    """The cells that a box grown by ``pad`` touches, nearest to its middle cell first, ties by cell."""
    grown = F.struct((box["minx"] - pad).alias("minx"), (box["miny"] - pad).alias("miny"), (box["maxx"] + pad).alias("maxx"), (box["maxy"] + pad).alias("maxy"))
    mid = [(F.floor(grown[f"min{a}"] / size) + F.floor(grown[f"max{a}"] / size)) / 2 for a in "xy"]
    far = lambda c: F.struct(F.hypot(c["cx"] - mid[0], c["cy"] - mid[1]).alias("d"), c["cx"].alias("cx"), c["cy"].alias("cy"))
    return F.transform(F.sort_array(F.transform(cells_for_bounds(grown, size), far)), lambda c: F.struct(c["cx"].alias("cx"), c["cy"].alias("cy")))


def longest(parts: Column) -> Column:
    """The longest part of several, the first of equal ones."""
    return F.array_max(F.transform(parts, lambda p, i: F.struct(length(p).alias("l"), (-i).alias("i"), p.alias("p"))))["p"]


def midpoint_of_parts(parts: Column) -> Column:
    """A spot on a shape of several parts: half-way along the longest, which is the line itself where there is one."""
    return once(longest(parts), midpoint)


def part_stations(parts: Column, spacing: float) -> Column:
    """Of every part with a length its place, stations at most ``spacing`` apart and their step."""
    each = F.transform(parts, lambda p, i: F.struct(i.alias("part"), length(p).alias("l"), p.alias("line")))
    return F.transform(F.filter(each, lambda x: x["l"] > 0), lambda x: F.struct(x["part"].alias("part"), x["line"].alias("line"), sample_stations(x["line"], spacing).alias("stations"), (x["l"] / F.greatest(F.ceil(x["l"] / spacing), F.lit(1))).alias("step_m")))


def tile_of(x: Column, y: Column, size: float = 0.1) -> Column:
    return F.struct(F.floor(F.round(x / size, 9)).alias("tx"), F.floor(F.round(y / size, 9)).alias("ty"))


def tile_name(tile: Column) -> Column:
    """The file name of a tile: its whole latitude and longitude steps, signed, of four digits."""
    sign = lambda c: F.concat(F.when(c < 0, "-").otherwise("+"), F.lpad(F.abs(c).cast("string"), 4, "0"))
    return F.concat(F.lit("t_"), sign(tile["ty"]), F.lit("_"), sign(tile["tx"]), F.lit(".tif"))


def _number(data: np.ndarray, at: np.ndarray, little: np.ndarray, kind: str) -> np.ndarray:
    """Numbers that start at the given bytes, each in its own byte order."""
    size = np.dtype(kind).itemsize
    raw = data[at[:, None] + np.where(little[:, None], np.arange(size), np.arange(size)[::-1])]
    return np.ascontiguousarray(raw).view("<" + kind).ravel()


def _nested(offsets: np.ndarray, values: pa.Array, null: np.ndarray | None = None) -> pa.Array:
    mask = None if null is None or not null.any() else pa.array(null)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=mask)


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... anew for each count."""
    return np.arange(counts.sum()) - np.repeat(_ends(counts)[:-1], counts)


def parts_of_wkb(shapes: pa.Array) -> pa.Array:
    """WKB points, lines, polygons and their multiples as lists of parts, rings in their order.

    All shapes of a batch go on together: a step reads the next header of each, and steps are as many as the most parts
    that one shape has. Vertices are then taken out of the buffer at once.
    """
    null = shapes.is_null().to_numpy(zero_copy_only=False)
    shapes = shapes.cast(pa.binary())
    ends = np.frombuffer(shapes.buffers()[1], np.int32)[shapes.offset : shapes.offset + len(shapes) + 1].astype(np.int64) if len(shapes) else np.zeros(1, np.int64)
    held = shapes.buffers()[2] if len(shapes) else None
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    at, stop = ends[:-1].copy(), ends[1:]
    due, rings = np.where(null, 0, 1), np.zeros(len(null), np.int64)  # shapes and rings that a row still has to read
    little = np.zeros(len(null), bool)
    found: list[tuple[np.ndarray, ...]] = []

    def take(rows: np.ndarray, n: np.ndarray) -> None:
        if (at[rows] + 16 * n > stop[rows]).any():
            raise ValueError("WKB ends within a shape")
        found.append((rows, at[rows].copy(), n, little[rows].copy()))
        at[rows] += 16 * n

    def read(rows: np.ndarray) -> np.ndarray:
        if (at[rows] + 4 > stop[rows]).any():
            raise ValueError("WKB ends within a shape")
        at[rows] += 4
        return _number(data, at[rows] - 4, little[rows], "u4").astype(np.int64)

    while (live := np.flatnonzero((due > 0) | (rings > 0))).size:
        ring = live[rings[live] > 0]
        take(ring, read(ring))
        rings[ring] -= 1
        head = np.setdiff1d(live, ring, assume_unique=True)
        if (at[head] >= stop[head]).any():
            raise ValueError("WKB ends within a shape")
        little[head] = data[at[head]] != 0
        at[head] += 1
        kind = read(head)
        if (strange := kind[(kind < 1) | (kind > 6)]).size:
            raise ValueError(f"WKB kind {strange[0]} is not read")
        due[head] -= 1
        take(head[kind == 1], np.ones((kind == 1).sum(), np.int64))
        take(line := head[kind == 2], read(line))
        area, many = head[kind == 3], head[kind > 3]
        rings[area] = read(area)
        due[many] += read(many)

    kinds = (np.int64, np.int64, np.int64, bool)
    rows, starts, n, order = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, t in enumerate(kinds))
    by = np.lexsort((starts, rows))  # a row's parts lie one after the other
    rows, starts, n, order = rows[by], starts[by], n[by], np.repeat(order[by], n[by])
    spots = np.repeat(starts, n) + 16 * _within(n)
    x, y = (pa.array(_number(data, spots + k, order, "f8")) for k in (0, 8))
    parts = _nested(_ends(n), pa.StructArray.from_arrays([x, y], ["x", "y"]))
    return _nested(_ends(np.bincount(rows, minlength=len(null))), parts, null)


def wkb_to_parts(wkb: Column) -> Column:
    """Geometry bytes to parts of vertices; 4.1's own spatial functions are switched off."""
    return F.arrow_udf(parts_of_wkb, f"array<{VERTICES}>")(wkb)


def simplified(lines: pa.Array, tolerance: float) -> pa.Array:
    """Lines of fewer vertices, none further than ``tolerance`` from the result; ends stay.

    All stretches of all lines of a batch are looked at together: in each round every stretch keeps its vertex furthest
    from its chord (the first of several), where that is too far, and becomes two.
    """
    null = lines.is_null().to_numpy(zero_copy_only=False)
    lines = pa.ListArray.from_arrays(pa.array(_ends(np.where(null, 0, lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))), pa.int32()), lines.flatten())
    ends, spots = lines.offsets.to_numpy().astype(np.int64), lines.values
    x, y = (spots.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
    keep = np.zeros(len(x), bool)
    held = np.diff(ends) > 0
    first, last = ends[:-1][held], ends[1:][held] - 1
    keep[first] = keep[last] = True
    while (wide := last - first > 1).any():
        first, last = first[wide], last[wide]
        n = last - first - 1
        starts, k = _ends(n)[:-1], np.repeat(first + 1, n) + _within(n)
        dx, dy = x[last] - x[first], y[last] - y[first]
        px, py, ux, uy, square = x[k] - np.repeat(x[first], n), y[k] - np.repeat(y[first], n), np.repeat(dx, n), np.repeat(dy, n), np.repeat(dx * dx + dy * dy, n)
        t = np.divide(px * ux + py * uy, square, out=np.zeros(len(k)), where=square != 0).clip(0, 1)
        off = np.nan_to_num(np.hypot(px - t * ux, py - t * uy), nan=-1.0, posinf=np.inf)
        far = np.maximum.reduceat(off, starts)
        hit = np.flatnonzero(off == np.repeat(far, n))
        at = k[hit[np.searchsorted(hit, starts)]]
        split = far > tolerance
        keep[at[split]] = True
        first, last = np.concatenate([first[split], at[split]]), np.concatenate([at[split], last[split]])
    left = _ends(np.add.reduceat(np.append(keep, False).astype(np.int64), ends[:-1]) * held) if len(held) else np.zeros(1, np.int64)
    return _nested(left, spots.filter(pa.array(keep)), null)


def simplify(line: Column, tolerance: float) -> Column:
    """Fewer vertices, none further than ``tolerance`` from the result."""
    return F.arrow_udf(lambda lines: simplified(lines, tolerance), VERTICES)(line)
