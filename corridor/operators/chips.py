"""Image chips: which tile covers a point, statistics of a chip, its eight symmetries, and reproducible variations.

A chip is a binary of four bands of H rows of H pixels, a byte each, bands first (red, green, blue, near infrared).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.common import Refused

# Bands, pixels of shift, multipliers that keep a chip readable, share of blank pixels that is still usable.
BANDS, RED, NIR, VIEWS = 4, 0, 3, 8
MOST_SHIFT, GAINS, CONTRASTS, MOST_BLANK = 4, (0.8, 1.15), (0.8, 1.25), 0.05


@dataclass(frozen=True)
class Preset:
    """What may be drawn: views, and how far gain, contrast and shift may go to either side."""

    views: tuple[int, ...]
    gain: float = 0.0
    contrast: float = 0.0
    shift: int = 0

    def __post_init__(self):
        spans = ((self.gain, GAINS), (self.contrast, CONTRASTS))
        if any(1 - v < lo - 1e-9 or 1 + v > hi + 1e-9 for v, (lo, hi) in spans) or not 0 <= self.shift <= MOST_SHIFT or not set(self.views) <= set(range(VIEWS)):
            raise Refused("a preset that goes beyond what a chip stands")


# Presets by name, with their views and the most that gain and contrast may change.
PRESETS = {"none": Preset((0,)), "flips": Preset((0, 2, 4, 6)), "full": Preset(tuple(range(VIEWS)), 0.10, 0.10, MOST_SHIFT)}


def pixels(chips: pd.Series) -> np.ndarray:
    """Chips of one size as an array (n, 4, H, H)."""
    flat = np.frombuffer(b"".join(chips), np.uint8).reshape(len(chips), -1) if len(chips) else np.empty((0, BANDS), np.uint8)
    side = int(round((flat.shape[1] / BANDS) ** 0.5))
    if side * side * BANDS != flat.shape[1] or chips.map(len).nunique() > 1:
        raise Refused("chips must be four square bands of one size")
    return flat.reshape(len(flat), BANDS, side, side)


def turned(x: np.ndarray, view: int) -> np.ndarray:
    """View k of arrays that end in rows and columns: k % 4 quarter turns, after a mirroring where k is 4 or more."""
    return np.rot90(x[..., ::-1] if view >= 4 else x, view % 4, axes=(-2, -1))


def turned_back(x: np.ndarray, view: int) -> np.ndarray:
    back = np.rot90(x, -(view % 4), axes=(-2, -1))
    return back[..., ::-1] if view >= 4 else back


def chip_stats(chips: DataFrame, key: str, chip: str = "chip") -> DataFrame:
    """key, NDVI mean and deviation, share of NDVI under 0.1, variance of brightness, blank share, and whether usable.

    NDVI is 0 where both bands are 0; a pixel is blank where all bands are 0. Null chips are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = pixels(b[chip]).astype(float)
            red, nir = x[:, RED], x[:, NIR]
            total = red + nir
            v = np.divide(nir - red, total, out=np.zeros_like(total), where=total > 0)
            blank = (x == 0).all(1).mean((1, 2))
            light = x[:, :3].mean(1).var((1, 2))
            yield pd.DataFrame({key: b[key], "ndvi_mean": v.mean((1, 2)), "ndvi_std": v.std((1, 2)), "impervious": (v < 0.1).mean((1, 2)), "bright_var": light, "blank": blank, "usable": blank <= MOST_BLANK})

    kind = chips.schema[key].dataType.simpleString()
    rows = chips.where(F.col(chip).isNotNull()).select(key, chip)
    return rows.mapInPandas(run, f"{key} {kind}, ndvi_mean double, ndvi_std double, impervious double, bright_var double, blank double, usable boolean")


def expand_views(chips: DataFrame, key: str, chip: str = "chip") -> DataFrame:
    """A row for each chip and view: key, view, chip."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = pixels(b[chip])
            for k in range(VIEWS):
                yield pd.DataFrame({key: b[key], "view": np.int32(k), "chip": [c.tobytes() for c in turned(x, k)]})

    kind = chips.schema[key].dataType.simpleString()
    return chips.where(F.col(chip).isNotNull()).select(key, chip).mapInPandas(run, f"{key} {kind}, view int, chip binary")


def varied(x: np.ndarray, view: int, dx: int, dy: int, gain: float, contrast: float) -> np.ndarray:
    """One chip turned, moved (the uncovered strip repeats the edge), brightened, and stretched around its mean."""
    side, bytes_of = x.shape[-1], lambda v: np.clip(np.rint(v), 0, 255).astype(np.uint8)
    at = np.arange(side)
    out = turned(x, view)[:, np.clip(at - dy, 0, side - 1)[:, None], np.clip(at - dx, 0, side - 1)]
    if gain != 1:
        out = bytes_of(out * np.float32(gain))
    if contrast != 1:
        grey = np.float32(out.mean())
        out = bytes_of((out - grey) * np.float32(contrast) + grey)
    return out


def augment(chips: DataFrame, key: str, seed: int, epoch: int, preset: Preset, chip: str = "chip") -> DataFrame:
    """key, the drawn view, dx, dy, gain, contrast, how many of them change anything, and the chip so changed.

    Draws hash seed, epoch and key, so they are the same wherever and whenever a row is worked on.
    """

    def draw(name: str):
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), F.lit(name), F.col(key)), F.lit(1 << 30)) / float(1 << 30)

    def step(name: str):
        return (F.floor(draw(name) * (2 * preset.shift + 1)) - preset.shift).cast("int")

    def around_one(name: str, width: float):
        return F.lit(1.0) + (draw(name) * 2 - 1) * width

    views = F.array(*[F.lit(v) for v in preset.views])
    drawn = chips.where(F.col(chip).isNotNull()).select(
        key, F.get(views, F.floor(draw("view") * len(preset.views)).cast("int")).alias("view"), step("dx").alias("dx"), step("dy").alias("dy"),
        around_one("gain", preset.gain).alias("gain"), around_one("contrast", preset.contrast).alias("contrast"), F.col(chip).alias("chip"),
    )
    changes = [F.col("view") != 0, (F.col("dx") != 0) | (F.col("dy") != 0), F.col("gain") != 1, F.col("contrast") != 1]
    drawn = drawn.withColumn("n_ops", sum((c.cast("int") for c in changes), F.lit(0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            what = zip(pixels(b.chip), b["view"], b.dx, b.dy, b.gain, b.contrast, strict=True)
            yield b.assign(chip=[varied(x, *w).tobytes() for x, *w in what])

    return drawn.mapInPandas(run, drawn.schema)


#: Parts of a cell's side into which tiles are cut.
FINE = 16


def chip_plan(points: DataFrame, tiles: DataFrame, key: str, cell: float = 5000.0) -> DataFrame:
    """Points (key, x, y) with the first of the tiles (tile, x0, y0, x1, y1) that hold them; null where none does.

    Tiles are cut into small cells, FINE to a side of ``cell``. The first tile that covers a small cell whole holds every
    point in it, so a point is compared only with tiles that begin or end in its cell and come before that one.
    """
    size = cell / FINE
    at = lambda c: F.floor(F.col(c) / size)
    spread = tiles.withColumn("_i", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("_j", F.explode(F.sequence(at("y0"), at("y1"))))
    near = size * 1e-9
    holds = lambda lo, hi, k: (F.col(lo) <= F.col(k) * size - near) & (F.col(hi) >= (F.col(k) + 1) * size + near)
    spread = spread.withColumn("_whole", holds("x0", "x1", "_i") & holds("y0", "y1", "_j"))
    whole = spread.where("_whole").groupBy("_i", "_j").agg(F.min("tile").alias("_first"))
    part = spread.where("not _whole").join(whole, ["_i", "_j"], "left").where(F.col("_first").isNull() | (F.col("tile") < F.col("_first"))).drop("_first", "_whole")
    placed = points.withColumns({"_i": at("x"), "_j": at("y")})
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    found = placed.join(part, ["_i", "_j"]).where(inside).select(key, "tile").unionAll(placed.join(whole, ["_i", "_j"]).select(key, "_first"))
    return points.join(found.groupBy(key).agg(F.min("tile").alias("tile")), key, "left")


def chip_census(plan: DataFrame) -> DataFrame:
    """One row: points, those with a tile, those without."""
    return plan.agg(F.count("*").alias("total"), F.count("tile").alias("with_tile"), (F.count("*") - F.count("tile")).alias("without_tile"))
