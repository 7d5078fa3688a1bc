"""Checks of the flood-depth surface: marks hidden and guessed again, misses by distance, taped depths, and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridor.common import Refused, checkpointed
from corridor.operators.depth import SIDE, speaks, spot_on
from corridor.operators.mark_runs import run_places
from corridor.operators.order_stats import quantiles, same

# Metres of line hidden to each side of a mark, upper ends of the distance bands, fewest marks in a band,
# allowed median of water over ground at the marks, and the greatest median miss against the taped depths.
STRETCHES, BANDS, LEAST_IN_BAND = (0, 250, 500), (100, 250, 500, 1000), 30
WATER_OVER_GROUND, MOST_TAPE_MISS = (-1.0, 3.0), 0.25
# Metres of a cell in which marks meet pieces: wider than the search, so that a piece is copied into few.
CELL = 4 * SIDE


def _runs(marks: DataFrame, merge: float = 1.0) -> DataFrame:
    """Marks with k, the place of their run, and station; place in the stream, n, sum_ and mean_ x, y, z of the run.

    All by windows along a stream: marks are dealt by stream once and nothing is joined.
    """
    flat = run_places(marks.select("stream", "mark", "order_key", *[F.col(c).cast("double").alias(c) for c in "xyz"]), merge)
    run, w = Window.partitionBy("stream", "k"), Window.partitionBy("stream").orderBy("k", "order_key", "mark")
    flat = flat.withColumns({f"{n}_{c}": f(c).over(run) for c in "xyz" for n, f in (("sum", F.sum), ("mean", F.avg))} | {"n": F.count("*").over(run)})
    gap = F.hypot(*[F.col(f"mean_{c}") - F.lag(f"mean_{c}").over(w) for c in "xy"])  # 0 within a run
    flat = flat.withColumns({"_gap": F.coalesce(gap, F.lit(0.0)), "place": F.row_number().over(w)})
    return flat.withColumn("station", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")


def runs_of_marks(marks: DataFrame, merge: float = 1.0) -> DataFrame:
    """Marks (stream, mark, order_key, x, y, z) with the place k of their run and its station along the whole line."""
    return _runs(marks, merge).select("stream", "k", "mark", "order_key", "x", "y", "z", "station")


def _neighbours(runs: DataFrame) -> DataFrame:
    """``_runs`` with last, the line's last k; opens, at a run's first mark, and there the run after it (k, x, y, z); and for
    each stretch but 0 the runs a to b that it hides around a mark and the runs p and q before and after these.

    Stretches are taken from run to run; other marks of a run copy its first one's.
    """
    w = Window.partitionBy("stream").orderBy("place")
    back = Window.partitionBy("stream").orderBy(F.desc("place"))
    here = F.struct("k", *[F.col(f"mean_{c}").alias(c) for c in "xyz"])
    df = runs.withColumns({"opens": F.coalesce(F.lag("k").over(w) != F.col("k"), F.lit(True)), "last": F.max("k").over(Window.partitionBy("stream"))})
    df = df.withColumns({"p0": F.lag(here).over(w), "q0": F.last(F.when(F.col("opens"), here), True).over(back.rowsBetween(Window.unboundedPreceding, -1))})
    alone = F.when(F.col("opens"), -1).otherwise(F.col("place"))  # what opens no run has no window but its own
    at = Window.partitionBy("stream", alone).orderBy("station")
    ends = {}
    for s in STRETCHES[1:]:
        near = at.rangeBetween(-s, s)
        ends |= {f"_a{s}": F.min(F.struct("place", F.col("k").alias("k"), F.col("p0").alias("p"))).over(near), f"_b{s}": F.max(F.struct("place", F.col("k").alias("k"), F.col("q0").alias("q"))).over(near)}
    df = df.withColumns(ends)
    held = F.struct("p0", "q0", *[F.col(c) for c in ends])
    df = df.withColumn("_held", F.last(F.when(F.col("opens"), held), True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = {"p0": F.col("_held.p0"), "q0": F.col("_held.q0"), "a0": F.col("k"), "b0": F.col("k")}
    for s in STRETCHES[1:]:
        out |= {f"a{s}": F.col(f"_held._a{s}.k"), f"p{s}": F.col(f"_held._a{s}.p"), f"b{s}": F.col(f"_held._b{s}.k"), f"q{s}": F.col(f"_held._b{s}.q")}
    return df.withColumns(out).drop("_held", *ends)


def _closed(s: int) -> Column:
    """The nearest spot to a mark on what closes its line where a stretch hides runs: from the run before to the run after or,
    where a run keeps other marks, over their means. A line with one run left is a piece of no length."""
    k, a, b, last, n, p, q = (F.col(c) for c in ("k", f"a{s}", f"b{s}", "last", "n", f"p{s}", f"q{s}"))
    own = [((F.col(f"sum_{c}") - F.col(c)) / (n - 1)).alias(c) for c in "xyz"]
    yes, no = F.lit(True), F.lit(False)
    kept = n > 1 if s == 0 else no
    left = F.struct(k.alias("k"), *own)
    piece = lambda u, v, first, final: F.struct(u["k"].alias("k"), *[u[c].alias(f"{c}1") for c in "xyz"], *[v[c].alias(f"{c}2") for c in "xyz"], first.alias("first"), final.alias("final"))
    alone = F.when(kept, left).otherwise(F.when(p.isNull(), q).otherwise(p))
    only = F.when(kept, p.isNull() & q.isNull()).otherwise((p.isNull() & (b + 1 == last)) | (q.isNull() & (a == 1)))
    closing = F.array(
        F.when(~kept & p.isNotNull() & q.isNotNull(), piece(p, q, a == 1, b + 1 == last)),
        F.when(kept & p.isNotNull(), piece(p, left, a == 1, q.isNull())),
        F.when(kept & q.isNotNull(), piece(left, q, p.isNull(), b + 1 == last)),
        F.when(only, piece(alone, alone, yes, yes)),
    )
    return F.array_min(F.transform(F.array_compact(closing), lambda e: spot_on(F.col("x"), F.col("y"), lambda c: e[c])))


def _pieces(runs: DataFrame) -> DataFrame:
    """Pieces of the whole lines of ``_neighbours``: line, pk, ends, first and final, in every cell that holds points within SIDE."""
    ends = {f"{c}1": F.col(f"mean_{c}") for c in "xyz"} | {f"{c}2": F.coalesce(F.col(f"q0.{c}"), F.when(F.col("last") == 0, F.col(f"mean_{c}"))) for c in "xyz"}
    df = runs.where("opens").select("stream", "k", "last", *[v.alias(c) for c, v in ends.items()]).where("x2 is not null or last = 0")
    df = df.withColumn("final", F.col("k") == F.max("k").over(Window.partitionBy("stream")))
    reach = lambda c: F.sequence(F.floor((F.least(f"{c}1", f"{c}2") - SIDE) / CELL), F.floor((F.greatest(f"{c}1", f"{c}2") + SIDE) / CELL))
    df = df.select(F.col("stream").alias("line"), F.col("k").alias("pk"), *ends, (F.col("k") == 0).alias("first"), "final", F.explode(reach("x")).alias("pi"))
    return df.withColumn("pj", F.explode(reach("y")))


def hidden_mark_test(marks: DataFrame) -> DataFrame:
    """Marks (stream, mark, order_key, x, y, z, draws) guessed from the others: stream, mark, stretch, guess, along, miss.

    Stretch 0 hides one mark, the others every mark within so many metres along the line; its stream's line is closed
    over those left and answers beside the other streams' lines. Marks that draw no line have stretch -1 and are guessed
    from all lines. guess is null where no line speaks. Runs of marks under a metre apart stay those of the whole line.

    A mark knows what closes its gaps from its own stream. It goes once to the cell that holds it, meets there the pieces
    of all lines within SIDE, once for all stretches, and is answered without being dealt again.
    """
    runs = _neighbours(_runs(marks.where("draws")))
    cell = [F.floor(F.col(c) / CELL).alias(to) for c, to in (("x", "i"), ("y", "j"))]
    asked = [c for s in STRETCHES for c in (f"a{s}", f"b{s}", f"closed{s}")]
    drawn = runs.withColumns({f"closed{s}": _closed(s) for s in STRETCHES}).select("stream", "mark", F.lit(True).alias("draws"), "x", "y", "z", "last", *asked, *cell)
    poor = marks.where(~F.col("draws")).select("stream", "mark", F.lit(False).alias("draws"), *[F.col(c).cast("double").alias(c) for c in "xyz"], *cell)
    points = drawn.unionByName(poor, allowMissingColumns=True)
    beside = reduce(lambda u, v: u & v, [F.col(c).between(F.least(f"{c}1", f"{c}2") - SIDE, F.greatest(f"{c}1", f"{c}2") + SIDE) for c in "xy"])
    met = points.join(_pieces(runs), (F.col("i") == F.col("pi")) & (F.col("j") == F.col("pj")) & beside, "left")

    own = F.col("draws") & (F.col("line") == F.col("stream"))
    pk, last = F.col("pk"), F.col("last")
    spots = {}
    for s in STRETCHES:
        a, b = F.col(f"a{s}"), F.col(f"b{s}")
        stays = F.col("line").isNotNull() & (~own | (((pk + 1 < a) | (pk > b)) & (pk < last)))
        first = F.when(own, (pk == 0) | ((a == 0) & (pk == b + 1))).otherwise(F.col("first"))
        final = F.when(own, (pk + 1 == last) | ((b == last) & (pk + 1 == a - 1))).otherwise(F.col("final"))
        new = {"first": first, "final": final, "k": pk}
        spots[f"m{s}"] = F.when(stays, spot_on(F.col("x"), F.col("y"), lambda c, new=new: new.get(c, F.col(c))))
    mark = ["i", "j", "stream", "mark", "draws"]
    fixed = F.struct("z", *[f"closed{s}" for s in STRETCHES]).alias("fixed")
    met = met.select(*mark, "line", fixed, *[v.alias(c) for c, v in spots.items()])
    lines = met.groupBy(*mark, "line").agg(F.first("fixed").alias("fixed"), *[F.min(c).alias(c) for c in spots])

    def answer(m: Column, line: str) -> Column:
        said = (m["dist"] <= SIDE) & speaks(lambda c: m[c])
        return F.when(said, F.struct(m["dist"].alias("dist"), F.col(line).alias("line"), m["level"].alias("level"), F.hypot(m["along"], m["dist"]).alias("mark_dist"), m["at_end"].alias("at_end")))

    best = lines.groupBy(*mark).agg(F.first("fixed").alias("fixed"), F.min(F.when(F.coalesce(~own, F.lit(True)), answer(F.col("m0"), "line"))).alias("other"), *[F.min(F.when(own, F.col(c))).alias(c) for c in spots])
    mine = [answer(F.least(F.col(f"m{s}"), F.col(f"fixed.closed{s}")), "stream") for s in STRETCHES]
    guess = lambda s, c: F.struct(F.lit(s).alias("stretch"), c["level"].alias("guess"), c["mark_dist"].alias("along"))
    each = F.when(F.col("draws"), F.array(*[guess(s, F.least(m, F.col("other"))) for s, m in zip(STRETCHES, mine, strict=True)])).otherwise(F.array(guess(-1, F.col("other"))))
    out = best.select("stream", "mark", "fixed.z", F.explode(each).alias("e"))
    return out.select("stream", "mark", "e.*", (F.col("e.guess") - F.col("z")).alias("miss"))


def misses(df: DataFrame, miss: Column, by: list[str], more: list[Column] | None = None, bias: bool = True) -> DataFrame:
    """Of each group: n, exact median, p75 and p90 of the size of a miss, and, if asked, its median with sign.

    ``df`` is worked out once: let it have no more columns than are used.
    """
    d = checkpointed(df.withColumn("_miss", miss))
    asked = {name: (F.abs("_miss"), share) for name, share in (("median", 0.5), ("p75", 0.75), ("p90", 0.9))} | ({"bias": (F.col("_miss"), 0.5)} if bias else {})
    return same(d.groupBy(*by).agg(F.count("_miss").alias("n"), *(more or [])), quantiles(d, by, asked), by, "left")


def band_table(hidden: DataFrame) -> DataFrame:
    """By distance to the nearest mark left, in bands (lo, hi]: n, median and p90 of the miss, too_few.

    A mark counts once in a band, with the smallest stretch that puts it there. Bands without marks have n 0.
    """
    lows = (0, *BANDS[:-1])
    band = F.coalesce(*[F.when(F.col("along") <= hi, F.lit(k)) for k, hi in enumerate(BANDS)])
    guessed = hidden.where((F.col("stretch") >= 0) & F.col("guess").isNotNull()).withColumn("band", band).where("band is not null")
    once = guessed.groupBy("stream", "mark", "band").agg(F.min(F.struct("stretch", "miss")).alias("m"))
    found = misses(once.select("band", "m.miss"), F.col("miss"), ["band"], bias=False)
    every = hidden.sparkSession.createDataFrame([(k, lo, hi) for k, (lo, hi) in enumerate(zip(lows, BANDS, strict=True))], "band int, lo int, hi int")
    n = F.coalesce("n", F.lit(0))
    return every.join(found, "band", "left").select("lo", "hi", n.alias("n"), "median", "p90", (n < LEAST_IN_BAND).alias("too_few"))


def tape_tests(marks: DataFrame, hidden: DataFrame) -> DataFrame:
    """Depths against the taped ones (marks with ground and tape): one row each for the mark's own level, and for the
    level guessed with the mark hidden. corr is null under three rows or where a side is constant."""
    taped = marks.where("tape is not null and ground is not null")
    own = taped.select(F.lit("own level").alias("test"), (F.col("z") - F.col("ground")).alias("d"), "tape")
    guess = hidden.where("stretch = 0 and guess is not null").select("stream", "mark", "guess")
    end = taped.where("draws").join(guess, ["stream", "mark"]).select(F.lit("end to end").alias("test"), (F.col("guess") - F.col("ground")).alias("d"), "tape")
    corr = F.covar_pop("d", "tape") / F.nullif(F.stddev_pop("d") * F.stddev_pop("tape"), F.lit(0.0))
    out = misses(own.unionAll(end), F.col("d") - F.col("tape"), ["test"], [F.when(F.count("*") >= 3, corr).alias("corr")])
    return out.select("test", "n", "median", "p75", "p90", "bias", "corr")


def gate_report(marks: DataFrame, hidden: DataFrame, coarse: str = "ground30") -> DataFrame:
    """One row with what the gates look at: water over ground, marks guessed, median tape misses of fine and coarse ground."""
    taped = F.col("tape").isNotNull() & F.col("ground").isNotNull() & F.col(coarse).isNotNull()
    asked = {n: (F.when(taped, F.abs(F.col("z") - F.col(c) - F.col("tape"))), 0.5) for c, n in (("ground", "miss_fine"), (coarse, "miss_coarse"))}
    medians = quantiles(marks, [], {"water_over_ground": (F.when(F.col("draws"), F.col("z") - F.col("ground")), 0.5)} | asked)
    guessed = hidden.agg(F.count_if((F.col("stretch") == 0) & F.col("guess").isNotNull()).alias("n_guessed"))
    return marks.agg(F.count_if(taped).alias("n_taped")).crossJoin(medians).crossJoin(guessed)  # one row each


def gates(marks: DataFrame, hidden: DataFrame, coarse: str = "ground30") -> dict:
    """The report, if no gate refuses: units, marks enough to state an error, fine ground better than coarse and close."""
    r = gate_report(marks, hidden, coarse).first().asDict()
    over, (lo, hi) = r["water_over_ground"], WATER_OVER_GROUND
    if over is None or not lo <= over <= hi:
        raise Refused(f"water over ground at the marks has a median of {over} m: wrong units, or no ground")
    if r["n_guessed"] < LEAST_IN_BAND:
        raise Refused(f"{r['n_guessed']} marks could be guessed from others: too few to state an error")
    if not r["n_taped"] or not r["miss_fine"] < r["miss_coarse"]:
        raise Refused("fine ground is not better than coarse ground on the taped marks")
    if r["miss_fine"] > MOST_TAPE_MISS:
        raise Refused(f"fine ground misses the taped depths by {r['miss_fine']:.2f} m")
    return r
