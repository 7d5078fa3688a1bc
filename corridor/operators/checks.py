"""Reports that hold scores against what was seen: parts by rank, lifts with ranges, shares of damage, grades, table sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType

from corridor.common import Refused, checkpointed
from corridor.operators.gates import assert_key, compare_tables, domain_report, key_report, orphans
from corridor.operators.ranking import drawn, ntile_by_rank

# Answers a grader may give, those that decide, and fewest rows and draws.
VIEWS = ("clear", "far", "unusable")
DAMAGE = ("none", "cracks_or_patches", "pothole", "cant_tell")
DECIDED = ("none", "cracks_or_patches", "pothole")
LEAST_IN_BAND, LEAST_CAMERAS, LEAST_DRAWS = 50, 30, 500


def _lift(worst: tuple[Column, Column], best: tuple[Column, Column]) -> Column:
    rate = [events / F.nullif(exposure.cast("double"), F.lit(0.0)) for events, exposure in (worst, best)]
    return rate[0] / F.nullif(rate[1], F.lit(0.0))


def _sums(fifth: str, events: str, exposure: str) -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col(fifth) == f, F.col(c))), F.lit(0)) for f in (5, 1) for c in (events, exposure)]


def report_check(scored: DataFrame, by: list[str], band: str, score: str, events: str, exposure: str, tie: str) -> DataFrame:
    """A row for each ``by``: rows, events, exposure, and events per exposure in the worst fifth over the best one.

    raw_lift cuts fifths over all rows of ``by``, adjusted_lift within each band; a higher score is worse.
    Bands of fewer than LEAST_IN_BAND rows are left out of the cut and counted in n_left_out.
    """
    raw = ntile_by_rank(scored, score, 5, by, tie, LEAST_IN_BAND, "raw_fifth")
    both = ntile_by_rank(raw, score, 5, [*by, band], tie, LEAST_IN_BAND, "fifth")
    r, a = (_sums(c, events, exposure) for c in ("raw_fifth", "fifth"))
    return both.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(events).alias("events"), F.sum(exposure).alias("exposure"), F.count_if(F.col("fifth") == 0).alias("n_left_out"),
        _lift((r[0], r[1]), (r[2], r[3])).alias("raw_lift"), _lift((a[0], a[1]), (a[2], a[3])).alias("adjusted_lift"),
    )


def lift_range(parts: DataFrame, by: list[str], fifth: str, events: str, exposure: str, block: str, draws: int, seed: int = 42) -> DataFrame:
    """The 2.5 and 97.5 percentiles of the lift over draws of whole blocks with replacement, a row for each ``by``.

    Blocks are summed once and are few; fifths stay as cut on all rows. Null where fewer than LEAST_DRAWS draws have one.
    """
    names = ["_wc", "_wm", "_bc", "_bm"]
    totals = checkpointed(parts.groupBy(*by, block).agg(*[s.alias(n) for s, n in zip(_sums(fifth, events, exposure), names, strict=True)]))
    numbered = totals.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(block)) - 1)
    slots = totals.groupBy(*by).agg(F.count("*").alias("_n")).withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    slots = slots.withColumn("_slot", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))))
    taken = slots.groupBy(*by, "_d", drawn(F.col("_n"), seed, *[F.col(c) for c in by], F.col("_d"), F.col("_slot")).cast("int").alias("_k")).agg(F.count("*").alias("_t"))
    w = [F.sum(F.col(n) * F.col("_t")) for n in names]
    each = taken.join(numbered, [*by, "_k"]).groupBy(*by, "_d").agg(_lift((w[0], w[1]), (w[2], w[3])).alias("m"))
    out = each.groupBy(*by).agg(F.count("m").alias("draws"), F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    return out.select(*by, "draws", *[F.when(F.col("draws") >= LEAST_DRAWS, F.get("_q", i)).alias(n) for i, n in enumerate(("low", "high"))])


def damage_shares(graded: DataFrame, by: str, roads: str, score: str, damaged: str, tie: str) -> DataFrame:
    """For each score (``by``) and road group, and all roads: the share damaged in the worst and best third by rank.

    Fewer than LEAST_CAMERAS rows: too_few, with null shares.
    """
    every = graded.withColumn(roads, F.explode(F.array(F.col(roads), F.lit("all"))))
    thirds = ntile_by_rank(every, score, 3, [by, roads], tie, LEAST_CAMERAS, "_third")
    hit = F.col(damaged).cast("double")
    share = {"share_damaged": F.avg(hit), "worst_third": F.avg(F.when(F.col("_third") == 3, hit)), "best_third": F.avg(F.when(F.col("_third") == 1, hit))}
    n = F.count("*")
    out = thirds.groupBy(by, roads).agg(n.alias("n"), (n < LEAST_CAMERAS).alias("too_few"), *[F.when(n >= LEAST_CAMERAS, v).alias(k) for k, v in share.items()])
    return out.withColumn("ratio", F.col("worst_third") / F.nullif("best_third", F.lit(0.0)))


def joined_sheet(sheet: DataFrame, places: DataFrame, on: str) -> DataFrame:
    """A sheet of answers beside the stills that its numbers stand for. Numbers must be unique and stand for a still."""
    strange = orphans(assert_key(sheet, on), on, places, on).count()
    if strange:
        raise Refused(f"{strange} answers carry a number ({on}) that stands for no still")
    return places.join(sheet, on)


def grades_from_sheets(places: DataFrame, views: DataFrame, damages: DataFrame, again: DataFrame | None = None, again_places: DataFrame | None = None) -> DataFrame:
    """Grades (camera_id, file, pass, view, damage) from sheets that know a still by a number only.

    ``views`` is over all stills and ``damages`` over those with a clear view; a clear still that has no damage answer
    was not graded and is left out. ``again`` holds second answers, whose numbers (repeat_index) ``again_places`` explains.
    """
    columns = ("camera_id", "file", "pass", "view", "damage")
    seen = joined_sheet(views, places, "index").join(joined_sheet(damages, places, "index").select("index", "damage"), "index", "left")
    clear = F.col("view") == "clear"
    once = seen.where(~(clear & F.col("damage").isNull())).select("camera_id", "file", F.lit(1).alias("pass"), "view", F.when(clear, F.col("damage")).otherwise(F.lit("")).alias("damage"))
    if again is None or again_places is None:
        return once
    twice = joined_sheet(again, again_places, "repeat_index").withColumns({"pass": F.lit(2), "view": F.lit("clear")})
    return once.unionByName(twice.select(*columns))


def grade_report(grades: DataFrame, cameras: DataFrame) -> DataFrame:
    """rule and broken: answers out of the lists, damage without a clear view, passes other than two, unknown cameras, and
    stills with more than one grade in a pass."""
    clear = F.coalesce(F.col("view") == "clear", F.lit(False))
    damage = F.coalesce("damage", F.lit(""))
    rules = {
        "view": F.coalesce(F.col("view").isin(*VIEWS), F.lit(False)),
        "damage": F.when(clear, damage.isin(*DAMAGE)).otherwise(damage == ""),
        "pass": F.coalesce(F.col("pass").isin(1, 2), F.lit(False)),
    }
    strange = orphans(grades, "camera_id", cameras, "camera_id").agg(F.lit("camera").alias("rule"), F.count("*").alias("broken"))
    repeated = key_report(grades, "camera_id", "file", "pass").select(F.lit("repeated").alias("rule"), F.col("n_repeated").alias("broken"))
    return domain_report(grades, rules).unionByName(strange).unionByName(repeated)


def checked_grades(grades: DataFrame, cameras: DataFrame) -> DataFrame:
    """``grades``, refused where ``grade_report`` finds anything."""
    bad = grade_report(grades, cameras).where("broken > 0").collect()
    if bad:
        raise Refused("grades: " + ", ".join(f"{r['broken']} break {r['rule']}" for r in bad))
    return grades


def decided(grades: DataFrame) -> DataFrame:
    """camera_id, file and damage: of each camera the first file, by name, whose first grade says something of the road."""
    g = grades.where((F.col("pass") == 1) & (F.col("view") == "clear") & F.col("damage").isin(*DECIDED))
    return g.groupBy("camera_id").agg(F.min(F.struct("file", "damage")).alias("m")).select("camera_id", "m.*")


def verify(loaded: DataFrame, files: DataFrame, key: str, values: list[str], rules: dict[str, Column], blanks: list[str]) -> DataFrame:
    """what and broken of a load held against its files: rows, values by key (missing and extra keys too), rules that the
    loaded rows must keep, and blanks that are no longer blank, or the other way round, on common keys."""
    rows = loaded.agg(F.count("*").alias("a")).crossJoin(files.agg(F.count("*").alias("b")))  # one row each
    parts = [rows.select(F.lit("rows").alias("what"), F.abs(F.col("a") - F.col("b")).alias("broken"))]
    found = compare_tables(files.select(key, *values), loaded.select(key, *values), key)
    parts.append(found.select(F.concat(F.lit("value: "), "what").alias("what"), F.col("n").alias("broken")))
    parts.append(domain_report(loaded, rules).select(F.concat(F.lit("rule: "), "rule").alias("what"), "broken"))
    flags = lambda df: df.select(key, *[F.col(c).isNull().alias(c) for c in blanks])
    blank = compare_tables(flags(files), flags(loaded), key).where(~F.col("what").isin("missing", "extra"))
    parts.append(blank.select(F.concat(F.lit("blank: "), "what").alias("what"), F.col("n").alias("broken")))
    return reduce(DataFrame.unionAll, parts)


def own_rows(df: DataFrame) -> DataFrame:
    """``df`` without replayed rows."""
    return df.where("replay_of is null") if "replay_of" in df.columns else df


def verify_times(loaded: DataFrame, files: DataFrame, time: str = "time") -> DataFrame:
    """what and broken: 1 where the first or last time of the load, replays apart, is not that of its files."""
    ends = lambda df, to: own_rows(df).agg(F.min(time).alias(f"{to}1"), F.max(time).alias(f"{to}2"))
    both = ends(loaded, "a").crossJoin(ends(files, "b"))  # one row each
    flags = [F.struct(F.lit(n).alias("what"), (~F.col(f"a{k}").eqNullSafe(F.col(f"b{k}"))).cast("long").alias("broken")) for k, n in ((1, "first time"), (2, "last time"))]
    return both.select(F.inline(F.array(*flags)))


def verify_summary(stored: DataFrame, anew: DataFrame, keys: list[str], n_rows: DataFrame | None = None, count: str = "n", tolerance: float = 1e-9) -> DataFrame:
    """what and broken of a stored summary held against one made anew from the files.

    Keys that either side lacks or that are repeated, values that differ on common keys (nulls are equal, as keys too;
    fractions may differ by ``tolerance`` of their size, as sums go by any order), and, where ``n_rows`` is given, by how
    much the stored counts miss its number of rows: a summary tells of every row once.
    """
    values = [c for c in anew.columns if c not in keys]
    a = stored.groupBy(*keys).agg(*[F.first(c).alias(c) for c in values], (F.count("*") - 1).alias("_more"))
    b = anew.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.struct(*values).alias("_anew"))
    on = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    both = a.join(b, on, "full")
    has, due = F.col("_more").isNotNull(), F.col("_anew").isNotNull()

    def differs(c: str) -> Column:
        x, y = F.col(c), F.col(f"_anew.{c}")
        if isinstance(anew.schema[c].dataType, FractionalType):
            close = F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
            return ~F.coalesce(close, F.lit(False)) & ~x.eqNullSafe(y)
        return ~x.eqNullSafe(y)

    found = both.agg(
        F.count_if(~has).alias("missing"), F.count_if(~due).alias("extra"), F.coalesce(F.sum("_more"), F.lit(0)).alias("repeated"),
        *[F.count_if(has & due & differs(c)).alias(f"value: {c}") for c in values],
    )
    out = found.unpivot([], found.columns, "what", "broken")
    if n_rows is None:
        return out
    told = stored.agg(F.coalesce(F.sum(count), F.lit(0)).alias("t")).crossJoin(own_rows(n_rows).agg(F.count("*").alias("r")))  # one row each
    return out.unionAll(told.select(F.lit("rows told of"), F.abs(F.col("t") - F.col("r")).cast("long")))


def health(tables: dict[str, DataFrame], manifest: DataFrame) -> DataFrame:
    """Per table its rows, replayed rows and newest time (null for tables without one), and whether its last load is complete.

    ``manifest`` (name, status, at) is what versioned writes note. One pass over each table.
    """
    last = manifest.groupBy("name").agg(F.max_by("status", "at").alias("status"))
    parts = []
    for name, df in tables.items():
        replays = F.count_if(F.col("replay_of").isNotNull()) if "replay_of" in df.columns else F.lit(None).cast("long")
        newest = F.max("time") if "time" in df.columns else F.lit(None).cast("timestamp")
        parts.append(df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), replays.alias("n_replayed"), newest.alias("newest")))
    found = reduce(DataFrame.unionAll, parts).join(last, "name", "left")
    return found.select("name", "n_rows", "n_replayed", "newest", F.coalesce(F.col("status") == "complete", F.lit(False)).alias("complete"))


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, files and bytes of tables that are read from files."""
    parts = []
    for name, df in tables.items():
        files = df.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n"), F.max("_metadata.file_size").alias("b"))
        parts.append(files.agg(F.lit(name).alias("table"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_files"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_bytes")))
    return reduce(DataFrame.unionAll, parts)
