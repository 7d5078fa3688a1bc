"""Data-quality gates: each is one aggregate or an anti join, and refuses with what it found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridor.common import Refused, checkpointed
from corridor.functions.keys import block_id, epoch_ms, fold_of
from corridor.operators.ranking import global_rank

# What no model may see because it was measured in the same survey or is a label, by name and by prefix.
BANNED = frozenset(
    "pv_RTG_NBR pv_GFP_CODE pv_AVERAGE_IRI pv_IRI_YEAR pv_AVERAGE_RUT_DEPTH pv_PMS_TREATMENT_NAME pv_TREATMENT_COST pv_PMS_BUDGET_GROUP_NAME "
    "pv_PCS_SRVY_YR pv_asph_RTG_NBR pv_asph_PMS_TREATMENT_NAME pv_asph_TREATMENT_COST pv_asph_PMS_BUDGET_GROUP_NAME pv_asph_SRVY_YR "
    "pv_asph_PCS_COMMENT pv_asph_PVD_SHLDR_COND_CD pv_asph_TRNSVRS_CD pv_asph_RUT_CD pv_asph_RVL_CD pv_asph_OXDTN_CD pv_asph_BLD_CD "
    "pv_asph_PTCH_CD pv_asph_RIDE_CD pv_asph_SHLDR_RPR_PCT pv_asph_ALGTR_NONE_PCT pv_asph_ALGTR_LOW_PCT pv_asph_ALGTR_MDRT_PCT "
    "pv_asph_ALGTR_HGH_PCT in_helene_zone".split()
)
BANNED_PREFIXES = ("y_", "pred_", "n_", "im_vit_")
# Edge of a fold block in metres, folds, share of repeated reports that refuses a pull, hashes of a result.
BLOCK_M, FOLDS, MOST_REPEATED, HASHES = 5000, 5, 0.01, ("code", "table", "manifest")


def key_report(df: DataFrame, *key: str) -> DataFrame:
    """Rows, rows with a null in the key, and keys that occur more than once; grouped first, so no key meets a task whole."""
    nulls = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    by = df.groupBy(*key).count().withColumn("_null", nulls)
    total = F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows")
    missing = F.coalesce(F.sum(F.when(F.col("_null"), F.col("count"))), F.lit(0)).alias("n_null")
    return by.agg(total, missing, F.count_if(~F.col("_null") & (F.col("count") > 1)).alias("n_repeated"))


def assert_key(df: DataFrame, *key: str) -> DataFrame:
    r = key_report(df, *key).first()
    if r["n_null"] or r["n_repeated"]:
        raise Refused(f"{key}: {r['n_null']} null, {r['n_repeated']} repeated")
    return df


def same_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how many keys are missing on the right and how many are extra there."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full").agg(F.count_if(F.col("r").isNull()).alias("missing"), F.count_if(F.col("l").isNull()).alias("extra"))


def merge_one_to_one(d: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join of a table with as many rows out as in: the key is unique and whole on both sides, and no column clashes."""
    return _beside(assert_key(d, key), other, key)


def _beside(d: DataFrame, other: DataFrame, key: str) -> DataFrame:
    clash = (set(d.columns) & set(other.columns)) - {key}
    if clash:
        raise Refused(f"columns on both sides: {sorted(clash)}")
    return d.join(assert_key(other, key), key, "left").select(*d.columns, *[c for c in other.columns if c != key])


def attach_with_rename(d: DataFrame, side: DataFrame, key: str, suffix: str = "_d8") -> DataFrame:
    """Left join whose side's columns win; the old ones keep their values under a suffix."""
    clash = (set(d.columns) & set(side.columns)) - {key}
    taken = {c + suffix for c in clash} & set(d.columns)
    if taken:
        raise Refused(f"names already taken: {sorted(taken)}")
    return merge_one_to_one(d.withColumnsRenamed({c: c + suffix for c in clash}), side, key)


def side_tables(d: DataFrame, key: str, *sides: DataFrame) -> DataFrame:
    """A table with the columns of many per-key tables, each joined one to one; keys that a side lacks get nulls.

    The table's key is checked once, as one-to-one joins keep it; a side is worked out once for its check and its join.
    """
    return reduce(lambda a, b: _beside(a, checkpointed(b), key), sides, assert_key(d, key))


def prefix_columns(df: DataFrame, prefix: str, *but: str) -> DataFrame:
    """A group prefix on every column but the keys and those that have it already."""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in but and not c.startswith(prefix)})


def check_features(columns: list[str], banned: frozenset[str] = BANNED, prefixes: tuple[str, ...] = BANNED_PREFIXES) -> list[str]:
    bad = sorted(c for c in columns if c in banned or c.startswith(prefixes))
    if bad:
        raise Refused(f"columns that leak: {bad}")
    return columns


def domain_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rule and the rows that break it, in one pass; a rule that is null for a row holds."""
    counts = df.agg(*[F.count_if(~c).alias(n) for n, c in rules.items()])
    return counts.unpivot([], list(rules), "rule", "broken")


def assert_domain(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    bad = domain_report(df, rules).where("broken > 0").collect()
    if bad:
        raise Refused("; ".join(f"{r['rule']}: {r['broken']} rows" for r in bad))
    return df


def functional_dependency(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Keys with more than one combination of the columns; null is a value."""
    return df.select(key, *columns).distinct().groupBy(key).count().where("count > 1").select(key, F.col("count").alias("n_values"))


def orphans(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def fingerprint(df: DataFrame) -> DataFrame:
    """A hash of the rows that their order does not change: count, exclusive or, and sum of row hashes."""
    h = df.select(F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).alias("h"))
    return h.agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))


#: Two primes under 2^31 and a base below each, so that products stay within a long.
MODULI, BASES = (2_147_483_647, 2_147_483_629), (1_000_003, 998_244_353)
#: All the bits that a place, a positive long, has.
PLACE_BITS = 63


def ordered_fingerprint(df: DataFrame, order: list[str], bits: int = PLACE_BITS) -> DataFrame:
    """n and h: a hash of the rows in their order by ``order`` (a key), so that a changed value, place or row changes it.

    A row at place k adds its own hash times the k-th power of a base, modulo a prime, and so for two primes: sums of
    ranges add up, so no task sees all rows, and the hash is the same however they are dealt. Columns go by name.
    Of a place its lowest ``bits`` bits count: with fewer than the table needs, places so far apart hash alike.
    """
    texts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in sorted(df.columns)]
    own = F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 12), 16, 10).cast("long")
    ranked = global_rank(df.select(*order, own.alias("_own")), [F.asc(c) for c in order], "_k")

    def sum_of(p: int, base: int) -> Column:
        squares = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(pow(base, 1 << k, p)).cast("long").alias("v")) for k in range(bits)])
        bit = lambda k: F.call_function("shiftright", F.col("_k"), k).bitwiseAND(F.lit(1).cast("long")) == 1
        power = F.aggregate(squares, F.lit(1).cast("long"), lambda a, x: F.when(bit(x["k"]), a * x["v"] % p).otherwise(a))
        total = F.sum((F.col("_own") % p * power % p).cast("decimal(20,0)"))
        return F.coalesce((total % F.lit(p).cast("decimal(20,0)")).cast("long").cast("string"), F.lit("0"))

    parts = [sum_of(p, base) for p, base in zip(MODULI, BASES, strict=True)]
    return ranked.agg(F.count("*").alias("n"), F.concat_ws("-", *parts).alias("h"))


def unchanged(before: DataFrame, after: DataFrame) -> None:
    """Refuses where two fingerprints, each one row, differ in any value."""
    a, b = before.first(), after.first()
    if a != b:
        raise Refused(f"rows changed: {a.asDict()} before, {b.asDict()} after")


def not_too_good(name: str, value: float | None, most: float) -> float | None:
    if value is not None and value > most:
        raise Refused(f"{name} is {value:.3f}: over {most} something leaks")
    return value


def compare_tables(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Per column, how many common keys differ (nulls equal), and how many keys either side lacks."""
    columns = [c for c in left.columns if c != key]
    a = left.select(key, F.struct(*columns).alias("a"))
    b = right.select(key, F.struct(*columns).alias("b"))
    both = a.join(b, key, "full")
    common = F.col("a").isNotNull() & F.col("b").isNotNull()
    found = both.agg(
        F.count_if(F.col("b").isNull()).alias("missing"),
        F.count_if(F.col("a").isNull()).alias("extra"),
        *[F.count_if(common & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(c) for c in columns],
    )
    return found.unpivot([], ["missing", "extra", *columns], "what", "n")


def first_reason(**reasons: Column) -> Column:
    """The name of the first reason that holds, null where none does."""
    out = F.lit(None).cast("string")
    for name, c in reversed(list(reasons.items())):
        out = F.when(c, name).otherwise(out)
    return out


def clean_numbers(df: DataFrame, singles: tuple[str, ...] = (), places: int = 3) -> DataFrame:
    """NaN becomes null; ``singles``, once rounded to ``places`` and kept as floats, are doubles of that rounding again.

    An infinity refuses, and so does a time without a zone: Spark has such times as timestamp_ntz.
    """
    naive = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    if naive:
        raise Refused(f"times without a zone: {naive}")
    numbers = [f.name for f in df.schema if f.dataType.typeName() in ("float", "double")]
    rules = {c: ~F.abs(F.col(c)).eqNullSafe(F.lit(float("inf"))) for c in numbers}
    if rules:
        assert_domain(df, rules)
    plain = {c: F.round(F.col(c).cast("double"), places) if c in singles else F.col(c) for c in numbers}
    return df.withColumns({c: F.when(~F.isnan(c), v) for c, v in plain.items()})


def contract_report(df: DataFrame, columns: list[str], key: str = "seg_id", x: str = "mid_x", y: str = "mid_y", block: str = "split_block", fold: str = "fold") -> DataFrame:
    """rule and broken: what a table of labels and folds breaks of its contract, recomputed row by row.

    Columns that are missing refuse at once. The block must be that of the midpoint and the fold the crc32 of the block,
    exactly: a fold of 2.5, a null or a text is not.
    """
    lacking = sorted({*columns, key, x, y, block, fold} - set(df.columns))
    if lacking:
        raise Refused(f"columns missing: {lacking}")
    kind = df.schema[fold].dataType.typeName()
    whole = F.col(fold).cast("double") if kind in ("integer", "long", "short", "byte", "float", "double") else F.lit(None).cast("double")
    k = key_report(df, key).select(F.stack(F.lit(2), F.lit("key missing"), F.col("n_null"), F.lit("key repeated"), F.col("n_repeated")).alias("rule", "broken"))
    rules = {
        "midpoint missing": F.col(x).isNotNull() & F.col(y).isNotNull(),
        "block": F.col(block).eqNullSafe(block_id(F.col(x), F.col(y), BLOCK_M)) | F.col(x).isNull() | F.col(y).isNull(),
        "fold": whole.eqNullSafe(fold_of(F.col(block), FOLDS).cast("double")),
    }
    return domain_report(df, rules).unionByName(k)


def assert_contract(df: DataFrame, columns: list[str], **names: str) -> DataFrame:
    bad = contract_report(df, columns, **names).where("broken > 0").collect()
    if bad:
        raise Refused("; ".join(f"{r['rule']}: {r['broken']} rows" for r in bad))
    return df


def different_hashes(a: DataFrame, b: DataFrame, names: tuple[str, ...] = HASHES) -> DataFrame:
    """name of each hash (name, hash) that two results do not share; one that either lacks is a difference."""
    need = a.sparkSession.createDataFrame([(n,) for n in names], "name string")
    both = need.join(a.select("name", F.col("hash").alias("_a")), "name", "left").join(b.select("name", F.col("hash").alias("_b")), "name", "left")
    return both.where(~F.coalesce((F.col("_a") == F.col("_b")) & (F.col("_a") != ""), F.lit(False))).select("name")


def comparable(a: DataFrame, b: DataFrame, names: tuple[str, ...] = HASHES) -> None:
    bad = sorted(r["name"] for r in different_hashes(a, b, names).collect())
    if bad:
        raise Refused(f"results are not comparable: different {', '.join(bad)} hash")


def mark_filters(marks: DataFrame, storm: str, box: tuple[float, float, float, float]) -> DataFrame:
    """``marks`` (mark_id, storm, confidence, lon, lat, height) with reason: why a mark does not count, null where it does.

    The first that holds: of another storm, of low or unknown confidence, outside the box, without a height over 0, and
    a repeated id, whose first of those left by lon, lat and height counts.
    """
    w, s, e, n = box
    first = first_reason(
        other_storm=~F.coalesce(F.lower("storm").startswith(storm), F.lit(False)),
        low_confidence=F.coalesce(F.col("confidence").rlike("^(VP|Unknown)"), F.lit(False)),
        outside_box=~F.coalesce(F.col("lon").between(w, e) & F.col("lat").between(s, n), F.lit(False)),
        no_height=~F.coalesce(F.col("height") > 0, F.lit(False)),
    )
    return _first_of_each(marks.withColumn("reason", first), ["mark_id"], ["lon", "lat", "height"], "repeated_id")


def _first_of_each(df: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """``reason`` is ``name`` for rows without one that share a key with an earlier such row; rows alike in ``order`` too."""
    place = F.row_number().over(Window.partitionBy(*key, F.col("reason").isNull()).orderBy(*order))
    return df.withColumn("reason", F.coalesce("reason", F.when(place > 1, name)))


def reasons(df: DataFrame) -> DataFrame:
    """reason and n: how many rows fell to each, and how many were kept."""
    return df.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def clean_reports(raw: DataFrame, now: Column, box: tuple[float, float, float, float], types: list[str], spare: tuple[str, str] | None = None) -> DataFrame:
    """``raw`` (source, id, type, lon, lat, received in epoch milliseconds) with report_id, time, lon, lat and reason.

    The first reason that holds: wrong_type, unlocated (0 and 0 is no place; ``spare`` names columns to fall back on),
    out_of_state, undated, future, duplicate (a later row of one source and id).
    """
    w, s, e, n = box

    def usable(x: Column, y: Column) -> Column:
        return F.coalesce((F.abs(x) > 1e-9) & (F.abs(y) > 1e-9) & ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf")), F.lit(False))

    x, y = F.col("lon").cast("double"), F.col("lat").cast("double")
    if spare:
        here, there = usable(x, y), [F.col(c).cast("double") for c in spare]
        x, y = F.when(here, x).otherwise(there[0]), F.when(here, y).otherwise(there[1])
    df = raw.withColumns({"lon": x, "lat": y, "time": epoch_ms(F.col("received")), "report_id": F.concat_ws(":", "source", F.col("id").cast("string"))})
    reason = first_reason(
        wrong_type=~F.coalesce(F.col("type").isin(*types), F.lit(False)),
        unlocated=~usable(F.col("lon"), F.col("lat")),
        out_of_state=~(F.col("lon").between(w, e) & F.col("lat").between(s, n)),
        undated=F.col("received").isNull(),
        future=F.col("time") > now,
    )
    return _first_of_each(df.withColumn("reason", reason), ["report_id"], ["received", "lon", "lat", "type"], "duplicate")


def assert_few_repeats(cleaned: DataFrame, most: float = MOST_REPEATED) -> DataFrame:
    """``cleaned`` reports, refused where a source has over ``most`` of its rows as duplicates."""
    by = cleaned.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("reason") == "duplicate").alias("d"))
    bad = by.where(F.col("d") > most * F.col("n")).collect()
    if bad:
        raise Refused("; ".join(f"{r['source']}: {r['d']} duplicate report ids in {r['n']} rows" for r in bad))
    return cleaned
