"""Sinks: versions behind a manifest, fixed CSV layouts, shards, GeoJSON, dumps, report tables."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corridor.common import Refused
from corridor.operators.ranking import global_rank

MANIFEST = "name string, version string, status string, rows long, at timestamp"


def write_versioned(df: DataFrame, root: str, name: str) -> str:
    """Writes aside, then notes the version as loaded and, after its rows are counted again, as complete.

    A failed write leaves the last complete version in use; readers take that one alone.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    path = f"{root}/{name}/{version}"

    def note(status: str, rows: int | None) -> None:
        entry = spark.createDataFrame([(name, version, status, rows)], "name string, version string, status string, rows long")
        entry.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/_manifest")

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    written = seen.get["rows"]
    note("loaded", written)
    found = spark.read.parquet(path).count()
    if found != written:
        raise Refused(f"{name}: {written} rows written, {found} found")
    note("complete", found)
    return version


def read_versioned(spark: SparkSession, root: str, name: str) -> DataFrame:
    notes = spark.read.schema(MANIFEST).parquet(f"{root}/_manifest").where((F.col("name") == name) & (F.col("status") == "complete"))
    last = notes.orderBy(F.desc("at")).limit(1).collect()
    if not last:
        raise Refused(f"{name}: no complete version")
    return spark.read.parquet(f"{root}/{name}/{last[0]['version']}")


def last_status(spark: SparkSession, root: str) -> str | None:
    """The status of the newest version of any name under a root; null where nothing was loaded."""
    notes = spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")
    return notes.agg(F.max_by("status", F.struct("at", F.when(F.col("status") == "complete", 1).otherwise(0)))).first()[0]


# Layouts of exports, heading to source column and kind.
RISK = {
    "seg_id": ("seg_id", "text"), "route_id": ("route_id", "text"), "route": ("route", "text"), "county": ("county", "text"), "beg_mp": ("beg_mp", "float"), "end_mp": ("end_mp", "float"),
    "from_desc": ("from_desc", "text"), "to_desc": ("to_desc", "text"), "length_mi": ("length_mi", "float"), "mid_lon": ("mid_lon", "float"), "mid_lat": ("mid_lat", "float"),
    "rating": ("rating", "float"), "survey_year": ("survey_year", "text"), "wear_rate_pred": ("pred_rate", "float"), "wear_rate_heldout": ("rate_heldout", "bool"),
    "years_to_poor": ("pred_years_to_poor", "float"), "repair_bucket": ("repair_bucket", "text"), "crack_risk": ("pred_crack", "float"), "crack_heldout": ("crack_heldout", "bool"),
    "flood_risk": ("pred_flood", "float"), "flood_scored": ("flood_scored", "bool"), "flood_heldout": ("flood_heldout", "bool"),
}
QUEUE = {
    "route": ("route", "text"), "county": ("county", "text"), "from_mp": ("beg_mp", "float"), "to_mp": ("end_mp", "float"), "tier": ("tier", "text"), "priority_score": ("score", "float"),
    "years_to_poor": ("years", "float"), "wear_heldout": ("rate_heldout", "yes"), "cracking_probability": ("crack", "float"), "flood_score": ("flood", "zone"), "rating": ("rating", "float"),
    "survey_year": ("survey_year", "text"), "vehicles_per_day": ("traffic", "float"), "traffic_source": ("traffic_source", "text"), "ncdot_treatment": ("treatment", "text"),
    "ncdot_cost": ("cost", "float"), "seg_id": ("seg_id", "text"), "longitude": ("lon", "float"), "latitude": ("lat", "float"),
}
STORM = {
    "rank": ("rank", "text"), "route": ("route", "text"), "county": ("county", "text"), "from_mp": ("beg_mp", "float"), "to_mp": ("end_mp", "float"), "from": ("from_desc", "text"), "to": ("to_desc", "text"),
    "flood_score": ("flood", "float"), "seg_id": ("seg_id", "text"), "longitude": ("lon", "float"), "latitude": ("lat", "float"),
    "equipment_staged": (None, "text"), "detour_planned": (None, "text"), "checked_by": (None, "text"),
}
ORDER = {
    "work_order": ("work_order", "text"), "status": ("status", "text"), "crew": ("crew", "text"), "due": ("due", "text"), "order_tier": ("order_tier", "text"), "seg_id": ("seg_id", "text"), "route": ("route", "text"),
    "county": ("county", "text"), "from_mp": ("beg_mp", "float"), "to_mp": ("end_mp", "float"), "miles": ("miles", "miles"), "from": ("from_desc", "text"), "to": ("to_desc", "text"), "tier": ("tier", "text"),
    "years_to_poor": ("years", "float"), "cracking_prob": ("crack", "float"), "flood_score_helene_zone": ("flood", "assessed"), "ncdot_rating": ("rating", "float"), "rating_year": ("survey_year", "text"),
    "ncdot_treatment": ("treatment", "text"), "ncdot_cost_estimate": ("cost", "float"), "notes": ("notes", "text"), "data_note": ("data_note", "text"),
}


def laid_out(df: DataFrame, layout: dict[str, tuple[str | None, str]]) -> DataFrame:
    """A fixed layout as text columns; a heading without a source, or whose source is not there, is blank.

    Kinds beside those of csv_text: ``yes`` says yes or no, ``zone`` is blank outside the zone and ``assessed`` says so
    there, ``miles`` has three decimals.
    """
    kinds = {"yes": "text", "zone": "float", "assessed": "text", "miles": "text"}

    def value(c: str | None, kind: str) -> Column:
        if c is None or c not in df.columns:
            return F.lit(None).cast("string")
        v = F.col(c)
        if kind == "yes":
            return F.when(v, "yes").otherwise("no")
        if kind == "zone":
            return F.when(F.col("in_zone"), v)
        if kind == "assessed":
            return F.when(F.col("in_zone"), number_text(v)).otherwise("not assessed")
        return F.format_string("%.3f", v.cast("double")) if kind == "miles" else v

    plain = df.select(*[value(c, k).alias(h) for h, (c, k) in layout.items()])
    known = {h: ("text" if c is None or c not in df.columns else kinds.get(k, k)) for h, (c, k) in layout.items()}
    return csv_text(plain, known)


def number_text(v: Column) -> Column:
    """A number with at most six decimals and no zeros at the end; null for null."""
    return F.when(v.isNotNull(), F.regexp_replace(F.regexp_replace(F.format_string("%.6f", v.cast("double")), "0+$", ""), r"\.$", ""))


def csv_text(df: DataFrame, layout: dict[str, str]) -> DataFrame:
    """Columns of a fixed layout as text: blanks empty, true and false, numbers with at most six decimals."""

    def text(c: str, kind: str) -> Column:
        v = F.col(f"`{c}`")
        if kind == "bool":
            v = F.when(v, "true").when(~v, "false")
        elif kind == "float":
            v = number_text(v)
        else:
            v = v.cast("string")
        return F.when(F.col(f"`{c}`").isNull(), "").otherwise(v).alias(c)

    return df.select(*[text(c, k) for c, k in layout.items()])


#: Rows of a page of an export.
PAGE = 250_000
#: Tasks that write an export, at most; of more pages each writes several.
MOST_WRITERS = 512


def write_fixed_csv(df: DataFrame, path: str, layout: dict[str, str], key: str, page: int = PAGE) -> int:
    """The layout sorted by ``key`` (and, where keys repeat, by all columns) in files of ``page`` rows each but the last.

    Pages are cut by exact rank, so the same rows give the same files, byte for byte, however they were dealt before.
    Returns the pages that a task writes, n: page k is part-<k // n> with -c<k % n> at the end of its name.
    """
    return _write_pages(csv_text(df, layout), path, key, page)


def write_laid_out(df: DataFrame, path: str, layout: dict[str, tuple[str | None, str]], key: str = "seg_id", page: int = PAGE) -> int:
    """An export in one of the fixed layouts, in pages by exact rank of its heading ``key``."""
    return _write_pages(laid_out(df, layout), path, key, page)


def _write_pages(text: DataFrame, path: str, key: str, page: int) -> int:
    order = [F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in text.columns if c != key]]
    ranked = global_rank(text, [c.asc() for c in order], "_rank").withColumn("_page", F.floor((F.col("_rank") - 1) / page).cast("int"))
    pages = ranked.agg(F.coalesce(F.max("_page"), F.lit(0)) + 1).first()[0]
    each = math.ceil(pages / MOST_WRITERS)
    dealt = ranked.repartitionById(math.ceil(pages / each), F.floor(F.col("_page") / each).cast("int")).sortWithinPartitions("_rank")
    dealt.drop("_rank", "_page").write.option("maxRecordsPerFile", page).csv(path, header=True, emptyValue="")
    return each


def data_dictionary(df: DataFrame, said: dict[str, tuple[str, str]]) -> DataFrame:
    """Name, description and unit of each column."""
    rows = [(c, *said.get(c, ("", ""))) for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "name string, description string, unit string")


def write_shards(df: DataFrame, path: str, cell: Column, county: Column, short: list[str], pieces: int = 8, key: str = "seg_id") -> None:
    """JSON by grid cell, every row in one: ``short`` columns under map, all under detail; and all again by county.

    A crowded cell is up to ``pieces`` files, dealt by a hash of the key, so that no task writes it whole.
    """
    piece = F.pmod(F.xxhash64(key), F.lit(pieces))
    named = df.withColumns({"cell": cell, "county_code": county, "_piece": piece})
    by_cell = named.repartition("cell", "_piece")
    by_cell.select("cell", *short).write.partitionBy("cell").json(f"{path}/map")
    by_cell.drop("_piece", "county_code").write.partitionBy("cell").json(f"{path}/detail")
    named.repartition("county_code", "_piece").drop("_piece", "cell").write.partitionBy("county_code").json(f"{path}/county")


def feature(line: str, *properties: str) -> Column:
    """A GeoJSON feature of a line with coordinates to six places; missing properties are left out."""
    at = F.transform(line, lambda p: F.array(F.round(p["x"], 6), F.round(p["y"], 6)))
    shape = F.struct(F.lit("LineString").alias("type"), at.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), shape.alias("geometry")))


def feature_collections(df: DataFrame, group: str, line: str, order: str, *properties: str) -> DataFrame:
    """``group`` and geojson: the lines of each group, a work order's say, as one collection in order of ``order``."""
    each = df.select(group, F.struct(F.col(order).alias("o"), feature(line, *properties).alias("f")).alias("s"))
    features = F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["f"]), ",")
    name = F.to_json(F.struct(F.col(group).cast("string").alias("name")))
    head = F.concat(F.lit('{"type":"FeatureCollection",'), F.substring(name, 2, 1 << 20).substr(F.lit(1), F.length(name) - 2), F.lit(',"features":['))
    return each.groupBy(group).agg(features.alias("f")).select(group, F.concat(head, F.col("f"), F.lit("]}")).alias("geojson"))


def dump_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.csv(f"{folder}/{name}", header=True, timestampFormat="yyyy-MM-dd'T'HH:mm:ssXXX", emptyValue="", nullValue="")


def markdown(df: DataFrame, most: int = 500) -> str:
    """A small result as a report table; blanks stay blank. More rows than ``most`` refuse."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise Refused("a report table is small: aggregate first")
    said = [["" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r] for r in rows]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *said])
