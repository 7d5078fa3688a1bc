"""Sources: tables, landed pages of feature layers, GeoJSON marks, sensor feeds, file indexes, grade sheets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corridor.common import Refused
from corridor.functions.geo import wkb_to_parts


def read_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def geo_codes(spark: SparkSession, path: str, geometry: str) -> set[str]:
    """The coordinate systems that Parquet files give for a geometry column in their ``geo`` metadata, as authority:code.

    A file without the metadata gives ``unknown``; one that names no system means longitude and latitude, as its
    format says. Footers are read by tasks, a file each.
    """
    files = [r["p"] for r in spark.read.parquet(path).select(F.col("_metadata.file_path").alias("p")).distinct().collect()]

    def said(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        for b in batches:
            out = []
            for p in b.column(0).to_pylist():
                where, name = fs.FileSystem.from_uri(p)
                meta = pq.read_schema(name, filesystem=where).metadata or {}
                if b"geo" not in meta:
                    out.append("unknown")
                    continue
                column = json.loads(meta[b"geo"])["columns"].get(geometry, {})
                of = (column.get("crs") or {}).get("id") or {}
                named = f"{of.get('authority')}:{of.get('code')}" if of else "other" if column.get("crs") else "OGC:CRS84"
                out.append(named)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["code"])

    rows = spark.createDataFrame([(f,) for f in files], "p string").repartition(max(1, len(files))).mapInArrow(said, "code string")
    return {r["code"] for r in rows.distinct().collect()}


def read_geo(spark: SparkSession, path: str, geometry: str = "geometry") -> DataFrame:
    """Parquet with WKB shapes as ``parts`` of vertices; refuses files in another coordinate system than longitude and
    latitude, or that do not say theirs, and missing or empty shapes."""
    other = sorted(geo_codes(spark, path, geometry) - {"EPSG:4326", "OGC:CRS84"})
    if other:
        raise Refused(f"shapes must be in EPSG:4326, not {other}")
    df = spark.read.parquet(path)
    bad = df.where(F.col(geometry).isNull() | (F.length(geometry) <= 9)).count()
    if bad:
        raise Refused(f"{bad} shapes missing or empty")
    return df.withColumn("parts", wkb_to_parts(F.col(geometry))).drop(geometry)


def ingest_pages(spark: SparkSession, path: str, fields: dict[str, str], expected: int | None = None) -> DataFrame:
    """Landed JSON pages of a feature layer to rows: ``fields`` (name to type) of attributes, and x and y of points.

    A page with an error, fields that no page has, or another number of rows than the server counted refuse.
    """
    attributes = T.StructType([T.StructField(n, T.StringType()) for n in fields])
    geometry = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    feature = T.StructType([T.StructField("attributes", attributes), T.StructField("geometry", geometry)])
    schema = T.StructType([T.StructField("error", T.StringType()), T.StructField("fields", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))), T.StructField("features", T.ArrayType(feature))])
    pages = spark.read.schema(schema).json(path, multiLine=True)
    said = pages.agg(F.count_if(F.col("error").isNotNull()).alias("errors"), F.coalesce(F.sum(F.size("features")), F.lit(0)).alias("n"), F.array_distinct(F.flatten(F.collect_set(F.col("fields.name")))).alias("names")).first()
    if said["errors"]:
        raise Refused(f"{said['errors']} pages hold an error")
    if said["names"] and set(fields) - set(said["names"]):
        raise Refused(f"fields missing: {sorted(set(fields) - set(said['names']))}")
    if expected is not None and said["n"] != expected:
        raise Refused(f"{said['n']} rows received, {expected} counted")
    rows = pages.select(F.explode("features").alias("f"))
    return rows.select(*[F.col(f"f.attributes.{n}").try_cast(t).alias(n) for n, t in fields.items()], "f.geometry.x", "f.geometry.y")


def ingest_points(spark: SparkSession, path: str, fields: dict[str, str], expected: int | None = None) -> DataFrame:
    return ingest_pages(spark, path, fields, expected).where("x is not null and y is not null")


def read_marks(spark: SparkSession, path: str, properties: dict[str, str]) -> DataFrame:
    """GeoJSON points as rows; a required property that no feature has refuses."""
    props = T.StructType([T.StructField(n, T.StringType()) for n in properties])
    geometry = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.DoubleType()))])
    schema = T.StructType([T.StructField("features", T.ArrayType(T.StructType([T.StructField("properties", props), T.StructField("geometry", geometry)])))])
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).where("f.geometry.type = 'Point'")
    empty = f.agg(*[F.count(F.col(f"f.properties.{n}")).alias(n) for n in properties]).first()
    lacking = [n for n in properties if not empty[n]]
    if lacking:
        raise Refused(f"properties missing: {lacking}")
    return f.select(*[F.col(f"f.properties.{n}").try_cast(t).alias(n) for n, t in properties.items()], F.get("f.geometry.coordinates", 0).alias("lon"), F.get("f.geometry.coordinates", 1).alias("lat"))


def read_sensor_feed(spark: SparkSession, path: str, parameter: str = "water_level_raw") -> DataFrame:
    """One JSON a station with parallel arrays of times and values per parameter, to station, time, level_m and bad.

    Values that are no numbers stay as rows with ``bad`` true, so that they can be counted and dropped.
    """
    series = T.StructType([T.StructField("name", T.StringType()), T.StructField("times", T.ArrayType(T.StringType())), T.StructField("values", T.ArrayType(T.StringType()))])
    schema = T.StructType([T.StructField("station", T.StringType()), T.StructField("params", T.ArrayType(series))])
    one = F.get(F.filter("params", lambda p: p["name"] == parameter), 0)
    df = spark.read.schema(schema).json(path, multiLine=True).select("station", one.alias("p")).where("p is not null")
    z = df.select("station", F.explode(F.arrays_zip(F.col("p.times").alias("t"), F.col("p.values").alias("v"))).alias("z"))
    level = F.col("z.v").try_cast("double")
    return z.select("station", F.col("z.t").try_cast("timestamp").alias("time"), level.alias("level_m"), (level.isNull() | F.isnan(level)).alias("bad"))


def index_files(spark: SparkSession, path: str, pattern: str = r"([A-Za-z0-9]+)_(\d{8}T\d{6})Z?\.\w+$") -> DataFrame:
    """Station and UTC time of files by their names; contents are not read."""
    f = spark.read.format("binaryFile").load(path).select("path", "length")
    return f.select("path", "length", F.regexp_extract("path", pattern, 1).alias("station"), F.try_to_timestamp(F.regexp_extract("path", pattern, 2), F.lit("yyyyMMdd'T'HHmmss")).alias("time"))


def read_grades(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A sheet of text columns in which blank cells stay empty text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, header=True, emptyValue="", nullValue="\x00").fillna("")
