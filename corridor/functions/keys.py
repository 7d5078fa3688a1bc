"""Road keys: route ids, segment ids, labels, and cleaning of what stands for a missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Route classes by the first digit of a route id.
CLASSES = {"1": "I", "2": "US", "3": "NC", "4": "SR"}
# How a class stands before its number; counties by code, 1 to 100.
LABELS = {"1": "I-", "2": "US ", "3": "NC ", "4": "SR "}
COUNTIES = (
    "Alamance, Alexander, Alleghany, Anson, Ashe, Avery, Beaufort, Bertie, Bladen, Brunswick, Buncombe, Burke, Cabarrus, Caldwell, "
    "Camden, Carteret, Caswell, Catawba, Chatham, Cherokee, Chowan, Clay, Cleveland, Columbus, Craven, Cumberland, Currituck, Dare, "
    "Davidson, Davie, Duplin, Durham, Edgecombe, Forsyth, Franklin, Gaston, Gates, Graham, Granville, Greene, Guilford, Halifax, "
    "Harnett, Haywood, Henderson, Hertford, Hoke, Hyde, Iredell, Jackson, Johnston, Jones, Lee, Lenoir, Lincoln, Macon, Madison, "
    "Martin, McDowell, Mecklenburg, Mitchell, Montgomery, Moore, Nash, New Hanover, Northampton, Onslow, Orange, Pamlico, Pasquotank, "
    "Pender, Perquimans, Person, Pitt, Polk, Randolph, Richmond, Robeson, Rockingham, Rowan, Rutherford, Sampson, Scotland, Stanly, "
    "Stokes, Surry, Swain, Transylvania, Tyrrell, Union, Vance, Wake, Warren, Washington, Watauga, Wayne, Wilkes, Wilson, Yadkin, "
    "Yancey"
).split(", ")
# Words that make a structure a culvert or pipe.
CULVERT = "culvert|pipe|rcbc|cmp|corrugated|aluminum|multi-plate"
SEG_ID = r"^ncdot:(\d{8})(\d{3}):(\d+(?:\.\d+)?)$"
HIGHWAY = r"(?i)^\s*(I|US|NC|SR)[-\s]*(\d+)(?:\s*(ALT|BUS|BYP))?\s*$"


def route_key(c: Column) -> Column:
    """Text, float or integer ids to a long; junk to null. Halves round to even."""
    return F.bround(c.try_cast("double")).cast("long")


def norm_route(c: Column) -> Column:
    """Without a trailing .0 and blanks; the last eight characters."""
    return F.right(F.regexp_replace(F.trim(c.cast("string")), r"\.0$", ""), F.lit(8))


def compose_route(route: Column, county: Column) -> Column:
    return F.concat(norm_route(route), F.lpad(county.cast("int").cast("string"), 3, "0"))


def make_seg_id(route: Column, milepost: Column) -> Column:
    return F.format_string("ncdot:%s:%.3f", route, milepost.cast("double"))


def parse_seg_id(c: Column) -> Column:
    """Struct of route, class, number, county and milepost; null where the id has another shape."""
    route = F.regexp_extract(c, SEG_ID, 1)
    names = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    out = F.struct(
        route.alias("route"),
        names[F.substring(route, 1, 1)].alias("class"),
        F.substring(route, 4, 5).cast("int").alias("number"),
        F.regexp_extract(c, SEG_ID, 2).cast("int").alias("county"),
        F.regexp_extract(c, SEG_ID, 3).cast("double").alias("milepost"),
    )
    return F.when(c.rlike(SEG_ID), out)


def route_label(seg_id: Column, number: Column | None = None) -> Column:
    """'US 13' or 'I-40' from a segment's id; a class that is not known counts as a secondary road.

    An id has room for five digits of a route's number; ``number`` is the route's own, where the table has it.
    """
    p = parse_seg_id(seg_id)
    names = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.concat(F.coalesce(names[F.substring(p["route"], 1, 1)], F.lit(LABELS["4"])), (p["number"] if number is None else number).cast("string"))


def county_name(code: Column) -> Column:
    """The name of a county by its code, 1 to 100; null for others."""
    return F.when(code.between(1, len(COUNTIES)), F.get(F.array(*[F.lit(c) for c in COUNTIES]), code - 1))


def road_name(seg_id: Column, number: Column | None = None) -> Column:
    """'SR 2748, Wake County (mp 0.94)'; the county is left out where its code is none. ``number`` as in ``route_label``."""
    p = parse_seg_id(seg_id)
    county = F.coalesce(F.concat(F.lit(", "), county_name(p["county"]), F.lit(" County")), F.lit(""))
    return F.concat(route_label(seg_id, number), county, F.format_string(" (mp %.2f)", p["milepost"]))


def parse_highway(c: Column) -> Column:
    """'I-40', 'US 70 BUS' or 'sr2748' to a struct of class and number; else null."""
    out = F.struct(F.upper(F.regexp_extract(c, HIGHWAY, 1)).alias("class"), F.regexp_extract(c, HIGHWAY, 2).cast("int").alias("number"))
    return F.when(c.rlike(HIGHWAY), out)


def nearest_place(lon: Column, lat: Column, places: dict[str, tuple[float, float]]) -> Column:
    """The closest of a few reference points; ties by name."""
    found = [F.struct((F.pow(lon - x, 2) + F.pow(lat - y, 2)).alias("d"), F.lit(n).alias("n")) for n, (x, y) in places.items()]
    return F.array_min(F.array(*found))["n"]


def split_county(c: Column) -> Column:
    """'092-Wake' to a struct of code and name."""
    p = F.split(c, "-", 2)
    return F.struct(F.get(p, 0).alias("code"), F.get(p, 1).alias("name"))


def missing_to_null(c: Column, sentinels: tuple) -> Column:
    return F.when(~c.isin(*sentinels), c)


def contains_any(pattern: str, *texts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *texts)).rlike(pattern)


def is_bridge(kind: Column) -> Column:
    """Anything that is not named a culvert or a pipe; blank counts as a bridge."""
    return ~F.lower(F.coalesce(kind, F.lit(""))).rlike(CULVERT)


def epoch_ms(c: Column) -> Column:
    return F.timestamp_millis(c.cast("long"))


ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"


def parse_time(c: Column) -> Column:
    """ISO text with a zone to a timestamp; null without a zone or in another shape."""
    return F.when(c.rlike(ISO), c.try_cast("timestamp"))


def heldout_bits(*flags: Column) -> Column:
    out = F.lit(0)
    for k, f in enumerate(flags):
        out = out + F.when(f, 1 << k).otherwise(0)
    return out


def record_json(**fields: Column) -> Column:
    """A record as JSON text in which missing fields are left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def block_id(x: Column, y: Column, size: int = 5000) -> Column:
    return F.concat_ws("_", F.floor(x / size).cast("string"), F.floor(y / size).cast("string"))


def fold_of(block: Column, k: int = 5) -> Column:
    """crc32 of the block's name; it does not depend on any other row."""
    return F.pmod(F.crc32(block.cast("binary")), F.lit(k)).cast("int")
