"""Locations from CSV rows: country, city and district terms, and coordinates of cities.

What a row-by-row import would leave: the first spelling of a name stays, the last valid coordinates win. Terms are
told by their normalised names below their parent, so an import repeated, or split into batches, ends the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from dirlake.functions.scalar import decimal_point, form_trim, is_empty, is_numeric, slug, text_field
from dirlake.sources.shared import cut

from .meta import unpivot, upsert_rows
from .terms import at_paths, create_terms

#: Countries whose third column is a district, and header names, in lower case.
DOMESTIC, HEADERS = ("türkiye", "turkey"), ("ülke", "ulke", "country")


def location_rows(rows: DataFrame, domestic: tuple[str, ...] = DOMESTIC) -> DataFrame:
    """Usable rows (line_no, country, city, district, lat, lng): trimmed names, empty as null, coordinates if both are valid."""
    out = rows.where(~is_empty(F.col("country"))).withColumns({c: form_trim(F.col(c)) for c in ("country", "city", "district")})
    out = out.where(~F.lower("country").isin(*HEADERS) & (F.col("country") != ""))
    home = F.lower("country").isin(*domestic)
    lat, lng = decimal_point(F.col("lat")), decimal_point(F.col("lng"))
    valid = ~home & is_numeric(lat) & is_numeric(lng)
    city = F.when(~is_empty(F.col("city")), F.col("city"))
    return out.select("line_no", "country", city.alias("city"), F.when(home & city.isNotNull() & ~is_empty(F.col("district")), F.col("district")).alias("district"), F.when(valid, text_field(lat)).alias("lat"), F.when(valid, text_field(lng)).alias("lng"))


def location_terms(rows: DataFrame, domestic: tuple[str, ...] = DOMESTIC) -> DataFrame:
    """path (normalised names), level, name, parent_path, lat, lng of each location; lat and lng only for cities."""
    own = location_rows(rows, domestic).withColumns({f"{c}_key": slug(F.col(c)) for c in ("country", "city", "district")})
    level = lambda name, keys, use: F.struct(F.concat_ws("/", *keys).alias("path"), F.lit(name).alias("level"), F.col(name).alias("name"), F.concat_ws("/", *keys[:-1]).alias("parent_path"), *[(F.col(c) if use else F.lit(None).cast("string")).alias(c) for c in ("lat", "lng")])
    levels = F.array(level("country", ["country_key"], False), level("city", ["country_key", "city_key"], True), level("district", ["country_key", "city_key", "district_key"], False))
    each = own.select("line_no", F.explode(levels).alias("t")).select("line_no", "t.*").where("name is not null")
    found = each.groupBy("path", "level", "parent_path").agg(
        F.min_by("name", "line_no").alias("name"),
        F.max_by(F.when(F.col("lat").isNotNull(), F.struct("lat", "lng")), F.when(F.col("lat").isNotNull(), F.col("line_no"))).alias("at"),
    )
    return found.select("path", "level", "name", "parent_path", "at.lat", "at.lng")


def import_terms(rows: DataFrame, terms: DataFrame, meta: DataFrame, domestic: tuple[str, ...] = DOMESTIC) -> tuple[DataFrame, DataFrame]:
    """Terms and attribute rows (meta_id, term_id, key, value) after importing rows: level and coordinates are attributes.

    Terms that are there get the level that the rows name; coordinates that the rows don't give stay. New terms and new
    attribute rows get the next numbers of theirs.
    """
    found = cut(location_terms(rows, domestic), "locations")
    terms = cut(create_terms(terms, found), "terms")
    wide = at_paths(terms, found).select("term_id", F.col("level").alias("location_type"), F.col("lat").alias("map_lat"), F.col("lng").alias("map_lng"))
    return terms, upsert_rows(meta, unpivot(wide, "term_id", ["location_type", "map_lat", "map_lng"]), "term_id")


def merge_locations(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing locations after importing new ones: known names stay, new coordinates replace old ones."""
    added = new.select("path", *[F.col(c).alias(f"_{c}") for c in ("level", "name", "parent_path", "lat", "lng")])
    both = existing.join(added, "path", "full")
    place = F.when(F.col("_lat").isNotNull(), F.struct(F.col("_lat").alias("lat"), F.col("_lng").alias("lng"))).otherwise(F.struct("lat", "lng"))
    return both.select("path", *[F.coalesce(c, f"_{c}").alias(c) for c in ("level", "name", "parent_path")], place["lat"].alias("lat"), place["lng"].alias("lng"))


def import_report(rows: DataFrame, domestic: tuple[str, ...] = DOMESTIC) -> DataFrame:
    """submitted and accepted: rows given, and rows that made a location."""
    taken = location_rows(rows, domestic).select("line_no").withColumn("ok", F.lit(1))
    return rows.join(taken, "line_no", "left").agg(F.count("*").alias("submitted"), F.count("ok").alias("accepted"))


def row_error() -> Column:
    """Why a row makes no location: 'country' if it has none, 'header' if it repeats the header; null if it makes one."""
    country = F.lower(form_trim(F.col("country")))
    return F.when(is_empty(F.col("country")) | (country == ""), "country").when(country.isin(*HEADERS), "header")


def rejected_rows(rows: DataFrame) -> DataFrame:
    """line_no and error of the rows (line_no, country, ...) that make no location: without a country, or a repeated header."""
    return rows.select("line_no", row_error().alias("error")).where("error is not null")


def judged(checked: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of checked_lines with error: why a row is set aside, and accepted: whether it makes a location.

    A malformed line makes what its fields say, and is reported; strict keeps it out.
    """
    error = F.coalesce(row_error(), F.col("malformed"))
    return checked.withColumn("error", error).withColumn("accepted", (row_error().isNull() & (F.col("malformed").isNull() | F.lit(not strict))))


def quarantine(rows: DataFrame) -> DataFrame:
    """line_no, line, error, accepted of the judged rows that have an error."""
    return rows.where("error is not null").select("line_no", "line", "error", "accepted")


def counted(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """Judged rows, and what the pass that writes them counts: submitted, accepted, and rejected ones. No scan of their own."""
    counts = Observation()
    return rows.observe(counts, F.count("*").alias("submitted"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), F.count("malformed").alias("malformed")), counts
