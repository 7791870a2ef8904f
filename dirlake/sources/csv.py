"""CSV files and lines of locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlake.functions.scalar import unicode_trim

from .schema import LOCATION_CSV

#: Commas of a line with all fields.
COMMAS = LOCATION_CSV.count(",")


def fields(line: Column) -> Column:
    """A line's fields, quotes respected; a short line's missing fields are null."""
    return F.from_csv(line, LOCATION_CSV, {"mode": "PERMISSIVE", "escape": "\""})


def parse_lines(lines: DataFrame) -> DataFrame:
    """Fields of lines (line_no, line); blank lines go."""
    kept = lines.where(F.length(unicode_trim("line")) > 0)
    return kept.select("line_no", fields(F.regexp_replace("line", "\r$", "")).alias("f")).select("line_no", "f.*")


def checked_lines(lines: DataFrame) -> DataFrame:
    """As parse_lines, with the line itself and malformed: 'quotes' if they don't pair up, 'long' if there are too many fields, else null.

    The CSV reader marks lines whose fields aren't as many as the columns; of these, short ones are well formed.
    """
    kept = lines.where(F.length(unicode_trim("line")) > 0).withColumn("_row", F.regexp_replace("line", "\r$", ""))
    parsed = F.from_csv("_row", f"{LOCATION_CSV}, _corrupt string", {"mode": "PERMISSIVE", "escape": "\"", "columnNameOfCorruptRecord": "_corrupt"})
    kept = kept.select("line_no", "line", "_row", parsed.alias("f")).select("line_no", "line", "_row", "f.*")
    bare = F.regexp_replace("_row", '"[^"]*"', "")  # a doubled quote within quotes ends one such part and begins another
    malformed = F.when(F.regexp_count("_row", F.lit('"')) % 2 == 1, "quotes").when(F.col("_corrupt").isNotNull() & (F.regexp_count(bare, F.lit(",")) > COMMAS), "long")
    return kept.withColumn("malformed", malformed).drop("_row", "_corrupt")


def read_locations(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """country, city, district, lat, lng of the files at path, with line_no, which rises by file name, then place.

    With multi_line a quoted field may hold line feeds, but each file is read by one task; else large files are split.
    """
    rows = spark.read.csv(path, schema=LOCATION_CSV, header=True, multiLine=multi_line, escape='"')
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    return rows.select("*", place.alias("line_no"))
