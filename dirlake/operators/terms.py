"""Hierarchical terms: look-up by slug or name, paths, links to entities, get-or-create."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlake.functions.scalar import is_empty, slug
from dirlake.sources.shared import cut

from .keys import with_keys

#: How names are compared: neither case nor accents count.
NAMES = "UNICODE_CI_AI"


def name_key(c: Column, collation: str | None = NAMES) -> Column:
    """A name as a key of joins and groups; with a collation the dotless i counts as an i, too."""
    return c if collation is None else F.collate(F.translate(c, "ı", "i"), collation)


def by_slug_or_name(rows: DataFrame, wanted: str, terms: DataFrame, taxonomy: str, found: str, collation: str | None = NAMES) -> DataFrame:
    """rows with the term_id, as column found, whose slug is in column wanted, or else whose name is; null if none.

    Names are equal by a collation, or byte by byte without one. Of several such terms the smallest term_id counts. Empty
    values find nothing.
    """
    own = terms.where(F.col("taxonomy") == taxonomy)
    slugs = own.where("slug is not null").groupBy(F.col("slug").alias("_slug")).agg(F.min("term_id").alias("_by_slug"))
    names = own.where("name is not null").groupBy(name_key(F.col("name"), collation).alias("_name")).agg(F.min("term_id").alias("_by_name"))
    out = rows.join(slugs, F.col(wanted) == F.col("_slug"), "left").join(names, name_key(F.col(wanted), collation) == F.col("_name"), "left")
    hit = F.when(~is_empty(F.col(wanted)), F.coalesce("_by_slug", "_by_name"))
    return out.withColumn(found, hit).drop("_slug", "_name", "_by_slug", "_by_name")


def city_and_district(rows: DataFrame, terms: DataFrame, taxonomy: str = "location") -> DataFrame:
    """rows (city, district) with city_id and district_id; a district counts only where the city was found."""
    out = by_slug_or_name(by_slug_or_name(rows, "city", terms, taxonomy, "city_id"), "district", terms, taxonomy, "district_id")
    return out.withColumn("district_id", F.when(F.col("city_id").isNotNull(), F.col("district_id")))


def first_term(links: DataFrame, terms: DataFrame, taxonomy: str) -> DataFrame:
    """entity_id and term_name: of each entity's terms the first by name, then term_id."""
    own = links.where(F.col("taxonomy") == taxonomy).join(terms.where(F.col("taxonomy") == taxonomy).select("term_id", "name"), "term_id")
    return own.groupBy("entity_id").agg(F.min(F.struct("name", "term_id")).alias("t")).select("entity_id", F.col("t.name").alias("term_name"))


def replace_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """links after setting new ones: an entity's links of a taxonomy go where new has any of that taxonomy."""
    kept = links.join(new.select("entity_id", "taxonomy").distinct(), ["entity_id", "taxonomy"], "left_anti")
    return kept.unionByName(new.select(*links.columns).distinct())


def paths(terms: DataFrame, separator: str = " > ") -> DataFrame:
    """term_id and path: the names from the root down, by doubling the distance to the ancestor known.

    A term whose parent is missing starts a path; one in a cycle, or below it, has a null path. Each doubling is written
    to the shared folder. While there are terms outside cycles without a path, each gives some of them theirs; so when
    one gives none, the rest are cycles.
    """
    known = terms.select("term_id").withColumnRenamed("term_id", "_id")
    out = terms.select("term_id", "name", "parent").join(known, F.col("parent") == F.col("_id"), "left").select("term_id", F.col("_id").alias("up"), F.col("name").alias("path"))
    open_before = None
    while True:
        out = cut(out, "paths")
        still_open = out.where("up is not null").count()
        if still_open in (0, open_before):
            return out.select("term_id", F.when(F.col("up").isNull(), F.col("path")).alias("path"))
        open_before = still_open
        above = out.select(F.col("term_id").alias("_id"), F.col("up").alias("_up"), F.when(F.col("up").isNull() | (F.col("up") != F.col("term_id")), F.col("path")).alias("_path"))
        out = out.join(above, F.col("up") == F.col("_id"), "left").select("term_id", F.col("_up").alias("up"), F.when(F.col("_id").isNull(), F.col("path")).otherwise(F.concat("_path", F.lit(separator), "path")).alias("path"))


def children(terms: DataFrame) -> DataFrame:
    """parent, and n_children of each term that has any."""
    return terms.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children"))


def term_key(taxonomy: Column, *levels: Column) -> Column:
    """A number for a term by its place: rerunning an import finds the same terms."""
    return F.xxhash64(taxonomy, *[slug(x) for x in levels])


def get_or_create(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """existing terms and those of wanted that aren't there yet (same columns; term_id tells)."""
    new = wanted.dropDuplicates(["term_id"]).join(existing.select("term_id"), "term_id", "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def create_terms(existing: DataFrame, found: DataFrame, taxonomy: str = "location") -> DataFrame:
    """existing terms (term_id, taxonomy, name, slug, parent) and one for each path of found (path, name, parent_path) that isn't there yet.

    A term's path is made of the slugs of its names from the root down; of several terms with one path the smallest term_id stands
    for it. New terms get the next term_ids, those nearer to the root first, then by path, so a parent has a smaller one. What is
    there already is reused with its spelling, so an import that comes again adds nothing.
    """
    own = existing.where(F.col("taxonomy") == taxonomy)
    known = paths(own.withColumn("name", slug(F.col("name"))), "/").where("path is not null").groupBy("path").agg(F.min("term_id").alias("term_id"))
    fresh = found.select("path", "name", "parent_path").dropDuplicates(["path"]).join(known.select("path"), "path", "left_anti")
    last = existing.agg(F.max("term_id")).first()[0] or 0
    fresh = with_keys(fresh.withColumn("depth", F.size(F.split("path", "/"))), ["depth", "path"], "term_id", last)
    above = known.unionByName(fresh.select("path", "term_id")).select(F.col("path").alias("parent_path"), F.col("term_id").alias("parent"))
    fresh = fresh.join(above, "parent_path", "left")
    return existing.unionByName(fresh.select("term_id", F.lit(taxonomy).alias("taxonomy"), "name", slug(F.col("name")).alias("slug"), "parent"))


def at_paths(terms: DataFrame, found: DataFrame, taxonomy: str = "location") -> DataFrame:
    """found (path, ...) with the term_id that stands for each path."""
    own = terms.where(F.col("taxonomy") == taxonomy)
    known = paths(own.withColumn("name", slug(F.col("name"))), "/").where("path is not null")
    return found.join(known.groupBy("path").agg(F.min("term_id").alias("term_id")), "path")
