"""The directory queries on the driver tables, and DuckDB SQL for each.

The driver tables stand in for a directory: suppliers and customers are companies, nations and regions locations,
orders leads, parts job titles, documents news. Every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlake.functions import scalar as S
from dirlake.operators import details, ingest, listing, meta, submit, terms
from dirlake.sources.csv import parse_lines
from dirlake.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def null(kind: str = "string"):
    return F.lit(None).cast(kind)


def nation_terms(spark: SparkSession, d: str) -> DataFrame:
    """Regions, and nations below them, as location terms."""
    regions = table(spark, d, "region").select((F.col("r_regionkey") + 1000).cast("bigint").alias("term_id"), F.col("r_name").alias("name"), null("bigint").alias("parent"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("term_id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 1000).cast("bigint").alias("parent"))
    return regions.unionByName(nations).select("term_id", F.lit("location").alias("taxonomy"), "name", S.slug(F.col("name")).alias("slug"), "parent")


def supplier_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.lit("location").alias("taxonomy"), F.col("s_nationkey").cast("bigint").alias("term_id"))


def numbered_meta(wide: DataFrame, owner: str, keys: list[str]) -> DataFrame:
    rows = meta.unpivot(wide, owner, keys)
    return rows.withColumn("meta_id", F.xxhash64(owner, "key"))


SLUG_SQL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
CENTS = "cast(cast(round({} * 100) as bigint) as varchar)"


def cents(c: str):
    return F.round(F.col(c) * 100).cast("bigint").cast("string")


@query("SELECT s_suppkey, coalesce(s_name, '') || ', ' || coalesce(n_name, '') AS full_address FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def full_address(spark: SparkSession, d: str) -> DataFrame:
    addresses = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("address"))
    return details.full_address(addresses, supplier_links(spark, d), nation_terms(spark, d)).withColumnRenamed("entity_id", "s_suppkey")


@query(f"SELECT s_suppkey, s_name AS name, cast(s_nationkey AS varchar) AS nation, {CENTS.format('s_acctbal')} AS cents FROM supplier")
def eav_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"), cents("s_acctbal").alias("cents"))
    keys = ["name", "nation", "cents"]
    return meta.pivot(numbered_meta(wide, "s_suppkey", keys), keys, "s_suppkey")


@query("SELECT d.doc_id, coalesce(cast(quality AS varchar) = '1', false) AS is_good, coalesce(cast(toxic AS varchar) = '1', false) AS is_toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def bool_flag(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return both.select("doc_id", S.flag(F.col("quality")).alias("is_good"), S.flag(F.col("toxic")).alias("is_toxic"))


@query("SELECT p_partkey, coalesce(try_cast(regexp_extract(' ' || p_size || p_brand, '^[ \\t\\n\\r]*([+-]?[0-9]+)', 1) AS bigint), 0) AS size, coalesce(try_cast(regexp_extract(p_name, '^[ \\t\\n\\r]*([+-]?[0-9]+)', 1) AS bigint), 0) AS none FROM part")
def lenient_int(spark: SparkSession, d: str) -> DataFrame:
    mixed = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", S.lenient_int(mixed).alias("size"), S.lenient_int(F.col("p_name")).alias("none"))


def wanted_nation(c: str = "n_name"):
    kind = F.pmod(F.col("c_custkey"), F.lit(3))
    return F.when(kind == 0, S.slug(F.col(c))).when(kind == 1, F.col(c)).otherwise(F.lit("nowhere"))


WANTED_SQL = "CASE c_custkey % 3 WHEN 0 THEN " + SLUG_SQL.format("n_name") + " WHEN 1 THEN n_name ELSE 'nowhere' END"


@query(f"""WITH w AS (SELECT c_custkey, {WANTED_SQL} AS wanted FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
t AS (SELECT cast(n_nationkey AS bigint) AS term_id, n_name AS name, {SLUG_SQL.format('n_name')} AS slug FROM nation UNION ALL SELECT cast(r_regionkey + 1000 AS bigint), r_name, {SLUG_SQL.format('r_name')} FROM region)
SELECT c_custkey, wanted, coalesce((SELECT min(term_id) FROM t WHERE slug = wanted), (SELECT min(term_id) FROM t WHERE name = wanted)) AS term_id FROM w""")
def fallback_lookup(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = table(spark, d, "customer").join(nations, "c_nationkey", "left").select("c_custkey", wanted_nation().alias("wanted"))
    return terms.by_slug_or_name(rows, "wanted", nation_terms(spark, d), "location", "term_id")


@query("SELECT l_orderkey, cast(pos AS integer) AS pos, p_partkey, p_name FROM (SELECT l_orderkey, l_partkey, min(rn) - 1 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem) GROUP BY 1, 2) JOIN part ON l_partkey = p_partkey")
def ordered_related(spark: SparkSession, d: str) -> DataFrame:
    lines = listing.dealt(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey")
    lists = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    lists = lists.select("l_orderkey", F.col("x.l_partkey").alias("ids"))
    return listing.ordered_lookup(lists, "l_orderkey", "ids", table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")


@query("SELECT 's' || s_suppkey AS place, r_name || ' > ' || n_name || ' > ' || s_name AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || n_nationkey, r_name || ' > ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'r' || r_regionkey, r_name FROM region")
def hierarchy_path(spark: SparkSession, d: str) -> DataFrame:
    place = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    tree = table(spark, d, "region").select(place("r", "r_regionkey").alias("term_id"), F.col("r_name").alias("name"), null().alias("parent"))
    tree = tree.unionByName(table(spark, d, "nation").select(place("n", "n_nationkey").alias("term_id"), F.col("n_name").alias("name"), place("r", "n_regionkey").alias("parent")))
    tree = tree.unionByName(table(spark, d, "supplier").select(place("s", "s_suppkey").alias("term_id"), F.col("s_name").alias("name"), place("n", "s_nationkey").alias("parent")))
    return terms.paths(tree).withColumnRenamed("term_id", "place")


def supplier_lines(spark: SparkSession, d: str) -> DataFrame:
    """CSV lines: region, nation, supplier, and coordinates with a decimal comma, every fourth without."""
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own = table(spark, d, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    number = F.concat(F.lit('"'), F.floor(F.col("s_suppkey") / 7).cast("string"), F.lit(","), F.pmod("s_suppkey", F.lit(7)).cast("string"), F.lit('"'))
    lat = F.when(F.pmod("s_suppkey", F.lit(4)) == 0, F.lit("none")).otherwise(number)
    return own.select(F.col("s_suppkey").alias("line_no"), F.concat("r_name", F.lit(","), "n_name", F.lit(',"'), "s_name", F.lit('",'), lat, F.lit(","), number, F.lit("\r")).alias("line"))


HOME = ("asia", "europe")
LINES_SQL = """WITH f AS (SELECT s_suppkey AS line_no, r_name AS country, n_name AS city, s_name AS district, lower(r_name) IN ('asia', 'europe') AS home,
CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE (s_suppkey // 7) || '.' || (s_suppkey % 7) END AS lat, (s_suppkey // 7) || '.' || (s_suppkey % 7) AS lng,
{r} AS rk, {n} AS nk, {s} AS sk FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""".format(r=SLUG_SQL.format("r_name"), n=SLUG_SQL.format("n_name"), s=SLUG_SQL.format("s_name"))


@query(LINES_SQL + """ SELECT path, any_value(level) AS level, arg_min(name, line_no) AS name, any_value(parent_path) AS parent_path FROM (
SELECT line_no, rk AS path, 'country' AS level, country AS name, '' AS parent_path FROM f UNION ALL SELECT line_no, rk || '/' || nk, 'city', city, rk FROM f
UNION ALL SELECT line_no, rk || '/' || nk || '/' || sk, 'district', district, rk || '/' || nk FROM f WHERE home) GROUP BY path""")
def csv_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return ingest.location_terms(parse_lines(supplier_lines(spark, d)), HOME).select("path", "level", "name", "parent_path")


@query(LINES_SQL + " SELECT rk || '/' || nk AS path, arg_max(lat, line_no) FILTER (WHERE lat IS NOT NULL AND NOT home) AS lat, arg_max(lng, line_no) FILTER (WHERE lat IS NOT NULL AND NOT home) AS lng FROM f GROUP BY 1")
def last_valid(spark: SparkSession, d: str) -> DataFrame:
    return ingest.location_terms(parse_lines(supplier_lines(spark, d)), HOME).where("level = 'city'").select("path", "lat", "lng")


@query(LINES_SQL + " SELECT count(*) AS submitted, count(*) AS accepted FROM f")
def import_report(spark: SparkSession, d: str) -> DataFrame:
    return ingest.import_report(parse_lines(supplier_lines(spark, d)), HOME)


@query("SELECT c_custkey, try_cast(replace((c_custkey // 3) || ',' || (c_custkey % 3), ',', '.') AS double) AS number, c_mktsegment IS NULL AS numeric_segment FROM customer")
def decimal_comma(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.floor(F.col("c_custkey") / 3).cast("string"), F.lit(","), F.pmod("c_custkey", F.lit(3)).cast("string"))
    point = S.decimal_point(raw)
    number = F.when(S.is_numeric(point), point.try_cast("double"))
    return table(spark, d, "customer").select("c_custkey", number.alias("number"), S.is_numeric(F.col("c_mktsegment")).alias("numeric_segment"))


@query("SELECT cast(floor((rn - 1) / 50) AS bigint) AS batch, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM events) GROUP BY 1")
def batch50(spark: SparkSession, d: str) -> DataFrame:
    return listing.batches(table(spark, d, "events").select("event_id"), "event_id").groupBy("batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def recent50(spark: SparkSession, d: str) -> DataFrame:
    return listing.recent(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), "o_orderdate", "o_orderkey")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    newest = orders.agg(F.max("o_orderdate")).first()[0]
    return listing.page(orders, "o_orderdate", "o_orderkey", 20, (F.lit(newest), F.lit(-1)))


@query("SELECT c_custkey, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, c_name) AS name, coalesce(CASE WHEN s_suppkey IS NOT NULL THEN CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END END, 7) AS verified FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def sparse_upsert(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.lit(7).alias("verified"))
    patch = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"), F.when(F.col("s_acctbal") > 0, 1).alias("verified"))
    patch = patch.join(base.select("c_custkey"), "c_custkey", "left_semi")
    return meta.upsert(base, patch, "c_custkey", sparse=["name"], flags=["verified"])


@query("SELECT c_custkey, CASE WHEN s_suppkey IS NULL THEN c_mktsegment WHEN s_suppkey % 2 = 0 THEN s_name END AS hours FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def replace_or_delete(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("hours"))
    patch = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("hours"))
    return meta.upsert(base, patch.join(base.select("c_custkey"), "c_custkey", "left_semi"), "c_custkey", lists=["hours"])


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def unique_check(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(known, "c_custkey", "left_anti")


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS first_name, CASE WHEN len(string_split(p_name, ' ')) > 1 THEN string_split(p_name, ' ')[-1] ELSE '' END AS last_name FROM part")
def name_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.first_word(F.col("p_name")).alias("first_name"), S.last_word(F.col("p_name")).alias("last_name"))


@query("SELECT doc_id, cast(place AS integer) AS place, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents) WHERE length(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) > 0")
def line_list(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return lines.where(F.length(S.unicode_trim("line")) > 0)


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[\\r\\n\\t ]+', ' ', 'g')) AS text FROM pages")
def sanitize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", S.text_field(F.col("html")).alias("text"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[\\r\\t ]+', ' ', 'g'), chr(32) || chr(10)) AS text FROM pages")
def sanitize_area(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", S.text_area(F.col("html")).alias("text"))


@query("SELECT page_id, CASE WHEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('', 'http', 'https', 'ftp', 'mailto') THEN url ELSE '' END AS url, '' AS script FROM pages")
def clean_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", S.url(F.col("url")).alias("url"), S.url(F.concat(F.lit("javascript:"), "url")).alias("script"))


@query("SELECT c_custkey, replace(c_name, '#', '#') || '@example.com' AS email, '' AS bad FROM customer")
def clean_email(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", S.email(F.concat(F.lit(" "), "c_name", F.lit("@example.com "))).alias("email"), S.email(F.col("c_name")).alias("bad"))


@query("SELECT s_suppkey, to_base64(encode(s_suppkey || '|' || s_name)) AS token FROM supplier")
def token_b64(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", S.token(F.col("s_suppkey").cast("string"), F.col("s_name")).alias("token"))


@query(f"""WITH w AS (SELECT c_custkey, {WANTED_SQL} AS city, r_name AS district FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT cast(n_nationkey AS bigint) AS term_id, n_name AS name, {SLUG_SQL.format('n_name')} AS slug FROM nation UNION ALL SELECT cast(r_regionkey + 1000 AS bigint), r_name, {SLUG_SQL.format('r_name')} FROM region),
c AS (SELECT *, coalesce((SELECT min(term_id) FROM t WHERE slug = city), (SELECT min(term_id) FROM t WHERE name = city)) AS city_id, coalesce((SELECT min(term_id) FROM t WHERE slug = district), (SELECT min(term_id) FROM t WHERE name = district)) AS any_id FROM w)
SELECT c_custkey, city, district, city_id, CASE WHEN city_id IS NOT NULL THEN any_id END AS district_id FROM c""")
def chained_lookup(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    rows = table(spark, d, "customer").join(places, "c_nationkey", "left").select("c_custkey", wanted_nation().alias("city"), F.col("r_name").alias("district"))
    return terms.city_and_district(rows, nation_terms(spark, d))


@query("SELECT s_suppkey AS entity_id, 'location' AS taxonomy, cast(CASE WHEN s_acctbal < 0 THEN (s_nationkey + 1) % 25 ELSE s_nationkey END AS bigint) AS term_id FROM supplier UNION ALL SELECT s_suppkey, 'sector', s_suppkey % 5 FROM supplier")
def link_replace(spark: SparkSession, d: str) -> DataFrame:
    suppliers = table(spark, d, "supplier")
    sectors = suppliers.select(F.col("s_suppkey").alias("entity_id"), F.lit("sector").alias("taxonomy"), (F.col("s_suppkey") % 5).alias("term_id"))
    new = suppliers.where("s_acctbal < 0").select(F.col("s_suppkey").alias("entity_id"), F.lit("location").alias("taxonomy"), ((F.col("s_nationkey") + 1) % 25).cast("bigint").alias("term_id"))
    return terms.replace_links(supplier_links(spark, d).unionByName(sectors), new)


@query("SELECT l_orderkey, cast(count(*) FILTER (WHERE cast(cast(l_discount * 100 AS integer) AS varchar) NOT IN ('', '0')) AS integer) AS n_items FROM lineitem GROUP BY 1")
def item_filter(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("time"), F.round(F.col("l_discount") * 100).cast("int").cast("string").alias("title"))).alias("schedule"))
    return items.select("l_orderkey", F.size(S.cleaned(S.titled(F.col("schedule"), "title"), ["time", "title"])).alias("n_items"))


@query("SELECT p_partkey, CASE WHEN regexp_full_match('#' || printf('%03d', p_size), '#([A-Fa-f0-9]{3}){1,2}') THEN '#' || printf('%03d', p_size) END AS color, CASE WHEN regexp_full_match(p_brand, '#([A-Fa-f0-9]{3}){1,2}') THEN p_brand END AS brand FROM part")
def hex_color(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.hex_color(F.format_string("#%03d", "p_size")).alias("color"), S.hex_color(F.col("p_brand")).alias("brand"))


@query(f"SELECT n_nationkey, {SLUG_SQL.format('n_name')} AS slug, lower(n_name) AS lowered FROM nation")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", S.slug(F.col("n_name")).alias("slug"), S.ascii_lower(F.col("n_name")).alias("lowered"))


@query("SELECT n_name AS name, count(*) AS n_entities, min(s_suppkey) AS first_id FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def term_connection(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    pairs = listing.connection(entities, supplier_links(spark, d), nation_terms(spark, d), "location")
    return pairs.groupBy("name").agg(F.count("*").alias("n_entities"), F.min("entity_id").alias("first_id"))


@query("SELECT cast(n_regionkey + 1000 AS bigint) AS parent, count(*) AS n_children FROM nation GROUP BY 1")
def term_children(spark: SparkSession, d: str) -> DataFrame:
    return terms.children(nation_terms(spark, d))


@query("SELECT s_suppkey AS id, s_name AS \"companyType\", s_acctbal > 0 AS \"isVerified\", " + CENTS.format("s_acctbal") + " AS \"mapLat\", '' AS phone, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS linkedin, cast(CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS integer) AS n_hours FROM supplier")
def company_details(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "supplier")
    even, third = F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 3 == 0
    hours = F.to_json(F.array(F.struct(F.lit("Mon").alias("days"), F.lit("9-17").alias("time"))))
    wide = own.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("company_type"), F.when(F.col("s_acctbal") > 0, F.lit("1")).otherwise(F.lit("0")).alias("is_verified"), cents("s_acctbal").alias("map_lat"), F.when(even, F.col("s_name")).alias("linkedin_url"), F.when(third, hours).alias("working_hours"))
    rows = numbered_meta(wide, "entity_id", [c for c in wide.columns if c != "entity_id"])
    found = details.company_details(own.select(F.col("s_suppkey").alias("id"), F.lit("company").alias("post_type")), rows)
    return found.select("id", "companyType", "isVerified", "mapLat", "phone", F.col("social.linkedin").alias("linkedin"), F.size("workingHours").alias("n_hours"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS \"leadType\", o_orderstatus = 'F' AS \"isPremium\", cast(floor(o_totalprice) AS integer) AS \"viewCount\", 0 AS \"offerCount\", o_orderkey % 2 = 0 AS \"isHiddenName\", cast(o_custkey AS varchar) AS \"budgetString\", '' AS \"expiryDate\", 'x' || o_custkey AS \"deliveryLocation\", '' AS attachment FROM orders")
def lead_details(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders")
    wide = own.select(F.col("o_orderkey").alias("entity_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("lead_type"), F.when(F.col("o_orderstatus") == "F", F.lit("1")).alias("is_premium"), F.concat(F.floor("o_totalprice").cast("string"), F.lit(" views")).alias("view_count"), F.when(F.col("o_orderkey") % 2 == 0, "1").otherwise("yes").alias("is_hidden_name"), F.col("o_custkey").cast("string").alias("budget_string"), F.concat(F.lit("x"), F.col("o_custkey").cast("string")).alias("delivery_location"))
    rows = numbered_meta(wide, "entity_id", [c for c in wide.columns if c != "entity_id"])
    found = details.lead_details(own.select(F.col("o_orderkey").alias("id"), F.lit("lead").alias("post_type")), rows)
    return found


@query("SELECT p_partkey AS id, p_name AS \"companyName\", p_type AS \"workType\", p_size = 1 AS \"isFeatured\", '' AS salary, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS location, cast(p_size AS varchar) AS experience, '' AS education, '' AS deadline FROM part")
def job_details(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "part")
    wide = own.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("company_name"), F.col("p_type").alias("work_type"), F.col("p_size").cast("string").alias("is_featured"), F.col("p_size").cast("string").alias("experience"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("location"))
    rows = numbered_meta(wide, "entity_id", [c for c in wide.columns if c != "entity_id"])
    found = details.job_details(own.select(F.col("p_partkey").alias("id"), F.lit("career").alias("post_type")), rows)
    return found


@query("SELECT event_id AS id, event_type AS \"eventType\", cast(ts AS varchar) AS \"startDate\", value > 50 AS \"isOfficial\", cast(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS integer) AS n_speakers, CASE WHEN event_id % 2 = 0 THEN event_type END AS speaker, 0 AS n_schedule, '' AS \"endDate\", '' AS \"locationType\", event_type AS venue, cast(event_id AS varchar) AS address, '' AS organizer, 'free' AS price, '' AS \"registrationLink\" FROM events")
def event_details(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events")
    speakers = F.to_json(F.array(F.struct(F.col("event_type").alias("name"))))
    wide = own.select(F.col("event_id").alias("entity_id"), "event_type", F.col("ts").cast("string").alias("start_date"), F.when(F.col("value") > 50, F.lit("1")).alias("is_official"), F.when(F.col("event_id") % 2 == 0, speakers).alias("speakers"), F.col("event_type").alias("venue"), F.col("event_id").cast("string").alias("address"), F.lit("free").alias("price"))
    rows = numbered_meta(wide, "entity_id", [c for c in wide.columns if c != "entity_id"])
    found = details.event_details(own.select(F.col("event_id").alias("id"), F.lit("event").alias("post_type")), rows)
    return found.select("*", F.size("speakers").alias("n_speakers"), F.get("speakers.name", F.lit(0)).alias("speaker"), F.size("schedule").alias("n_schedule")).drop("speakers", "schedule")


@query("SELECT cast(n_nationkey AS bigint) AS term_id, 'city' AS type, cast(n_nationkey AS varchar) AS lat, '' AS lng FROM nation UNION ALL SELECT cast(r_regionkey + 1000 AS bigint), '', '', '' FROM region")
def location_details(spark: SparkSession, d: str) -> DataFrame:
    own = nation_terms(spark, d)
    wide = own.where("parent is not null").select("term_id", F.lit("city").alias("location_type"), F.col("term_id").cast("string").alias("map_lat"))
    return details.location_details(own, numbered_meta(wide, "term_id", ["location_type", "map_lat"]))


@query("SELECT cast(r_regionkey AS bigint) AS term_id, r_name AS icon, '' AS \"iconName\", '' AS \"featuredImage\", '#ea580c' AS color FROM region")
def sector_details(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("term_id"), F.lit("sector").alias("taxonomy"), F.col("r_name").alias("sector_icon"), F.lit("#ea580c").alias("sector_color"))
    return details.sector_details(own.select("term_id", "taxonomy"), numbered_meta(own, "term_id", ["sector_icon", "sector_color"]))


@query("SELECT o_custkey AS id, cast(rn - 1 AS integer) AS pos, p_partkey AS news_id, p_name AS title FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) JOIN part ON o_orderkey = p_partkey")
def related_news(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("ids"))
    wide = lists.select(F.col("o_custkey").alias("entity_id"), F.to_json(F.transform("ids", lambda x: x.cast("string"))).alias("related_news_ids"))
    companies = lists.select(F.col("o_custkey").alias("id"), F.lit("company").alias("post_type"), F.lit("publish").alias("status"), null().alias("title"))
    news = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("post").alias("post_type"), F.lit("publish").alias("status"), F.col("p_name").alias("title"))
    return details.related_news(companies.unionByName(news), numbered_meta(wide, "entity_id", ["related_news_ids"]))


def submissions(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    own = table(spark, d, "customer").join(nations, "c_nationkey", "left")
    return own.select(F.col("c_custkey").alias("id"), F.concat(F.lit("<b>"), "c_name", F.lit("</b> ")).alias("title"), null().alias("officialName"), null().alias("sector"), F.col("c_mktsegment").alias("companyType"), null().alias("description"), F.concat("c_custkey", F.lit("@example.com")).alias("email"), null().alias("phone"), null().alias("website"), wanted_nation().alias("city"), null().alias("district"), null().alias("postalCode"), null().alias("address"))


@query("SELECT c_custkey AS id, 'company' AS post_type, c_name AS title, '' AS content, 'pending' AS status FROM customer")
def submit_entities(spark: SparkSession, d: str) -> DataFrame:
    return submit.submit_companies(submissions(spark, d), nation_terms(spark, d))[0]


@query("SELECT c_custkey AS entity_id, 'company_type' AS key, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'email', c_custkey || '@example.com' FROM customer")
def submit_meta(spark: SparkSession, d: str) -> DataFrame:
    return submit.submit_companies(submissions(spark, d), nation_terms(spark, d))[1]


@query("SELECT c_custkey AS entity_id, 'location' AS taxonomy, cast(n_nationkey AS bigint) AS term_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 < 2")
def submit_links(spark: SparkSession, d: str) -> DataFrame:
    return submit.submit_companies(submissions(spark, d), nation_terms(spark, d))[2]


def registrations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_nationkey", F.lit("."), (F.col("c_custkey") % 1000).cast("string"), F.lit("@example.com")).alias("email"), F.concat(F.lit("Ada "), "c_mktsegment").alias("firstName"), null().alias("lastName"), null().alias("phone"), F.when(F.col("c_acctbal") > 0, F.lit("kurumsal")).otherwise(F.lit("bireysel")).alias("accountType"), F.col("c_name").alias("companyName"), null().alias("taxOffice"), null().alias("taxNumber"), null().alias("sector"))
    known = table(spark, d, "supplier").select(F.concat("s_nationkey", F.lit("."), (F.col("s_suppkey") % 1000).cast("string"), F.lit("@example.com")).alias("email"))
    return own, known


USERS_SQL = """WITH r AS (SELECT *, c_nationkey || '.' || (c_custkey % 1000) || '@example.com' AS email FROM customer), k AS (SELECT s_nationkey || '.' || (s_suppkey % 1000) || '@example.com' AS email FROM supplier),
u AS (SELECT r.* FROM r JOIN (SELECT email, min(c_custkey) AS c_custkey FROM r GROUP BY 1) f ON r.email = f.email AND r.c_custkey = f.c_custkey WHERE r.email NOT IN (SELECT email FROM k))"""


@query(USERS_SQL + " SELECT c_custkey AS id, email AS login, email, 'Ada' AS first_name, string_split('Ada ' || c_mktsegment, ' ')[-1] AS last_name, 'Ada ' || c_mktsegment AS display_name FROM u")
def register_users(spark: SparkSession, d: str) -> DataFrame:
    return submit.register_users(*registrations(spark, d))[0]


@query(USERS_SQL + " SELECT c_custkey AS user_id, 'account_type' AS key, CASE WHEN c_acctbal > 0 THEN 'kurumsal' ELSE 'bireysel' END AS value FROM u UNION ALL SELECT c_custkey, 'company_name', c_name FROM u WHERE c_acctbal > 0")
def register_meta(spark: SparkSession, d: str) -> DataFrame:
    return submit.register_users(*registrations(spark, d))[1]


@query(USERS_SQL + " SELECT c_custkey AS id, email FROM r WHERE c_custkey NOT IN (SELECT c_custkey FROM u)")
def register_rejected(spark: SparkSession, d: str) -> DataFrame:
    return submit.register_users(*registrations(spark, d))[2].select("id", "email")


@query("SELECT o_orderkey AS id, 'lead' AS post_type FROM orders WHERE o_orderstatus = 'O'")
def entity_scan(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", F.lit("lead")).otherwise(F.lit("company")).alias("post_type"))
    return entities.where("post_type = 'lead'")


@query("SELECT term_id, taxonomy, name FROM (SELECT cast(n_nationkey AS bigint) AS term_id, 'location' AS taxonomy, n_name AS name FROM nation UNION ALL SELECT cast(r_regionkey + 1000 AS bigint), 'location', r_name FROM region UNION ALL SELECT 2000, 'location', 'ATLANTIS')")
def get_or_create(spark: SparkSession, d: str) -> DataFrame:
    known = nation_terms(spark, d).where("parent is null").select("term_id", "taxonomy", "name")
    new = spark.createDataFrame([(2000, "location", "ATLANTIS"), (2000, "location", "Atlantis!")], known.schema).where("name = upper(name)")
    return terms.get_or_create(known, nation_terms(spark, d).select("term_id", "taxonomy", "name").unionByName(new))


@query("SELECT l_orderkey, max(CASE WHEN l_partkey = l_orderkey % 50 + 1 THEN 1 ELSE 0 END) = 1 AS listed FROM lineitem GROUP BY 1")
def in_list(spark: SparkSession, d: str) -> DataFrame:
    lines = listing.dealt(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey")
    lists = lines.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("ids"))
    return lists.select("l_orderkey", S.listed(F.col("ids"), F.col("l_orderkey") % 50 + 1).alias("listed"))


@query("SELECT s_suppkey AS id, s_name AS title, 'id' AS found_by FROM supplier WHERE s_suppkey = 7 UNION ALL SELECT s_suppkey, s_name, 'slug' FROM supplier WHERE " + SLUG_SQL.format("s_name") + " = 'supplier-000000003'")
def single_node(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), S.slug(F.col("s_name")).alias("slug"))
    by_id, by_slug = listing.node(own, "id", F.lit(7)), listing.node(own, "slug", F.lit("supplier-000000003"))
    return by_id.withColumn("found_by", F.lit("id")).unionByName(by_slug.withColumn("found_by", F.lit("slug"))).drop("slug")


@query("SELECT s_suppkey AS line_no, CASE s_suppkey % 5 WHEN 0 THEN 'country' ELSE 'header' END AS error FROM supplier WHERE s_suppkey % 5 < 2")
def csv_rejected(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("s_suppkey") % 5 == 0, F.lit(" ")).when(F.col("s_suppkey") % 5 == 1, F.lit("Ülke")).otherwise(F.col("s_name"))
    lines = table(spark, d, "supplier").select(F.col("s_suppkey").alias("line_no"), F.concat(name, F.lit(",city,,1,2")).alias("line"))
    return ingest.rejected_rows(parse_lines(lines))


@query("SELECT true AS success, 'Firma başvurunuz alındı. Teşekkürler!' AS message, c_custkey AS \"postId\" FROM customer")
def submit_payloads(spark: SparkSession, d: str) -> DataFrame:
    return submit.payloads(submit.submit_companies(submissions(spark, d), nation_terms(spark, d))[0])


@query("SELECT o_orderkey AS id, o_orderdate AS date FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def recent_news(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") == "F", "publish").otherwise("draft").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, "post").otherwise("lead").alias("post_type"))
    return listing.recent(own.where("post_type = 'post' and status = 'publish'"), "date", "id").select("id", "date")


@query(LINES_SQL + """ SELECT path, any_value(level) AS level, arg_min(name, line_no) AS name, arg_max(lat, line_no) FILTER (WHERE lat IS NOT NULL) AS lat, arg_max(lng, line_no) FILTER (WHERE lat IS NOT NULL) AS lng FROM (
SELECT line_no, rk AS path, 'country' AS level, country AS name, NULL AS lat, NULL AS lng FROM f UNION ALL SELECT line_no, rk || '/' || nk, 'city', city, CASE WHEN NOT home THEN lat END, lng FROM f
UNION ALL SELECT line_no, rk || '/' || nk || '/' || sk, 'district', district, NULL, NULL FROM f WHERE home) GROUP BY path""")
def location_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two halves of the lines, one merged into the other."""
    lines = supplier_lines(spark, d)
    first, second = (ingest.location_terms(parse_lines(lines.where(x)), HOME) for x in (F.col("line_no") < 50, F.col("line_no") >= 50))
    return ingest.merge_locations(first, second).select("path", "level", "name", "lat", "lng")


@query("SELECT coalesce(c_custkey, s_suppkey) AS entity_id, 'phone' AS key, coalesce(s_name, c_name) AS value FROM customer FULL JOIN (SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0) ON c_custkey = s_suppkey")
def attribute_merge(spark: SparkSession, d: str) -> DataFrame:
    old = numbered_meta(table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("phone")), "entity_id", ["phone"])
    patch = meta.unpivot(table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("phone")), "entity_id", ["phone"])
    return meta.upsert_rows(old, patch).select("entity_id", "key", "value")
