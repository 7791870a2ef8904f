"""Queries over what the directory writes: merged attributes, keys, trees, imports, pages, replies; and rules on data with all their branches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlake.functions import scalar as S
from dirlake.operators import details, ingest, listing, meta, submit, terms, trees
from dirlake.operators.keys import with_keys
from dirlake.sources.attributes import Attributes
from dirlake.sources.buckets import Buckets
from dirlake.sources.csv import checked_lines
from dirlake.sources.nodes import Pages, write_nodes
from dirlake.sources.shared import shared_path
from dirlake.sources.tables import table
from dirlake.streaming.locations import LOCATION

from .catalog import HOME, LINES_SQL, SLUG_SQL, nation_terms, null, numbered_meta, query, registrations, supplier_lines

MERGED_SQL = """WITH old AS (SELECT c_custkey AS meta_id, c_custkey AS entity_id, 'phone' AS key, c_name AS value FROM customer),
patch AS (SELECT s_suppkey AS entity_id, 'phone' AS key, s_name AS value FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'email', 's' || s_suppkey FROM supplier),
kept AS (SELECT meta_id, entity_id, key, coalesce(p.value, o.value) AS value FROM old o LEFT JOIN patch p USING (entity_id, key)),
added AS (SELECT (SELECT max(meta_id) FROM old) + row_number() OVER (ORDER BY entity_id, key) AS meta_id, entity_id, key, value FROM patch ANTI JOIN old USING (entity_id, key)),
merged AS (SELECT * FROM kept UNION ALL SELECT * FROM added)"""


def merged_store(spark: SparkSession, d: str) -> Attributes:
    """Customers' phones in buckets, with the suppliers' patch of phones and e-mails merged in."""
    store = Attributes(shared_path(spark, "attributes"), count=8)
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("meta_id"), F.col("c_custkey").alias("entity_id"), F.lit("phone").alias("key"), F.col("c_name").alias("value"))
    store.create(own)
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("phone"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("email"))
    store.merge(meta.unpivot(suppliers, "entity_id", ["phone", "email"]))
    return store


@query(MERGED_SQL + " SELECT * FROM merged")
def bucket_merge(spark: SparkSession, d: str) -> DataFrame:
    return merged_store(spark, d).read(spark)


@query(MERGED_SQL + " SELECT entity_id, max(value) FILTER (WHERE key = 'phone') AS phone, max(value) FILTER (WHERE key = 'email') AS email FROM merged GROUP BY 1")
def bucket_read(spark: SparkSession, d: str) -> DataFrame:
    return meta.pivot(merged_store(spark, d).read(spark), ["phone", "email"])


@query("SELECT event_id, 100 + row_number() OVER (ORDER BY ts, event_id) AS id FROM events")
def new_keys(spark: SparkSession, d: str) -> DataFrame:
    return with_keys(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], "id", 100).select("event_id", "id")


TREE_SQL = """WITH RECURSIVE t AS (SELECT 'r' || r_regionkey AS term_id, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
u AS (SELECT term_id, term_id AS top FROM t UNION ALL SELECT t.term_id, u.top FROM u JOIN t ON t.parent = u.term_id)"""


def place_tree(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and suppliers as one tree of terms."""
    place = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    tree = table(spark, d, "region").select(place("r", "r_regionkey").alias("term_id"), F.col("r_name").alias("name"), null().alias("parent"))
    tree = tree.unionByName(table(spark, d, "nation").select(place("n", "n_nationkey").alias("term_id"), F.col("n_name").alias("name"), place("r", "n_regionkey").alias("parent")))
    return tree.unionByName(table(spark, d, "supplier").select(place("s", "s_suppkey").alias("term_id"), F.col("s_name").alias("name"), place("n", "s_nationkey").alias("parent")))


@query(TREE_SQL + " SELECT top AS term_id, count(DISTINCT u.term_id) - 1 AS n_terms, count(l_suppkey) AS n_links FROM u LEFT JOIN lineitem ON u.term_id = 's' || l_suppkey GROUP BY top")
def subtree_counts(spark: SparkSession, d: str) -> DataFrame:
    """Terms below each region, nation and supplier, and line items linked in its subtree."""
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("term_id"))
    return trees.subtree_counts(trees.intervals(place_tree(spark, d)), links)


@query("SELECT DISTINCT l_orderkey AS entity_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
def entities_below(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a supplier anywhere below the region EUROPE."""
    tree = place_tree(spark, d)
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("term_id"))
    top = tree.where("name = 'EUROPE'").first().term_id
    return trees.entities_below(trees.intervals(tree), links, top)


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY up ORDER BY name, term_id) AS k FROM (SELECT n_nationkey AS term_id, n_name AS name, n_regionkey AS up FROM nation)),
r AS (SELECT r_regionkey, r_name, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2), p AS (SELECT *, 1 + coalesce(sum(n + 1) OVER (ORDER BY r_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM r)
SELECT cast(r_regionkey + 1000 AS bigint) AS term_id, cast(low AS bigint) AS low, cast(low + n AS bigint) AS high, 0::BIGINT AS depth FROM p UNION ALL SELECT cast(term_id AS bigint), cast(p.low + k AS bigint), cast(p.low + k AS bigint), 1 FROM o JOIN p ON up = r_regionkey""")
def tree_intervals(spark: SparkSession, d: str) -> DataFrame:
    return trees.intervals(nation_terms(spark, d)).select("term_id", "low", "high", "depth")


def awkward_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of customers: every seventh with an open quote, of the others some too long, without a country, or a header."""
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, F.lit(" ")).when(k % 5 == 1, F.lit("Country")).otherwise(F.col("c_mktsegment"))
    place = F.when(k % 7 == 0, F.concat(F.lit('"'), "c_name")).otherwise(F.concat(F.lit('"'), "c_name", F.lit(', x"')))
    return table(spark, d, "customer").select(k.alias("line_no"), F.concat(name, F.lit(","), place, F.lit(",,1,2"), F.when(k % 3 == 0, ",more").otherwise("")).alias("line"))


CUSTOMER_ERROR = "CASE WHEN c_custkey % 5 = 0 THEN 'country' WHEN c_custkey % 5 = 1 THEN 'header' WHEN c_custkey % 7 = 0 THEN 'quotes' WHEN c_custkey % 3 = 0 THEN 'long' END"


@query(f"SELECT c_custkey AS line_no, CASE WHEN c_custkey % 5 = 0 THEN ' ' WHEN c_custkey % 5 = 1 THEN 'Country' ELSE c_mktsegment END || ',\"' || c_name || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE ', x\"' END || ',,1,2' || CASE WHEN c_custkey % 3 = 0 THEN ',more' ELSE '' END AS line, {CUSTOMER_ERROR} AS error, c_custkey % 5 > 1 AS accepted FROM customer WHERE {CUSTOMER_ERROR} IS NOT NULL")
def csv_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return ingest.quarantine(ingest.judged(checked_lines(awkward_lines(spark, d))))


@query(f"SELECT count(*) AS submitted, count(*) FILTER (WHERE {CUSTOMER_ERROR} IS NULL) AS accepted, count(*) FILTER (WHERE {CUSTOMER_ERROR} IS NOT NULL) AS rejected, count(DISTINCT c_mktsegment) FILTER (WHERE {CUSTOMER_ERROR} IS NULL) AS countries FROM customer")
def import_counts(spark: SparkSession, d: str) -> DataFrame:
    """What the pass that writes locations counts on the way, and the countries it wrote."""
    rows, counts = ingest.counted(ingest.judged(checked_lines(awkward_lines(spark, d)), strict=True))
    store = Buckets(shared_path(spark, "counted"), LOCATION, ("path",), 4)
    store.create(ingest.location_terms(rows.where("accepted")))
    return store.read(spark).where("level = 'country'").agg(*[F.lit(counts.get[c]).cast("bigint").alias(c) for c in ("submitted", "accepted", "rejected")], F.count("*").alias("countries"))


@query(LINES_SQL + """ SELECT path, any_value(level) AS level, arg_min(name, line_no) AS name, any_value(parent_path) AS parent_path, arg_max(lat, line_no) FILTER (WHERE lat IS NOT NULL) AS lat, arg_max(lng, line_no) FILTER (WHERE lat IS NOT NULL) AS lng FROM (
SELECT line_no, rk AS path, 'country' AS level, country AS name, '' AS parent_path, NULL AS lat, NULL AS lng FROM f UNION ALL SELECT line_no, rk || '/' || nk, 'city', city, rk, CASE WHEN NOT home THEN lat END, lng FROM f
UNION ALL SELECT line_no, rk || '/' || nk || '/' || sk, 'district', district, rk || '/' || nk, NULL, NULL FROM f WHERE home) GROUP BY path""")
def bucketed_import(spark: SparkSession, d: str) -> DataFrame:
    """The lines in three batches, each merged into the buckets of its locations."""
    rows = ingest.judged(checked_lines(supplier_lines(spark, d)))
    last = rows.agg(F.max("line_no")).first()[0] or 0
    store = Buckets(shared_path(spark, "imported"), LOCATION, ("path",), 8)
    for k in range(3):
        batch = ingest.location_terms(rows.where(F.col("line_no").between(k * last // 3 + bool(k), (k + 1) * last // 3)), HOME)
        store.merge(batch, ingest.merge_locations) if k else store.create(batch)
    return store.read(spark)


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderdate AS date, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS n, count(*) OVER () AS total FROM orders)
SELECT 'first' AS side, id, date, true AS has_more FROM o WHERE n BETWEEN 31 AND 50 UNION ALL SELECT 'last', id, date, true FROM o WHERE n BETWEEN total - 44 AND total - 30""")
def pages_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """Twenty orders after the thirtieth, and fifteen before the last thirty, by cursors."""
    pages = Pages(shared_path(spark, "pages"))
    pages.create(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("date")), 8)
    after = pages.page(spark, first=30).orderBy("date", "id").first().cursor
    before = pages.page(spark, last=30).first().cursor
    found = [pages.page(spark, first=20, after=after).withColumn("side", F.lit("first")), pages.page(spark, last=15, before=before).withColumn("side", F.lit("last"))]
    return meta.union(found).select("side", "id", "date", "has_more")


@query("SELECT c_custkey AS id, " + SLUG_SQL.format("c_name") + " AS slug, 'id' AS found_by FROM customer WHERE c_custkey = 11 UNION ALL SELECT c_custkey, " + SLUG_SQL.format("c_name") + ", 'slug' FROM customer WHERE " + SLUG_SQL.format("c_name") + " = 'customer-000000013'")
def bucketed_node(spark: SparkSession, d: str) -> DataFrame:
    name = f"nodes_{uuid.uuid4().hex}"
    write_nodes(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), S.slug(F.col("c_name")).alias("slug")), name, 8, shared_path(spark, name))
    nodes = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, and nodes knows the buckets
    by_id, by_slug = listing.node(nodes, "id", F.lit(11).cast("bigint")), listing.node(nodes, "slug", F.lit("customer-000000013"))
    return by_id.withColumn("found_by", F.lit("id")).unionByName(by_slug.withColumn("found_by", F.lit("slug")))


def whole_companies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as companies with every attribute, and parts as news; some attributes are missing or bad for some."""
    k = F.col("s_suppkey")
    own = table(spark, d, "supplier")
    plain = {c: F.concat(F.lit(f"{c} "), k.cast("string")) for c in details.COMPANY["text"]}
    links = {c: F.when(k % (n + 2) == 0, F.concat(F.lit(f"{c}/"), k.cast("string"))) for n, c in enumerate(details.COMPANY["record"]["social"].values())}
    hours = F.to_json(F.transform(F.sequence(F.lit(1), k % 3 + 1), lambda i: F.struct(F.concat(F.lit("day"), i.cast("string")).alias("days"), F.lit("9").alias("time"))))
    services = F.when(k % 4 == 0, F.lit("[broken")).otherwise(F.to_json(F.array(F.struct(F.lit("i").alias("icon"), F.col("s_name").alias("title"), F.lit("d").alias("desc")))))
    news = F.when(k % 5 > 0, F.to_json(F.array(F.lit("3"), (k % 7 + 1).cast("string"), F.lit("-7"), F.lit("3"))))
    wide = own.select(k.alias("entity_id"), *[c.alias(n) for n, c in (plain | links).items()], (k % 2).cast("string").alias("is_verified"), F.when(k % 6 > 0, hours).alias("working_hours"), services.alias("company_services"), news.alias("related_news_ids"))
    entities = own.select(k.alias("id"), F.lit("company").alias("post_type"), F.lit("publish").alias("status"), F.col("s_name").alias("title"))
    part = F.col("p_partkey")
    first = table(spark, d, "part").select(part.alias("id"), F.lit("post").alias("post_type"), F.when(part == 4, "draft").otherwise("publish").alias("status"), F.col("p_name").alias("title"))
    return entities.unionByName(first), numbered_meta(wide, "entity_id", [c for c in wide.columns if c != "entity_id"])


TEXT_SQL = ", ".join(f"'{c} ' || s_suppkey AS \"{details.camel(c)}\"" for c in details.COMPANY["text"])
SOCIAL_SQL = ", ".join(f"CASE WHEN s_suppkey % {n + 2} = 0 THEN '{c}/' || s_suppkey ELSE '' END AS {x}" for n, (x, c) in enumerate(details.COMPANY["record"]["social"].items()))


@query(f"""SELECT s_suppkey AS id, {TEXT_SQL}, s_suppkey % 2 = 1 AS "isVerified", CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE array_to_string(list_transform(range(1, s_suppkey % 3 + 2), lambda i: 'day' || i || '=9'), ',') END AS hours,
CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'i/' || s_name || '/d' END AS services, {SOCIAL_SQL},
CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE '3:' || (SELECT p_name FROM part WHERE p_partkey = 3) || CASE s_suppkey % 7 + 1 WHEN 3 THEN '' WHEN 4 THEN '' ELSE ',' || (s_suppkey % 7 + 1) || ':' || (SELECT p_name FROM part WHERE p_partkey = s_suppkey % 7 + 1) END END AS news FROM supplier""")
def company_frame(spark: SparkSession, d: str) -> DataFrame:
    """All 21 fields of each company from one frame, lists as texts."""
    found = details.company_details(*whole_companies(spark, d), news=True)
    text = lambda c, f: F.array_join(F.transform(c, f), ",")
    hours = text("workingHours", lambda x: F.concat(x["days"], F.lit("="), x["time"]))
    services = text("services", lambda x: F.concat_ws("/", x["icon"], x["title"], x["desc"]))
    news = text("relatedNews", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["title"]))
    return found.select("id", *[details.camel(c) for c in details.COMPANY["text"]], "isVerified", hours.alias("hours"), services.alias("services"), "social.*", news.alias("news"))


@query("SELECT s_suppkey AS id, 'email ' || s_suppkey AS email, CASE WHEN s_suppkey % 4 = 0 THEN 'twitter_url/' || s_suppkey ELSE '' END AS twitter, CASE WHEN s_suppkey % 6 = 0 THEN 0 ELSE cast(s_suppkey % 3 + 1 AS integer) END AS n_hours FROM supplier")
def selected_fields(spark: SparkSession, d: str) -> DataFrame:
    """A request for three fields, two of them in part."""
    found = details.company_details(*whole_companies(spark, d), fields=["email", "social.twitter", "workingHours.days"])
    return found.select("id", "email", "social.twitter", F.size("workingHours.days").alias("n_hours"))


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type || '/' || user_id END AS speakers, CASE WHEN event_id % 2 = 0 THEN cast(ts AS varchar) || ' ' || event_type ELSE '' END AS schedule FROM events")
def event_lists(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events")
    speakers = F.to_json(F.array(F.struct(F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("title"))))
    schedule = F.to_json(F.array(F.struct(F.col("ts").cast("string").alias("time"), F.col("event_type").alias("title"))))
    wide = own.select(F.col("event_id").alias("entity_id"), F.when(F.col("event_id") % 3 > 0, speakers).alias("speakers"), F.when(F.col("event_id") % 2 == 0, schedule).otherwise(F.lit("bad")).alias("schedule"))
    found = details.event_details(own.select(F.col("event_id").alias("id"), F.lit("event").alias("post_type")), numbered_meta(wide, "entity_id", ["speakers", "schedule"]), ["speakers.name", "speakers.title", "schedule"])
    return found.select("id", F.array_join(F.transform("speakers", lambda x: F.concat_ws("/", x["name"], x["title"])), ",").alias("speakers"), F.array_join(F.transform("schedule", lambda x: F.concat_ws(" ", x["time"], x["title"])), ",").alias("schedule"))


NAMED_SQL = "CASE c_custkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN replace(n_name, 'I', 'İ') WHEN 2 THEN replace(lower(n_name), 'a', 'á') ELSE n_name || '!' END"


@query(f"SELECT c_custkey, {NAMED_SQL} AS wanted, (SELECT min(cast(t.n_nationkey AS bigint)) FROM nation t WHERE strip_accents(lower(t.n_name)) = strip_accents(lower({NAMED_SQL}))) AS term_id FROM customer LEFT JOIN nation n ON c_nationkey = n.n_nationkey".replace("n_name", "n.n_name").replace("t.n.n_name", "t.n_name"))
def names_by_collation(spark: SparkSession, d: str) -> DataFrame:
    """Nations by names in other cases and with other accents; no slug helps."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    k, name = F.col("c_custkey") % 4, F.col("n_name")
    wanted = F.when(k == 0, F.lower(name)).when(k == 1, F.replace(name, F.lit("I"), F.lit("İ"))).when(k == 2, F.replace(F.lower(name), F.lit("a"), F.lit("á"))).otherwise(F.concat(name, F.lit("!")))
    rows = table(spark, d, "customer").join(nations, "c_nationkey", "left").select("c_custkey", wanted.alias("wanted"))
    own = nation_terms(spark, d).where("parent is not null").withColumn("slug", null())
    return terms.by_slug_or_name(rows, "wanted", own, "location", "term_id")


def payload_rows(spark: SparkSession, d: str) -> DataFrame:
    """Events' properties as forms: some with a key that no form has, some broken."""
    k = F.col("event_id") % 5
    more = F.concat(F.lit('{"email": "'), "event_type", F.lit('", "hack": ['), F.col("user_id").cast("string"), F.lit('], "phone": null, "views": '), F.col("event_id").cast("string"), F.lit("}"))
    return table(spark, d, "events").select(F.col("event_id").alias("entity_id"), F.when(k == 0, F.lit("{broken")).when(k == 1, more).when(k == 2, F.lit("[1]")).otherwise(F.col("props")).alias("payload"))


@query("SELECT event_id AS entity_id, 'email' AS key, event_type AS value FROM events WHERE event_id % 5 = 1 UNION ALL SELECT event_id, 'views', cast(event_id AS varchar) FROM events WHERE event_id % 5 = 1 UNION ALL SELECT event_id, 'k', props->>'k' FROM events WHERE event_id % 5 > 2 AND (props->>'k') IS NOT NULL")
def open_payloads(spark: SparkSession, d: str) -> DataFrame:
    return submit.open_fields(payload_rows(spark, d), "entity_id", "payload", ["email", "phone", "views", "k"])[0]


@query("SELECT event_id AS entity_id, NULL AS key, '{broken' AS value, 'json' AS error FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id, NULL, '[1]', 'json' FROM events WHERE event_id % 5 = 2 UNION ALL SELECT event_id, 'hack', '[' || user_id || ']', 'key' FROM events WHERE event_id % 5 = 1 UNION ALL SELECT event_id, 'k', props->>'k', 'key' FROM events WHERE event_id % 5 > 2 AND json_exists(props, '$.k')")
def open_rejected(spark: SparkSession, d: str) -> DataFrame:
    return submit.open_fields(payload_rows(spark, d), "entity_id", "payload", ["email", "phone", "views"])[1]


def mixed_submissions(spark: SparkSession, d: str) -> DataFrame:
    """Customers as submissions: without a title, with an empty one, with or without a description of tags and text."""
    k = F.col("c_custkey")
    title = F.when(k % 3 == 0, F.lit("<i> </i>")).when(k % 3 == 1, F.col("c_name"))
    content = F.when(k % 2 == 0, F.concat(F.lit("<p>"), "c_mktsegment", F.lit("</p>")))
    rest = ["officialName", "sector", "companyType", "email", "phone", "website", "city", "district", "postalCode", "address"]
    return table(spark, d, "customer").select(k.alias("id"), title.alias("title"), content.alias("description"), *[null().alias(c) for c in rest])


@query("SELECT c_custkey AS id, c_custkey % 6 <> 3 AS success, CASE WHEN c_custkey % 6 = 3 THEN 'Firma oluşturulamadı: Content, title, and excerpt are empty.' ELSE 'Firma başvurunuz alındı. Teşekkürler!' END AS message, CASE WHEN c_custkey % 6 <> 3 THEN c_custkey END AS \"postId\" FROM customer")
def submit_replies(spark: SparkSession, d: str) -> DataFrame:
    return submit.replies(mixed_submissions(spark, d))


@query("SELECT c_custkey AS id, 'Content, title, and excerpt are empty.' AS error FROM customer WHERE c_custkey % 6 = 3")
def submit_failed(spark: SparkSession, d: str) -> DataFrame:
    return submit.failed(mixed_submissions(spark, d))


@query("SELECT c_custkey AS id, 'company' AS post_type, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN c_name ELSE '(İsimsiz Firma)' END AS title, CASE WHEN c_custkey % 2 = 0 THEN '<p>' || c_mktsegment || '</p>' ELSE '' END AS content, 'pending' AS status FROM customer WHERE c_custkey % 6 <> 3")
def submit_content(spark: SparkSession, d: str) -> DataFrame:
    return submit.submit_companies(mixed_submissions(spark, d), nation_terms(spark, d))[0]


REPLIES_SQL = """WITH r AS (SELECT *, c_nationkey || '.' || (c_custkey % 1000) || '@example.com' AS email FROM customer), k AS (SELECT s_nationkey || '.' || (s_suppkey % 1000) || '@example.com' AS email FROM supplier),
u AS (SELECT email, min(c_custkey) AS c_custkey FROM r WHERE c_custkey % 11 > 0 AND email NOT IN (SELECT email FROM k) GROUP BY 1)"""


@query(REPLIES_SQL + """ SELECT c_custkey AS id, c_custkey IN (SELECT c_custkey FROM u) AS success, CASE WHEN c_custkey IN (SELECT c_custkey FROM u) THEN 'Kayıt başarılı! Giriş yapabilirsiniz.' WHEN c_custkey % 11 = 0 THEN 'Cannot create a user with an empty login name.' ELSE 'Bu e-posta adresi zaten kayıtlı.' END AS message, CASE WHEN c_custkey IN (SELECT c_custkey FROM u) THEN c_custkey END AS "userId" FROM r""")
def register_replies(spark: SparkSession, d: str) -> DataFrame:
    own, known = registrations(spark, d)
    own = own.withColumn("email", F.when(F.col("id") % 11 == 0, F.lit("no address")).otherwise(F.col("email")))
    return submit.registration_replies(own, known)


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey || 'a@example.com' WHEN 1 THEN c_mktsegment || '@x.example.org' ELSE '' END AS email FROM customer")
def email_cases(spark: SparkSession, d: str) -> DataFrame:
    """Addresses with characters that go, good ones, and two kinds that are none."""
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, F.concat("c_custkey", F.lit(" <a>,@example.com"))).when(k == 1, F.concat("c_mktsegment", F.lit("@x.example.org"))).when(k == 2, F.concat("c_mktsegment", F.lit("@localhost"))).otherwise(F.concat("c_custkey", F.lit("@a@b.co")))
    return table(spark, d, "customer").select("c_custkey", S.email(raw).alias("email"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'https://example.com/' || c_custkey || '?a=b' WHEN 1 THEN '' WHEN 2 THEN 'mailto:' || c_custkey || '@example.com' WHEN 3 THEN '/path/' || c_mktsegment ELSE '' END AS url FROM customer")
def url_cases(spark: SparkSession, d: str) -> DataFrame:
    """URLs with characters that go, forbidden and allowed schemes, none."""
    k = F.col("c_custkey") % 5
    raw = F.when(k == 0, F.concat(F.lit(' https://example.com/"<'), "c_custkey", F.lit(">?a=b "))).when(k == 1, F.concat(F.lit("javascript:"), "c_custkey")).when(k == 2, F.concat(F.lit("mailto:"), "c_custkey", F.lit("@example.com"))).when(k == 3, F.concat(F.lit("/path/"), "c_mktsegment")).otherwise(F.concat(F.lit("data:"), "c_name"))
    return table(spark, d, "customer").select("c_custkey", S.url(raw).alias("url"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '#' || printf('%06x', cast(p_partkey * 7919 % 16777216 AS integer)) WHEN 1 THEN '#' || upper(printf('%03x', cast(p_partkey % 4096 AS integer))) END AS color FROM part")
def color_cases(spark: SparkSession, d: str) -> DataFrame:
    """Colours of six and three digits, of four, and without the sign."""
    k, p = F.col("p_partkey") % 4, F.col("p_partkey")
    raw = F.when(k == 0, F.format_string("#%06x", p * 7919 % 16777216)).when(k == 1, F.upper(F.format_string("#%03x", p % 4096))).when(k == 2, F.format_string("#%04x", p % 65536)).otherwise(F.format_string("%06x", p))
    return table(spark, d, "part").select("p_partkey", S.hex_color(raw).alias("color"))


@query("SELECT c_custkey, to_base64(encode(c_custkey || '|' || c_name || '|' || (1700000000 + c_nationkey))) AS token FROM customer")
def login_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", S.login_token(F.col("c_custkey"), F.col("c_name"), F.col("c_nationkey") + 1_700_000_000).alias("token"))


#: Rows of an import: regions and nations that are there as terms, and new countries, cities and districts.
PLACES_SQL = f"""WITH RECURSIVE f AS (SELECT s_suppkey AS line_no, CASE WHEN s_suppkey % 3 = 0 THEN 'New ' || r_name ELSE lower(r_name) END AS country, n_name AS city, s_name AS district FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
k AS (SELECT *, {SLUG_SQL.format('country')} AS ck, {SLUG_SQL.format('city')} AS nk, {SLUG_SQL.format('district')} AS dk, lower(country) IN ('asia', 'europe') AS home FROM f),
e AS (SELECT line_no, 1 AS depth, 'country' AS level, ck AS path, country AS name, '' AS up, NULL AS lat FROM k UNION ALL SELECT line_no, 2, 'city', ck || '/' || nk, city, ck, CASE WHEN NOT home THEN (line_no // 7) || '.' || (line_no % 7) END FROM k UNION ALL SELECT line_no, 3, 'district', ck || '/' || nk || '/' || dk, district, ck || '/' || nk, NULL FROM k WHERE home),
p AS (SELECT path, any_value(depth) AS depth, any_value(level) AS level, any_value(up) AS up, arg_min(name, line_no) AS name, arg_max(lat, line_no) FILTER (WHERE lat IS NOT NULL) AS lat FROM e GROUP BY path),
o AS (SELECT cast(r_regionkey + 1000 AS bigint) AS term_id, r_name AS name, NULL::BIGINT AS parent, {SLUG_SQL.format('r_name')} AS path FROM region UNION ALL SELECT cast(n_nationkey AS bigint), n_name, cast(r_regionkey + 1000 AS bigint), {SLUG_SQL.format('r_name')} || '/' || {SLUG_SQL.format('n_name')} FROM nation JOIN region ON n_regionkey = r_regionkey),
n AS (SELECT (SELECT max(term_id) FROM o) + row_number() OVER (ORDER BY depth, path) AS term_id, name, up, path FROM p ANTI JOIN o USING (path)),
a AS (SELECT term_id, path FROM o UNION ALL SELECT term_id, path FROM n), t AS (SELECT term_id, name, parent FROM o UNION ALL SELECT n.term_id, name, a.term_id FROM n LEFT JOIN a ON a.path = n.up)"""


def imported(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own = table(spark, d, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    at = F.concat(F.floor(k / 7).cast("string"), F.lit(","), (k % 7).cast("string"))
    rows = own.select(k.alias("line_no"), F.when(k % 3 == 0, F.concat(F.lit("New "), "r_name")).otherwise(F.lower("r_name")).alias("country"), F.col("n_name").alias("city"), F.col("s_name").alias("district"), at.alias("lat"), at.alias("lng"))
    known = nation_terms(spark, d)
    levels = known.where("parent is null").select("term_id", F.lit("region").alias("location_type"))
    return ingest.import_terms(rows, known, numbered_meta(levels, "term_id", ["location_type"]).withColumn("meta_id", F.col("term_id")).select("meta_id", "term_id", "key", "value"), HOME)


@query(PLACES_SQL + f" SELECT term_id, 'location' AS taxonomy, name, {SLUG_SQL.format('name')} AS slug, parent FROM t")
def imported_terms(spark: SparkSession, d: str) -> DataFrame:
    return imported(spark, d)[0]


@query(PLACES_SQL + """, w AS (SELECT term_id, 'location_type' AS key, level AS value FROM p JOIN a USING (path) UNION ALL SELECT term_id, x, lat FROM p JOIN a USING (path), (SELECT unnest(['map_lat', 'map_lng']) AS x) WHERE lat IS NOT NULL),
m AS (SELECT term_id AS meta_id, term_id, 'location_type' AS key, 'region' AS value FROM o WHERE parent IS NULL)
SELECT meta_id, term_id, key, coalesce(w.value, m.value) AS value FROM m LEFT JOIN w USING (term_id, key) UNION ALL SELECT (SELECT max(meta_id) FROM m) + row_number() OVER (ORDER BY term_id, key), term_id, key, value FROM w ANTI JOIN m USING (term_id, key)""")
def imported_term_meta(spark: SparkSession, d: str) -> DataFrame:
    return imported(spark, d)[1]


ACCOUNTS_SQL = """WITH r AS (SELECT *, c_nationkey || '.' || (c_custkey % 1000) || '@example.com' AS email FROM customer), k AS (SELECT s_suppkey AS id, s_nationkey || '.' || (s_suppkey % 1000) || '@example.com' AS email, s_name FROM supplier),
u AS (SELECT r.*, (SELECT max(id) FROM k) + row_number() OVER (ORDER BY r.c_custkey) AS id FROM r JOIN (SELECT email, min(c_custkey) AS c_custkey FROM r GROUP BY 1) f ON r.email = f.email AND r.c_custkey = f.c_custkey WHERE r.email NOT IN (SELECT email FROM k))"""


def created_accounts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own, _ = registrations(spark, d)
    email = F.concat("s_nationkey", F.lit("."), (F.col("s_suppkey") % 1000).cast("string"), F.lit("@example.com"))
    accounts = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), email.alias("login"), email.alias("email"), F.col("s_name").alias("first_name"), F.lit("").alias("last_name"), F.col("s_name").alias("display_name"))
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("meta_id"), F.col("s_suppkey").alias("user_id"), F.lit("phone").alias("key"), F.col("s_name").alias("value"))
    return submit.create_accounts(own, accounts, known)


@query(ACCOUNTS_SQL + " SELECT id, email AS login, email, s_name AS first_name, '' AS last_name, s_name AS display_name FROM k UNION ALL SELECT id, email, email, 'Ada', string_split('Ada ' || c_mktsegment, ' ')[-1], 'Ada ' || c_mktsegment FROM u")
def new_accounts(spark: SparkSession, d: str) -> DataFrame:
    return created_accounts(spark, d)[0]


@query(ACCOUNTS_SQL + """, m AS (SELECT id AS user_id, 'account_type' AS key, CASE WHEN c_acctbal > 0 THEN 'kurumsal' ELSE 'bireysel' END AS value FROM u UNION ALL SELECT id, 'company_name', c_name FROM u WHERE c_acctbal > 0)
SELECT id AS meta_id, id AS user_id, 'phone' AS key, s_name AS value FROM k UNION ALL SELECT (SELECT max(id) FROM k) + row_number() OVER (ORDER BY user_id, key), user_id, key, value FROM m""")
def new_account_meta(spark: SparkSession, d: str) -> DataFrame:
    return created_accounts(spark, d)[1]


TAGS_SQL, ANY_SQL = (", ".join(f"'{x}'" for x in some) for some in (S.POST_TAGS, S.ANY_ATTRIBUTES))
OWN_SQL = " OR ".join(f"(name = '{tag}' AND string_split(a, '=')[1] IN ({', '.join(repr(x) for x in some)}))" for tag, some in S.OWN_ATTRIBUTES.items())


@query(f"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '{S.TOKEN}', 0)) AS x, unnest(range(len(regexp_extract_all(html, '{S.TOKEN}', 0)))) AS n FROM pages),
u AS (SELECT *, lower(regexp_extract(x, '^</?([A-Za-z][A-Za-z0-9]*)[^A-Za-z0-9]', 1)) AS name FROM t),
v AS (SELECT page_id, n, CASE WHEN x = '<' THEN '&lt;' WHEN NOT starts_with(x, '<') THEN x WHEN name NOT IN ({TAGS_SQL}) THEN '' WHEN starts_with(x, '</') THEN '</' || name || '>'
ELSE '<' || name || array_to_string(list_transform(list_filter(regexp_extract_all(x, '{S.ATTRIBUTE}', 1), lambda a: (string_split(a, '=')[1] IN ({ANY_SQL}) OR {OWN_SQL}) AND (string_split(a, '=')[1] NOT IN ('href', 'src') OR regexp_matches(lower(a), '{S.SAFE_URL}'))), lambda a: ' ' || a), '') || CASE WHEN ends_with(x, '/>') THEN ' /' ELSE '' END || '>' END AS y FROM u)
SELECT page_id, coalesce(string_agg(y, '' ORDER BY n), '') AS html FROM pages LEFT JOIN v USING (page_id) GROUP BY page_id""")
def allowed_html(spark: SparkSession, d: str) -> DataFrame:
    """Whole pages with allowed tags and attributes only."""
    return table(spark, d, "pages").select("page_id", S.post_html(F.col("html")).alias("html"))
