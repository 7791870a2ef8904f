"""Fields asked for, single nodes, pages both ways, names by collation, open payloads, replies."""

import base64
import json
import re
import time

import pytest
from pyspark.sql import functions as F

from dirlake.functions import scalar as S
from dirlake.operators import details, listing, submit, terms
from dirlake.sources.nodes import Pages, write_nodes
from dirlake.sources.schema import COMPANY_SUBMISSION, ENTITY, ENTITY_META, TERM

ENTITIES = [(1, "company", "A", "", "publish", None, "a"), (2, "company", "B", "", "publish", None, "b"), (5, "post", "N5", "", "publish", None, "n"), (6, "post", "N6", "", "draft", None, "m"), (7, "post", "N7", "", "publish", None, "o")]
META = [(1, 1, "email", "x@y.z"), (3, 1, "is_verified", "1"), (4, 1, "working_hours", json.dumps([{"days": "Mon", "time": "9"}])), (6, 1, "related_news_ids", json.dumps(["7", "5x", "6", "7", "99"])), (7, 1, "linkedin_url", "l"), (8, 1, "twitter_url", "t")]


def keys_read(df):
    """The keys that the scan of the attributes is filtered by."""
    pushed = df._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [")[1].split("ReadSchema")[0]
    return set(re.findall(r"EqualTo\(key,(\w+)\)", pushed)) | {k for x in re.findall(r"In\(key, \[([\w,]+)\]", pushed) for k in x.split(",")}


def scanned(df):
    """Rows that the scans of a plan give out."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif "QueryStage" in kind:
            todo.append(p.plan())
        elif kind == "FileSourceScanExec":
            found += p.metrics().get("numOutputRows").get().value()
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_fields_asked_for(spark, tmp_path):
    entities = spark.createDataFrame(ENTITIES, ENTITY)
    spark.createDataFrame(META, ENTITY_META).write.parquet(f"file://{tmp_path}/meta")
    meta = spark.read.parquet(f"file://{tmp_path}/meta")
    got = details.company_details(entities, meta, ["email", "social.linkedin", "workingHours.time"])
    row = {r.id: r for r in got.collect()}
    assert (row[1].email, row[1].social.asDict(), row[1].workingHours[0].asDict()) == ("x@y.z", {"linkedin": "l"}, {"time": "9"}) and row[2].email == "" and row[2].workingHours == []
    assert keys_read(got) == {"email", "working_hours", "linkedin_url"}
    two = details.company_details(entities, meta, ["phone", "isVerified"])
    assert keys_read(two) == {"phone", "is_verified"} and two.columns == ["id", "phone", "isVerified"]
    for wrong in ("nothing", "social.myspace", "email.x"):
        with pytest.raises(ValueError):
            details.company_details(entities, meta, [wrong])


def test_whole_company(spark):
    """All 21 fields in one frame, news in the order of the list."""
    entities, meta = spark.createDataFrame(ENTITIES, ENTITY), spark.createDataFrame(META, ENTITY_META)
    got = details.company_details(entities, meta, news=True)
    row = {r.id: r for r in got.collect()}
    assert len(got.columns) == 22 and [tuple(x) for x in row[1].relatedNews] == [(7, "N7"), (5, "N5")] and row[2].relatedNews == []
    only = details.company_details(entities, meta, ["relatedNews"])
    assert only.columns == ["id", "relatedNews"] and only.count() == 2


def test_single_node(spark, tmp_path):
    """An id is read from one bucket; a slug skips the row groups whose Bloom filters don't have it."""
    rows = spark.range(20000).select("id", F.concat(F.lit("company-"), F.sha2(F.col("id").cast("string"), 256)).alias("slug"))
    write_nodes(rows, "nodes", buckets=8, path=f"file://{tmp_path}/nodes", row_group_bytes=1 << 16)
    nodes = spark.table("nodes")
    one = listing.node(nodes, "id", F.lit(77).cast("bigint"))
    slug = one.first().slug
    assert scanned(one) < 20000 / 8 * 1.2
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else a plan doesn't name its buckets
    try:
        assert "SelectedBucketsCount: 1 out of 8" in listing.node(nodes, "id", F.lit(77).cast("bigint"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")

    by_slug = nodes.where(F.col("slug") == slug)
    assert by_slug.first().id == 77 and 0 < scanned(by_slug) <= 6000
    assert scanned(nodes.where(F.col("slug") == slug.replace("company-", "company-0"))) < 6000 < scanned(nodes.where(F.col("slug") > "company-5"))
    spark.sql("DROP TABLE nodes")


def test_pages(spark, tmp_path):
    rows = [(i, None if i % 50 == 49 else f"2024-01-{1 + i * 7 % 20:02}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, day string").select("id", F.to_timestamp_ntz("day").alias("date"))
    pages = Pages(f"file://{tmp_path}/pages")
    pages.create(df, 9)
    want = [i for i, d in sorted(rows, key=lambda x: (x[1] or "", x[0]), reverse=True)]
    got, at = [], None
    while True:
        page = pages.page(spark, first=23, after=at).collect()
        got += [r.id for r in page]
        at = page[-1].cursor
        if not page[0].has_more:
            break
    assert got == want
    got, at = [], None
    while True:
        page = pages.page(spark, last=31, before=at).collect()
        got = [r.id for r in page] + got
        at = page[0].cursor
        if not page[0].has_more:
            break
    assert got == want
    assert pages.page(spark, first=5, after=pages.page(spark, last=1).first().cursor).count() == 0
    for wrong in ({}, {"first": 1, "last": 1}, {"first": 1, "before": "x"}, {"last": 1, "after": "x"}):
        with pytest.raises(ValueError):
            pages.page(spark, **wrong)


def test_files_of_a_page(spark, tmp_path):
    """As many files are read for a page of a table ten times as large."""
    for n in (4, 40):
        df = spark.range(n * 100).select("id", F.timestamp_seconds(F.col("id") * 60).alias("date"))
        pages = Pages(f"file://{tmp_path}/pages{n}")
        pages.create(df, n)
        middle = pages.page(spark, first=1, after=base64.b64encode(json.dumps(["1970-01-01 03:00:00", "180"]).encode()).decode())
        assert middle.first().id == 179 and len(middle.inputFiles()) <= 2


@pytest.mark.parametrize("name", ["İzmir", "izmir", "IZMIR", "IZMİR", "ızmır"])
def test_names_by_collation(spark, name):
    own = spark.createDataFrame([(2, "location", "İzmir", "x", 1), (3, "location", "Şişli", "y", 1)], TERM)
    rows = spark.createDataFrame([(1, name), (2, "SISLI"), (3, "iz mir")], "id long, city string")
    assert {r.id: r.found for r in terms.by_slug_or_name(rows, "city", own, "location", "found").collect()} == {1: 2, 2: 3, 3: None}
    exact = {r.id: r.found for r in terms.by_slug_or_name(rows, "city", own, "location", "found", collation=None).collect()}
    assert exact == {1: 2 if name == "İzmir" else None, 2: None, 3: None}


def test_open_payloads(spark):
    rows = [(1, '{"email": "a@b.co", "phone": 5, "hack": {"x": [1]}, "hours": [{"a": "b"}], "gone": null, "website": null}'), (2, "{broken"), (3, "[1, 2]"), (4, "{}"), (5, None), (6, '{"email": ""}')]
    df = spark.createDataFrame(rows, "id long, payload string")
    good, bad = submit.open_fields(df, "id", "payload", ["email", "phone", "hours", "website"])
    assert sorted(map(tuple, good.collect())) == [(1, "email", "a@b.co"), (1, "hours", '[{"a":"b"}]'), (1, "phone", "5"), (6, "email", "")]
    assert sorted(map(tuple, bad.collect()), key=repr) == [(1, "gone", None, "key"), (1, "hack", '{"x":[1]}', "key"), (2, None, "{broken", "json"), (3, None, "[1, 2]", "json")]
    assert [c.count() for c in submit.open_fields(df.limit(0), "id", "payload", ["email"])] == [0, 0]
    typed = {r.id: (r.email, r.phone) for r in submit.typed_fields(df, "payload", "email string, phone int").collect()}
    assert typed[1] == ("a@b.co", 5) and typed[2] == typed[5] == (None, None)


def test_replies(spark):
    fields = "id long, " + COMPANY_SUBMISSION
    rest = (None,) * 10
    rows = spark.createDataFrame([(1, "A", None, *rest), (2, "<b> </b>", None, *rest), (3, None, None, *rest), (4, "", None, None, None, "text", *rest[3:])], fields)
    got = {r.id: tuple(r)[1:] for r in submit.replies(rows).collect()}
    assert got[1] == (True, submit.RECEIVED, 1) and got[2] == (False, submit.NOT_CREATED + submit.NOTHING_GIVEN, None) and got[3][0] and got[4][0]
    assert [tuple(r) for r in submit.failed(rows).collect()] == [(2, submit.NOTHING_GIVEN)]
    entity, meta, links = submit.submit_companies(rows, spark.createDataFrame([], TERM))
    assert sorted(r.id for r in entity.collect()) == [1, 3, 4]


def test_registration_replies(spark):
    fields = "id long, email string, firstName string, lastName string, phone string, accountType string, companyName string, taxOffice string, taxNumber string, sector string"
    row = lambda i, e: (i, e, "Ada King", None, None, None, None, None, None, None)
    rows = spark.createDataFrame([row(1, "a@x.org"), row(2, "a@x.org"), row(3, "k@x.org"), row(4, "no address")], fields)
    got = {r.id: tuple(r)[1:] for r in submit.registration_replies(rows, spark.createDataFrame([("k@x.org",)], "email string")).collect()}
    assert got == {1: (True, submit.REGISTERED, 1), 2: (False, submit.KNOWN_EMAIL, None), 3: (False, submit.KNOWN_EMAIL, None), 4: (False, submit.NO_LOGIN, None)}


def test_login_token(spark):
    """Id, e-mail and the time of the query."""
    before = int(time.time())
    df = spark.range(3).select(S.login_token(F.col("id"), F.lit("a@b.co")).alias("now"), S.login_token(F.col("id"), F.lit("a@b.co"), F.lit(17)).alias("then"))
    for i, r in enumerate(df.collect()):
        who, email, seconds = base64.b64decode(r.now).decode().split("|")
        assert (who, email) == (str(i), "a@b.co") and before <= int(seconds) <= time.time()
        assert base64.b64decode(r.then).decode() == f"{i}|a@b.co|17"
