"""Quirks of forms and importer on small rows, and what must not change an import."""

import json

import pytest
from pyspark.sql import functions as F

from dirlake.functions import scalar as S
from dirlake.operators import details, ingest, listing, meta, submit, terms
from dirlake.plans import catalog
from dirlake.sources.csv import parse_lines, read_locations
from dirlake.sources.schema import ENTITY, ENTITY_META, TERM


def one(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r.y for r in df.select(f(F.col("x")).alias("y")).collect()]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (S.form_trim, " \t\0a b\x0b\n", "a b"),
        (S.unicode_trim, "  a ", "a"),
        (S.lenient_int, " 12abc", 12),
        (S.lenient_int, "1e3", 1000),
        (S.lenient_int, "x", 0),
        (S.lenient_int, None, 0),
        (S.lenient_int, "99999999999999999999", 0),
        (S.flag, "1", True),
        (S.flag, "01", False),
        (S.flag, None, False),
        (S.is_empty, "0", True),
        (S.is_empty, "00", False),
        (S.is_numeric, "1.5d", False),
        (S.is_numeric, "NaN", False),
        (S.is_numeric, " -.5e3", True),
        (S.is_numeric, None, False),
        (S.text_field, "<p>a\n\n b</p> ", "a b"),
        (S.text_area, "<p>a\n b</p>\n", "a\n b"),
        (S.hex_color, "#AbC", "#AbC"),
        (S.hex_color, "#abcd", None),
        (S.slug, "Çağrı Şişli!", "cagri-sisli"),
        (S.slug, "İZMİR", "izmir"),
        (S.post_html, '<P onclick="x">a</P><script>b</script><!-- c -->', "<p>a</p>b"),
        (S.post_html, '<a href="https://x.org/?a=b" rel="r" style="s">l</a><a href="javascript:x">m</a>', '<a href="https://x.org/?a=b" rel="r">l</a><a>m</a>'),
        (S.post_html, '<a href="java&#115;cript:x">m</a><a href="/p?q=a:b">n</a><a href="JAVASCRIPT:x">o</a>', '<a>m</a><a href="/p?q=a:b">n</a><a>o</a>'),
        (S.post_html, '<img src="a.png" alt="t" href="x" onerror=e /><br/>1 < 2 > 0 <', '<img src="a.png" alt="t" /><br />1 &lt; 2 > 0 &lt;'),
        (S.post_html, "<b<script>x</script>", "&lt;bx"),
        (S.post_html, "", ""),
        (S.post_html, None, None),
        (S.email, " a b@x.org", "ab@x.org"),
        (S.email, "a@b", ""),
        (S.url, "javascript:alert(1)", ""),
        (S.url, "https://x.org/a b", "https://x.org/ab"),
        (S.last_word, "Ada", ""),
        (S.last_word, "Ada King Lovelace", "Lovelace"),
    ],
)
def test_scalar(spark, f, given, want):
    assert one(spark, f, given) == [want]


LINES = ["Ülke,Şehir", "Türkiye,İzmir,Konak", "turkey,Ankara,0", "TURKEY,Ankara,Çankaya,1,2", "", "Fransa,Paris,Paris,\"48,8\",\"2,3\"", "fransa,PARIS,x,north,2", "Fransa,Paris,x,49,3\r", "0,x", "Fransa,0", "Fransa"]


def lines(spark, rows):
    return spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "line_no long, line string")


def test_import(spark):
    got = {r.path: r for r in ingest.location_terms(parse_lines(lines(spark, LINES))).collect()}
    assert got["fransa/paris"].name == "Paris" and (got["fransa/paris"].lat, got["fransa/paris"].lng) == ("49", "3")
    assert got["turkey/ankara/cankaya"].level == "district" and got["turkey/ankara"].lat is None
    assert "fransa/paris/paris" not in got and not any(p.startswith(("0", "ulke")) for p in got)
    report = ingest.import_report(parse_lines(lines(spark, LINES))).first()
    assert (report.submitted, report.accepted) == (10, 8)


@pytest.mark.parametrize("size", [1, 3, 50])
def test_import_in_batches(spark, size):
    """Batches of any size, also sent twice, end as one import."""
    rows = [(i, x) for i, x in enumerate(LINES)]
    schema = "line_no long, line string"
    state = ingest.location_terms(parse_lines(spark.createDataFrame([], schema)))
    for at in range(0, len(rows), size):
        new = ingest.location_terms(parse_lines(spark.createDataFrame(rows[at : at + size], schema)))
        state = spark.createDataFrame(ingest.merge_locations(ingest.merge_locations(state, new), new).collect(), state.schema)
    assert sorted(map(tuple, state.collect()), key=repr) == sorted(map(tuple, ingest.location_terms(parse_lines(spark.createDataFrame(rows, schema))).collect()), key=repr)


def test_csv_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('country,city,district,lat,lng\n"Fran\nsa",Paris,,1,2\n', encoding="utf-8")
    row = read_locations(spark, str(tmp_path)).first()
    assert (row.country, row.city, row.lat) == ("Fran\nsa", "Paris", "1")


def test_streamed_import(spark, tmp_path):
    from dirlake.streaming.locations import import_locations

    (tmp_path / "in").mkdir()
    for i, x in enumerate(LINES):
        (tmp_path / "in" / f"{i:02}.csv").write_text(x + "\n", encoding="utf-8")
    import_locations(spark, str(tmp_path / "in"), "streamed_locations", str(tmp_path / "at"), per_batch=4).awaitTermination()
    got = {r.path: r.lat for r in spark.table("streamed_locations").collect()}
    assert got["fransa/paris"] == "49" and len(got) == 8
    spark.sql("DROP TABLE streamed_locations")


def test_upsert(spark):
    base = spark.createDataFrame([(1, "a", 1, ["x"]), (2, "b", 0, None)], "id long, name string, ok int, list array<string>")
    nothing = spark.createDataFrame([(1, None, None, None)], "id long, name string, ok int, list array<string>")
    out = {r.id: r for r in meta.upsert(base, nothing, "id", sparse=["name"], flags=["ok"], lists=["list"]).collect()}
    assert (out[1].name, out[1].ok, out[1].list) == ("a", 0, None) and (out[2].name, out[2].ok) == ("b", 0)
    new = spark.createDataFrame([(3, "c", 5, ["z"])], base.schema)
    out = {r.id: r for r in meta.upsert(base, new, "id", sparse=["name"], flags=["ok"], lists=["list"]).collect()}
    assert (out[3].name, out[3].ok, out[3].list) == ("c", 1, ["z"]) and out[1].list == ["x"]


def test_upsert_rows(spark):
    old = spark.createDataFrame([(1, 7, "k", "a"), (2, 7, "m", "b")], ENTITY_META)
    patch = spark.createDataFrame([(7, "k", "c"), (8, "k", "d"), (7, "m", None)], "entity_id bigint, key string, value string")
    assert {(r.entity_id, r.key, r.value) for r in meta.upsert_rows(old, patch).collect()} == {(7, "k", "c"), (7, "m", "b"), (8, "k", "d")}


TERMS = [(1, "location", "Türkiye", "turkiye", None), (2, "location", "İzmir", "izmir", 1), (3, "location", "Konak", "konak", 2), (4, "location", "Konak", "konak-2", 1), (5, "sector", "Gıda", "gida", None), (6, "location", "a", "a", 7), (7, "location", "b", "b", 6)]


def test_terms(spark):
    own = spark.createDataFrame(TERMS, TERM)
    paths = {r.term_id: r.path for r in terms.paths(own).collect()}
    assert paths[3] == "Türkiye > İzmir > Konak" and paths[5] == "Gıda" and paths[6] is None
    rows = spark.createDataFrame([(1, "izmir", "Konak"), (2, "nowhere", "Konak"), (3, "İzmir", "0"), (4, None, None)], "id long, city string, district string")
    got = {r.id: (r.city_id, r.district_id) for r in terms.city_and_district(rows, own).collect()}
    assert got == {1: (2, 3), 2: (None, None), 3: (2, None), 4: (None, None)}


def test_submission(spark):
    fields = "id long, title string, officialName string, sector string, companyType string, description string, email string, phone string, website string, city string, district string, postalCode string, address string"
    rows = spark.createDataFrame([(9, None, "Ö", "Gıda", None, "<b>x</b>", "a@b.co", None, None, "izmir", "Konak", None, "a\nb")], fields)
    entity, attributes, links = submit.submit_companies(rows, spark.createDataFrame(TERMS, TERM))
    assert tuple(entity.first()) == (9, "company", submit.UNNAMED, "<b>x</b>", "pending")
    assert {(r.key, r.value) for r in attributes.collect()} == {("official_name", "Ö"), ("email", "a@b.co"), ("address", "a\nb")}
    assert {(r.taxonomy, r.term_id) for r in links.collect()} == {("sector", 5), ("location", 2), ("location", 3)}


def test_registration(spark):
    fields = "id long, email string, firstName string, lastName string, phone string, accountType string, companyName string, taxOffice string, taxNumber string, sector string"
    rows = [(1, "a@x.org", "Ada King", None, "1", "kurumsal", "A", "T", "N", "S"), (2, "a@x.org", "B", "C", None, "bireysel", "B", None, None, None), (3, "b@x.org", "B", "C", None, "Kurumsal", "B", None, None, None), (4, "k@x.org", "K", None, None, None, None, None, None, None)]
    users, attributes, rejected = submit.register_users(spark.createDataFrame(rows, fields), spark.createDataFrame([("k@x.org",)], "email string"))
    assert {(r.id, r.first_name, r.last_name, r.display_name) for r in users.collect()} == {(1, "Ada", "King", "Ada King"), (3, "B", "C", "B")}
    assert ("company_name", "A") in {(r.key, r.value) for r in attributes.collect()} and {r.user_id for r in attributes.where("key = 'company_name'").collect()} == {1}
    assert {r.id for r in rejected.collect()} == {2, 4}


def test_company(spark):
    entities = spark.createDataFrame([(1, "company", "A", "", "publish", None, "a"), (5, "post", "N5", "", "publish", None, "n"), (6, "post", "N6", "", "draft", None, "m"), (7, "post", "N7", "", "publish", None, "o")], ENTITY)
    rows = [(1, 1, "email", "x@y.z"), (2, 1, "email", "later"), (3, 1, "is_verified", "1"), (4, 1, "working_hours", json.dumps([{"days": "Mon", "time": "9"}])), (5, 1, "company_services", "broken"), (6, 1, "related_news_ids", json.dumps(["7", "5x", "6", "7", "99"])), (7, 1, "linkedin_url", "l")]
    attributes = spark.createDataFrame(rows, ENTITY_META)
    got = details.company_details(entities, attributes).first()
    assert (got.email, got.isVerified, got.phone, got.services, got.workingHours[0].days, got.social.linkedin, got.social.twitter) == ("x@y.z", True, "", [], "Mon", "l", "")
    assert [(r.pos, r.news_id) for r in details.related_news(entities, attributes).orderBy("pos").collect()] == [(0, 7), (1, 5)]


def test_ordered_lookup(spark, monkeypatch):
    """Of repeated ids the first place counts; what a task groups doesn't grow with the table."""
    rows = [(1, [7, None, 5, 7, 9, 5]), (2, []), (3, None), (4, [(i * i) % 101 for i in range(3000)])]
    targets = spark.createDataFrame([(i, f"n{i}") for i in range(101) if i != 9], "news_id long, title string")
    got = listing.ordered_lookup(spark.createDataFrame(rows, "id long, ids array<long>"), "id", "ids", targets, "news_id").collect()
    assert sorted(map(tuple, got)) == sorted((o, x.index(i), i, f"n{i}") for o, x in rows for i in set(x or []) - {9, None})
    monkeypatch.setattr(listing, "ROWS", 500, raising=False)
    related = catalog.ordered_related(spark, "/root/testdata/sf0.001")
    tasks = [r["count"] for r in related.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(tasks) > 5000 and max(tasks) < 1500


@pytest.mark.parametrize("size", [1, 7, 50])
def test_batches(spark, size):
    rows = spark.createDataFrame([(i * i,) for i in range(137)], "k long").repartition(5)
    got = {r.k: r.batch for r in listing.batches(rows, "k", size).collect()}
    assert got == {i * i: i // size for i in range(137)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], ENTITY)
    assert details.company_details(empty, spark.createDataFrame([], ENTITY_META)).count() == 0
    assert terms.paths(spark.createDataFrame([], TERM)).count() == 0
    assert listing.batches(spark.createDataFrame([], "k long"), "k").count() == 0


def test_deep_paths(spark):
    """A chain of a hundred terms, and what hangs below a cycle."""
    rows = [(i, "location", str(i), None, i - 1 if i else None) for i in range(100)] + [(200, "location", "x", None, 201), (201, "location", "y", None, 200), (202, "location", "z", None, 201)]
    paths = {r.term_id: r.path for r in terms.paths(spark.createDataFrame(rows, TERM)).collect()}
    assert paths[99] == " > ".join(map(str, range(100))) and paths[200] is paths[201] is paths[202] is None


def test_order_of_files(spark, tmp_path):
    """The first spelling is that of the first file by name, the last coordinates those of the last."""
    for name, city, n, lat in (("a", "PARIS", 1, "1"), ("b", "Paris", 4000, "2"), ("c", "paris", 30, "3")):
        (tmp_path / f"{name}.csv").write_text("country,city,district,lat,lng\n" + f"Fransa,{city},,{lat},5\n" * n, encoding="utf-8")
    for multi_line in (True, False):
        found = {r.path: r for r in ingest.location_terms(read_locations(spark, str(tmp_path), multi_line)).collect()}
        assert (found["fransa/paris"].name, found["fransa/paris"].lat) == ("PARIS", "3")
