"""Bucketed tables, keys, trees, and the streamed import: what changes on disk, and what a lost run leaves."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from dirlake.operators import meta
from dirlake.operators.keys import running_sum, with_keys
from dirlake.operators.trees import below, entities_below, intervals, subtree_counts
from dirlake.sources.attributes import Attributes
from dirlake.sources.buckets import Buckets
from dirlake.sources.schema import ENTITY_META, TERM

PATCH = "entity_id bigint, key string, value string"


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_running_sum(spark):
    r = random.Random(1)
    rows = [(i, r.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(r.sample(rows, 300), "k long, n long").repartition(7)
    got = {x.k: x.before for x in running_sum(df, ["k"], "n", "before").collect()}
    assert got == {i: sum(n for _, n in rows[:i]) for i in range(300)}
    assert rows_of(with_keys(df.drop("n"), ["k"], "id", 40)) == [(i, i + 41) for i in range(300)] or sorted(x.id - x.k for x in with_keys(df.drop("n"), ["k"], "id", 40).collect()) == [41] * 300
    assert with_keys(df.limit(0), ["k"], "id").count() == 0


def test_attributes_are_read_again(spark):
    """What a patch writes is read by pivot, for old owners and new ones, also with rows that have no meta_id."""
    old = spark.createDataFrame([(1, 10, "phone", "a"), (None, 12, "phone", "n")], ENTITY_META)
    patch = spark.createDataFrame([(10, "email", "e"), (11, "phone", "p"), (10, "phone", None)], PATCH)
    new = meta.upsert_rows(old, patch)
    got = {r.entity_id: (r.phone, r.email) for r in meta.pivot(new, ["phone", "email"]).collect()}
    assert got == {10: ("a", "e"), 11: ("p", None), 12: ("n", None)}
    assert sorted(r.meta_id for r in new.collect()) == [1, 2, 3, 4]
    again = meta.upsert_rows(spark.createDataFrame(new.collect(), ENTITY_META), patch)
    assert rows_of(again) == rows_of(new)


def test_repeated_attributes(spark):
    """A patch changes the row that pivot reads; other rows of the key stay; a list without a value loses all of them."""
    old = spark.createDataFrame([(2, 10, "k", "b"), (1, 10, "k", "a"), (3, 10, "l", "x"), (4, 10, "l", "y")], ENTITY_META)
    patch = spark.createDataFrame([(10, "k", "c"), (10, "l", None)], PATCH)
    assert rows_of(meta.upsert_rows(old, patch, lists=("l",))) == [(1, 10, "k", "c"), (2, 10, "k", "b")]
    assert len(rows_of(meta.upsert_rows(old, patch))) == 4


def test_one_bucket_changes(spark, tmp_path):
    store = Attributes(f"file://{tmp_path}/meta", count=16)
    store.create(spark.createDataFrame([(i + 1, i, "phone", str(i)) for i in range(400)], ENTITY_META))
    before = files(f"{tmp_path}/meta")
    touched = store.merge(spark.createDataFrame([(7, "phone", "new"), (7, "email", "e")], PATCH))
    after = files(f"{tmp_path}/meta")
    changed = {f.split("bucket=")[1].split("/")[0] for f in before.keys() ^ after.keys()}
    assert len(touched) == 1 and changed == {str(touched[0])} and all(before[f] == after[f] for f in before.keys() & after.keys())
    assert store.of(spark, 7, ["phone", "email"]).first()[1:] == ("new", "e")
    assert store.read(spark).where("key = 'email'").first().meta_id == 401 and store.read(spark).count() == 401
    plan = store.buckets.lookup(spark, 7)._jdf.queryExecution().executedPlan().toString()
    assert f"(bucket#" in plan and f"= {touched[0]})" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_keys_are_never_given_twice(spark, tmp_path):
    store = Attributes(f"file://{tmp_path}/meta", count=4)
    store.create(spark.createDataFrame([(5, 1, "k", "a")], ENTITY_META))
    patch = spark.createDataFrame([(i, "k", "x") for i in range(50)], PATCH)
    store.merge(patch)
    first = rows_of(store.read(spark))
    assert sorted(r[0] for r in first) == list(range(5, 55))
    store.merge(patch)
    assert rows_of(store.read(spark)) == first
    store.merge(spark.createDataFrame([(99, "k", "y")], PATCH))
    assert store.read(spark).where("entity_id = 99").first().meta_id == 55
    os.rename(f"{tmp_path}/meta-last", f"{tmp_path}/gone")  # a run lost while it kept the last number
    store.merge(spark.createDataFrame([(100, "k", "y")], PATCH))
    assert store.read(spark).where("entity_id = 100").first().meta_id == 56


def test_lost_merge(spark, tmp_path, monkeypatch):
    """A merge that is lost before, while or after rows are written ends the same when it is run again."""
    patch = spark.createDataFrame([(i, "k", "x") for i in range(20)], PATCH)
    want = None
    for step in ("none", "reserve", "write", "after"):
        store = Attributes(f"file://{tmp_path}/{step}", count=4)
        store.create(spark.createDataFrame([(1, 3, "k", "a"), (2, 30, "k", "b")], ENTITY_META))

        def lost(*args, **kwargs):
            raise RuntimeError("lost")

        real = Buckets._write
        with monkeypatch.context() as m:
            if step == "reserve":
                m.setattr(Attributes, "_reserve", lost)
            elif step == "write":
                m.setattr(Buckets, "_write", lost)
            elif step == "after":
                m.setattr(Buckets, "_write", lambda self, rows: (real(self, rows), lost()))
            if step != "none":
                with pytest.raises(RuntimeError):
                    store.merge(patch)
        store.merge(patch)
        got = store.read(spark)
        assert got.count() == got.select("meta_id").distinct().count() == 21
        values = rows_of(got.drop("meta_id"))
        want = want or values
        assert values == want


def test_emptied_bucket(spark, tmp_path):
    store = Attributes(f"file://{tmp_path}/meta", count=8)
    store.create(spark.createDataFrame([(1, 3, "hours", "a"), (2, 5, "hours", "b")], ENTITY_META))
    store.merge(spark.createDataFrame([(3, "hours", None)], PATCH), lists=("hours",))
    assert [r.entity_id for r in store.read(spark).collect()] == [5]
    assert store.merge(spark.createDataFrame([], PATCH)) == []


def brute_intervals(rows):
    """(term_id, parent, low, high, depth) by walking down from the roots."""
    ids = {r[0] for r in rows}
    children = {}
    for i, _, name, _, parent in rows:
        children.setdefault(parent if parent in ids else None, []).append((name is not None, name or "", i, parent))
    out, n = [], 0

    def walk(at, depth):
        nonlocal n
        for _, _, i, parent in sorted(children.get(at, [])):
            n += 1
            low = n
            walk(i, depth + 1)
            out.append((i, parent, low, n, depth))

    walk(None, 0)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals(spark, seed):
    r = random.Random(seed)
    rows = [(i, "location", r.choice("abcdef") + str(r.randint(0, 3)), None, r.choice([None, 9999, *range(i)]) if i else None) for i in range(120)]
    rows += [(200 + i, "location", "z", None, 199 + i if i else 3) for i in range(40)]  # a long chain
    loops = [(300, "location", "x", None, 301), (301, "location", "y", None, 300), (302, "location", None, None, 301)]
    labels = intervals(spark.createDataFrame(r.sample(rows + loops, len(rows) + 3), TERM))
    want = brute_intervals(rows)
    assert rows_of(labels.select("term_id", "parent", "low", "high", "depth")) == sorted(want, key=repr)
    low = {i: (a, b) for i, _, a, b, _ in want}
    for top in (0, 3, 239, 300):
        inside = sorted(i for i, (a, _) in low.items() if top in low and low[top][0] <= a <= low[top][1])
        assert sorted(x.term_id for x in below(labels, top).collect()) == inside
        assert below(labels, top, itself=False).count() == max(0, len(inside) - 1)
    links = [(e, i) for e in range(60) for i in r.sample(sorted(low), 2)]
    df = spark.createDataFrame(links, "entity_id long, term_id long")
    inside = lambda top: {i for i, (a, _) in low.items() if low[top][0] <= a <= low[top][1]}
    assert {x.term_id: (x.n_terms, x.n_links) for x in subtree_counts(labels, df).collect()} == {t: (len(inside(t)) - 1, sum(i in inside(t) for _, i in links)) for t in low}
    assert sorted(x.entity_id for x in entities_below(labels, df, 3).collect()) == sorted({e for e, i in links if i in inside(3)})
    assert intervals(spark.createDataFrame([], TERM)).count() == 0


def test_import_into_terms(spark):
    """Terms and attributes of an import; the same import again adds nothing, whatever it is cut into."""
    from dirlake.operators import details, ingest
    from dirlake.sources.csv import parse_lines

    lines = ["Türkiye,İzmir,Konak", "turkey,Ankara,Çankaya", "Türkiye,izmir,Bornova", 'Fransa,Paris,x,"48,8","2,3"', "Fransa,PARIS,,49,3", "Fransa,Lyon", "Yeni,İzmir,,1,2"]
    rows = parse_lines(spark.createDataFrame(list(enumerate(lines)), "line_no long, line string"))
    old = spark.createDataFrame([(7, "location", "Fransa", "fransa", None), (9, "sector", "Paris", "paris", None), (8, "location", "Paris!", "p", 7)], TERM)
    meta_schema = "meta_id bigint, term_id bigint, key string, value string"
    known = spark.createDataFrame([(4, 8, "map_lat", "1"), (5, 8, "color", "red")], meta_schema)
    terms, attributes = ingest.import_terms(rows, old, known)
    got = {r.term_id: (r.name, r.parent) for r in terms.collect()}
    assert {i: got[i] for i in (7, 8, 9)} == {7: ("Fransa", None), 8: ("Paris!", 7), 9: ("Paris", None)}
    new = {i: x for i, x in got.items() if i > 9}
    assert sorted(new) == list(range(10, 10 + len(new))) and all(p is None or p < i for i, (_, p) in got.items())
    named = {n: i for i, (n, _) in new.items()}
    assert set(named) >= {"Türkiye", "turkey", "Konak", "Bornova", "Çankaya", "Lyon", "Yeni"} and len(new) == 10
    assert got[named["Bornova"]][1] == got[named["Konak"]][1] and got[got[named["Konak"]][1]] == ("İzmir", named["Türkiye"])
    read = {r.term_id: (r.type, r.lat, r.lng) for r in details.location_details(terms, attributes).collect()}
    assert read[8] == ("city", "49", "3") and read[7] == ("country", "", "") and read[named["Konak"]] == ("district", "", "")
    again, same = ingest.import_terms(rows, spark.createDataFrame(terms.collect(), TERM), spark.createDataFrame(attributes.collect(), meta_schema))
    assert rows_of(again) == rows_of(terms) and rows_of(same) == rows_of(attributes)
    assert attributes.where("meta_id = 4").first().value == "49" and attributes.count() == attributes.select("meta_id").distinct().count()


def test_accounts_again(spark):
    from dirlake.operators import submit

    fields = "id long, email string, firstName string, lastName string, phone string, accountType string, companyName string, taxOffice string, taxNumber string, sector string"
    row = lambda i, e: (i, e, "Ada King", None, "1", None, None, None, None, None)
    rows = spark.createDataFrame([row(500, "b@x.org"), row(400, "a@x.org"), row(600, "k@x.org"), row(700, "a@x.org")], fields)
    schema = "id bigint, login string, email string, first_name string, last_name string, display_name string"
    users = spark.createDataFrame([(3, "k@x.org", "k@x.org", "K", "", "K")], schema)
    none = spark.createDataFrame([], "meta_id bigint, user_id bigint, key string, value string")
    accounts, attributes = submit.create_accounts(rows, users, none)
    assert {(r.id, r.email) for r in accounts.collect()} == {(3, "k@x.org"), (4, "a@x.org"), (5, "b@x.org")}
    assert rows_of(attributes) == [(1, 4, "phone", "1"), (2, 5, "phone", "1")]
    again, same = submit.create_accounts(rows, spark.createDataFrame(accounts.collect(), schema), spark.createDataFrame(attributes.collect(), attributes.schema))
    assert rows_of(again) == rows_of(accounts) and rows_of(same) == rows_of(attributes)
