"""Streamed imports: fifty lines a batch, lost runs, batches that come again, lines that are set aside."""

import random

import pytest

from dirlake.operators import ingest
from dirlake.sources.csv import checked_lines, parse_lines
from dirlake.sources.lines import LineReader
from dirlake.streaming import locations
from dirlake.streaming.locations import Import, finish, import_rows


def city_lines(n, seed=0):
    r = random.Random(seed)
    return [f"{r.choice(['Fransa', 'fransa', 'İtalya'])},City{r.randint(0, 30)},x,{r.randint(0, 50)},{r.randint(0, 50)}" if r.random() < 0.7 else f"Türkiye,Şehir{r.randint(0, 9)},İlçe{r.randint(0, 9)}" for _ in range(n)]


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("country,city,district,lat,lng\n" + "\n".join(lines) + "\n", encoding="utf-8")


def table_rows(spark, name):
    return sorted(map(tuple, spark.table(name).drop("bucket").collect()), key=repr)


def at_once(spark, lines):
    rows = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    return sorted(map(tuple, ingest.location_terms(parse_lines(rows)).collect()), key=repr)


def test_lines_of_a_batch(tmp_path):
    """Offsets lie behind a fixed number of lines, across files, blank lines and headers."""
    write(tmp_path, "a.csv", [f"a{i}" for i in range(7)] + ["", " "])
    write(tmp_path, "b.csv", [f"b{i}é" for i in range(4)])
    (tmp_path / "c.csv").write_text("header only")
    (tmp_path / "d.csv").write_text("h\nlast, without line feed")
    reader, at, found = LineReader(str(tmp_path), 3), None, []
    at = reader.initialOffset()
    while (to := reader.latestOffset()) != at:
        found.append([x[2] for p in reader.partitions(at, to) for x in reader.read(p)])
        at = to
    assert [len(x) for x in found] == [3, 3, 3, 3]
    assert sum(found, []) == [f"a{i}" for i in range(7)] + [f"b{i}é" for i in range(4)] + ["last, without line feed"]
    write(tmp_path, "e.csv", ["e0"])
    again = LineReader(str(tmp_path), 3)
    again.partitions({"file": "", "byte": 0}, at)  # what Spark asks first when a query starts again
    to = again.latestOffset()
    assert [x[2] for p in again.partitions(at, to) for x in again.read(p)] == ["e0"]


def test_fifty_rows(spark, tmp_path):
    lines = city_lines(230)
    write(tmp_path / "in", "a.csv", lines[:120])
    write(tmp_path / "in", "b.csv", lines[120:])
    args = (spark, str(tmp_path / "in"), "fifty", str(tmp_path / "at"))
    finish(import_rows(*args, folder=f"file://{tmp_path}/out"))
    own = Import(spark, "fifty", str(tmp_path / "at"), f"file://{tmp_path}/out")
    assert [r.submitted for r in own.ledger(spark).orderBy("batch").collect()] == [50, 50, 50, 50, 30]
    assert table_rows(spark, "fifty") == at_once(spark, lines)
    write(tmp_path / "in", "c.csv", city_lines(20, 1))
    finish(import_rows(*args, folder=f"file://{tmp_path}/out"))
    assert table_rows(spark, "fifty") == at_once(spark, lines + city_lines(20, 1))
    assert own.ledger(spark).count() == 6
    spark.sql("DROP TABLE fifty")


@pytest.mark.parametrize("step", ["_merge_rows", "_publish", "_set_aside", "_enter"])
@pytest.mark.parametrize("after", [False, True])
def test_lost_batch(spark, tmp_path, monkeypatch, step, after):
    """A run that is lost in the middle, before or after any step, goes on to the same table and ledger."""
    lines = city_lines(90, 3)
    write(tmp_path / "in", "a.csv", lines)
    name, args = f"lost_{step}_{after}".lower(), (str(tmp_path / "in"), str(tmp_path / "at"))
    real, calls = getattr(Import, step), []

    def lost(self, *a):
        calls.append(1)
        if len(calls) == 2 and not after:
            raise RuntimeError("lost")
        real(self, *a)
        if len(calls) == 2:
            raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Import, step, lost)
        query = import_rows(spark, args[0], name, args[1], rows=40, folder=f"file://{tmp_path}/out", buckets=4)
        with pytest.raises(Exception, match="lost"):
            query.processAllAvailable()
    finish(import_rows(spark, args[0], name, args[1], rows=40, folder=f"file://{tmp_path}/out", buckets=4))
    assert table_rows(spark, name) == at_once(spark, lines)
    ledger = Import(spark, name, args[1], f"file://{tmp_path}/out").ledger(spark).orderBy("batch").collect()
    assert [(r.batch, r.submitted, r.accepted) for r in ledger] == [(0, 40, 40), (1, 40, 40), (2, 10, 10)]
    spark.sql(f"DROP TABLE {name}")


def test_batch_again(spark, tmp_path):
    """A batch that the ledger has changes nothing, even if later ones have moved its city since."""
    import glob

    left = lambda: {f for x in ("batch", "patch") for f in glob.glob(f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/{x}-*")}
    before = left()
    own = Import(spark, "again", "checkpoint", f"file://{tmp_path}/out", buckets=4)
    batch = lambda *x: spark.createDataFrame(list(enumerate(x)), "line_no long, line string")
    own.merge(batch("Fransa,Paris,,1,1"), 0)
    own.merge(batch("Fransa,PARIS,,2,2"), 1)
    own.merge(batch("Fransa,Paris,,1,1"), 0)
    assert [(r.name, r.lat) for r in spark.table("again").where("level = 'city'").collect()] == [("Paris", "2")]
    own.merge(batch(), 2)
    assert own.ledger(spark).where("batch = 2").first().submitted == 0
    assert left() == before  # nothing stays behind but the table, its ledger and its rejected lines
    spark.sql("DROP TABLE again")


def test_only_its_buckets(spark, tmp_path):
    import glob

    own = Import(spark, "few_buckets", "c", f"file://{tmp_path}/out", buckets=32)
    batch = lambda *x: spark.createDataFrame(list(enumerate(x)), "line_no long, line string")
    own.merge(batch(*city_lines(300)), 0)
    files = lambda: set(glob.glob(f"{tmp_path}/out/locations/bucket=*/*.parquet"))
    before = files()
    own.merge(batch("Fransa,City1,,9,9"), 1)
    assert len({f.split("bucket=")[1].split("/")[0] for f in before ^ files()}) == 2  # of the country and of the city
    spark.sql("DROP TABLE few_buckets")


MALFORMED = ["Fransa,Paris,,1,2", 'Fransa,"Ly,on,,1,2', "Fransa,Nice,,1,2,3", 'Fransa,"A,B",,1,2', 'Fransa,"say ""hi"", you",,1,2', "Fransa,Nice", "0,x", " ,y", "ülke,şehir", "", 'Fransa,"a,b,c,d,e,f,g"', "Fransa,Nice,,1,2,"]


@pytest.mark.parametrize("strict", [False, True])
def test_quarantine(spark, strict):
    rows = spark.createDataFrame(list(enumerate(MALFORMED)), "line_no long, line string")
    rows, counts = ingest.counted(ingest.judged(checked_lines(rows), strict))
    kept = rows.collect()  # the pass that counts
    found = {r.line_no: (r.error, r.accepted) for r in kept if r.error}
    assert found == {1: ("quotes", not strict), 2: ("long", not strict), 6: ("country", False), 7: ("country", False), 8: ("header", False), 11: ("long", not strict)}
    assert {r.line_no: r.line for r in kept}[1] == MALFORMED[1]
    assert counts.get == {"submitted": 11, "accepted": 5 if strict else 8, "rejected": 6 if strict else 3, "malformed": 3}
    assert {r.line_no: (r.city, r.lat) for r in kept}[3] == ("A,B", "1") and {r.line_no: r.city for r in kept}[4] == 'say "hi", you'
    assert ingest.quarantine(rows).columns == ["line_no", "line", "error", "accepted"]


def test_ledger_is_by_checkpoint(spark):
    assert Import(spark, "t", "a").source != Import(spark, "t", "b").source and locations.LEDGER.endswith("batch bigint")
