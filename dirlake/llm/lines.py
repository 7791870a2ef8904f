"""Operator 7: near-duplicate lines by MinHash, with DataFrame functions only.

Signature. Every place of a distinct line gives a shingle of `chars` characters. One pass over their hashes keeps, for
each of 2 * BANDS prefixes, the hash nearest to it by exclusive or: the least one with that prefix, if there is any. Two
of these minima are a band. At a Jaccard similarity of 0.8 of five-character shingles, lines with single letters changed
all over have one of 0.58 for 12 characters, so a band agrees with 0.58^2 and one of 12 with 0.99. Lines with few different
five-character shingles have bands of these as well, of three minima each: 1 - (1 - 0.8^3)^8 = 0.997.

Verification. A band first pairs its lines with the one of most copies. The five-character shingles of pairs are compared
exactly. Lines of bands that aren't all linked by then meet once more by pairs of bands, each with a leader drawn by
hash. No step makes all pairs of a band. Each component of linked lines keeps its first line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .storage import bucketed, written

#: Bands of long shingles, and places whose hashes are compared before they meet the minima of their line.
BANDS, AT_ONCE = 12, 4
#: Lines of fewer characters than FEW have bands of five-character shingles too; so do those made of repetitions, those of no more
#: than four different characters in one of the stretches looked at, and those of LONG characters with no more than LETTERS.
FEW, LONG, LETTERS = 64, 4096, 12
STRETCHES = r"(?s)(.{20}).{0,80}"
FOUR_LETTERS = r"(?s)^(.)\1*+(?:(.)(?:\1|\2)*+(?:(.)(?:\1|\2|\3)*+(?:(.)(?:\1|\2|\3|\4)*+)?+)?+)?+$"


def trimmed(line: Column) -> Column:
    """The line without blanks at its ends; btrim goes through all of a line, so it sees only those that have some."""
    blanks = " \t\r"
    some = [f(line, F.lit(c)) for f in (F.startswith, F.endswith) for c in blanks]
    return F.when(reduce(Column.__or__, some), F.btrim(line, F.lit(blanks))).otherwise(line)


def line_id(line: Column) -> Column:
    """The number that groups equal lines."""
    return F.xxhash64(line)


def shingles(line: Column, size: int) -> Column:
    """Hashes of the shingles of a line that has size characters or more, at every place; four bytes are one character."""
    at = lambda u: F.sequence(F.lit(1), F.octet_length(u) - (4 * size - 1), F.lit(4))
    each = lambda u: F.transform(at(u), lambda i: F.xxhash64(F.substring(u, i, F.lit(4 * size))))
    return F.transform(F.array(F.encode(line, "UTF-32")), each)[0]


def has_few(line: Column) -> Column:
    """Whether a line is short, or little is left without the string that it begins with, or it is of few letters somewhere."""
    first = lambda n: F.substring(line, 1, n)
    again = lambda n: (F.char_length(line) < FEW + 2 * n) | F.contains(F.substring(line, n + 1, FEW + n - 1), first(n))  # noqa: E731  (else FEW of these stay)
    rest = [again(n) & (F.char_length(F.replace(line, first(n), F.lit(""))) < FEW) for n in (5, 12)]
    stretch = F.exists(F.regexp_extract_all(line, F.lit(STRETCHES), F.lit(1)), lambda x: x.rlike(FOUR_LETTERS))
    plain = F.when(F.char_length(line) >= LONG, F.size(F.array_distinct(F.split(line, ""))) <= LETTERS).otherwise(F.lit(False))
    return (F.char_length(line) < FEW) | rest[0] | rest[1] | stretch | plain


def signatures(distinct: DataFrame, size: int, chars: int) -> DataFrame:
    """id, copies and bands of each distinct line (id, copies, line)."""
    sizes = F.array(F.when(F.char_length("line") >= chars, chars), F.when(has_few(F.col("line")), size))
    own = distinct.where(F.char_length("line") >= size).select("id", "copies", F.encode("line", "UTF-32").alias("u"), F.explode(F.array_compact(sizes)).alias("size"))
    last = F.octet_length("u") - 4 * F.col("size") + 1
    each = own.select("id", "copies", "size", "u", last.alias("last"), F.explode(F.sequence(F.lit(1), last, F.lit(4 * AT_ONCE))).alias("at"))
    places = [F.least(F.col("at") + 4 * i, "last") for i in range(AT_ONCE)]
    each = each.select("id", "copies", "size", *[F.xxhash64(F.substring("u", p, 4 * F.col("size"))).alias(f"x{i}") for i, p in enumerate(places)])
    prefixes = [((k * 23 + 5) % 64 << 58) - (1 << 63) for k in range(2 * BANDS)]  # the sign bit makes the order that of unsigned numbers
    nearest = [F.least(*[F.col(f"x{i}").bitwiseXOR(F.lit(p)) for i in range(AT_ONCE)]) for p in prefixes]
    least = each.groupBy("id", "copies", "size").agg(*[F.min(x).alias(f"h{k}") for k, x in enumerate(nearest)])
    pairs = F.array(*[F.xxhash64(F.lit(b), f"h{2 * b}", f"h{2 * b + 1}") for b in range(BANDS)])
    triples = F.array(*[F.xxhash64(F.lit(-1 - b), f"h{b}", f"h{b + 8}", f"h{b + 16}") for b in range(8)])
    return least.select("id", "copies", F.when(F.col("size") == chars, pairs).otherwise(triples).alias("bands"))


def led(entries: DataFrame, order: Column) -> DataFrame:
    """Entries of the bands with several lines, each with its band's leader: the line of the greatest order. Other columns stay."""
    others = [c for c in entries.columns if c == "c"]
    best = entries.groupBy("band").agg(F.max_by("id", order).alias("leader"), F.count("*").alias("m"), *[F.max_by(c, order).alias(f"leader_{c}") for c in others])
    return entries.drop("leader", "m").join(best.where("m > 1"), "band")


def duplicate_lines(docs: DataFrame, min_chars: int = 1, size: int = 5, percent: int = 80, chars: int = 12) -> DataFrame:
    """key and removed (array of line numbers from 0) of each row of docs (key, doc_id, text) that loses lines.

    Lines of fewer than min_chars characters are never compared; 1 lets in all but blank ones. Of equal lines and of linked ones the first stays, by
    doc_id (null first), key and place. Lines of fewer than size characters have no shingle and match equal ones only. Lines are told
    by 64 bits; one whose other 64 bits aren't those of the line that stands for its group stays in any case.
    """
    lines = docs.select("key", "doc_id", F.posexplode(F.split(F.lower("text"), "\n")).alias("place", "line")).select("key", "doc_id", "place", trimmed(F.col("line")).alias("line"))
    lines = lines.where(F.char_length("line") >= min_chars).select("key", "doc_id", "place", "line", line_id(F.col("line")).alias("id"), F.xxhash64(F.lit(1), "line").alias("check"))
    distinct = lines.groupBy("id").agg(F.min(F.struct("doc_id", "key", "place", "line")).alias("first"), F.count("*").alias("copies"))
    distinct = bucketed(distinct.select("id", "copies", F.struct("first.doc_id", "first.key", "first.place").alias("first"), "first.line"), "lines", "id")
    texts = distinct.select("id", "line")

    def verified(pairs: DataFrame, but: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The linked ones of pairs, and all that were compared: each once, in one direction, and none of but."""
        pairs = pairs.toDF("x", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        pairs = written(pairs if but is None else pairs.join(but, ["a", "b"], "left_anti"), "line-pairs")
        both = pairs.join(texts.toDF("b", "line_b"), "b").join(texts.toDF("a", "line_a"), "a")
        both = both.select("a", "b", shingles(F.col("line_a"), size).alias("x"), shingles(F.col("line_b"), size).alias("y"))
        both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), F.size(F.array_union("x", "y")).alias("all"))
        return written(both.where(f"shared * 100 >= all * {percent}").select("a", "b"), "line-links"), pairs

    def mixed(entries: DataFrame, links: DataFrame) -> DataFrame:
        """Entries of the bands whose lines aren't all in one component, with it (c)."""
        own = entries.join(components(links), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        spread = own.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("band")
        return written(own.join(spread, "band"), "mixed")

    signed = written(signatures(distinct, size, chars), "signatures")
    entries = signed.select("id", "copies", F.explode("bands").alias("band"))
    met = entries.groupBy("band").agg(F.count("*").alias("m")).where("m > 1").select("band")
    rank = F.shiftleft(F.least("copies", F.lit((1 << 20) - 1)), 40).bitwiseOR(F.col("id").bitwiseAND(F.lit((1 << 40) - 1)))  # more copies first
    entries = written(entries.join(met, "band").select("id", "band", rank.alias("rank")), "bands", (signed,))
    entries = written(led(entries, F.col("rank")), "led", (entries,))
    links, compared = verified(entries.where("id <> leader").select("leader", "id"))
    left = mixed(entries.where("m > 2"), links)
    both = left.groupBy("id", "c").agg(F.sort_array(F.collect_list("band")).alias("bands"))  # at most a line's bands
    both = both.select("id", "c", F.explode(F.flatten(F.transform("bands", lambda x, i: F.transform(F.slice("bands", i + 2, F.size("bands")), lambda y: F.xxhash64(x, y))))).alias("band"))
    more = led(both, F.xxhash64("id", "band")).where("c <> leader_c").select("leader", "id")
    joined = components(links.union(verified(more, compared)[0]))

    own = distinct.select("id", "copies", "first", F.xxhash64(F.lit(1), "line").alias("of"))
    of = own.join(joined, "id")
    of = of.select("id", "of", "component").join(of.groupBy("component").agg(F.min("first").alias("kept")), "component").select("id", F.col("of").alias("of_linked"), "kept")
    kept = own.where("copies > 1").select("id", "of", "first").join(of, "id", "full").select("id", F.coalesce("of", "of_linked").alias("of"), F.coalesce("kept", "first").alias("kept"))
    gone = lines.select("id", "check", "key", "doc_id", "place").join(kept, "id").where((F.col("check") == F.col("of")) & ~F.struct("doc_id", "key", "place").eqNullSafe(F.col("kept")))
    return gone.groupBy("key").agg(F.sort_array(F.collect_list("place")).alias("removed"))  # at most a document's lines


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that tell a document by its doc_id and text; nulls count as values of their own."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.when(text.isNull(), ".").otherwise(":"), F.coalesce(text, F.lit("")))
    return F.unhex(F.md5(whole))


def dedup_lines(docs: DataFrame, **settings: int) -> tuple[DataFrame, str]:
    """docs without the duplicate lines of column text, and one more column, whose name is returned: the removed line numbers.

    A null text stays null, an empty one empty; equal rows (same doc_id and text) are taken for one document and lose
    the same lines. Lines end at line feeds; the lines that stay are joined by line feeds. Other columns stay.
    """
    names = {"key": "key", "removed": "removed"}
    for n in names:
        while names[n] in docs.columns:
            names[n] += "_"
    key, removed = names["key"], names["removed"]
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    gone = duplicate_lines(keyed.select(F.col(key).alias("key"), "doc_id", "text"), **settings)
    out = keyed.join(gone.toDF(key, removed), key, "left")
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(removed), i)), "\n")
    text = F.when(F.col(removed).isNull(), F.col("text")).otherwise(rest)
    return out.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.coalesce(removed, F.array().cast("array<int>")).alias(removed)), removed


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_removed, removed line numbers and remaining text of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out, removed = dedup_lines(docs)
    return out.select("doc_id", F.size(removed).cast("long").alias("n_removed"), F.col(removed).alias("removed"), "text")
