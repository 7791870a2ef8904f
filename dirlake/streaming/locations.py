"""Location files as a stream: each micro-batch is merged into a table, and a batch that comes twice changes nothing.

The table lies in buckets by path; a batch rewrites the buckets of its locations only. Once a batch's rows are there, its
counts go to the ledger, a folder for each batch. A batch that the ledger has is left out. One that was lost before that comes
again from Spark's checkpoint and is merged again, which gives the same rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dirlake.operators.ingest import counted, judged, location_terms, merge_locations, quarantine
from dirlake.sources.buckets import Buckets
from dirlake.sources.csv import checked_lines
from dirlake.sources.lines import LocationLines
from dirlake.sources.shared import cut, drop, exists

LOCATION = "path string, level string, name string, parent_path string, lat string, lng string"
LEDGER = "submitted bigint, accepted bigint, rejected bigint, malformed bigint, source string, batch bigint"


class Import:
    """Merges batches of lines into a catalogue table, whose files, ledger and set-aside lines lie below folder."""

    def __init__(self, spark: SparkSession, table: str, checkpoint: str, folder: str | None = None, buckets: int = 64, strict: bool = False):
        self.session, self.table, self.strict = spark, table, strict
        self.folder = folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{table}-import"
        self.source = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]  # batches are numbered by checkpoint
        self.store = Buckets(f"{self.folder}/locations", LOCATION, ("path",), buckets)

    def ledger(self, spark: SparkSession) -> DataFrame:
        """Counts of each batch that is done: its reply."""
        return spark.read.schema(LEDGER).parquet(f"{self.folder}/ledger")

    def rejected(self, spark: SparkSession) -> DataFrame:
        """line_no, line, error, accepted of the lines that were set aside or are malformed."""
        return spark.read.parquet(f"{self.folder}/rejected")

    def merge(self, lines: DataFrame, number: int) -> None:
        """One batch of lines (line_no, line)."""
        spark = lines.sparkSession
        if exists(spark, f"{self.folder}/ledger/source={self.source}/batch={number}/_done"):
            return
        rows, counts = counted(judged(checked_lines(lines), self.strict))
        rows = cut(rows, "batch")  # the one pass over the lines, which counts them
        self._merge_rows(rows.where("accepted"))
        self._publish(spark)
        self._set_aside(quarantine(rows), number)
        self._enter(spark, {} if rows.isEmpty() else counts.get, number)
        drop(rows)

    def _merge_rows(self, rows: DataFrame) -> None:
        new = location_terms(rows)
        if exists(rows.sparkSession, self.store.path):
            self.store.merge(new, merge_locations)
        else:
            self.store.create(new)

    def _publish(self, spark: SparkSession) -> None:
        if not spark.catalog.tableExists(self.table):
            spark.sql(f"CREATE TABLE {self.table} ({LOCATION}, bucket int) USING parquet PARTITIONED BY (bucket) LOCATION '{self.store.path}'")
        spark.catalog.recoverPartitions(self.table)
        for session in (spark, self.session):  # a stream's batches have a session of their own; other applications refresh by themselves
            session.catalog.refreshTable(self.table)

    def _set_aside(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/rejected/source={self.source}/batch={number}")

    def _enter(self, spark: SparkSession, counts: dict, number: int) -> None:
        at = f"{self.folder}/ledger/source={self.source}/batch={number}"
        row = {k: int(counts.get(k, 0)) for k in ("submitted", "accepted", "rejected", "malformed")}
        spark.range(1).select(*[F.lit(v).cast("bigint").alias(k) for k, v in row.items()]).coalesce(1).write.mode("overwrite").parquet(at)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_done")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True).close()


def import_locations(spark: SparkSession, files: str, table: str, checkpoint: str, per_batch: int = 50, folder: str | None = None, **settings: object) -> StreamingQuery:
    """Starts importing text files of CSV lines into a catalogue table, per_batch files at a time, until none is left.

    Lines of a batch go by file name, then place. folder (by default below the warehouse) keeps table and ledger.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", per_batch).text(files).select(F.col("value").alias("line"), F.input_file_name().alias("file"))
    place = F.struct("file", F.monotonically_increasing_id().alias("place"))
    return _started(lines, Import(spark, table, checkpoint, folder, **settings), place, checkpoint, availableNow=True)


def import_rows(spark: SparkSession, files: str, table: str, checkpoint: str, rows: int = 50, folder: str | None = None, **settings: object) -> StreamingQuery:
    """Starts importing the lines of a folder's files, rows lines a batch, the first line of each file left out.

    The query goes on with files that come later; finish() ends it once all lines that are there have been merged.
    """
    spark.dataSource.register(LocationLines)
    lines = spark.readStream.format("location_lines").option("rows", rows).load(files)
    return _started(lines, Import(spark, table, checkpoint, folder, **settings), F.struct("file", "place"), checkpoint, processingTime="0 seconds")


def finish(query: StreamingQuery) -> None:
    query.processAllAvailable()
    query.stop()


def _started(lines: DataFrame, to: Import, place: Column, checkpoint: str, **trigger: object) -> StreamingQuery:
    def merge(batch: DataFrame, number: int) -> None:
        to.merge(batch.select(place.alias("line_no"), "line"), number)

    return lines.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**trigger).start()
