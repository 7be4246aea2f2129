"""Scan ingest with an idempotent receiver, and what is kept up to date from it: the registry, contradictions and the fleet's summary.

Every stream ends in tables. A batch that is sent again, by a restart, a new checkpoint or a device that repeats itself,
changes nothing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from packlens.operators.fleet import DAY_MS, VERDICTS, conflict_lists, product_key, scan_scope, summary_of, summary_rows, time_range
from packlens.sources.folders import read_file
from packlens.sources.keyed import KeyedTable, newest, summed


def first_copies(scans: DataFrame, order: list[str]) -> DataFrame:
    """Batch form: one row an id, the first by `order`."""
    return scans.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("r = 1").drop("r")


#: Ids are dealt into so many folders, so that a batch rereads those of its own ids' folders only.
ID_FOLDERS = 64
#: Names the batch that added a row, where rows are stamped.
STAMP = ("by_stream", "by_batch")


def insert_new(spark: SparkSession, batch: DataFrame, path: str, order: list[str], folders: int = ID_FOLDERS, stamp: tuple[str, int] | None = None) -> DataFrame | None:
    """Adds the valid rows of a batch whose ids the folder lacks; rows lie in `part=` folders by their id's hash.

    A batch that runs again adds nothing; writers must not run at once. stamp: the stream and the batch's number; then the rows
    that this batch has added are returned, in this run or in one before it that did not get to its end.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(folders)).cast("int")
    fresh = first_copies(batch.where(F.col("verdict").isin(*VERDICTS)), order).withColumn("part", part)
    if stamp:
        fresh = fresh.withColumns({name: F.lit(value) for name, value in zip(STAMP, stamp, strict=True)}).withColumn(STAMP[1], F.col(STAMP[1]).cast("long"))
    touched = [r["part"] for r in fresh.select("part").distinct().collect()]  # at most `folders` numbers
    known = _read(spark, path, fresh.select("part", "id").schema)
    added = fresh
    if known is not None:
        added = fresh.join(known.where(F.col("part").isin(touched)).select("id"), "id", "left_anti")
    added.write.mode("append").partitionBy("part").parquet(path)
    if not stamp:
        return None
    own = spark.read.schema(fresh.schema).parquet(path) if touched else fresh
    return own.where(F.col("part").isin(touched) & (F.col(STAMP[0]) == stamp[0]) & (F.col(STAMP[1]) == stamp[1])).drop("part", *STAMP)


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The folder as a table, None where it is not there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _each_batch(stream: DataFrame, checkpoint: str, run) -> StreamingQuery:
    """Runs what is there and stops. run(batch, source, number): the source is the id that the checkpoint keeps, so a new checkpoint is a new source."""

    def batch(rows: DataFrame, number: int) -> None:
        own = json.loads(read_file(rows.sparkSession, f"{checkpoint.rstrip('/')}/metadata"))["id"]
        run(rows, own, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_scan_ingest(stream: DataFrame, path: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Runs what is there and stops; re-sends of any age are ignored."""
    return _each_batch(stream, checkpoint, lambda batch, source, n: insert_new(batch.sparkSession, batch, path, order) and None)


def stream_verdict_counts(stream: DataFrame, name: str) -> StreamingQuery:
    """Counts over everything received so far, in a memory table: four rows."""
    return stream.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()


def registry_table(spark: SparkSession, path: str, schema: StructType) -> KeyedTable:
    """The registry by sku: the newest row by saved_at, of equally new ones the incoming."""
    return KeyedTable(spark, path, schema, ["sku_id"], newest(["sku_id"], "saved_at"))


def stream_registry_upsert(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Merges the stream into `registry_table`, which any number of streams can feed one after another."""
    return _each_batch(stream, checkpoint, lambda batch, source, n: registry_table(batch.sparkSession, path, batch.schema).merge(batch, source, n) and None)


@dataclass
class Fleet:
    """Scans under a folder, each id once, and what is kept of them: contradictions by product and sums by day and device.

    `scans` (schema) has id, device_id, scanned_at, verdict, sku_id, brand, mrp and net_quantity, and checks (rule_id, status) where rules are counted. A
    product's state is one row a (field, value) with its first sighting; a day's state has a row a (device, verdict), (device, product) and (device, rule). A
    bucket of the sums holds `days` days of one of `parts` shares of the devices, so a batch of today's scans rewrites `parts` buckets.
    """

    spark: SparkSession
    root: str
    scans: StructType
    order: list[str]
    days: int = 32
    parts: int = 4
    folders: int = ID_FOLDERS
    conflict_state: KeyedTable = field(init=False)
    summary_state: KeyedTable = field(init=False)

    def __post_init__(self) -> None:
        kind = lambda c: self.scans[c].dataType.simpleString()
        first = f"product string, field string, value string, at struct<scanned_at: {kind('scanned_at')}, id: {kind('id')}>, n long"
        self.conflict_state = KeyedTable(self.spark, f"{self.root}/conflicts", first, ["product"], summed(["product", "field", "value"], at=F.min))
        sums = f"day int, device_id {kind('device_id')}, kind string, key string, n long"
        dealt = F.floor(F.col("day") / self.days).cast("int") * self.parts + F.pmod(F.xxhash64("device_id"), F.lit(self.parts)).cast("int")
        self.summary_state = KeyedTable(self.spark, f"{self.root}/summary", sums, dealt, summed(["day", "device_id", "kind", "key"]))

    def add(self, batch: DataFrame, source: str, number: int) -> None:
        """Adds a batch of a stream: new scans, then what they change in both states. Each of the three steps knows what it has done before."""
        added = insert_new(self.spark, batch.select(*self.scans.names), f"{self.root}/scans", self.order, self.folders, stamp=(source, number))
        self.conflict_state.merge(first_sightings(added), source, number)
        self.summary_state.merge(summary_rows(added), source, number)

    def conflicts(self) -> DataFrame:
        """The rows of `product_conflicts` over everything received so far."""
        return conflicts_of(self.conflict_state.read())

    def summary(self, role: str = "INSPECTOR", own_device: int = 0, device: int | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
        """`fleet_report` in a scope and a range of scanned_at, both ends included.

        Whole days come from the state, of which only their buckets are read; scans are read for the one or two days that the range cuts.
        """
        first = None if since is None else -(-since // DAY_MS)
        behind = None if until is None else (until + 1) // DAY_MS
        begins = lambda b: b // self.parts * self.days
        touched = lambda b: (first is None or begins(b) + self.days > first) and (behind is None or begins(b) < behind)
        rows = scan_scope(self.summary_state.read(touched), role, own_device, device)
        rows = rows.where(F.lit(True) if first is None else F.col("day") >= first).where(F.lit(True) if behind is None else F.col("day") < behind)
        cut = [d for d in {None if since is None or since % DAY_MS == 0 else since // DAY_MS, None if until is None or (until + 1) % DAY_MS == 0 else until // DAY_MS} if d is not None]
        held = _read(self.spark, f"{self.root}/scans", self.scans) if cut else None
        if held is not None:
            scans = time_range(scan_scope(held, role, own_device, device), since, until)
            in_cut = F.lit(False)
            for d in cut:
                in_cut = in_cut | F.col("scanned_at").between(d * DAY_MS, (d + 1) * DAY_MS - 1)
            rows = rows.unionByName(summary_rows(scans.where(in_cut)))
        return summary_of(rows)


def first_sightings(scans: DataFrame) -> DataFrame:
    """product, field, value, at (scanned_at, id: the first sighting) and n; the field '' counts the product's scans."""
    entry = lambda name, value: F.struct(F.lit(name).alias("field"), value.alias("value"))
    said = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    entries = F.array(entry("", F.lit("")), entry("mrp", said("mrp")), entry("net_quantity", said("net_quantity")))
    each = scans.select(product_key().alias("product"), F.struct("scanned_at", "id").alias("at"), F.explode(entries).alias("e")).where("product is not null and e.value is not null")
    return each.groupBy("product", "e.field", "e.value").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))


def conflicts_of(sightings: DataFrame) -> DataFrame:
    """`first_sightings` to the rows of `product_conflicts`."""
    return conflict_lists(sightings.select("product", "field", F.col("value").alias("same"), F.struct("at", "value").alias("first"), "n"), "")


def stream_fleet(stream: DataFrame, fleet: Fleet, checkpoint: str) -> StreamingQuery:
    """Adds what is there to the fleet's tables and stops: contradictions and summary are then read from them."""
    return _each_batch(stream, checkpoint, fleet.add)
