"""Streams that end in tables: restarts, new checkpoints, re-sends and batches out of order leave what one batch query finds."""

import random

import pytest
from pyspark.sql import functions as F

from packlens.operators import fleet, match
from packlens.sources.folders import listed, make_file
from packlens.sources.keyed import KeyedTable, newest
from packlens.streaming import ingest

SKU = "sku_id string, brand string, mrp string, net_quantity string, source string, saved_at long"
SCAN = "id long, device_id long, scanned_at long, verdict string, sku_id string, brand string, mrp string, net_quantity string, checks array<struct<rule_id: string, status: string>>"
DAY = fleet.DAY_MS


def streamed(spark, df, path, files=2):
    df.repartition(files).write.parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_registry_of_two_streams(spark, tmp_path):
    rows = [("s1", "A", "5", "10 g", "MANUAL", 1), ("s1", "B", "6", "10 g", "MANUAL", 3), ("s1", "C", "7", "9 g", "MANUAL", 2), ("s2", "D", "5", "1 g", "MANUAL", 1)]
    later = [("s3", "E", "5", "1 g", "MANUAL", 1), ("s2", "F", "6", "1 g", "MANUAL", 1)]
    first, second = spark.createDataFrame(rows, SKU), spark.createDataFrame(later, SKU)
    path = str(tmp_path / "registry")
    stream = streamed(spark, first, tmp_path / "a")
    ingest.stream_registry_upsert(stream, path, str(tmp_path / "c1")).awaitTermination()
    held = ingest.registry_table(spark, path, first.schema)
    assert {(r.sku_id, r.brand) for r in held.read().collect()} == {("s1", "B"), ("s2", "D")}
    ingest.stream_registry_upsert(streamed(spark, second, tmp_path / "b"), path, str(tmp_path / "c2")).awaitTermination()
    want = {("s1", "B"), ("s2", "F"), ("s3", "E")}
    assert {(r.sku_id, r.brand) for r in held.read().collect()} == want, "a second stream with its own checkpoint loses nothing"
    assert {(r.sku_id, r.brand) for r in match.registry_upsert(first, second).collect()} == want
    version = held.manifest()["version"]
    ingest.stream_registry_upsert(stream, path, str(tmp_path / "c1")).awaitTermination()
    assert held.manifest()["version"] == version, "nothing new"
    ingest.stream_registry_upsert(stream, path, str(tmp_path / "c3")).awaitTermination()
    assert {r.sku_id: r.brand for r in held.read().collect()} == {"s1": "B", "s2": "D", "s3": "E"}, "of equally new rows the one that came last"
    assert held.read().schema == first.schema


def test_keyed_table(spark, tmp_path):
    made = lambda rows: spark.createDataFrame(rows, "k string, v string, at long")
    held = KeyedTable(spark, str(tmp_path / "t"), "k string, v string, at long", ["k"], newest(["k"], "at"), 4)
    assert not held.read().count() and not held.manifest()["buckets"]
    assert held.merge(made([(f"k{i}", "a", 1) for i in range(50)]), "one", 0) and held.merge(made([("k1", "b", 0), ("k2", "b", 2)]), "one", 1)
    assert not held.merge(made([("k2", "x", 9)]), "one", 1), "a batch that was merged before"
    assert {r.k: r.v for r in held.read().where("v != 'a'").collect()} == {"k2": "b"} and held.read().count() == 50
    folders = set(held.manifest()["buckets"].values())
    assert len(folders) == 2, "buckets without a new row stay where they are"
    held.merge(made([]), "two", 0)
    assert held.read().count() == 50 and held.manifest()["applied"] == {"one": 1, "two": 0}
    make_file(spark, str(tmp_path / "t/manifest/0000000004.json"), '{"version": 4, "buck')
    assert held.manifest()["version"] == 3, "its writer died"
    assert held.merge(made([("k3", None, 5)]), "two", 1) and held.manifest()["version"] == 5
    with pytest.raises(Exception, match="(?i)exist"):
        make_file(spark, str(tmp_path / "t/manifest/0000000005.json"), "{}")
    before = rows_of(held.read())
    held.vacuum(keep=1)
    assert rows_of(held.read()) == before and len(listed(spark, str(tmp_path / "t/manifest"))) == 1
    some = held.buckets_of(made([("k7", None, 0)]))
    assert len(some) == 1 and 0 < held.read(lambda b: b in some).count() < 50
    for folder in (tmp_path / "t/data").iterdir():
        for bucket in folder.glob("bucket=*"):
            for f in bucket.iterdir():
                f.unlink()
            bucket.rmdir()
    with pytest.raises(Exception, match="(?i)not.*exist"):
        held.read().count()


def scans(spark, n, seed):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    rows = []
    for i in range(n):
        checks = [(f"R{k}", pick("PASS", "FAIL")) for k in range(rng.randint(0, 3))]
        rows.append((i, pick(1, 2, 3), rng.randrange(5 * DAY), pick("FAIL", "PASS", "NEEDS_REVIEW"), pick("s1", "s2", None, ""), pick(None, " ", "B", " C "), pick("5", " 5 ", "6|7", None, " "), pick("1 g", None), checks or None))
    return spark.createDataFrame(rows, SCAN)


def test_fleet_stream_equals_batch(spark, tmp_path):
    sent = scans(spark, 300, 1)
    odd = sent.limit(5).withColumn("verdict", F.lit("odd")).withColumn("id", F.col("id") + 1000)
    held = ingest.Fleet(spark, str(tmp_path / "fleet"), sent.schema, ["scanned_at"], days=2, parts=2, folders=4)
    assert not held.conflicts().count() and held.summary().first().total == 0
    parts = [sent.where("id % 3 = 1"), sent.where("id % 3 != 1").unionByName(odd), sent.where("id % 2 = 0").withColumn("mrp", F.lit("999")).withColumn("verdict", F.lit("PASS"))]
    streams = [streamed(spark, p, tmp_path / f"in{k}") for k, p in enumerate(parts)]
    for k, stream in enumerate(streams):
        for _ in range(2):  # run, then started again from its checkpoint
            ingest.stream_fleet(stream, held, str(tmp_path / f"c{k}")).awaitTermination()
    ingest.stream_fleet(streams[0], held, str(tmp_path / "again")).awaitTermination()
    assert rows_of(held.conflicts()) == rows_of(fleet.product_conflicts(sent))
    state = held.conflict_state.read()
    assert state.count() == state.select("product", "field", "value").distinct().count()
    for scope in ({}, {"device": 2}, {"role": "CONSUMER", "own_device": 3}):
        for since, until in ((None, None), (DAY, 3 * DAY - 1), (DAY + 5, 4 * DAY + 7), (DAY + 5, DAY + DAY // 2), (None, DAY // 3), (9 * DAY, None)):
            want = fleet.fleet_report(fleet.time_range(fleet.scan_scope(sent, scope.get("role", "INSPECTOR"), scope.get("own_device", 0), scope.get("device")), since, until)).first()
            assert held.summary(**scope, since=since, until=until).first() == want, (scope, since, until)
    one = fleet.fleet_summary(sent).first()
    got = held.summary().first()
    assert (got.total, got.failed, got.passed, got.products, got.conclusive_rate) == (one.total, one.failed, one.passed, one.products, one.conclusive_rate)


def test_a_batch_that_stopped_half_way(spark, tmp_path):
    sent = scans(spark, 60, 2)
    held = ingest.Fleet(spark, str(tmp_path / "fleet"), sent.schema, ["scanned_at"], folders=4)
    half = ingest.insert_new(spark, sent, f"{held.root}/scans", held.order, 4, stamp=("s", 0))
    held.conflict_state.merge(ingest.first_sightings(half), "s", 0)
    held.add(sent, "s", 0)
    held.add(sent, "s", 0)
    assert rows_of(held.conflicts()) == rows_of(fleet.product_conflicts(sent)) and held.summary().first() == fleet.fleet_report(sent).first()
