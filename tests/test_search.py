"""The search index, pages by seek, bucketed tables and merged sides against their plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from packlens.operators import consensus, fleet, search
from packlens.sources import files

SCAN = "id long, scanned_at long, sku_id string, brand string, mrp string, net_quantity string, batch_number string, mfg_date string, verdict string, checks array<struct<rule_id: string, rule_name: string, status: string>>"


def scans(spark, n, seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice([None, "", "ab", "Abc abc", "50% off_x", "ÉCLAIR 5", "cab", "a|b|c"])
    rows = [(i, rng.randrange(40), word(), word(), word(), None, word(), "x" * 300 if i == 3 else None, rng.choice(["FAIL", "PASS"]), [("Tax-01", "Tax words", "PASS")] if i % 4 == 0 else None) for i in range(n)]
    return spark.createDataFrame(rows, SCAN)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_search_index_equals_search(spark, tmp_path):
    nested = scans(spark, 60)
    plain = nested.drop("checks")
    search.write_search_index(nested, str(tmp_path / "nested"), buckets=4)
    search.write_search_index(plain, str(tmp_path / "plain"), buckets=4)
    for text in ("abc", " ABC ", "bc a", "% o", "f_x", "éclair", "pas", "x" * 200, "nowhere", "abcabc", "ab", "", None, "tax", "words"):
        assert ids(search.search_indexed(plain, str(tmp_path / "plain"), text, buckets=4)) == ids(fleet.scan_search(plain, text)), text
        assert ids(search.search_indexed(nested, str(tmp_path / "nested"), text, buckets=4)) == ids(fleet.scan_search_checks(nested, text)), text
    found = search.search_candidates(spark, str(tmp_path / "plain"), "éclair", "bigint", buckets=4)
    assert found.count() < 60


def test_a_scan_is_listed_under_its_texts(spark, tmp_path):
    """a scan had a row for each run of three letters of all its texts."""
    plain = scans(spark, 60).drop("checks").withColumn("sku_id", F.lit("a sku with many letters"))
    search.write_search_index(plain, str(tmp_path / "index"), buckets=4)
    assert spark.read.parquet(str(tmp_path / "index" / "holders")).count() <= 7 * 60
    assert spark.read.parquet(str(tmp_path / "index" / "grams")).count() < 400
    assert ids(search.search_indexed(plain, str(tmp_path / "index"), "SKU WITH", buckets=4)) == list(range(60))


def test_texts_are_dealt_over_tasks(spark):
    """a file of one row group was normalised by one task."""
    from packlens.catalog import QUERIES

    assert QUERIES["norm_text_documents"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_pages_by_seek(spark, tmp_path):
    some = scans(spark, 130).select("id", "scanned_at")
    search.write_pages(some, str(tmp_path / "pages"), parts=7)
    for page, limit in ((1, 20), (3, 20), (7, 20), (8, 20), (2, 65), (1, 100), (40, 3), (99, 100)):
        got = search.read_page(spark, str(tmp_path / "pages"), page, limit, some.schema).collect()
        assert got == fleet.scan_page(some, page, limit).collect(), (page, limit)
    assert len(search.read_page(spark, str(tmp_path / "pages"), 5, 10, some.schema).inputFiles()) <= 3, "a page's ranges are read"
    search.write_pages(some.limit(0), str(tmp_path / "none"), parts=3)
    assert not search.read_page(spark, str(tmp_path / "none"), 1, 20, some.schema).count()
    with pytest.raises(ValueError):
        search.read_page(spark, str(tmp_path / "pages"), 0, 20, some.schema)


def test_tables_join_where_they_lie(spark, tmp_path):
    made = {
        "scans": spark.createDataFrame([(str(i), i, 1, 2, "PASS") for i in range(40)], "id string, device_id long, scanned_at long, synced_at long, verdict string"),
        "scan_checks": spark.createDataFrame([(str(i % 30), f"R{i // 30}", "PASS", None) for i in range(90)], "scan_id string, rule_id string, status string, observed string")}
    for name, df in made.items():
        files.write_table(df, str(tmp_path), name, buckets=4)
    held = [files.read_table(spark, str(tmp_path), n, df.schema, buckets=4) for n, df in made.items()]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nested = fleet.scan_with_checks(*held)
        assert "Exchange" not in nested._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, nested.collect())) == sorted(map(str, fleet.scan_with_checks(*made.values()).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(str, files.read_table(spark, str(tmp_path), "scans", made["scans"].schema).collect())) == sorted(map(str, made["scans"].collect()))


def test_every_table_has_its_schema(spark, tmp_path):
    for name, schema in files.TABLES.items():
        files.write_table(spark.createDataFrame([], schema), str(tmp_path), name, buckets=2)
    for name, df in files.read_tables(spark, str(tmp_path)).items():
        assert df.schema == spark.createDataFrame([], files.TABLES[name]).schema and not df.count()


def test_sides_that_disagree_name_their_readings(spark):
    rows = [(1, "a", "mrp", "Rs. 45", True, 0.6), (1, "b", "mrp", "50", True, 1.0), (1, "c", "mrp", "45.00", True, 0.8), (2, "a", "mrp", "45", True, 0.8), (2, "b", "mrp", "45.00", True, 0.8), (2, "c", "mrp", "", True, 1.0), (3, "a", "mrp", None, False, 0.0)]
    got = {r.scan_id: r for r in consensus.side_merge(spark.createDataFrame(rows, "scan_id long, side string, field string, value string, agreed boolean, confidence double")).collect()}
    assert got[1].reason == "sides_disagree" and got[1].value is None and [tuple(c) for c in got[1].candidates] == [("Rs. 45", 2), ("50", 1)]
    assert (got[2].value, got[2].confidence, got[2].candidates) == ("45", 0.8, []), "of equally sure sides the first"
    assert got[3].reason == "ocr_no_consensus" and got[3].candidates == []
