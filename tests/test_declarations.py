"""Example values of normalisation, dates, votes, matching and rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from packlens.functions.dates import date_shift, describe, label_date, label_period
from packlens.functions.normalize import norm_money, norm_quantity, norm_text, values_equal
from packlens.operators import consensus, fleet, measure, rules  # noqa: E501
from packlens.streaming.ingest import stream_scan_ingest


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_money(spark):
    raw = ["Rs. 45", "₹45", "45.00", "INR 45/-", "MRP ₹45.00", "Rs. 1,250", "MRP", "|||", None, "Ｒｓ. ４５"]
    assert column(spark, raw, norm_money) == [45.0, 45.0, 45.0, 45.0, 45.0, 1250.0, None, None, None, 45.0]


def test_quantity(spark):
    raw = ["500 g", "500g", "0.5 kg", "500 gm", "1 l", "1,5 kg", "500 widgets", "500", None]
    found = [tuple(x) if x else None for x in column(spark, raw, norm_quantity)]
    assert found == [(500.0, "g")] * 4 + [(1000.0, "ml"), (15000.0, "g"), None, None, None]


def test_text(spark):
    assert column(spark, ["ACME  Foods, Jaipur!", "Care@Acme.in", "निर्माता", "ＡＢＣ", None], norm_text) == ["acme foods jaipur", "care@acme.in", "निर्माता", "abc", ""]


def test_unreadable_values_are_not_equal(spark):
    rows = spark.createDataFrame([("mrp", "x", "x"), ("mrp", "Rs 5", "5.00"), ("net_quantity", "1 kg", "1000 g"), ("net_quantity", "1 g", "1 ml")], "f string, a string, b string")
    assert [r.x for r in rows.select(values_equal(F.col("f"), F.col("a"), F.col("b")).alias("x")).collect()] == [False, True, True, False]


@pytest.mark.parametrize("raw, first, last, precision", [
    ("12/2025", "2025-12-01", "2025-12-31", "MONTH"), ("02/2024", "2024-02-01", "2024-02-29", "MONTH"), ("25/12/2025", "2025-12-25", "2025-12-25", "DAY"),
    ("05/05/2025", "2025-05-05", "2025-05-05", "DAY"), ("06/07/2025", "2025-06-07", "2025-07-06", "AMBIGUOUS_ORDER"), ("12-SEPT-25", "2025-09-12", "2025-09-12", "DAY"),
    ("BEST BEFORE DEC 2025", "2025-12-01", "2025-12-31", "MONTH"), ("2025-12", "2025-12-01", "2025-12-31", "MONTH"), ("32/13/2025", None, None, None), ("00/00/2025", None, None, None), (" ", None, None, None)])
def test_dates(spark, raw, first, last, precision):
    (d,) = column(spark, [raw], label_date)
    assert (str(d.earliest), str(d.latest), d.precision) == (first, last, precision) if first else d is None


def test_periods(spark):
    assert [tuple(x) if x else None for x in column(spark, ["9 months", "2 weeks", "1 year", "soon"], label_period)] == [(9, 0), (0, 14), (12, 0), None]
    (d,) = column(spark, ["1 month"], lambda c: date_shift(label_date(F.lit("31/01/2025")), label_period(c)))
    assert d.earliest == dt.date(2025, 2, 28)
    assert column(spark, ["06/07/2025", "12/2025"], lambda c: describe(label_date(c))) == ["2025-06-07 or 2025-07-06", "Dec 2025"]


def vote(spark, values, field="mrp"):
    rows = spark.createDataFrame([(1, "front", i, field, v) for i, v in enumerate(values)], "scan_id long, side string, frame int, field string, value string")
    return rows, consensus.consensus_vote(rows).first()


def test_votes(spark):
    _, won = vote(spark, ["Rs. 45", "₹45", "45.00", "Rs. 49", "Rs. 61"])
    assert won.agreed and won.votes == 3 and won.confidence == 0.6 and won.value == "Rs. 45"
    rows, lost = vote(spark, ["45", "45", "49", "52", "61"])
    assert not lost.agreed and lost.value is None
    assert consensus.consensus_failures(rows).first().candidates == "45:2; 49:1; 52:1; 61:1"
    assert not vote(spark, ["|||"] * 3)[1].agreed
    assert vote(spark, ["500 g", "500g", "0.5 kg"], "net_quantity")[1].votes == 3
    with pytest.raises(Exception, match="more than 5 frames"):
        vote(spark, ["1"] * 6)


def test_verdict_precedence(spark):
    rows = [(1, "NOT_ASSESSABLE"), (1, "FAIL"), (2, "NOT_ASSESSABLE"), (2, "PASS"), (3, "EXEMPT"), (4, "PASS")]
    f = spark.createDataFrame([(s, f"R{i}", "f", st, None) for i, (s, st) in enumerate(rows)], "scan_id long, rule_id string, field string, status string, observed string")
    assert {r.scan_id: r.verdict for r in rules.verdict_rollup(f).collect()} == {1: "FAIL", 2: "NOT_ASSESSABLE", 3: "NOT_ASSESSABLE", 4: "PASS"}
    assert {r.scan_id: r.status for r in rules.field_groups(f).collect()} == {1: "NOT_ASSESSABLE", 2: "NOT_ASSESSABLE", 3: "EXEMPT", 4: "PASS"}


def test_conflicts(spark):
    rows = [("a", None, "45"), ("a", None, "55"), (None, "b", "20"), (None, "b", "20"), (None, " b ", "35"), (None, None, "1"), (None, " ", "2")]
    scans = spark.createDataFrame([(i, -i, s, b, m, None) for i, (s, b, m) in enumerate(rows)], "id long, scanned_at long, sku_id string, brand string, mrp string, net_quantity string")
    assert sorted(tuple(r) for r in fleet.product_conflicts(scans).collect()) == [("a", 2, ["55", "45"], []), ("b", 3, ["35", "20"], [])], "in the order of the scans' times"
    same = scans.withColumn("mrp", F.concat(F.when(F.col("id") % 2 == 0, "Rs. ").otherwise("₹"), "mrp", F.when(F.col("sku_id").isNull(), ".00").otherwise("")))
    alike = same.withColumn("mrp", F.when(F.col("sku_id").isNotNull(), F.concat(F.lit("45"), F.when(F.col("id") == 0, ".00").otherwise("/-"))).otherwise(F.col("mrp")))
    assert [tuple(r) for r in fleet.product_conflicts(alike, normalised=True).collect()] == [("b", 3, ["Rs. 35.00", "₹20.00"], [])], "45.00 and 45/- are one price"
    one, other = ([("x", 2, ["5|6", "7"], [])], [("x", 3, ["7", "8"], None), ("y", 1, ["1", "2"], [])])
    halves = [spark.createDataFrame(h, "product string, scans long, prices array<string>, quantities array<string>") for h in (one, other)]
    assert sorted(tuple(r) for r in fleet.conflict_merge(*halves).collect()) == [("x", 3, ["5|6", "7", "8"], []), ("y", 1, ["1", "2"], [])], "a bar in a value is no border"
    assert fleet.fleet_summary(scans.withColumn("verdict", F.lit("PASS")).limit(0)).first().conclusive_rate == 0.0


def test_conflicts_of_many_values(spark):
    ids = spark.range(6000).select("id", (-F.col("id")).alias("scanned_at"), F.lit(None).cast("string").alias("sku_id"), F.lit("b").alias("brand"))
    scans = ids.withColumns({"mrp": F.concat(F.lit(" "), (F.col("id") % 2000).cast("string")), "net_quantity": F.when(F.col("id") % 7 > 0, F.concat((F.col("id") % 700).cast("string"), F.lit(" g")))})
    found = fleet.product_conflicts(scans)
    row = found.first()
    assert (row.scans, row.prices) == (6000, [str(p) for p in range(1999, -1, -1)])
    assert row.quantities == [f"{i % 700} g" for i in range(5999, 5299, -1) if i % 7]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan and "filter(" not in plan, "no value is searched for in its product's list"


def test_focus(spark):
    b = spark.createDataFrame([(1, 1, 10.0), (1, 2, 3.0), (2, 1, 0.0), (3, 1, 0.0), (3, 2, 0.0)], "burst_id int, frame int, variance double")
    assert sorted((r.burst_id, r.frame) for r in measure.focus_gate(b).collect()) == [(1, 1), (2, 1), (3, 1), (3, 2)]


def test_replay_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "PASS"), (1, 1, "FAIL"), (2, 0, "PASS"), (3, 0, "odd")], "id long, at int, verdict string")
    rows.write.parquet(str(tmp_path / "in"))
    for run in ("a", "b"):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        stream_scan_ingest(stream, str(tmp_path / "out"), str(tmp_path / run), ["at"]).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).drop("part").collect()) == [(1, 0, "PASS"), (2, 0, "PASS")]


def test_votes_need_no_shuffle_of_their_own(spark):
    """F15 to F17: readings that lie by scan were dealt once more by scan and side, with all their texts."""
    rows = [(s, side, frame, "mrp", f"Rs. {40 + s % 2}") for s in range(20) for side in ("front", "back") for frame in range(3)]
    dealt = spark.createDataFrame(rows, "scan_id long, side string, frame int, field string, value string").repartition("scan_id")
    voted = consensus.consensus_vote(dealt)
    assert voted._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.value, r.votes) for r in voted.collect()} == {("Rs. 40", 3), ("Rs. 41", 3)} and voted.count() == 40
