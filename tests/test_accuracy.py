"""Outcomes of fields, and the interval against plain resampling of packs."""

import hashlib
import random

import pytest

from packlens.operators import accuracy, quality

FIELDS = "image_id string, field string, value string"


def test_outcomes(spark):
    truth = [("a", "mrp", "Rs. 40/-"), ("a", "brand", None), ("a", "net_quantity", "500 g"), ("b", "mrp", " "), ("b", "brand", "Acme"), ("b", "net_quantity", "ten g"), ("c", "brand", "Zed"), ("c", "brand", "Acme"), ("c", "mrp", "")]
    results = [("a", "mrp", "40.00"), ("a", "brand", ""), ("a", "net_quantity", "0.5 kg"), ("b", "mrp", "41"), ("b", "net_quantity", "ten g"), ("c", "brand", "ACME!"), ("c", "mrp", None), ("d", "mrp", "1")]
    found = accuracy.field_outcomes(spark.createDataFrame(results, FIELDS), spark.createDataFrame(truth, FIELDS))
    assert {(r.image_id, r.field): r.outcome for r in found.collect()} == {
        ("a", "mrp"): "equal", ("a", "brand"): "both_empty", ("a", "net_quantity"): "equal", ("b", "mrp"): "invented", ("b", "brand"): "missed", ("b", "net_quantity"): "wrong",
        ("c", "brand"): "equal", ("c", "mrp"): "both_empty"}


def test_interval_equals_resampling_of_packs(spark):
    rng = random.Random(3)
    # a pack's fields are right or wrong together, and packs have up to six rows of a field's outcomes
    packs = [[rng.random() < 0.9] * rng.randint(1, 6) for _ in range(120)]
    rows = [(str(i), "mrp", "equal" if ok else "wrong") for i, pack in enumerate(packs) for ok in pack]
    outcomes = spark.createDataFrame(rows, "image_id string, field string, outcome string").repartition(3)
    (got,) = accuracy.accuracy_by_field(outcomes, replicates=2001).collect()
    plain = []
    for _ in range(2001):
        drawn = [ok for _ in packs for ok in rng.choice(packs)]
        plain.append(sum(drawn) / len(drawn))
    plain.sort()
    assert got.n == len(rows) and got.accuracy == pytest.approx(sum(o == "equal" for *_, o in rows) / len(rows), abs=1e-6)
    assert got.low == pytest.approx(plain[50], abs=0.012) and got.high == pytest.approx(plain[1950], abs=0.012)
    alone = [rng.choices([ok for pack in packs for ok in pack], k=len(rows)) for _ in range(500)]
    narrow = sorted(sum(x) / len(x) for x in alone)
    assert got.high - got.low > 1.4 * (narrow[487] - narrow[12]), "fields of a pack are not independent"


def test_replicates(spark):
    outcomes = spark.createDataFrame([(str(i), f, "equal") for i in range(400) for f in ("mrp", "brand")], "image_id string, field string, outcome string")
    found = accuracy.resampled(outcomes, 10).collect()
    assert sorted((r.field, r.replicate) for r in found) == [(f, i) for f in ("brand", "mrp") for i in range(10)]
    assert accuracy.accuracy_by_field(outcomes.where("false")).collect() == []
    assert all(r.low == r.high == 1.0 for r in accuracy.accuracy_by_field(outcomes).collect())


def test_a_pack_draws_once_for_all_its_fields(spark):
    rows = [(str(i), f, "equal" if (i + k) % 3 else "wrong") for i in range(60) for k, f in enumerate(("mrp", "brand", "batch_number")) if (i + k) % 4]
    outcomes = spark.createDataFrame(rows, "image_id string, field string, outcome string")
    found = accuracy.resampled(outcomes, 50)
    weigh = lambda i, n: sum(hashlib.md5(f":{i}:{n // 4}".encode()).hexdigest()[8 * (n % 4) :][:8] >= step for step in accuracy.STEPS)
    for r in found.collect():
        drawn = [(weigh(i, r.replicate), o == "equal") for i, f, o in rows if f == r.field]
        assert r.accuracy == sum(w * ok for w, ok in drawn) / sum(w for w, _ in drawn)
    assert found.count() == 150
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and plan.rindex("Aggregate") > plan.index("md5"), "hashes are made of packs, not of their fields"


def test_kappa_of_blind_records(spark):
    rows = [(1, 1, True), (0, 0, True), (1, 0, True), (0, 0, True), (1, 1, False), (0, 1, None)]
    pairs = spark.createDataFrame(rows, "a int, b int, blind boolean")
    (all_,), (blind,) = quality.kappa(pairs, "a", "b").collect(), quality.kappa(pairs, "a", "b", blind="blind").collect()
    assert (all_.n, blind.n) == (6, 4) and blind.kappa == pytest.approx(0.5)
