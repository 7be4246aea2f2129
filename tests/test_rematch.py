"""Matches that are kept up to date equal a full match after products come, change and go."""

import random

import pytest
from pyspark.sql import functions as F

from packlens.operators import match
from packlens.operators.rematch import MatchIndex

SKU = "sku_id string, brand_strings array<string>, mrp int, net_quantity string, licence string"
SCAN = "id long, brand string, mrp string, net_quantity string, licence string"


def product(rng, i):
    brands = [b for b in (rng.choice([None, "Acme Foods", "acme foods gold", "Best Tea", "best tea co", "Best"]) for _ in range(2)) if b]
    return (f"S{i:03}", brands, rng.choice([None, 10, 20, 30]), rng.choice([None, "100 g", "0.1 kg", "200 g", "1 pack"]), rng.choice([None, "1", "2", "lic"]))


def pack(rng, i):
    return (i, rng.choice([None, " ", "Acme Foods", "Best Tea", "Best", "new brand"]), rng.choice([None, "10", "20", "30"]), rng.choice([None, "100 g", "200 g", "5 widgets"]), rng.choice([None, "1", "2"]))


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("scorer, full", [(match.WEIGHTED, match.match_weighted), (match.IDENTITY, match.match_identity)])
def test_kept_matches(spark, tmp_path, scorer, full):
    rng = random.Random(8)
    scans = spark.createDataFrame([pack(rng, i) for i in range(80)], SCAN)
    registry = {p[0]: p for p in (product(rng, i) for i in range(25))}
    made = lambda some: spark.createDataFrame(list(some), SKU)
    index = MatchIndex(spark, str(tmp_path / "index"), scorer, buckets=4)
    index.update(made(registry.values()))
    index.add(scans)
    assert rows_of(index.matches(scans)) == rows_of(full(scans, made(registry.values())))
    total = scorer.asked(scans).select(*scorer.signature).distinct().count()
    for step in range(1):
        new = {p[0]: p for p in (product(rng, i) for i in [*rng.sample(range(25), 2), 30 + step])}
        gone = rng.sample([k for k in registry if k not in new], 3)
        registry = {k: p for k, p in (registry | new).items() if k not in gone}
        for _ in range(2):  # an update that is sent again changes nothing
            index.update(made(new.values()), spark.createDataFrame([(g,) for g in gone], "sku_id string"))
        assert rows_of(index.matches(scans)) == rows_of(full(scans, made(registry.values()))), step
    index.update(made([("S900", ["Nobody Else"], 77, "77 g", "77")]))
    assert index.counted["signatures"] < total // 4 and 0 < index.counted["changed_keys"] < 20, "only what shares a key is matched again"
    index.update(made([]), made(registry.values()).select("sku_id").unionByName(spark.createDataFrame([("S900",)], "sku_id string")))
    assert rows_of(index.matches(scans)) == rows_of(full(scans, made([])))


def test_signatures_meet_a_row_a_key(spark):
    """one brand and quantity under n licences were n pairs for each of n scans."""
    n, scorer = 60, match.WEIGHTED
    registry = spark.createDataFrame([(f"S{i:03}", ["Acme"], None, "100 g", f"{i}") for i in range(n)], SKU)
    scans = spark.createDataFrame([(i, "Acme", None, None if i % 2 else "100 g", f"{i}") for i in range(n + 1)], SCAN)
    signatures = scorer.asked(scans).select(*scorer.signature).distinct()
    pairs = scorer.keys(signatures, None).join(scorer.condensed(scorer.product_keys(scorer.known(registry), None)), "key")
    assert pairs.count() <= 4 * n
    got = {r.id: (r.sku, r.score, r.candidates) for r in match.match_weighted(scans, registry).collect()}
    assert got == {i: (f"S{i:03}", 1.0, 1) for i in range(n)} | {n: (None, 0.0, n)}


def test_a_quantity_that_cannot_be_read_is_compared(spark):
    registry = spark.createDataFrame([("S1", ["Acme"], None, "1 pack", None), ("S2", ["Beta"], None, None, None)], SKU)
    scans = spark.createDataFrame([(1, "acme", None, "500 g", None), (2, "acme", None, "500 widgets", None), (3, "acme", None, None, None), (4, "beta", None, "500 widgets", None), (5, "acme", None, " ", None)], SCAN)
    got = {r.id: (r.sku, r.score) for r in match.match_weighted(scans, registry).collect()}
    assert got == {1: (None, 0.0), 2: (None, 0.0), 3: ("S1", 1.0), 4: ("S2", 1.0), 5: ("S1", 1.0)}
    assert match.match_weighted(scans, registry).where(F.col("score") > 0).count() == 3
