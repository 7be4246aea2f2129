"""Matches to the registry that are kept up to date: what changes in the registry rematches only the scans that it can concern.

Tables by key hold each signature's keys, each product's rows and keys, and the best match of each signature. A change of a
product concerns the signatures that share a key with the product as it was or as it is; for these alone the best is found
again, among the products that share their keys. A common order of words makes keys of brands; it is that of the registry at the start and
stays, since any order finds all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.operators.match import Scorer, with_best
from packlens.sources.folders import listed, written
from packlens.sources.keyed import KeyedTable


def _replaced(owner: str):
    """Of each owner's rows those of the batch, if it has any; a row without a key or signature only takes the old ones away."""

    def combine(rows: DataFrame) -> DataFrame:
        named = rows.where("fresh = 1").select(F.col(owner).alias("__owner")).distinct()
        old = rows.where("fresh = 0").join(named, F.col(owner) == F.col("__owner"), "left_anti")
        return old.unionByName(rows.where("fresh = 1 AND live")).drop("fresh").distinct()

    return combine


def _pairs_replaced(rows: DataFrame) -> DataFrame:
    """Of each (key, sku) the row of the batch, if it has one."""
    last = rows.groupBy("key", "sku_id").agg(F.max("fresh").alias("last"))
    return rows.join(last, ["key", "sku_id"]).where("fresh = last AND live").drop("fresh", "last").distinct()


@dataclass
class MatchIndex:
    """Under `root`: the keys of signatures, the products by sku and by key, and the best match of each signature, by one scorer.

    `update` takes changed and new products and the skus of removed ones; `add` takes scans. Either leaves what a full match would find. Both
    are merges of tables by key: one that stopped half way is run again with the same rows, and writers must not run at once.
    """

    spark: SparkSession
    root: str
    scorer: Scorer
    buckets: int = 32
    #: Of the last update: changed keys, signatures that were matched again, and candidates that they met.
    counted: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        text = lambda names: ", ".join(f"{c} string" for c in names)
        own, product = text(self.scorer.signature), text(self.scorer.product)
        table = lambda name, schema, by, combine: KeyedTable(self.spark, f"{self.root}/{name}", f"{schema}, live boolean", by, combine, self.buckets)
        self.keys = table("keys", f"key string, {own}", ["key"], lambda rows: rows.drop("fresh").distinct())
        self.skus = table("skus", f"sku_id string, {product}", ["sku_id"], _replaced("sku_id"))
        self.products = table("products", f"key string, sku_id string, {product}", ["key"], _pairs_replaced)
        self.best = table("best", f"sig string, {own}, {self.scorer.result}", ["sig"], _replaced("sig"))

    def _words(self, known: DataFrame | None = None) -> DataFrame | None:
        """The order of words: made of the first products, then read."""
        if self.scorer.words is None:
            return None
        path = f"{self.root}/words"
        if known is not None and "_SUCCESS" not in listed(self.spark, path):
            self.scorer.words(known).write.mode("overwrite").parquet(path)
        return self.spark.read.schema("word string, k long").parquet(path)

    def _signed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("sig", F.to_json(F.struct(*self.scorer.signature), {"ignoreNullFields": "false"}))

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows that several steps read, as a table: each step's plan stays small, and what an executor held is not lost with it."""
        return written(rows, f"match-{name}")

    def _found(self, signatures: DataFrame) -> None:
        """Finds and keeps the best of each signature among the products that share a key with it; only the buckets of those keys are read."""
        keyed = self._kept(self.scorer.keys(signatures.select(*self.scorer.signature), self._words()), "asked")
        wanted = self.products.buckets_of(keyed.select("key"))
        candidates = self.products.read(lambda b: b in wanted).join(keyed.select("key").distinct(), "key", "left_semi")
        met = self._kept(keyed.join(self.scorer.condensed(candidates), "key"), "met")
        self.counted["candidates"] = met.count()
        best = self._kept(self._signed(self.scorer.best(met)), "best")
        # a signature without a match takes its old one away
        none = self._signed(signatures).join(best.select("sig"), "sig", "left_anti")
        self.best.merge(best.withColumn("live", F.lit(True)).unionByName(none.select("sig", *self.scorer.signature).withColumn("live", F.lit(False)), allowMissingColumns=True))

    def update(self, products: DataFrame, removed: DataFrame | None = None) -> None:
        """products: registry rows, new or changed; removed: sku_id of those that are gone."""
        after = self._kept(self.scorer.known(products), "after")
        gone = products.select("sku_id") if removed is None else products.select("sku_id").unionByName(removed.select("sku_id"))
        gone, words = self._kept(gone.distinct(), "skus"), self._words(after)
        touched = self.skus.buckets_of(gone)
        before = self.skus.read(lambda b: b in touched).join(gone, "sku_id", "left_semi").drop("live")
        old = self._kept(self.scorer.product_keys(before, words), "old-keys")
        new = self._kept(self.scorer.product_keys(after, words), "new-keys")
        # a key that a product keeps is replaced by its new row, one that it loses is taken away
        lost = old.join(new.select("key", "sku_id").distinct(), ["key", "sku_id"], "left_anti")
        changes = self._kept(new.select("key").unionByName(old.select("key")).distinct(), "changes")
        asked = self.keys.buckets_of(changes)
        concerned = self._kept(self.keys.read(lambda b: b in asked).join(changes, "key", "left_semi").select(*self.scorer.signature).distinct(), "concerned")
        self.counted = {"changed_keys": changes.count(), "signatures": concerned.count()}
        self.products.merge(lost.withColumn("live", F.lit(False)).unionByName(new.withColumn("live", F.lit(True))))
        # skus go last: what stopped before them finds the old keys again
        self._found(concerned)
        dead = gone.join(after.select("sku_id"), "sku_id", "left_anti").withColumn("live", F.lit(False))
        self.skus.merge(after.withColumn("live", F.lit(True)).unionByName(dead, allowMissingColumns=True))

    def add(self, scans: DataFrame) -> None:
        """Signatures that the index lacks are matched and kept."""
        signatures = self._signed(self.scorer.asked(scans).select(*self.scorer.signature).distinct())
        known = self._signed(self.keys.read().select(*self.scorer.signature).distinct())
        fresh = self._kept(signatures.join(known.select("sig"), "sig", "left_anti").select(*self.scorer.signature), "fresh")
        self._found(fresh)
        self.keys.merge(self.scorer.keys(fresh, self._words()).withColumn("live", F.lit(True)))

    def matches(self, scans: DataFrame) -> DataFrame:
        """What the scorer's full match of these scans, which were added, with the current registry gives."""
        return with_best(self.scorer, self.scorer.asked(scans), self.best.read().drop("sig", "live"), self.skus.read())
