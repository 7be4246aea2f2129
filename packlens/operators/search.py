"""Search and pages over many scans without reading them all: posting lists of three letters, and pages by seek."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.operators.fleet import SEARCHED, scan_search, scan_search_checks

GRAM = 3
#: Lists of grams name texts, by their hash; lists of texts name scans.
GRAMS, HOLDERS = "bucket int, gram string, text long", "bucket int, text long, id {kind}"


def _grams(text: Column) -> Column:
    """The runs of GRAM characters of a text, each once; none of a shorter one."""
    places = F.sequence(F.lit(1), F.length(text) - GRAM + 1)
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, GRAM)))).otherwise(F.array().cast("array<string>"))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def write_search_index(scans: DataFrame, path: str, buckets: int = 64) -> None:
    """Posting lists of what a search looks into: the declared columns and, where checks are nested, their rules' ids and names.

    Each distinct text is cut into grams once (`grams`: gram and text), and each scan is listed under its few texts (`holders`: text and id), not under
    all their grams. Texts stand as hashes. Lists lie in `bucket=` folders, sorted, so a search reads those of its own grams and texts; a bucket with many
    rows is dealt over many files. `scans` is read twice.
    """
    texts = [F.lower(F.col(c)) for c in SEARCHED]
    told = F.array(*texts)
    if "checks" in scans.columns:
        rules = F.flatten(F.transform(F.coalesce("checks", F.array().cast(scans.schema["checks"].dataType)), lambda c: F.array(F.lower(c["rule_id"]), F.lower(c["rule_name"]))))
        told = F.concat(told, rules)
    long_enough = F.array_distinct(F.filter(told, lambda t: F.length(t) >= GRAM))
    each = scans.select("id", F.explode(long_enough).alias("text"))
    held = each.select(F.xxhash64("text").alias("text"), "id").withColumn("bucket", _bucket(F.col("text"), buckets))
    distinct = each.select("text").distinct().select(F.explode(_grams(F.col("text"))).alias("gram"), F.xxhash64("text").alias("text"))
    for rows, order, name in ((held, "text", "holders"), (distinct.withColumn("bucket", _bucket(F.col("gram"), buckets)), "gram", "grams")):
        rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", order).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/{name}")


def search_candidates(spark: SparkSession, path: str, query: str, kind: str, buckets: int = 64) -> DataFrame | None:
    """Ids of the scans of which a text holds all runs of three letters of the query; None where it has none."""
    wanted = query.strip().lower()
    grams = sorted({wanted[i : i + GRAM] for i in range(len(wanted) - GRAM + 1)})
    if not grams:
        return None
    asked = spark.createDataFrame([(g,) for g in grams], "gram string")
    held = sorted({r.b for r in asked.select(_bucket(F.col("gram"), buckets).alias("b")).collect()})  # as many as the query has grams
    lists = spark.read.schema(GRAMS).parquet(f"{path}/grams").where(F.col("bucket").isin(held) & F.col("gram").isin(grams))
    texts = lists.groupBy("text").agg(F.count_distinct("gram").alias("k")).where(F.col("k") == len(grams)).select(_bucket(F.col("text"), buckets).alias("bucket"), "text")
    return spark.read.schema(HOLDERS.format(kind=kind)).parquet(f"{path}/holders").join(texts, ["bucket", "text"], "left_semi").select("id").distinct()


def search_indexed(scans: DataFrame, path: str, query: str | None, buckets: int = 64) -> DataFrame:
    """The rows of `scan_search`, or of `scan_search_checks` where checks are nested, by the index of `write_search_index` over the same scans.

    Candidates hold all grams of the query in one text and are then searched; a query of less than three letters reads all scans.
    """
    plain = scan_search_checks if "checks" in scans.columns else scan_search
    kind = dict(scans.dtypes)["id"]
    found = None if not query else search_candidates(scans.sparkSession, path, query, kind, buckets)
    return plain(scans if found is None else scans.join(found, "id", "left_semi"), query)


def _newest() -> list[Column]:
    return [F.desc("scanned_at"), F.asc("id")]


def write_pages(scans: DataFrame, path: str, parts: int = 64) -> None:
    """Scans in the order of pages, cut into `parts` ranges in folders of their own, and how many each holds."""
    ranged = scans.repartitionByRange(parts, *_newest()).withColumn("part", F.spark_partition_id())
    ranged.sortWithinPartitions("part", *_newest()).write.partitionBy("part").parquet(f"{path}/scans")
    held = scans.sparkSession.read.schema("id long, part int").parquet(f"{path}/scans").groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    held.coalesce(1).write.parquet(f"{path}/counts")


def read_page(spark: SparkSession, path: str, page: int, limit: int, schema) -> DataFrame:
    """The rows of `scan_page`, from `write_pages`: the counts tell which ranges hold the page, and only these are read and ordered."""
    if page < 1 or not 1 <= limit <= 100:
        raise ValueError("pages count from 1 and hold 1 to 100 scans")
    counts = sorted(tuple(r) for r in spark.read.schema("part int, n long").parquet(f"{path}/counts").collect())  # a row a range
    total, first, skipped, read, before = sum(n for _, n in counts), (page - 1) * limit, 0, [], 0
    for part, n in counts:
        if before < first + limit and before + n > first:
            skipped = before if not read else skipped
            read.append(part)
        before += n
    held = spark.read.schema(schema).parquet(*[f"{path}/scans/part={p}" for p in read]) if read else spark.createDataFrame([], schema)
    rows = held.orderBy(*_newest()).offset(first - skipped if read else 0).limit(limit)
    return rows.select("*", F.lit(total).cast("long").alias("total"), F.lit(max(-(-total // limit), 1)).cast("long").alias("pages"))
