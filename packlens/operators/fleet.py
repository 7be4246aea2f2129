"""Fleet analytics over scans and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlens.functions.normalize import norm_field

VERDICTS = ("FAIL", "NOT_ASSESSABLE", "NEEDS_REVIEW", "PASS")
STATUSES = (*VERDICTS, "NOT_APPLICABLE", "EXEMPT")
DAY_MS = 86_400_000
#: Columns that a search looks into.
SEARCHED = ("sku_id", "brand", "mrp", "net_quantity", "batch_number", "mfg_date", "verdict")


def product_key(sku: str = "sku_id", brand: str = "brand") -> Column:
    """The sku, else the trimmed brand, else null: scans without either are never pooled."""
    return F.coalesce(F.nullif(F.col(sku), F.lit("")), F.nullif(F.trim(F.col(brand)), F.lit("")))


def scan_search(scans: DataFrame, query: str | None) -> DataFrame:
    """Case-insensitive substring of any declared column; % and _ are literal; a blank query keeps all."""
    if not query or not query.strip():
        return scans
    wanted = F.lit(query.strip().lower())
    found = F.lit(False)
    for c in SEARCHED:
        found = found | F.coalesce(F.contains(F.lower(F.col(c)), wanted), F.lit(False))
    return scans.where(found)


def scan_search_checks(nested: DataFrame, query: str | None) -> DataFrame:
    """As `scan_search`, on scans with their checks: a rule's id or name counts too."""
    if not query or not query.strip():
        return nested
    wanted = F.lit(query.strip().lower())
    held = lambda c: F.coalesce(F.contains(F.lower(c), wanted), F.lit(False))
    found = F.exists("checks", lambda x: held(x["rule_id"]) | held(x["rule_name"]))
    for c in SEARCHED:
        found = found | held(F.col(c))
    return nested.where(found)


def scan_by_id(scans: DataFrame, checks: DataFrame, scan_id: int, role: str, own_device: int) -> DataFrame:
    """One scan with its checks; none where a consumer asks for another device's."""
    return scan_with_checks(scan_scope(scans.where(F.col("id") == scan_id), role, own_device), checks.where(F.col("scan_id") == scan_id))


def verdict_filter(scans: DataFrame, verdict: str) -> DataFrame:
    return scans.where(F.col("verdict") == verdict.upper())


def scan_device_lookup(scans: DataFrame, devices: DataFrame) -> DataFrame:
    """`scans` with device_key: the internal id of the device that they name, or the name where it is not known."""
    known = devices.select(F.col("device_id").alias("named"), F.col("id").cast("string").alias("internal"))
    return scans.join(known, F.col("device_id").cast("string") == F.col("named"), "left").withColumn("device_key", F.coalesce("internal", F.col("device_id").cast("string"))).drop("named", "internal")


def citation_default(checks: DataFrame, rules: DataFrame) -> DataFrame:
    """`checks` with a citation: their own, else their rule's, else a general one. `rules` has tens of rows."""
    held = F.broadcast(rules.select("rule_id", F.col("citation").alias("of_rule")))
    return checks.join(held, "rule_id", "left").withColumn("citation", F.coalesce("citation", "of_rule", F.lit("Statutory requirement"))).drop("of_rule")


def scan_provenance(scans: DataFrame) -> DataFrame:
    """`scans` with the columns that tell how they were read; the source is the device where nothing is said."""
    kinds = {"source": "string", "image_key": "string", "ocr_model": "string", "mean_confidence": "double", "elapsed_ms": "long"}
    filled = scans.select("*", *[F.lit(None).cast(k).alias(c) for c, k in kinds.items() if c not in scans.columns])
    return filled.withColumn("source", F.coalesce("source", F.lit("device")))


def scan_checks_unique(checks: DataFrame) -> DataFrame:
    """One check a scan and rule: the worst status, then the first observed value."""
    ranked = F.struct(F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status")).alias("r"), F.coalesce("observed", F.lit("")).alias("o"), "status", "field", "observed")
    return checks.groupBy("scan_id", "rule_id").agg(F.min(ranked).alias("b")).select("scan_id", "rule_id", "b.status", "b.field", "b.observed")


def union_products(*parts: DataFrame) -> DataFrame:
    """The names that any part has, each once."""
    out = parts[0].select("product")
    for p in parts[1:]:
        out = out.unionByName(p.select("product"))
    return out.where("product is not null").distinct()


def distinct_in_order(scans: DataFrame, value: str) -> DataFrame:
    """Per product the distinct trimmed values in the order in which they were first seen, joined by '|'.

    First sightings are aggregated per (product, value) before the lists are made.
    """
    rows = scans.select(product_key().alias("product"), F.nullif(F.trim(F.col(value)), F.lit("")).alias("v"), F.struct("scanned_at", "id").alias("at")).where("product is not null and v is not null")
    first = rows.groupBy("product", "v").agg(F.min("at").alias("at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"])
    return first.groupBy("product").agg(F.array_join(listed, "|").alias("seen"))


def bulk_summary(items: DataFrame) -> DataFrame:
    """items: run_id, name, error, failed (checks, null while not processed) to one row a run with its counts and each item's line."""
    line = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("failed").isNull(), "No result").when(F.col("failed") == 0, "No violations found").otherwise(F.concat(F.col("failed").cast("string"), F.lit(" failing checks")))
    done = F.col("error").isNotNull() | F.col("failed").isNotNull()
    rows = items.withColumn("line", line).groupBy("run_id", "line").agg(F.count(F.lit(1)).alias("k"), F.count_if(done).alias("d"), F.count_if(F.col("failed") > 0).alias("f"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "k"))), lambda x: F.concat(x["line"], F.lit(" x"), x["k"].cast("string"))), "; ")
    return rows.groupBy("run_id").agg(F.sum("d").alias("processed"), F.sum("k").alias("total"), F.sum("f").alias("failures"), told.alias("lines"))


def sync_lag(scans: DataFrame) -> DataFrame:
    """`scans` with lag_ms, the time from the scan to its arrival; null where either is missing."""
    return scans.withColumn("lag_ms", F.col("synced_at") - F.col("scanned_at"))


def scan_scope(scans: DataFrame, role: str, own_device: int, device: int | None = None) -> DataFrame:
    """A consumer sees its own device; others all, or the one asked for."""
    if role == "CONSUMER":
        return scans.where(F.col("device_id") == own_device)
    return scans if device is None else scans.where(F.col("device_id") == device)


def time_range(scans: DataFrame, since: int | None, until: int | None) -> DataFrame:
    if since is not None:
        scans = scans.where(F.col("scanned_at") >= since)
    return scans if until is None else scans.where(F.col("scanned_at") <= until)


def scan_page(scans: DataFrame, page: int, limit: int) -> DataFrame:
    """A page, newest first then by id, each row with the total and the number of pages (1 when empty)."""
    total = scans.agg(F.count(F.lit(1)).alias("total"))
    pages = total.select("total", F.greatest(F.ceil(F.col("total") / limit), F.lit(1)).cast("long").alias("pages"))
    rows = scans.orderBy(F.desc("scanned_at"), "id").offset((page - 1) * limit).limit(limit)
    return rows.crossJoin(F.broadcast(pages))  # one row


def scan_with_checks(scans: DataFrame, checks: DataFrame) -> DataFrame:
    """Each scan with its checks nested in rule order; a scan without checks has an empty list."""
    nested = checks.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("rule_id", "status", "observed"))).alias("checks"))
    joined = scans.join(nested, scans["id"] == nested["scan_id"], "left").drop("scan_id")
    return joined.withColumn("checks", F.coalesce("checks", F.array().cast("array<struct<rule_id:string,status:string,observed:string>>")))


def scan_validate(scans: DataFrame, checks: DataFrame, versions: list[str]) -> DataFrame:
    """Each scan with `reason`, null if accepted: a bad version, verdict or check rejects the whole scan."""
    bad = checks.where(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))).select(F.col("scan_id").alias("bad_id")).distinct()
    marked = scans.join(bad, scans["id"] == bad["bad_id"], "left")
    reason = (
        F.when(~F.coalesce(F.col("ruleset_version").isin(*versions), F.lit(False)), "unknown_ruleset_version")
        .when(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), "unknown_verdict")
        .when(F.col("bad_id").isNotNull(), "unknown_status")
    )
    return marked.withColumn("reason", reason).drop("bad_id")


def fleet_summary(scans: DataFrame) -> DataFrame:
    """One row: total, failed, passed, conclusive_rate (4 places, 0 when empty), products."""
    s = scans.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("verdict") == "FAIL").alias("failed"),
        F.count_if(F.col("verdict") == "PASS").alias("passed"), F.count_distinct(product_key()).alias("products"))
    rate = F.coalesce(F.round(F.try_divide(F.col("failed") + F.col("passed"), F.col("total")), 4), F.lit(0.0))
    return s.withColumn("conclusive_rate", rate)


def summary_rows(scans: DataFrame) -> DataFrame:
    """What a summary of the fleet adds up: kind, key and n per (day, device_id).

    Kinds: 'verdict', 'product', and 'rule' for failing checks where `scans` has its checks nested. Sums of such rows are such rows, so
    parts of a fleet are summed apart and merged later; a product counts once however many parts name it.
    """
    entry = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    kinds = F.array(entry("verdict", F.upper("verdict")), entry("product", product_key()))
    if "checks" in scans.columns:
        failed = F.filter(F.coalesce("checks", F.array().cast(scans.schema["checks"].dataType)), lambda c: c["status"] == "FAIL")
        kinds = F.concat(kinds, F.transform(failed, lambda c: entry("rule", c["rule_id"])))
    each = scans.select(F.floor(F.col("scanned_at") / DAY_MS).cast("int").alias("day"), "device_id", F.explode(kinds).alias("e")).select("day", "device_id", "e.kind", "e.key")
    return each.where("key is not null").groupBy("day", "device_id", "kind", "key").agg(F.count(F.lit(1)).alias("n"))


def summary_of(rows: DataFrame, top: int = 5) -> DataFrame:
    """One row out of `summary_rows`: total, failed, passed, conclusive_rate, products, by_verdict (map), top_violations (rule_id, n; most first)."""
    counted = rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    of = lambda kind, verdict=None: F.coalesce(F.sum(F.when((F.col("kind") == kind) & (True if verdict is None else F.col("key") == verdict), F.col("n"))), F.lit(0))
    entries = lambda kind, *order: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(*order))))
    # lists of verdicts and of rules: a few and tens
    s = counted.agg(
        of("verdict").alias("total"), of("verdict", "FAIL").alias("failed"), of("verdict", "PASS").alias("passed"), F.count_if(F.col("kind") == "product").alias("products"),
        F.map_from_entries(entries("verdict", "key", "n")).alias("by_verdict"), F.slice(entries("rule", (-F.col("n")).alias("least"), "key"), 1, top).alias("rules"))
    rate = F.coalesce(F.round(F.try_divide(F.col("failed") + F.col("passed"), F.col("total")), 4), F.lit(0.0))
    violations = F.transform("rules", lambda r: F.struct(r["key"].alias("rule_id"), (-r["least"]).alias("n")))
    return s.select("total", "failed", "passed", rate.alias("conclusive_rate"), "products", "by_verdict", violations.alias("top_violations"))


def fleet_report(scans: DataFrame, top: int = 5) -> DataFrame:
    """`summary_of` of scans with their checks nested, after `scan_scope` and `time_range`."""
    return summary_of(summary_rows(scans), top)


def verdict_counts(scans: DataFrame) -> DataFrame:
    return scans.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def status_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def top_violations(checks: DataFrame, limit: int = 5) -> DataFrame:
    """Rules by failing checks, most first, then by rule."""
    return checks.where("status = 'FAIL'").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_id").limit(limit)


def product_conflicts(scans: DataFrame, normalised: bool = False) -> DataFrame:
    """Products whose scans print two or more prices or quantities: product, scans, prices, quantities (arrays).

    Values are trimmed texts in the order in which they were first seen; a list with one value is emptied. normalised: values
    that mean the same ('Rs. 45' and '45.00') count once, shown as first seen, and what cannot be read is no value. Scans are counted
    per (product, price, quantity) first and values per (product, field) next, so a product with a third of all scans sends a few rows.
    """
    clean = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    rows = scans.select(product_key().alias("product"), clean("mrp").alias("p"), clean("net_quantity").alias("q"), F.struct("scanned_at", "id").alias("at")).where("product is not null")
    counted = rows.groupBy("product", "p", "q").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    same = {"p": F.col("p"), "q": F.col("q")}
    if normalised:
        same = {"p": norm_field(F.lit("mrp"), F.col("p")), "q": F.nullif(norm_field(F.lit("net_quantity"), F.col("q")), F.lit(""))}
    counted = counted.withColumns({f"same_{c}": same[c] for c in "pq"})
    entry = lambda field, c: F.struct(F.lit(field).alias("field"), F.col(f"same_{c}").alias("same"), F.struct("at", F.col(c).alias("value")).alias("first"))
    each = counted.select("product", "n", F.explode(F.array(entry("mrp", "p"), entry("net_quantity", "q"))).alias("e")).select("product", "n", "e.*")
    return conflict_lists(each.groupBy("product", "field", "same").agg(F.sum("n").alias("n"), F.min("first").alias("first")), "mrp")


def conflict_lists(firsts: DataFrame, counted: str) -> DataFrame:
    """product, field, same (a value as compared, null for none), first (at, value: its first sighting), n to `product_conflicts`' rows.

    A (product, field, value) is one row, so a list needs a sort and no search. counted: the field whose n add up to a product's scans.
    """
    seen = lambda field: F.collect_list(F.when((F.col("field") == field) & F.col("same").isNotNull(), F.struct("first.at", "first.value", "same")))
    grouped = firsts.groupBy("product").agg(F.sum(F.when(F.col("field") == counted, F.col("n"))).alias("scans"), seen("mrp").alias("prices"), seen("net_quantity").alias("quantities"))
    many = lambda c: F.when(F.size(c) > 1, F.transform(F.array_sort(c), lambda x: x["value"])).otherwise(F.array().cast("array<string>")).alias(c)
    return grouped.where((F.size("prices") > 1) | (F.size("quantities") > 1)).select("product", "scans", many("prices"), many("quantities"))


def conflicts_top(conflicts: DataFrame, limit: int = 50) -> DataFrame:
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1 to 500")
    return conflicts.orderBy(F.desc("scans"), "product").limit(limit)


def conflict_merge(local: DataFrame, fleet: DataFrame) -> DataFrame:
    """Both sides' conflicts by product: the larger number of scans, the union of the values, sorted."""
    a, b = local.alias("a"), fleet.alias("b")
    own = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    both = lambda c: F.array_sort(F.array_union(own(f"a.{c}"), own(f"b.{c}"))).alias(c)
    joined = a.join(b, F.col("a.product") == F.col("b.product"), "full_outer")
    return joined.select(F.coalesce("a.product", "b.product").alias("product"), F.greatest("a.scans", "b.scans").alias("scans"), both("prices"), both("quantities"))


def history_latest(scans: DataFrame, cap: int = 500) -> DataFrame:
    """Per device the newest copy of each scan, newest first, at most cap of them (the history's size)."""
    once = scans.withColumn("r", F.row_number().over(Window.partitionBy("device_id", "id").orderBy(F.desc("scanned_at")))).where("r = 1")
    place = F.row_number().over(Window.partitionBy("device_id").orderBy(F.desc("scanned_at"), "id"))
    return once.withColumn("place", place).where(F.col("place") <= cap).drop("r")


def history_rows(scans: DataFrame, checks: DataFrame) -> DataFrame:
    """One row a check; a scan without checks is one row with empty cells. Written by sources.files.write_history_csv."""
    joined = scans.join(checks, scans["id"] == checks["scan_id"], "left")
    stamp = F.date_format(F.timestamp_millis("scanned_at"), "yyyy-MM-dd HH:mm:ss")
    return joined.select("id", stamp.alias("scanned"), "verdict", "brand", scans["mrp"], "rule_id", "status", "field", "observed")
