"""Registered queries on declared packs: rules, sizes, enrolment, search and lists, and the SQL each is checked against."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.catalog import MONEY, PRODUCT, Q_MAG, Q_NAME, _FOLDED, _QTY_WORDS, _m, _query
from packlens.functions.normalize import server_money, server_quantity, server_text
from packlens.operators import consensus, fleet, match, measure, rules
from packlens.plans.bind import view
from packlens.sources.files import corpus_list as list_corpus
from packlens.sources.files import corpus_upsert as upsert_corpus
from packlens.sources.files import export_results, image_key

TODAY = "1996-07-15"

# each check as the SQL of 'STATUS|reason', over f (the rule's field), m (the date it refers to), r (the matched product), h, s
_SEEN = "f.value IS NOT NULL"
_DATE = "CASE WHEN f.t_first IS NOT NULL THEN f.{t} WHEN f.t_months IS NOT NULL AND NOT coalesce(m.anchor_only, TRUE) THEN CAST(m.{t} + to_months(f.t_months) AS DATE) + f.t_days END"
_FIRST, _LAST = _DATE.format(t="t_first"), _DATE.format(t="t_last")
_DAY = f"DATE '{TODAY}'"
_QTY = f"{_m(Q_MAG, 'f.value')} = {_m(Q_MAG, 'r.net_quantity')} AND {_m(Q_NAME, 'f.value')} = {_m(Q_NAME, 'r.net_quantity')}"
_REGISTERED = {
    "mrp": ("r.mrp_exact IS NULL", f"{_m(MONEY, 'f.value')} = r.mrp_exact"), "net_quantity": ("r.net_quantity IS NULL", _QTY),
    "brand": ("FALSE", "lower(f.value) = 'brand#0' OR (r.brand2 IS NOT NULL AND lower(f.value) = 'brand#1')")}
_SQL = {
    "field_present": f"CASE WHEN {_SEEN} AND NOT f.anchor_only THEN 'PASS|' ELSE 'FAIL|' END",
    "matches_registry": f"CASE WHEN r.scan_id IS NULL THEN 'NOT_APPLICABLE|registry_unpopulated' WHEN NOT coalesce({_SEEN} AND NOT f.anchor_only, FALSE) THEN 'FAIL|' WHEN {{missing}} THEN 'NOT_ASSESSABLE|registry_unpopulated' WHEN coalesce({{equal}}, FALSE) THEN 'PASS|' WHEN r.source = 'IMPORTED' THEN 'FAIL|' ELSE 'NEEDS_REVIEW|' END",
    "role_present": "CASE WHEN f.anchor_only THEN 'FAIL|' WHEN o.role = 'MANUFACTURER' THEN 'PASS|' WHEN o.role = 'UNKNOWN' THEN 'NEEDS_REVIEW|' ELSE 'FAIL|' END",
    "date_marking": f"CASE WHEN NOT coalesce({_SEEN} AND NOT f.anchor_only, FALSE) THEN 'FAIL|' WHEN f.relative AND coalesce(m.anchor_only, TRUE) THEN 'FAIL|' ELSE 'PASS|' END",
    "date_not_future": f"CASE WHEN NOT coalesce({_SEEN} AND NOT f.anchor_only, FALSE) THEN 'NOT_APPLICABLE|no_date_declared' WHEN f.t_first IS NULL THEN 'NOT_ASSESSABLE|date_unparsed' WHEN f.t_first > {_DAY} THEN 'FAIL|' WHEN f.t_last > {_DAY} THEN 'NEEDS_REVIEW|' ELSE 'PASS|' END",
    "date_order": f"CASE WHEN {_FIRST} IS NULL OR m.t_first IS NULL THEN 'NOT_APPLICABLE|date_pair_incomplete' WHEN m.t_first > {_LAST} THEN 'FAIL|' WHEN {_FIRST} > m.t_last OR {_FIRST} = m.t_first THEN 'PASS|' ELSE 'NEEDS_REVIEW|' END",
    "not_expired": f"CASE WHEN NOT coalesce({_SEEN} AND NOT f.anchor_only, FALSE) THEN 'NOT_APPLICABLE|no_date_declared' WHEN {_FIRST} IS NULL THEN 'NOT_ASSESSABLE|date_unresolved' WHEN {_LAST} < {_DAY} THEN 'FAIL|' WHEN {_FIRST} < {_DAY} THEN 'NEEDS_REVIEW|' ELSE 'PASS|' END",
    "min_height_mm": "CASE WHEN h.low_mm IS NULL AND s.unavailable IS NOT NULL THEN 'NOT_APPLICABLE|height_scale_unavailable' WHEN h.low_mm IS NULL THEN 'NOT_ASSESSABLE|height_not_measured' {settled} END",
}
_SETTLED = {True: "WHEN h.low_mm >= 1.0 THEN 'PASS|' WHEN h.high_mm < 1.0 THEN 'FAIL|' ELSE 'NEEDS_REVIEW|'", False: "ELSE 'NEEDS_REVIEW|'"}
_RULES = json.loads(rules.CANONICAL.read_text())["rules"]


def _rule_sql(rule: dict, settled: bool = False) -> str:
    check, field = rule["check"]["type"], rule["field"]
    outcome = _SQL[check].replace("{settled}", _SETTLED[settled])
    if check == "matches_registry":
        outcome = outcome.replace("{missing}", _REGISTERED[field][0]).replace("{equal}", _REGISTERED[field][1])
    if rule["id"] == "CARE-01":
        outcome = f"CASE WHEN b.k % 9 IN (1, 2, 3) THEN 'EXEMPT|' ELSE {outcome} END"
    return f"""SELECT b.k AS scan_id, '{rule['id']}' AS rule_id, {outcome} AS o, f.value, f.confidence, f.agreement FROM packs b LEFT JOIN declared f ON f.scan_id = b.k AND f.field = '{field}'
        LEFT JOIN declared m ON m.scan_id = b.k AND m.field = 'mfg_date' LEFT JOIN pack_registry r ON r.scan_id = b.k LEFT JOIN pack_roles o ON o.scan_id = b.k
        LEFT JOIN pack_heights h ON h.scan_id = b.k AND h.field = '{field}' LEFT JOIN pack_scales s ON s.scan_id = b.k"""


def _findings_sql(check: str | None = None, settled: bool = False) -> str:
    each = " UNION ALL ".join(_rule_sql(r, settled) for r in _RULES if check in (None, r["check"]["type"]))
    return f"""SELECT scan_id, rule_id, split_part(o, '|', 1) AS status, nullif(split_part(o, '|', 2), '') AS reason, CASE WHEN o <> 'EXEMPT|' THEN value END AS observed,
        CASE WHEN o = 'EXEMPT|' THEN 1.0 ELSE coalesce(confidence, 0.0) END AS confidence, CASE WHEN o <> 'EXEMPT|' AND value IS NOT NULL THEN concat(CAST(agreement AS VARCHAR), '/5 frames') END AS agreement FROM ({each}) AS each_rule"""


def _findings(spark: SparkSession, sf_dir: str, check: str | None = None, settled: bool = False) -> DataFrame:
    root = json.loads(rules.CANONICAL.read_text())
    root["rules"] = [r for r in root["rules"] if check in (None, r["check"]["type"])]
    for r in root["rules"] if settled else []:
        r["check"]["params"] = {"min_mm": 1.0}
    ruleset, exempt, _ = rules.load_rules(spark, json.dumps(root))
    product = view(spark, sf_dir, "pack_registry")
    product = product.select("scan_id", match.authority(F.col("source")).alias("authority"), "mrp_exact", "net_quantity", F.filter(F.array("brand1", "brand2"), lambda b: b.isNotNull()).alias("brand_strings"))
    return rules.evaluate(
        view(spark, sf_dir, "declared"), ruleset, exempt, TODAY, scans=view(spark, sf_dir, "packs").select(F.col("k").alias("scan_id")), registry=product,
        roles=view(spark, sf_dir, "pack_roles"), heights=view(spark, sf_dir, "pack_heights"), scales=view(spark, sf_dir, "pack_scales"))


def _shown(findings: DataFrame) -> DataFrame:
    return findings.select("scan_id", "rule_id", "status", "reason", "observed", "confidence", F.col("evidence")["agreement"].alias("agreement"))


@_query(_findings_sql())
def evaluate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over all packs: one finding each."""
    return _shown(_findings(spark, sf_dir))


def _check_query(check: str, name: str, settled: bool = False) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _shown(_findings(spark, sf_dir, check, settled))

    query.__name__ = name
    _query(_findings_sql(check, settled))(query)


for _check in rules.CHECKS:
    _check_query(_check, "check_min_height" if _check == "min_height_mm" else f"check_{_check}", settled=_check == "min_height_mm")


@_query("""SELECT k AS scan_id, 'CARE-01' AS rule_id, CASE WHEN k % 9 = 2 THEN 'EX-SMALL-PACK-ML' ELSE 'EX-SMALL-PACK' END AS exemption_id, CASE WHEN k % 9 = 2 THEN 'Packaged Commodities Rules, r. 26 (10 ml or less)' ELSE 'Packaged Commodities Rules, r. 26 (10 g or less)' END AS citation,
    1.0 AS confidence FROM packs WHERE k % 9 IN (1, 2, 3)""")
def exempt_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exempt rules are not evaluated; they carry the exemption and its citation."""
    found = _findings(spark, sf_dir, "field_present").where("status = 'EXEMPT'")
    return found.select("scan_id", "rule_id", F.col("evidence")["exemption_id"].alias("exemption_id"), "citation", "confidence")


@_query(f"""SELECT verdict, count(*) AS n FROM (SELECT scan_id, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'NOT_ASSESSABLE') THEN 'NOT_ASSESSABLE' WHEN bool_or(status = 'NEEDS_REVIEW') THEN 'NEEDS_REVIEW' WHEN bool_or(status = 'PASS') THEN 'PASS' ELSE 'NOT_ASSESSABLE' END AS verdict
    FROM ({_findings_sql()}) AS f GROUP BY scan_id) AS v GROUP BY verdict""")
def verdict_counts_of_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.verdict_counts(rules.verdict_rollup(_findings(spark, sf_dir)))


@_query("""SELECT scan_id, value, op, limit_g, CASE op WHEN 'lte' THEN g <= limit_g WHEN 'lt' THEN g < limit_g WHEN 'gte' THEN g >= limit_g WHEN 'gt' THEN g > limit_g WHEN 'eq' THEN g = limit_g ELSE FALSE END AS held FROM (
    SELECT scan_id, value, ['lte', 'lt', 'gte', 'gt', 'eq', 'near'][scan_id % 6 + 1] AS op, 10.0::DOUBLE AS limit_g, CASE value WHEN '8 g' THEN 8.0 WHEN '0.01 kg' THEN 10.0 WHEN '11 g' THEN 11.0 WHEN '500 g' THEN 500.0 ELSE 1e9 END AS g FROM declared WHERE field = 'net_quantity') AS q
    WHERE g < 1e9 UNION ALL SELECT scan_id, value, ['lte', 'lt', 'gte', 'gt', 'eq', 'near'][scan_id % 6 + 1], 10.0::DOUBLE, FALSE FROM declared WHERE field = 'net_quantity' AND value NOT IN ('8 g', '0.01 kg', '11 g', '500 g')""")
def condition_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities against 10 g by each operator; other units and unreadable texts never hold."""
    q = view(spark, sf_dir, "declared").where("field = 'net_quantity'")
    op = F.get(F.array(*[F.lit(o) for o in ("lte", "lt", "gte", "gt", "eq", "near")]), (F.col("scan_id") % 6).cast("int"))
    q = q.withColumn("op", op).withColumn("limit_g", F.lit(10.0))
    return q.select("scan_id", "value", "op", "limit_g", rules.condition_compare(F.col("value"), F.col("op"), F.col("limit_g"), F.lit("g")).alias("held"))


@_query("SELECT scan_id, rule_id, status FROM scan_checks WHERE status IN ('FAIL', 'NOT_ASSESSABLE')")
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.violations(view(spark, sf_dir, "scan_checks")).select("scan_id", "rule_id", "status")


_FAULTY = "SELECT scan_id, CASE WHEN scan_id % 41 = 0 THEN ' ' ELSE rule_id END AS rule_id, CASE WHEN scan_id % 37 = 0 THEN NULL ELSE 'r. 6' END AS citation, CASE WHEN scan_id % 31 = 0 THEN 1.5 WHEN scan_id % 31 = 1 THEN NULL ELSE 0.5 END AS confidence, CASE WHEN scan_id % 2 = 0 THEN 'why' END AS reason, status FROM scan_checks"


@_query(f"""SELECT fault, count(*) AS n FROM (SELECT CASE WHEN trim(rule_id) = '' THEN 'no_rule' WHEN citation IS NULL THEN 'no_citation' WHEN confidence IS NULL OR confidence > 1 THEN 'confidence' WHEN status = 'NOT_ASSESSABLE' AND reason IS NULL THEN 'no_reason' END AS fault FROM ({_FAULTY}) AS x) AS y GROUP BY fault""")
def finding_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    faulty = spark.sql(_FAULTY.replace("scan_checks", "{checks}"), checks=view(spark, sf_dir, "scan_checks"))
    return rules.finding_validate(faulty).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


_GROUP_ORDER = "['NOT_ASSESSABLE', 'FAIL', 'NEEDS_REVIEW', 'PASS', 'NOT_APPLICABLE', 'EXEMPT']"


@_query(f"""SELECT scan_id, field, place FROM (SELECT scan_id, field, row_number() OVER (ORDER BY scan_id, w, field) AS place FROM (SELECT scan_id, field, min(list_position({_GROUP_ORDER}, status)) AS w FROM scan_checks GROUP BY 1, 2) AS g) AS n WHERE place <= 100""")
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 lines of the report of all scans."""
    first = rules.report_order(rules.field_groups(view(spark, sf_dir, "scan_checks"))).limit(100)
    listed = first.agg(F.collect_list(F.struct("scan_id", "field")).alias("all"))  # 100 rows
    return listed.select(F.posexplode("all").alias("i", "x")).select("x.scan_id", "x.field", (F.col("i") + 1).cast("long").alias("place"))


# sizes
_OPTICS = """c AS (SELECT *, 1000.0 / nullif(greatest(diopters, 0), 0) AS distance, CASE WHEN image_w_px / image_h_px > sensor_w_mm / sensor_h_mm THEN sensor_w_mm * image_h_px / image_w_px ELSE sensor_h_mm END AS cover,
  CASE WHEN correction <> 1.0 THEN 0.05 WHEN calibration = 2 THEN 0.10 ELSE 0.30 END AS t, CASE WHEN sensor_h_mm IS NULL THEN 'sensor' WHEN calibration = 0 THEN 'uncalibrated' WHEN focal_mm IS NULL THEN 'focal length' WHEN diopters IS NULL THEN 'focus' END AS unavailable FROM optics),
sized AS (SELECT *, CASE WHEN unavailable IS NULL AND distance > focal_mm THEN cover / image_h_px * (greatest(distance * (1 - t), focal_mm * 1.0001) - focal_mm) / focal_mm * correction END AS lo,
  CASE WHEN unavailable IS NULL AND distance > focal_mm THEN cover / image_h_px * (distance * (1 + t) - focal_mm) / focal_mm * correction END AS hi FROM c)
"""


@_query("WITH " + _OPTICS + """SELECT k, round(lo, 6) AS min_mm, round(hi, 6) AS max_mm, unavailable, CASE WHEN lo IS NULL THEN NULL WHEN correction <> 1.0 THEN 'CALIBRATED_DEVICE' ELSE 'REPORTED_OPTICS' END AS scale_source,
    CASE WHEN unavailable IS NOT NULL THEN 'NOT_APPLICABLE' WHEN lo IS NULL THEN 'NOT_ASSESSABLE' WHEN lo * height_px >= 6 THEN 'PASS' WHEN hi * height_px < 6 THEN 'FAIL' ELSE 'NEEDS_REVIEW' END AS status FROM sized""")
def mm_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = measure.min_height(measure.mm_scale(view(spark, sf_dir, "optics")), 6.0)
    return judged.select("k", F.round("min_mm", 6).alias("min_mm"), F.round("max_mm", 6).alias("max_mm"), "unavailable", "scale_source", "status")


@_query("WITH " + _OPTICS + """SELECT k, floor(lo * height_px * 1000000.0 + 0.5) / 1000000.0 AS low_mm, floor(hi * height_px * 1000000.0 + 0.5) / 1000000.0 AS high_mm, floor((lo * height_px + hi * height_px) / 2 * 1000000.0 + 0.5) / 1000000.0 AS middle_mm, CASE WHEN lo IS NOT NULL THEN printf('%.2f-%.2f mm', lo * height_px, hi * height_px) END AS measured FROM sized""")
def mm_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measure.mm_measure(measure.mm_scale(view(spark, sf_dir, "optics")))
    return found.select("k", *[(F.floor(F.col(c) * 1000000.0 + 0.5) / 1000000.0).alias(c) for c in ("low_mm", "high_mm", "middle_mm")], "measured")


@_query("WITH " + _OPTICS + """SELECT f.scan_id, f.field, round(z.lo * (10 + f.scan_id % 30), 6) AS low_mm, round(z.hi * (10 + f.scan_id % 30), 6) AS high_mm FROM declared f JOIN sized z ON z.k = f.scan_id WHERE f.field IN ('mrp', 'net_quantity') AND NOT f.anchor_only AND f.scan_id % 30 > 0 AND z.lo IS NOT NULL""")
def cap_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of prices and quantities where a scale and a box are known."""
    agreed = view(spark, sf_dir, "declared").withColumn("box_h_px", F.when(F.col("scan_id") % 30 > 0, 10 + F.col("scan_id") % 30).otherwise(0))
    scales = measure.mm_scale(view(spark, sf_dir, "optics")).withColumnRenamed("k", "scan_id")
    found = measure.cap_heights(agreed, scales)
    return found.select("scan_id", "field", F.round("low_mm", 6).alias("low_mm"), F.round("high_mm", 6).alias("high_mm"))


@_query("""SELECT k, round(c, 6) AS correction, round((c - 1) * 100, 4) AS error_percent FROM (SELECT k, CASE WHEN r > 1.0 / 3 AND r < 3 THEN r END AS c FROM (SELECT k, reference_mm / nullif(reference_px, 0) / nullif(mm_per_px, 0) AS r FROM shots) AS x) AS y""")
def calibration_compute(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measure.calibration_compute(view(spark, sf_dir, "shots"))
    return found.select("k", F.round("correction", 6).alias("correction"), F.round("error_percent", 4).alias("error_percent"))


@_query("""SELECT s.k, CASE WHEN s.diopters > 0 AND n.diopters > 0 AND s.diopters / n.diopters BETWEEN 0.5 AND 2.0 THEN n.correction ELSE 1.0 END AS correction FROM shots s LEFT JOIN (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY calibrated_at DESC) AS r FROM calibrations WHERE correction BETWEEN 1.0 / 3 AND 3.0) AS x WHERE r = 1) AS n ON n.device_id = s.device_id""")
def calibration_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.calibration_apply(view(spark, sf_dir, "shots"), view(spark, sf_dir, "calibrations")).select("k", "correction")


@_query("""SELECT reference, count(*) AS shots, any_value(reference_mm) AS reference_mm FROM shots GROUP BY reference""")
def reference_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known objects that shots were measured against."""
    used = view(spark, sf_dir, "shots").groupBy("reference").agg(F.count(F.lit(1)).alias("shots"))
    return used.join(F.broadcast(measure.reference_sizes(spark)), "reference").select("reference", "shots", "reference_mm")


# enrolment
_FIELD = "max(CASE WHEN field = '{f}' AND NOT anchor_only AND trim(value) <> '' THEN value END)"


@_query(f"""SELECT concat('SCAN-', CAST(scan_id AS VARCHAR)) AS sku_id, coalesce({_FIELD.format(f='brand')}, '') AS brands, {_m(MONEY, _FIELD.format(f='mrp'))} AS mrp_exact, {_FIELD.format(f='net_quantity')} AS net_quantity, {_FIELD.format(f='fssai_licence')} AS fssai_licence
    FROM declared GROUP BY scan_id HAVING count(*) FILTER (NOT anchor_only AND trim(value) <> '') > 0""")
def enrol_from_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = match.enrol_from_scan(view(spark, sf_dir, "declared"))
    return rows.select("sku_id", F.array_join("brand_strings", "|").alias("brands"), "mrp_exact", "net_quantity", "fssai_licence")


@_query("SELECT scan_id, field, value FROM declared WHERE NOT anchor_only AND trim(value) <> ''")
def matchable_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.matchable_fields(view(spark, sf_dir, "declared")).select("scan_id", "field", "value")


@_query("""SELECT allowed, count(*) AS n FROM (SELECT d.device_id IS NOT NULL AS allowed FROM scans s LEFT JOIN (SELECT DISTINCT device_id FROM devices WHERE role = 'INSPECTOR') d ON d.device_id = CAST(s.device_id AS VARCHAR)) AS x GROUP BY allowed""")
def enrol_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = view(spark, sf_dir, "scans").select("id", F.col("device_id").cast("string").alias("device_id"))
    return match.enrol_allowed(asked, view(spark, sf_dir, "devices")).groupBy("allowed").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT source, known, CASE known WHEN 'IMPORTED' THEN 'AUTHORITATIVE' ELSE 'ASSERTED' END AS authority, n FROM (SELECT source, CASE WHEN source IN ('IMPORTED', 'MANUAL', 'ENROLLED_FROM_SCAN') THEN source ELSE 'ENROLLED_FROM_SCAN' END AS known, count(*) AS n FROM (SELECT CASE WHEN saved_at % 7000 = 0 THEN 'guess' ELSE source END AS source FROM registry) AS r GROUP BY source) AS g")
def authority_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "registry").select(F.when(F.col("saved_at") % 7000 == 0, "guess").otherwise(F.col("source")).alias("source"))
    return r.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", match.known_source(F.col("source")).alias("known"), match.authority(F.col("source")).alias("authority"), "n")


@_query("SELECT sku_id, brand, source FROM registry ORDER BY sku_id")
def sku_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.sku_list(view(spark, sf_dir, "registry").select("sku_id", "brand", "source"))


_PRICE_WORDS = "trim(regexp_replace(lower(coalesce(mrp, '')), '\\s+', ' ', 'g'))"
_BRAND_WORDS = _PRICE_WORDS.replace("mrp", "brand")
_QTY_FORM = f"CASE WHEN len(string_split({_QTY_WORDS}, ' ')) = 2 THEN concat(split_part({_QTY_WORDS}, ' ', 1), ' ', {_FOLDED.format(w=_QTY_WORDS)}) ELSE {_QTY_WORDS} END"


@_query(f"SELECT id, {_BRAND_WORDS} AS brand, CASE WHEN try_cast(trim(mrp) AS DOUBLE) IS NOT NULL THEN printf('%.2f', try_cast(trim(mrp) AS DOUBLE)) ELSE {_PRICE_WORDS} END AS price, {_QTY_FORM} AS quantity FROM scans")
def match_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal forms of the server's matcher: numbers to two places, two-word quantities with the unit folded."""
    scans = view(spark, sf_dir, "scans")
    return scans.select("id", server_text(F.col("brand")).alias("brand"), server_money(F.col("mrp")).alias("price"), server_quantity(F.col("net_quantity")).alias("quantity"))


# search and lists
@_query("""SELECT id, verdict FROM scans s WHERE lower(verdict) LIKE '%tax-0%' OR lower(brand) LIKE '%tax-0%' OR EXISTS (SELECT 1 FROM scan_checks c WHERE c.scan_id = s.id AND lower(c.rule_id) LIKE '%tax-0%')""")
def scan_search_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans with a rule whose id or name holds the text."""
    checks = view(spark, sf_dir, "scan_checks").groupBy("scan_id").agg(F.collect_list(F.struct("rule_id", F.lit("").alias("rule_name"))).alias("checks"))
    scans = view(spark, sf_dir, "scans")
    nested = scans.join(checks, scans["id"] == checks["scan_id"], "left").withColumn("checks", F.coalesce("checks", F.array().cast(checks.schema["checks"].dataType)))
    return fleet.scan_search_checks(nested, "Tax-0").select("id", "verdict")


@_query("""SELECT s.id, s.device_id, count(c.rule_id) AS n FROM scans s LEFT JOIN scan_checks c ON c.scan_id = s.id WHERE s.id = 7 AND s.device_id = (SELECT device_id FROM scans WHERE id = 7) GROUP BY 1, 2""")
def scan_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan, asked for by its own device."""
    scans = view(spark, sf_dir, "scans")
    own = scans.where("id = 7").select("device_id").first()
    found = fleet.scan_by_id(scans, view(spark, sf_dir, "scan_checks"), 7, "CONSUMER", own["device_id"] if own else -1)
    return found.select("id", "device_id", F.size("checks").cast("long").alias("n"))


@_query("SELECT id, verdict FROM scans WHERE verdict = 'NEEDS_REVIEW'")
def verdict_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.verdict_filter(view(spark, sf_dir, "scans"), "needs_review").select("id", "verdict")


@_query("SELECT s.id, coalesce(CAST(d.id AS VARCHAR), CAST(s.device_id AS VARCHAR)) AS device_key FROM scans s LEFT JOIN devices d ON d.device_id = CAST(s.device_id AS VARCHAR)")
def scan_device_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.scan_device_lookup(view(spark, sf_dir, "scans"), view(spark, sf_dir, "devices")).select("id", "device_key")


_CITED = " ".join(f"WHEN '{r['id']}' THEN '{r['citation']}'" for r in _RULES)


@_query(f"""SELECT scan_id, rule_id, CASE WHEN scan_id % 5 = 0 THEN 'own' ELSE CASE rule_id {_CITED} ELSE 'Statutory requirement' END END AS citation FROM (SELECT scan_id, CASE WHEN scan_id % 7 = 0 THEN 'OLD-01' ELSE rule_id END AS rule_id FROM scan_checks) AS c""")
def citation_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = view(spark, sf_dir, "scan_checks").select("scan_id", F.when(F.col("scan_id") % 7 == 0, "OLD-01").otherwise(F.col("rule_id")).alias("rule_id"), F.when(F.col("scan_id") % 5 == 0, "own").alias("citation"))
    return fleet.citation_default(checks, rules.load_rules(spark)[0]).select("scan_id", "rule_id", "citation")


@_query("SELECT id, CASE WHEN id % 3 = 0 THEN 'server' ELSE 'device' END AS source, CAST(NULL AS VARCHAR) AS image_key FROM scans")
def scan_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = view(spark, sf_dir, "scans").withColumn("source", F.when(F.col("id") % 3 == 0, "server"))
    return fleet.scan_provenance(scans).select("id", "source", "image_key")


@_query("""SELECT scan_id, rule_id, ['FAIL', 'NOT_ASSESSABLE', 'NEEDS_REVIEW', 'PASS', 'NOT_APPLICABLE', 'EXEMPT'][min(list_position(['FAIL', 'NOT_ASSESSABLE', 'NEEDS_REVIEW', 'PASS', 'NOT_APPLICABLE', 'EXEMPT'], status))] AS status FROM (
    SELECT l_orderkey AS scan_id, CAST(l_linenumber AS VARCHAR) AS rule_id, CASE l_returnflag WHEN 'R' THEN 'FAIL' WHEN 'A' THEN 'PASS' ELSE 'NEEDS_REVIEW' END AS status FROM lineitem) AS x GROUP BY 1, 2""")
def scan_checks_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as checks: several of one scan and rule are one."""
    status = F.when(F.col("l_returnflag") == "R", "FAIL").when(F.col("l_returnflag") == "A", "PASS").otherwise("NEEDS_REVIEW")
    checks = view(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").cast("string").alias("rule_id"), status.alias("status"), F.lit("f").alias("field"), F.lit(None).cast("string").alias("observed"))
    return fleet.scan_checks_unique(checks).select("scan_id", "rule_id", "status")


@_query(f"SELECT DISTINCT product FROM (SELECT {PRODUCT} AS product FROM scans UNION ALL SELECT sku_id FROM registry) AS u WHERE product IS NOT NULL")
def union_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.union_products(view(spark, sf_dir, "scans").withColumn("product", fleet.product_key()), view(spark, sf_dir, "registry").withColumn("product", F.col("sku_id")))


@_query(f"""SELECT product, string_agg(v, '|' ORDER BY scanned_at, id) AS seen FROM (SELECT product, v, scanned_at, id, row_number() OVER (PARTITION BY product, v ORDER BY scanned_at, id) AS r FROM (
    SELECT {PRODUCT} AS product, nullif(trim(mrp), '') AS v, scanned_at, id FROM scans) AS x WHERE product IS NOT NULL AND v IS NOT NULL) AS y WHERE r = 1 GROUP BY product""")
def distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.distinct_in_order(view(spark, sf_dir, "scans"), "mrp")


_ITEMS = "SELECT o_custkey AS run_id, o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'could not be read' END AS error, CASE WHEN o_orderkey % 10 < 2 THEN NULL ELSE CAST(o_orderkey % 4 AS BIGINT) END AS failed FROM orders"


@_query(f"""SELECT run_id, count(*) FILTER (error IS NOT NULL OR failed IS NOT NULL) AS processed, count(*) AS total, count(*) FILTER (failed > 0) AS failures FROM ({_ITEMS}) AS i GROUP BY run_id""")
def bulk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.sql(_ITEMS.replace("FROM orders", "FROM {orders}"), orders=view(spark, sf_dir, "orders"))
    return fleet.bulk_summary(items).select("run_id", "processed", "total", "failures")


@_query("SELECT id, synced_at - scanned_at AS lag_ms FROM scans")
def sync_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.sync_lag(view(spark, sf_dir, "scans")).select("id", "lag_ms")


@_query("""SELECT scan_id, side, field FROM (SELECT scan_id, side, field, max(v) AS v, any_value(frames) AS frames FROM (
    SELECT o.scan_id, o.side, o.field, count(*) AS v, any_value(n.frames) AS frames FROM observations o JOIN (SELECT scan_id, side, count(DISTINCT frame) AS frames FROM observations GROUP BY 1, 2) n ON n.scan_id = o.scan_id AND n.side = o.side
    WHERE o.field = 'batch_number' GROUP BY 1, 2, 3, CASE WHEN trim(o.value) = '' THEN '' ELSE 'b-12 x' END) AS g GROUP BY 1, 2, 3) AS b WHERE v < least(3, frames) ORDER BY 1, 2, 3""")
def unresolved_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch numbers that the frames of a side did not settle."""
    o = view(spark, sf_dir, "observations").where("field = 'batch_number'")
    return consensus.unresolved_fields(consensus.consensus_vote(o))


@_query("""SELECT k AS image, concat(CAST(year(d) AS VARCHAR), '/', lpad(CAST(month(d) AS VARCHAR), 2, '0'), '/', lpad(CAST(day(d) AS VARCHAR), 2, '0'), '/', CAST(k AS VARCHAR), CASE k % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.webp' ELSE '.bin' END) AS image_key FROM packs""")
def image_date_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*[F.lit(x) for x in ("image/jpeg", "image/png", "image/webp", "text/plain")]), (F.col("k") % 4).cast("int"))
    packs = view(spark, sf_dir, "packs").select("k", F.col("k").cast("string").alias("image_id"), kind.alias("content_type"), F.col("d").cast("timestamp").alias("created"))
    return packs.select(F.col("k").alias("image"), image_key().alias("image_key"))


_ENTRY = "SELECT CAST(id % {n} AS BIGINT) AS id, id AS image_id, verdict, scanned_at AS created_at FROM scans"


@_query(f"""SELECT id, image_id, verdict, created_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fresh DESC, created_at DESC, image_id, verdict) AS r FROM (
    SELECT *, 0 AS fresh FROM ({_ENTRY.format(n=900)} WHERE id % 2 = 0) AS a UNION ALL SELECT *, 1 AS fresh FROM ({_ENTRY.format(n=700)} WHERE id % 2 = 1) AS b) AS u) AS n WHERE r = 1""")
def corpus_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by id: the incoming take the place of the current."""
    scans = view(spark, sf_dir, "scans")
    entry = lambda n, odd: scans.where(F.col("id") % 2 == odd).select((F.col("id") % n).cast("long").alias("id"), F.col("id").alias("image_id"), "verdict", F.col("scanned_at").alias("created_at"))
    return upsert_corpus(entry(900, 0), entry(700, 1))


@_query("SELECT id, created_at FROM (SELECT id, scanned_at AS created_at FROM scans) AS c ORDER BY created_at DESC, id LIMIT 50")
def corpus_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_corpus(view(spark, sf_dir, "scans").select("id", F.col("scanned_at").alias("created_at")))


@_query(f"""SELECT CAST(scan_id AS VARCHAR) AS image_id, string_agg(concat(field, '=', status, ':', coalesce(v, '-')), ';' ORDER BY field) AS fields, (SELECT coalesce(string_agg(rule_id, ',' ORDER BY rule_id), '') FROM scan_checks w WHERE w.scan_id = g.scan_id AND w.status = 'FAIL') AS violations FROM (
    SELECT scan_id, field, {_GROUP_ORDER}[min(list_position({_GROUP_ORDER}, status))] AS status, arg_min(observed, rule_id) FILTER (observed IS NOT NULL) AS v FROM scan_checks GROUP BY 1, 2) AS g GROUP BY scan_id""")
def export_results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of all scans with checks, read back."""
    findings = view(spark, sf_dir, "scan_checks").withColumn("agreement", F.lit(None).cast("string"))
    about = view(spark, sf_dir, "scans").select(
        F.col("id").alias("scan_id"), F.col("id").cast("string").alias("image_id"), "verdict", "ruleset_version", F.lit(3).alias("frames_used"), F.lit(None).cast("long").alias("elapsed_ms"), "scanned_at", F.array().cast("array<string>").alias("raw_lines"))
    scans = findings.select("scan_id").distinct().join(about, "scan_id", "left").withColumn("image_id", F.col("scan_id").cast("string"))
    doc = F.from_json("document", "fields map<string, struct<present: boolean, value: string, status: string>>, violations array<string>")
    read = export_results(findings, scans).select("image_id", doc.alias("d"))
    shown = F.transform(F.array_sort(F.map_entries("d.fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"]["status"], F.lit(":"), F.coalesce(e["value"]["value"], F.lit("-"))))
    return read.select("image_id", F.array_join(shown, ";").alias("fields"), F.array_join("d.violations", ",").alias("violations"))
