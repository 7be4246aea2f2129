"""Registered queries on tables that streams and merges keep up to date, and the SQL each is checked against."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.catalog import _BUCKET, _CONFLICTS, _IDENTITY_ROWS, _UPSERTED, _WEIGHTED_ROWS, _QTY, _TAX, _VOTE, _WITH_CHECKS, PRODUCT, Q_MAG, _barred, _checks_told, _m, _query, _registry
from packlens.operators import fleet, flow, rules, search
from packlens.operators.match import IDENTITY, WEIGHTED, Scorer
from packlens.operators.rematch import MatchIndex
from packlens.plans.bind import view
from packlens.sources.files import read_table, write_table
from packlens.sources.folders import listed, shared_folder, written
from packlens.streaming import ingest

#: Micro-batches that a table is streamed in.
BATCHES = 3
#: A range of scanned_at that cuts the day at both of its ends.
SINCE, UNTIL = 725846400000 + 12_345_678, 978307200000 + 40_000_000


def _streamed(df: DataFrame, name: str) -> DataFrame:
    """A stream of what df holds, in some micro-batches whose order is not that of the rows."""
    path, spark = shared_folder(df.sparkSession, name), df.sparkSession
    df.repartition(2 * BATCHES).write.parquet(path)
    files = sum(n.endswith(".parquet") for n in listed(spark, path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-files // BATCHES)).parquet(path)


@_query(_UPSERTED)
def stream_registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams, each with its own checkpoint, one after another into one registry."""
    path = shared_folder(spark, "registry")
    for name in ("registry", "registry_update"):
        columns = ["sku_id", "brand", F.col("mrp").cast("string").alias("mrp"), "net_quantity", "source", F.col("saved_at").cast("long").alias("saved_at")]
        stream = _streamed(view(spark, sf_dir, name).select(*columns), name)
        ingest.stream_registry_upsert(stream, path, shared_folder(spark, f"{name}-checkpoint")).awaitTermination()
    return ingest.registry_table(spark, path, stream.schema).read()


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = view(spark, sf_dir, "scans").select("id", "device_id", "scanned_at", "verdict", "sku_id", "brand", "mrp", "net_quantity")
    checks = view(spark, sf_dir, "scan_checks").groupBy("scan_id").agg(F.collect_list(F.struct("rule_id", "status")).alias("checks"))
    return scans.join(checks, scans["id"] == checks["scan_id"], "left").drop("scan_id")


def _fleet(spark: SparkSession, sf_dir: str) -> ingest.Fleet:
    """All scans through one stream, then a third of them once more, with another verdict, through a second one."""
    scans = written(_nested(spark, sf_dir), "nested-scans")
    held = ingest.Fleet(spark, shared_folder(spark, "fleet"), scans.schema, ["scanned_at"], days=256, parts=2, folders=16)
    again = scans.where("id % 3 = 0").withColumn("verdict", F.lit("PASS"))
    for name, some in (("sent", scans), ("sent-again", again)):
        ingest.stream_fleet(_streamed(some, name), held, shared_folder(spark, f"{name}-checkpoint")).awaitTermination()
    return held


@_query(_CONFLICTS)
def stream_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _barred(_fleet(spark, sf_dir).conflicts())


_TOLD = "(SELECT string_agg(concat({k}, '=', CAST(n AS VARCHAR)), ',' ORDER BY {o}) FROM ({q}) AS told)"
_REPORT = f"""WITH chosen AS (SELECT * FROM scans WHERE {{where}})
    SELECT count(*) AS total, count(*) FILTER (verdict = 'FAIL') AS failed, count(*) FILTER (verdict = 'PASS') AS passed, coalesce(round(count(*) FILTER (verdict IN ('FAIL', 'PASS')) / count(*), 4), 0.0) AS conclusive_rate, count(DISTINCT {PRODUCT}) AS products,
    {_TOLD.format(k='verdict', o='verdict', q='SELECT verdict, count(*) AS n FROM chosen GROUP BY verdict')} AS by_verdict,
    {_TOLD.format(k='rule_id', o='n DESC, rule_id', q="SELECT c.rule_id, count(*) AS n FROM scan_checks c JOIN chosen s ON s.id = c.scan_id WHERE c.status = 'FAIL' GROUP BY c.rule_id ORDER BY n DESC, c.rule_id LIMIT 5")} AS top_violations FROM chosen"""


def _told(report: DataFrame) -> DataFrame:
    verdicts = F.array_join(F.transform(F.array_sort(F.map_entries("by_verdict")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    violations = F.array_join(F.transform("top_violations", lambda e: F.concat(e["rule_id"], F.lit("="), e["n"].cast("string"))), ",")
    return report.withColumns({"by_verdict": verdicts, "top_violations": violations})


@_query(_REPORT.format(where=f"scanned_at BETWEEN {SINCE} AND {UNTIL}"))
def stream_fleet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_fleet(spark, sf_dir).summary(since=SINCE, until=UNTIL))


@_query(_REPORT.format(where=f"device_id = 7 AND scanned_at >= {SINCE}"))
def fleet_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(fleet.fleet_report(fleet.time_range(fleet.scan_scope(_nested(spark, sf_dir), "CONSUMER", 7), SINCE, None)))


_SAME_PRICE = "printf('%.2f', floor(try_cast(nullif(regexp_extract(replace(replace(replace(mrp, 'Rs.', ' '), '₹', ' '), '/-', ' '), '[0-9]+(?:\\.[0-9]+)?', 0), '') AS DOUBLE) * 100 + 0.5) / 100)"
_NORMALISED = f"""WITH seen AS (SELECT {PRODUCT} AS product, trim(mrp) AS v, {_SAME_PRICE} AS s, scanned_at, id FROM scans),
    firsts AS (SELECT product, s, min((scanned_at, id, v)) AS f FROM seen WHERE product IS NOT NULL AND s IS NOT NULL GROUP BY product, s)
    SELECT product, string_agg(f[3], '|' ORDER BY f[1], f[2]) AS prices FROM firsts GROUP BY product HAVING count(*) > 1"""


@_query(_NORMALISED)
def product_conflicts_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices that differ in what they say, not only in how they are printed."""
    found = fleet.product_conflicts(view(spark, sf_dir, "scans"), normalised=True).where(F.size("prices") > 0)
    return found.select("product", F.array_join("prices", "|").alias("prices"))


def _kept_matches(spark: SparkSession, sf_dir: str, scorer: Scorer) -> DataFrame:
    """Half the scans meet a registry that lacks, misprices and has too many products; then it is put right, then the other half comes."""
    scans, registry = written(view(spark, sf_dir, "scans").select("id", *scorer.said), "scans"), _registry(spark, sf_dir)
    number = F.substring("sku_id", 5, 20).cast("long")
    wrong = registry.where(number % 5 != 0).withColumns({"mrp": F.when(number % 7 == 1, F.col("mrp") + 1).otherwise(F.col("mrp")), "net_quantity": F.when(number % 9 == 2, "1 pack").otherwise(F.col("net_quantity"))})
    extra = registry.where(number % 6 == 0).withColumn("sku_id", F.concat(F.lit("OLD-"), "sku_id"))
    index = MatchIndex(spark, shared_folder(spark, "matches"), scorer, buckets=16)
    index.update(wrong.unionByName(extra))
    index.add(scans.where("id % 2 = 0"))
    index.update(registry.where((number % 5 == 0) | (number % 7 == 1) | (number % 9 == 2)), removed=extra)
    index.add(scans)
    return index.matches(scans)


@_query(_WEIGHTED_ROWS)
def registry_match_weighted_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_matches(spark, sf_dir, WEIGHTED)


@_query(_IDENTITY_ROWS)
def registry_match_identity_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_matches(spark, sf_dir, IDENTITY)


@_query(_WITH_CHECKS)
def scan_with_checks_colocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that are written in buckets by scan join and nest without a shuffle."""
    folder, tables = shared_folder(spark, "by-scan"), {n: view(spark, sf_dir, n) for n in ("scans", "scan_checks")}
    for name, df in tables.items():
        write_table(df, folder, name, buckets=8)
    return _checks_told(fleet.scan_with_checks(*[read_table(spark, folder, n, df.schema, buckets=8) for n, df in tables.items()]))


@_query("""SELECT s.id, s.scanned_at, t.total, greatest(CAST(ceil(t.total / 20.0) AS BIGINT), 1) AS pages FROM scans s, (SELECT count(*) AS total FROM scans) t
    ORDER BY s.scanned_at DESC, s.id LIMIT 20 OFFSET 10000""")
def scan_page_by_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 501: the ranges before it are counted, not read."""
    scans, path = view(spark, sf_dir, "scans").select("id", "scanned_at"), shared_folder(spark, "pages")
    search.write_pages(scans, path, parts=16)
    return search.read_page(spark, path, 501, 20, scans.schema)


_HOLDS = " OR ".join(f"contains(lower({c}), '{{t}}')" for c in fleet.SEARCHED)


@_query(f"SELECT id, brand, mrp FROM scans WHERE {_HOLDS.format(t='brand#13')} UNION ALL SELECT id, brand, mrp FROM scans WHERE {_HOLDS.format(t='12/-')}")
def scan_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two searches by one index."""
    scans, path = written(view(spark, sf_dir, "scans"), "scans"), shared_folder(spark, "search")
    search.write_search_index(scans, path, buckets=16)
    some = [search.search_indexed(scans, path, text, buckets=16).select("id", "brand", "mrp") for text in (" Brand#13 ", "12/-")]
    return some[0].unionByName(some[1])


_MRP = "'(?i)(?:₹|rs\\.?|inr)?\\s*(\\d+(?:\\.\\d{1,2})?)'"
_PRICED = "'(?i)(?:mrp|m\\.r\\.p|rs\\.?|₹|inr|अधिकतम\\s*खुदरा\\s*मूल्य)'"
_DIGITS = "regexp_replace(regexp_extract(text, '\\d[\\d\\s\\-]{8,26}\\d', 0), '\\D', '', 'g')"
# every frame of every side: its fields by the lines' wording, then the votes over frames, the merge of sides and the rules
_FRAMES = f"""frame_fields AS (SELECT scan_id, side, frame, arg_min(regexp_extract(text, {_MRP}, 1), line_no) FILTER (regexp_matches(text, {_PRICED}) AND regexp_matches(text, '\\d')) AS mrp,
      arg_min(trim(regexp_extract(text, {_QTY}, 0)), line_no + CASE WHEN regexp_matches(text, '(?i)net\\s*(?:qty|quantity|wt|weight)') THEN 0 ELSE 1000000 END) FILTER (regexp_matches(text, {_QTY})) AS net_quantity,
      arg_min({_DIGITS}, line_no) FILTER (length({_DIGITS}) = 14) AS number, bool_or(regexp_matches(text, '(?i)fssai|\\blic\\b\\.?|licence\\s*no|license\\s*no')) AS licensed,
      arg_min(trim(text), line_no) FILTER (regexp_matches(text, {_TAX})) AS line, string_agg(text, ' ' ORDER BY line_no) AS joined, arg_min(trim(text), line_no) FILTER (lower(text) LIKE '%incl%') AS incl,
      arg_min(trim(text), line_no) FILTER (lower(text) LIKE '%tax%') AS tax, arg_min(trim(text), line_no) FILTER (regexp_matches(text, '(?i)(?:mrp|m\\.r\\.p|rs\\.?|₹|inr)')) AS price,
      arg_min(trim(text), line_no) FILTER (regexp_matches(lower(text), 'consumer care|customer care|consumer complaints|for complaints')) AS care,
      bool_or(contains(lower(text), 'manufactured by: ')) AS made FROM side_lines GROUP BY scan_id, side, frame),
    frame_observations AS (SELECT scan_id, side, frame, field, value FROM (
      SELECT scan_id, side, frame, 'mrp' AS field, mrp AS value FROM frame_fields UNION ALL SELECT scan_id, side, frame, 'net_quantity', net_quantity FROM frame_fields
      UNION ALL SELECT scan_id, side, frame, 'fssai_licence', CASE WHEN number IS NOT NULL THEN number WHEN licensed THEN '' END FROM frame_fields
      UNION ALL SELECT scan_id, side, frame, 'tax_inclusive', coalesce(line, CASE WHEN regexp_matches(joined, {_TAX}) THEN coalesce(incl, tax, price) END) FROM frame_fields
      UNION ALL SELECT scan_id, side, frame, 'consumer_care', care FROM frame_fields UNION ALL SELECT scan_id, side, frame, 'maker', CASE WHEN made THEN 'maker' END FROM frame_fields
      UNION ALL SELECT scan_id, side, frame, 'seen', 'x' FROM frame_fields) AS each_field WHERE value IS NOT NULL)"""
_MERGED = f"""sided AS (SELECT scan_id, side, field, value, agreed, confidence, agreed AND trim(coalesce(value, '')) <> '' AS filled, {_BUCKET} AS bucket FROM agreed),
    merged AS (SELECT scan_id, field, CASE WHEN n <= 1 THEN b.value END AS value FROM (SELECT scan_id, field, count(DISTINCT CASE WHEN filled THEN bucket END) AS n,
      min(CASE WHEN agreed THEN {{'f': -CAST(filled AS INT), 'c': -confidence, 's': side, 'value': value}} END) AS b FROM sided GROUP BY 1, 2) AS g),
    wide AS (SELECT s.scan_id, max(m.value) FILTER (m.field = 'mrp') AS mrp, max(m.value) FILTER (m.field = 'net_quantity') AS net_quantity, max(m.value) FILTER (m.field = 'fssai_licence') AS licence,
      max(m.value) FILTER (m.field = 'tax_inclusive') AS tax, max(m.value) FILTER (m.field = 'consumer_care') AS care, max(m.value) FILTER (m.field = 'maker') AS maker, max(h.low_mm) AS low_mm, max(h.high_mm) AS high_mm
      FROM (SELECT DISTINCT scan_id FROM side_lines) s LEFT JOIN merged m ON m.scan_id = s.scan_id LEFT JOIN side_heights h ON h.scan_id = s.scan_id GROUP BY s.scan_id),
    findings AS (SELECT scan_id, 'MRP-01' AS rule_id, {{p}} AS status FROM (SELECT scan_id, mrp AS v FROM wide) AS x UNION ALL SELECT scan_id, 'QTY-01', {{p}} FROM (SELECT scan_id, net_quantity AS v FROM wide) AS x
      UNION ALL SELECT scan_id, 'FSSAI-01', {{p}} FROM (SELECT scan_id, licence AS v FROM wide) AS x UNION ALL SELECT scan_id, 'TAX-01', {{p}} FROM (SELECT scan_id, tax AS v FROM wide) AS x
      UNION ALL SELECT scan_id, 'CARE-01', CASE WHEN small THEN 'EXEMPT' ELSE {{p}} END FROM (SELECT scan_id, care AS v, coalesce({_m(Q_MAG, 'net_quantity')} <= 10, FALSE) AS small FROM wide) AS x
      UNION ALL SELECT scan_id, 'MFR-01', CASE WHEN maker IS NOT NULL THEN 'PASS' ELSE 'NEEDS_REVIEW' END FROM wide
      UNION ALL SELECT scan_id, 'CAP-01', CASE WHEN low_mm IS NULL THEN 'NOT_ASSESSABLE' WHEN low_mm >= 1.0 THEN 'PASS' WHEN high_mm < 1.0 THEN 'FAIL' ELSE 'NEEDS_REVIEW' END FROM wide)"""
_MERGED = _MERGED.replace("{p}", "CASE WHEN coalesce(v, '') <> '' THEN 'PASS' ELSE 'FAIL' END")
_FRAME_VOTE = _VOTE.strip().removeprefix("WITH ").replace("FROM observations", "FROM frame_observations")
_ORDERED = ["FAIL", "NOT_ASSESSABLE", "NEEDS_REVIEW", "PASS"]
JUDGED = ("MRP-01", "QTY-01", "FSSAI-01", "TAX-01", "CARE-01", "MFR-01", "CAP-01")


@_query(f"""WITH {_FRAMES}, {_FRAME_VOTE}, {_MERGED}
    SELECT scan_id, count(*) AS n, string_agg(concat(rule_id, '=', status), ',' ORDER BY rule_id) AS findings, {_ORDERED}[min(list_position({_ORDERED}, status))] AS verdict FROM findings GROUP BY scan_id""")
def verdicts_from_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of four frames of two sides, some misread, to verdicts by seven rules, the height rule without what holds it back."""
    root = json.loads(rules.CANONICAL.read_text())
    root["rules"] = [r for r in root["rules"] if r["id"] in JUDGED]
    for r in root["rules"]:
        r["check"]["params"] = {k: v for k, v in (r["check"].get("params") or {}).items() if not k.startswith("needs_")}
    ruleset, exempt, _ = rules.load_rules(spark, json.dumps(root))
    findings = flow.judge(view(spark, sf_dir, "side_lines", dealt=True), ruleset, exempt, "2026-09-05", heights=view(spark, sf_dir, "side_heights"))
    told = F.array_join(F.array_sort(F.collect_list(F.concat("rule_id", F.lit("="), "status"))), ",")
    return findings.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"), told.alias("findings"), rules._verdict().alias("verdict"))
