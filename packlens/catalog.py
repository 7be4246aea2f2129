"""Registered queries of the engine and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.functions.dates import certain, date_shift, describe, label_date, label_period, possibly_after, resolved
from packlens.functions.normalize import norm_money, norm_quantity, norm_text, token_jaccard
from packlens.operators import consensus, extract, fleet, match, measure, quality, rules
from packlens.plans.bind import view, with_views
from packlens.streaming.ingest import first_copies

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TODAY = "2001-06-15"
CHECK_DAY = "2026-09-05"


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


# SQL pieces that several oracles share
MONEY = "floor(try_cast(nullif(regexp_extract(replace(replace(replace(replace(replace(replace(replace(lower({c}), '₹', ' '), 'rs.', ' '), 'rs', ' '), 'inr', ' '), 'mrp', ' '), '/-', ' '), ',', ''), '[0-9]+(?:\\.[0-9]+)?', 0), '') AS DOUBLE) * 100.0 + 0.5) / 100.0"
Q_NUM = "try_cast(nullif(regexp_extract(replace(lower({c}), ',', ''), '([0-9]+(?:[.,][0-9]+)?)\\s*([a-zA-Z]+)', 1), '') AS DOUBLE)"
Q_UNIT = "regexp_extract(replace(lower({c}), ',', ''), '([0-9]+(?:[.,][0-9]+)?)\\s*([a-zA-Z]+)', 2)"
Q_FACTOR = f"CASE WHEN {Q_UNIT} IN ('g','gm','gms','gram','grams','ml','millilitre','millilitres','milliliter') THEN 1.0::DOUBLE WHEN {Q_UNIT} IN ('kg','kgs','kilogram','kilograms','l','ltr','litre','litres','liter') THEN 1000.0::DOUBLE WHEN {Q_UNIT} = 'mg' THEN 0.001::DOUBLE END"
Q_NAME = f"CASE WHEN {Q_UNIT} IN ('g','gm','gms','gram','grams','kg','kgs','kilogram','kilograms','mg') THEN 'g' WHEN {Q_UNIT} IN ('ml','millilitre','millilitres','milliliter','l','ltr','litre','litres','liter') THEN 'ml' END"
Q_MAG = f"floor({Q_NUM} * {Q_FACTOR} * 10000.0 + 0.5) / 10000.0"
TEXT = "trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}\\p{{M}}\\s.@+_-]', ' ', 'g'), '\\s+', ' ', 'g'))"
PRODUCT = "coalesce(nullif(sku_id, ''), nullif(trim(brand), ''))"


def _m(template: str, c: str) -> str:
    return template.format(c=c)


@_query(f"SELECT scan_id, frame, field, value, {_m(MONEY, 'value')} AS money FROM observations")
def norm_money_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "observations").select("scan_id", "frame", "field", "value", norm_money(F.col("value")).alias("money"))


@_query(f"SELECT id, {_m(Q_MAG, 'net_quantity')} AS magnitude, CASE WHEN {_m(Q_MAG, 'net_quantity')} IS NOT NULL THEN {_m(Q_NAME, 'net_quantity')} END AS unit FROM scans")
def norm_quantity_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = norm_quantity(F.col("net_quantity"))
    return view(spark, sf_dir, "scans").select("id", q["magnitude"].alias("magnitude"), q["unit"].alias("unit"))


@_query(f"SELECT doc_id, {_m(TEXT, 'text')} AS normal FROM documents")
def norm_text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file may have few row groups, and a row group is read by one task, so texts are dealt over all tasks first."""
    docs = view(spark, sf_dir, "documents").select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return docs.select("doc_id", norm_text(F.col("text")).alias("normal"))


_DAY = "try_cast(concat(lpad(({y})::VARCHAR, 4, '0'), '-', lpad(({m})::VARCHAR, 2, '0'), '-', lpad(({d})::VARCHAR, 2, '0')) AS DATE)"
_DATES = """
WITH g AS (
  SELECT k, raw, regexp_matches(raw, '\\b(\\d{4})-(\\d{1,2})\\b') AS iso, try_cast(nullif(regexp_extract(raw, '\\b(\\d{4})-(\\d{1,2})\\b', 1), '') AS INT) AS iy, try_cast(nullif(regexp_extract(raw, '\\b(\\d{4})-(\\d{1,2})\\b', 2), '') AS INT) AS im,
    regexp_matches(raw, '\\b(\\d{1,2})[/.\\-\\s]{1,2}(\\d{1,2})[/.\\-\\s]{1,2}(\\d{2,4})\\b') AS dmy,
    try_cast(nullif(regexp_extract(raw, '\\b(\\d{1,2})[/.\\-\\s]{1,2}(\\d{1,2})[/.\\-\\s]{1,2}(\\d{2,4})\\b', 1), '') AS INT) AS a, try_cast(nullif(regexp_extract(raw, '\\b(\\d{1,2})[/.\\-\\s]{1,2}(\\d{1,2})[/.\\-\\s]{1,2}(\\d{2,4})\\b', 2), '') AS INT) AS b,
    try_cast(nullif(regexp_extract(raw, '\\b(\\d{1,2})[/.\\-\\s]{1,2}(\\d{1,2})[/.\\-\\s]{1,2}(\\d{2,4})\\b', 3), '') AS INT) AS y0,
    try_cast(nullif(regexp_extract(raw, '(?i)\\b(?:(\\d{1,2})[/.\\-\\s]{0,2})?([a-z]{3,9})[/.\\-\\s]{0,2}(\\d{2,4})\\b', 1), '') AS INT) AS nd,
    list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], left(lower(regexp_extract(raw, '(?i)\\b(?:(\\d{1,2})[/.\\-\\s]{0,2})?([a-z]{3,9})[/.\\-\\s]{0,2}(\\d{2,4})\\b', 2)), 3)) AS nm,
    try_cast(nullif(regexp_extract(raw, '(?i)\\b(?:(\\d{1,2})[/.\\-\\s]{0,2})?([a-z]{3,9})[/.\\-\\s]{0,2}(\\d{2,4})\\b', 3), '') AS INT) AS ny,
    try_cast(nullif(regexp_extract(raw, '\\b(\\d{1,2})[/.\\-\\s]{1,2}(\\d{4})\\b', 1), '') AS INT) AS mm, try_cast(nullif(regexp_extract(raw, '\\b(\\d{1,2})[/.\\-\\s]{1,2}(\\d{4})\\b', 2), '') AS INT) AS my
  FROM date_texts),
h AS (SELECT *, CASE WHEN y0 < 100 THEN y0 + 2000 ELSE y0 END AS y, CASE WHEN ny < 100 THEN ny + 2000 ELSE ny END AS yy FROM g),
i AS (SELECT *, """ + _DAY.format(y="y", m="b", d="a") + " AS dm, " + _DAY.format(y="y", m="a", d="b") + " AS md, " + _DAY.format(y="yy", m="nm", d="coalesce(nd, 1)") + " AS nn, " + _DAY.format(y="my", m="mm", d="1") + " AS mmy, " + _DAY.format(y="iy", m="im", d="1") + """ AS ii FROM h),
dated AS (
  SELECT k, raw,
    CASE WHEN iso THEN ii WHEN dmy THEN least(coalesce(dm, md), coalesce(md, dm)) WHEN nm > 0 THEN nn ELSE mmy END AS earliest,
    CASE WHEN iso THEN last_day(ii) WHEN dmy THEN greatest(coalesce(dm, md), coalesce(md, dm)) WHEN nm > 0 THEN CASE WHEN nd IS NULL THEN last_day(nn) ELSE nn END ELSE last_day(mmy) END AS latest,
    CASE WHEN iso THEN 'MONTH' WHEN dmy THEN CASE WHEN dm <> md THEN 'AMBIGUOUS_ORDER' ELSE 'DAY' END WHEN nm > 0 THEN CASE WHEN nd IS NULL THEN 'MONTH' ELSE 'DAY' END ELSE 'MONTH' END AS precision0
  FROM i)
"""
_LABEL = _DATES + "SELECT k, raw, CAST(earliest AS VARCHAR) AS earliest, CAST(latest AS VARCHAR) AS latest, CASE WHEN earliest IS NOT NULL THEN precision0 END AS precision FROM dated"


@_query(_LABEL)
def label_date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = resolved(view(spark, sf_dir, "date_texts"), "raw", d=label_date)
    return d.select("k", "raw", F.col("d.earliest").cast("string").alias("earliest"), F.col("d.latest").cast("string").alias("latest"), F.col("d.precision").alias("precision"))


@_query("""SELECT k, CASE WHEN raw LIKE 'best before %' THEN CAST(regexp_extract(raw, '(\\d+) month', 1) AS VARCHAR) END AS months,
    CASE WHEN raw LIKE 'best before %' THEN CAST(CAST((DATE '2024-01-31' + to_months(CAST(regexp_extract(raw, '(\\d+) month', 1) AS INT))) AS DATE) AS VARCHAR) END AS until FROM date_texts""")
def label_period_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shelf lives counted from 31 January 2024."""
    made, p = label_date(F.lit("31/01/2024")), F.col("p")
    return resolved(view(spark, sf_dir, "date_texts"), "raw", p=label_period).select("k", p["months"].cast("string").alias("months"), date_shift(made, p)["earliest"].cast("string").alias("until"))


@_query(_DATES + """SELECT k, coalesce(earliest = latest, FALSE) AS certain, CASE WHEN earliest IS NULL THEN NULL WHEN precision0 = 'MONTH' THEN strftime(earliest, '%b %Y') WHEN precision0 = 'AMBIGUOUS_ORDER' THEN concat(earliest::VARCHAR, ' or ', latest::VARCHAR) ELSE earliest::VARCHAR END AS shown,
    CASE WHEN earliest IS NULL THEN 'NOT_ASSESSABLE' WHEN earliest > DATE '""" + TODAY + """' THEN 'FAIL' WHEN latest > DATE '""" + TODAY + """' THEN 'NEEDS_REVIEW' ELSE 'PASS' END AS status FROM dated""")
def date_not_future_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = resolved(view(spark, sf_dir, "date_texts"), "raw", d=label_date)
    today = F.lit(TODAY).cast("date")
    status = F.when(F.col("d").isNull(), "NOT_ASSESSABLE").when(F.col("d.earliest") > today, "FAIL").when(possibly_after(F.col("d"), today), "NEEDS_REVIEW").otherwise("PASS")
    return d.select("k", F.coalesce(certain(F.col("d")), F.lit(False)).alias("certain"), describe(F.col("d")).alias("shown"), status.alias("status"))


@_query(f"SELECT id, {PRODUCT} AS product, coalesce({PRODUCT}, 'Unidentified pack') AS title FROM scans")
def product_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fleet.product_key()
    return view(spark, sf_dir, "scans").select("id", p.alias("product"), F.coalesce(p, F.lit("Unidentified pack")).alias("title"))


@_query("""SELECT id, brand, verdict FROM scans WHERE contains(lower(sku_id), 'brand#1') OR contains(lower(brand), 'brand#1') OR contains(lower(mrp), 'brand#1')
    OR contains(lower(net_quantity), 'brand#1') OR contains(lower(batch_number), 'brand#1') OR contains(lower(verdict), 'brand#1') OR contains(lower(mfg_date), 'brand#1')""")
def scan_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.scan_search(view(spark, sf_dir, "scans"), " Brand#1 ").select("id", "brand", "verdict")


@_query("""SELECT id, mfg_date FROM scans WHERE contains(lower(mfg_date), '/2023') OR contains(lower(sku_id), '/2023') OR contains(lower(brand), '/2023') OR contains(lower(mrp), '/2023')""")
def scan_search_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.scan_search(view(spark, sf_dir, "scans"), "/2023").select("id", "mfg_date")


@_query("SELECT id, device_id, verdict FROM scans WHERE device_id = 7 AND scanned_at BETWEEN 725846400000 AND 978307200000")
def scan_scope_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.time_range(fleet.scan_scope(view(spark, sf_dir, "scans"), "CONSUMER", 7), 725846400000, 978307200000).select("id", "device_id", "verdict")


@_query("""SELECT s.id, s.scanned_at, t.total, greatest(CAST(ceil(t.total / 20.0) AS BIGINT), 1) AS pages FROM scans s, (SELECT count(*) AS total FROM scans) t
    ORDER BY s.scanned_at DESC, s.id LIMIT 20 OFFSET 40""")
def scan_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.scan_page(view(spark, sf_dir, "scans").select("id", "scanned_at"), 3, 20)


_WITH_CHECKS = """SELECT s.id, count(c.rule_id) AS n, coalesce(string_agg(concat(c.rule_id, '=', c.status), ',' ORDER BY c.rule_id), '') AS checks FROM scans s LEFT JOIN scan_checks c ON c.scan_id = s.id GROUP BY s.id"""


@_query(_WITH_CHECKS)
def scan_with_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks_told(fleet.scan_with_checks(view(spark, sf_dir, "scans"), view(spark, sf_dir, "scan_checks")))


def _checks_told(nested: DataFrame) -> DataFrame:
    return nested.select("id", F.size("checks").cast("long").alias("n"), F.array_join(F.transform("checks", lambda c: F.concat(c["rule_id"], F.lit("="), c["status"])), ",").alias("checks"))


@_query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN s.ruleset_version <> '1.2.0' THEN 'unknown_ruleset_version' WHEN b.scan_id IS NOT NULL THEN 'unknown_status' END AS reason
    FROM scans s LEFT JOIN (SELECT DISTINCT scan_id FROM scan_checks WHERE status NOT IN ('FAIL', 'NOT_ASSESSABLE', 'NEEDS_REVIEW', 'PASS', 'NOT_APPLICABLE', 'EXEMPT') OR (scan_id % 50 = 0 AND rule_id = 'MRP-01')) b ON b.scan_id = s.id) AS marked GROUP BY reason""")
def scan_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = view(spark, sf_dir, "scan_checks").withColumn("status", F.when((F.col("scan_id") % 50 == 0) & (F.col("rule_id") == "MRP-01"), "odd").otherwise(F.col("status")))
    return fleet.scan_validate(view(spark, sf_dir, "scans"), checks, ["1.2.0"]).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@_query(f"""SELECT count(*) AS total, count(*) FILTER (verdict = 'FAIL') AS failed, count(*) FILTER (verdict = 'PASS') AS passed, count(DISTINCT {PRODUCT}) AS products,
    coalesce(round(count(*) FILTER (verdict IN ('FAIL', 'PASS')) / count(*), 4), 0.0) AS conclusive_rate FROM scans""")
def fleet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.fleet_summary(view(spark, sf_dir, "scans"))


@_query("SELECT verdict, count(*) AS n FROM scans GROUP BY verdict")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.verdict_counts(view(spark, sf_dir, "scans"))


@_query("SELECT status, count(*) AS n FROM scan_checks GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.status_counts(view(spark, sf_dir, "scan_checks"))


@_query("SELECT rule_id, count(*) AS n FROM scan_checks WHERE status = 'FAIL' GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 5")
def top_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.top_violations(view(spark, sf_dir, "scan_checks"))


_SEEN = "SELECT product, string_agg(v, '|' ORDER BY scanned_at, id) AS seen, count(*) AS n FROM (SELECT product, v, scanned_at, id, row_number() OVER (PARTITION BY product, v ORDER BY scanned_at, id) AS r FROM (SELECT {p} AS product, nullif(trim({c}), '') AS v, scanned_at, id FROM scans) AS x WHERE product IS NOT NULL AND v IS NOT NULL) AS y WHERE r = 1 GROUP BY product"
_CONFLICTS = f"""SELECT g.product, g.scans, CASE WHEN p.n > 1 THEN p.seen ELSE '' END AS prices, CASE WHEN q.n > 1 THEN q.seen ELSE '' END AS quantities
    FROM (SELECT {PRODUCT} AS product, count(*) AS scans FROM scans WHERE {PRODUCT} IS NOT NULL GROUP BY 1) AS g LEFT JOIN ({_SEEN.format(p=PRODUCT, c='mrp')}) p ON p.product = g.product
    LEFT JOIN ({_SEEN.format(p=PRODUCT, c='net_quantity')}) q ON q.product = g.product WHERE p.n > 1 OR q.n > 1"""


@_query(_CONFLICTS)
def product_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _barred(fleet.product_conflicts(view(spark, sf_dir, "scans")))


def _barred(conflicts: DataFrame) -> DataFrame:
    """Lists as texts, which the comparison with SQL wants."""
    return conflicts.withColumns({c: F.array_join(c, "|") for c in ("prices", "quantities")})


@_query("SELECT * FROM (" + _CONFLICTS + ") AS c ORDER BY scans DESC, product LIMIT 50")
def conflicts_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _barred(fleet.conflicts_top(fleet.product_conflicts(view(spark, sf_dir, "scans"))))


_HALF = "SELECT {p} AS product, count(*) AS scans, array_to_string(list_sort(list(DISTINCT mrp)), '|') AS prices FROM scans WHERE {p} IS NOT NULL AND id % 2 = {h} GROUP BY 1"


@_query(f"""SELECT coalesce(a.product, b.product) AS product, greatest(a.scans, b.scans) AS scans,
    array_to_string(list_sort(list_distinct(list_concat(string_split(coalesce(a.prices, b.prices), '|'), string_split(coalesce(b.prices, a.prices), '|')))), '|') AS prices, '' AS quantities
    FROM ({_HALF.format(p=PRODUCT, h=0)}) a FULL JOIN ({_HALF.format(p=PRODUCT, h=1)}) b ON a.product = b.product""")
def conflict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = view(spark, sf_dir, "scans").withColumn("product", fleet.product_key()).where("product is not null")
    half = lambda h: scans.where(F.col("id") % 2 == h).groupBy("product").agg(F.count(F.lit(1)).alias("scans"), F.array_sort(F.collect_set("mrp")).alias("prices")).withColumn("quantities", F.array().cast("array<string>"))
    return _barred(fleet.conflict_merge(half(0), half(1)))


@_query("""SELECT id, device_id, scanned_at, place FROM (SELECT id, device_id, scanned_at, row_number() OVER (PARTITION BY device_id ORDER BY scanned_at DESC, id) AS place FROM scans) AS r WHERE place <= 500""")
def history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = view(spark, sf_dir, "scans")
    return fleet.history_latest(scans.unionByName(scans.where("id % 3 = 0"))).select("id", "device_id", "scanned_at", F.col("place").cast("long").alias("place"))


@_query("""SELECT s.id, strftime(make_timestamp(s.scanned_at * 1000), '%Y-%m-%d %H:%M:%S') AS scanned, s.verdict, s.brand, s.mrp, c.rule_id, c.status, c.field, c.observed FROM scans s LEFT JOIN scan_checks c ON c.scan_id = s.id""")
def export_history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.history_rows(view(spark, sf_dir, "scans"), view(spark, sf_dir, "scan_checks"))


_BUCKET = f"""CASE WHEN trim(value) = '' THEN '__blank__'
    WHEN field = 'mrp' THEN coalesce(CAST({_m(MONEY, 'value')} AS VARCHAR), concat('__unread__', value))
    WHEN field = 'net_quantity' THEN CASE WHEN {_m(Q_MAG, 'value')} IS NULL THEN concat('__unread__', value) ELSE concat(CAST({_m(Q_MAG, 'value')} AS VARCHAR), ' ', {_m(Q_NAME, 'value')}) END
    ELSE {_m(TEXT, 'value')} END"""
_VOTE = f"""WITH votes AS (SELECT scan_id, side, field, {_BUCKET} AS bucket, count(*) AS votes, min(frame) AS first_frame, arg_min(value, frame) AS value FROM observations GROUP BY 1, 2, 3, 4),
nframes AS (SELECT scan_id, side, count(DISTINCT frame) AS frames FROM observations GROUP BY 1, 2),
ranked AS (SELECT *, CASE WHEN bucket LIKE '\\_\\_unread%' ESCAPE '\\' THEN 0 ELSE votes END AS v FROM votes),
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, side, field ORDER BY v DESC, first_frame) AS r FROM ranked) AS x WHERE r = 1),
agreed AS (SELECT w.scan_id, w.side, w.field, CASE WHEN v >= least(3, frames) THEN CASE WHEN bucket = '__blank__' THEN '' ELSE value END END AS value, v AS votes, frames, v >= least(3, frames) AS agreed,
  CASE WHEN v >= least(3, frames) THEN v / frames ELSE 0.0 END AS confidence FROM won w JOIN nframes n ON n.scan_id = w.scan_id AND n.side = w.side)
"""


@_query(_VOTE + "SELECT scan_id, side, field, value, CAST(votes AS BIGINT) AS votes, frames, agreed, confidence FROM agreed")
def consensus_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "observations")
    return consensus.consensus_vote(o)


@_query(_VOTE + """SELECT v.scan_id, v.side, v.field, string_agg(concat(v.value, ':', CAST(v.votes AS VARCHAR)), '; ' ORDER BY v.votes DESC, v.first_frame, v.value) AS candidates, any_value(a.frames) AS frames
    FROM votes v JOIN agreed a ON a.scan_id = v.scan_id AND a.side = v.side AND a.field = v.field WHERE NOT a.agreed GROUP BY 1, 2, 3""")
def consensus_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "observations")
    return consensus.consensus_failures(o)


def _two_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring scans seen as the two sides of one pack."""
    o = view(spark, sf_dir, "observations")
    return consensus.decided(o).withColumn("scan_id", F.expr("scan_id div 2"))


@_query(_VOTE + f""", paired AS (SELECT scan_id // 2 AS scan_id, side, field, value, agreed, confidence, agreed AND trim(coalesce(value, '')) <> '' AS filled, {_BUCKET} AS bucket FROM agreed),
    apart AS (SELECT scan_id, field, string_agg(concat(f.v, ':', CAST(votes AS VARCHAR)), '; ' ORDER BY votes DESC, f.s) AS candidates FROM (
      SELECT scan_id, field, bucket, count(*) AS votes, min({{'s': side, 'v': value}}) AS f FROM paired WHERE filled GROUP BY 1, 2, 3) AS g GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT h.scan_id, h.field, CASE WHEN reason IS NULL THEN b.value END AS value, CASE WHEN reason IS NULL THEN b.confidence ELSE 0.0 END AS confidence, reason, coalesce(a.candidates, '') AS candidates FROM (
      SELECT scan_id, field, b, CASE WHEN n > 1 THEN 'sides_disagree' WHEN b IS NULL THEN 'ocr_no_consensus' END AS reason FROM (
        SELECT scan_id, field, count(DISTINCT CASE WHEN filled THEN bucket END) AS n, min(CASE WHEN agreed THEN {{'f': -CAST(filled AS INT), 'c': -confidence, 's': side, 'value': value, 'confidence': confidence}} END) AS b FROM paired GROUP BY 1, 2) AS g) AS h
    LEFT JOIN apart a ON a.scan_id = h.scan_id AND a.field = h.field""")
def side_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.array_join(F.transform("candidates", lambda c: F.concat(c["value"], F.lit(":"), c["votes"].cast("string"))), "; ")
    return consensus.side_merge(_two_sides(spark, sf_dir)).withColumn("candidates", told)


_RANK = "CASE status WHEN 'FAIL' THEN 1 WHEN 'NOT_ASSESSABLE' THEN 2 WHEN 'NEEDS_REVIEW' THEN 3 WHEN 'PASS' THEN 4 END"
_ROLL = f"SELECT scan_id, coalesce(['FAIL', 'NOT_ASSESSABLE', 'NEEDS_REVIEW', 'PASS'][min({_RANK})], 'NOT_ASSESSABLE') AS verdict FROM scan_checks GROUP BY scan_id"


@_query(_ROLL)
def verdict_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdict_rollup(view(spark, sf_dir, "scan_checks"))


@_query("""SELECT scan_id, field, ['NOT_ASSESSABLE', 'FAIL', 'NEEDS_REVIEW', 'PASS', 'NOT_APPLICABLE', 'EXEMPT'][min(list_position(['NOT_ASSESSABLE', 'FAIL', 'NEEDS_REVIEW', 'PASS', 'NOT_APPLICABLE', 'EXEMPT'], status))] AS status,
    arg_min(observed, rule_id) FILTER (observed IS NOT NULL) AS observed FROM scan_checks GROUP BY scan_id, field""")
def field_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.field_groups(view(spark, sf_dir, "scan_checks"))


_TOLD = "CASE WHEN count(*) FILTER (c.status = '{s}') = 0 THEN '' ELSE concat(' ', count(*) FILTER (c.status = '{s}'), ' check(s) {w}: ', string_agg(c.rule_id, ', ' ORDER BY c.rule_id) FILTER (c.status = '{s}'), '.') END"


@_query(f"""SELECT scan_id, not_applicable, partial, verdict, CASE verdict WHEN 'PASS' THEN concat('Every check that applied passed.', not_applicable, partial) WHEN 'FAIL' THEN concat('One or more declarations do not meet what is cited.', not_applicable, partial)
    WHEN 'NEEDS_REVIEW' THEN 'A person must decide on the flagged checks.' ELSE 'Not enough evidence to judge.' END AS explanation FROM (
    SELECT c.scan_id, {_TOLD.format(s='NOT_APPLICABLE', w='did not apply')} AS not_applicable, {_TOLD.format(s='NOT_ASSESSABLE', w='could not be assessed')} AS partial, any_value(v.verdict) AS verdict
    FROM scan_checks c JOIN ({_ROLL}) v ON v.scan_id = c.scan_id GROUP BY c.scan_id) AS g""")
def caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.caveats(view(spark, sf_dir, "scan_checks"))


@_query(f"SELECT c.scan_id, c.rule_id, c.status FROM scan_checks c JOIN ({_ROLL}) v ON v.scan_id = c.scan_id WHERE c.status = v.verdict AND v.verdict <> 'PASS'")
def blocking_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.blocking_checks(view(spark, sf_dir, "scan_checks"))


# what both sides have is compared; a quantity that cannot be read (hq without q) equals nothing
_READ = "CASE WHEN {m} IS NOT NULL THEN concat(CAST({m} AS VARCHAR), ' ', {u}) END".format(m=_m(Q_MAG, "net_quantity"), u=_m(Q_NAME, "net_quantity"))
_ASKED = f"CASE WHEN trim(coalesce(brand, '')) <> '' THEN {_m(TEXT, 'brand')} END AS b, trim(coalesce(net_quantity, '')) <> '' AS hq, {_READ} AS q, CASE WHEN trim(coalesce(licence, '')) <> '' THEN regexp_replace(licence, '[^0-9]', '', 'g') END AS l"
_KNOWN = f"CASE WHEN one IS NOT NULL THEN {_m(TEXT, 'one')} END AS b, net_quantity IS NOT NULL AS hq, {_READ} AS q, regexp_replace(licence, '[^0-9]', '', 'g') AS l"
_BRANDS = "SELECT *, brand AS one FROM registry UNION ALL SELECT *, brand2 AS one FROM registry WHERE brand2 IS NOT NULL"


_WEIGHTED = f"""sk AS (SELECT id, {_ASKED} FROM scans), rk AS (SELECT sku_id, {_KNOWN} FROM ({_BRANDS}) AS u), asked AS (SELECT DISTINCT b, hq, q, l FROM sk), known AS (SELECT DISTINCT * FROM rk),
    pairs AS (SELECT a.b, a.hq, a.q, a.l, k.sku_id, max((2.0 * CAST(coalesce(a.b = k.b, FALSE) AS INT) + 2 * CAST(coalesce(a.q = k.q, FALSE) AS INT) + CAST(coalesce(a.l = k.l, FALSE) AS INT)) / nullif(2 * CAST(a.b IS NOT NULL AND k.b IS NOT NULL AS INT) + 2 * CAST(a.hq AND k.hq AS INT) + CAST(a.l IS NOT NULL AND k.l IS NOT NULL AS INT), 0)) AS score FROM asked a, known k GROUP BY 1, 2, 3, 4, 5),
    best AS (SELECT b, hq, q, l, score, min(sku_id) AS sku, count(*) AS n, row_number() OVER (PARTITION BY b, hq, q, l ORDER BY score DESC) AS r FROM pairs WHERE score >= 0.75 GROUP BY b, hq, q, l, score),
    weighted AS (SELECT sk.id, CASE WHEN n = 1 THEN sku END AS sku, CASE WHEN n = 1 THEN score ELSE 0.0 END AS score, coalesce(n, 0) AS candidates FROM sk LEFT JOIN best ON best.b IS NOT DISTINCT FROM sk.b AND best.hq = sk.hq AND best.q IS NOT DISTINCT FROM sk.q AND best.l IS NOT DISTINCT FROM sk.l AND best.r = 1)"""


_WEIGHTED_ROWS = f"WITH {_WEIGHTED} SELECT id, sku, score, candidates FROM weighted"


@_query(_WEIGHTED_ROWS)
def registry_match_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.match_weighted(view(spark, sf_dir, "scans"), _registry(spark, sf_dir))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry with its brand strings as a list."""
    return view(spark, sf_dir, "registry").withColumn("brand_strings", F.filter(F.array("brand", "brand2"), lambda b: b.isNotNull()))


_WORDS = "trim(regexp_replace(lower(coalesce({c}, '')), '\\s+', ' ', 'g'))"
_FOLDED = "CASE split_part({w}, ' ', 2) WHEN 'gm' THEN 'g' WHEN 'grams' THEN 'g' WHEN 'gram' THEN 'g' WHEN 'kgs' THEN 'kg' WHEN 'kilograms' THEN 'kg' WHEN 'ltr' THEN 'l' WHEN 'litre' THEN 'l' WHEN 'litres' THEN 'l' ELSE split_part({w}, ' ', 2) END"
_QTY_WORDS = _WORDS.format(c="net_quantity")
_BPQ = "nullif({b}, '') AS b, printf('%.2f', {p}) AS p, nullif(CASE WHEN len(string_split({q}, ' ')) = 2 THEN concat(split_part({q}, ' ', 1), ' ', {f}) ELSE {q} END, '') AS q"
_BPQ = {c: _BPQ.format(b=_WORDS.format(c=c), p=p, q=_QTY_WORDS, f=_FOLDED.format(w=_QTY_WORDS)) for c, p in (("brand", _m(MONEY, "mrp")), ("one", "CAST(mrp AS DOUBLE)"))}


_IDENTITY_ROWS = f"""WITH sk AS (SELECT id, {_BPQ['brand']} FROM scans), rk AS (SELECT sku_id, {_BPQ['one']} FROM ({_BRANDS}) AS u),
    asked AS (SELECT DISTINCT b, p, q FROM sk), known AS (SELECT b, p, q, min(sku_id) AS sku_id FROM rk GROUP BY 1, 2, 3),
    parts AS (SELECT a.b, a.p, a.q, k.sku_id, CASE WHEN a.b IS NOT NULL AND k.b IS NOT NULL THEN len(list_intersect(string_split(a.b, ' '), string_split(k.b, ' '))) / len(list_distinct(list_concat(string_split(a.b, ' '), string_split(k.b, ' ')))) END AS bs,
        CASE WHEN a.p IS NOT NULL AND k.p IS NOT NULL THEN CAST(a.p = k.p AS DOUBLE) END AS ps, CASE WHEN a.q IS NOT NULL AND k.q IS NOT NULL THEN CAST(a.q = k.q AS DOUBLE) END AS qs FROM asked a, known k),
    pairs AS (SELECT *, round((coalesce(bs, 0) + coalesce(ps, 0) + coalesce(qs, 0)) / nullif(CAST(bs IS NOT NULL AS INT) + CAST(ps IS NOT NULL AS INT) + CAST(qs IS NOT NULL AS INT), 0), 6) AS score FROM parts),
    best AS (SELECT *, row_number() OVER (PARTITION BY b, p, q ORDER BY score DESC, sku_id) AS r FROM pairs WHERE score >= 0.72)
    SELECT sk.id, CASE WHEN best.sku_id IS NOT NULL THEN 'MATCHED' ELSE 'REJECTED' END AS status, best.sku_id AS sku, best.score AS score, bs AS brand_score, ps AS mrp_score, qs AS quantity_score
    FROM sk LEFT JOIN best ON best.b IS NOT DISTINCT FROM sk.b AND best.p IS NOT DISTINCT FROM sk.p AND best.q IS NOT DISTINCT FROM sk.q AND best.r = 1"""


@_query(_IDENTITY_ROWS)
def registry_match_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.match_identity(view(spark, sf_dir, "scans"), _registry(spark, sf_dir))


_PICK = "CASE WHEN a.sku_id IS NULL OR coalesce(b.saved_at >= a.saved_at OR b.source = 'IMPORTED', FALSE) THEN b.{c} ELSE a.{c} END AS {c}"


@_query("SELECT * REPLACE (CAST(mrp AS VARCHAR) AS mrp) FROM (SELECT " + ", ".join(_PICK.format(c=c) for c in ("sku_id", "brand", "mrp", "net_quantity", "source", "saved_at")) + " FROM registry a FULL JOIN registry_update b ON a.sku_id = b.sku_id) AS m")
def registry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = match.registry_merge(view(spark, sf_dir, "registry"), view(spark, sf_dir, "registry_update"))
    return merged.withColumn("mrp", F.col("mrp").cast("string"))


_UPSERTED = """SELECT sku_id, brand, CAST(mrp AS VARCHAR) AS mrp, net_quantity, source, saved_at FROM (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY saved_at DESC, fresh DESC) AS r FROM (
    SELECT sku_id, brand, mrp, net_quantity, source, saved_at, 0 AS fresh FROM registry UNION ALL SELECT sku_id, brand, mrp, net_quantity, source, saved_at, 1 AS fresh FROM registry_update) AS u) AS n WHERE r = 1"""


@_query(_UPSERTED)
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    upserted = match.registry_upsert(view(spark, sf_dir, "registry"), view(spark, sf_dir, "registry_update"))
    return upserted.withColumn("mrp", F.col("mrp").cast("string"))


_JUDGED = "CASE WHEN trim(coalesce({s}, '')) = '' OR {n} THEN 'NOT_ASSESSABLE' WHEN coalesce({e}, FALSE) THEN 'PASS' WHEN r.source = 'IMPORTED' THEN 'FAIL' ELSE 'NEEDS_REVIEW' END"
_SAME_QTY = f"{_m(Q_MAG, 's.net_quantity')} = {_m(Q_MAG, 'r.net_quantity')} AND {_m(Q_NAME, 's.net_quantity')} = {_m(Q_NAME, 'r.net_quantity')}"


@_query(f"""WITH j AS (SELECT s.id, {_JUDGED.format(s='s.mrp', n='r.mrp IS NULL', e=f"{_m(MONEY, 's.mrp')} = CAST(r.mrp AS DOUBLE)")} AS price, {_JUDGED.format(s='s.net_quantity', n='r.net_quantity IS NULL', e=_SAME_QTY)} AS quantity,
    {_JUDGED.format(s='s.brand', n='r.brand IS NULL', e=f"{_m(TEXT, 's.brand')} = {_m(TEXT, 'r.brand')} OR {_m(TEXT, 's.brand')} = {_m(TEXT, 'r.brand2')}")} AS brand FROM scans s LEFT JOIN registry r ON r.sku_id = s.sku_id)
    SELECT id, 'mrp' AS field, price AS status FROM j UNION ALL SELECT id, 'net_quantity', quantity FROM j UNION ALL SELECT id, 'brand', brand FROM j""")
def registry_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.registry_compare(view(spark, sf_dir, "scans"), _registry(spark, sf_dir))


@_query("""SELECT p_partkey AS k, len(list_intersect(string_split(p_name, ' '), string_split(lower(concat(p_type, ' ring')), ' '))) / len(list_distinct(list_concat(string_split(p_name, ' '), string_split(lower(concat(p_type, ' ring')), ' ')))) AS jaccard FROM part""")
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), token_jaccard(F.col("p_name"), F.concat("p_type", F.lit(" ring"))).alias("jaccard"))


@_query("""SELECT scan_id, arg_min(regexp_extract(text, '(?i)(?:₹|rs\\.?|inr)?\\s*(\\d+(?:\\.\\d{1,2})?)', 1), line_no) FILTER (regexp_matches(text, '(?i)(?:mrp|m\\.r\\.p|rs\\.?|₹|inr|अधिकतम\\s*खुदरा\\s*मूल्य)') AND regexp_matches(text, '\\d')) AS mrp FROM ocr_lines GROUP BY scan_id""")
def extract_mrp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.frame_fields(view(spark, sf_dir, "ocr_lines")).select("scan_id", "mrp")


_QTY = "'(?i)\\d+(?:[.,]\\d+)?\\s*(?:g|gm|gms|gram|grams|kg|kgs|mg|ml|l|ltr|litre|litres|liter)\\b'"


@_query(f"""SELECT scan_id, arg_min(trim(regexp_extract(text, {_QTY}, 0)), line_no + CASE WHEN regexp_matches(text, '(?i)net\\s*(?:qty|quantity|wt|weight)') THEN 0 ELSE 1000000 END) FILTER (regexp_matches(text, {_QTY})) AS net_quantity FROM ocr_lines GROUP BY scan_id""")
def extract_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.frame_fields(view(spark, sf_dir, "ocr_lines")).select("scan_id", "net_quantity")


@_query("""SELECT scan_id, arg_min(regexp_replace(regexp_extract(text, '\\d[\\d\\s\\-]{8,26}\\d', 0), '\\D', '', 'g'), line_no) FILTER (length(regexp_replace(regexp_extract(text, '\\d[\\d\\s\\-]{8,26}\\d', 0), '\\D', '', 'g')) = 14) AS licence_number, bool_or(regexp_matches(text, '(?i)fssai|\\blic\\b\\.?|licence\\s*no|license\\s*no')) AS licence_caption FROM ocr_lines GROUP BY scan_id""")
def extract_licence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.frame_fields(view(spark, sf_dir, "ocr_lines")).select("scan_id", "licence_number", "licence_caption")


_TAX = "'(?i)incl.{0,20}?tax|all\\s*tax|सभी\\s*करों\\s*सहित'"


@_query(f"""SELECT scan_id, coalesce(line, CASE WHEN regexp_matches(joined, {_TAX}) THEN coalesce(incl, tax, price) END) AS tax_inclusive FROM (
    SELECT scan_id, arg_min(trim(text), line_no) FILTER (regexp_matches(text, {_TAX})) AS line, string_agg(text, ' ' ORDER BY line_no) AS joined, arg_min(trim(text), line_no) FILTER (lower(text) LIKE '%incl%') AS incl,
      arg_min(trim(text), line_no) FILTER (lower(text) LIKE '%tax%') AS tax, arg_min(trim(text), line_no) FILTER (regexp_matches(text, '(?i)(?:mrp|m\\.r\\.p|rs\\.?|₹|inr)')) AS price FROM ocr_lines GROUP BY scan_id) AS g""")
def extract_tax_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.frame_fields(view(spark, sf_dir, "ocr_lines")).select("scan_id", "tax_inclusive")


@_query("""SELECT scan_id, arg_min(trim(text), line_no) AS care, arg_min(coalesce(nullif(trim(regexp_extract(text, '(?:\\+91[\\s-]?)?(?:\\d[\\s-]?){10,13}', 0)), ''), '-'), line_no) AS phone, arg_min(coalesce(nullif(regexp_extract(text, '[\\w.+-]+@[\\w-]+\\.[\\w.]+', 0), ''), '-'), line_no) AS email
    FROM ocr_lines WHERE regexp_matches(lower(text), 'consumer care|customer care|consumer complaints|for complaints') GROUP BY scan_id""")
def extract_care(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = extract.frame_fields(view(spark, sf_dir, "ocr_lines")).where("care is not null")
    return f.select("scan_id", F.col("care.c_care").alias("care"), F.coalesce("care.c_phone", F.lit("-")).alias("phone"), F.coalesce("care.c_email", F.lit("-")).alias("email"))


@_query("""SELECT scan_id, field, value, anchor_only, relative FROM (
    SELECT p_partkey AS scan_id, 'mfg_date' AS field, CASE p_partkey % 4 WHEN 0 THEN '06/2025' WHEN 1 THEN CASE WHEN p_partkey % 8 = 1 THEN '07/2025' ELSE '' END ELSE concat('DEC-', CAST(20 + p_partkey % 10 AS VARCHAR)) END AS value, p_partkey % 4 = 1 AND p_partkey % 8 <> 1 AS anchor_only, FALSE AS relative FROM part WHERE p_partkey % 4 < 3
    UNION ALL SELECT p_partkey, 'batch_number', CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_partkey < 10 THEN concat('B', CAST(p_partkey AS VARCHAR)) ELSE concat('B', CAST(p_partkey AS VARCHAR)) END WHEN 1 THEN CASE WHEN p_partkey % 6 = 1 THEN concat('LX', CAST(p_partkey AS VARCHAR)) ELSE '' END ELSE '' END, p_partkey % 3 = 2 OR (p_partkey % 3 = 1 AND p_partkey % 6 <> 1), FALSE FROM part
    UNION ALL SELECT p_partkey, 'expiry', CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey % 24 = 0 THEN '24 months from packing' ELSE '9 months from packing' END WHEN 1 THEN '12/2030' ELSE '' END, p_partkey % 4 = 2, p_partkey % 4 = 0 FROM part WHERE p_partkey % 4 < 3) AS expected""")
def extract_captioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked against what the lines were rendered from."""
    found = extract.extract(view(spark, sf_dir, "ocr_lines")).where(F.col("field").isin(*extract.CAPTIONED))
    return found.select("scan_id", "field", "value", "anchor_only", "relative")


_TAGGED = """anchors AS (SELECT * FROM (VALUES ('manufactured by', 'MANUFACTURER'), ('manufactured & packed by', 'MANUFACTURER'), ('mfd by', 'MANUFACTURER'), ('packed by', 'PACKER'), ('imported by', 'IMPORTER'), ('marketed by', 'MARKETER')) AS v(anchor, role)),
named AS (SELECT l.*, (SELECT arg_max(a.anchor, length(a.anchor)) FROM anchors a WHERE contains(lower(l.text), a.anchor)) AS anchor FROM address_lines l),
headed AS (SELECT n.*, a.role, trim(substr(text, strpos(lower(text), n.anchor) + length(n.anchor)), ' :-.–—') AS head, trim(text, ' :-.–—') AS plain, n.anchor IS NOT NULL OR regexp_matches(lower(text), 'mfg date|batch|customer care') AS cap FROM named n LEFT JOIN anchors a ON a.anchor = n.anchor),
ahead AS (SELECT *, lead(plain, 1) OVER w AS t1, lead(plain, 2) OVER w AS t2, lead(plain, 3) OVER w AS t3, coalesce(lead(cap, 1) OVER w, TRUE) AS c1, coalesce(lead(cap, 2) OVER w, TRUE) AS c2, coalesce(lead(cap, 3) OVER w, TRUE) AS c3,
  lead(bottom, 1) OVER w AS b1, lead(bottom, 2) OVER w AS b2, lead(bottom, 3) OVER w AS b3 FROM headed WINDOW w AS (PARTITION BY scan_id, frame ORDER BY line_no)),
taken AS (SELECT *, role IS NOT NULL AND length(head) < 6 AS alone, CASE WHEN NOT c1 THEN nullif(t1, '') END AS x1, CASE WHEN NOT c1 AND NOT c2 THEN nullif(t2, '') END AS x2, CASE WHEN NOT c1 AND NOT c2 AND NOT c3 THEN nullif(t3, '') END AS x3 FROM ahead),
tagged AS (SELECT scan_id, frame, line_no, coalesce(role, 'UNKNOWN') AS role, CASE WHEN role IS NULL THEN trim(text) WHEN alone THEN concat_ws(', ', x1, x2, x3) ELSE head END AS body,
  CASE WHEN alone THEN 1 + CAST(x1 IS NOT NULL AS INT) + CAST(x2 IS NOT NULL AS INT) + CAST(x3 IS NOT NULL AS INT) ELSE 1 END AS lines,
  CASE WHEN alone THEN greatest(bottom, CASE WHEN x1 IS NOT NULL THEN b1 END, CASE WHEN x2 IS NOT NULL THEN b2 END, CASE WHEN x3 IS NOT NULL THEN b3 END) ELSE bottom END AS bottom FROM taken)
"""


@_query("WITH " + _TAGGED + "SELECT scan_id, frame, line_no, role, body, lines, bottom FROM tagged")
def tag_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses on the line of their caption and on the lines under it."""
    return extract.tag_addresses(view(spark, sf_dir, "address_lines")).select("scan_id", "frame", "line_no", "role", "body", "lines", "bottom")


@_query("WITH " + _TAGGED + "SELECT scan_id, role, count(*) AS n, string_agg(body, ' | ' ORDER BY frame, line_no) AS addresses FROM tagged WHERE trim(body) <> '' GROUP BY scan_id, role")
def address_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.address_roles(extract.tag_addresses(view(spark, sf_dir, "address_lines")))


@_query("""SELECT scan_id, frame, min("left") AS "left", min(top) AS top, max("right") AS "right", max(bottom) AS bottom FROM ocr_lines GROUP BY scan_id, frame""")
def box_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.box_union(view(spark, sf_dir, "ocr_lines"))


@_query("""SELECT scan_id, frame, lines, raw FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY lines DESC, frame) AS r FROM (
    SELECT scan_id // 3 AS scan_id, scan_id % 3 AS frame, count(*) AS lines, string_agg(text, ' / ' ORDER BY line_no) AS raw FROM ocr_lines GROUP BY 1, 2) AS g) AS n WHERE r = 1""")
def fullest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three neighbouring packs' lines seen as the frames of one."""
    lines = view(spark, sf_dir, "ocr_lines").withColumn("frame", F.col("scan_id") % 3).withColumn("scan_id", F.expr("scan_id div 3"))
    return extract.fullest_frame(lines).select("scan_id", "frame", "lines", F.array_join("raw_lines", " / ").alias("raw"))


@_query("""SELECT scan_id, frame, m.t AS brand FROM (SELECT scan_id, frame, max({'h': bottom - top, 'n': -line_no, 't': trim(text)}) AS m, list_sort(list(bottom - top)) AS hs FROM ocr_lines
    WHERE length(trim(text)) >= 2 AND NOT contains(text, ':') AND NOT regexp_matches(text, '\\d') AND NOT regexp_matches(text, '(?i)(?:mrp|price|weight|qty|quantity|batch|mfg|date|use by|best before|fssai|lic|care|customer|consumer|net|incl|tax|packed|marketed)')
    GROUP BY scan_id, frame) AS g WHERE m.h >= hs[len(hs) // 2 + 1] * 1.3""")
def brand_prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.brand_prominence(view(spark, sf_dir, "ocr_lines"))


@_query("""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 24 = 0 AND p_partkey % 5 <> 2 THEN 'NOT_ASSESSABLE' ELSE 'FAIL' END AS verdict FROM part) AS v GROUP BY verdict""")
def verdict_counts_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to fields to findings to verdicts. Packs that declare everything still have no measured height, so they are not assessable."""
    lines = view(spark, sf_dir, "ocr_lines")
    known = [c for c in lines.columns if c not in ("scan_id", "frame")]
    roles = extract.tag_addresses(lines.select("scan_id", "frame", *known)).where(F.trim("body") != "").select("scan_id", "role").distinct().persist()
    ruleset, exempt, _ = rules.load_rules(spark)
    # read several times by the rules: kept by Spark, in memory or on the executors' disks
    declared = extract.extract(lines).drop("frame").persist()
    findings = rules.evaluate(declared, ruleset, exempt, CHECK_DAY, scans=lines.select("scan_id").distinct(), roles=roles)
    return fleet.verdict_counts(rules.verdict_rollup(findings))


@_query("""SELECT device_id, correction, calibrated_at FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY calibrated_at DESC) AS r FROM calibrations WHERE correction BETWEEN 1.0 / 3 AND 3.0) AS n WHERE r = 1""")
def latest_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.latest_calibration(view(spark, sf_dir, "calibrations")).select("device_id", "correction", "calibrated_at")


_RATIO = "SELECT burst_id, frame, variance, CASE WHEN count(*) OVER w = 1 OR max(variance) OVER w <= 0 THEN 1.0 ELSE variance / max(variance) OVER w END AS ratio FROM bursts WINDOW w AS (PARTITION BY burst_id)"


@_query(_RATIO)
def burst_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.burst_ratio(view(spark, sf_dir, "bursts")).withColumn("variance", F.col("variance").cast("double"))


@_query(f"SELECT burst_id, frame FROM (SELECT *, max(CAST(ratio >= 0.4 AS INT)) OVER (PARTITION BY burst_id) AS any_sharp FROM ({_RATIO}) AS r) AS g WHERE ratio >= 0.4 OR any_sharp = 0")
def focus_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.focus_gate(view(spark, sf_dir, "bursts")).select("burst_id", "frame")


@_query("SELECT id, device_id, event_type, verdict FROM scan_stream WHERE event_type <> 'resend'")
def scan_ingest_first_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    resend = F.when(F.col("event_type") == "resend", 1).otherwise(0)
    return first_copies(view(spark, sf_dir, "scan_stream").withColumn("late", resend), ["late", "event_type"]).drop("late")


_WILSON = "(a + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) {s} 1.96 * sqrt(a * (1 - a) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n)"


@_query(f"""SELECT lang, n, round(a, 6) AS accuracy, round({_WILSON.format(s='-')}, 6) AS low, round({_WILSON.format(s='+')}, 6) AS high FROM (
    SELECT d.lang, count(*) AS n, avg(CAST(l.quality = 1 - l.toxic AS DOUBLE)) AS a FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY d.lang) AS g""")
def accuracy_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = view(spark, sf_dir, "labels").join(view(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").withColumn("guess", 1 - F.col("toxic"))
    return quality.accuracy_by(pairs, "lang", "quality", "guess")


@_query("""SELECT n, round((o / n - e / (n * n)) / nullif(1 - e / (n * n), 0), 6) AS kappa FROM (SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS o,
    count(*) FILTER (quality = 0) * count(*) FILTER (toxic = 0) + count(*) FILTER (quality = 1) * count(*) FILTER (toxic = 1) AS e FROM labels) AS g""")
def annotator_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.kappa(view(spark, sf_dir, "labels"), "quality", "toxic")
