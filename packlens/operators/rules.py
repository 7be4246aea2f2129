"""Rules as data over declared fields: every scan meets every rule; unknown is a status with a reason."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from packlens.functions.dates import label_date, label_period, possibly_after
from packlens.functions.normalize import nfkc, nfkc_all, norm_field, norm_quantity, readable
from packlens.functions.once import once
from packlens.sources.folders import written

#: Fields that an extractor can find: what is absent of these is absent from the pack.
EXTRACTABLE = ("mrp", "net_quantity", "manufacturer_address", "consumer_care", "mfg_date", "batch_number", "expiry", "fssai_licence", "tax_inclusive", "brand")
CHECKS = ("field_present", "matches_registry", "role_present", "date_marking", "date_not_future", "date_order", "not_expired", "min_height_mm")
ROLES = ("manufacturer", "packer", "importer", "marketer", "unknown")
#: Worst first, by what they are ranked for; the two orders differ on purpose.
VERDICT_ORDER = ("FAIL", "NOT_ASSESSABLE", "NEEDS_REVIEW", "PASS")
GROUP_ORDER = ("NOT_ASSESSABLE", "FAIL", "NEEDS_REVIEW", "PASS", "NOT_APPLICABLE", "EXEMPT")
CANONICAL = Path(__file__).resolve().parent.parent / "rules.json"

RULE = """rule_id string, ord int, name string, field string, citation string, check string, registry_key string, role string, relative_requires string,
    after_field string, min_mm double, needs_legal_confirmation boolean, needs_calibration boolean"""
EXEMPTION = "exemption_id string, ex_ord int, field string, op string, value double, unit string, exempts array<string>, citation string"


def load_rules(spark: SparkSession, text: str | None = None) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Rules and exemptions as tables of tens of rows, and the set's version, source_citation and height_metric.

    text: the rules as JSON; the package's own without it. A set without one of the three, and a rule or exemption without a
    citation, a check or a condition is refused, and so is a check that no operator does.
    """
    root = json.loads(CANONICAL.read_text() if text is None else text)
    if not root:
        raise ValueError("the rules are empty")
    about = {k: _needed(root, k, "the rules") for k in ("version", "source_citation", "height_metric")}
    rules = [_rule(r, i) for i, r in enumerate(root.get("rules") or [], 1)]
    exemptions = [_exemption(e, i) for i, e in enumerate(root.get("exemptions") or [], 1)]
    return spark.createDataFrame(rules, RULE), spark.createDataFrame(exemptions, EXEMPTION), about


def _needed(raw: Mapping, key: str, of: str):
    if raw.get(key) is None:
        raise ValueError(f"{of}: no {key}")
    return raw[key]


def _rule(raw: Mapping, order: int) -> tuple:
    name = f"rule {raw.get('id')}"
    check, citation = _needed(raw, "check", name), str(_needed(raw, "citation", name))
    if check.get("type") not in CHECKS:
        raise ValueError(f"{name}: unknown check {check.get('type')}")
    params = check.get("params") or {}
    least = params.get("min_mm")
    return (
        str(raw.get("id", "")), order, str(raw.get("name", "")), str(raw.get("field", "")), citation, check["type"], check.get("registry_key"), check.get("role"),
        check.get("relative_requires"), check.get("after_field"), None if least is None else float(least),
        bool(params.get("needs_legal_confirmation", False)), bool(params.get("needs_calibration", False)))


def _exemption(raw: Mapping, order: int) -> tuple:
    name = f"exemption {raw.get('id')}"
    c, citation = _needed(raw, "condition", name), str(_needed(raw, "citation", name))
    return str(raw.get("id", "")), order, str(c.get("field", "")), str(c.get("op", "")), float(c.get("value", 0.0)), c.get("unit"), [str(x) for x in raw.get("exempts") or []], citation


def condition_compare(value: Column, op: Column, limit: Column, unit: Column) -> Column:
    """Whether a declared value meets a condition; false where it cannot be read, has another unit, or the operator is unknown.

    With a unit both sides are quantities in g or ml; without one the value must be a number.
    """
    return _compared(norm_quantity(value), norm_quantity(F.concat_ws(" ", limit.cast("string"), unit)), F.trim(value).try_cast("double"), op, limit, unit)


def _compared(seen: Column, asked: Column, number: Column, op: Column, limit: Column, unit: Column) -> Column:
    same = seen["unit"] == asked["unit"]
    left = F.when(unit.isNotNull(), F.when(same, seen["magnitude"])).otherwise(number)
    right = F.when(unit.isNotNull(), asked["magnitude"]).otherwise(limit)
    held = F.when(op == "lte", left <= right).when(op == "lt", left < right).when(op == "gte", left >= right).when(op == "gt", left > right).when(op == "eq", left == right)
    return F.coalesce(held, F.lit(False))


def _filled(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select("*", *[F.lit(None).cast(kind).alias(n) for n, kind in columns.items() if n not in df.columns])


#: Distinct texts up to so many are sent to all tasks, by their count and not by the size of their file; more of them meet the rows by sorting.
FEW = 100_000
#: What rules read of a declared field.
OWN = ("value", "anchor_only", "relative", "confidence", "votes", "own", "period", "norm", "holds")
READ = {"own": "struct<earliest: date, latest: date, precision: string>", "period": "struct<months: int, days: int>", "norm": "string", "holds": "array<boolean>"}


def _read_once(rows: DataFrame, keys: tuple[str, ...], made: Callable[[DataFrame], DataFrame], some: Column | None = None) -> DataFrame:
    """rows with what `made` adds to their distinct `keys`: each combination is read once, however many rows have it. some: rows that are read, the others get nulls."""
    texts = made((rows if some is None else rows.where(some)).select(*keys).distinct())
    read = written(texts.withColumnsRenamed({k: f"__{k}" for k in keys}), "rule-texts")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return rows.join(F.broadcast(read) if read.count() <= FEW else read.hint("merge"), same, "left").drop(*[f"__{k}" for k in keys])


def evaluate(
    declared: DataFrame, rules: DataFrame, exemptions: DataFrame, today: str, scans: DataFrame | None = None,
    registry: DataFrame | None = None, roles: DataFrame | None = None, heights: DataFrame | None = None, scales: DataFrame | None = None,
) -> DataFrame:
    """One finding per scan and rule: scan_id, rule_id, ord, field, status, reason, observed, confidence, citation, evidence.

    declared: scan_id, field, value, and if known anchor_only (a caption without a value), relative, confidence, agreement, frames; one row a
    scan and field. scans: scan_id of all scans (those of `declared` without it). registry: scan_id, authority, mrp_exact, net_quantity, brand_strings
    of the scans that are matched to a product. roles: scan_id, role (lower case; unknown for addresses without a caption). heights: scan_id, field,
    low_mm, high_mm. scales: scan_id, unavailable. `today` is the day that dates are held against.

    An exempt rule is not evaluated. What is not declared has confidence 0. Every unknown has a status and a reason of its own: NOT_APPLICABLE tells of
    the setup, NOT_ASSESSABLE of the scan, NEEDS_REVIEW of evidence that does not settle it.
    """
    declared = _filled(declared, {"anchor_only": "boolean", "relative": "boolean", "confidence": "double", "agreement": "int", "frames": "int"})
    declared = declared.select("scan_id", "field", "value", "anchor_only", "relative", "confidence", "agreement", "frames")
    spark, (asked, exempts) = declared.sparkSession, (rules.collect(), sorted(exemptions.collect(), key=lambda e: (e.ex_ord, e.exemption_id, e.citation)))  # tens of rows each
    of_check = lambda check: [r for r in asked if r.check == check]
    rows = (declared.select("scan_id").distinct() if scans is None else scans.select("scan_id"))

    # everything that is known of a scan meets by its id, once; the rules, tens of rows, come after that, so that findings are never shuffled
    rows = rows.join(_nested(declared, asked, exempts), "scan_id", "left")
    pairs = {(r.registry_key, r.field): f"expected{i}" for i, r in enumerate(of_check("matches_registry")) if r.registry_key in REGISTRY_KEYS}
    if of_check("matches_registry") and registry is not None:
        rows = rows.join(_expected(registry, pairs), "scan_id", "left")
    else:
        rows = _filled(rows, {"registered": "boolean", "authority": "string"} | {n: "array<string>" for n in pairs.values()})
    wanted = sorted({r.role.lower() for r in of_check("role_present") if r.role} | {"unknown"})
    if of_check("role_present") and roles is not None:
        has = [F.coalesce(F.max(F.lower("role") == w), F.lit(False)).alias(f"role_{i}") for i, w in enumerate(wanted)]
        rows = rows.join(roles.groupBy("scan_id").agg(*has), "scan_id", "left")
    else:
        rows = _filled(rows, {f"role_{i}": "boolean" for i in range(len(wanted))})
    measured = sorted({r.field for r in of_check("min_height_mm")})
    if measured and heights is not None:
        least = [F.min(F.when(F.col("field") == f, F.struct("field", "low_mm", "high_mm"))).alias(f"height_{i}") for i, f in enumerate(measured)]
        rows = rows.join(heights.where(F.col("field").isin(measured)).groupBy("scan_id").agg(*least), "scan_id", "left")
    else:
        rows = _filled(rows, {f"height_{i}": "struct<field: string, low_mm: double, high_mm: double>" for i in range(len(measured))})
    rows = rows.join(scales.select("scan_id", "unavailable"), "scan_id", "left") if measured and scales is not None else _filled(rows, {"unavailable": "string"})

    places = {f: i for i, f in enumerate(_named(asked, exempts))}
    rows = once(rows, {f"field_{i}": F.col("fields")[f] for f, i in places.items()}).drop("fields")
    field = lambda f: F.col(f"field_{places[f]}")
    facts = {"expected": pairs, "role": {w: F.col(f"role_{i}") for i, w in enumerate(wanted)}, "height": {f: F.col(f"height_{i}") for i, f in enumerate(measured)}}
    ends: dict[tuple, int] = {}
    code = lambda *end: F.lit(ends.setdefault(end, len(ends)))

    def told(r: Row) -> Column:
        """The place in `ends` of what a rule finds: the first exemption that holds, else the first case that does."""
        cases = _cases(r, field, facts, F.lit(today).cast("date"))
        out = code(*cases[-1][1:], None, None)
        for condition, status, reason in reversed(cases[:-1]):
            out = F.when(F.coalesce(condition, F.lit(False)), code(status, reason, None, None)).otherwise(out)
        for i, e in reversed(list(enumerate(exempts))):
            if r.rule_id in e.exempts:
                out = F.when(F.coalesce(F.get(field(e.field)["holds"], F.lit(i)), F.lit(False)), code("EXEMPT", None, e.exemption_id, e.citation)).otherwise(out)
        return out

    # a scan's outcomes are made of expressions for each rule by itself, and a finding only takes its own. The lambda keeps Spark from compiling all of them into one
    # method, which would be too long for the JVM to compile in turn
    shown = F.transform(F.array(*[F.col(f"field_{i}") for i in places.values()]), lambda x: F.struct(x["value"].alias("value"), x["confidence"].alias("confidence"), x["votes"].alias("votes")))
    rows = rows.select("scan_id", F.array(*[told(r) for r in asked]).alias("codes"), shown.alias("shown"))
    listed = [F.struct(F.lit(i).alias("at"), F.lit(places[r.field]).alias("place"), *[F.lit(r[c]).cast(kind).alias(c) for c, kind in (("rule_id", "string"), ("ord", "int"), ("field", "string"), ("citation", "string"), ("check", "string"))]) for i, r in enumerate(asked)]
    table = spark.range(0, 1, 1, 1).select(F.inline(F.array(*listed))) if listed else spark.createDataFrame([], "at int, place int, rule_id string, ord int, field string, citation string, check string")
    ending = F.array(*[F.struct(*[F.lit(x).cast("string").alias(n) for n, x in zip(("status", "reason", "exemption_id", "citation"), end, strict=True)]) for end in ends])
    found = rows.crossJoin(F.broadcast(table)).select("scan_id", "rule_id", "ord", "field", "check", F.col("citation").alias("cited"), F.get(ending, F.get("codes", F.col("at"))).alias("end"), F.get("shown", F.col("place")).alias("own"))
    exempt, votes = F.col("end.exemption_id").isNotNull(), F.col("own.votes")
    evidence = F.when(exempt, F.create_map(F.lit("exemption_id"), F.col("end.exemption_id"))).when(votes.isNotNull(), F.create_map(F.lit("check"), F.col("check"), F.lit("agreement"), votes)).otherwise(F.create_map(F.lit("check"), F.col("check")))
    return found.select(
        "scan_id", "rule_id", "ord", "field", F.col("end.status").alias("status"), F.col("end.reason").alias("reason"), F.when(~exempt, F.col("own.value")).alias("observed"),
        F.when(exempt, 1.0).when(F.col("own.value").isNotNull(), F.coalesce("own.confidence", F.lit(0.0))).otherwise(0.0).alias("confidence"),
        F.when(exempt, F.col("end.citation")).otherwise(F.col("cited")).alias("citation"), evidence.alias("evidence"))


def _cases(r: Row, field: Callable[[str], Column], facts: dict[str, dict], day: Column) -> list[tuple[Column | None, str, str | None]]:
    """(condition, status, reason) of a rule's outcomes, the first that holds counts; the last has no condition."""
    own, other = field(r.field), r.after_field or r.relative_requires
    o = field(other) if other else None
    seen, blank, relative = own["value"].isNotNull(), F.coalesce(own["anchor_only"], F.lit(False)), F.coalesce(own["relative"], F.lit(False))
    o_blank = F.coalesce(o["anchor_only"], F.lit(False)) if other else F.lit(True)
    # a date, or else a period counted from another declared date
    anchor = F.when(o.isNotNull() & ~o_blank, o["own"]) if other else F.lit(None).cast(READ["own"])
    own_date = F.when(~blank & (F.trim(F.coalesce(own["value"], F.lit(""))) != ""), own["own"])
    ends = {
        e: F.coalesce(own_date[e], F.when(own_date.isNull() & ~blank & own["period"].isNotNull(), F.date_add(F.add_months(anchor[e], own["period"]["months"]), own["period"]["days"])))
        for e in ("earliest", "latest")}
    first, last = ends["earliest"], ends["latest"]
    absent = (~seen if r.field not in EXTRACTABLE else F.lit(False), "NOT_APPLICABLE", "field_not_extractable")
    if r.check == "field_present":
        return [(seen & blank, "FAIL", None), (seen, "PASS", None), absent, (None, "FAIL", None)]
    if r.check == "matches_registry":
        name = facts["expected"].get((r.registry_key, r.field))
        expected = F.col(name) if name else F.lit(None).cast("array<string>")
        return [
            (F.col("registered").isNull(), "NOT_APPLICABLE", "registry_unpopulated"), absent, (~seen | blank, "FAIL", None), (F.lit(r.registry_key is None), "NOT_ASSESSABLE", "registry_key_missing"),
            (expected.isNull(), "NOT_ASSESSABLE", "registry_unpopulated"), (F.array_contains(expected, own["norm"]), "PASS", None), (F.col("authority") == "AUTHORITATIVE", "FAIL", None), (None, "NEEDS_REVIEW", None)]
    if r.check == "role_present":
        role = r.role and r.role.lower()
        return [
            (blank, "FAIL", None), (F.lit(role is None), "NOT_ASSESSABLE", "role_missing"), (F.lit(role is not None and role not in ROLES), "NOT_ASSESSABLE", "role_unknown"),
            (facts["role"][role] if role else None, "PASS", None), (facts["role"]["unknown"], "NEEDS_REVIEW", None), (None, "FAIL", None)]
    if r.check == "date_marking":
        return [absent, (~seen | blank, "FAIL", None), (relative & F.lit(r.relative_requires is not None) & (o.isNull() | o_blank if other else F.lit(True)), "FAIL", None), (None, "PASS", None)]
    if r.check == "date_not_future":
        return [
            (~seen | blank, "NOT_APPLICABLE", "no_date_declared"), (own["own"].isNull(), "NOT_ASSESSABLE", "date_unparsed"), (own["own"]["earliest"] > day, "FAIL", None),
            (possibly_after(own["own"], day), "NEEDS_REVIEW", None), (None, "PASS", None)]
    if r.check == "date_order":
        return [
            (F.lit(r.after_field is None), "NOT_ASSESSABLE", "order_unconfigured"), (first.isNull() | anchor.isNull(), "NOT_APPLICABLE", "date_pair_incomplete"), (anchor["earliest"] > last, "FAIL", None),
            ((first > anchor["latest"]) | (first == anchor["earliest"]), "PASS", None), (None, "NEEDS_REVIEW", None)]
    if r.check == "not_expired":
        return [
            (~seen | blank, "NOT_APPLICABLE", "no_date_declared"), (first.isNull(), "NOT_ASSESSABLE", "date_unresolved"), (last < day, "FAIL", None), (first < day, "NEEDS_REVIEW", None), (None, "PASS", None)]
    if r.check == "min_height_mm":
        height = facts["height"][r.field]
        low, high, least = height["low_mm"], height["high_mm"], F.lit(r.min_mm).cast("double")
        return [
            (low.isNull() & F.col("unavailable").isNotNull(), "NOT_APPLICABLE", "height_scale_unavailable"), (low.isNull(), "NOT_ASSESSABLE", "height_not_measured"), (least.isNull(), "NOT_ASSESSABLE", "threshold_unconfigured"),
            (F.lit(bool(r.needs_legal_confirmation or r.needs_calibration)), "NEEDS_REVIEW", None), (low >= least, "PASS", None), (high < least, "FAIL", None), (None, "NEEDS_REVIEW", None)]
    raise ValueError(f"rule {r.rule_id}: unknown check {r.check}")


#: What a rule can hold a declared value against.
REGISTRY_KEYS = ("mrp_exact", "net_quantity", "brand_strings")


def _expected(registry: DataFrame, pairs: dict[tuple[str, str], str]) -> DataFrame:
    """scan_id, registered, authority and for each pair of a registry key and a field the normal forms that a value may have there, null where the product has none.

    Each distinct product is read once. A form that cannot be read is null, and equals nothing.
    """

    def made(products: DataFrame) -> DataFrame:
        brands = F.when(F.size("brand_strings") > 0, nfkc_all(F.col("brand_strings")))
        of = {"mrp_exact": F.when(F.col("mrp_exact").isNotNull(), F.array(F.col("mrp_exact").cast("string"))), "net_quantity": F.when(F.col("net_quantity").isNotNull(), F.array(nfkc(F.col("net_quantity")))), "brand_strings": brands}
        products = once(products, {f"c_{key}": c for key, c in of.items()})
        normed = lambda f: lambda v: _norm(F.lit(f), v)
        return products.select(*REGISTRY_KEYS, *[F.transform(f"c_{key}", normed(f)).alias(name) for (key, f), name in pairs.items()])

    facts = registry.select("scan_id", F.lit(True).alias("registered"), "authority", *REGISTRY_KEYS)
    return (_read_once(facts, REGISTRY_KEYS, made) if pairs else facts).drop(*REGISTRY_KEYS)


def _norm(field: Column, value: Column) -> Column:
    """A text, in form NFKC, as values that agree in a field have it in common; null where it cannot be read."""
    return F.when(readable(field, value, False), norm_field(field, value, False))


def _named(asked: list[Row], exempts: list[Row]) -> list[str]:
    """The fields that rules and exemptions name: their own, and those that dates are counted from."""
    return sorted({f for r in asked for f in (r.field, r.after_field, r.relative_requires) if f} | {e.field for e in exempts})


def _nested(declared: DataFrame, asked: list[Row], exempts: list[Row]) -> DataFrame:
    """scan_id, fields: a scan's declared fields that rules name, by field, tens at most; two rows of one scan and field are an error.

    Each distinct text is read once: dates and periods of the fields that date rules name, normal forms of those that registry rules name, and which exemptions hold.
    """
    dates, registered = _date_fields(asked), sorted({r.field for r in asked if r.check == "matches_registry"})
    among = lambda some: F.col("field").isin(some)

    def made(texts: DataFrame) -> DataFrame:
        texts = once(texts, {
            "value_c": F.when(among(registered), nfkc(F.col("value"))), "seen": F.when(among([e.field for e in exempts]), norm_quantity(F.col("value"))), "number": F.trim("value").try_cast("double"),
            **{f"asked{i}": norm_quantity(F.concat_ws(" ", F.lit(e.value).cast("string"), F.lit(e.unit).cast("string"))) for i, e in enumerate(exempts)}})
        holds = [F.coalesce(among([e.field]) & _compared(F.col("seen"), F.col(f"asked{i}"), F.col("number"), F.lit(e.op), F.lit(e.value), F.lit(e.unit).cast("string")), F.lit(False)) for i, e in enumerate(exempts)]
        read = {"own": F.when(among(dates), label_date(F.col("value"))), "period": F.when(among(dates), label_period(F.col("value"))), "norm": F.when(among(registered), _norm(F.col("field"), F.col("value_c"))), "holds": F.array(*holds).cast("array<boolean>")}
        return texts.select("field", "value", *[c.cast(READ[n]).alias(n) for n, c in read.items()])

    rows = declared.where(among(_named(asked, exempts)))
    votes = F.when(F.col("value").isNotNull() & F.col("agreement").isNotNull(), F.concat(F.col("agreement").cast("string"), F.lit("/"), F.col("frames").cast("string"), F.lit(" frames")))
    rows = rows.select("scan_id", "field", "value", "anchor_only", "relative", "confidence", votes.alias("votes"))
    some = sorted({*dates, *registered, *[e.field for e in exempts]})
    rows = _read_once(rows, ("field", "value"), made, among(some) & F.col("value").isNotNull()) if some else _filled(rows, READ)
    return rows.groupBy("scan_id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct(*OWN)))).alias("fields"))


def _date_fields(asked: list[Row]) -> list[str]:
    """The fields that date rules read."""
    return sorted({v for r in asked if r.check in ("date_marking", "date_not_future", "date_order", "not_expired") for v in (r.field, r.relative_requires, r.after_field) if v})


def _rank(status: Column, order: tuple[str, ...]) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in order]), status), F.lit(99)).cast("int")


def verdict_rollup(findings: DataFrame) -> DataFrame:
    """The worst status of each scan; one where nothing was evaluated is NOT_ASSESSABLE."""
    return findings.groupBy("scan_id").agg(_verdict().alias("verdict"))


def _verdict() -> Column:
    worst = F.min(F.when(F.col("status").isin(*VERDICT_ORDER), _rank(F.col("status"), VERDICT_ORDER)))
    return F.coalesce(F.get(F.array(*[F.lit(v) for v in VERDICT_ORDER]), worst - 1), F.lit("NOT_ASSESSABLE"))


def field_groups(findings: DataFrame) -> DataFrame:
    """Per (scan, field) the worst status and the first observed value by rule order."""
    order = F.col("ord") if "ord" in findings.columns else F.col("rule_id")
    g = findings.groupBy("scan_id", "field").agg(F.min(_rank(F.col("status"), GROUP_ORDER)).alias("w"), F.min_by("observed", F.when(F.col("observed").isNotNull(), order)).alias("observed"))
    return g.select("scan_id", "field", F.get(F.array(*[F.lit(v) for v in GROUP_ORDER]), F.col("w") - 1).alias("status"), "observed")


def caveats(findings: DataFrame) -> DataFrame:
    """Per scan and status the rules that did not apply or could not be told, and what the verdict means.

    scan_id, not_applicable, partial ('' where there are none), verdict, explanation.
    """
    ids = lambda status: F.array_sort(F.collect_list(F.when(F.col("status") == status, F.col("rule_id"))))
    g = findings.groupBy("scan_id").agg(ids("NOT_APPLICABLE").alias("a"), ids("NOT_ASSESSABLE").alias("b"), _verdict().alias("verdict"))
    told = lambda c, words: F.when(F.size(c) > 0, F.concat(F.lit(" "), F.size(c).cast("string"), F.lit(words), F.array_join(c, ", "), F.lit("."))).otherwise("")
    g = g.select("scan_id", told("a", " check(s) did not apply: ").alias("not_applicable"), told("b", " check(s) could not be assessed: ").alias("partial"), "verdict")
    meaning = (
        F.when(F.col("verdict") == "PASS", F.concat(F.lit("Every check that applied passed."), "not_applicable", "partial"))
        .when(F.col("verdict") == "FAIL", F.concat(F.lit("One or more declarations do not meet what is cited."), "not_applicable", "partial"))
        .when(F.col("verdict") == "NEEDS_REVIEW", "A person must decide on the flagged checks.").otherwise("Not enough evidence to judge."))
    return g.withColumn("explanation", meaning)


def blocking_checks(findings: DataFrame) -> DataFrame:
    """The findings whose status is their scan's verdict."""
    return findings.join(verdict_rollup(findings), "scan_id").where("status = verdict and verdict <> 'PASS'").select("scan_id", "rule_id", "status")


def violations(findings: DataFrame) -> DataFrame:
    """Findings that a reader must look at: failed, or not assessable."""
    return findings.where(F.col("status").isin("FAIL", "NOT_ASSESSABLE"))


def finding_validate(findings: DataFrame) -> DataFrame:
    """`findings` with `fault`, null where sound: a rule and a citation, a confidence in [0, 1], a reason where not assessable."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    fault = (
        F.when(blank("rule_id"), "no_rule").when(blank("citation"), "no_citation").when(~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)), "confidence")
        .when((F.col("status") == "NOT_ASSESSABLE") & blank("reason"), "no_reason"))
    return findings.withColumn("fault", fault)


def report_order(groups: DataFrame) -> DataFrame:
    """Field groups as a report lists them: by scan, worst first, then by field."""
    return groups.orderBy("scan_id", _rank(F.col("status"), GROUP_ORDER), "field")
