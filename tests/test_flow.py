"""Lines of several frames and sides to one finding a scan and rule."""

from pyspark.sql import functions as F

from packlens.operators import extract, flow, rules

LINE = "scan_id long, side string, frame int, line_no int, text string, left int, top int, right int, bottom int"
BACK = ["NET WT: 500 g", "MRP Rs. 45/- incl. of all taxes", "Batch No. B12", "Manufactured by:", "Acme Foods", "Indore 452001"]
FRONT = ["FSSAI Lic. 10012345678901", "MFG DATE : 06/2025", "BEST BEFORE 9 months from packing", "Customer care 98765 43210"]


def lines(spark, packs):
    """packs: scan_id to (side, frame, texts)."""
    rows = [(k, side, frame, i, t, 40, 40 + 60 * i, 340, 70 + 60 * i) for k, shots in packs.items() for side, frame, texts in shots for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, LINE)


def test_frames_and_sides_to_verdicts(spark):
    swapped = lambda old, new, texts: [new if t == old else t for t in texts]
    misread = swapped(BACK[1], "MRP Rs. 49/- incl. of all taxes", BACK)
    packs = {
        1: [("back", f, BACK) for f in range(4)] + [("front", f, FRONT) for f in range(4)],
        2: [("back", 0, BACK), ("back", 1, misread), ("back", 2, BACK), ("back", 3, BACK), ("front", 0, FRONT)],
        3: [("back", 0, BACK), ("back", 1, misread), ("front", 0, FRONT)],
        4: [("back", 0, BACK), ("front", 0, [*FRONT, "NET WT: 200 g"])],
        5: [("back", 0, swapped(BACK[3], "a plain line", BACK)), ("front", 0, FRONT)],
        6: [("back", 0, BACK), ("back", 1, ["nothing at all"]), ("front", 0, FRONT)],
    }
    ruleset, exempt, _ = rules.load_rules(spark)
    ruleset = ruleset.where(~F.col("rule_id").isin("CAP-01", "CAP-02"))
    found = flow.judge(lines(spark, packs), ruleset, exempt, "2025-09-05").collect()
    of = {(r.scan_id, r.rule_id): r for r in found}
    assert len(of) == len(found) == 6 * 15, "one finding a scan and rule"
    status = lambda k, rule: of[k, rule].status
    assert {r.rule_id: r.status for r in found if r.scan_id == 1 and r.status not in ("PASS", "NOT_APPLICABLE")} == {}
    assert of[2, "MRP-01"].observed.startswith("45") and status(2, "MRP-01") == "PASS" and of[2, "MRP-01"].confidence == 0.75, "a misread frame is outvoted"
    assert status(3, "MRP-01") == "FAIL" and status(3, "QTY-01") == "PASS", "two frames that differ settle nothing"
    assert status(4, "QTY-01") == "FAIL" and status(4, "MRP-01") == "PASS", "sides that disagree declare nothing"
    assert [status(k, "MFR-01") for k in (1, 5)] == ["PASS", "NEEDS_REVIEW"]
    assert status(6, "MRP-01") == "FAIL", "a frame without fields counts among the side's frames"
    assert status(1, "EXPIRY-01") == status(1, "EXPIRY-03") == "PASS", "nine months from June are not over in September"
    declared, scans, roles = flow.declared_of(flow.observations_of(lines(spark, packs)))
    one = {r.field: r for r in declared.where("scan_id = 1").collect()}
    assert one["manufacturer_address"].value == "Acme Foods, Indore 452001" and one["expiry"].relative and not one["mfg_date"].relative
    assert scans.count() == 6 and {r.role for r in roles.where("scan_id = 1").collect()} == {"manufacturer", "unknown"}


def test_equal_frames_are_read_once(spark):
    packs = {1: [("back", f, BACK if f != 2 else FRONT) for f in (3, 0, 2, 4)] + [("front", f, BACK) for f in (0, 1)]}
    kinds = {(r.side, r.first): (sorted(r.frames), [x.text for x in r.lines]) for r in flow._kinds(lines(spark, packs)).collect()}
    assert kinds == {("back", 0): ([0, 3, 4], BACK), ("back", 2): ([2], FRONT), ("front", 0): ([0, 1], BACK)}
    said = flow.observations_of(lines(spark, packs)).where("field IN ('mrp', '__seen')").collect()
    assert sorted((r.side, r.frame) for r in said if r.field == "__seen") == [("back", 0), ("back", 2), ("back", 3), ("back", 4), ("front", 0), ("front", 1)]
    assert sorted((r.side, r.frame, r.value) for r in said if r.field == "mrp") == [("back", 0, "45"), ("back", 3, "45"), ("back", 4, "45"), ("front", 0, "45"), ("front", 1, "45")]


def test_findings_are_not_shuffled(spark):
    declared = spark.createDataFrame([(1, "mrp", "Rs. 5"), (1, "expiry", "12/2030"), (2, "mrp", "6")], "scan_id long, field string, value string")
    ruleset, exempt, _ = rules.load_rules(spark)
    found = rules.evaluate(declared, ruleset, exempt, "2026-09-05", heights=spark.createDataFrame([(1, "mrp", 1.0, 2.0)], "scan_id long, field string, low_mm double, high_mm double"))
    assert found.count() == 2 * ruleset.count()
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    crossed = next(i for i, line in enumerate(plan) if "Join Cross" in line)
    assert not any("Join" in line or "Aggregate" in line for line in plan[:crossed]), "rules come after all joins"


def test_findings_take_what_is_made_once_a_scan(spark):
    declared = spark.range(40).selectExpr("id AS scan_id", "explode(array('mrp', 'brand', 'expiry')) AS field").selectExpr("*", "CASE field WHEN 'mrp' THEN '₹ ５' WHEN 'brand' THEN 'Acme' ELSE '12/2030' END AS value")
    registry = spark.range(40).selectExpr("id AS scan_id", "'ASSERTED' AS authority", "5.0D AS mrp_exact", "'5 g' AS net_quantity", "array('x', 'ＡＣＭＥ') AS brand_strings")
    ruleset, exempt, _ = rules.load_rules(spark)
    found = rules.evaluate(declared, ruleset, exempt, "2026-09-05", registry=registry)
    assert {(r.rule_id, r.status) for r in found.where("rule_id IN ('MRP-02', 'QTY-02', 'BRAND-01', 'EXPIRY-03')").collect()} == {("MRP-02", "PASS"), ("QTY-02", "FAIL"), ("BRAND-01", "PASS"), ("EXPIRY-03", "PASS")}
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString(), "only distinct texts reach Python"
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan[: plan.index("Join Cross")], "findings search no list"


def test_lines_are_dealt_by_frame_before_they_are_read(spark):
    lines = spark.range(0, 400, 1, 1).selectExpr("id div 4 AS scan_id", "0 AS frame", "CAST(id % 4 AS INT) AS line_no", "concat('MRP Rs. ', id) AS text")
    fields = extract.frame_fields(lines)
    assert [r.mrp for r in fields.orderBy("scan_id").select("mrp").collect()] == [str(4 * i) for i in range(100)]
    plan = fields._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Generate") < plan.index("RepartitionByExpression"), "candidates are made where a frame's lines are gathered"
