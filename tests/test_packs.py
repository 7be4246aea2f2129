"""Example values of rules, sizes, addresses, matching, files and streams; the matchers against all pairs."""

import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from packlens.functions.normalize import server_money, server_quantity, server_text
from packlens.operators import extract, fleet, match, measure, rules
from packlens.sources import files
from packlens.streaming import ingest

TODAY = "2026-09-05"
DECLARED = "scan_id long, field string, value string, anchor_only boolean, relative boolean, confidence double, agreement int, frames int"


def findings(spark, declared, text=None, **more):
    rows = [(s, f, v, b, r, 0.8, 4, 5) for s, f, v, b, r in declared]
    ruleset, exempt, _ = rules.load_rules(spark, text)
    found = rules.evaluate(spark.createDataFrame(rows, DECLARED), ruleset, exempt, TODAY, **more).collect()
    return {(r.scan_id, r.rule_id): r for r in found}


def changed(**edit):
    root = json.loads(rules.CANONICAL.read_text())
    return json.dumps(root | edit)


def test_rules_are_refused(spark):
    root = json.loads(rules.CANONICAL.read_text())
    first = root["rules"][0]
    for text in (
        "{}", changed(version=None), changed(source_citation=None), changed(height_metric=None), changed(rules=[{k: v for k, v in first.items() if k != "citation"}]),
        changed(rules=[{k: v for k, v in first.items() if k != "check"}]), changed(rules=[first | {"check": {"type": "guess"}}]),
        changed(exemptions=[{k: v for k, v in root["exemptions"][0].items() if k != "citation"}]), changed(exemptions=[{k: v for k, v in root["exemptions"][0].items() if k != "condition"}])):
        with pytest.raises(ValueError):
            rules.load_rules(spark, text)
    ruleset, exempt, about = rules.load_rules(spark)
    assert ruleset.count() == 17 and exempt.count() == 2 and about["height_metric"] == "cap_height"
    assert {r.field for r in ruleset.select("field").collect()} <= set(rules.EXTRACTABLE)


def test_date_rules(spark):
    cases = {
        # made, expiry (value, blank, relative) -> MFG-02, EXPIRY-01, EXPIRY-02, EXPIRY-03
        1: (("12/2027", False), ("12/2030", False, False), ("FAIL", "PASS", "PASS", "PASS")),
        2: (("", True), ("9 months from packing", False, True), ("NOT_APPLICABLE", "FAIL", "NOT_APPLICABLE", "NOT_ASSESSABLE")),
        3: (("06/2026", False), ("06/2026", False, False), ("PASS", "PASS", "PASS", "FAIL")),
        4: (("09/2026", False), ("", True, False), ("NEEDS_REVIEW", "FAIL", "NOT_APPLICABLE", "NOT_APPLICABLE")),
        5: (("03/2026", False), ("12/2025", False, False), ("PASS", "PASS", "FAIL", "FAIL")),
        6: (("03/2026", False), ("9 months", False, False), ("PASS", "PASS", "PASS", "PASS")),
        7: (("MFD BY", False), ("09/2026", False, False), ("NOT_ASSESSABLE", "PASS", "NOT_APPLICABLE", "NEEDS_REVIEW")),
        8: (("15/06/2026", False), ("06/2026", False, False), ("PASS", "PASS", "NEEDS_REVIEW", "FAIL")),
        9: (None, ("soon", False, True), ("NOT_APPLICABLE", "FAIL", "NOT_APPLICABLE", "NOT_ASSESSABLE")),
    }
    declared = [(s, "mfg_date", made[0], made[1], False) for s, (made, _, _) in cases.items() if made]
    declared += [(s, "expiry", *expiry) for s, (_, expiry, _) in cases.items()]
    found = findings(spark, declared)
    for s, (*_, expected) in cases.items():
        assert tuple(found[s, r].status for r in ("MFG-02", "EXPIRY-01", "EXPIRY-02", "EXPIRY-03")) == expected, s
    assert found[2, "EXPIRY-03"].reason == "date_unresolved" and found[7, "MFG-02"].reason == "date_unparsed" and found[9, "MFG-02"].reason == "no_date_declared"


def test_registry_roles_heights_and_exemptions(spark):
    declared = [
        (1, "mrp", "Rs. 45", False, False), (1, "net_quantity", "10 g", False, False), (1, "brand", "ACME  Foods", False, False), (2, "mrp", "", True, False), (2, "net_quantity", "11 g", False, False),
        (3, "mrp", "Rs. 50", False, False), (3, "net_quantity", "ten g", False, False), (3, "manufacturer_address", "", True, False)]
    registry = spark.createDataFrame([(1, "ASSERTED", 45.0, "0.01 kg", ["x", "acme foods"]), (3, "AUTHORITATIVE", 45.0, None, [])], "scan_id long, authority string, mrp_exact double, net_quantity string, brand_strings array<string>")
    roles = spark.createDataFrame([(1, "MANUFACTURER"), (2, "UNKNOWN"), (3, "PACKER")], "scan_id long, role string")
    heights = spark.createDataFrame([(1, "mrp", 1.0, 1.2), (2, "mrp", 0.5, 0.9), (3, "mrp", 0.9, 1.1)], "scan_id long, field string, low_mm double, high_mm double")
    scales = spark.createDataFrame([(2, "uncalibrated")], "scan_id long, unavailable string")
    more = dict(registry=registry, roles=roles, heights=heights, scales=scales)
    root = json.loads(rules.CANONICAL.read_text())
    for r in root["rules"]:
        if r["id"] == "CAP-01":
            r["check"]["params"] = {"min_mm": 1.0}
    root["rules"].append({"id": "LOGO-01", "field": "logo", "citation": "c", "check": {"type": "field_present"}})
    f = findings(spark, declared, json.dumps(root), **more)
    of = lambda rule: [f[s, rule].status for s in (1, 2, 3)]
    assert of("MRP-02") == ["PASS", "NOT_APPLICABLE", "FAIL"] and of("QTY-02") == ["PASS", "NOT_APPLICABLE", "NOT_ASSESSABLE"] and of("BRAND-01") == ["PASS", "NOT_APPLICABLE", "FAIL"]
    assert of("MFR-01") == ["PASS", "NEEDS_REVIEW", "FAIL"] and of("CAP-01") == ["PASS", "FAIL", "NEEDS_REVIEW"] and of("LOGO-01") == ["NOT_APPLICABLE"] * 3
    assert of("CAP-02") == ["NOT_ASSESSABLE", "NOT_APPLICABLE", "NOT_ASSESSABLE"] and of("CARE-01") == ["EXEMPT", "FAIL", "FAIL"] and of("MRP-01") == ["PASS", "FAIL", "PASS"]
    assert f[1, "CARE-01"].evidence == {"exemption_id": "EX-SMALL-PACK"} and f[1, "CARE-01"].confidence == 1.0 and "r. 26" in f[1, "CARE-01"].citation
    assert f[1, "MRP-01"].evidence == {"check": "field_present", "agreement": "4/5 frames"} and f[1, "MRP-01"].confidence == 0.8 and f[1, "TAX-01"].confidence == 0.0
    held = findings(spark, declared, **more)
    assert held[1, "CAP-01"].status == held[2, "CAP-01"].status == "NEEDS_REVIEW", "thresholds that nobody confirmed accuse nobody"


def test_scales(spark):
    rows = [(1, 2, 1.0, 5.0), (2, 0, 1.0, 5.0), (3, 1, 1.0, 5.0), (4, 1, 1.1, 5.0), (5, 2, 1.0, 0.0), (6, 1, 1.0, 150.0)]
    optics = spark.createDataFrame([(k, 5.6, 7.4, 4000, 3000, 5.4, d, c, x) for k, c, x, d in rows], "k int, sensor_h_mm double, sensor_w_mm double, image_w_px int, image_h_px int, focal_mm double, diopters double, calibration int, correction double")
    got = {r.k: r for r in measure.mm_scale(optics).collect()}
    per = lambda d, c=1.0: 7.4 * 0.75 / 3000 * (d - 5.4) / 5.4 * c
    for k, t, c in ((1, 0.10, 1.0), (3, 0.30, 1.0), (4, 0.05, 1.1)):
        assert got[k].min_mm == pytest.approx(per(200 * (1 - t), c)) and got[k].max_mm == pytest.approx(per(200 * (1 + t), c))
    assert got[2].min_mm is None and got[2].unavailable == "uncalibrated" and got[5].min_mm is None and got[5].unavailable is None
    assert got[6].min_mm == pytest.approx(per(5.4 * 1.0001)) and got[4].scale_source == "CALIBRATED_DEVICE"


def test_addresses_follow_their_caption(spark):
    texts = ["निर्माता :", "गोकुल", "", "रोड़ नं. 7, इन्दौर", "MFG DATE : 06/2025", "Packed by: Blue Packers", "a line"]
    lines = spark.createDataFrame([(1, 0, i, t, 0, i * 10, 50, i * 10 + 8) for i, t in enumerate(texts)], "scan_id long, frame int, line_no int, text string, left int, top int, right int, bottom int")
    got = {r.line_no: r for r in extract.tag_addresses(lines).collect()}
    assert (got[0].role, got[0].body, got[0].lines, got[0].bottom) == ("MANUFACTURER", "गोकुल, रोड़ नं. 7, इन्दौर", 3, 38)
    assert (got[5].role, got[5].body) == ("PACKER", "Blue Packers") and got[6].role == "UNKNOWN" and len(got) == len(texts)
    assert {r.role: r.addresses for r in extract.address_roles(extract.tag_addresses(lines)).collect()}["PACKER"] == "Blue Packers"


def test_server_forms(spark):
    rows = spark.createDataFrame([("  ACME  Foods ", "45", "500 Grams"), (None, "Rs 45", "500gm")], "b string, p string, q string")
    got = [tuple(r) for r in rows.select(server_text(F.col("b")), server_money(F.col("p")), server_quantity(F.col("q"))).collect()]
    assert got == [("acme foods", "45.00", "500 g"), ("", "rs 45", "500gm")]


def test_matchers_equal_all_pairs(spark):
    rng = random.Random(4)
    brand = lambda: rng.choice([None, "Acme Foods", "acme foods gold", "Best Tea", "best tea co", "Best"])
    price, quantity, licence = (lambda: rng.choice([None, 10, 20, 30])), (lambda: rng.choice([None, "100 g", "200 g", "1 kg"])), (lambda: rng.choice([None, "1", "2"]))
    products = [(f"S{i:03}", [b for b in (brand(), brand()) if b], price(), quantity(), licence()) for i in range(60)]
    packs = [(i, brand(), price(), quantity(), licence()) for i in range(120)]
    registry = spark.createDataFrame(products, "sku_id string, brand_strings array<string>, mrp int, net_quantity string, licence string")
    scans = spark.createDataFrame([(i, b, p if p is None else str(p), q, l) for i, b, p, q, l in packs], "id long, brand string, mrp string, net_quantity string, licence string")
    jaccard = lambda a, b: len(set(a.lower().split()) & set(b.lower().split())) / len(set(a.lower().split()) | set(b.lower().split()))
    identity = {r.id: r for r in match.match_identity(scans, registry).collect()}
    weighted = {r.id: r for r in match.match_weighted(scans, registry).collect()}
    for i, b, p, q, l in packs:
        best, held = (0.0, None), []
        for sku, brands, rp, rq, rl in products:
            parts = ([max(jaccard(b, x) for x in brands)] if b and brands else []) + ([float(p == rp)] if p and rp else []) + ([float(q == rq)] if q and rq else [])
            score = round(sum(parts) / len(parts), 6) if parts else 0.0
            best = max(best, (score, sku), key=lambda x: x[0])
            w = 2 * bool(b and brands) + 2 * bool(q and rq) + bool(l and rl)
            s = 2 * any(bool(b) and b.lower() == x.lower() for x in brands) + 2 * bool(q and q == rq) + bool(l and l == rl)
            held += [(s / w, sku)] if w and s / w >= 0.75 else []
        got = identity[i]
        assert (got.status, got.sku, got.score) == (("MATCHED", best[1], best[0]) if best[0] >= 0.72 else ("REJECTED", None, None)), (i, b, p, q)
        top = [sku for s, sku in held if s == max(held)[0]]
        assert (weighted[i].sku, weighted[i].candidates) == (top[0] if len(top) == 1 else None, len(top)), (i, b, q, l)
    assert {r.status for r in match.match_identity(scans, registry.limit(0)).collect()} == {"NO_CANDIDATE"}


def png(path, grey):
    h, w = grey.shape
    raw = b"".join(b"\0" + np.repeat(row, 3).astype(np.uint8).tobytes() for row in grey)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_sharpness(spark, tmp_path):
    rng = np.random.default_rng(2)
    noise = rng.integers(0, 256, (20, 30)).astype(np.int64)
    soft = (noise + np.roll(noise, 1, 0) + np.roll(noise, 1, 1) + np.roll(noise, (1, 1), (0, 1))) // 4
    for name, x in (("sharp", noise), ("soft", soft), ("flat", noise * 0 + 9), ("tiny", noise[:2])):
        png(tmp_path / f"{name}.png", x)
    got = {r.origin.rsplit("/", 1)[1][:-4]: r.variance for r in measure.frame_sharpness(spark.read.format("image").load(str(tmp_path))).collect()}
    luma = (256 * noise) >> 8
    edges = np.array([[luma[y, x - 1] + luma[y, x + 1] + luma[y - 1, x] + luma[y + 1, x] - 4 * luma[y, x] for x in range(1, 29)] for y in range(1, 19)], float)
    assert got["sharp"] == pytest.approx(edges.var()) and got["soft"] < got["sharp"] / 4 and got["flat"] == got["tiny"] == 0.0


def test_files(spark, tmp_path):
    scans = spark.createDataFrame([(1, 0, "PASS", 'a "b", c', "4,5"), (2, 0, "FAIL", None, "x\ny")], "id long, scanned_at long, verdict string, brand string, mrp string")
    checks = spark.createDataFrame([(1, "R", "PASS", "mrp", "4")], "scan_id long, rule_id string, status string, field string, observed string")
    files.write_history_csv(fleet.history_rows(scans, checks).coalesce(1).orderBy("id"), str(tmp_path / "csv"))
    (part,) = (tmp_path / "csv").glob("part-*")
    assert part.read_text() == 'id,scanned,verdict,brand,mrp,rule_id,status,field,observed\n1,1970-01-01 00:00:00,PASS,"a ""b"", c","4,5",R,PASS,mrp,4\n2,1970-01-01 00:00:00,FAIL,,"x\ny",,,,\n'
    (tmp_path / "scans.json").write_text('{"id": "a", "verdict": "odd", "brand": " ", "checks": [{"rule_id": "R", "status": "?"}]}\n{"id": "b", "verdict": "PASS", "mrp": "null"}\nnot json\n')
    read = {r.id: r for r in files.read_scans(spark, str(tmp_path / "scans.json")).collect()}
    assert sorted(read) == ["a", "b"] and read["a"].verdict == "NOT_ASSESSABLE" and read["a"].brand is None and read["a"].checks[0].status == "NOT_ASSESSABLE" and read["b"].mrp is None and read["b"].checks == []
    files.write_json(files.read_scans(spark, str(tmp_path / "scans.json")), str(tmp_path / "again"))
    assert {r.id for r in files.read_scans(spark, str(tmp_path / "again")).collect()} == {"a", "b"} and '"brand":null' in "".join(p.read_text() for p in (tmp_path / "again").glob("part-*"))
    (tmp_path / "skus.json").write_text('{"sku_id": "S", "net_quantity": "null", "source": "guess"}\n')
    (sku,) = files.read_registry(spark, str(tmp_path / "skus.json")).collect()
    assert sku.net_quantity is None and sku.source == "MANUAL"
    for i in (1, 2):
        (tmp_path / f"corpus/s{i}").mkdir(parents=True)
        (tmp_path / f"corpus/s{i}/scan.json").write_text(json.dumps({"id": f"s{i}", "verdict": "PASS"}))
        (tmp_path / f"corpus/s{i}/frame-01.jpg").write_bytes(b"x" * 524288)
    (tmp_path / "corpus/s2/frame-02.jpg").write_bytes(b"")
    assert {r.id: r.frame_count for r in files.corpus_load(spark, str(tmp_path / "corpus")).collect()} == {"s1": 1, "s2": 1}, "an empty frame is none"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "corpus")).drop("content")
    total = files.corpus_summary(listed).first()
    assert (total.scans, total.frames) == (2, 2) and total.megabytes == pytest.approx(1.0, abs=0.001)
    nested = '{"scan_id": 1, "side": "front", "frame": 0, "blocks": [{"lines": [{"text": "a", "box": {"left": 1, "top": 2, "right": 3, "bottom": 4}, "elements": [{"text": "a", "box": {"left": 1, "top": 2, "right": 2, "bottom": 4}}]}, {"text": "lost"}]}, {"lines": [{"text": "b", "box": {"left": 1, "top": 2, "right": 3, "bottom": 4}}]}]}'
    (tmp_path / "lines.json").write_text(nested + "\n")
    lines = files.read_ocr_lines(spark, str(tmp_path / "lines.json"), "json", nested=True)
    assert sorted((r.line_no, r.text) for r in lines.collect()) == [(0, "a"), (1, "b")]
    boxes = extract.word_box(lines.withColumn("value", F.lit("a"))).orderBy("line_no").collect()
    assert boxes[0].value_box.right == 2 and boxes[1].value_box.right == 3
    results = files.export_results(
        spark.createDataFrame([(1, "R1", "mrp", "FAIL", " ", "3/5 frames"), (1, "R2", "mrp", "PASS", "4", None)], "scan_id long, rule_id string, field string, status string, observed string, agreement string"),
        spark.createDataFrame([(1, "a/b", "FAIL", "1", 3, None, 0, ["x"])], "scan_id long, image_id string, verdict string, ruleset_version string, frames_used int, elapsed_ms long, scanned_at long, raw_lines array<string>"))
    files.write_results(results, str(tmp_path / "results"))
    (out,) = (tmp_path / "results/image=a_b").glob("*.txt")
    doc = json.loads(out.read_text())
    assert doc["fields"]["mrp"] == {"present": False, "value": None, "status": "FAIL", "agreement": "3/5 frames"} and doc["violations"] == ["R1"] and doc["elapsed_ms"] is None
