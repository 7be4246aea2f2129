"""Views of packs, scans and registry that are derived from the given tables.

The definitions are written once in SQL that Spark and DuckDB read alike: integer and text
arithmetic only. DAYS(x) stands for the days since 1970-01-01 and MONTHS(x, n) for a date n months on, which the two spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("customer", "part", "orders", "lineitem", "events", "documents", "labels")

VIEWS = {
    "registry": """
        SELECT concat('SKU-', CAST(p_partkey AS STRING)) AS sku_id, p_brand AS brand, CASE WHEN p_partkey % 6 = 0 THEN concat(p_brand, ' gold') ELSE NULL END AS brand2,
               CASE WHEN p_partkey % 7 = 3 THEN NULL ELSE CAST(round(p_retailprice) AS BIGINT) END AS mrp,
               CASE WHEN p_partkey % 11 = 5 THEN NULL WHEN p_partkey % 17 = 4 THEN '1 pack' ELSE concat(CAST(p_size AS STRING), ' g') END AS net_quantity,
               CASE WHEN p_partkey % 4 = 1 THEN concat('1001', lpad(CAST(p_partkey AS STRING), 10, '0')) ELSE NULL END AS licence,
               CASE p_partkey % 3 WHEN 0 THEN 'IMPORTED' WHEN 1 THEN 'ENROLLED_FROM_SCAN' ELSE 'MANUAL' END AS source,
               p_partkey * 1000 AS saved_at
        FROM part""",
    "registry_update": """
        SELECT concat('SKU-', CAST(p_partkey + 3 AS STRING)) AS sku_id, p_brand AS brand, CAST(p_size AS BIGINT) AS mrp,
               concat(CAST(p_size AS STRING), ' g') AS net_quantity,
               CASE p_partkey % 5 WHEN 0 THEN 'IMPORTED' ELSE 'MANUAL' END AS source,
               (p_partkey + 3) * 1000 + (p_partkey % 3 - 1) * 500 AS saved_at
        FROM part WHERE p_partkey % 2 = 0""",
    "first_items": """
        SELECT l_orderkey, l_partkey FROM (
          SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r
          FROM lineitem) AS numbered WHERE r = 1""",
    "scans": """
        SELECT o_orderkey AS id, o_custkey AS device_id,
               CAST(DAYS(o_orderdate) AS BIGINT) * 86400000 + (o_orderkey % 86400) * 1000 AS scanned_at,
               CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'P' THEN 'PASS'
                 ELSE CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'NOT_ASSESSABLE' ELSE 'NEEDS_REVIEW' END END AS verdict,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('SKU-', CAST(p_partkey AS STRING)) END AS sku_id,
               CASE WHEN o_orderkey % 11 = 0 THEN '  ' WHEN o_orderkey % 13 = 0 THEN NULL ELSE p_brand END AS brand,
               CASE o_orderkey % 4 WHEN 0 THEN concat('Rs. ', price) WHEN 1 THEN concat('₹', price) WHEN 2 THEN concat(price, '.00') ELSE concat(price, '/-') END AS mrp,
               CASE WHEN o_orderkey % 8 = 6 THEN NULL WHEN o_orderkey % 31 = 3 THEN '500 widgets' WHEN o_orderkey % 3 = 0 THEN concat(CAST(p_size AS STRING), ' g')
                    WHEN o_orderkey % 3 = 1 THEN concat('0.', lpad(CAST(p_size AS STRING), 3, '0'), ' kg') ELSE concat(CAST(p_size AS STRING), 'gm') END AS net_quantity,
               CASE WHEN o_orderkey % 6 = 5 THEN NULL WHEN p_partkey % 4 = 1 THEN concat('1001', lpad(CAST(p_partkey + CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS STRING), 10, '0')) ELSE NULL END AS licence,
               concat('B', CAST(o_orderkey % 97 AS STRING)) AS batch_number, CASE WHEN o_orderkey % 5 = 2 THEN NULL ELSE concat(CAST(1 + o_orderkey % 12 AS STRING), '/', CAST(2020 + o_orderkey % 7 AS STRING)) END AS mfg_date,
               CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(DAYS(o_orderdate) AS BIGINT) * 86400000 + (o_orderkey % 86400) * 1000 + (o_custkey % 50) * 60000 END AS synced_at,
               CASE WHEN o_orderkey % 19 = 0 THEN '9.9.9' ELSE '1.2.0' END AS ruleset_version
        FROM (SELECT o.*, p.*, CAST(CAST(round(p.p_retailprice) AS BIGINT) + CASE WHEN o.o_orderkey % 9 = 0 THEN 5 ELSE 0 END AS STRING) AS price
              FROM orders o JOIN first_items f ON f.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = f.l_partkey) AS joined""",
    "scan_checks": """
        SELECT scan_id, rule_id, min(status) AS status, min(field) AS field, min(observed) AS observed FROM (
          SELECT l_orderkey AS scan_id,
                 CASE l_linenumber WHEN 1 THEN 'MRP-01' WHEN 2 THEN 'QTY-01' WHEN 3 THEN 'MFG-01' WHEN 4 THEN 'BATCH-01' WHEN 5 THEN 'TAX-01' WHEN 6 THEN 'MRP-02' ELSE 'QTY-02' END AS rule_id,
                 CASE l_linenumber WHEN 1 THEN 'mrp' WHEN 2 THEN 'net_quantity' WHEN 3 THEN 'mfg_date' WHEN 4 THEN 'batch_number' WHEN 5 THEN 'tax_inclusive' WHEN 6 THEN 'mrp' ELSE 'net_quantity' END AS field,
                 CASE WHEN l_returnflag = 'R' THEN 'FAIL' WHEN l_returnflag = 'A' THEN 'PASS' WHEN l_linestatus = 'O' THEN 'NOT_ASSESSABLE'
                      WHEN l_suppkey % 3 = 0 THEN 'NOT_APPLICABLE' ELSE 'NEEDS_REVIEW' END AS status,
                 CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE concat('seen "', CAST(l_partkey % 10 AS STRING), '", twice') END AS observed
          FROM lineitem) AS flat GROUP BY scan_id, rule_id""",
    "frames": """
        SELECT l_orderkey AS scan_id, concat(CASE WHEN l_orderkey % 2 = 0 THEN 'front' ELSE 'back' END, CASE WHEN r > 5 THEN concat(' ', CAST(CAST(floor((r - 1) / 5) AS INT) AS STRING)) ELSE '' END) AS side, CAST((r - 1) % 5 AS INT) AS frame, l_quantity, l_partkey, l_suppkey FROM (
          SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS r
          FROM lineitem) AS numbered""",
    "observations": """
        SELECT scan_id, side, frame, field,
               CASE field WHEN 'mrp' THEN CASE WHEN l_partkey % 17 = 0 THEN '' WHEN l_partkey % 13 = 0 THEN '|||'
                    WHEN l_suppkey % 3 = 0 THEN concat('Rs. ', CAST(40 + CAST(floor(l_quantity / 26) AS BIGINT) AS STRING))
                    WHEN l_suppkey % 3 = 1 THEN concat(CAST(40 + CAST(floor(l_quantity / 26) AS BIGINT) AS STRING), '.00')
                    ELSE concat('₹', CAST(40 + CAST(floor(l_quantity / 26) AS BIGINT) AS STRING)) END
                 WHEN 'net_quantity' THEN CASE WHEN l_partkey % 5 = 0 THEN '500 g' WHEN l_partkey % 5 = 1 THEN '0.5 kg' WHEN l_partkey % 5 = 2 THEN '500gm' WHEN l_partkey % 5 = 3 THEN '200 ml' ELSE '500 widgets' END
                 ELSE CASE WHEN l_partkey % 6 = 0 THEN ' ' WHEN l_suppkey % 2 = 0 THEN 'B-12,  x' ELSE 'b-12 X' END END AS value
        FROM frames CROSS JOIN (VALUES ('mrp'), ('net_quantity'), ('batch_number')) AS named(field)""",
    "date_texts": """
        SELECT k, CASE k % 7 WHEN 0 THEN concat(d, '/', m, '/', y) WHEN 1 THEN concat(m, '/', y) WHEN 2 THEN concat(mon, ' ', y)
                    WHEN 3 THEN concat(d, '-', mon, '-', substr(y, 3, 2)) WHEN 4 THEN concat(y, '-', lpad(m, 2, '0'))
                    WHEN 5 THEN concat('best before ', m, ' months') ELSE concat('PKD ', m, '.', d, '.', substr(y, 3, 2)) END AS raw FROM (
          SELECT k, CAST(day(shipped) AS STRING) AS d, CAST(month(shipped) AS STRING) AS m, CAST(year(shipped) AS STRING) AS y,
                 CASE month(shipped) WHEN 1 THEN 'Jan' WHEN 2 THEN 'FEB' WHEN 3 THEN 'March' WHEN 4 THEN 'apr' WHEN 5 THEN 'May' WHEN 6 THEN 'JUNE' WHEN 7 THEN 'Jul' WHEN 8 THEN 'Aug' WHEN 9 THEN 'SEPT' WHEN 10 THEN 'Oct' WHEN 11 THEN 'Nov' ELSE 'Dec' END AS mon
          FROM (SELECT l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10 AS k, CAST(l_shipdate AS DATE) AS shipped FROM lineitem) AS dated) AS parts""",
    "ocr_lines": """
        SELECT p_partkey AS scan_id, 0 AS frame, line_no,
               CASE line_no
                 WHEN 0 THEN p_name
                 WHEN 1 THEN CASE p_partkey % 4 WHEN 0 THEN concat('NET WT: ', CAST(p_size AS STRING), ' g') WHEN 1 THEN concat('Net Qty ', CAST(p_size AS STRING), 'ml') WHEN 2 THEN concat(CAST(p_size AS STRING), ' kg') ELSE 'NET WT' END
                 WHEN 2 THEN CASE p_partkey % 5 WHEN 0 THEN concat('MRP Rs. ', CAST(CAST(round(p_retailprice) AS BIGINT) AS STRING), '/-') WHEN 1 THEN concat('M.R.P ₹', CAST(CAST(round(p_retailprice) AS BIGINT) AS STRING), '.50') WHEN 2 THEN 'MRP' WHEN 3 THEN concat('customers ', CAST(p_size AS STRING)) ELSE concat('INR ', CAST(p_size AS STRING)) END
                 WHEN 3 THEN CASE p_partkey % 3 WHEN 0 THEN '(INCL. OF ALL TAXES)' WHEN 1 THEN '(inclusive of' ELSE 'serving size' END
                 WHEN 4 THEN CASE p_partkey % 3 WHEN 1 THEN 'every tax)' ELSE 'store cool' END
                 WHEN 5 THEN CASE p_partkey % 4 WHEN 0 THEN 'MFG DATE : 06/2025' WHEN 1 THEN 'MFG. DATE' WHEN 2 THEN concat('Packed on 12-DEC-', CAST(20 + p_partkey % 10 AS STRING)) ELSE 'plain words' END
                 WHEN 6 THEN CASE p_partkey % 3 WHEN 0 THEN concat('BATCH N0. B', CAST(p_partkey AS STRING)) WHEN 1 THEN 'BATCH N0.' ELSE 'Lot No' END
                 WHEN 7 THEN CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey % 24 = 0 THEN 'BEST BEFORE 24 months from packing' ELSE 'BEST BEFORE 9 months from packing' END WHEN 1 THEN 'EXP DATE 12/2030' WHEN 2 THEN 'USE BY' ELSE 'no dates here' END
                 WHEN 8 THEN 'Manufactured by: Acme Foods'
                 WHEN 9 THEN CASE p_partkey % 3 WHEN 0 THEN 'Customer care 98765 43210 care@acme.in' WHEN 1 THEN 'for complaints write to us' ELSE 'thank you' END
                 WHEN 10 THEN CASE p_partkey % 4 WHEN 0 THEN concat('FSSAI Lic. 1001', lpad(CAST(p_partkey AS STRING), 10, '0')) WHEN 1 THEN 'fssai' ELSE 'recycle' END
                 WHEN 11 THEN '07/2025' ELSE concat('LX', CAST(p_partkey AS STRING)) END AS text,
               CASE line_no WHEN 11 THEN 330 WHEN 12 THEN 320 ELSE 40 END AS "left",
               CASE line_no WHEN 11 THEN 342 WHEN 12 THEN 402 ELSE 40 + line_no * 60 END AS top,
               CASE line_no WHEN 0 THEN 540 WHEN 1 THEN 340 WHEN 2 THEN 340 WHEN 3 THEN 340 WHEN 4 THEN 340 WHEN 5 THEN 300 WHEN 6 THEN 300 WHEN 7 THEN 300 WHEN 8 THEN 440 WHEN 9 THEN 440 WHEN 10 THEN 440 ELSE 430 END AS "right",
               CASE line_no WHEN 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 70 ELSE 120 END WHEN 11 THEN 368 WHEN 12 THEN 428 ELSE 70 + line_no * 60 END AS bottom
        FROM part CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12)) AS numbers(line_no)
        WHERE line_no < 11 OR (line_no = 11 AND p_partkey % 8 = 1) OR (line_no = 12 AND p_partkey % 6 = 1)""",
    "side_lines": """
        SELECT scan_id, CASE WHEN line_no < 5 THEN 'back' ELSE 'front' END AS side, f AS frame, line_no,
               CASE WHEN line_no = 2 AND scan_id % 7 = 0 AND f = 1 THEN 'MRP Rs. 999/-' WHEN line_no = 1 AND scan_id % 13 = 0 AND f >= 2 THEN 'NET WT: 77 g'
                    WHEN line_no = 8 AND scan_id % 8 = 4 THEN 'a plain line' WHEN line_no = 9 AND scan_id % 17 = 3 THEN 'NET WT: 999 g' ELSE text END AS text,
               "left", top, "right", bottom
        FROM ocr_lines CROSS JOIN (VALUES (0), (1), (2), (3)) AS shots(f)""",
    "side_heights": """
        SELECT p_partkey AS scan_id, 'mrp' AS field, CAST(0.6 AS DOUBLE) + (p_partkey % 3) * CAST(0.4 AS DOUBLE) AS low_mm, CAST(1.4 AS DOUBLE) + (p_partkey % 3) * CAST(0.4 AS DOUBLE) AS high_mm FROM part WHERE p_partkey % 10 < 7""",
    "bursts": """
        SELECT user_id * 100 + day(ts) AS burst_id, event_id AS frame, CASE WHEN event_id % 10 = 0 THEN 0.0 ELSE value END AS variance FROM events""",
    "calibrations": """
        SELECT c_custkey % 400 AS device_id, CAST(0.3 AS DOUBLE) + (c_custkey % 31) * CAST(0.1 AS DOUBLE) AS correction, c_custkey AS calibrated_at, (c_custkey % 20) * CAST(0.5 AS DOUBLE) AS diopters FROM customer""",
    "shots": """
        SELECT p_partkey AS k, p_partkey % 450 AS device_id, (p_partkey % 17) * CAST(0.6 AS DOUBLE) AS diopters, CASE WHEN p_partkey % 2 = 0 THEN 'card, long edge' ELSE 'card, short edge' END AS reference,
               CASE WHEN p_partkey % 2 = 0 THEN CAST(85.6 AS DOUBLE) ELSE CAST(53.98 AS DOUBLE) END AS reference_mm, p_partkey % 40 * 50 AS reference_px, CAST(0.01 AS DOUBLE) * (p_partkey % 13) AS mm_per_px FROM part""",
    "devices": """
        SELECT c_custkey + 1000000 AS id, CAST(c_custkey AS STRING) AS device_id, CASE WHEN c_custkey % 3 = 0 THEN 'INSPECTOR' ELSE 'CONSUMER' END AS role FROM customer WHERE c_custkey % 4 <> 0""",
    "packs": """
        SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d,
               CASE month(o_orderdate) WHEN 1 THEN 'Jan' WHEN 2 THEN 'FEB' WHEN 3 THEN 'March' WHEN 4 THEN 'apr' WHEN 5 THEN 'May' WHEN 6 THEN 'JUNE' WHEN 7 THEN 'Jul' WHEN 8 THEN 'Aug' WHEN 9 THEN 'SEPT' WHEN 10 THEN 'Oct' WHEN 11 THEN 'Nov' ELSE 'Dec' END AS mon
        FROM orders""",
    "pack_dates": """
        SELECT k, concat(CAST(year(d) AS STRING), '-', lpad(CAST(month(d) AS STRING), 2, '0')) AS ym, concat(CAST(month(d) AS STRING), '/', CAST(year(d) AS STRING)) AS my, concat(mon, ' ', CAST(year(d) AS STRING)) AS named,
               concat(CAST(day(d) AS STRING), ' ', mon, ' ', CAST(year(d) AS STRING)) AS dayed, d, CAST(date_trunc('month', d) AS DATE) AS m_first, last_day(d) AS m_last,
               MONTHS(d, 6) AS later, MONTHS(d, -2) AS sooner FROM packs""",
    "declared": """
        SELECT k AS scan_id, field, value, value = '' AS anchor_only, relative, CAST(3 + k % 3 AS DOUBLE) / 5 AS confidence, CAST(3 + k % 3 AS INT) AS agreement, 5 AS frames, t_first, t_last, t_months, t_days FROM (
          SELECT k, 'mrp' AS field, CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('Rs. ', CAST(40 + k % 3 AS STRING)) END AS value, 1 = 0 AS relative, CAST(NULL AS DATE) AS t_first, CAST(NULL AS DATE) AS t_last, CAST(NULL AS INT) AS t_months, CAST(NULL AS INT) AS t_days FROM packs
          UNION ALL SELECT k, 'net_quantity', CASE k % 9 WHEN 0 THEN NULL WHEN 1 THEN '8 g' WHEN 2 THEN '10 ml' WHEN 3 THEN '0.01 kg' WHEN 4 THEN '11 g' WHEN 5 THEN 'ten g' WHEN 6 THEN '0.5 l' WHEN 7 THEN '' ELSE '500 g' END, 1 = 0, NULL, NULL, NULL, NULL FROM packs
          UNION ALL SELECT k, 'consumer_care', CASE WHEN k % 2 = 0 THEN 'Consumer care 98765 43210' END, 1 = 0, NULL, NULL, NULL, NULL FROM packs
          UNION ALL SELECT k, 'tax_inclusive', CASE WHEN k % 3 <> 0 THEN 'incl. of all taxes' END, 1 = 0, NULL, NULL, NULL, NULL FROM packs
          UNION ALL SELECT k, 'batch_number', CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('B', CAST(k AS STRING)) END, 1 = 0, NULL, NULL, NULL, NULL FROM packs
          UNION ALL SELECT k, 'fssai_licence', CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE '10012345678901' END, 1 = 0, NULL, NULL, NULL, NULL FROM packs
          UNION ALL SELECT k, 'manufacturer_address', CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Acme Foods, Indore' END, 1 = 0, NULL, NULL, NULL, NULL FROM packs
          UNION ALL SELECT k, 'brand', CASE WHEN k % 4 <> 0 THEN concat('Brand#', CAST(k % 3 AS STRING)) END, 1 = 0, NULL, NULL, NULL, NULL FROM packs
          UNION ALL SELECT k, 'mfg_date', CASE k % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 3 THEN named WHEN 4 THEN dayed WHEN 5 THEN my WHEN 6 THEN 'no date' ELSE ym END, 1 = 0,
            CASE WHEN k % 8 IN (0, 1, 6) THEN NULL WHEN k % 8 = 4 THEN d ELSE m_first END, CASE WHEN k % 8 IN (0, 1, 6) THEN NULL WHEN k % 8 = 4 THEN d ELSE m_last END, NULL, NULL FROM pack_dates
          UNION ALL SELECT k, 'expiry', CASE k % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ym WHEN 4 THEN concat(CAST(year(sooner) AS STRING), '-', lpad(CAST(month(sooner) AS STRING), 2, '0')) WHEN 5 THEN '9 months from packing' WHEN 6 THEN '2 weeks' WHEN 7 THEN 'soon' WHEN 8 THEN dayed
              ELSE concat(CAST(year(later) AS STRING), '-', lpad(CAST(month(later) AS STRING), 2, '0')) END, k % 10 IN (5, 7),
            CASE WHEN k % 10 IN (0, 1, 5, 6, 7) THEN NULL WHEN k % 10 = 2 THEN m_first WHEN k % 10 = 4 THEN CAST(date_trunc('month', sooner) AS DATE) WHEN k % 10 = 8 THEN d ELSE CAST(date_trunc('month', later) AS DATE) END,
            CASE WHEN k % 10 IN (0, 1, 5, 6, 7) THEN NULL WHEN k % 10 = 2 THEN m_last WHEN k % 10 = 4 THEN last_day(sooner) WHEN k % 10 = 8 THEN d ELSE last_day(later) END,
            CASE k % 10 WHEN 5 THEN 9 WHEN 6 THEN 0 ELSE NULL END, CASE k % 10 WHEN 5 THEN 0 WHEN 6 THEN 14 ELSE NULL END FROM pack_dates) AS fields WHERE value IS NOT NULL""",
    "pack_truth": """
        SELECT k AS scan_id, 'mrp' AS field, CASE k % 7 WHEN 0 THEN CASE WHEN k % 2 = 0 THEN NULL ELSE '41' END WHEN 1 THEN ' ' ELSE concat(CAST(40 + k % 3 + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS STRING), '.00') END AS value FROM packs
        UNION ALL SELECT k, 'net_quantity', CASE k % 9 WHEN 0 THEN '5 g' WHEN 2 THEN '10 ml' WHEN 3 THEN '10 g' WHEN 5 THEN 'ten g' WHEN 6 THEN '500 millilitres' WHEN 7 THEN NULL WHEN 8 THEN '0.5 kg' ELSE '8 gm' END FROM packs
        UNION ALL SELECT k, 'batch_number', CASE k % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'b0' ELSE concat('b', CAST(k AS STRING), ' ') END FROM packs WHERE k % 10 <> 3
        UNION ALL SELECT k, 'brand', concat('BRAND#', CAST(k % 5 AS STRING)) FROM packs WHERE k % 3 <> 1
        UNION ALL SELECT k, 'brand', 'Z last' FROM packs WHERE k % 6 = 0""",
    "pack_registry": """
        SELECT k AS scan_id, CASE WHEN k % 3 = 1 THEN 'IMPORTED' ELSE 'MANUAL' END AS source, CASE WHEN k % 8 = 0 THEN NULL ELSE CAST(40 + k % 2 AS DOUBLE) END AS mrp_exact,
               CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '10 g' WHEN 2 THEN '500 g' WHEN 3 THEN '11 g' ELSE '500 ml' END AS net_quantity, 'brand#0' AS brand1, CASE WHEN k % 2 = 0 THEN 'BRAND#1 ' ELSE NULL END AS brand2 FROM packs WHERE k % 3 <> 0""",
    "pack_roles": """
        SELECT k AS scan_id, CASE k % 4 WHEN 1 THEN 'MANUFACTURER' WHEN 2 THEN 'UNKNOWN' ELSE 'PACKER' END AS role FROM packs WHERE k % 4 <> 0""",
    "pack_heights": """
        SELECT k AS scan_id, 'mrp' AS field, CAST(0.6 AS DOUBLE) + (k % 4) * CAST(0.2 AS DOUBLE) AS low_mm, CAST(0.9 AS DOUBLE) + (k % 4) * CAST(0.2 AS DOUBLE) AS high_mm FROM packs WHERE k % 5 < 3""",
    "pack_scales": """
        SELECT k AS scan_id, 'sensor' AS unavailable FROM packs WHERE k % 5 = 3""",
    "address_lines": """
        SELECT p_partkey AS scan_id, 0 AS frame, line_no,
               CASE line_no WHEN 0 THEN CASE p_partkey % 5 WHEN 0 THEN 'Manufactured by :' WHEN 1 THEN 'Manufactured by: Acme Foods, Indore' WHEN 2 THEN 'MFD BY -' WHEN 3 THEN 'Marketed by Acme Traders' ELSE 'a plain line' END
                 WHEN 1 THEN CASE p_partkey % 3 WHEN 0 THEN concat('Plot ', CAST(p_partkey AS STRING), ', Nehru Road.') WHEN 1 THEN ' - ' ELSE 'Packed by: Blue Packers Ltd' END
                 WHEN 2 THEN CASE p_partkey % 4 WHEN 0 THEN 'Indore 452001' WHEN 1 THEN 'MFG DATE : 06/2025' WHEN 2 THEN '' ELSE 'Manufactured & packed by: Red Works' END
                 WHEN 3 THEN CASE p_partkey % 2 WHEN 0 THEN 'near the bridge' ELSE 'Batch No B1' END
                 ELSE 'Imported by' END AS text,
               40 + line_no AS "left", line_no * 60 AS top, 300 + p_partkey % 9 AS "right", line_no * 60 + 40 AS bottom
        FROM part CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS numbers(line_no)""",
    "optics": """
        SELECT p_partkey AS k, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(5.55 AS DOUBLE) END AS sensor_h_mm, CAST(7.4 AS DOUBLE) AS sensor_w_mm, 4000 AS image_w_px, 3000 AS image_h_px,
               CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(5.4 AS DOUBLE) END AS focal_mm, CASE WHEN p_partkey % 10 = 0 THEN CAST(0 AS DOUBLE) ELSE (p_partkey % 50) * CAST(0.2 AS DOUBLE) END AS diopters,
               p_partkey % 3 AS calibration, CAST(1 AS DOUBLE) + (p_partkey % 5) * CAST(0.05 AS DOUBLE) AS correction, 20 + p_size AS height_px FROM part""",
    "scan_stream": """
        SELECT event_id AS id, user_id AS device_id, event_type, CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'purchase' THEN 'PASS' WHEN 'view' THEN 'NEEDS_REVIEW' ELSE 'NOT_ASSESSABLE' END AS verdict FROM events
        UNION ALL
        SELECT event_id AS id, user_id AS device_id, 'resend' AS event_type, 'NOT_ASSESSABLE' AS verdict FROM events WHERE event_id % 10 = 0""",
}


def _uses(sql: str, names: tuple[str, ...]) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    """One of VIEWS, or a given table, as a DataFrame over sf_dir.

    dealt: tables are dealt by their key, so that all tasks make the many rows of a view out of a small file.
    """
    if name not in VIEWS:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return table.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), table.columns[0]) if dealt else table
    sql = re.sub(r"DAYS\((\w+)\)", r"datediff(CAST(\1 AS DATE), DATE'1970-01-01')", VIEWS[name])
    sql = re.sub(r"MONTHS\((\w+), (-?\d+)\)", r"add_months(\1, \2)", sql).replace('"left"', "`left`").replace('"right"', "`right`")
    parts = {n: view(spark, sf_dir, n, dealt) for n in _uses(sql, (*BASE, *VIEWS)) if n != name and re.search(rf"(FROM|JOIN) {n}\b", sql)}
    for n in parts:
        sql = re.sub(rf"(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **parts)


def with_views(sql: str) -> str:
    """The SQL with the views it names put before it, for DuckDB."""
    needed: list[str] = []

    def add(text: str) -> None:
        for n in VIEWS:
            if n not in needed and re.search(rf"(FROM|JOIN) {n}\b", text):
                add(VIEWS[n])
                needed.append(n)

    add(sql)
    days = lambda text: re.sub(r"DAYS\((\w+)\)", r"date_diff('day', DATE '1970-01-01', CAST(\1 AS DATE))", text)
    fixed = {n: re.sub(r"MONTHS\((\w+), (-?\d+)\)", r"CAST(\1 + to_months(\2) AS DATE)", days(VIEWS[n])) for n in needed}
    ctes = ",\n".join(f"{n} AS ({fixed[n]})" for n in needed)
    body = sql.strip()
    if not ctes:
        return body
    return f"WITH {ctes},\n{body[5:]}" if body.startswith("WITH ") else f"WITH {ctes}\n{body}"
