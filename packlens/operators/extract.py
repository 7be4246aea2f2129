"""Declared fields out of recognised lines: one pass of candidates, one aggregate per frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlens.functions.once import once

# Captions and patterns as packs print them.
CARE_ANCHORS = ("consumer care", "customer care", "consumer complaints", "for complaints", "उपभोक्ता शिकायत", "ग्राहक सेवा")
MFG_ANCHORS = ("mfg. date", "mfg date", "mfg.date", "manufacture date", "date of manufacture", "date of packing", "packed on", "pkd on", "pkd", "निर्माण तिथि", "पैकिंग तिथि", "पैक करने की तिथि")
BATCH_ANCHORS = ("batch no", "batch number", "batch", "lot no", "lot number", "b. no", "b.no", "code no", "बैच", "बैच सं")
EXPIRY_ANCHORS = ("use by", "used by", "best before", "expiry", "exp. date", "exp date", "उपयोग की तिथि", "सर्वोत्तम")
ROLES = {
    "MANUFACTURER": ("manufactured by", "manufactured & packed by", "manufactured and packed by", "mfd by", "mfd. by", "mfg by", "mfg. by", "manufacturer", "निर्माता", "निर्मित द्वारा", "द्वारा निर्मित"),
    "PACKER": ("packed by", "packaged by", "repacked by", "packer", "पैक किया गया", "पैकर", "द्वारा पैक"),
    "IMPORTER": ("imported by", "importer", "आयातकर्ता", "द्वारा आयातित"),
    "MARKETER": ("marketed by", "marketer", "sold by", "विपणक", "द्वारा विपणित"),
}
PHONE = r"(?:\+91[\s-]?)?(?:\d[\s-]?){10,13}"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"
PRICE_LINE = r"(?i)(?:mrp|m\.r\.p|rs\.?|₹|inr|अधिकतम\s*खुदरा\s*मूल्य)"
PRICE_LINE_STRICT = r"(?i)(?:\bmrp\b|m\.r\.p|\brs\b\.?|₹|\binr\b|अधिकतम\s*खुदरा\s*मूल्य)"
PRICE = r"(?i)(?:₹|rs\.?|inr)?\s*(\d+(?:\.\d{1,2})?)"
QUANTITY = r"(?i)\d+(?:[.,]\d+)?\s*(?:g|gm|gms|gram|grams|kg|kgs|mg|ml|l|ltr|litre|litres|liter)\b"
QUANTITY_LINE = r"(?i)(?:net\s*(?:qty|quantity|wt|weight)|शुद्ध\s*वजन|मात्रा)"
DATE = r"(?i)\d{1,2}\s*[/.\-]\s*\d{1,2}\s*[/.\-]\s*\d{2,4}|\d{1,2}\s*[/.\-]\s*\d{2,4}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s*[.\-/ ]?\s*\d{2,4}"
BATCH = r"(?i)\b(?=[A-Z0-9\-/]*\d)[A-Z0-9][A-Z0-9\-/]{1,19}\b"
DIGIT_RUN = r"\d[\d\s\-]{8,26}\d"
LICENCE_LINE = r"(?i)fssai|\blic\b\.?|licence\s*no|license\s*no"
LICENCE_DIGITS = 14
TAX = r"(?i)incl.{0,20}?tax|all\s*tax|सभी\s*करों\s*सहित"
CAPTIONISH = r"(?i)(?:mrp|price|weight|qty|quantity|batch|mfg|date|use by|best before|fssai|lic|care|customer|consumer|net|incl|tax|packed|marketed|निर्माता|पैक|मूल्य|वजन)"
RESIDUE = r"(?i)^(?:[ :\-.–—]*(?:no|n0|nos|number|num|lot|code|sr|s\.?no)\b\.?)*[ :\-.–—]*"

FRAME = ("scan_id", "frame")
SIDES = ("left", "top", "right", "bottom")
CAPTIONED = {"mfg_date": (MFG_ANCHORS, DATE, False), "batch_number": (BATCH_ANCHORS, BATCH, False), "expiry": (EXPIRY_ANCHORS, DATE, True)}


def strip_residue(c: Column) -> Column:
    """The text after a caption without separators and stranded caption words."""
    return F.regexp_replace(F.regexp_replace(c, RESIDUE, ""), r"[ :\-.–—]+$", "")


def _after(text: Column, anchors: tuple[str, ...]) -> Column:
    """What follows the longest anchor that the text holds; null where it holds none."""
    low = F.lower(text)
    longest = F.get(F.filter(F.array(*[F.lit(a) for a in sorted(anchors, key=lambda a: (-len(a), a))]), lambda a: F.contains(low, a)), F.lit(0))
    # most lines hold none, and are not searched anchor by anchor
    return F.when(_has(text, anchors), F.substring(text, F.position(longest, low) + F.length(longest), F.length(text)))


def _has(text: Column, anchors: tuple[str, ...]) -> Column:
    # one run over the text, which is put in lower case once
    return F.regexp_like(F.lower(text), F.lit("|".join(rf"\Q{a}\E" for a in anchors)))


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))


def line_candidates(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Every per-line candidate in one projection."""
    t = F.col("text")
    price = F.when(F.regexp_like(t, F.lit(PRICE_LINE_STRICT if strict else PRICE_LINE)), _found(t, PRICE, 1))
    quantity = _found(t, QUANTITY)
    licence = F.get(F.filter(F.transform(F.regexp_extract_all(t, F.lit(DIGIT_RUN), F.lit(0)), lambda r: F.regexp_replace(r, r"\D", "")), lambda r: F.length(r) == LICENCE_DIGITS), F.lit(0))
    licence = F.when(F.regexp_like(t, F.lit(DIGIT_RUN)), licence)
    care = _has(t, CARE_ANCHORS)
    added = {
        "c_mrp": price,
        "c_quantity": quantity,
        "c_anchored": quantity.isNotNull() & F.regexp_like(t, F.lit(QUANTITY_LINE)),
        "c_licence": licence,
        "c_licence_caption": F.regexp_like(t, F.lit(LICENCE_LINE)),
        "c_tax": F.regexp_like(t, F.lit(TAX)),
        "c_care": F.when(care, F.trim(t)),
        "c_phone": F.when(care, _found(t, PHONE)),
        "c_email": F.when(care, _found(t, EMAIL)),
    }
    for field, (anchors, _, _) in CAPTIONED.items():
        added[f"c_{field}_rest"] = strip_residue(_after(t, anchors))
    read = once(lines, added)
    return once(read, {f"c_{field}": _found(F.col(f"c_{field}_rest"), value) for field, (_, value, _) in CAPTIONED.items()})


def _first(value: Column, order: Column, where: Column) -> Column:
    """The value of the first line, in `order`, that meets the condition."""
    return F.min_by(F.when(where, value), F.when(where, order))


def frame_fields(lines: DataFrame, strict: bool = False) -> DataFrame:
    """One row per (scan_id, frame): the fields that need only the line itself or the joined text.

    Lines are dealt by frame as they are, and read where they are gathered: however few files hold them, each task sorts a bounded share.
    """
    c, n = line_candidates(lines.repartition(*FRAME), strict), F.col("line_no")
    joined = F.array_join(F.sort_array(F.collect_list(F.struct("line_no", "text")))["text"], " ")
    aggs = [
        _first(F.col("c_mrp"), n, F.col("c_mrp").isNotNull()).alias("mrp"),
        _first(F.col("c_quantity"), F.when(F.col("c_anchored"), n).otherwise(n + 1_000_000), F.col("c_quantity").isNotNull()).alias("net_quantity"),
        _first(F.col("c_licence"), n, F.col("c_licence").isNotNull()).alias("licence_number"),
        F.max("c_licence_caption").alias("licence_caption"),
        _first(F.trim("text"), n, F.col("c_tax")).alias("tax_line"),
        joined.alias("joined"),
        *[_first(F.trim("text"), n, F.contains(F.lower(F.col("text")), F.lit(w))).alias(f"tax_{w}") for w in ("incl", "tax")],
        _first(F.trim("text"), n, F.regexp_like(F.col("text"), F.lit(PRICE_LINE))).alias("tax_price"),
        _first(F.struct("c_care", "c_phone", "c_email"), n, F.col("c_care").isNotNull()).alias("care"),
    ]
    for f, (_, _, relative) in CAPTIONED.items():
        rest, value = F.col(f"c_{f}_rest"), F.col(f"c_{f}")
        usable = value.isNotNull() | (F.trim(rest) != "" if relative else F.lit(False))
        aggs += [
            _first(F.struct(F.coalesce(value, F.trim(rest)).alias("value"), value.isNull().alias("relative")), n, F.coalesce(usable, F.lit(False))).alias(f),
            F.min(F.when(rest.isNotNull() & ~F.coalesce(usable, F.lit(False)), n)).alias(f"{f}_blank")]
    out = c.groupBy(*FRAME).agg(*aggs)
    tax = F.coalesce("tax_line", F.when(F.regexp_like("joined", F.lit(TAX)), F.coalesce("tax_incl", "tax_tax", "tax_price")))
    return out.withColumn("tax_inclusive", tax).drop("tax_line", "tax_incl", "tax_tax", "tax_price", "joined")


def caption_pairs(lines: DataFrame, blanks: DataFrame) -> DataFrame:
    """The nearest line right of each blank caption in its row: scan_id, frame, field, text.

    `blanks`: scan_id, frame, field, line_no. Lines meet within their frame only (tens of lines).
    A value's row centre is within half a line, it starts where the caption ends or at most a caption's width on, and it is no caption.
    """
    caption = blanks.join(lines, [*FRAME, "line_no"]).select(*FRAME, "field", F.col("line_no").alias("c_no"), *[F.col(x).alias(f"c_{x}") for x in ("left", "top", "right", "bottom")])
    other = lines.where(~_has(F.col("text"), CARE_ANCHORS + MFG_ANCHORS + BATCH_ANCHORS + EXPIRY_ANCHORS))
    height = F.col("c_bottom") - F.col("c_top")
    beside = (
        (F.col("line_no") != F.col("c_no")) & (height > 0)
        & (F.abs((F.col("top") + F.col("bottom")) / 2 - (F.col("c_top") + F.col("c_bottom")) / 2) <= height * 0.5)
        & (F.col("left") >= F.col("c_right") - height) & (F.col("left") - F.col("c_right") <= F.col("c_right") - F.col("c_left")))
    near = Window.partitionBy(*FRAME, "field").orderBy("left", "line_no")
    return other.join(caption, list(FRAME)).where(beside).withColumn("r", F.row_number().over(near)).where("r = 1").select(*FRAME, "field", "text")


def extract(lines: DataFrame, strict: bool = False, keep: Callable[[DataFrame], DataFrame] = lambda fields: fields) -> DataFrame:
    """Long table of the fields found: scan_id, frame, field, value, anchor_only, relative; an absent field has no row.

    keep: may write the frames' fields, which are read twice, for the captions without a value too.
    """
    fields = keep(frame_fields(lines, strict))
    none = F.lit(False)
    entry = lambda name, value, anchor_only=none, relative=none: F.struct(F.lit(name).alias("field"), value.alias("value"), anchor_only.alias("anchor_only"), relative.alias("relative"))
    licence = F.when(F.col("licence_number").isNotNull(), F.col("licence_number")).when(F.col("licence_caption"), "")
    simple = F.array(
        entry("mrp", F.col("mrp")), entry("net_quantity", F.col("net_quantity")), entry("tax_inclusive", F.col("tax_inclusive")),
        entry("fssai_licence", licence, F.col("licence_number").isNull()), entry("consumer_care", F.col("care.c_care")),
        *[entry(f, F.col(f"{f}.value"), none, F.col(f"{f}.relative")) for f in CAPTIONED])
    found = fields.select(*FRAME, F.explode(simple).alias("e")).select(*FRAME, "e.*").where("value is not null")
    blank = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.when(F.col(f).isNull(), F.col(f"{f}_blank")).alias("line_no")) for f in CAPTIONED]))
    blanks = fields.select(*FRAME, blank.alias("b")).select(*FRAME, "b.field", "b.line_no").where("line_no is not null")
    pairs = caption_pairs(lines, blanks)
    pattern = lambda f: _found(strip_residue(F.col("text")), CAPTIONED[f][1])
    value = F.when(F.col("field") == "batch_number", pattern("batch_number")).otherwise(pattern("mfg_date"))
    read = blanks.join(pairs, [*FRAME, "field"], "left").select(*FRAME, "field", value.alias("v"))
    captioned = read.select(*FRAME, "field", F.coalesce("v", F.lit("")).alias("value"), F.col("v").isNull().alias("anchor_only"), none.alias("relative"))
    return found.unionByName(captioned)


#: An address has so many characters at least, and runs to so many lines under its caption.
MIN_BODY, CONTINUED_LINES = 6, 3
SEPARATORS = " :-.–—"


def tag_addresses(lines: DataFrame) -> DataFrame:
    """Every line with its role by the longest caption over all roles: FRAME, line_no, role, body, lines (how many the address runs to).

    A line without a role's caption is UNKNOWN with its whole text. A caption without an address of MIN_BODY characters goes on
    with up to CONTINUED_LINES lines below, blank ones skipped, and stops at the next caption of any kind; the box is that of all its lines.
    """
    anchors = sorted(((a, role) for role, names in ROLES.items() for a in names), key=lambda x: len(x[0]))
    low, role = F.lower(F.col("text")), F.lit(None).cast("string")
    for a, r in anchors:
        role = F.when(F.contains(low, F.lit(a)), r).otherwise(role)
    body = F.trim(_after(F.col("text"), tuple(a for a, _ in anchors)), F.lit(SEPARATORS))
    caption = role.isNotNull() | _has(F.col("text"), CARE_ANCHORS + MFG_ANCHORS + BATCH_ANCHORS + EXPIRY_ANCHORS)
    own = lines.select(*FRAME, "line_no", "text", *SIDES, role.alias("role"), body.alias("head"), caption.alias("caption"))
    # the few lines below, as a list; frames have tens of lines
    below = Window.partitionBy(*FRAME).orderBy("line_no").rowsBetween(1, CONTINUED_LINES)
    own = own.withColumn("below", F.collect_list(F.struct("caption", F.trim("text", F.lit(SEPARATORS)).alias("text"), *SIDES)).over(below))
    alone = F.col("role").isNotNull() & (F.length("head") < MIN_BODY)
    stop = F.array_position(F.transform("below", lambda x: x["caption"]), True)
    taken = F.filter(F.when(stop > 0, F.slice("below", F.lit(1), (stop - 1).cast("int"))).otherwise(F.col("below")), lambda x: x["text"] != "")
    own = own.withColumn("taken", F.when(alone, taken).otherwise(F.slice("below", 1, 0)))
    under = F.array_join(F.transform("taken", lambda x: x["text"]), ", ")
    reach = lambda side, best: best(F.concat(F.array(F.col(side)), F.transform("taken", lambda x: x[side]))).alias(side)
    return own.select(
        *FRAME, "line_no", F.coalesce("role", F.lit("UNKNOWN")).alias("role"),
        F.when(F.col("role").isNull(), F.trim("text")).when(alone, under).otherwise(F.col("head")).alias("body"), (F.size("taken") + 1).alias("lines"),
        reach("left", F.array_min), reach("top", F.array_min), reach("right", F.array_max), reach("bottom", F.array_max))


def address_roles(tagged: DataFrame) -> DataFrame:
    """Addresses by scan and role, in the order of their lines, joined by ' | '; a caption without an address is none."""
    rows = tagged.where(F.trim("body") != "")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("frame", "line_no", "body"))), lambda x: x["body"])
    return rows.groupBy("scan_id", "role").agg(F.count(F.lit(1)).alias("n"), F.array_join(listed, " | ").alias("addresses"))


def word_box(lines: DataFrame, value: str = "value") -> DataFrame:
    """`lines` (text, box, elements) with value_box: the box of the first word that holds the value, else the line's."""
    first = F.get(F.filter("elements", lambda e: F.contains(e["text"], F.col(value))), F.lit(0))
    return lines.withColumn("value_box", F.coalesce(first["box"], F.col("box")))


def box_union(lines: DataFrame) -> DataFrame:
    """The box around all lines of a frame."""
    return lines.groupBy(*FRAME).agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))


def fullest_frame(lines: DataFrame) -> DataFrame:
    """scan_id, frame, lines, raw_lines of the frame with the most lines, the first of equals."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    frames = lines.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("lines"), listed.alias("raw_lines"))
    best = frames.groupBy("scan_id").agg(F.max(F.struct("lines", (-F.col("frame")).alias("f"), "frame", "raw_lines")).alias("b"))
    return best.select("scan_id", "b.frame", "b.lines", "b.raw_lines")


def brand_prominence(lines: DataFrame) -> DataFrame:
    """Per frame the tallest line that is no caption, quantity or number, if 1.3 times the median height."""
    text, height = F.trim("text"), F.col("bottom") - F.col("top")
    plain = (F.length(text) >= 2) & (height > 0) & ~F.contains(text, F.lit(":")) & ~F.regexp_like(text, F.lit(CAPTIONISH)) & ~F.regexp_like(text, F.lit(r"\d"))
    rows = lines.where(plain).select(*FRAME, "line_no", text.alias("text"), height.alias("h"))
    g = rows.groupBy(*FRAME).agg(F.max_by("text", F.struct("h", -F.col("line_no"))).alias("brand"), F.max("h").alias("tallest"), F.array_sort(F.collect_list("h")).alias("hs"))
    return g.where(F.col("tallest") >= F.get("hs", F.floor(F.size("hs") / 2).cast("int")) * 1.3).select(*FRAME, "brand")
