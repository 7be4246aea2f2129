"""Scans matched to the product registry, without pairing every scan with every product.

Both scorers work out what a pair must agree in to reach the threshold, given what either side lacks. Each such case is a
key; a side emits the keys of the cases that it can take part in, and the sides meet in one equi-join on the key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlens.functions.normalize import nfkc, nfkc_all, norm_money, norm_quantity, norm_text, server_money, server_quantity, server_text, values_equal
from packlens.sources.folders import written

WEIGHTED_THRESHOLD, IDENTITY_THRESHOLD = 0.75, 0.72


def _brands(df: DataFrame) -> Column:
    """The brand strings of a registry: an array column of that name, or else the one brand."""
    return F.col("brand_strings") if "brand_strings" in df.columns else F.array("brand")


def _key(case: str, *parts: str | Column) -> Column:
    """The key of a case; null where a part is."""
    return F.concat(F.lit(case), *[x for p in parts for x in (F.lit("\x1f"), F.col(p) if isinstance(p, str) else p)])


def _keyed(df: DataFrame, keys: list[Column]) -> DataFrame:
    return df.select("*", F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())).alias("key"))


def _none(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNull() for c in columns])


def _comparable(df: DataFrame, brand: str, present, unread: str) -> DataFrame:
    """b, q, l: brand, quantity and licence to compare, null where there is none. Each distinct text is normalised once.

    A quantity that is there but cannot be read is compared and equals nothing: `unread`, another mark on each side, stands for it.
    """
    entry = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("text"))
    texts = df.select(F.explode(F.array(entry("b", brand), entry("q", "net_quantity"))).alias("t")).select("t.*").where("text is not null").distinct()
    q = norm_quantity(F.col("text"))
    normal = F.when(F.col("kind") == "b", norm_text(F.col("text"))).when(q.isNotNull(), F.concat_ws(" ", q["magnitude"].cast("string"), q["unit"]))
    # written, so that Spark knows how small it is before it plans the joins
    read = written(texts.withColumn("normal", normal), "match-texts")
    of = lambda kind: read.where(F.col("kind") == kind).select(F.col("text").alias(f"__{kind}"), F.col("normal").alias(f"__{kind}n"))
    joined = df.join(of("b"), F.col(brand) == F.col("__b"), "left").join(of("q"), F.col("net_quantity") == F.col("__q"), "left")
    return (
        joined.withColumn("b", F.when(present(F.col(brand)), F.col("__bn")))
        .withColumn("q", F.when(present(F.col("net_quantity")), F.coalesce("__qn", F.lit(unread))))
        .withColumn("l", F.when(present(F.col("licence")), F.regexp_replace("licence", "[^0-9]", ""))))


def _said(c: Column) -> Column:
    """Whether a pack says something: a blank declares nothing."""
    return F.trim(F.coalesce(c, F.lit(""))) != ""


def _weighted_asked(scans: DataFrame) -> DataFrame:
    return _comparable(scans, "brand", _said, "?scan").select("id", "b", "q", "l")


def _weighted_known(registry: DataFrame) -> DataFrame:
    r = registry.select("sku_id", "net_quantity", "licence", F.explode_outer(_brands(registry)).alias("one"))
    return _comparable(r, "one", Column.isNotNull, "?sku").select("sku_id", "b", "q", "l").distinct()


def _licensed(own: list[Column]) -> list[Column]:
    """The keys of some cases, and each with the licence behind it, by which those meet whose licences are equal too."""
    return [*own, *[_key("h", k, "l") for k in own]]


def _weighted_keys(signatures: DataFrame, words: DataFrame | None) -> DataFrame:
    lone = F.concat(F.when(F.col("b").isNull(), "-").otherwise("b"), F.when(F.col("q").isNull(), "-").otherwise("q"))
    own = [_key("bq", "b", "q"), F.when(_none("q"), _key("b", "b")), F.when(~_none("q"), _key("b0", "b")), F.when(_none("b"), _key("q", "q")), F.when(~_none("b"), _key("q0", "q"))]
    return _keyed(signatures, [*_licensed(own), _key("l", lone, "l")])


def _weighted_product_keys(known: DataFrame, words: DataFrame | None) -> DataFrame:
    own = [_key("bq", "b", "q"), _key("b", "b"), F.when(_none("q"), _key("b0", "b")), _key("q", "q"), F.when(_none("b"), _key("q0", "q"))]
    return _keyed(known, [
        *_licensed(own), _key("l", F.lit("--"), "l"),
        F.when(_none("b"), _key("l", F.lit("b-"), "l")), F.when(_none("q"), _key("l", F.lit("-q"), "l")), F.when(_none("b", "q"), _key("l", F.lit("bq"), "l"))])


def _weighted_condensed(products: DataFrame) -> DataFrame:
    """A row a key, however many licences share it: its products, and of them those without a licence (`bare`)."""
    each = products.groupBy("key", "sku_id").agg((F.count_if(F.col("l").isNull()) > 0).alias("bare"))
    bare = F.when(F.col("bare"), F.col("sku_id"))
    return each.groupBy("key").agg(F.min("sku_id").alias("sku"), F.count(F.lit(1)).alias("n"), F.min(bare).alias("bare_sku"), F.count(bare).alias("bare_n"))


def _weighted_best(pairs: DataFrame) -> DataFrame:
    """What a key's products score: 1 if nothing differs, 0.8 if only the licence does. The latter also counts equal licences, which the key with the licence finds at 1."""
    base = F.when(F.startswith("key", F.lit("bq")), 4).otherwise(2)
    equal = F.col("l").isNull() | F.startswith("key", F.lit("h")) | F.startswith("key", F.lit("l"))
    case = lambda when, score, sku, n: F.when(when & (F.col(n) > 0), F.struct(score.cast("double").alias("score"), F.col(sku).alias("sku"), F.col(n).alias("n")))
    cases = F.array(case(equal, F.lit(1.0), "sku", "n"), case(~equal, F.lit(1.0), "bare_sku", "bare_n"), case(~equal & (F.col("bare_n") == 0), base / (base + 1), "sku", "n"))
    scored = pairs.select("b", "q", "l", F.explode(F.filter(cases, lambda c: c["score"] >= WEIGHTED_THRESHOLD)).alias("c")).select("b", "q", "l", "c.*")
    best = scored.groupBy("b", "q", "l", "score").agg(F.min("sku").alias("sku"), F.sum("n").alias("candidates"))
    return best.groupBy("b", "q", "l").agg(F.max(F.struct("score", "sku", "candidates")).alias("t")).select("b", "q", "l", "t.score", "t.sku", "t.candidates")


def _weighted_told(found: DataFrame, some: DataFrame) -> DataFrame:
    alone = F.coalesce(F.col("candidates") == 1, F.lit(False))
    return found.select("id", F.when(alone, F.col("sku")).alias("sku"), F.when(alone, F.col("score")).otherwise(0.0).alias("score"), F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"))


def match_weighted(scans: DataFrame, registry: DataFrame) -> DataFrame:
    """Per scan: sku, score, candidates; weights brand 2, quantity 2, licence 1 of what both sides have, readable or not.

    A score of 0.75 needs every comparable one of brand and quantity to agree, and the licence too where only
    one of them is comparable; a licence alone decides where neither is. In each case the score depends besides the key only on whether
    licences are equal, differ or lack, so products are counted per key, with and without the licence in it, before they meet scans, and a
    signature meets a row a key. Scans are reduced to distinct signatures. A tie for the best is no match. Of several brand strings any may agree.
    """
    return _matched(WEIGHTED, scans, registry)


def _words(c: Column) -> Column:
    return F.filter(F.array_distinct(F.split(c, " ")), lambda t: t != "")


def _word_counts(known: DataFrame) -> DataFrame:
    """In how many distinct brands a word stands: word, k."""
    return known.select("b").where("b is not null").distinct().select(F.explode(_words(F.col("b"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("k"))


def _rare_words(signatures: DataFrame, counts: DataFrame) -> DataFrame:
    """`signatures` with `rare`: of each brand's words the rarest, as many as any brand of Jaccard 0.72 must share one of.

    Two sets of that similarity share a word among the n - ceil(0.72 n) + 1 first ones in any common order; the order is by `counts`, how many
    known brands hold a word, a word that is not in it first. Brands are reduced to distinct strings first.
    """
    brands = signatures.select("b").where("b is not null").distinct().select("b", F.explode(_words(F.col("b"))).alias("word"))
    ordered = brands.join(counts, "word", "left").groupBy("b").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("k", F.lit(0)).alias("k"), "word"))).alias("ws"))
    n = F.size("ws")
    first = ordered.select(F.col("b").alias("of"), F.transform(F.slice("ws", F.lit(1), (n - F.ceil(F.lit(IDENTITY_THRESHOLD) * n) + 1).cast("int")), lambda x: x["word"]).alias("rare"))
    return signatures.join(first, F.col("b") == F.col("of"), "left").drop("of")


def _identity_asked(scans: DataFrame) -> DataFrame:
    return scans.select("id", *_identity(F.col("brand")))


def _identity_known(registry: DataFrame) -> DataFrame:
    return registry.select("sku_id", "mrp", "net_quantity", F.explode_outer(_brands(registry)).alias("one")).select("sku_id", *_identity(F.col("one"))).distinct()


def _identity_keys(signatures: DataFrame, words: DataFrame | None) -> DataFrame:
    lacking = F.concat(F.when(F.col("p").isNull(), "-").otherwise("p"), F.when(F.col("q").isNull(), "-").otherwise("q"))
    own = [_key("pq", "p", "q"), F.when(_none("q"), _key("p", "p")), F.when(~_none("q"), _key("p0", "p")), F.when(_none("p"), _key("q", "q")), F.when(~_none("p"), _key("q0", "q"))]
    return _met(_rare_words(signatures, words), F.array(*own), _word_keys(lacking))


def _identity_product_keys(known: DataFrame, words: DataFrame | None) -> DataFrame:
    own = [_key("pq", "p", "q"), _key("p", "p"), F.when(_none("q"), _key("p0", "p")), _key("q", "q"), F.when(_none("p"), _key("q0", "q"))]
    named = [_word_keys(F.lit("--")), _word_keys(F.lit("p-"), _none("p")), _word_keys(F.lit("-q"), _none("q")), _word_keys(F.lit("pq"), _none("p", "q"))]
    return _met(_rare_words(known, words), F.array(*own), *named)


def _word_keys(case: Column, when: Column | None = None) -> Column:
    return F.transform(F.coalesce("rare", F.array().cast("array<string>")), lambda w: _key("b", case if when is None else F.when(when, case), w))


def _met(df: DataFrame, *keys: Column) -> DataFrame:
    return df.select("*", F.explode(F.filter(F.concat(*keys), lambda k: k.isNotNull())).alias("key")).drop("rare")


def _identity_condensed(products: DataFrame) -> DataFrame:
    return products.groupBy("key", *[F.col(c).alias(f"r{c}") for c in "bpq"]).agg(F.min("sku_id").alias("sku"))


def _identity_best(pairs: DataFrame) -> DataFrame:
    shared = F.size(F.array_intersect(_words(F.col("b")), _words(F.col("rb")))) / F.size(F.array_union(_words(F.col("b")), _words(F.col("rb"))))
    part = lambda c, value: F.when(F.col(c).isNotNull() & F.col(f"r{c}").isNotNull(), value)
    equal = lambda c: part(c, (F.col(c) == F.col(f"r{c}")).cast("double"))
    scored = pairs.select("b", "p", "q", "sku", part("b", shared).alias("brand_score"), equal("p").alias("mrp_score"), equal("q").alias("quantity_score"))
    parts = [F.col(c) for c in ("brand_score", "mrp_score", "quantity_score")]
    score = F.round(sum((F.coalesce(c, F.lit(0.0)) for c in parts), F.lit(0.0)) / sum((c.isNotNull().cast("int") for c in parts), F.lit(0)), 6)
    kept = scored.withColumn("score", score).where(F.col("score") >= IDENTITY_THRESHOLD)
    best = kept.groupBy("b", "p", "q").agg(F.min(F.struct((-F.col("score")).alias("least"), "sku", "score", *parts)).alias("t"))
    return best.select("b", "p", "q", *[F.col(f"t.{c}") for c in ("score", "sku", "brand_score", "mrp_score", "quantity_score")])


def _identity_told(found: DataFrame, some: DataFrame) -> DataFrame:
    status = F.when(F.col("sku").isNotNull(), "MATCHED").when(F.col("some"), "REJECTED").otherwise("NO_CANDIDATE")
    return found.crossJoin(F.broadcast(some)).select("id", status.alias("status"), "sku", "score", "brand_score", "mrp_score", "quantity_score")  # one row


def match_identity(scans: DataFrame, registry: DataFrame) -> DataFrame:
    """Per scan: status, sku, score, and per field what it added (null where it was not compared).

    The score is the mean of brand Jaccard (of the best brand string), price and quantity equality over what both sides have. Of 0.72, three parts
    need price and quantity to agree, two need the one of them that is compared, and one needs itself: prices and quantities make the keys, and
    brands only where neither is compared, through their rare words. Scans and products are reduced to distinct signatures. The best score
    wins, then the smallest sku. Below the threshold the status is REJECTED; an empty registry gives NO_CANDIDATE.
    """
    return _matched(IDENTITY, scans, registry)


def _identity(brand: Column) -> list[Column]:
    """b, p, q in the server's normal forms, null where there is nothing to compare."""
    filled = lambda c: F.nullif(c, F.lit(""))
    # the price is read as the pack prints it: its number, else its text
    price = F.coalesce(norm_money(F.col("mrp").cast("string")).cast("string"), F.col("mrp").cast("string"))
    return [filled(server_text(brand)).alias("b"), filled(server_money(price)).alias("p"), filled(server_quantity(F.col("net_quantity"))).alias("q")]


@dataclass(frozen=True)
class Scorer:
    """A way to match by keys. said: the columns of a scan that are read; signature: what of a scan decides; product: what of a product does; result: what is found for a signature.

    keys, product_keys: (rows, word counts) to the rows with each `key` they meet by; condensed: products that a signature need not tell apart as one; best: joined
    signatures and products to the best of each signature; told: (scans with the best, whether there are products) to the rows that are returned.
    """

    said: tuple[str, ...]
    signature: tuple[str, ...]
    product: tuple[str, ...]
    result: str
    asked: Callable[[DataFrame], DataFrame]
    known: Callable[[DataFrame], DataFrame]
    keys: Callable[[DataFrame, DataFrame | None], DataFrame]
    product_keys: Callable[[DataFrame, DataFrame | None], DataFrame]
    condensed: Callable[[DataFrame], DataFrame]
    best: Callable[[DataFrame], DataFrame]
    told: Callable[[DataFrame, DataFrame], DataFrame]
    words: Callable[[DataFrame], DataFrame] | None = None


WEIGHTED = Scorer(
    ("brand", "net_quantity", "licence"), ("b", "q", "l"), ("b", "q", "l"), "score double, sku string, candidates long", _weighted_asked, _weighted_known, _weighted_keys, _weighted_product_keys,
    _weighted_condensed, _weighted_best, _weighted_told)
IDENTITY = Scorer(
    ("brand", "mrp", "net_quantity"), ("b", "p", "q"), ("b", "p", "q"), "score double, sku string, brand_score double, mrp_score double, quantity_score double", _identity_asked, _identity_known, _identity_keys,
    _identity_product_keys, _identity_condensed, _identity_best, _identity_told, _word_counts)


def _matched(scorer: Scorer, scans: DataFrame, registry: DataFrame) -> DataFrame:
    # a scan is read for its texts, for its signature and for its row
    asked, known = scorer.asked(written(scans.select("id", *scorer.said), "match-scans")), scorer.known(registry)
    words = scorer.words(known) if scorer.words else None
    pairs = scorer.keys(asked.select(*scorer.signature).distinct(), words).join(scorer.condensed(scorer.product_keys(known, words)), "key")
    return with_best(scorer, asked, scorer.best(pairs), registry)


def with_best(scorer: Scorer, asked: DataFrame, best: DataFrame, registry: DataFrame) -> DataFrame:
    """The scans' rows out of what was found for their signatures."""
    found = best.withColumnsRenamed({c: f"m_{c}" for c in scorer.signature})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in scorer.signature])
    return scorer.told(asked.join(found, same, "left"), registry.agg((F.count(F.lit(1)) > 0).alias("some")))


def registry_merge(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Per sku the remote row if the local is absent, not newer, or the remote is imported; else the local."""
    a, b = local.alias("a"), remote.alias("b")
    take = F.col("a.sku_id").isNull() | F.coalesce((F.col("b.saved_at") >= F.col("a.saved_at")) | (F.col("b.source") == "IMPORTED"), F.lit(False))
    pick = lambda c: F.when(take, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return a.join(b, F.col("a.sku_id") == F.col("b.sku_id"), "full_outer").select(*[pick(c) for c in ("sku_id", "brand", "mrp", "net_quantity", "source", "saved_at")])


def registry_upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The newest row of each sku; of equally new ones the incoming."""
    columns = ["sku_id", "brand", "mrp", "net_quantity", "source", "saved_at"]
    rows = current.select(*columns, F.lit(0).alias("new")).unionByName(incoming.select(*columns, F.lit(1).alias("new")))
    order = Window.partitionBy("sku_id").orderBy(F.desc("saved_at"), F.desc("new"))
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").select(*columns)


#: Where a registry's row can come from; anything else counts as enrolled from a scan.
SOURCES = ("IMPORTED", "MANUAL", "ENROLLED_FROM_SCAN")


def known_source(source: Column) -> Column:
    return F.when(F.coalesce(source.isin(*SOURCES), F.lit(False)), source).otherwise("ENROLLED_FROM_SCAN")


def authority(source: Column) -> Column:
    """Only an imported product master settles who is wrong; what was read off a pack asserts."""
    return F.when(known_source(source) == "IMPORTED", "AUTHORITATIVE").otherwise("ASSERTED")


def sku_list(registry: DataFrame) -> DataFrame:
    return registry.orderBy("sku_id")


def registry_compare(scans: DataFrame, registry: DataFrame) -> DataFrame:
    """Scans with a sku against what is registered: id, field, status of price, quantity and brand, any of several brand strings.

    NOT_ASSESSABLE without a value on either side; a mismatch fails against an authoritative row and is for review otherwise.
    """
    r = registry.select("sku_id", F.col("mrp").cast("string").alias("r_mrp"), F.col("net_quantity").alias("r_quantity"), _brands(registry).alias("r_brands"), "source")
    joined = scans.join(r, "sku_id", "left")
    sound = lambda values: F.filter(values, lambda v: v.isNotNull())
    entry = lambda field, seen, values: F.struct(F.lit(field).alias("field"), F.col(seen).alias("seen"), sound(values).alias("values"))
    entries = F.array(entry("mrp", "mrp", F.array("r_mrp")), entry("net_quantity", "net_quantity", F.array("r_quantity")), entry("brand", "brand", F.coalesce("r_brands", F.array().cast("array<string>"))))
    each = joined.select("id", "source", F.explode(entries).alias("e")).select("id", "source", "e.field", nfkc(F.col("e.seen")).alias("seen"), nfkc_all(F.col("e.values")).alias("values"), (F.size("e.values") == 0).alias("none"))
    seen = F.trim(F.coalesce("seen", F.lit(""))) != ""
    equal = F.exists("values", lambda v: values_equal(F.col("field"), F.col("seen"), v, compatible=False))
    status = F.when(~seen | F.col("none"), "NOT_ASSESSABLE").when(equal, "PASS").when(authority(F.col("source")) == "AUTHORITATIVE", "FAIL").otherwise("NEEDS_REVIEW")
    return each.select("id", "field", status.alias("status"))


def matchable_fields(agreed: DataFrame) -> DataFrame:
    """The agreed fields that can tell a product: not a caption alone, not blank."""
    return agreed.where(~F.coalesce("anchor_only", F.lit(False)) & (F.trim(F.coalesce("value", F.lit(""))) != ""))


def enrol_from_scan(agreed: DataFrame, sku: Column | None = None) -> DataFrame:
    """A registry row a scan out of its agreed fields: money as a number, the licence as digits, brand as the one brand string."""
    fields = ("brand", "mrp", "net_quantity", "manufacturer_address", "consumer_care", "fssai_licence")
    wide = matchable_fields(agreed).groupBy("scan_id").pivot("field", list(fields)).agg(F.min("value"))
    licence = F.nullif(F.regexp_replace("fssai_licence", r"\D", ""), F.lit(""))
    return wide.select(
        (F.concat(F.lit("SCAN-"), F.col("scan_id").cast("string")) if sku is None else sku).alias("sku_id"), "scan_id",
        F.when(F.col("brand").isNotNull(), F.array("brand")).otherwise(F.array().cast("array<string>")).alias("brand_strings"), norm_money(F.col("mrp")).alias("mrp_exact"), "net_quantity",
        "manufacturer_address", "consumer_care", licence.alias("fssai_licence"), F.lit("ENROLLED_FROM_SCAN").alias("source"))


def enrol_allowed(enrolments: DataFrame, devices: DataFrame) -> DataFrame:
    """`enrolments` (device_id) with allowed: whether the device is an inspector's. What is not goes to quarantine."""
    inspectors = devices.where("role = 'INSPECTOR'").select(F.col("device_id").alias("of")).distinct()
    return enrolments.join(inspectors, F.col("device_id") == F.col("of"), "left").withColumn("allowed", F.col("of").isNotNull()).drop("of")
