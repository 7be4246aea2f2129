"""Operator 10, mixing sources to target weights: time-varying curriculum.

Each source gets a word target by weight. Its weight over training time u in [0, 1] is a line with
mean 1, integrated to the cumulative demand u + a(u^2 - u); a document that covers the words
[c, c + n) of its source's shuffled stream is trained at the time where the source's demand reaches c. The demand
of all sources up to that time is its position, and documents are range-sorted by it. DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlens.llm.common import WORD, cut, group_keys, opened, quoted, running_before, text_or_empty

WEIGHTS = (3.0, 1.0, 2.0)
SLOPES = (0.5, -0.5, 0.0)
BUDGET = 1.5
MAX_EPOCHS = 2.0
#: Parts that a source's documents are dealt over where they meet its totals.
SALTS = 64


def source_targets(sizes: DataFrame, weights: Sequence[float], slopes: Sequence[float], budget: float, max_epochs: float) -> DataFrame:
    """Adds weight, slope and target to (source, source_size), one row a source.

    The target is min(cap, level * weight) for the one level at which targets sum to the budget:
    sources are put in the order in which they reach their cap, and running sums give the level at each. A
    source's row is its name and two sums; the window below meets those rows only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), at)
    rows = sizes.withColumn("weight", pick(weights)).withColumn("slope", pick([slopes[i % len(slopes)] for i in range(len(weights))]))
    rows = rows.withColumn("cap", max_epochs * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = budget * F.sum("source_size").over(everything)
    room = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", room / share)
    # the first source whose cap is not reached fixes the level for itself and all after it
    open_ = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("o"), F.col("level")))).over(everything)
    level = open_["level"]
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("weight")))
    return rows.withColumn("target", target).drop("cap", "level")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: list[str]) -> DataFrame:
    """The columns `keep` as one struct, source, size and the key that shuffles a source."""
    own = F.struct(*[docs[quoted(c)] for c in keep]).alias("__row")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.xxhash64(F.col(id_col), text_or_empty(text_col))
    return docs.select(own, F.col(source_col).cast("string").alias("source"), size.alias("size"), key.alias("key"))


def _laid(
    rows: DataFrame, light: DataFrame, weights: Sequence[float] = WEIGHTS, slopes: Sequence[float] = SLOPES, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS,
) -> DataFrame:
    """Rows of `_sized` with their source's targets, the words before each in its source's stream, and how often each is taken. light: their source, size and key, written.

    A source's stream is read pass by pass as long as the next document fits whole into what is left of the target. Of the documents that
    the last pass leaves, the one nearest in size to what is then missing is taken as well (`last`), if that brings the source nearer to its target; it
    stands at the end of the stream, behind the `filled` words.
    """
    targets = source_targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, slopes, budget, max_epochs)
    everything = Window.partitionBy()
    by_source = ["__g0", "__n0"]
    known = targets.select(
        *group_keys(["source"]), "source_size", "target", "slope",
        F.sum("target").over(everything).alias("whole"), F.sum(F.col("target") * F.col("slope")).over(everything).alias("drift"))
    most = F.lit(math.ceil(max_epochs))

    def placed(some: DataFrame, facts: DataFrame) -> DataFrame:
        # what is known of a source comes with the sums, so texts are shuffled once before they are sorted
        joined = running_before(some, ["source"], ["key", "size"], "size", "before", light, facts)
        # passes e = 0, 1, ... with e * source_size + before + size <= target
        passes = F.floor((F.col("target") - F.col("before") - F.col("size")) / F.greatest("source_size", F.lit(1))) + 1
        times = F.when(F.col("size") == 0, 0).otherwise(F.greatest(F.lit(0), F.least(passes, most)))
        return joined.withColumn("times", times.cast("int"))

    # a row a source: words of whole documents, and for what is missing the nearest of the documents that may be taken once more
    once = placed(light, known).where("size > 0").select("*", *group_keys(["source"]))
    filled = once.groupBy(*by_source).agg(F.sum(F.col("times") * F.col("size")).alias("filled"))
    missing = F.col("target") - F.col("filled")
    # a source may have a third of all documents, so its one row is copied and its documents are dealt over the copies
    copied = filled.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = once.withColumn("salt", F.pmod("before", F.lit(SALTS)).cast("int")).join(copied, [*by_source, "salt"]).where((F.col("times") <= F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))) & (F.col("times") < most))
    left = left.withColumn("off", F.abs(missing - F.col("size"))).where(F.col("off") < missing)
    chosen = left.groupBy(*by_source, "filled").agg(F.min(F.struct("off", "before")).alias("c")).select(*by_source, "filled", F.col("c.before").alias("chosen"))
    joined = placed(rows, known.join(chosen, by_source, "left"))
    joined = joined.withColumn("last", F.coalesce((F.col("before") == F.col("chosen")) & (F.col("size") > 0), F.lit(False)))
    return joined.withColumn("times", F.col("times") + F.col("last").cast("int")).drop("chosen")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """`docs` without the text, with size, source_size, target, times, taken (words, repeats counted) and position.

    how: weights, slopes, budget, max_epochs. Sources by code point, null last, take `weights` and `slopes` (-1 to 1: share
    at the end against the start) in turn. A source's documents are shuffled by hash and read through up to max_epochs times
    until the next one does not fit whole; then the one nearest in size to what is missing is taken, if that is nearer to the target than without it. max_epochs
    bounds a source's target; a document is taken at most that often, rounded up. Position is the number
    of words of the whole mix that are trained before a document's first word; documents that are not taken have none. Null and
    empty texts have size 0 and are not taken. Repeated rows are documents of their own. An empty table stays empty.
    Columns pass whatever their names; one that is named like a result is replaced by it.
    """
    keep = [c for c in docs.columns if c != text_col]
    sized = cut(_sized(docs, id_col, text_col, source_col, keep), "sized")
    rows = _laid(sized, sized.select("source", "size", "key"), **how)
    position = F.when(F.col("times") > 0, _position(F.when(F.col("last") & (F.col("times") == 1), F.col("filled")).otherwise(F.col("before"))))
    results = {n: F.col(n) for n in ("size", "source_size", "target", "times")} | {"taken": F.col("times") * F.col("size"), "position": position}
    return opened(rows, keep, **results)


def _position(words_before: Column) -> Column:
    """Words of the whole mix before the time u at which a source's stream reaches words_before.

    The source's demand inverted gives u: u + a(u^2 - u) is the share of its target. The demands of all sources up to u
    add up to whole * u + drift * (u^2 - u).
    """
    share = words_before / F.greatest(F.col("target"), F.lit(1.0))
    a = F.col("slope")
    u = F.when(a == 0, share).otherwise((F.sqrt(F.greatest(F.lit(0.0), (1 - a) * (1 - a) + 4 * a * share)) - (1 - a)) / (2 * a))
    u = F.greatest(F.lit(0.0), u)
    return F.col("whole") * u + F.col("drift") * (u * u - u)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: the rows of `docs`, whole, once for each time they are taken, range-sorted by position.

    Columns are those of `docs`; nulls, repeats and empty tables as in `mix`. Texts are not written but to be shuffled: `docs` is read twice, for
    sizes and for rows, and should be a table.
    """
    sized = _sized(docs, id_col, text_col, source_col, docs.columns)
    laid = _laid(sized, cut(sized.select("source", "size", "key"), "sized"), **how).where("times > 0")
    copies = laid.select("*", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("pass"))
    # a later pass through the source is a source's length later in its stream
    later = F.col("before") + F.col("pass") * F.col("source_size")
    at = F.when(F.col("last") & (F.col("pass") == F.col("times") - 1), F.col("filled")).otherwise(later)
    return opened(copies.orderBy(_position(at)), docs.columns)
