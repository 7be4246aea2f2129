"""Operator 9, SimHash near-dedup: segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments, written in unary so
that the Manhattan distance of two embeddings is the bit count of their XOR. That distance never
exceeds the Hamming distance of the fingerprints. The embedding is cut into 8 blocks; fingerprints
within 4 bits agree in 4 blocks at least, so every choice of 4 blocks is a grid whose cells are
joined as ranges: pairs in a cell are bounded by Manhattan distance, then verified exactly. In cells
of many members pairs are not formed: two fingerprints within 4 bits are both within 2 bits of some
centre, all that are within 2 bits of one centre link, and each of them is tied to the first of them only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens.llm.common import cut, opened, row_key, sealed, text_or_empty
from packlens.llm.lines import signed, texts

SEED = 42
BLOCKS = 8
LOW_BITS = 0x5555555555555555
#: Members of a grid cell beyond which its pairs are not formed.
DENSE = 16


def shingle_hashes(text: str, shingle: int) -> bytes:
    """The 8-byte hashes of the text's word shingles, in order; none for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return b""
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    last = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[last:].tolist(), strict=True)])


def fingerprint_of(hashes: bytes) -> int:
    if not hashes:
        return 0
    n = len(hashes) // 8
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(n, 64)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 255):  # byte sums of up to 255 rows cannot overflow
        counts += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: str, shingle: int) -> int:
    """The SimHash of the text's word shingles, repeats counted; 0 for a text without words."""
    return fingerprint_of(shingle_hashes(text, shingle))


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [n for n in batch.schema.names if n != "__text"]
        found = pa.array([signed(fingerprint(t, shingle)) for t in texts(batch)], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), found], names=[*names, "fp"])


def embedding(fp: Column) -> Column:
    """Per two-bit segment its bit count 0, 1, 2 as 00, 01, 11."""
    low = F.lit(LOW_BITS)
    odd = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(odd).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(odd).bitwiseAND(low), 1))


def _flips(bits: int) -> list[int]:
    """All masks of up to `bits` of the 64 bits."""
    return [signed(sum(1 << b for b in some)) for n in range(bits + 1) for some in combinations(range(64), n)]


def links(fps: DataFrame, max_bits: int = 4, dense: int = DENSE) -> DataFrame:
    """Pairs (src < dst) of the distinct values of column fp that connect all which lie within max_bits (even) bits.

    Every pair is a link, within max_bits bits. Cells of up to `dense` members give all their links; members of
    larger cells give, for every centre within max_bits / 2 bits, the links to the smallest one around
    it. A centre has a bounded number of fingerprints around it (2081 at 2 bits), so no group grows with
    the input, and both ways take work in proportion to the fingerprints.
    """
    masks = [signed(sum(0xFF << (8 * b) for b in blocks)) for blocks in combinations(range(BLOCKS), BLOCKS - max_bits)]
    grid = F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("grid", "mask")
    # few bytes become many rows, so they are dealt out by count first; by key, Spark would take the shuffle before for it
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = fps.select("fp").repartition(tasks)
    cells = spread.select("fp", embedding(F.col("fp")).alias("emb"), grid).select("fp", "grid", F.col("emb").bitwiseAND(F.col("mask")).alias("cell"))
    counts = cut(cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cells")
    members = cut(cells.join(counts.hint("merge"), ["grid", "cell"]), "cell-members")  # the counts grow with the input
    few = members.where(F.col("n") <= dense).select("grid", "cell", "fp")
    a, b = few.alias("a"), few.alias("b")
    apart = embedding(F.col("a.fp")).bitwiseXOR(embedding(F.col("b.fp")))
    pairs = a.join(
        b,
        (F.col("a.grid") == F.col("b.grid")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(apart) <= max_bits)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits),
    ).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    many = members.where(F.col("n") > dense).select("fp").distinct()
    flips = F.array(*[F.lit(m) for m in _flips(max_bits // 2)])
    around = many.repartition(tasks).select("fp", F.explode(flips).alias("flip")).groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
    stars = around.agg(F.sort_array(F.collect_list("fp")).alias("all")).where(F.size("all") > 1)
    ties = stars.select(F.col("all")[0].alias("src"), F.explode(F.slice("all", F.lit(2), F.size("all"))).alias("dst"))
    return pairs.unionByName(ties).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (src, dst) reaches.

    Alternates large-star and small-star steps until the edges stay the same; each step is written
    to the shared folder. Only one count and one checksum a step come to the driver.
    """
    edges = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = None
    now = state(edges)
    while now != before and now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first, so that the join below is one of two plain shuffles, whose hot nodes Spark splits
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "large-star")
        down = cut(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = large.join(down, "u")
        edges = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        edges = cut(edges.where("u <> v").distinct(), "small-star")
        before, now = now, state(edges)
    found = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row a document row: id, __th (text hash), fingerprint (hex), component_id.

    Documents link when their fingerprints differ in max_bits bits or fewer; component_id is the smallest
    id that a document reaches, itself included (null only where no document of its component has
    an id). Null and empty texts have fingerprint 0, which links like any other. Copies are joined
    through their fingerprint, never pairwise. Extra columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(*row_key(id_col, text_col), text_or_empty(text_col).alias("__text"))
    table = cut(source.mapInArrow(partial(_fingerprints, shingle=shingle), f"__id {kind}, __th long, fp long"), "fingerprints")
    distinct = table.groupBy("fp").agg(F.min("__id").alias("id"))
    found = components(links(distinct, max_bits))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    least = cut(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "least-ids")
    of = rooted.join(least, "root").select(F.col("fp").alias("f"), "component_id")
    joined = table.join(of, table["fp"] == of["f"], "left")
    return joined.select(F.col("__id").alias(id_col), "__th", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find: Callable[..., DataFrame] = simhash_groups, **how) -> DataFrame:
    """One document of each group that `find` finds stays: the one with the smallest id, and of its rows one.

    Documents with null id stay only where their group has no id at all, one of them.
    """
    groups = find(docs, id_col, text_col, **how)
    own = groups[id_col].eqNullSafe(groups["component_id"])
    first = groups.where(own).select(F.col(id_col).alias("__id"), "fingerprint", "component_id", "__th")
    named = first.where(F.col("__id").isNotNull()).groupBy("__id").agg(F.min("__th").alias("__th"))
    without = first.where(F.col("__id").isNull()).groupBy("fingerprint").agg(F.min("__th").alias("__th"))
    stay = named.unionByName(without.select(F.lit(None).cast(dict(docs.dtypes)[id_col]).alias("__id"), "__th"))
    # one key for the join and the repeated rows, so that texts are shuffled once
    key = lambda df: F.xxhash64(df["__id"], df["__th"])
    keyed = sealed(docs, id_col, text_col)
    kept = keyed.withColumn("__key", key(keyed)).join(stay.select(key(stay).alias("__key")), "__key", "left_semi")
    return opened(kept.dropDuplicates(["__key"]), docs.columns)
