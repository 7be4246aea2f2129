"""Near copies by the Jaccard similarity of word shingles, each link verified exactly.

Candidates meet in buckets: the components of operator 9's SimHash links, and bands of min-hashes
for what lies further apart than its bit limit. A set of shingles is also written as the parity of its
counts in 256 segments: the Hamming distance of two such sketches never exceeds the number of shingles that
only one of the sets has, so most pairs are ruled out by a few bit operations before any set is read.
Members of a bucket are compared with its leader, the one that meets most others; then what is not
yet connected to the leader is compared with what it is not connected to: in buckets of up to PAIRED members with all of them, in
larger ones with those that share a rare shingle. Of two sets of similarity j the smaller has a shingle of the larger one among its first
n - ceil(2 j n / (1 + j)) + 1 ones in any common order, and the larger among its n - ceil(j n) + 1. Rare shingles come first, by
a table of counts, so pages that share much, but too little, share no such shingle. The sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens.llm.common import cut, row_key, text_or_empty
from packlens.llm.lines import signed, sliced, texts
from packlens.llm.simhash import components, fingerprint_of, links, shingle_hashes

#: A pair at Jaccard 0.8 misses all bands with a chance of (1 - 0.8^4)^16, 2 in 10,000.
BANDS, ROWS = 16, 4
SEGMENTS = 256
#: Members of a bucket that are compared one by one.
PAIRED = 64
#: Counters of shingles; hashes that share one only make the order of shingles a worse guess.
COUNTERS = 1 << 18
SKETCH = [f"s{i}" for i in range(SEGMENTS // 64)]
U = np.uint64
_RNG = np.random.default_rng(20240611)
_FACTORS = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * U(2) + U(1)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * U(2) + U(1)


def shingle_set(hashes: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(hashes, "<u8"))


def bands(own: np.ndarray) -> list[int]:
    """The bucket of each band; none for a text without words."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, U)
    for i in range(0, len(own), 2048):
        x = own[None, i : i + 2048] * _FACTORS
        x ^= x >> U(32)
        x *= U(0xD6E8FEB86659FD93)
        least = np.minimum(least, x.min(axis=1))
    mixed = (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=U) + np.arange(BANDS, dtype=U)
    return mixed.view(np.int64).tolist()


def sketch(own: np.ndarray) -> list[int]:
    """The parities of the numbers of hashes in each segment, 64 to a number."""
    counts = np.bincount((own >> U(20)).astype(np.int64) % SEGMENTS, minlength=SEGMENTS)
    return np.packbits((counts & 1).astype(np.uint8)).view("<i8").tolist()


def _digest(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        node, fp, found, facts = [], [], [], []
        for text in texts(batch):
            hashes = shingle_hashes(text, shingle)
            own = shingle_set(hashes)
            node.append(signed(xxhash.xxh64_intdigest(own.tobytes())))
            fp.append(signed(fingerprint_of(hashes)))
            found.append(bands(own))
            facts.append([len(own), *sketch(own)])
        kept = [n for n in batch.schema.names if n != "__text"]
        arrays = [pa.array(node, pa.int64()), pa.array(fp, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(facts, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *arrays], names=[*kept, "node", "fp", "bands", "facts"])


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        own = [shingle_set(shingle_hashes(t, shingle)).view(np.int64) for t in texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own, pa.list_(pa.int64()))], names=["node", "own"])


def verified(pairs: DataFrame, sets: DataFrame, least_percent: int) -> DataFrame:
    """The pairs (src, dst) whose sets have a Jaccard similarity of least_percent or more."""
    a, b = sets.select(F.col("node").alias("src"), F.col("own").alias("x")), sets.select(F.col("node").alias("dst"), F.col("own").alias("y"))
    both = pairs.join(a, "src").join(b, "dst").where(100 * F.least(F.size("x"), F.size("y")) >= least_percent * F.greatest(F.size("x"), F.size("y")))
    shared = both.select("src", "dst", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("shared"))
    return shared.where(100 * F.col("shared") >= least_percent * (F.col("n") - F.col("shared"))).select("src", "dst")


def _may_link(a: str, b: str, least_percent: int) -> Column:
    """False only where two sets cannot be similar enough, by their sizes and sketches.

    Sets of n and m shingles at Jaccard j differ in (n + m)(1 - j) / (1 + j) shingles.
    """
    n, m = F.col(f"{a}.size"), F.col(f"{b}.size")
    apart = sum((F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in SKETCH), F.lit(0))
    return ((100 + least_percent) * apart <= (100 - least_percent) * (n + m)) & (100 * F.least(n, m) >= least_percent * F.greatest(n, m))


def _counters(own: np.ndarray) -> np.ndarray:
    return (own.view(np.uint64) >> U(11)).astype(np.int64) % COUNTERS


def _flat(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("own").flatten().to_numpy(zero_copy_only=False)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each counter is hit by the shingles of a task's sets."""
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        total += np.bincount(_counters(_flat(batch)), minlength=COUNTERS)
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], names=["counter", "n"])


def _first_shingles(batches: Iterator[pa.RecordBatch], counts: np.ndarray, least_percent: int) -> Iterator[pa.RecordBatch]:
    """Per set its rarest shingles: (node, shingle, small). small: it is among those that the smaller set of a pair must share."""
    for batch in sliced(batches, 256):
        nodes, keys, small = [], [], []
        for node, own in zip(batch.column("node").to_pylist(), batch.column("own")):
            own = own.values.to_numpy(zero_copy_only=False)
            n = len(own)
            if not n:
                continue
            larger = n - -(-least_percent * n // 100) + 1
            smaller = n - -(-2 * least_percent * n // (100 + least_percent)) + 1
            first = own[np.lexsort((own, counts[_counters(own)]))[:larger]]
            nodes += [node] * len(first)
            keys.append(first)
            small.append(np.arange(len(first)) < smaller)
        flat = [np.concatenate(x) if x else np.zeros(0, k) for x, k in ((keys, np.int64), (small, bool))]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.bool_())], names=["node", "shingle", "small"])


def _by_rare_shingles(members: DataFrame, sets: DataFrame, least_percent: int) -> DataFrame:
    """Pairs (src < dst) of different roots, one of them late, that share a shingle which a similar pair must share: `members` has node, root, late, size, SKETCH.

    A shingle of one root alone makes no pair. Of the roots that have it the largest is met by the others and not by itself, so a
    component of any size is met once by each member of the others.
    """
    own = cut(sets.join(members.select("node"), "node"), "near-large-sets")
    counts = np.zeros(COUNTERS, np.int64)
    for r in own.mapInArrow(_counted, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toLocalIterator():  # COUNTERS rows at most
        counts[r.counter] = r.n
    firsts = own.mapInArrow(partial(_first_shingles, counts=counts, least_percent=least_percent), "node long, shingle long, small boolean")
    rows = cut(firsts.join(members.select("node", "root"), "node"), "near-first-shingles")
    per = rows.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("n"))
    shared = per.groupBy("shingle").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("n", "root")).alias("top")).where("roots > 1")
    met = cut(rows.join(shared.select("shingle", "top"), "shingle"), "near-shared-shingles")
    a, b = met.where("root <> top").alias("a"), met.alias("b")
    pairs = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.root") != F.col("b.root")) & (F.col("a.small") | F.col("b.small")))
    found = cut(pairs.select(F.least("a.node", "b.node").alias("src"), F.greatest("a.node", "b.node").alias("dst")).distinct(), "near-shingle-pairs")
    x, y = members.alias("x"), members.alias("y")
    both = found.join(x, F.col("src") == F.col("x.node")).join(y, F.col("dst") == F.col("y.node"))
    return both.where((F.col("x.late") | F.col("y.late")) & _may_link("x", "y", least_percent)).select("src", "dst")


def _similar(rows: DataFrame, facts: DataFrame, sets: DataFrame, least_percent: int) -> DataFrame:
    """Verified links (src < dst) of `rows` (node, bucket) that connect all similar members of each bucket."""
    sizes = cut(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    met = cut(rows.join(sizes, "bucket").join(facts, "node").select("bucket", "node", "n", "size", *SKETCH), "met")
    degree = cut(met.groupBy("node").agg(F.sum("n").alias("degree")), "degrees")
    lead = F.max(F.struct("degree", (-F.col("node")).alias("least"), "node", "size", *SKETCH)).alias("lead")
    heads = cut(met.join(degree, "node").groupBy("bucket").agg(lead).select("bucket", "lead.*"), "heads")

    def linked(pairs: DataFrame) -> DataFrame:
        return cut(verified(cut(pairs, "near-pairs"), sets, least_percent), "near-links")

    def paired(a: DataFrame, b: DataFrame, apart: Column) -> DataFrame:
        both = a.alias("a").join(b.alias("b"), (F.col("a.bucket") == F.col("b.bucket")) & apart & _may_link("a", "b", least_percent))
        return both.select(F.least("a.node", "b.node").alias("src"), F.greatest("a.node", "b.node").alias("dst")).distinct()

    found = linked(paired(met, heads, F.col("a.node") != F.col("b.node")))
    roots = cut(components(found), "near-components")
    head_roots = heads.select("bucket", "node").join(roots, "node", "left").select("bucket", F.coalesce("root", "node").alias("head_root"))
    labelled = met.select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    labelled = cut(labelled.join(cut(head_roots, "head-roots"), "bucket").select("bucket", "node", "root", (F.col("root") != F.col("head_root")).alias("late")), "labelled")
    # only buckets with a member that is not connected to the leader go on
    still = cut(labelled.where("late").select("bucket").distinct(), "open-buckets")
    known = cut(met.join(still, "bucket").join(labelled, ["bucket", "node"]), "open-members")
    few = known.where(F.col("n") <= PAIRED)
    by_bucket = linked(paired(few.where("late"), few, F.col("a.root") != F.col("b.root")))
    many = known.where(F.col("n") > PAIRED).groupBy("node").agg(F.max("late").alias("late"), *[F.first(c).alias(c) for c in ("root", "size", *SKETCH)])
    by_shingle = linked(_by_rare_shingles(cut(many, "near-large"), sets, least_percent))
    return found.unionByName(by_bucket).unionByName(by_shingle)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, max_bits: int = 4, least_percent: int = 80) -> DataFrame:
    """One row a document row: id, __th (text hash), fingerprint (hex, one a component), component_id.

    Documents link when the Jaccard similarity of their sets of word shingles is least_percent or more;
    component_id is as in `simhash_groups`. Texts without words are alike; one of fewer words than a
    shingle is one shingle.
    """
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(*row_key(id_col, text_col), text_or_empty(text_col).alias("__text"))
    digest = cut(source.mapInArrow(partial(_digest, shingle=shingle), f"__id {kind}, __th long, node long, fp long, bands array<long>, facts array<long>"), "near-digest")
    nodes = cut(digest.groupBy("node").agg(F.min(F.struct("__id", "__th")).alias("of"), F.min("fp").alias("fp"), F.max("bands").alias("bands"), F.max("facts").alias("facts")), "near-nodes")
    near = components(links(nodes.select("fp").distinct(), max_bits)).withColumnRenamed("node", "fp")
    by_bits = nodes.join(near, "fp", "left").select("node", F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("bucket"))
    rows = cut(nodes.select("node", F.explode("bands").alias("bucket")).unionByName(by_bits).distinct(), "near-rows")
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    need = rows.join(shared, "bucket").select("node").distinct().join(nodes, "node").select("node", F.col("of.__id").alias("__i"), F.col("of.__th").alias("__t"))
    held = source.join(need, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__th") == F.col("__t"))).select("node", "__text")
    sets = cut(held.mapInArrow(partial(_sets, shingle=shingle), "node long, own array<long>").dropDuplicates(["node"]), "near-sets")
    facts = nodes.select("node", *[F.col("facts")[i].alias(n) for i, n in enumerate(["size", *SKETCH])])
    found = components(_similar(rows, facts, sets, least_percent))
    rooted = digest.select("__id", "__th", "node").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")
    rooted = cut(rooted, "near-roots")
    least = cut(rooted.groupBy("root").agg(F.min("__id").alias("component_id")), "least-ids")
    return rooted.join(least, "root").select(F.col("__id").alias(id_col), "__th", F.lower(F.lpad(F.hex("root"), 16, "0")).alias("fingerprint"), "component_id")
