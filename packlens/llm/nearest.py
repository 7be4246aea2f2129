"""Operator 6, approximate nearest neighbours: shifted space-filling curves.

Vectors are rotated and shifted at random, projected to a few dimensions and ordered along a Hilbert
curve, several times over. Cells have edges at quantiles, and a vector's place on a curve is its rank among the
keys of a bounded sample, so neither one long vector nor a tight cluster empties the orderings. How far a query looks along each curve
is measured: some queries are answered by brute force, and the window is the narrowest that finds
the wanted share of their neighbours. Orderings are cut into ranges as wide as that window; a query meets the
ranges around it, inner products are taken in blocks, and the best of all orderings are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packlens.llm.common import cut

DIMS, BITS = 8, 6
SEED = 20240607
#: Vectors that edges and ranks come from, and queries that the window is measured with.
SAMPLE, PILOTS = 20_000, 96
#: Queries that look at one slice of an ordering together.
CHUNK = 8


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of integer coordinates in [0, 2**bits).

    Gray-code the interleaved bits from the highest level down, undoing at each level the rotation
    and reflection of the sub-cube that the levels above have chosen.
    """
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, lower = np.int64(1 << level), np.int64((1 << level) - 1)
        for d in range(dims):
            up = (x[:, d] & bit) != 0
            swap = np.where(up, 0, (x[:, 0] ^ x[:, d]) & lower)
            x[:, 0] ^= np.where(up, lower, swap)
            x[:, d] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=1)
    flip = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[:, -1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[:, d] >> level & 1)
    return key


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows as doubles; shorter vectors are padded with zeros."""
    lists = column.to_pylist()
    out = np.zeros((len(lists), dims))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


@dataclass
class Curves:
    """The orderings, fitted on a sample: rotations, cell edges and the sample's sorted keys. A few MB, whatever the input."""

    dims: int
    longest: float
    frames: np.ndarray  # (curves, dims + 1, DIMS)
    shifts: np.ndarray  # (curves, DIMS): of the edges, in cells
    edges: list[np.ndarray]  # per curve (DIMS, cells - 1)
    ranks: list[np.ndarray]  # per curve the sorted keys of the sample

    @classmethod
    def fitted(cls, sample: np.ndarray, longest: float, curves: int) -> Curves:
        dims = sample.shape[1]
        rng = np.random.default_rng(SEED)
        frames = np.stack([np.linalg.qr(rng.normal(size=(dims + 1, dims + 1)))[0][:, :DIMS] for _ in range(curves)])
        shifts = rng.random((curves, frames.shape[2]))
        own = cls(dims, longest, frames, shifts, [], [])
        x = own._lifted(sample)
        for c in range(curves):
            marks = (np.arange(1, 1 << BITS)[None] - shifts[c][:, None]) / (1 << BITS)
            y = x @ frames[c]
            own.edges.append(np.stack([np.quantile(y[:, d], marks[d]) for d in range(y.shape[1])]))
            own.ranks.append(np.sort(own._key(x, c)))
        return own

    def _lifted(self, x: np.ndarray) -> np.ndarray:
        """One more component makes all norms equal, so that near directions are large products."""
        x = x / self.longest
        return np.column_stack([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))])

    def _key(self, lifted: np.ndarray, c: int) -> np.ndarray:
        y = lifted @ self.frames[c]
        return hilbert_keys(np.stack([np.searchsorted(e, y[:, d]) for d, e in enumerate(self.edges[c])], axis=1), BITS)

    def places(self, x: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """(rows, curves): rank of each vector's key among the sample's; equal keys are dealt over their ranks by the salt."""
        lifted, out = self._lifted(x), np.empty((len(x), len(self.frames)), np.int32)
        for c, ranks in enumerate(self.ranks):
            key = self._key(lifted, c)
            first, last = np.searchsorted(ranks, key), np.searchsorted(ranks, key, "right")
            mixed = (salt * np.uint64(2 * c + 3) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            out[:, c] = first + ((last - first) * (mixed / float(1 << 24))).astype(np.int64)
        return out


def _placed(batches: Iterator[pa.RecordBatch], curves: Curves) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        salt = np.asarray(batch.column("rep").to_numpy(zero_copy_only=False)).astype(np.uint64)
        at = curves.places(_matrix(batch.column("vec"), curves.dims), salt)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, at.shape[1]), pa.int32()), pa.array(at.ravel()))
        yield batch.append_column("at", flat)


def _pilot_best(batches: Iterator[pa.RecordBatch], names: np.ndarray, pilots: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Of each batch the k best candidates of each pilot query, by brute force."""
    for batch in batches:
        scores = pilots @ _matrix(batch.column("vec"), pilots.shape[1]).T
        scores[names[:, None] == batch.column("rep").to_numpy()[None]] = -np.inf
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        q, flat = np.repeat(names, top.shape[1]), pa.array(top.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.take_along_axis(scores, top, 1).ravel()), batch.column("at").take(flat)], names=["q", "s", "at"])


def _best(table: pa.Table, dims: int, k: int, reach: int) -> pa.Table:
    """For each query row of a group the k + 1 best candidates within reach, with scores summed in one fixed order."""
    table = table.sort_by("at")
    asks, rep, at = (np.asarray(table.column(n).to_numpy()) for n in ("asks", "rep", "at"))
    x = _matrix(table.column("vec"), dims)
    q, c, q_at, c_at = x[asks], x[~asks], at[asks], at[~asks]
    names, ids, best = rep[asks], rep[~asks], []
    for lo in range(0, len(q), CHUNK):
        part = q[lo : lo + CHUNK]
        a, b = np.searchsorted(c_at, [q_at[lo] - reach, q_at[min(lo + CHUNK, len(q)) - 1] + reach + 1])
        scores = part @ c[a:b].T
        n = min(k + 1, b - a)
        top = np.argpartition(-scores, n - 1, axis=1)[:, :n] if n else np.zeros((len(part), 0), np.int64)
        exact = (part[:, None, :] * c[a:b][top]).sum(2)
        best += [[{"s": -s, "v": v} for s, v in zip(x, y, strict=True)] for x, y in zip(exact.tolist(), ids[a:b][top].tolist(), strict=True)]
    return pa.table({"q": pa.array(names, pa.int64()), "best": pa.array(best, pa.list_(pa.struct([("s", pa.float64()), ("v", pa.int64())])))})


def _window(index: DataFrame, dims: int, k: int, recall: float) -> int:
    """How many ranks to either side hold the wanted share of the true neighbours of pilot queries on one curve at least."""
    chosen = index.where("has_query").orderBy(F.xxhash64("rep", F.lit("pilot")), "rep").limit(PILOTS).select("rep", "vec", "at").toArrow()
    if not chosen.num_rows:
        return 1
    names, own = chosen.column("rep").to_numpy(), dict(zip(chosen.column("rep").to_pylist(), chosen.column("at").to_pylist(), strict=True))
    run = partial(_pilot_best, names=names, pilots=_matrix(chosen.column("vec"), dims), k=k)
    each = index.select("rep", "vec", "at").mapInArrow(run, "q long, s double, at array<int>")
    best = each.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("s"), "at"))), 1, k).alias("best"))
    found = best.select("q", F.explode("best.at").alias("at")).toArrow()  # PILOTS * k rows
    if not found.num_rows:
        return 1
    apart = [int(np.abs(np.subtract(own[q], at)).min()) for q, at in zip(found.column("q").to_pylist(), found.column("at").to_pylist(), strict=True)]
    return max(1, int(np.quantile(apart, recall, method="higher")))


def nearest(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20,
    curves: int = 24, recall: float = 0.93, rows_a_block: int = 8192,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each id divisible by `every`.

    Ties go to the smaller id. Curves are fitted on SAMPLE vectors, and the window along them is the narrowest that finds
    the share `recall` of the neighbours of PILOTS queries; every row is indexed. Windows are met in blocks of about
    rows_a_block vectors. Null, zero, empty and non-finite vectors
    and null ids take no part; shorter vectors count as padded with zeros. Equal vectors are
    indexed once, with their k + 1 smallest ids, which is all that an answer can hold. Extra
    columns are not read; an empty table gives no rows.
    """
    vec = F.col(vec_col).cast("array<double>")
    sound = F.coalesce(F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0), F.lit(False))
    rows = cut(vectors.where(F.col(id_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), (F.col(id_col) % every == 0).alias("asks")), "vectors")
    facts = rows.agg(F.max(F.size("vec")).alias("d"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)).alias("m")).first()
    dims, longest = facts["d"] or 1, math.sqrt(facts["m"] or 1.0) or 1.0
    same = rows.groupBy("vec").agg(F.min("id").alias("rep"), F.max("asks").alias("has_query"))
    by = Window.partitionBy("vec").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1)
    members = cut(few.groupBy("vec").agg(F.min("id").alias("rep"), F.collect_list("id").alias("ids")).select("rep", "ids"), "members")
    own = cut(same.select("rep", "has_query", "vec"), "distinct-vectors")
    sample = own.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vec").toArrow()
    fitted = Curves.fitted(_matrix(sample.column("vec"), dims) if sample.num_rows else np.ones((1, dims)), longest, curves)
    index = cut(own.mapInArrow(partial(_placed, curves=fitted), "rep long, has_query boolean, vec array<double>, at array<int>"), "curve-places")
    reach = _window(index, dims, k, recall)
    # a range is as wide as the window: blocks of its rows, and parts of the queries of three ranges
    counts = index.agg(F.count(F.lit(1)), F.count_if("has_query")).first()
    share = reach / max(1, sample.num_rows)
    blocks, parts = (max(1, math.ceil(n * share / rows_a_block)) for n in (counts[0], 3 * counts[1]))
    dealt = lambda n: F.pmod(F.xxhash64("rep"), F.lit(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    placed = index.select("rep", "has_query", "vec", F.posexplode("at").alias("curve", "at")).withColumn("range", F.floor(F.col("at") / reach).cast("int"))
    candidates = placed.select("curve", "range", "at", dealt(blocks).alias("block"), numbers(parts).alias("part"), F.lit(False).alias("asks"), "rep", "vec")
    asking = placed.where("has_query").select("curve", F.explode(F.sequence(F.col("range") - 1, F.col("range") + 1)).alias("range"), "at", dealt(parts).alias("part"), "rep", "vec")
    asking = asking.select("curve", "range", "at", numbers(blocks).alias("block"), "part", F.lit(True).alias("asks"), "rep", "vec")

    def best(group: pa.Table) -> pa.Table:
        return _best(group, dims, k, reach)

    met = candidates.unionByName(asking).groupBy("curve", "range", "block", "part").applyInArrow(best, "q long, best array<struct<s: double, v: long>>")
    # per query at most curves * 3 * blocks short lists
    merged = met.groupBy("q").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k + 1).alias("best"))
    found = merged.select("q", F.explode("best").alias("b")).select("q", F.col("b.s").alias("s"), F.col("b.v").alias("rep"))
    expanded = found.join(members, "rep").select("q", F.transform("ids", lambda i: F.struct(F.col("s").alias("s"), i.alias("v"))).alias("best"))
    answer = expanded.groupBy("q").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best"))
    queries = rows.where("asks").join(same.select(F.col("vec").alias("w"), F.col("rep").alias("q")), F.col("vec") == F.col("w")).select("id", "q")
    final = queries.join(answer, "q").select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("best", lambda b: b["v"] != F.col("id")), 1, k)).alias("rank", "b"))
    return final.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.v").alias("vec_id"), (-F.col("b.s")).alias("score"))
