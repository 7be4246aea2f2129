"""Operator 3, token-id output: concatenated ids with Elias-Fano coded document boundaries.

Documents are range-partitioned by id and written as blocks. A block is a header, the sorted
document ids and the document ends, both Elias-Fano coded, and the concatenated ids in two or four
bytes each. Blocks are rows of a Parquet folder (shard, block, n_ids, data), so that any store Spark
writes to can hold them and lost tasks are written anew. The start of a document is a select in its block plus
the ids of the blocks and shards before. Ends are read by select, which looks at the bits between two samples.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packlens.llm.common import shared_path, text_or_empty
from packlens.llm.lines import texts
from packlens.llm.tokens import encoder

END_ID = 1
MAGIC = b"PLTB"
HEADER = struct.Struct("<4sBBHIQqII")  # magic, version, id bytes, reserved, docs, ids, first doc id, null ids, bytes of the ids' code
BLOCK_IDS = 1 << 20


class EliasFano:
    """A non-decreasing sequence below 2**63: low bits packed, high bits in unary with select samples.

    Uses about 2 + log2(universe / n) bits a value, and 4 bytes for every SAMPLE values.
    """

    SAMPLE = 256
    HEAD = struct.Struct("<IBI")

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.int64)
        low = np.packbits(((values[:, None] >> shifts) & 1).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[:: cls.SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.n, self.low_bits, len(self.high)) + self.samples.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, high = cls.HEAD.unpack_from(data)
        at = cls.HEAD.size
        samples = np.frombuffer(data, "<u4", -(-n // cls.SAMPLE), at)
        at += samples.nbytes
        low = np.frombuffer(data, np.uint8, (n * low_bits + 7) // 8, at)
        return cls(n, low_bits, low, np.frombuffer(data, np.uint8, high, at + len(low)), samples)

    def select(self, i: int) -> int:
        """The i-th value. Only the bits between two samples are looked at, and the low bits of the one value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        k, left = divmod(i, self.SAMPLE)
        at = int(self.samples[k])
        if left:
            stop = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.high)
            bits = np.unpackbits(self.high[at // 8 : -(-stop // 8)], bitorder="little")
            at += int(np.flatnonzero(bits[at % 8 :])[left])
        first, shift = divmod(i * self.low_bits, 8)
        low = int.from_bytes(self.low[first : first + 9].tobytes(), "little") >> shift & ((1 << self.low_bits) - 1)
        return (at - i) << self.low_bits | low

    def between_samples(self, k: int) -> np.ndarray:
        """The values from the k-th sample to the next one: their selects in one call, on the bits between the two samples."""
        first, last = k * self.SAMPLE, min((k + 1) * self.SAMPLE, self.n)
        at = int(self.samples[k])
        stop = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[at // 8 : -(-stop // 8)], bitorder="little")[at % 8 :]
        high = np.flatnonzero(bits)[: last - first] + at - np.arange(first, last)
        begin, end = first * self.low_bits, last * self.low_bits
        low = np.unpackbits(self.low[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :][: end - begin]
        return high << self.low_bits | (low.reshape(last - first, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(1, dtype=np.int64)

    def all(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits).astype(np.int64)
        return high << self.low_bits | (bits << np.arange(self.low_bits, dtype=np.int64)).sum(1, dtype=np.int64)


def encode_block(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """doc_ids ascending with nulls first; ids: each document's, as little-endian unsigned 32-bit."""
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)
    flat = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if not len(flat) or flat.max() < 1 << 16 else 4
    first = int(known[0]) if len(known) else 0
    names, bounds = EliasFano.of(known - first).to_bytes(), EliasFano.of(ends).to_bytes()
    head = HEADER.pack(MAGIC, 1, width, 0, len(ids), len(flat), first, len(doc_ids) - len(known), len(names))
    return head + struct.pack("<I", len(bounds)) + names + bounds + flat.astype(f"<u{width}").tobytes()


class Block:
    def __init__(self, data: bytes):
        magic, version, self.width, _, self.n_docs, self.n_ids, self.first, self.nulls, names = HEADER.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a block of token ids")
        (bounds,) = struct.unpack_from("<I", data, HEADER.size)
        at = HEADER.size + 4
        self.names, self.ends = EliasFano.from_bytes(data[at : at + names]), EliasFano.from_bytes(data[at + names : at + names + bounds])
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at + names + bounds)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.names.all() + self.first).tolist()

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def _write(batches: Iterator[pa.RecordBatch], path: str, end_id: int, block_ids: int) -> Iterator[pa.RecordBatch]:
    code, end, shard, block = encoder(path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
    names: list = []
    held: list[bytes] = []
    size = 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([size // 4], pa.int64()), pa.array([encode_block(names, held)], pa.binary())], names=["shard", "block", "n_ids", "data"])

    for batch in batches:
        for name, ids in zip(batch.column("__id").to_pylist(), code.encode(texts(batch)), strict=True):
            names.append(name)
            held.append(ids + end)
            size += len(ids) + 4
            if size >= 4 * block_ids:
                yield row()
                names, held, size, block = [], [], 0, block + 1
    if names:
        yield row()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of all whole texts, each followed by end_id, in ascending order of an integer id.

    Null ids come first, rows of one id in the order of their texts; null and empty texts are the end id alone; an empty table writes
    a folder without blocks. Texts are range-partitioned before they are encoded, so no text is encoded twice.
    """
    source = docs.select(F.col(id_col).cast("long").alias("__id"), text_or_empty(text_col).alias("__text"))
    ordered = source.repartitionByRange(F.col("__id").asc_nulls_first()).sortWithinPartitions(F.col("__id").asc_nulls_first(), "__text")
    blocks = ordered.mapInArrow(partial(_write, path=tokenizer, end_id=end_id, block_ids=block_ids), "shard int, block int, n_ids long, data binary")
    blocks.write.option("compression", "zstd").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, number, data in zip(*(batch.column(n).to_pylist() for n in ("shard", "block", "data")), strict=True):
            block = Block(data)
            n = block.n_docs
            ends = np.concatenate([block.ends.between_samples(k) for k in range(len(block.ends.samples))])
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            ids = block.ids.astype("<u4", copy=False)
            crcs = [zlib.crc32(ids[a:b]) for a, b in pairwise([0, *ends.tolist()])]
            yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(block.doc_ids(), pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crcs, pa.int64())], names=["shard", "block", "doc_id", "local", "n_tokens", "ids_crc32"])


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    blocks = spark.read.schema("shard int, block int, n_ids long, data binary").parquet(path)
    found = blocks.select("shard", "block", "data").mapInArrow(_read, "shard int, block int, doc_id long, local long, n_tokens long, ids_crc32 long")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))  # a row a file
    before = shards.select("shard", F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select("shard", "block", inside.alias("block_start")).join(before, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("base"))
    return found.join(offsets, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def tokens_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    path = shared_path(docs.sparkSession, "token-ids")
    write_tokens(docs, path, tokenizer, id_col, text_col)
    return read_boundaries(docs.sparkSession, path)
