"""Line hashes of documents, and lines that recur across distinct documents.

Documents are counted by their distinct text: the hash of the normalised lines that hold a word. Exact
copies, and copies that differ in case or blanks only, count once, whatever else they share with
other documents; lightly edited copies are documents of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DIGITS = re.compile(rb"[^ ]*[0-9][^ ]*")


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def normalised(text: str) -> list[bytes]:
    """The lines of a text: A-Z lower-cased, blanks collapsed; those without a word are empty."""
    return [b" ".join(line.split()) for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n")]


def content_of(own: list[bytes]) -> int:
    """What tells distinct documents apart: the hash of the normalised lines that hold a word."""
    return signed(xxhash.xxh64_intdigest(b"\n".join(x for x in own if x)))


def recurring(lines: DataFrame, keys: list[str], min_contents: int) -> DataFrame:
    """Keys of the lines that recur: `lines` has one row per document and key, with `content`.

    A key recurs with more than `min_contents` different contents. The count is exact; rows are
    pre-aggregated before each shuffle.
    """
    per = lines.groupBy(*keys, "content").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("contents")).where(F.col("contents") > min_contents).select(*keys)


def templates(line: bytes, depth: int, fields: int, min_tokens: int) -> list[int]:
    """Leaves of the fixed-depth tree that a line falls into, as hashes.

    The path is the token count, then the first `depth` tokens, with tokens that hold a digit
    generalised. The rest is `fields` runs of tokens; each leaf generalises one of them to a
    variable field, so two lines share a leaf when they differ in one run at most.
    """
    tokens = _DIGITS.sub(b"<*>", line).split(b" ")
    count = len(tokens)
    if count < min_tokens or not line:
        return []
    path = b"%d\x1f%s\x1f" % (count, b"\x1f".join(tokens[:depth]))
    rest = tokens[depth:]
    if len(rest) < fields:
        return [signed(xxhash.xxh64_intdigest(path + b" ".join(rest)))]
    ends = [len(rest) * i // fields for i in range(fields + 1)]
    runs = [b" ".join(rest[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    out = []
    for i in range(fields):
        kept = b"\x1e".join(b"<*>" if j == i else run for j, run in enumerate(runs))
        out.append(signed(xxhash.xxh64_intdigest(path + b"%d\x1d" % i + kept)))
    return out


def columns(batch: pa.RecordBatch, out: dict[str, pa.DataType], values: dict[str, list]) -> pa.RecordBatch:
    """A batch with the columns of `batch` but for its text, then those of `values`."""
    kept = [n for n in batch.schema.names if n != "__text"]
    arrays = [batch.column(n) for n in kept] + [pa.array(values[n], kind) for n, kind in out.items()]
    return pa.RecordBatch.from_arrays(arrays, names=[*kept, *out])


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a task holds of long texts follows these and not the session's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("__text").to_pylist()]


def template_digest(batches: Iterator[pa.RecordBatch], depth: int, fields: int, min_tokens: int) -> Iterator[pa.RecordBatch]:
    kinds = {"content": pa.int64(), "leaves": pa.list_(pa.list_(pa.int64()))}
    for batch in sliced(batches):
        got: dict[str, list] = {n: [] for n in kinds}
        for text in texts(batch):
            own = normalised(text)
            got["content"].append(content_of(own))
            got["leaves"].append([templates(x, depth, fields, min_tokens) for x in own])
        yield columns(batch, kinds, got)
