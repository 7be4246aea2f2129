"""Operator 7, packing: shortest-pack-first over the length histogram.

Documents are tokenised once into a written table. Full runs of `width` ids are sequences of their
own; the rest of each document has a length under `width`. The histogram of these lengths (at
most width - 1 counts) comes to the driver, where lengths are placed longest first into the shortest
pack with room, as counts of patterns, not as documents. Documents then take the places of their
length by their rank within it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm.common import cut, running_before, text_or_empty
from packlens.llm.lines import texts
from packlens.llm.tokens import encoder

END_ID = 1


def plan_packs(histogram: dict[int, int], width: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """Places for `histogram[length]` items of each length under width, in the fewest sequences.

    Returns lots (length, first rank, count, part start, part length, first sequence, offset): the items
    of that length with ranks first .. first + count - 1 put the part into that many consecutive
    sequences. An item is cut only when no pack has room for it and the fewest possible number of
    packs, ceil(ids / width), is open. The work depends on the histogram, not on the documents.
    """
    most = -(-sum(n * k for n, k in histogram.items()) // width)
    lots: list[list[tuple[int, int, int, int]]] = [[] for _ in range(width + 1)]
    for n, k in sorted(histogram.items()):
        lots[n].append((n, 0, k, 0))
    packs: list[list[tuple[int, int]]] = [[] for _ in range(width + 1)]  # by room: (first sequence, count)
    opened, out = 0, []
    for n in range(width, 0, -1):
        room = width
        while lots[n]:
            length, rank, k, start = lots[n].pop()
            while room and not packs[room]:
                room -= 1
            if room < n and opened < most:
                t = min(k, most - opened)
                first, room_now, part = opened, width, n
                opened += t
            else:
                first, count = packs[room].pop()
                t, room_now, part = min(k, count), room, min(n, room)
                if t < count:
                    packs[room].append((first + t, count - t))
            out.append((length, rank, t, start, part, first, width - room_now))
            if room_now > part:
                packs[room_now - part].append((first, t))
                room = max(room, room_now - part)
            if part < n:
                lots[n - part].append((length, rank, t, start + part))
            if t < k:
                lots[n].append((length, rank + t, k - t, start))
    return out


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    code = encoder(path)
    kind = np.dtype("<u2" if max(code.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
    for batch in batches:
        kept = [batch.column(n) for n in batch.schema.names if n != "__text"]
        at = 0
        for flat, counts in code.encoded(texts(batch)):
            ends = np.cumsum(counts)
            own = np.insert(flat, ends, end_id).astype(kind)
            offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * kind.itemsize
            ids = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(own)])
            columns = [*(c.slice(at, len(counts)) for c in kept), pa.array(counts + 1), ids]
            at += len(counts)
            yield pa.RecordBatch.from_arrays(columns, names=[*(n for n in batch.schema.names if n != "__text"), "n", "ids"])


def _wide(ids: bytes, n: int) -> bytes:
    return ids if len(ids) == 4 * n else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def token_table(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """A written table (row, __id, n, ids): whole texts as ids with the end id, in two bytes each where the vocabulary allows it."""
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    return cut(source.mapInArrow(partial(_encode, path=tokenizer, end_id=end_id), f"row long, __id {kind}, n long, ids binary"), "tokens")


def _pieces(batches: Iterator[pa.RecordBatch], width: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for batch in batches:
        got: dict[str, list] = {n: [] for n in [*names, "ids"]}
        source: list[int] = []
        columns = (batch.column(n).to_pylist() for n in ("n", "ids", "full_before", "parts"))
        for i, (n, small, before, parts) in enumerate(zip(*columns, strict=True)):
            ids = _wide(small, n)
            full = n // width
            places = [(j * width, width, before + j, 0) for j in range(full)]
            places += [(full * width + p["s"], p["l"], p["q"], p["o"]) for p in sorted(parts or [], key=lambda p: p["s"])]
            for start, length, sequence, offset in places:
                own = ids[4 * start : 4 * (start + length)]
                source.append(i)
                for name, value in zip(names, (start, length, zlib.crc32(own), n, sequence, offset), strict=True):
                    got[name].append(value)
                if with_ids:
                    got["ids"].append(own)
        arrays = [batch.column("__id").take(pa.array(source, pa.int64())), *(pa.array(got[n], pa.int64()) for n in names)]
        yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(got["ids"], pa.binary())] if with_ids else [])], names=["__id", *names, *(["ids"] if with_ids else [])])


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", width: int = 2048, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (uint32, little-endian).

    Each id of each row lies in one piece. Null and empty texts are the end id alone. Repeated rows are
    packed each. An empty table gives no rows. Sequence ids are gapless from 0; all sequences but
    the last few are full, since fewer than `width` ids of padding are left in all.
    """
    spark = docs.sparkSession
    tokens = token_table(docs, id_col, text_col, tokenizer, end_id)
    lengths = tokens.select("row", F.expr(f"n div {width}").alias("full"), F.expr(f"cast(n % {width} as int)").alias("rest"))
    counts = lengths.groupBy("rest").agg(F.count(F.lit(1)).alias("k"), F.sum("full").alias("full")).collect()  # at most `width` rows
    base = sum(r["full"] for r in counts)
    lots = plan_packs({r["rest"]: r["k"] for r in counts if r["rest"]}, width)
    plan = spark.createDataFrame(
        [(n, rank, rank + k, start, part, base + first, offset) for n, rank, k, start, part, first, offset in lots],
        "p_rest int, p_from long, p_to long, s int, l int, q long, o int")
    ranked = running_before(lengths.withColumn("one", F.lit(1)), ["rest"], ["row"], "one", "rank")
    placed = running_before(ranked.select("row", "full", "rest", "rank"), [], ["row"], "full", "full_before")
    # the plan has a few rows for each of the at most width - 1 lengths
    near = placed.join(F.broadcast(plan), (F.col("rest") == F.col("p_rest")) & (F.col("rank") >= F.col("p_from")) & (F.col("rank") < F.col("p_to")), "left")
    part = F.when(F.col("s").isNotNull(), F.struct("s", "l", (F.col("q") + F.col("rank") - F.col("p_from")).alias("q"), "o"))
    places = near.groupBy("row").agg(F.first("full_before").alias("full_before"), F.collect_list(part).alias("parts"))
    kind = dict(docs.dtypes)[id_col]
    schema = f"__id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    joined = tokens.join(places, "row").select("__id", "n", "ids", "full_before", "parts")
    return joined.mapInArrow(partial(_pieces, width=width, with_ids=with_ids), schema).withColumnRenamed("__id", id_col)
