"""Operator 2, LM scoring: an interpolated modified Kneser-Ney bigram model.

Bigrams are counted in Spark: a task counts its own texts and sends, per part of the model, one compressed
block of (word before, word, count). The task that merges a part writes it to the shared folder as
sorted hash arrays; a table of words is written alike. Scoring tasks map these arrays into memory
and look words up by binary search, so no task or driver holds the model.
"""

from __future__ import annotations

import os
import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.llm.common import crc32_id, cut, shared_path, text_or_empty
from packlens.llm.lines import texts

START, END = 1, 2
CHUNK_TOKENS = 2_000_000
SCORE_TOKENS = 400_000
MEMO_WORDS = 400_000
#: Bigrams seen less often keep their mass for the backoff and are not stored. All are (1), unless a caller asks for less.
MIN_COUNT = 1
#: Bytes of text for each part of the model, so that a part fits a task whatever the input.
PART_BYTES = 1 << 26
U = np.uint64


class WordHashes(dict):
    """64-bit hash of a word; dropped and refilled beyond MEMO_WORDS."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word) | 4
        return h

    def of(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if len(self) > MEMO_WORDS:
            self.clear()
        out = np.empty(len(words) + 2, U)
        out[0], out[-1] = START, END
        out[1:-1] = np.fromiter(map(self.__getitem__, words), U, len(words))
        return out


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    k = (before * U(0x9E3779B97F4A7C15) + word) * U(0xBF58476D1CE4E5B9)
    return k ^ (k >> U(31))


def part_of(before: np.ndarray, word: np.ndarray, parts: int) -> np.ndarray:
    """A word's bigrams lie in up to 8 parts, so that a frequent word fills no part alone."""
    spread = ((before * U(0xD6E8FEB86659FD93)) >> U(61)) * U(0x9E3779B1)
    return (((word * U(0xA0761D6478BD642F)) >> U(32)) + spread) % U(parts)


def summed(before: np.ndarray, word: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by key, with their summed counts: key, before, word, count."""
    key = pair_keys(before, word)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(count[order], first) if len(key) else count
    return key[first], before[order][first], word[order][first], total


def pack_arrays(*arrays: np.ndarray) -> bytes:
    return struct.pack("<I", len(arrays[0])) + pa.Codec("zstd").compress(b"".join(a.tobytes() for a in arrays), asbytes=True)


def unpack_arrays(data: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<I", data)
    sizes = [n * np.dtype(k).itemsize for k in kinds]
    raw = pa.Codec("zstd").decompress(memoryview(data)[4:], decompressed_size=sum(sizes), asbytes=True)
    ends = np.cumsum([0, *sizes])
    return [np.frombuffer(raw[a:b], k) for a, b, k in zip(ends, ends[1:], kinds, strict=False)]


def _count(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    memo, held, size = WordHashes(), [], 0

    def flush() -> pa.RecordBatch:
        before, word = np.concatenate([t[:-1] for t in held]), np.concatenate([t[1:] for t in held])
        _, before, word, count = summed(before, word, np.ones(len(word), np.int64))
        part = part_of(before, word, parts)
        order = np.lexsort((before, word, part))
        before, word, count, part = before[order], word[order], count[order].astype("<u4"), part[order]
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = np.append(at[1:], len(part))
        blocks = [pack_arrays(before[a:b], word[a:b], count[a:b]) for a, b in zip(at, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array(blocks, pa.binary())], names=["part", "block"])

    for batch in batches:
        for text in texts(batch):
            held.append(memo.of(text))
            size += len(held[-1])
            if size >= CHUNK_TOKENS:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _store(folder: str, name: str, data: bytes) -> None:
    """A file of the shared folder appears whole; a task that runs again puts the same in its place."""
    fs, root = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    temporary = f"{root}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        out.write(data)
    fs.move(temporary, f"{root}/{name}")


TALLY = "kind int, a long, b long, c long, d long, e long"


def _merge(group: pa.Table, folder: str, min_count: int) -> pa.Table:
    """Merges the blocks of a part, stores its arrays, and tallies words (kind 0: word, count, words
    before it), contexts of stored bigrams (1: word, sum, of count 1, of 2, of more), counts of counts (2) and the part (3)."""
    blocks = [unpack_arrays(b, ("<u8", "<u8", "<u4")) for b in group.column("block").to_pylist()]
    before, word, count = (np.concatenate([b[i] for b in blocks]) for i in range(3))
    key, before, word, count = summed(before, word, count.astype(np.int64))
    kept = count >= min_count
    part = group.column("part")[0].as_py()
    _store(folder, f"pairs-{part}", key[kept].tobytes() + count[kept].astype("<u4").tobytes())
    words, at = np.unique(word, return_inverse=True)
    contexts, of = np.unique(before[kept], return_inverse=True)
    stored = count[kept]
    of_counts = np.array([(count == i).sum() for i in (1, 2, 3, 4)])
    add = lambda at, x, n: np.bincount(at, x, minlength=n).astype(np.int64)
    none, four, one = np.zeros(len(words), np.int64), np.zeros(4, np.int64), np.zeros(1, np.int64)
    columns = {
        "kind": [none, none[:0] if not len(contexts) else np.ones(len(contexts), np.int64), four + 2, one + 3],
        "a": [words.view(np.int64), contexts.view(np.int64), np.arange(1, 5), one + part],
        "b": [add(at, count, len(words)), add(of, stored, len(contexts)), of_counts, one],
        "c": [add(at, np.ones(len(word)), len(words)), add(of, stored == 1, len(contexts)), four, one],
        "d": [none, add(of, stored == 2, len(contexts)), four, one],
        "e": [none, add(of, stored > 2, len(contexts)), four, one],
    }
    kinds = {"kind": pa.int32()}
    return pa.table({n: pa.array(np.concatenate(x), kinds.get(n, pa.int64())) for n, x in columns.items()})


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of events seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(raw))  # type: ignore[return-value]


def _words(group: pa.Table, folder: str) -> pa.Table:
    """Stores the words of a part: hash, count, unigram probability, discounted mass of its stored bigrams."""
    w = group.column("w").to_numpy().view(U)
    order = np.argsort(w)
    arrays = [w[order], *(group.column(n).to_numpy()[order] for n in ("n", "p", "mass"))]
    part = group.column("part")[0].as_py()
    _store(folder, f"words-{part}", b"".join(a.astype(k).tobytes() for a, k in zip(arrays, ("<u8", "<f8", "<f8", "<f8"), strict=True)))
    return pa.table({"part": pa.array([part], pa.int32()), "n": pa.array([len(w)], pa.int64())})


@lru_cache(maxsize=1024)
def mapped(folder: str, name: str, kinds: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """The arrays of a file, memory-mapped; from a store that cannot be mapped, a copy for this worker is. A lost file is an error."""
    fs, root = pa.fs.FileSystem.from_uri(folder)
    path = f"{root}/{name}"
    if fs.get_file_info(path).type == pa.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if not isinstance(fs, pa.fs.LocalFileSystem):
        fd, local = tempfile.mkstemp()
        with fs.open_input_stream(path) as source, os.fdopen(fd, "wb") as out:
            while part := source.read(1 << 24):
                out.write(part)
        path = local
    size = os.path.getsize(path)
    n = size // sum(np.dtype(k).itemsize for k in kinds)
    if not n:
        return tuple(np.zeros(0, k) for k in kinds)
    data = np.memmap(path, np.uint8, "r")
    ends = np.cumsum([0, *(n * np.dtype(k).itemsize for k in kinds)])
    out = tuple(data[a:b].view(k) for a, b, k in zip(ends, ends[1:], kinds, strict=False))
    if path.startswith(tempfile.gettempdir() + "/tmp"):
        os.unlink(path)
    return out


WORD_KINDS, PAIR_KINDS = ("<u8", "<f8", "<f8", "<f8"), ("<u8", "<u4")


def manifest(parts: Iterable[int], n: int) -> bytes:
    """One bit for each of n parts that has a file."""
    held = np.zeros(n, np.uint8)
    held[list(parts)] = 1
    return np.packbits(held, bitorder="little").tobytes()


def find(folder: str, stem: str, kinds: tuple[str, ...], key: np.ndarray, part: np.ndarray, held: bytes) -> list[np.ndarray]:
    """For each key the values of its entry as doubles, 0 where there is none. Keys are distinct; held: parts that have a file."""
    out = [np.zeros(len(key)) for _ in kinds[1:]]
    order = np.lexsort((key, part))
    sorted_part = part[order]
    at = np.flatnonzero(np.concatenate([[True], sorted_part[1:] != sorted_part[:-1]])) if len(key) else []
    for a, b in zip(at, np.append(at[1:], len(key)) if len(key) else [], strict=True):
        own, number = order[a:b], int(sorted_part[a])
        if not held[number // 8] >> number % 8 & 1:
            continue
        keys, *values = mapped(folder, f"{stem}-{number}", kinds)
        if not len(keys):
            continue
        place = np.minimum(np.searchsorted(keys, key[own]), len(keys) - 1)
        hit = keys[place] == key[own]
        for o, v in zip(out, values, strict=True):
            o[own[hit]] = v[place[hit]]
    return out


def word_part(word: np.ndarray, parts: int) -> np.ndarray:
    return ((word * U(0xA0761D6478BD642F)) >> U(32)) % U(parts)


def _score(batches: Iterator[pa.RecordBatch], folder: str, facts: dict) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    parts, n, v, d = facts["parts"], facts["tokens"], facts["words"], np.array([0.0, *facts["discounts"]])

    def chunk(held: list[np.ndarray]) -> list[np.ndarray]:
        lengths = np.array([len(t) - 1 for t in held])
        before, word = np.concatenate([t[:-1] for t in held]), np.concatenate([t[1:] for t in held])
        words, at = np.unique(np.concatenate([word, before]), return_inverse=True)
        count, p, mass = (x[at] for x in find(folder, "words", WORD_KINDS, words, word_part(words, parts), facts["word_parts"]))
        seen, p_word = count[: len(word)], p[: len(word)]
        context, mass = count[len(word) :], mass[len(word) :]
        p_word = np.where(seen > 0, p_word, facts["unknown"])
        context = np.where(before == U(START), float(facts["texts"]), context)
        pairs, where = np.unique(pair_keys(before, word), return_index=True)
        (times,) = find(folder, "pairs", PAIR_KINDS, pairs, part_of(before[where], word[where], parts), facts["pair_parts"])
        times = times[np.searchsorted(pairs, pair_keys(before, word))]
        own = np.maximum(times - d[np.minimum(times, 3).astype(np.int64)], 0.0)
        safe = np.maximum(context, 1.0)
        prob = np.where(context > 0, own / safe + (1.0 - mass / safe) * p_word, p_word)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        total = lambda x: np.add.reduceat(x, starts)
        return [lengths, total((seen > 0).astype(np.int64)), total(np.log10((seen + 1.0) / (n + v + 1.0))), total(np.log10(prob))]

    for batch in batches:
        done: list[list[np.ndarray]] = []
        held: list[np.ndarray] = []
        size = 0
        for text in texts(batch):
            held.append(memo.of(text))
            size += len(held[-1])
            if size >= SCORE_TOKENS:
                done.append(chunk(held))
                held, size = [], 0
        if held:
            done.append(chunk(held))
        if done:
            columns = [pa.array(np.concatenate([x[i] for x in done])) for i in range(4)]
            kept = [x for x in batch.schema.names if x != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), *columns], names=[*kept, "n_tokens", "n_known", "base_score", "score"])


def train(corpus: DataFrame, text_col: str = "text", min_count: int = MIN_COUNT) -> dict:
    """Fits the model on all texts; returns its folder and its few numbers.

    Null and empty texts are one end token; repeated rows count each. An empty corpus gives a model in which nothing is known.
    """
    spark: SparkSession = corpus.sparkSession
    folder = shared_path(spark, "bigrams")
    size = corpus.agg(F.sum(F.octet_length(text_or_empty(text_col)))).first()[0] or 0
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    blocks = corpus.select(text_or_empty(text_col).alias("__text")).mapInArrow(partial(_count, parts=parts), "part int, block binary")

    def merge(group: pa.Table) -> pa.Table:
        return _merge(group, folder, min_count)

    tally = cut(blocks.groupBy("part").applyInArrow(merge, TALLY), "tally")
    seen = {r["a"]: r["n"] for r in tally.where("kind = 2").groupBy("a").agg(F.sum("b").alias("n")).collect()}  # 4 rows
    d = discounts([int(seen.get(i, 0) or 0) for i in (1, 2, 3, 4)])
    words = cut(tally.where("kind = 0").groupBy("a").agg(F.sum("b").alias("n"), F.sum("c").alias("ways")), "word-counts")
    sums = words.agg(F.sum("n"), F.count(F.lit(1)), F.sum("ways"), *[F.count_if(F.col("ways") == i) for i in (1, 2, 3, 4)], F.max(F.when(F.col("a") == END, F.col("n")))).first()
    tokens, distinct, ways, ends = int(sums[0] or 0), int(sums[1]), int(sums[2] or 0), int(sums[7] or 0)
    u = discounts([int(x) for x in sums[3:7]])
    less = F.when(F.col("ways") == 1, u[0]).when(F.col("ways") == 2, u[1]).otherwise(u[2])
    free = float(words.agg(F.sum(less)).first()[0] or 0.0) / max(ways, 1) if ways else 1.0
    unknown = free / (distinct + 1)
    mass = tally.where("kind = 1").groupBy("a").agg((F.sum("b") - d[0] * F.sum("c") - d[1] * F.sum("d") - d[2] * F.sum("e")).alias("mass"))
    table = words.join(mass, "a", "left").select(
        F.col("a").alias("w"), F.col("n").cast("double").alias("n"), ((F.col("ways") - less) / max(ways, 1) + unknown).alias("p"), F.coalesce("mass", F.lit(0.0)).alias("mass"))
    start = mass.where(F.col("a") == START).first()  # one row: the beginning of a text has no count of its own

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column("w").to_numpy().view(U)
            yield b.append_column("part", pa.array(word_part(w, parts).astype(np.int32)))

    def store(group: pa.Table) -> pa.Table:
        return _words(group, folder)

    beginning = spark.createDataFrame([(START, 0.0, 0.0, float(start["mass"]))] if start else [], "w long, n double, p double, mass double")
    dealt = table.unionByName(beginning).mapInArrow(part, "w long, n double, p double, mass double, part int")
    stored = cut(dealt.groupBy("part").applyInArrow(store, "part int, n long"), "stored-words")
    held = {
        "pair_parts": manifest([r["a"] for r in tally.where("kind = 3").select("a").collect()], parts),
        "word_parts": manifest([r["part"] for r in stored.select("part").collect()], parts),
    }  # a number a part
    return held | {"folder": folder, "parts": parts, "tokens": tokens, "words": distinct, "texts": ends, "unknown": unknown, "discounts": d}


def score(docs: DataFrame, model: dict, columns: list[str], text_col: str = "text") -> DataFrame:
    """`columns` of docs with n_tokens, n_known, base_score, score (log10) added."""
    source = docs.select(*columns, text_or_empty(text_col).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "__text")
    facts = {k: v for k, v in model.items() if k != "folder"}
    return source.mapInArrow(partial(_score, folder=model["folder"], facts=facts), f"{kinds}, n_tokens long, n_known long, base_score double, score double")


def score_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, out_fold: int = 2, min_count: int = MIN_COUNT) -> DataFrame:
    """Scores every document, learning from those whose crc32 of the id mod folds is not out_fold.

    A null id is in no fold and learnt from. Also adds perplexity (per token).
    """
    fold = F.coalesce(crc32_id(id_col) % folds == out_fold, F.lit(False))
    model = train(docs.where(~fold), text_col, min_count)
    scored = score(docs.withColumn("held_out", fold), model, [id_col, "held_out"], text_col)
    return scored.withColumn("train_tokens", F.lit(model["tokens"]).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
