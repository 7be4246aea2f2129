"""Operator 4, toxicity: a convolutional text classifier in numpy.

Words are hashed into one embedding table and their stems of several lengths into another; filters of several widths
slide over the words, each keeps its two highest values over the text, and a logistic layer scores these maxima. It learns from
all labelled rows: they are dealt into shards, a task fits the model on a shard, and after each round the tasks' models become one by their
mean. Beside the model of all rows, a model for each part that validates is fitted without that part; scores are stretched so that 0.7 is the best
threshold by cross-validation, and a threshold is calibrated for each language besides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm.common import crc32_id, cut, row_key, text_or_empty
from packlens.llm.lines import texts

BUCKETS, HALF = 1 << 16, 8
#: Lengths of the leading characters that stand for a word's stem, so that inflected forms share embeddings.
STEMS = (4, 5, 6)
#: Words and stems that fewer of the learning texts hold have no embedding: they would single out texts, not say what is toxic.
MIN_TEXTS = 5
#: Parts of the learning rows; each is scored by a model of the others, and those scores set the thresholds.
PARTS = 3
WIDTHS, FILTERS = (1, 2, 3), 16
#: So many of a filter's highest values over a text are pooled: one word says less than two that stand apart.
TOP = 2
SEGMENT, CHUNK = 30_000, 60_000
CUT = 0.7
#: A task learns from about so many rows, or so many bytes of text, in a round; there are as many tasks as the labelled rows need.
SHARD_ROWS, SHARD_BYTES = 16_384, 60_000_000
#: Rounds over all rows: so many that a model sees about VISITS rows, repeats included, but two at least.
VISITS, ROUNDS = 48_000, (2, 8)
#: A batch of the fit ends at so many words, beside its number of rows.
BATCH_WORDS = 300_000
#: Rows of the embedding table that are summed together, and bins of validation logits to one unit.
BLOCK, BINS = 4096, 1000
#: Toxic validation rows of all languages that count as much as a language's own.
PRIOR_ROWS = 20
_SPACES = bytes(b if (48 <= b < 58 or 97 <= b < 123 or b >= 128) else 32 for b in range(256))


class WordIds(dict):
    """The buckets of a word and of its stems in one number, 16 bits each; dropped and refilled beyond a bound."""

    def __missing__(self, word: bytes) -> int:
        i, chars = xxhash.xxh64_intdigest(word) % BUCKETS, word.decode("utf-8", "replace")
        for k, n in enumerate(STEMS, 1):
            i |= xxhash.xxh64_intdigest(chars[:n].encode(), n) % BUCKETS << 16 * k
        self[word] = i
        return i

    def of(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().translate(_SPACES).split()
        if len(self) > 400_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rows_of(ids: np.ndarray) -> list[np.ndarray]:
    """Rows of the table: words in its first half, stems of all lengths in the second."""
    part = lambda k: (ids >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype(np.int64)
    return [part(0), *[BUCKETS + part(k) for k in range(1, len(STEMS) + 1)]]


def highest(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The TOP highest values of each row, highest first, and their columns; -1e9 where there are fewer. `values` is used up."""
    best, where = np.full((TOP, len(values)), -1e9, np.float32), np.zeros((TOP, len(values)), np.int64)
    rows = np.arange(len(values))
    for k in range(min(TOP, values.shape[1])):
        where[k] = values.argmax(1)
        best[k] = values[rows, where[k]]
        values[rows, where[k]] = -1e9
    return best, where


@dataclass
class Model:
    table: np.ndarray  # (2 * BUCKETS, HALF)
    filters: list[np.ndarray]  # per width (width, 2 * HALF, FILTERS)
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    stretch: float = 1.0
    shift: float = 0.0

    @classmethod
    def fresh(cls, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        f = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        n = TOP * len(WIDTHS) * FILTERS
        return cls(f(2 * BUCKETS, HALF) * 0.1, [f(w, 2 * HALF, FILTERS) * np.float32(0.6 / np.sqrt(w)) for w in WIDTHS], np.zeros(n, np.float32), f(n) * 0.1, 0.0)

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        """Of each word its own embedding, then the sum of its stems'."""
        word, *stems = rows_of(ids)
        return np.concatenate([self.table[word], sum(self.table[r] for r in stems)], axis=1)

    def responses(self, ids: np.ndarray) -> np.ndarray:
        """(filters, words): filter values at each first word, blanks after the end; before the bias."""
        x = np.ascontiguousarray(self.vectors(ids).T)
        out = np.zeros((len(WIDTHS) * FILTERS, len(ids)), np.float32)
        for k, w in enumerate(self.filters):
            for j in range(len(w)):
                if len(ids) > j:
                    out[k * FILTERS : (k + 1) * FILTERS, : len(ids) - j] += w[j].T @ x[:, j:]
        return out

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        """Of any number of texts of any length: long texts go in overlapping segments."""
        pad = max(WIDTHS) - 1
        top = np.full((len(docs), TOP, len(WIDTHS) * FILTERS), -1e9, np.float32)
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            blank = np.zeros(pad, np.uint64)
            flat = np.concatenate([y for _, x in held for y in (x, blank)])
            values = self.responses(flat)
            # a filter must not see the blank rows' embeddings, nor the next text
            ends = np.cumsum([len(x) + pad for _, x in held])
            starts = ends - np.array([len(x) + pad for _, x in held])
            values = self._masked(flat, values, starts, ends - pad)
            for (i, x), a in zip(held, starts, strict=True):
                # windows that start behind a segment are the next one's
                best, _ = highest(values[:, a : a + min(len(x), SEGMENT)])
                top[i] = np.sort(np.concatenate([top[i], best]), axis=0)[: -TOP - 1 : -1]

        for i, ids in enumerate(docs):
            for a in range(0, len(ids), SEGMENT):
                held.append((i, ids[a : a + SEGMENT + pad]))
                size += len(held[-1][1])
                if size >= CHUNK:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        return np.maximum(top.reshape(len(docs), len(self.bias)) + self.bias, 0) @ self.weights + self.offset

    def _masked(self, flat: np.ndarray, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        for k, w in enumerate(WIDTHS):
            for back in range(1, max(WIDTHS)):
                if back < w:  # windows that would reach over the end
                    at = ends - back
                    values[k * FILTERS : (k + 1) * FILTERS, at[at >= starts]] = -1e9
        for j in range(max(WIDTHS) - 1):
            values[:, ends + j] = -1e9
        return values

    def scaled(self, logits: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1; the shift is the logit of 0.7."""
        z = self.stretch * (logits.astype(np.float64) - self.shift) + np.log(CUT / (1 - CUT))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        return np.where(np.array([len(d) > 0 for d in docs], bool), self.scaled(self.logits(docs)), 0.0)


@dataclass
class State:
    """A model while it is fitted, with Adam's moments of the dense layers and Adagrad's sums of the embeddings."""

    model: Model
    first: list[np.ndarray]
    second: list[np.ndarray]
    gathered: np.ndarray
    known: np.ndarray  # rows of the table that enough texts hold
    step: int = 0

    @classmethod
    def fresh(cls, held_by: np.ndarray, seed: int = 11) -> State:
        m, known = Model.fresh(seed), held_by >= MIN_TEXTS
        m.table[~known] = 0
        dense = [*m.filters, m.bias, m.weights]
        return cls(m, [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense], np.full(m.table.shape, 1e-4, np.float32), known)

    def copy(self) -> State:
        """What a broadcast holds belongs to all tasks of a worker."""
        m = self.model
        own = Model(m.table.copy(), [p.copy() for p in m.filters], m.bias.copy(), m.weights.copy(), m.offset)
        return State(own, [p.copy() for p in self.first], [p.copy() for p in self.second], self.gathered.copy(), self.known, self.step)

    def dense(self) -> np.ndarray:
        m = self.model
        parts = [*m.filters, m.bias, m.weights, *self.first, *self.second, np.array([m.offset, self.step])]
        return np.concatenate([np.ravel(p) for p in parts]).astype(np.float32)

    def set_dense(self, values: np.ndarray) -> None:
        m, at = self.model, 0
        for p in (*m.filters, m.bias, m.weights, *self.first, *self.second):
            p[...] = values[at : at + p.size].reshape(p.shape)
            at += p.size
        m.offset, self.step = float(values[at]), round(float(values[at + 1]))


def held(docs: list[np.ndarray]) -> np.ndarray:
    """How many texts hold a word or stem of each row of the table."""
    found, last = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
    for d in docs:
        rows = np.concatenate(rows_of(d))
        last[rows] = at = np.arange(len(rows))
        found[rows[last[rows] == at]] += 1  # of equal rows one remains
    return found


def fit(docs: list[np.ndarray], y: np.ndarray, state: State, epochs: int = 1, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
    """Adam on the dense layers, Adagrad on the touched embedding rows; gradients flow through maxima only."""
    m, rng, gathered = state.model, np.random.default_rng(seed), state.gathered
    dense, first, second = [*m.filters, m.bias, m.weights], state.first, state.second
    docs = [d if len(d) else np.zeros(1, np.uint64) for d in docs]
    sizes = np.array([len(d) for d in docs])
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        lo = 0
        while lo < len(order):
            own = order[lo : lo + batch]
            own = own[: max(1, int(np.searchsorted(np.cumsum(sizes[own]), BATCH_WORDS, "right")))]
            lo += len(own)
            lengths = np.array([len(docs[i]) for i in own])
            pad = max(WIDTHS) - 1
            flat = np.concatenate([np.concatenate([docs[i], np.zeros(pad, np.uint64)]) for i in own])
            ends = np.cumsum(lengths + pad)
            starts, ends = ends - lengths - pad, ends - pad
            values = m._masked(flat, m.responses(flat), starts, ends)
            found = [highest(values[:, a:b]) for a, b in zip(starts, ends, strict=True)]
            pre = np.stack([best.ravel() for best, _ in found]) + m.bias
            where = np.stack([a + columns.ravel() for a, (_, columns) in zip(starts, found, strict=True)])
            top = np.maximum(pre, 0)
            z = np.clip(top @ m.weights + m.offset, -30, 30)
            error = (1 / (1 + np.exp(-z)) - y[own]) / len(own)
            back = (error[:, None] * m.weights) * (pre > 0)
            grads = [np.zeros_like(p) for p in dense]
            grads[-2], grads[-1] = back.sum(0), top.T @ error + 1e-5 * m.weights
            rows, deltas = [], []
            for n in range(TOP * len(WIDTHS)):
                k, w = n % len(WIDTHS), WIDTHS[n % len(WIDTHS)]
                b, at = back[:, n * FILTERS : (n + 1) * FILTERS], where[:, n * FILTERS : (n + 1) * FILTERS]
                for j in range(w):
                    ids = flat[np.minimum(at + j, len(flat) - 1)]
                    x = m.vectors(ids.ravel()).reshape(*ids.shape, 2 * HALF)
                    grads[k][j] += np.einsum("df,dfe->ef", b, x)
                    i, e = np.nonzero(b)
                    delta = b[i, e, None] * m.filters[k][j].T[e]
                    rows += rows_of(ids[i, e])
                    deltas += [delta[:, :HALF], *[delta[:, HALF:]] * len(STEMS)]
            state.step += 1
            for p, g, a, v in zip(dense, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                v += 0.01 * (g * g - v)
                p -= (rate * (a / (1 - 0.9**state.step)) / (np.sqrt(v / (1 - 0.99**state.step)) + 1e-8)).astype(np.float32)
            m.offset -= rate * float(error.sum())
            rows = np.concatenate(rows)
            by_row = np.argsort(rows, kind="stable")
            touched, firsts = np.unique(rows[by_row], return_index=True)
            if not len(touched):
                continue
            sums = np.add.reduceat(np.concatenate(deltas)[by_row], firsts, axis=0)
            known = state.known[touched]
            touched, sums = touched[known], sums[known]
            gathered[touched] += sums * sums
            m.table[touched] -= 0.1 * sums / np.sqrt(gathered[touched])


def best_threshold(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the best F1 of weighted rows; midway between two scores. Without positives, above all."""
    order = np.argsort(-score, kind="stable")
    hit, seen = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    if not len(score) or not hit[-1]:
        return float(score.max(initial=0.0)) + 1.0
    f1 = 2 * hit / (seen + hit[-1])
    ordered = score[order]
    f1[:-1][ordered[:-1] == ordered[1:]] = -1  # equal scores cannot be parted
    i = int(np.argmax(f1))
    return float((ordered[i] + ordered[min(i + 1, len(ordered) - 1)]) / 2) if i + 1 < len(ordered) else float(ordered[i])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word ids of the texts, compressed."""
    memo, zstd = WordIds(), pa.Codec("zstd")
    for batch in batches:
        names = [n for n in batch.schema.names if n != "__text"]
        ids = [memo.of(t) for t in texts(batch)]
        found = [pa.array([len(x) for x in ids], pa.int64()), pa.array([zstd.compress(x.tobytes(), asbytes=True) for x in ids], pa.binary())]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *found], names=[*names, "words", "ids"])


def _unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    zstd = pa.Codec("zstd")
    return [np.frombuffer(zstd.decompress(x, 8 * n, asbytes=True), np.uint64) for x, n in zip(batch.column("ids").to_pylist(), batch.column("words").to_pylist(), strict=True)]


def _shard(batches: Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray], np.ndarray, int]:
    """The texts of a partition and their labels in the order by hash, and the shard's number."""
    docs, y, order, shard = [], [], [], 0
    for batch in batches:
        docs += _unpacked(batch)
        y += batch.column("toxic").to_pylist()
        order += batch.column("order").to_pylist()
        shard = batch.column("shard")[0].as_py() if batch.num_rows else shard
    at = np.argsort(np.array(order, np.int64), kind="stable")
    return [docs[i] for i in at], np.array(y, np.float32)[at], shard


PIECE = "model int, block int, type string, rows binary, n binary, sums binary"


def _piece(model: int, block: int, rows: np.ndarray, n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """n: how often each row counts, or one number for all rows."""
    raw = [pa.array([x.tobytes()], pa.binary()) for x in (rows.astype(np.int32), n.astype(np.float32), sums)]
    return pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), pa.array([block], pa.int32()), pa.array([sums.dtype.str]), *raw], names=["model", "block", "type", "rows", "n", "sums"])


def _pieces(model: int, rows: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Values of some rows of the table, cut into blocks. rows ascend."""
    for block in np.unique(rows // BLOCK):
        a, b = np.searchsorted(rows, (block * BLOCK, (block + 1) * BLOCK))
        yield _piece(model, int(block), rows[a:b], np.ones(1), sums[a:b])


def _read(raw: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.frombuffer(raw[1], np.int32)
    return rows, np.frombuffer(raw[2], np.float32), np.frombuffer(raw[3], raw[0]).reshape(len(rows), -1)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One piece for each model and block: how many pieces held a row, and the sum of its values."""
    held_: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for model, block, *raw in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
            rows, n, sums = _read(raw)
            first = max(0, block) * BLOCK
            if (model, block) not in held_:
                size = BLOCK if block >= 0 else len(rows)
                held_[model, block] = np.zeros(size), np.zeros((size, sums.shape[1]))
            total = held_[model, block]
            total[0][rows - first] += n
            total[1][rows - first] += sums
    for (model, block), (n, sums) in held_.items():
        at = np.flatnonzero(n)
        yield _piece(model, block, at + max(0, block) * BLOCK, n[at], sums[at].astype(np.float32))


def _summed(each: list[DataFrame]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(model, block, rows, pieces that held them, sums) of all pieces; they are added in tasks, the driver gets the sums: a model's size, whatever the input."""
    pieces = reduce(DataFrame.union, each).repartition("model", "block").mapInArrow(_added, PIECE)
    for model, block, *raw in zip(*pieces.toArrow().to_pydict().values(), strict=True):
        yield model, block, *_read(raw)


def _counts(rows: DataFrame) -> np.ndarray:
    """(part, row of the table): texts of the part that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((PARTS, 2 * BUCKETS), np.int64)
        for batch in batches:
            docs, part = _unpacked(batch), np.array(batch.column("part").to_pylist())
            for k in range(PARTS):
                found[k] += held([docs[i] for i in np.flatnonzero(part == k)])
        for k in range(PARTS):
            at = np.flatnonzero(found[k])
            yield from _pieces(k, at, found[k][at, None].astype(np.float32))

    counts = np.zeros((PARTS, 2 * BUCKETS), np.int64)
    for k, _, at, _, sums in _summed([rows.mapInArrow(run, PIECE)]):
        counts[k, at] = sums[:, 0]
    return counts


def _round(rows: DataFrame, states: list[State], epochs: int, seed: int) -> None:
    """Each model goes over its rows, a task a shard, and becomes the mean of the tasks' models; of an embedding those count that changed it."""

    def learn(k: int, sent) -> Callable:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            docs, y, shard = _shard(batches)
            if not docs:
                return
            old, new = sent.value, sent.value.copy()
            fit(docs, y, new, epochs, seed=seed + shard)
            at = np.flatnonzero((new.gathered != old.gathered).any(axis=1))
            # what changed goes in half precision; of sums of squares the roots
            yield from _pieces(k, at, np.concatenate([new.model.table[at] - old.model.table[at], np.sqrt(new.gathered[at] - old.gathered[at])], axis=1).astype(np.float16))
            dense = new.dense()
            yield _piece(k, -1, np.arange(len(dense)), np.full(1, len(docs)), dense[:, None] * np.float32(len(docs)))

        return run

    sent = [rows.sparkSession.sparkContext.broadcast(s) for s in states]
    for k, block, at, n, sums in _summed([rows.where(F.col("part") != k).mapInArrow(learn(k, sent[k]), PIECE) for k in range(len(states))]):
        mean = (sums / n[:, None]).astype(np.float32)
        if block < 0:
            states[k].set_dense(mean[:, 0])
        else:
            states[k].model.table[at] += mean[:, :HALF]
            states[k].gathered[at] += mean[:, HALF:] ** 2
    for b in sent:
        b.destroy()


def _validated(rows: DataFrame, models: list[Model]) -> list[tuple[str, int, int, int]]:
    """(language, label, logit in bins, rows) of all rows, each scored by the model that did not learn from its part."""

    def scored(sent) -> Callable:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                z = np.clip(sent.value.logits(_unpacked(batch)), -1000, 1000) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("toxic"), pa.array(np.round(z * BINS).astype(np.int64))], names=["lang", "toxic", "bin"])

        return run

    sent = [rows.sparkSession.sparkContext.broadcast(m) for m in models]
    each = [rows.where(F.col("part") == k).mapInArrow(scored(b), "lang string, toxic int, bin long") for k, b in enumerate(sent)]
    found = [(r[0], r[1], r[2], r[3]) for r in reduce(DataFrame.union, each).groupBy(F.coalesce("lang", F.lit("")), "toxic", "bin").count().collect()]
    for b in sent:
        b.destroy()
    return found


def _with_texts(docs: DataFrame, known: DataFrame, n: int, shards: int) -> DataFrame:
    """The texts of the known rows beside their labels, a partition a shard. Most texts without a label are left out before the shuffle, by a
    bitmap of hashed keys (two bytes a known row, 8 MB at most); the join decides."""
    bits = 1 << min(26, max(16, (16 * n).bit_length()))
    bit = 1 + F.pmod(F.xxhash64("__id", "__th"), F.lit(bits))
    maps = known.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("__map"))
    some = docs.withColumn("__bucket", F.bitmap_bucket_number(bit)).withColumn("__at", F.bitmap_bit_position(bit).cast("int")).join(F.broadcast(maps), "__bucket")
    byte = F.conv(F.hex(F.expr("substring(__map, cast(__at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    some = some.where(byte.bitwiseAND(F.expr("shiftleft(1, __at % 8)")) != 0).select("__id", "__th", "__l", "__text")
    keys = ["__id", "__th"]
    # repeated rows of a document are one
    one = some.join(known.select(*keys, "__y", "part"), keys).groupBy(*keys).agg(
        F.max("__y").alias("toxic"), F.max("part").alias("part"), F.min("__l").alias("lang"), F.min("__text").alias("__text"))
    packed = one.select("lang", "toxic", "part", F.xxhash64(*keys, F.lit("sample")).alias("order"), "__text").mapInArrow(
        _packed, "lang string, toxic int, part int, order long, words long, ids binary")
    # numbers that hash to each of the partitions once, so that each shard has its own
    spread = known.sparkSession.range(20 * shards + 20).groupBy(F.pmod(F.hash("id"), F.lit(shards))).agg(F.min("id")).collect()
    numbers = sorted(r[1] for r in spread)
    shard = F.element_at(F.array(*map(F.lit, numbers)), F.pmod("order", F.lit(len(numbers))).cast("int") + 1)
    return packed.withColumn("shard", shard.cast("long")).repartition(shards, "shard")


def train(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES) -> tuple[Model, dict[str, float]]:
    """Fits on all labelled documents.

    docs: __id, __th, __l, __text; labels: __id, __y (0 or 1), one row an id. The documents are dealt into shards of about shard_rows rows and
    shard_bytes of text, and a task learns from one. With more than one shard, the first alone makes the models with which all of them
    begin. The documents are also dealt into PARTS parts, and a model of the other parts scores each; those scores set the
    stretch and the thresholds by language of the model of them all. A language's
    threshold is the best one of its own rows and those of all languages together, which count less the more toxic rows it has itself.
    Unless two parts hold each label, all scores stay below 0.7.
    """
    slim = docs.where(F.col("__id").isNotNull()).groupBy("__id", "__th").agg(F.max(F.octet_length("__text")).alias("bytes"))
    part = F.pmod(F.xxhash64("__id", F.lit("part")), F.lit(PARTS)).cast("int").alias("part")
    known = cut(slim.join(labels, "__id").select("__id", "__th", "__y", "bytes", part), "labelled")
    totals = known.groupBy("__y", "part").agg(F.count("*"), F.sum("bytes")).collect()
    n, size = sum(r[2] for r in totals), sum(r[3] for r in totals)
    if min(sum(r[0] == label for r in totals) for label in (0, 1)) < 2:
        m = Model.fresh(0)
        m.stretch, m.shift = 0.0, 0.0
        m.weights[:] = 0
        return _quiet(m), {}
    shards = max(1, -(-n // shard_rows), -(-size // shard_bytes))
    rows = _with_texts(docs, known, n, shards).persist(StorageLevel.DISK_ONLY)
    counts = _counts(rows)
    states = [State.fresh(counts.sum(axis=0) - own) for own in (*counts, 0)]
    rounds = min(ROUNDS[1], max(ROUNDS[0], VISITS // n))
    if shards == 1:
        _round(rows, states, rounds, 11)
    else:
        _round(rows.where(F.col("shard") == rows.agg(F.min("shard")).first()[0]), states, 1, 11)
        for r in range(1, rounds + 1):
            _round(rows, states, 1, 11 + r * shards)
    m = states[PARTS].model
    found = _validated(rows, [s.model for s in states[:PARTS]])
    rows.unpersist()
    langs, y = np.array([f[0] for f in found]), np.array([f[1] for f in found], np.float64)
    z, weight = np.array([f[2] / BINS for f in found]), np.array([f[3] for f in found], np.float64)
    m.shift = best_threshold(z, y, weight)
    m.stretch = 2.0 / max(0.5, float(np.sqrt(np.cov(z, aweights=weight, ddof=0))))
    score = m.scaled(z)
    cuts = {}
    for lang in sorted(set(langs)):
        own = langs == lang
        prior = PRIOR_ROWS / (PRIOR_ROWS + (weight * y)[own].sum())
        cuts[str(lang)] = best_threshold(score, y, weight * np.where(own, 1.0, prior))
    return m, cuts


def _quiet(m: Model) -> Model:
    m.stretch, m.shift, m.offset = 1.0, 5.0, 0.0
    return m


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    label_col: str = "toxic", folds: int = 3, out_fold: int = 1, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """id, held_out, score, predicted (score >= 0.7), threshold and flagged (by language).

    Learns from all labelled rows whose crc32 of the id mod folds is not out_fold; a task holds about shard_rows of them and texts of about
    shard_bytes. Only the text enters a score; texts of any length are read whole, in segments of bounded size. Null and empty texts and others without words have score 0. Rows with a null id are not held
    out. A language without labelled rows has the threshold 0.7. An empty table stays empty; columns pass neither in nor out but
    those named here, so no name can clash. Repeated rows are scored each;
    an id that is labelled both ways counts as toxic.
    """
    fold = F.coalesce(crc32_id(id_col) % folds == out_fold, F.lit(False))
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__y"))
    learn = docs.where(~fold).select(*row_key(id_col, text_col), F.col(lang_col).cast("string").alias("__l"), text_or_empty(text_col).alias("__text"))
    model, cuts = train(learn, known, shard_rows, shard_bytes)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB and some, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordIds()
        for batch in batches:
            scores = sent.value.score([memo.of(t) for t in texts(batch)])
            kept = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(scores, pa.float64())], names=[*kept, "score"])

    source = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("__lang"), fold.alias("held_out"), text_or_empty(text_col).alias("__text"))
    scored = source.mapInArrow(run, f"__id {dict(docs.dtypes)[id_col]}, __lang string, held_out boolean, score double")
    threshold = F.lit(CUT)
    for lang, at in cuts.items():
        threshold = F.when(F.coalesce("__lang", F.lit("")) == lang, F.lit(at)).otherwise(threshold)
    return scored.select(F.col("__id").alias(id_col), "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), threshold.alias("threshold"), (F.col("score") >= threshold).alias("flagged"))
