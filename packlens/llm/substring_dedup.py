"""Operator 1, substring dedup: sliding sentence spans.

Every run of several consecutive sentences is hashed, equal hashes meet globally, and the sentences
that a non-first occurrence of a repeated run covers are removed. A sentence of many words is cut
further at words that their own hash marks, so that a passage without full stops holds runs too,
wherever it stands.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from packlens.llm.common import cut, opened, row_key, same_row, sealed, text_or_empty
from packlens.llm.lines import signed, sliced, texts

_END = re.compile(r"(?<=[.!?])(?=[ \t\n\r])|(?<=\n)(?=[^\n])")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words beyond which a sentence is cut further: before a word that its hash marks (one in MARK), or at LONG words.
LONG, MARK = 24, 8


def pieces(text: str) -> list[str]:
    """Sentences, long ones in parts; their concatenation is the text."""
    out: list[str] = []
    for p in _END.split(text):
        if len(p) <= 2 * LONG or len(p.split()) <= LONG:
            out.append(p)
            continue
        at = words = 0
        for m in _WORD.finditer(p):
            if words and (words >= LONG or zlib.crc32(m[0].lower().encode("utf-8", "surrogatepass")) % MARK == 0):
                out.append(p[at : m.start()])
                at, words = m.start(), 0
            words += 1
        out.append(p[at:])
    return out


def sentences(text: str) -> list[tuple[int, bytes]]:
    """(index of the piece, normalised words) of the pieces that have a word."""
    cut_up = ((i, b" ".join(p.encode("utf-8", "surrogatepass").lower().split())) for i, p in enumerate(pieces(text)))
    return [(i, words) for i, words in cut_up if words]


def runs(own: list[tuple[int, bytes]], span: int, min_words: int) -> list[tuple[int, int, int]]:
    """(hash, first sentence, sentences) of the run that starts at each sentence.

    A run has `span` sentences, and more until it has min_words words; one that the text is too
    short for is left out.
    """
    counts = [w.count(b" ") + 1 for _, w in own]
    out = []
    n = words = 0  # the run of the sentence before, without its first, is where this one begins
    for i in range(len(own)):
        while i + n < len(own) and (n < span or words < min_words):
            words += counts[i + n]
            n += 1
        if n < span or words < min_words:
            break
        out.append((signed(xxhash.xxh64_intdigest(b"\n".join(w for _, w in own[i : i + n]))), i, n))
        n, words = n - 1, words - counts[i]
    return out


def _spans(batches: Iterator[pa.RecordBatch], span: int, min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        counts, ends, flat = [], [0], []
        for text in texts(batch):
            own = sentences(text)
            counts.append(len(own))
            flat += runs(own, span, min_words)
            ends.append(len(flat))
        h, at, n = (np.fromiter((r[i] for r in flat), kind, len(flat)) for i, kind in enumerate((np.int64, np.int32, np.int32)))
        found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(h), pa.array(at), pa.array(n)], ["h", "at", "n"]))
        yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__th"), pa.array(counts, pa.int32()), found], names=["__id", "__th", "n_sentences", "runs"])


def _cut_out(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """Only texts that lose a sentence are cut up again."""
    for batch in sliced(batches):
        old, cover = batch.column("__row").field(text_col), batch.column("__cover")
        hit = cover.is_valid()
        where = pa.array(np.flatnonzero(hit.to_numpy(zero_copy_only=False)))
        new, gone = [], []
        for text, covered in zip(old.take(where).to_pylist(), cover.take(where).to_pylist(), strict=True):
            own, all_pieces = sentences(text), pieces(text)
            gone.append(sorted({own[i][0] for i in covered}))
            dropped = set(gone[-1])
            new.append("".join(p for i, p in enumerate(all_pieces) if i not in dropped))
        removed: list[list[int]] = [[]] * batch.num_rows
        for i, g in zip(where.to_pylist(), gone, strict=True):
            removed[i] = g
        text = pc.replace_with_mask(old, hit, pa.array(new, old.type)) if new else old
        yield pa.RecordBatch.from_arrays([batch.column("__row"), text, batch.column("__n"), pa.array(removed, pa.list_(pa.int32()))], names=["__row", "__new", "__n", "__gone"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 2, min_words: int = 25) -> DataFrame:
    """`docs` with the repeated spans cut from the text, and n_sentences, n_removed, removed (indexes of `pieces`).

    A run has at least `span` sentences and min_words words, so what is shorter is never removed, an exact copy of a
    shorter text included. The first occurrence, by (id, text hash, sentence) with null ids first, stays; all others lose
    the sentences that the run covers, within one document too. Sentences are compared by their words,
    A-Z lower-cased. Null text stays null, an empty one has no sentence. Rows with equal id and
    text are one document and get the same text. An empty table stays empty. Columns other than the text pass as they
    are, whatever their names; one that is named like a result is replaced by it.
    """
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(*row_key(id_col, text_col), text_or_empty(text_col).alias("__text"))
    digest = cut(source.mapInArrow(partial(_spans, span=span, min_words=min_words), f"__id {kind}, __th long, n_sentences int, runs array<struct<h: long, at: int, n: int>>"), "spans")
    each = digest.select("__id", "__th", F.explode("runs").alias("r"))
    each = each.select("__id", "__th", F.col("r.h").alias("h"), F.col("r.at").alias("at"), F.col("r.n").alias("n"))
    place = F.struct("__id", "__th", "at")
    # repeated rows of one document give equal places, which do not make a run repeated. Written, so that the join
    # below is one of two plain shuffles and Spark splits a run that a third of all rows hold
    bounds = each.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = cut(bounds.where(~F.col("first").eqNullSafe(F.col("last"))).select("h", "first"), "repeated-runs")
    again = each.join(repeated.hint("merge"), "h").where(~place.eqNullSafe(F.col("first")))
    covered = again.groupBy("__id", "__th").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + F.col("n") - 1)))).alias("__cover"))
    # small rows of the documents, repeated ones once
    about = digest.groupBy("__id", "__th").agg(F.max("n_sentences").alias("__n"))
    marks = about.join(covered, same_row(about, covered), "left").select(about["__id"], about["__th"], "__n", "__cover")
    keyed = sealed(docs, id_col, text_col)
    joined = keyed.join(marks, same_row(keyed, marks), "left").select("__row", "__n", "__cover")
    out = StructType([
        StructField("__row", keyed.schema["__row"].dataType), StructField("__new", StringType()), StructField("__n", IntegerType()),
        StructField("__gone", ArrayType(IntegerType()))])
    done = joined.mapInArrow(partial(_cut_out, text_col=text_col), out)
    return opened(done, docs.columns, **{text_col: F.col("__new"), "n_sentences": F.coalesce("__n", F.lit(0)), "n_removed": F.size("__gone"), "removed": F.col("__gone")})
