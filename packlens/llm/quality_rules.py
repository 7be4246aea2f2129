"""Operator 8, quality rules: cross-document line frequency.

Every normalised line is hashed; per host the distinct documents that hold it are counted; lines above
the limit are removed, and a document that loses most of its words is depleted and rejected. A few
base rules on the text itself (length, repetition) reject a document before that.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm.common import cut, opened, row_key, same_row, sealed, text_or_empty
from packlens.llm.lines import columns, content_of, normalised, recurring, signed, sliced, texts

MIN_WORDS = 20
WINDOW = 8
MAX_REPEATED_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"
#: Stands for a null host.
NO_HOST = "\x00null"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a run of `window` words which the list holds at least twice. Exact.

    Runs get ranks by doubling: the rank of 2k words is that of the pair of ranks of k words.
    """
    n = len(words)
    if n <= window or window & (window - 1):
        return _repeated_plain(words, window)
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    width = 1
    while width < window:
        pairs = rank[:-width] * np.int64(n + 1) + rank[width:]
        distinct, rank = np.unique(pairs, return_inverse=True)
        width *= 2
        if len(distinct) == len(pairs):
            return 0
    twice = np.bincount(rank)[rank] > 1
    marks = np.zeros(n + 1, np.int64)
    marks[: len(twice)] += twice
    marks[window : window + len(twice)] -= twice
    return int((np.cumsum(marks[:n]) > 0).sum())


def _repeated_plain(words: list[bytes], window: int) -> int:
    runs = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    seen, inside = Counter(runs), set()
    for i, run in enumerate(runs):
        if seen[run] > 1:
            inside.update(range(i, i + window))
    return len(inside)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content"]
    kinds = {n: pa.int64() for n in longs} | {"lines": pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32()), ("at", pa.list_(pa.int32()))]))}
    for batch in sliced(batches):
        got: dict[str, list] = {n: [] for n in kinds}
        for text in texts(batch):
            raw = text.encode("utf-8", "surrogatepass")
            words = raw.split()
            got["n_words"].append(len(words))
            got["word_chars"].append(len(text) - (len(raw) - len(raw.translate(None, BLANKS))))
            got["n_symbols"].append(len(raw) - len(raw.translate(None, SYMBOLS)))
            full = [x for x in raw.split(b"\n") if x.translate(None, BLANKS)]
            got["n_dup_lines"].append(len(full) - len(set(full)))
            got["n_repeat_words"].append(repeated_words(words))
            full = normalised(text)
            own: dict[bytes, list[int]] = {}
            for i, x in enumerate(full):
                if x:
                    own.setdefault(x, []).append(i)
            got["content"].append(content_of(full))
            got["lines"].append([{"h": signed(xxhash.xxh64_intdigest(x)), "w": x.count(b" ") + 1, "at": at} for x, at in own.items()])
        yield columns(batch, kinds, got)


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    max_docs_per_host: int = 20, min_words_left_percent: int = 30,
) -> DataFrame:
    """One verdict a document row: measures, removed (numbers of the lines that go, from 0), base_failed, depleted, kept.

    max_docs_per_host: a line is removed when more documents of distinct text on its host hold
    it (`lines.recurring`). min_words_left_percent: a document is depleted when removal leaves a
    smaller share of its words. Null hosts are a host of their own. Null and empty texts have no
    words, fail the base rules and are rejected. Rows with equal id and text are one document and
    get one verdict each; an empty table gives no rows. A text of any length is held whole by one task. Extra columns are not read.
    """
    source = docs.select(*row_key(id_col, text_col), F.col(host_col).cast("string").alias("__host"), text_or_empty(text_col).alias("__text"))
    longs = ", ".join(f"{n} long" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content"))
    kind = dict(docs.dtypes)[id_col]
    digest = source.mapInArrow(_measure, f"__id {kind}, __th long, __host string, {longs}, lines array<struct<h: long, w: int, at: array<int>>>")
    digest = cut(digest, "quality-digest")
    lines = digest.select(
        "__id", "__th", F.coalesce("__host", F.lit(NO_HOST)).alias("host"), "content", F.explode("lines").alias("x")
    ).select("__id", "__th", "host", F.col("x.h").alias("h"), F.col("x.w").alias("w"), F.col("x.at").alias("at"), "content")
    often = cut(recurring(lines, ["host", "h"], max_docs_per_host), "recurring-lines")
    # repeated rows of a document count once
    found = lines.join(often, ["host", "h"]).dropDuplicates(["__id", "__th", "host", "h"])
    lost = found.groupBy("__id", "__th", "host").agg(F.sum(F.col("w") * F.size("at")).alias("lost"), F.array_sort(F.flatten(F.collect_list("at"))).alias("removed"))
    a, b = digest.withColumn("host", F.coalesce("__host", F.lit(NO_HOST))), lost
    joined = a.join(b, same_row(a, b) & (a["host"] == b["host"]), "left").select(
        a["__id"].alias(id_col), a["__th"], a["__host"], *[a[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.coalesce(b["lost"], F.lit(0)).alias("n_boilerplate_words"), F.coalesce(b["removed"], F.array().cast("array<int>")).alias("removed"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("n_boilerplate_words")
    depleted = 100 * left < min_words_left_percent * F.col("n_words")
    return joined.withColumn("base_failed", failed).withColumn("depleted", depleted).withColumn("kept", ~failed & ~depleted)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns, and their texts without the lines that the rules remove."""
    verdicts = quality_rules(docs, id_col, text_col, host_col, **limits).where(~F.col("kept") | (F.size("removed") > 0))
    changes = verdicts.select(F.col(id_col).alias("__id"), "__th", F.coalesce("__host", F.lit(NO_HOST)).alias("__hk"), F.col("kept").alias("__kept"), F.col("removed").alias("__removed"))
    changes = changes.dropDuplicates(["__id", "__th", "__hk"])
    keyed = sealed(docs, id_col, text_col, __hk=F.coalesce(F.col(host_col).cast("string"), F.lit(NO_HOST)))
    joined = keyed.join(changes, same_row(keyed, changes) & (keyed["__hk"] == changes["__hk"]), "left").where(F.coalesce("__kept", F.lit(True)))
    old = F.col("__row").getField(text_col)
    stay = F.filter(F.split(old, "\n", -1), lambda x, i: ~F.array_contains(F.col("__removed"), i))
    text = F.when(F.coalesce(F.size("__removed"), F.lit(0)) > 0, F.array_join(stay, "\n")).otherwise(old)
    return opened(joined.select("__row", "__removed"), docs.columns, **{text_col: text})
