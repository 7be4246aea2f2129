"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.llm.common import table
from packlens.llm.language_model import score_held_out
from packlens.llm.line_dedup import line_dedup
from packlens.llm.lines import sliced, texts
from packlens.llm.mixing import mix
from packlens.llm.nearest import nearest
from packlens.llm.packing import pack
from packlens.llm.periodic_runs import periodic_runs
from packlens.llm.quality_rules import quality_rules
from packlens.llm.simhash import simhash_groups
from packlens.llm.spelling import spelling_variants
from packlens.llm.substring_dedup import substring_dedup
from packlens.llm.token_counts import count_tokens
from packlens.llm.token_output import tokens_round_trip
from packlens.llm.tokens import tokenizer_path
from packlens.llm.toxicity import score_toxicity


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", "n_removed", "removed", "text")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_held_out(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", "text")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), with_ids=False)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_boilerplate_words", F.size("removed").alias("n_removed_lines"), "depleted")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position", "times").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), noise=97)


def repeating(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words as the query on periodic runs wants them: in a tenth of the documents a stretch of them repeats to the end."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    stretch = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (stretch * (1 + (n - a) // len(stretch)))[: n - a]


def _repeating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 256):
        ids, held = batch.column("doc_id").to_pylist(), texts(batch)
        made = [b" ".join(repeating(i, t.encode().split())).decode() for i, t in zip(ids, held, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())], names=["doc_id", "text"])


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("__text"))
    found = periodic_runs(docs.mapInArrow(_repeating, f"doc_id {dict(docs.dtypes)['doc_id']}, text string"))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", digest(told).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_substring_dedup, op2_lm_scoring, op3_token_output, op4_toxicity, op5_line_dedup, op6_nearest, op7_packing,
        op8_quality_rules, op9_simhash, op10_mixing, op11_spelling_variants, op12_periodic_runs, op13_token_counts,
    )
}

SQL: dict[str, str] = {}
