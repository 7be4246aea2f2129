"""A training corpus from `documents`: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and reread as
the next stage's documents. Stages before the last return the columns of `docs`; where a stage
changes a text, n_chars follows. Mixing returns a document once for each time that it is taken, so packing packs it as often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.llm.common import cut, quoted, table
from packlens.llm.line_dedup import line_dedup
from packlens.llm.mixing import mixed_documents
from packlens.llm.near_copies import near_groups
from packlens.llm.packing import pack
from packlens.llm.quality_rules import keep_good
from packlens.llm.simhash import drop_near_duplicates
from packlens.llm.tokens import tokenizer_path
from packlens.ship import ship

#: Near-duplicates in the pipeline are judged on shingles of five words.
SHINGLE = 5
TOKENIZER = "byte_bpe_50k.json"


def _sized(df: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" not in columns:
        return df
    return df.withColumn("n_chars", F.length("text").cast(dict(df.dtypes)["n_chars"])).select(*[quoted(c) for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or that host-wide lines deplete, go; host-wide lines go from the texts of the others.

    Null and empty texts go, as too short; null sources are a host of their own; repeated rows share one verdict; an empty table stays empty.
    """
    ship(spark)
    return _sized(keep_good(docs), docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from the texts; every document stays, one that loses all lines with an empty text.

    Null texts stay null; repeated rows get the same text; an empty table stays empty.
    """
    ship(spark)
    return _sized(line_dedup(docs, measures=False), docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard 0.8 or more) stays: the one with the smallest id.

    Texts without words are alike, null or empty; repeated rows become one; null ids stay only where their group has no id; an empty
    table stays empty.
    """
    ship(spark)
    return drop_near_duplicates(docs, find=near_groups, shingle=SHINGLE)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole, by training position.

    Null and empty texts have no words and are not taken; null sources are a source, the last one; repeated rows are documents of their own;
    ties of the shuffle go by size; an empty table stays empty.
    """
    ship(spark)
    return _sized(mixed_documents(docs), docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences: every id of every row, repeated rows included, in one piece.

    Null and empty texts are the end id alone; an empty table gives no rows.
    """
    ship(spark)
    return pack(docs, tokenizer_path(TOKENIZER), with_ids=False)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_stage),
    ("mixing to target weights", mix_stage),
    ("packing", pack_stage),
]

#: Fingerprints, connected components and tokens cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
