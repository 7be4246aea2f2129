"""What the training-data operators share: words, row keys, written tables, running totals."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters that are none of these six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Order within a group is dealt into this many hash buckets at least, and four for each shuffle partition.
BUCKETS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where the session names none and runs in one process (local tests) a temporary folder is made
    and set; on a cluster a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="packlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Key of a document row. Rows with equal id and equal text are the same document."""
    return [F.col(id_col).alias("__id"), F.xxhash64(text_or_empty(text_col)).alias("__th")]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sealed(docs: DataFrame, id_col: str, text_col: str, **more: Column) -> DataFrame:
    """`docs` as one struct column __row beside __id, __th and `more`: no name of a user's column can clash."""
    everything = F.struct(*[docs[quoted(c)] for c in docs.columns])
    return docs.select(everything.alias("__row"), *row_key(id_col, text_col), *[c.alias(n) for n, c in more.items()])


def opened(rows: DataFrame, columns: Sequence[str], **more: Column) -> DataFrame:
    """The columns of `sealed` rows again, and `more`: a column of the same name is put in the place of the old one."""
    old = [more[c] if c in more else F.col("__row").getField(c) for c in columns]
    new = [c.alias(n) for n, c in more.items() if n not in columns]
    return rows.select(*[c.alias(n) for c, n in zip(old, columns, strict=True)], *new)


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["__id"].eqNullSafe(right["__id"]) & (left["__th"] == right["__th"])


def crc32_id(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def group_keys(group: Sequence[str]) -> list[Column]:
    """Columns that are equal for rows of a group, nulls included."""
    texts = [F.coalesce(F.col(g).cast("string"), F.lit("")).alias(f"__g{i}") for i, g in enumerate(group)]
    return texts + [F.col(g).isNull().alias(f"__n{i}") for i, g in enumerate(group)]


def running_before(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str, sums_from: DataFrame | None = None, beside: DataFrame | None = None) -> DataFrame:
    """Adds the sum of `value` over the rows before this one in its group, in an order by hash.

    The order is (bucket of the hash of `order`, that hash, `order`). Sums are taken per (group, bucket),
    one small row a bucket and group meets in a window, and rows are ordered within a bucket
    only: a group with a third of all rows is spread over all buckets, whose number follows the partitions. df is read twice unless
    `sums_from` has its group, order and value columns in a cheaper table. Nulls form a group of
    their own; a null value counts 0. beside: a row a group of further columns to add; its group columns are named as in `group_keys`. They come with
    the sums before a row, so df is shuffled once.
    """
    group = list(group)
    buckets = max(BUCKETS, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = group_keys(group)
    names = [f"__g{i}" for i in range(len(group))] + [f"__n{i}" for i in range(len(group))]

    def dealt(some: DataFrame) -> DataFrame:
        some = some.withColumn("__h", F.xxhash64(*order)).withColumn("__b", F.pmod("__h", F.lit(buckets)).cast("int"))
        return some.withColumn("__v", F.coalesce(F.col(value).cast("long"), F.lit(0))).select("*", *keys)

    rows, sums = dealt(df), dealt(df if sums_from is None else sums_from)
    sums = sums.groupBy(*names, "__b").agg(F.sum("__v").alias("__s"))
    before = Window.partitionBy(*names).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*names, "__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    if beside is not None:
        offsets = offsets.join(beside, names, "left")
    inside = Window.partitionBy(*names, "__b").orderBy("__h", *order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(offsets, [*names, "__b"])
    total = F.col("__o") + F.coalesce(F.sum("__v").over(inside), F.lit(0))
    return joined.withColumn(out, total).drop("__h", "__b", "__v", "__o", *names)
