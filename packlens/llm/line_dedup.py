"""Operator 5, line dedup: log-template tree.

Each line is parsed down a tree of fixed depth (token count, leading tokens) whose leaves generalise
variable fields; templates that recur across distinct documents are dropped from all documents.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm.common import cut, opened, row_key, same_row, sealed, text_or_empty
from packlens.llm.lines import recurring, template_digest


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    depth: int = 2, fields: int = 3, min_tokens: int = 4, min_contents: int = 8, measures: bool = True,
) -> DataFrame:
    """`docs` with recurring lines cut from the text, and n_lines, n_dropped (int) added.

    A line is dropped when one of its templates stands in more than `min_contents` documents of
    distinct text (see `lines.recurring`: copies of one text count once). Lines under
    `min_tokens` tokens never are: they are too short to tell. A document that loses all lines
    stays, with an empty text. Null text stays null. Rows with equal id and text are one document. An empty table stays
    empty. Columns other than the text are passed on as they are, whatever their names; one that is named like a result
    is replaced by it. measures: False leaves n_lines and n_dropped out, and the columns as they were but for the text.
    """
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(*row_key(id_col, text_col), text_or_empty(text_col).alias("__text"))
    run = partial(template_digest, depth=depth, fields=fields, min_tokens=min_tokens)
    digest = cut(source.mapInArrow(run, f"__id {kind}, __th long, content long, leaves array<array<long>>"), "template-digest")
    # repeated rows of a document hold the same content and the same lines, so they count once
    lines = digest.select("__id", "__th", "content", F.posexplode("leaves").alias("line", "x")).where(F.size("x") > 0)
    leaves = lines.select("__id", "__th", "line", "content", F.explode("x").alias("leaf"))
    often = cut(recurring(leaves, ["leaf"], min_contents), "recurring-leaves")
    dropped = leaves.join(often, "leaf").groupBy("__id", "__th").agg(F.collect_set("line").alias("__drop"))
    keyed = sealed(docs, id_col, text_col)
    joined = keyed.join(dropped, same_row(keyed, dropped), "left").select("__row", "__drop")
    old = F.col("__row").getField(text_col)
    all_lines = F.split(old, "\n", -1)
    kept = F.filter(all_lines, lambda x, i: ~F.array_contains(F.col("__drop"), i))
    text = F.when(F.col("__drop").isNull(), old).otherwise(F.array_join(kept, "\n"))
    if not measures:
        return opened(joined, docs.columns, **{text_col: text})
    return opened(joined, docs.columns, **{text_col: text, "n_lines": F.coalesce(F.size(all_lines), F.lit(0)), "n_dropped": F.coalesce(F.size("__drop"), F.lit(0))})
