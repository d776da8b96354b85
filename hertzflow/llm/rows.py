"""Rows told apart without trusting the user's ids, which may be null, repeated or beyond 2^53.

Ids never pass through pandas, where a null turns a batch's integers into floats. A row is
known by its id and a hash of its text; rows equal in both are interchangeable. Where
documents need a key or an order of their own, ``own_rows`` numbers them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.layout import POS, order_rows

ROW = "_row"


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def own_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Add ``ROW``: a number without nulls, in the order of the ids, of each document's own.

    Where ids are whole numbers, all different and not null, which is counted, they are it.
    Otherwise rows are ordered by id (null first), then a hash of the text, and numbered; rows
    equal in both are one document. That orders the table once, texts included.
    """
    whole = dict(docs.dtypes)[doc_id] in ("tinyint", "smallint", "int", "bigint")
    repeated = docs.groupBy(doc_id).count().where((F.col("count") > 1) | F.col(doc_id).isNull())
    if whole and repeated.isEmpty():
        return docs.withColumn(ROW, F.col(doc_id).cast("bigint"))
    keyed = docs.withColumn("_key", text_key(F.col(text))).withColumn("_place", F.monotonically_increasing_id())
    ordered = order_rows(keyed, [doc_id, "_key"], ["_place"])
    return ordered.running({ROW: ("min", F.col(POS))}).drop(POS, "_key", "_place")
