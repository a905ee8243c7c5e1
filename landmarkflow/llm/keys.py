"""Row keys and passing all columns of a table through an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and the key (``k1``, ``k2``): hashes of id and text, never null.

    Rows equal in both are one text for every operator that uses the key.
    """
    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("k1"),
                       F.xxhash64("text").alias("k2"))


def positional(docs: DataFrame) -> tuple[DataFrame, list[str], str, str]:
    """``docs`` under column names of its own, those names, and its id and text among them.

    Operators that keep all columns work on these names, so none can clash.
    """
    inner = [f"_c{i}" for i in range(len(docs.columns))]
    return (docs.toDF(*inner), inner, inner[docs.columns.index("doc_id")],
            inner[docs.columns.index("text")])


def fields(df: DataFrame, names) -> list[str]:
    """Schema strings of some columns, for ``mapInArrow``."""
    return [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names]
