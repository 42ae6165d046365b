"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, new_path, releasing, shared_dir, staged
from ..shipping import ship

__all__ = ["ascii_lower", "discard", "each", "new_path", "packed", "releasing", "resident", "shared_dir", "staged", "table", "unpacked"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RESIDENT: dict[tuple, object] = {}


def resident(operator: str, key: str = "", make: Callable[[], object] = lambda: None):
    """What a Python worker holds from one task to the next: one object, that of the operator which came last.

    Workers serve one operator after the other; without this each operator's memory would come on top of the others'.
    """
    if (operator, key) not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[operator, key] = make()
    return _RESIDENT[operator, key]


def each(column: pa.Array, rows: int = 256) -> Iterator:
    """The values of a column, of which only so many are Python objects at a time."""
    for start in range(0, len(column), rows):
        yield from column.slice(start, rows).to_pylist()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` and the struct ``others`` of all other columns, whatever their names are.

    Its fields are called by their number (c0, c1, ...), so that no column's name can clash with another.
    """
    ship(docs.sparkSession)
    others = [_named(c).alias(f"c{k}") for k, c in enumerate(c for c in docs.columns if c not in (id_col, text_col))]
    return docs.select(_named(id_col).cast("long").alias("doc_id"), _named(text_col).alias("text"), F.struct(*(others or [F.lit(0).alias("c0")])).alias("others"))


def unpacked(df: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns that :func:`packed` was given."""
    place = {id_col: F.col("doc_id").alias(id_col), text_col: F.col("text").alias(text_col)}
    number = {c: k for k, c in enumerate(c for c in columns if c not in place)}
    return df.select(*[place[c] if c in place else F.col("others")[f"c{number[c]}"].alias(c) for c in columns])
