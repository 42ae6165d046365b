"""Text forms of query results: tab-separated values and name=term lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import terms as T
from ..functions.terms import XSD


def cell(term: Column) -> Column:
    r"""Escaped text of a term; decimal, integer and double are bare, unbound is empty."""
    lex = term["lex"]
    for letter, char in (("r", "\r"), ("n", "\n"), ("t", "\t")):
        lex = F.replace(lex, F.lit(char), F.lit("\\" + letter))
    quoted = F.concat(F.lit('"'), lex, F.lit('"'))
    bare = [XSD + t for t in ("decimal", "integer", "double")]
    text = (
        F.when(term["kind"] == T.IRI, F.concat(F.lit("<"), lex, F.lit(">")))
        .when(term["kind"] == T.BLANK, F.concat(F.lit("_:"), lex))
        .when(term["kind"] == T.LANG, F.concat(quoted, F.lit("@"), term["lang"]))
        .when((term["kind"] == T.TYPED) & term["dt"].isin(*bare), lex)
        .when(term["kind"] == T.TYPED, F.concat(quoted, F.lit("^^<"), term["dt"], F.lit(">")))
        .otherwise(quoted)
    )
    return F.when(term["id"].isNull(), "").otherwise(text)


def _cells(df: DataFrame) -> list[Column]:
    return [(cell(F.col(f.name)) if isinstance(f.dataType, StructType) else F.coalesce(F.col(f.name).cast("string"), F.lit(""))).alias(f.name) for f in df.schema.fields]


def tsv_lines(df: DataFrame) -> DataFrame:
    """``value``: a line for each row, without the header."""
    return df.select(F.concat_ws("\t", *_cells(df)).alias("value"))


def tsv_header(df: DataFrame) -> str:
    return "\t".join(f"?{c}" for c in df.columns)


def write_tsv(df: DataFrame, path: str) -> None:
    """A folder of part files, each with the header."""
    df.select(*[c.alias(f"?{n}") for c, n in zip(_cells(df), df.columns)]).write.csv(path, sep="\t", header=True, quote="", escape="", escapeQuotes=False)


def bound_lines(df: DataFrame) -> DataFrame:
    """``name=term`` for the bound variables of each row."""
    parts = [F.when(c != "", F.concat(F.lit(f"{n}="), c)) for c, n in zip(_cells(df), df.columns)]
    return df.select(F.concat_ws(" ", *parts).alias("value"))
