"""Filters, projection, order, duplicates, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filters
from ..functions.terms import Const, key, sort_key
from ..plans.algebra import Filter, Var


def _known(df: DataFrame, *names: str) -> None:
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"no variable named {', '.join(unknown)}; there are {', '.join(df.columns)}")


def apply_filter(df: DataFrame, f: Filter) -> DataFrame:
    _known(df, f.var)
    v = F.col(f.var)
    if f.op == "sameterm":
        if isinstance(f.value, Var):
            _known(df, f.value.name)
        return df.where(filters.same_term(v, F.col(f.value.name) if isinstance(f.value, Var) else f.value))
    if f.op in ("<", "<=", ">", ">=", "=", "!="):
        return df.where(filters.compare(v, f.op, float(f.value)))
    if f.op not in filters.FILTERS:
        raise ValueError(f"no filter named {f.op}")
    condition, takes_text = filters.FILTERS[f.op]
    if not takes_text:
        return df.where(condition(v))
    value = f.value.lex if isinstance(f.value, Const) else f.value
    lang = f.value.lang if isinstance(f.value, Const) else f.lang
    if f.op in ("regex", "re"):
        return df.where(condition(v, value, f.flags))
    return df.where(condition(v, value) if f.op == "langmatches" else condition(v, value, lang))


def project(df: DataFrame, names) -> DataFrame:
    _known(df, *names)
    return df.select(*names)


def sort(df: DataFrame, names) -> DataFrame:
    _known(df, *names)
    return df.orderBy(*[k for n in names for k in sort_key(F.col(n))])


def unique(df: DataFrame) -> DataFrame:
    """Distinct rows by term identity, in the order of all variables."""
    names = df.columns
    keyed = df.groupBy(*[key(F.col(n)).alias(f"__{n}") for n in names]).agg(*[F.first(n).alias(n) for n in names])
    return sort(keyed.select(*names), names)


def group_count(df: DataFrame, name: str) -> DataFrame:
    """The group term and n, its number of rows; an unbound group is a group."""
    _known(df, name)
    return df.groupBy(key(F.col(name)).alias("__id")).agg(F.first(name).alias(name), F.count(F.lit(1)).alias("n")).select(name, "n")


def aggregate(df: DataFrame, name: str, how: str, value: str) -> DataFrame:
    _known(df, name, value)
    if how not in ("sum", "avg", "min", "max"):
        raise ValueError(f"no aggregate named {how}")
    return df.groupBy(key(F.col(name)).alias("__id")).agg(F.first(name).alias(name), getattr(F, how)(F.col(value)["num"]).alias(how)).select(name, how)
