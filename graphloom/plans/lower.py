"""Folds a list of logical operators into one lazy DataFrame, in the order in which they stand."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import modifiers as m
from ..operators.paths import path
from ..operators.patterns import bgp, join
from .algebra import Aggregate, Bgp, Filter, GroupCount, Limit, Op, Path, Project, Sort, Unique


def lower(source, ops: list[Op]) -> DataFrame:
    df = None
    for op in ops:
        if isinstance(op, Bgp):
            mine = bgp(source, op.patterns)
            df = mine if df is None else join(df, mine)
            continue
        if isinstance(op, Path):
            df = path(source, op, df)
            continue
        if df is None:
            raise ValueError("a query begins with a pattern or a path")
        match op:
            case Filter():
                df = m.apply_filter(df, op)
            case Project(names):
                df = m.project(df, names)
            case Sort(names):
                df = m.sort(df, names)
            case Unique():
                df = m.unique(df)
            case GroupCount(name):
                df = m.group_count(df, name)
            case Aggregate(name, how, value):
                df = m.aggregate(df, name, how, value)
            case Limit(n):
                df = df.limit(n)
    if df is None:
        raise ValueError("an empty query has no rows and no columns")
    return df
