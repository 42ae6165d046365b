"""The fluent query builder and the algebra entry point."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .functions.terms import Const, iri_const
from .plans.algebra import ANY, Aggregate, Bgp, Filter, GroupCount, Limit, Op, Path, Pattern, Project, Sort, Unique, Var, summary, var
from .plans.lower import lower
from .plans.order import is_connected, ordered, starts_unbound


def node(x):
    """None: any term; ``?name``: a variable; another string: an IRI; a list: any of its constants."""
    if x is None:
        return ANY
    if isinstance(x, str):
        return var(x) if x.startswith("?") else iri_const(x)
    if isinstance(x, (list, set)):
        return tuple(node(y) for y in x)
    return x


def pattern(s, p, o) -> Pattern:
    return Pattern(node(s), node(p), node(o))


@dataclass(frozen=True)
class Query:
    """Immutable: each call returns a longer query. Nothing runs before an action on :meth:`to_df`."""

    source: object
    ops: tuple[Op, ...] = ()

    def _with(self, op: Op) -> Query:
        return Query(self.source, (*self.ops, op))

    def bgp(self, *patterns, strict: bool = False) -> Query:
        """``strict`` refuses cartesian products, and more than two patterns that begin with an all-variable one."""
        made = tuple(p if isinstance(p, Pattern) else pattern(*p) for p in patterns)
        if strict and not is_connected(made):
            raise ValueError("the patterns make a cartesian product")
        if strict and starts_unbound(made):
            raise ValueError("the first of more than two patterns has no constant")
        return self._with(Bgp(made))

    def path(self, s, p, o, kind: str = "+") -> Query:
        if kind not in "+*":
            raise ValueError(f"no path of kind {kind}")
        return self._with(Path(node(s), node(p), node(o), kind))

    def filter(self, name: str, op: str, value=None, flags: str = "", lang: str | None = None) -> Query:
        return self._with(Filter(name.lstrip("?"), op.lower(), value, lang, flags))

    def project(self, *names: str) -> Query:
        return self._with(Project(tuple(n.lstrip("?") for n in names)))

    def sort(self, *names: str) -> Query:
        return self._with(Sort(tuple(n.lstrip("?") for n in names)))

    def unique(self) -> Query:
        return self._with(Unique())

    def limit(self, n: int) -> Query:
        return self._with(Limit(n))

    def count_by(self, name: str) -> Query:
        return self._with(GroupCount(name.lstrip("?")))

    def aggregate(self, name: str, how: str, value: str) -> Query:
        return self._with(Aggregate(name.lstrip("?"), how, value.lstrip("?")))

    def to_df(self) -> DataFrame:
        return lower(self.source, list(self.ops))

    def count(self) -> int:
        return self.to_df().count()

    def summary(self) -> str:
        return summary(list(self.ops))

    def explain(self, mode: str = "formatted") -> None:
        self.to_df().explain(mode)


def plan(source, algebra: tuple) -> Query | None:
    """A query for the algebra trees that can be pushed down whole; None for all others.

    ``("bgp", pattern, ...)``, ``("path", s, p, o)``, ``("join", child, ("path", ...))``, ``("project", child, names)``
    and ``("filter", child, var, op, value)``. Patterns are put in order of selectivity.
    """
    match algebra:
        case ("bgp", *patterns):
            return Query(source, (Bgp(ordered(tuple(p if isinstance(p, Pattern) else pattern(*p) for p in patterns))),))
        case ("path", s, p, o):
            p = node(p)
            return Query(source).path(s, p, o) if isinstance(p, Const) else None
        case ("join", left, ("path", s, p, o)):
            child, p = plan(source, left), node(p)
            return child.path(s, p, o) if child is not None and isinstance(p, Const) else None
        case ("project", child, names):
            child = plan(source, child)
            return None if child is None else child.project(*names)
        case ("filter", child, name, op, *value):
            child = plan(source, child)
            known = {"regex", "isiri", "isuri", "isliteral", "isblank", "contains", "strstarts", "strends"}
            return child.filter(name, op, *value) if child is not None and op.lower() in known else None
    return None


__all__ = ["Query", "Var", "node", "pattern", "plan"]
