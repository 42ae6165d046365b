"""Logical operators: small frozen values, applied in the order in which they stand."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.terms import Const


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Any:
    """Matches every term and binds nothing."""


ANY = Any()
#: What may stand in a pattern; a tuple of constants matches any of them.
Node = Var | Any | Const | tuple


@dataclass(frozen=True)
class Pattern:
    s: Node
    p: Node
    o: Node

    def nodes(self) -> tuple:
        return self.s, self.p, self.o

    def variables(self) -> list[str]:
        return list(dict.fromkeys(n.name for n in self.nodes() if isinstance(n, Var)))


@dataclass(frozen=True)
class Bgp:
    patterns: tuple[Pattern, ...]


@dataclass(frozen=True)
class Path:
    """One or more steps (``+``), or none or more (``*``, an extension), over a constant predicate."""

    s: Node
    p: Const
    o: Node
    kind: str = "+"


@dataclass(frozen=True)
class Filter:
    """``op`` of :data:`graphloom.functions.filters.FILTERS`, ``sameterm``, or a comparison ``< <= > >= = !=``."""

    var: str
    op: str
    value: object = None
    lang: str | None = None
    flags: str = ""


@dataclass(frozen=True)
class Project:
    names: tuple[str, ...]


@dataclass(frozen=True)
class Sort:
    names: tuple[str, ...]


@dataclass(frozen=True)
class Unique:
    pass


@dataclass(frozen=True)
class GroupCount:
    """Rows for each value of ``var``; ends the query."""

    var: str


@dataclass(frozen=True)
class Aggregate:
    """Extension: sum, avg, min or max of the numbers of ``value`` for each value of ``var``; ends the query."""

    var: str
    how: str
    value: str


@dataclass(frozen=True)
class Limit:
    n: int


Op = Bgp | Path | Filter | Project | Sort | Unique | GroupCount | Aggregate | Limit


def var(name: str) -> Var:
    return Var(name.lstrip("?"))


def summary(ops: list[Op]) -> str:
    """One line, such as ``Query { BGP -> Filter -> Project }``."""
    label = {Bgp: "BGP", GroupCount: "Count"}
    return "Query { " + " -> ".join(label.get(type(o), type(o).__name__) for o in ops) + " }"
