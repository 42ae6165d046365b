"""The order of patterns and the checks that the command language makes.

Catalyst keeps the join order it is given (its cost-based reordering is off by default), so patterns are ordered here:
the most selective first, then always one that shares a variable with those before.
"""

from __future__ import annotations

from .algebra import Any, Pattern, Var


def cost(p: Pattern) -> int:
    """Free places count; a free subject or object counts double."""
    free = sum(isinstance(n, (Var, Any)) for n in p.nodes())
    return free * 2 ** isinstance(p.s, (Var, Any)) * 2 ** isinstance(p.o, (Var, Any))


def ordered(patterns: tuple[Pattern, ...]) -> tuple[Pattern, ...]:
    left, out, seen = sorted(patterns, key=cost), [], set()
    while left:
        connected = [p for p in left if seen & set(p.variables())]
        best = (connected or left)[0]
        left.remove(best)
        out.append(best)
        seen |= set(best.variables())
    return tuple(out)


def is_connected(patterns: tuple[Pattern, ...]) -> bool:
    """Whether no pattern order needs a cartesian product."""
    groups: list[set] = []
    for p in patterns:
        mine, rest = set(p.variables()), []
        for g in groups:
            if g & mine:
                mine |= g
            else:
                rest.append(g)
        groups = [*rest, mine]
    return len(groups) < 2


def starts_unbound(patterns: tuple[Pattern, ...]) -> bool:
    """More than two patterns, of which the first has no constant."""
    return len(patterns) > 2 and all(isinstance(n, (Var, Any)) for n in patterns[0].nodes())
