"""Filter conditions on term columns. An unbound variable gives null, which drops the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import BLANK, IRI, LANG, PLAIN, TYPED, Const, same


def is_iri(v: Column) -> Column:
    return v["kind"] == IRI


def is_literal(v: Column) -> Column:
    return v["kind"].isin(PLAIN, LANG, TYPED)


def is_blank(v: Column) -> Column:
    return v["kind"] == BLANK


def is_numeric(v: Column) -> Column:
    return F.when(v["id"].isNotNull(), v["num"].isNotNull())


def same_term(v: Column, other: Column | Const) -> Column:
    return same(v, other.column() if isinstance(other, Const) else other)


def compatible(v: Column, lang: str | None) -> Column:
    """A plain pattern fits plain strings, a pattern with a language only that very language."""
    return v["kind"] == PLAIN if lang is None else (v["kind"] == LANG) & (v["lang"] == lang)


def contains(v: Column, text: str, lang: str | None = None) -> Column:
    return compatible(v, lang) & v["lex"].contains(F.lit(text))


def starts(v: Column, text: str, lang: str | None = None) -> Column:
    """On the lexical value of any kind of term; with a language, of that language."""
    found = v["lex"].startswith(F.lit(text))
    return found if lang is None else compatible(v, lang) & found


def ends(v: Column, text: str, lang: str | None = None) -> Column:
    found = v["lex"].endswith(F.lit(text))
    return found if lang is None else compatible(v, lang) & found


def regex(v: Column, pattern: str, flags: str = "") -> Column:
    """Search in the lexical value of any kind of term. Only flag ``i`` counts, for ASCII letters; ``.`` stops at ``\\n`` alone."""
    return v["lex"].rlike("(?di)" * ("i" in flags) + "(?d)" * ("i" not in flags) + pattern)


def lang_matches(v: Column, wanted: str) -> Column:
    """Extension: the tag is ``wanted`` or begins with it; ``*`` is any tag."""
    if wanted == "*":
        return v["lang"].isNotNull() & (v["kind"] == LANG)
    tag = F.lower(v["lang"])
    return (v["kind"] == LANG) & ((tag == wanted.lower()) | tag.startswith(wanted.lower() + "-"))


def compare(v: Column, op: str, value: float) -> Column:
    """Extension: numeric comparison; what is no number drops."""
    return {"<": v["num"] < value, "<=": v["num"] <= value, ">": v["num"] > value, ">=": v["num"] >= value, "=": v["num"] == value, "!=": v["num"] != value}[op]


#: Name -> (condition, whether it takes a text).
FILTERS = {
    "isiri": (is_iri, False), "isuri": (is_iri, False), "isliteral": (is_literal, False), "isblank": (is_blank, False),
    "isnumeric": (is_numeric, False), "contains": (contains, True), "starts": (starts, True), "ends": (ends, True),
    "strstarts": (starts, True), "strends": (ends, True), "regex": (regex, True), "re": (regex, True), "langmatches": (lang_matches, True),
}
