"""RDF terms as struct columns.

``struct<id: long, id2: long, kind: byte, lex: string, lang: string, dt: string, num: double>``. Joins, grouping and
distinct use ``id`` and ``id2`` together, two hashes of kind, language, datatype and lexical value, so terms are equal
only if all four are (128 bits: at 10^11 terms a collision is not to be expected, where 64 bits would give hundreds). A
struct carries its own text, so nothing is ever looked up in a dictionary. ``num`` is null for what is no number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of terms.
IRI, BLANK, PLAIN, LANG, TYPED = 1, 2, 3, 4, 5

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
TERM = "struct<id:bigint,id2:bigint,kind:tinyint,lex:string,lang:string,dt:string,num:double>"

# Datatypes with a number, datatypes displayed without quotes, and the lexical forms that are valid.
NUMERIC = tuple(XSD + t for t in ("integer", "decimal", "float", "double"))
BARE = (*NUMERIC, XSD + "boolean")
LEXICAL = {
    XSD + "integer": r"^[-+]?\d+$",
    XSD + "decimal": r"^[-+]?\d+(\.\d+)?$",
    XSD + "float": r"^(NaN|-?INF|[-+]?\d+\.\d+([eE][-+]?\d+)?)$",
    XSD + "double": r"^(NaN|-?INF|[-+]?\d+\.\d+([eE][-+]?\d+)?)$",
    XSD + "date": r"^-?\d{4}-\d\d-\d\d$",
    XSD + "dateTime": r"^-?\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[-+]\d\d:\d\d)?$",
}
# Fixed value: the language tags that are valid.
LANGUAGE = r"^\w{2}(-(\w{2}|\w{4}))?$"
KEY = "struct<id:bigint,id2:bigint>"


def make(kind: Column, lex: Column, lang: Column | None = None, dt: Column | None = None, num: Column | None = None) -> Column:
    nothing = F.lit(None).cast("string")
    kind, lex, lang, dt = kind.cast("tinyint"), lex.cast("string"), nothing if lang is None else lang, nothing if dt is None else dt
    return F.struct(
        F.xxhash64(kind, lang, dt, lex).alias("id"), F.xxhash64(F.lit(7), kind, lang, dt, lex).alias("id2"), kind.alias("kind"), lex.alias("lex"), lang.alias("lang"), dt.alias("dt"),
        (F.lit(None).cast("double") if num is None else num.cast("double")).alias("num"),
    )


def same(a: Column, b: Column) -> Column:
    """Whether two terms (or keys of terms) are equal: both ids, as a join needs them."""
    return (a["id"] == b["id"]) & (a["id2"] == b["id2"])


def key(term: Column) -> Column:
    """What tells a term from all others, of type :data:`KEY`."""
    return F.struct(term["id"].alias("id"), term["id2"].alias("id2"))


def iri(lex: Column) -> Column:
    return make(F.lit(IRI), lex)


def blank(label: Column) -> Column:
    """``label`` begins with its import's scope, ``b{scope}b``, which keeps the blank nodes of two imports apart."""
    return make(F.lit(BLANK), label)


def plain(lex: Column) -> Column:
    return make(F.lit(PLAIN), lex)


def tagged(lex: Column, lang: Column) -> Column:
    return make(F.lit(LANG), lex, lang=normal_language(lang))


def typed(lex: Column, dt: Column, num: Column | None = None) -> Column:
    """A typed literal; ``num`` saves parsing the text where the number is at hand."""
    parsed = F.when(dt.isin(*NUMERIC), number(lex)) if num is None else num
    return make(F.lit(TYPED), lex, dt=dt, num=parsed)


def number(lex: Column) -> Column:
    """The double of a numeric lexical form, null if there is none. (A cast that fails must not end the query.)"""
    named = F.when(lex == "INF", "Infinity").when(lex == "-INF", "-Infinity").otherwise(lex)
    return named.try_cast("double")


def normal_language(tag: Column) -> Column:
    """Language lower, region upper, script title case."""
    parts = F.split(tag, "-")
    rest = F.get(parts, F.lit(1))
    second = F.when(F.length(rest) == 4, F.initcap(rest)).otherwise(F.upper(rest))
    return F.when(rest.isNull(), F.lower(tag)).otherwise(F.concat(F.lower(parts[0]), F.lit("-"), second))


def valid(term: Column) -> Column:
    """Whether the lexical form (or the language tag) is one that an import accepts."""
    ok = F.lit(True)
    for dt, pattern in LEXICAL.items():
        ok = F.when(term["dt"] == dt, term["lex"].rlike(pattern)).otherwise(ok)
    return F.when(term["kind"] == LANG, term["lang"].rlike(LANGUAGE)).when(term["kind"] == TYPED, ok).otherwise(True)


def display(term: Column) -> Column:
    """N-Triples-like text, unescaped; numbers and booleans are bare."""
    lex = term["lex"]
    quoted = F.concat(F.lit('"'), lex, F.lit('"'))
    return (
        F.when(term["kind"] == IRI, F.concat(F.lit("<"), lex, F.lit(">")))
        .when(term["kind"] == BLANK, F.concat(F.lit("_:"), lex))
        .when(term["kind"] == PLAIN, quoted)
        .when(term["kind"] == LANG, F.concat(quoted, F.lit("@"), term["lang"]))
        .when(term["dt"].isin(*BARE), lex)
        .otherwise(F.concat(quoted, F.lit("^^<"), term["dt"], F.lit(">")))
    )


def sort_key(term: Column) -> list[Column]:
    """Texts by their display form, then numbers by value, then unbound."""
    num = term["num"]
    return [term["id"].isNull().asc(), num.isNotNull().asc(), num.asc(), F.when(num.isNull(), display(term)).asc()]


@dataclass(frozen=True)
class Const:
    """A constant term."""

    kind: int
    lex: str
    lang: str | None = None
    dt: str | None = None

    def column(self) -> Column:
        text = lambda x: F.lit(x).cast("string")
        if self.kind == LANG:
            return tagged(text(self.lex), text(self.lang))
        if self.kind == TYPED:
            return typed(text(self.lex), text(self.dt))
        return make(F.lit(self.kind), text(self.lex))

    def id(self) -> Column:
        """Folded to a literal by the optimizer."""
        return self.column()["id"]

    def key(self) -> Column:
        return key(self.column())


def iri_const(lex: str) -> Const:
    return Const(IRI, lex)


def plain_const(lex: str) -> Const:
    return Const(PLAIN, lex)


def lang_const(lex: str, lang: str) -> Const:
    return Const(LANG, lex, lang=lang)


def typed_const(lex: str, dt: str) -> Const:
    return Const(TYPED, lex, dt=dt)
