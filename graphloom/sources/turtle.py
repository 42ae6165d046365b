"""Turtle files. Statements span lines, so a file is parsed whole in one task; many files are parsed in parallel.

For small files only: one beyond ``max_bytes`` fails the query. Bulk loads go through N-Triples, which split by line.

Covered: prefixes and base, ``a``, predicate and object lists, blank-node property lists, collections, short and long
strings, language tags, datatypes, and bare numbers and booleans.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.terms import RDF_TYPE, XSD
from ..shipping import ship
from .ntriples import file_scope

_RDF = RDF_TYPE.removesuffix("type")
_TOKEN = re.compile(
    r'''(?P<skip>\s+|\#[^\n]*)|(?P<iri><[^<>"\s]*>)|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\')'''
    r'''|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<blank>_:[\w-]+(?:\.+[\w-]+)*)'''
    r'''|(?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))|(?P<name>(?:[\w-]+(?:\.+[\w-]+)*)?:(?:[\w:%-]|\\.)*(?:\.+(?:[\w:%-]|\\.)+)*)|(?P<word>[A-Za-z]+)|(?P<mark>[.;,\[\]()])''',
    re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def _unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _PLAIN.get(m[1], m[1]), text)


class _File:
    """Recursive descent over one text; a term is (kind, lex, lang, dt)."""

    def __init__(self, text: str, scope: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise ValueError(f"not Turtle at character {at}")
            at = m.end()
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
        self.at, self.base, self.prefixes, self.out = 0, "", {}, []
        self.blank_head, self.fresh = f"b{scope}b", 0

    def take(self, expected: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or (expected and self.tokens[self.at][1] != expected):
            raise ValueError(f"{expected or 'more'} expected at token {self.at}")
        self.at += 1
        return self.tokens[self.at - 1]

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def parse(self) -> list:
        while self.at < len(self.tokens):
            word = self.peek().lower().lstrip("@")
            if self.tokens[self.at][0] in ("at", "word") and word in ("prefix", "base"):
                dotted = self.take()[1].startswith("@")
                if word == "prefix":
                    name = self.take()[1].removesuffix(":")
                    self.prefixes[name] = self.iri(self.take()[1])
                else:
                    self.base = self.iri(self.take()[1])
                if dotted:
                    self.take(".")
                continue
            listed = self.peek() == "["
            s = self.term()
            if not (listed and self.peek() == "."):
                self.properties(s)
            self.take(".")
        return self.out

    def properties(self, s) -> None:
        while True:
            p = (T.IRI, RDF_TYPE, None, None) if self.peek() == "a" else None
            p = (self.take(), p)[1] if p else self.term()
            while True:
                self.out.append((s, p, self.term()))
                if self.peek() != ",":
                    break
                self.take()
            while self.peek() == ";":
                self.take()
            if self.peek() in (".", "]", ""):
                return

    def iri(self, token: str) -> str:
        return urljoin(self.base, _unescape(token[1:-1])) if self.base else _unescape(token[1:-1])

    def new_blank(self):
        self.fresh += 1
        return (T.BLANK, f"{self.blank_head}n{self.fresh}", None, None)

    def term(self):
        kind, token = self.take()
        if kind == "iri":
            return (T.IRI, self.iri(token), None, None)
        if kind == "name":
            prefix, _, local = token.partition(":")
            return (T.IRI, self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), None, None)
        if kind == "blank":
            return (T.BLANK, self.blank_head + "l" + token[2:], None, None)
        if kind in ("str", "long"):
            text = _unescape(token[3:-3] if kind == "long" else token[1:-1])
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "at":
                return (T.LANG, text, self.take()[1][1:], None)
            if self.peek() == "^^":
                self.take()
                dt = self.term()[1]
                return (T.PLAIN, text, None, None) if dt == XSD + "string" else (T.TYPED, text, None, dt)
            return (T.PLAIN, text, None, None)
        if kind == "num":
            return (T.TYPED, token, None, XSD + ("double" if "e" in token.lower() else "decimal" if "." in token else "integer"))
        if token in ("true", "false"):
            return (T.TYPED, token, None, XSD + "boolean")
        if token == "[":
            me = self.new_blank()
            if self.peek() != "]":
                self.properties(me)
            self.take("]")
            return me
        if token == "(":
            items = []
            while self.peek() != ")":
                items.append(self.term())
            self.take(")")
            rest = (T.IRI, _RDF + "nil", None, None)
            for item in reversed(items):
                me = self.new_blank()
                self.out += [(me, (T.IRI, _RDF + "first", None, None), item), (me, (T.IRI, _RDF + "rest", None, None), rest)]
                rest = me
            return rest
        raise ValueError(f"unexpected {token}")


_FIELDS = ("kind", "lex", "lang", "dt")
_SCHEMA = ", ".join(f"{c}{f} {'tinyint' if f == 'kind' else 'string'}" for c in "spo" for f in _FIELDS)


def read(spark: SparkSession, path: str, scope: int = 1, on_invalid: str = "drop", max_bytes: int = 64 << 20) -> DataFrame:
    """s, p, o of the Turtle files at ``path``. A file that is no Turtle, or larger than ``max_bytes``, fails the query.

    Each file has blank nodes of its own.
    """
    ship(spark)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [[x for term in t for x in term] for t in _File(content.decode("utf-8-sig"), name).parse()]
                columns = list(zip(*rows)) or [()] * 12
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int8() if k % 4 == 0 else pa.string()) for k, c in enumerate(columns)], names=[c + f for c in "spo" for f in _FIELDS])

    files = spark.read.format("binaryFile").load(path)
    small = F.when(F.col("length") > max_bytes, F.raise_error(F.concat(F.lit(f"Turtle file beyond {max_bytes} bytes, use N-Triples: "), F.col("path")))).otherwise(F.lit(True))
    parsed = files.where(small).select(file_scope(scope, F.col("path")), "content").mapInArrow(run, _SCHEMA)

    def term(c):
        kind, lex, lang, dt = (F.col(c + f) for f in _FIELDS)
        tag = F.when(kind == T.LANG, T.normal_language(lang))
        return T.make(kind, lex, tag, dt, F.when(dt.isin(*T.NUMERIC), T.number(lex)))

    triples = parsed.select(*[term(c).alias(c) for c in "spo"])
    if on_invalid == "keep":
        return triples
    if on_invalid == "fail":
        return triples.where(F.when(~T.valid(F.col("o")), F.raise_error(F.concat(F.lit("invalid literal: "), F.col("o.lex")))).otherwise(True))
    return triples.where(T.valid(F.col("o")))
