"""N-Triples files: read as text in parallel splits, parsed by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.terms import XSD

# A fixed pattern: subject, predicate, object, literal body, language, datatype. Its possessive quantifiers run in loops,
# not by recursion, so that a literal of any length costs no stack.
LINE = r'^\s*(<[^>]*>|_:[^\s<"]+)\s*(<[^>]*>)\s*(<[^>]*>|_:[^\s<"]*[^\s<".]|"([^"\\]*+(?:\\.[^"\\]*+)*+)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$'
_SIMPLE = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: Column) -> Column:
    r"""Resolves \t \b \n \r \f \" \' \\ \uXXXX and \UXXXXXXXX, piece by piece; texts without a backslash stay as they are."""
    piece = r"(?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"

    def resolved(p: Column) -> Column:
        out = p
        for letter, char in _SIMPLE.items():
            out = F.when(p == F.lit("\\" + letter), F.lit(char)).otherwise(out)
        wide = F.decode(F.unhex(F.lpad(F.substring(p, 3, 8), 8, "0")), "UTF-32")
        return F.when(p.rlike(r"^\\[uU]"), wide).otherwise(out)

    pieces = F.regexp_extract_all(text, F.lit(piece), F.lit(0))
    return F.when(text.contains("\\"), F.array_join(F.transform(pieces, resolved), "")).otherwise(text)


def file_scope(scope: int, path: Column) -> Column:
    """The scope of the blank nodes of one file: the load and a hash of the file's whole path."""
    return F.concat(F.lit(f"{scope}x"), F.lower(F.hex(F.xxhash64(path))))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: no later filter or projection is folded into it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _fields(lines: DataFrame, scope: Column) -> DataFrame:
    """``lines`` with ``f``: kind and text of the subject, text of the predicate, and all about the object; one pass of
    the pattern. A line that is no triple has a null kind."""
    kept = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    good = ~F.col("value").contains("\n") & F.col("value").rlike(".")
    cut = _once(kept, "g", F.when(good, F.split(F.regexp_replace("value", LINE, "$1\n$2\n$3\n$4\n$5\n$6"), "\n", -1)))
    s, p, o, body, lang, dt = (F.col("g")[k] for k in range(6))
    is_blank = lambda token: token.startswith("_:")
    inside = lambda token: F.substring(token, F.lit(2), F.length(token) - 2)
    label = lambda token: F.concat(F.lit("b"), scope, F.lit("b"), F.substring(token, F.lit(3), F.length(token)))
    literal = o.startswith('"')
    kind = lambda token: F.when(is_blank(token), T.BLANK).otherwise(T.IRI)
    o_kind = F.when(~literal, kind(o)).when(lang != "", T.LANG).when((dt != "") & (dt != XSD + "string"), T.TYPED).otherwise(T.PLAIN)
    triple = F.size("g") == 6
    fields = F.struct(
        F.when(triple, kind(s)).alias("s_kind"), F.when(is_blank(s), label(s)).otherwise(unescape(inside(s))).alias("s"), unescape(inside(p)).alias("p"),
        F.when(triple, o_kind).alias("kind"), F.when(is_blank(o), label(o)).otherwise(unescape(F.when(literal, body).otherwise(inside(o)))).alias("lex"),
        F.when(literal & (lang != ""), T.normal_language(lang)).alias("lang"), F.when(literal & (dt != "") & (dt != XSD + "string"), dt).alias("dt"),
    )
    return _once(cut, "f", F.when(triple, fields)).drop("g")


def parse(lines: DataFrame, scope: int | Column = 1, on_invalid: str = "drop") -> DataFrame:
    """lines (value) -> s, p, o. Comments and blank lines are skipped; a literal may be as long as a line may be.

    ``scope`` tells the blank nodes of these lines from others. ``on_invalid``: what happens to lines that are no triple
    and to literals of invalid form: ``drop``, ``keep`` (such literals stay, with no number) or ``fail``.
    """
    read = _fields(lines, scope if isinstance(scope, Column) else F.lit(str(scope)))
    f = F.col("f")
    wrong = f.isNull() if on_invalid == "keep" else f.isNull() | ~T.valid(f)
    if on_invalid == "fail":
        kept = read.where(F.when(wrong, F.raise_error(F.concat(F.lit("invalid triple: "), F.col("value")))).otherwise(F.lit(True)))
    else:
        kept = read.where(~wrong)
    number = F.when(f["dt"].isin(*T.NUMERIC), T.number(f["lex"]))
    return kept.select(T.make(f["s_kind"], f["s"]).alias("s"), T.iri(f["p"]).alias("p"), T.make(f["kind"], f["lex"], f["lang"], f["dt"], number).alias("o"))


def rejected(lines: DataFrame) -> DataFrame:
    """The lines that an import drops, to be counted and reported."""
    f = F.col("f")
    return _fields(lines, F.lit("")).where(f.isNull() | ~T.valid(f)).select("value")


def read(spark: SparkSession, path: str, scope: int = 1, on_invalid: str = "drop") -> DataFrame:
    """Each file has blank nodes of its own."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"))
    return parse(lines, file_scope(scope, F.col("path")), on_invalid)


def escaped(lex: Column) -> Column:
    out = F.replace(lex, F.lit("\\"), F.lit("\\\\"))
    for letter, char in (('"', '"'), ("n", "\n"), ("r", "\r"), ("t", "\t")):
        out = F.replace(out, F.lit(char), F.lit("\\" + letter))
    return out


def token(term: Column) -> Column:
    """Standard N-Triples text of a term (with escapes and explicit datatypes)."""
    quoted = F.concat(F.lit('"'), escaped(term["lex"]), F.lit('"'))
    return (
        F.when(term["kind"] == T.IRI, F.concat(F.lit("<"), term["lex"], F.lit(">")))
        .when(term["kind"] == T.BLANK, F.concat(F.lit("_:"), term["lex"]))
        .when(term["kind"] == T.LANG, F.concat(quoted, F.lit("@"), term["lang"]))
        .when(term["kind"] == T.TYPED, F.concat(quoted, F.lit("^^<"), term["dt"], F.lit(">")))
        .otherwise(quoted)
    )


def lines(triples: DataFrame) -> DataFrame:
    return triples.select(F.concat_ws(" ", token(F.col("s")), token(F.col("p")), token(F.col("o")), F.lit(".")).alias("value"))


def write(triples: DataFrame, path: str) -> None:
    lines(triples).write.text(path)
