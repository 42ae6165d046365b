"""Secret scans through a trigram inverted index (native: DataFrame functions only).

From each rule's regex a Boolean trigram query is derived: an OR of ANDs of the trigrams that every match must hold.
The index holds the postings (trigram, document key) of the trigrams that some query names, over all documents. Each AND
looks its trigrams up and intersects their postings; a rule's candidates are the union of its ANDs. The regexes run over
their candidates alone. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked

#: Stands for "any character here" in the output of :func:`alternatives`.
_ANY = "\0"


@dataclass(frozen=True)
class Rule:
    """``group`` and ``least``: matches whose group is shorter than ``least`` are dropped after matching."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False
    base: bool = False


# The base rules, in the order in which spans with the same start are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True, True),
    # a match is a whole run from its first AKIA, so its length can stand in the regex
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
)
# Rules of this operator's own: public formats of well-known credentials.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


def alternatives(regex: str) -> list[str]:
    """Strings of which every match contains one, piece for piece; ``_ANY`` separates pieces with unknown text between.

    Understands what the rules use: literals, escapes, groups with ``|``, classes, and the quantifiers ``? * + {m,n}``.
    """
    def sequence(i: int, depth: int) -> tuple[list[str], int]:
        branches, current = [], [""]
        while i < len(regex) and not (regex[i] == ")" and depth):
            if regex[i] == "|":
                branches, current, i = branches + current, [""], i + 1
                continue
            if regex[i] == "(":
                atom, i = sequence(i + 1, depth + 1)
                i += 1
            elif regex[i] == "[":
                i, atom = regex.index("]", i + 2) + 1, [_ANY]
            elif regex[i] == "\\":
                if regex[i + 1] == "x":
                    atom, i = [chr(int(regex[i + 2 : i + 4], 16))], i + 4
                else:
                    atom, i = [_ANY if regex[i + 1].isalnum() else regex[i + 1]], i + 2
            else:
                atom, i = [_ANY if regex[i] == "." else regex[i]], i + 1
            if i < len(regex) and regex[i] in "?*+{":
                mark = regex[i]
                i = regex.index("}", i) + 1 if mark == "{" else i + 1
                atom = [*atom, ""] if mark == "?" else [_ANY] if mark in "*{" else [a + _ANY for a in atom]
            current = [a + b for a, b in product(current, atom)]
        return branches + current, i

    return sequence(0, 0)[0]


def trigram_query(rule: Rule) -> list[frozenset[str]] | None:
    """An OR of ANDs over lower-cased trigrams; None if some match needs no trigram."""
    query = []
    for text in alternatives(rule.regex):
        grams = {p[i : i + 3].lower() for p in text.split(_ANY) for i in range(len(p) - 2)}
        if not grams:
            return None
        query.append(frozenset(grams))
    return list(dict.fromkeys(query))


def trigram_index(docs: DataFrame, rules=RULES) -> DataFrame:
    """The inverted index: (gram, key) for each trigram that some rule's query names and each text that holds it."""
    named = sorted({g for q in map(trigram_query, rules) for conj in q or () for g in conj})
    lowered = docs.select("key", F.lower("text").alias("t"))
    held = F.array_compact(F.array(*[F.when(F.contains("t", F.lit(g)), F.lit(g)) for g in named]))
    return lowered.select(F.explode(held).alias("gram"), "key")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """key -> rules (their numbers): the texts whose trigrams satisfy the queries.

    A conjunction looks up its trigrams and keeps the keys that stand in all of their postings.
    """
    entries = [(g, r, c, 1 << k, (1 << len(conj)) - 1) for r, rule in enumerate(rules) for c, conj in enumerate(trigram_query(rule) or ()) for k, g in enumerate(sorted(conj))]
    queries = F.broadcast(index.sparkSession.createDataFrame(entries, "gram string, rule int, conj int, bit long, need long"))  # a few rows for each rule
    # a bit for each trigram, as rows that share a key post it several times
    met = index.join(queries, "gram").groupBy("key", "rule", "conj", "need").agg(F.bit_or("bit").alias("met")).where("met = need")
    return met.groupBy("key").agg(F.collect_set("rule").alias("rules"))


#: Running values are taken in blocks of this size, then over blocks: what is appended to stays short.
_BLOCK = 256


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: inside a lambda, an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, how) -> Column:
    """For each element of an int array, ``how`` (a sum or a maximum, from 0) over the elements up to it."""
    ints, lists = "array<int>", "array<array<int>>"
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))
    fold = lambda xs: F.aggregate(xs, F.array().cast(ints), lambda acc, x: F.concat(acc, F.array(how(last(acc), x).cast("int"))))

    def blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(_BLOCK))
        return F.when(F.size(v) == 0, F.array().cast(lists)).otherwise(F.transform(starts, lambda at: F.slice(v, at, F.lit(_BLOCK))))

    def joined(inside: Column) -> Column:
        return let(F.transform(inside, last), lambda ends: F.flatten(F.zip_with(inside, heads(ends), lambda block, head: F.transform(block, lambda x: how(head, x).cast("int")))))

    def heads(ends: Column) -> Column:
        return F.transform(ends, lambda x, k: F.aggregate(F.slice(ends, F.lit(1), k), F.lit(0), lambda acc, y: how(acc, y).cast("int")))

    return let(let(values, blocks), lambda b: let(F.transform(b, fold), joined))


SPANS = "array<struct<start:int,k:int,end:int,kind:string>>"


def matches(text: Column, rule: Rule) -> Column:
    """Array of (start, k, end, kind) of the rule's leftmost non-overlapping matches, in code points, end exclusive."""
    pattern = ("(?i)" if rule.ignore_case else "") + rule.regex
    k = RULES.index(rule)
    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length)
    groups = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)), F.char_length) if rule.least else lengths
    # what lies before each match (and, last of all, after them)
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)

    def spans(ns: Column) -> Column:
        steps = F.zip_with(ns, F.slice(gaps, F.lit(1), F.size(ns)), lambda n, gap: gap + n)
        ends = F.when(F.size(ns) == 0, F.array().cast("array<int>")).otherwise(running(steps, lambda a, b: a + b))
        found = F.arrays_zip(ends.alias("e"), ns.alias("n"), groups.alias("g"))
        kept = F.filter(found, lambda m: m["g"] >= rule.least)
        return F.transform(kept, lambda m: F.struct((m["e"] - m["n"]).alias("start"), F.lit(k).alias("k"), m["e"].alias("end"), F.lit(rule.kind).alias("kind")))

    return let(lengths, spans).cast(SPANS)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, others (all other columns) and ``found``: the sorted spans (start, k, end, kind), in code points.

    Null texts have no spans. Null ids and repeated rows are kept: the index knows a row by a hash of its id and text,
    and rows that share one can only add candidates to each other. An empty table gives an empty result. Texts of any
    length are scanned whole; where spans are placed, the work grows little faster than their number.
    """
    keyed = packed(docs, id_col, text_col).withColumn("key", F.xxhash64("doc_id", "text"))
    looked_up = keyed.join(candidates(trigram_index(keyed)), "key", "left")
    none = F.array().cast(SPANS)
    spans = []
    for r, rule in enumerate(RULES):
        if trigram_query(rule) is None:
            there = F.coalesce("text", F.lit("")).rlike(("(?i)" if rule.ignore_case else "") + rule.regex)
        else:
            there = F.coalesce(F.array_contains("rules", r), F.lit(False))
        spans.append(F.when(there & F.col("text").isNotNull(), matches(F.col("text"), rule)).otherwise(none))
    return looked_up.select("doc_id", "text", "others", F.array_sort(F.concat(*spans)).alias("found"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans and all spans of each document."""
    found = F.col("found")
    n_base = len(BASE_RULES)
    count = lambda k: F.size(F.filter(found, lambda s: s["k"] == k)).cast("long")
    return scan_secrets(docs).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.filter(found, lambda s: s["k"] < n_base)).cast("binary"), 256).alias("base_sha256"),
        listed(found).alias("spans"),
    )


#: Code points of the pieces into which a text is cut where parts of it are taken.
_PIECE = 4096


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mark``; overlapping spans become one mark.

    All columns stay as they are, whatever their names; null and empty texts, null ids, repeated rows and empty tables
    as in :func:`scan_secrets`. A part of a text is taken from the few pieces that hold it, so that the work grows with
    the text and the number of its secrets, not with their product.
    """
    scanned = scan_secrets(docs)
    pieces = F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % _PIECE), F.lit(0))
    reach = running(F.transform("found", lambda s: s["end"]), lambda a, b: F.greatest(a, b))  # the end of all spans so far
    shown = scanned.withColumns({"reach": F.when(F.size("found") > 0, reach), "pieces": F.when(F.size("found") > 0, pieces)})

    def part(start: Column, end: Column) -> Column:
        """Code points [start, end) of the text."""
        i, j = (F.floor(start / _PIECE).cast("int"), F.floor(end / _PIECE).cast("int"))
        piece = lambda k: F.coalesce(F.get("pieces", k), F.lit(""))
        inside = F.substring(piece(i), start % _PIECE + 1, end - start)
        middle = F.array_join(F.slice("pieces", i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        across = F.concat(F.substring(piece(i), start % _PIECE + 1, F.lit(_PIECE)), middle, F.substring(piece(j), F.lit(1), end % _PIECE))
        return F.when(end <= start, "").when(i == j, inside).otherwise(across)

    # before each span: what no earlier span covers, and a mark unless it begins inside an earlier one
    before = lambda k: F.when(k == 0, 0).otherwise(F.get("reach", k - 1))
    kept = F.transform("found", lambda s, k: F.when((s["start"] >= before(k)) | (k == 0), F.concat(part(before(k), s["start"]), F.lit(mark))).otherwise(""))
    rest = part(F.element_at("reach", -1), F.char_length("text"))
    done = F.when(F.size("found") > 0, F.concat(F.array_join(kept, ""), rest)).otherwise(F.col("text"))
    return unpacked(shown.withColumn("text", done), docs.columns)
