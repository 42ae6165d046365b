"""The registered graph queries over the relational tables, each with the SQL that gives the same rows.

The Spark side builds triple patterns and runs the general operators; the SQL side reads the tables directly.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.terms import XSD, display, plain_const, typed
from .operators.modifiers import sort
from .plans.algebra import Var
from .query import plan
from .scratch import new_path
from .sources import ntriples, results
from .sources.triples import TripleTable
from .store import TripleStore

P = "urn:p:"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, *tables: str):
    """Register a function of a store over ``tables`` (all, if none is named)."""

    def register(build: Callable[[TripleStore], DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(TripleStore.from_tables(spark, sf_dir, tables or None))
        ORACLES[build.__name__] = sql
        return build

    return register


def lex(name: str, alias: str | None = None) -> Column:
    return F.col(name)["lex"].alias(alias or name)


def num(name: str, alias: str | None = None) -> Column:
    return F.col(name)["num"].alias(alias or name)


@query("select r_name as name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name")
def agg_count_by_var(g):
    q = g.query().bgp(("?c", P + "c_nationkey", "?k"), ("?k", P + "n_regionkey", "?r"), ("?r", P + "r_name", "?name")).count_by("name")
    return q.to_df().select(lex("name"), "n")


@query("select 'urn:customer:' || c_custkey as s, c_name as o from customer")
def match_predicate(g):
    return g.match(None, P + "c_name", None).select(lex("s"), lex("o"))


@query("select 'urn:p:c_name' as p, c_name as o from customer where c_custkey = 5 union all select 'urn:p:c_mktsegment', c_mktsegment from customer where c_custkey = 5 union all select 'urn:p:c_nationkey', 'urn:nation:' || c_nationkey from customer where c_custkey = 5", "customer")
def match_subject(g):
    triples = g.match("urn:customer:5", [P + "c_name", P + "c_mktsegment", P + "c_nationkey"], None)
    return triples.select(lex("p"), lex("o"))


@query("select 'urn:customer:' || c_custkey as s from customer where c_nationkey = 7")
def match_object(g):
    return g.match(None, P + "c_nationkey", "urn:nation:7").select(lex("s"))


# The mapped columns of each table, and the tables whose rows are edges between others.
_COLUMNS = {
    "region": "r_name", "nation": "n_name n_regionkey", "customer": "c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_name s_nationkey s_acctbal",
    "part": "p_name p_brand p_type p_size p_retailprice", "orders": "o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "events": "ts user_id event_type value props", "documents": "lang source n_chars text", "labels": "quality toxic", "pages": "url html", "benchmark": "",
}
_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_EDGES = {"hasPart": "lineitem", "hasSupplier": "lineitem", "links": "nation", "maps": "nation", "role": "conversations", "said": "conversations"}
_EACH = " union all ".join(
    [f"select 'urn:p:{c}' as p, count({c}) as n from {t}" for t, cs in _COLUMNS.items() for c in cs.split()]
    + [f"select '{_TYPE}', count(*) from {t}" for t in _COLUMNS]
    + [f"select 'urn:p:{p}', count(*) from {t}" for p, t in _EDGES.items()]
    + ["select 'urn:p:next', count(*) from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1"]
    + ["select 'urn:p:follows', count(*) - count(distinct o_custkey) from orders"]
)


@query(f"select sum(n)::bigint as n from ({_EACH})")
def match_all_count(g):
    return g.triples().agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) as n from orders where o_orderstatus = 'F'")
def count_triples(g):
    return g.match(None, P + "o_orderstatus", plain_const("F")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select p, sum(n)::bigint as n from ({_EACH}) group by p having sum(n) > 0")
def predicate_histogram(g):
    return g.query().bgp(("?s", "?p", "?o")).count_by("p").to_df().select(lex("p"), "n")


@query("select 'urn:nation:' || n_nationkey as x from nation where n_nationkey = (7 * n_nationkey + 3) % 25")
def repeated_var_so(g):
    return g.bgp(("?x", P + "links", "?x")).select(lex("x"))


@query("select 'urn:customer:' || c_custkey as c, c_name as name, c_acctbal as bal, c_mktsegment as seg from customer")
def bgp_star(g):
    return g.bgp(("?c", P + "c_name", "?name"), ("?c", P + "c_acctbal", "?bal"), ("?c", P + "c_mktsegment", "?seg")).select(lex("c"), lex("name"), num("bal"), lex("seg"))


@query("select o_orderstatus as status, o_orderpriority as priority, count(*) as n, min(o_totalprice) as least, max(o_totalprice) as most from orders group by all")
def bgp_star_orders(g):
    """Four patterns with one subject, as one scan."""
    rows = g.bgp(("?o", P + "o_orderstatus", "?status"), ("?o", P + "o_orderpriority", "?priority"), ("?o", P + "o_totalprice", "?price"), ("?o", P + "o_orderdate", "?date"))
    return rows.groupBy(lex("status"), lex("priority")).agg(F.count("date.id").alias("n"), F.min("price.num").alias("least"), F.max("price.num").alias("most"))


@query("select 'urn:orders:' || o_orderkey as o, c_name as name, n_name as nation from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
def bgp_chain(g):
    return g.bgp(("?o", P + "o_custkey", "?c"), ("?c", P + "c_name", "?name"), ("?c", P + "c_nationkey", "?k"), ("?k", P + "n_name", "?nation")).select(lex("o"), lex("name"), lex("nation"))


@query("select 'urn:orders:' || o_orderkey as o, 'urn:nation:' || c_nationkey as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey and s_nationkey = c_nationkey")
def bgp_cycle_join(g):
    return g.bgp(("?o", P + "hasSupplier", "?s"), ("?o", P + "o_custkey", "?c"), ("?c", P + "c_nationkey", "?n"), ("?s", P + "s_nationkey", "?n")).select(lex("o"), lex("n"))


@query("select 'urn:orders:' || l_orderkey as o, 'urn:part:' || l_partkey as p from lineitem")
def bgp_bag_edges(g):
    return g.bgp(("?o", P + "hasPart", "?p")).select(lex("o"), lex("p"))


@query("select a.r_name as a, b.r_name as b from region a cross join region b")
def bgp_cross(g):
    return g.bgp(("?x", P + "r_name", "?a"), ("?y", P + "r_name", "?b")).select(lex("a"), lex("b"))


@query("""with t as (select 'urn:nation:' || n_nationkey as s, 'urn:p:links' as p, 'urn:nation:' || (7 * n_nationkey + 3) % 25 as o from nation
union all select 'urn:nation:' || n_nationkey, 'urn:p:maps', 'urn:nation:' || (n_nationkey * n_nationkey + 1) % 25 from nation
union all select 'urn:nation:' || n_nationkey, 'urn:p:n_name', n_name from nation
union all select 'urn:nation:' || n_nationkey, 'urn:p:n_regionkey', 'urn:region:' || n_regionkey from nation
union all select 'urn:nation:' || n_nationkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:nation' from nation)
select a.p as p, a.o as o, b.o as o2 from t a join t b on a.p = b.p where a.s = 'urn:nation:3' and b.s = 'urn:nation:4'""", "nation")
def bgp_pred_join(g):
    return g.bgp(("urn:nation:3", "?p", "?o"), ("urn:nation:4", "?p", "?o2")).where(F.col("p.lex").isNotNull()).select(lex("p"), lex("o"), lex("o2"))


@query("select 'urn:orders:' || o_orderkey as o, c_name as name from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING'")
def plan_ordered_bgp(g):
    q = plan(g.source, ("project", ("bgp", ("?o", P + "o_custkey", "?c"), ("?c", P + "c_name", "?name"), ("?c", P + "c_mktsegment", plain_const("BUILDING"))), ["o", "name"]))
    return q.to_df().select(lex("o"), lex("name"))


@query("select 'urn:region:' || n_regionkey as o from nation union all select 'urn:nation' from nation union all select 'urn:nation:' || (7 * n_nationkey + 3) % 25 from nation union all select 'urn:nation:' || (n_nationkey * n_nationkey + 1) % 25 from nation union all select 'urn:nation:' || c_nationkey from customer union all select 'urn:customer' from customer", "nation", "customer")
def filter_isiri(g):
    return g.query().bgp((None, None, "?o")).filter("o", "isiri").to_df().select(lex("o"))


@query("select n_name as o from nation union all select c_name from customer union all select c_mktsegment from customer union all select r_name from region", "nation", "customer", "region")
def filter_isliteral(g):
    return g.query().bgp(("?s", "?p", "?o")).filter("o", "isliteral").filter("p", "regex", "name$|segment$").to_df().select(lex("o"))


@query("select '_:b1b' || conv_id || '_' || turn as s, role from conversations")
def filter_isblank(g):
    return g.query().bgp(("?s", P + "role", "?role")).filter("s", "isblank").to_df().select(display(F.col("s")).alias("s"), lex("role"))


@query("select 'urn:part:' || p_partkey as s, p_size::double as o from part union all select 'urn:part:' || p_partkey, p_retailprice from part", "part")
def filter_isnumeric(g):
    return g.query().bgp(("?s", "?p", "?o")).filter("o", "isnumeric").to_df().select(lex("s"), num("o"))


@query("select s.s_name as a, t.s_name as b from supplier s join supplier t on s.s_nationkey = t.s_nationkey where s.s_suppkey = t.s_suppkey")
def filter_sameterm(g):
    q = g.query().bgp(("?x", P + "s_nationkey", "?n"), ("?y", P + "s_nationkey", "?n"), ("?x", P + "s_name", "?a"), ("?y", P + "s_name", "?b"))
    return q.filter("x", "sameterm", Var("y")).to_df().select(lex("a"), lex("b"))


@query("select c.c_name as a, d.c_name as b from customer c join customer d on c.c_nationkey = d.c_nationkey where c.c_custkey = d.c_custkey")
def filter_sameterm_all(g):
    """:func:`filter_sameterm` over customers."""
    q = g.query().bgp(("?x", P + "c_nationkey", "?n"), ("?y", P + "c_nationkey", "?n"), ("?x", P + "c_name", "?a"), ("?y", P + "c_name", "?b"))
    return q.filter("x", "sameterm", Var("y")).to_df().select(lex("a"), lex("b"))


@query("select p_name as name from part where contains(p_name, 'widget')")
def filter_contains(g):
    return g.query().bgp((None, P + "p_name", "?name")).filter("name", "contains", "widget").to_df().select(lex("name"))


@query("select 'urn:documents:' || doc_id as d from documents where lang = 'en' and contains(text, 'tion')")
def filter_contains_lang(g):
    return g.query().bgp(("?d", P + "text", "?t")).filter("t", "contains", "tion", lang="en").to_df().select(lex("d"))


@query("select p_name as name from part where starts_with(p_name, 'b')")
def filter_starts(g):
    return g.query().bgp((None, P + "p_name", "?name")).filter("name", "starts", "b").to_df().select(lex("name"))


@query("select p_name as name from part where ends_with(p_name, 't')")
def filter_ends(g):
    return g.query().bgp((None, P + "p_name", "?name")).filter("name", "ends", "t").to_df().select(lex("name"))


@query("select 'urn:part:' || p_partkey as p, p_name as name from part where regexp_matches(p_name, '^[a-m].*[aeiou]')")
def filter_regex(g):
    return g.query().bgp(("?p", P + "p_name", "?name")).filter("name", "regex", "^[a-m].*[aeiou]").to_df().select(lex("p"), lex("name"))


@query("select 'urn:part:' || p_partkey as p, p_name as name from part where regexp_matches(p_name, 'WIDGET$', 'i')")
def filter_regex_i(g):
    return g.query().bgp(("?p", P + "p_name", "?name")).filter("name", "regex", "WIDGET$", flags="i").to_df().select(lex("p"), lex("name"))


@query("select 'urn:documents:' || doc_id as d from documents where lang in ('en', 'fr') and n_chars > 1000")
def filter_langmatches_compare(g):
    q = g.query().bgp(("?d", P + "text", "?t"), ("?d", P + "n_chars", "?n")).filter("n", ">", 1000)
    return q.filter("t", "langmatches", "en").to_df().union(q.filter("t", "langmatches", "fr").to_df()).select(lex("d"))


@query("with recursive t(o) as (select (7 * 0 + 3) % 25 union select (7 * t.o + 3) % 25 from t) select 'urn:nation:' || o as o from t")
def path_bound_start(g):
    return g.query().path("urn:nation:0", P + "links", "?o").to_df().select(lex("o"))


@query("with recursive t(s, o) as (select n_nationkey, (n_nationkey * n_nationkey + 1) % 25 from nation union select t.s, (t.o * t.o + 1) % 25 from t) select 'urn:nation:' || s as s from t where o = 2")
def path_bound_end(g):
    return g.query().path("?s", P + "maps", "urn:nation:2").to_df().select(lex("s"))


@query("with recursive t(s, o) as (select n_nationkey, (n_nationkey * n_nationkey + 1) % 25 from nation union select t.s, (t.o * t.o + 1) % 25 from t) select count(*) as n from t where s = 3 and o = 1")
def path_pair(g):
    return g.query().path("urn:nation:3", P + "maps", "urn:nation:1").to_df().agg(F.count(F.lit(1)).alias("n"))


@query("with recursive t(s, o) as (select n_nationkey, (7 * n_nationkey + 3) % 25 from nation union select t.s, (7 * t.o + 3) % 25 from t) select 'urn:nation:' || s as s, 'urn:nation:' || o as o from t")
def path_all(g):
    return g.query().path("?s", P + "links", "?o").to_df().select(lex("s"), lex("o"))


@query("with recursive t(s, o) as (select n_nationkey, (n_nationkey * n_nationkey + 1) % 25 from nation union select t.s, (t.o * t.o + 1) % 25 from t) select 'urn:nation:' || s as x from t where s = o")
def path_self(g):
    return g.query().path("?x", P + "maps", "?x").to_df().select(lex("x"))


@query("with recursive t(s, o) as (select n_nationkey, (7 * n_nationkey + 3) % 25 from nation union select t.s, (7 * t.o + 3) % 25 from t) select n_name as name, 'urn:nation:' || o as o from t join nation on n_nationkey = s where n_regionkey = 0")
def path_after_bgp(g):
    q = g.query().bgp(("?n", P + "n_regionkey", "urn:region:0"), ("?n", P + "n_name", "?name"))
    return q.path("?n", P + "links", "?o").to_df().select(lex("name"), lex("o"))


@query("select '_:b1b' || a.conv_id || '_' || a.turn as s, '_:b1b' || b.conv_id || '_' || b.turn as o from conversations a join conversations b on a.conv_id = b.conv_id and a.turn < b.turn")
def path_chain_blank(g):
    return g.query().path("?s", P + "next", "?o").to_df().select(display(F.col("s")).alias("s"), display(F.col("o")).alias("o"))


@query("with recursive t(s, o) as (select n_nationkey, n_nationkey from nation union select t.s, (t.o * t.o + 1) % 25 from t) select 'urn:nation:' || s as s, 'urn:nation:' || o as o from t")
def path_star(g):
    return g.query().path("?s", P + "maps", "?o", kind="*").to_df().select(lex("s"), lex("o"))


@query("select n_name as name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def project_three_pattern(g):
    q = g.query().bgp(("?c", P + "c_nationkey", "?n"), ("?n", P + "n_regionkey", "?r"), ("?n", P + "n_name", "?name"))
    return q.project("name").to_df().select(lex("name"))


@query("select 'urn:customer:' || c_custkey as c, c_acctbal as bal from customer order by c_acctbal, 'urn:customer:' || c_custkey limit 20")
def sort_terms_topn(g):
    return g.query().bgp(("?c", P + "c_acctbal", "?bal")).sort("bal", "c").limit(20).to_df().select(lex("c"), num("bal"))


@query("select distinct p_name as name from part where contains(p_name, 'widget')")
def unique(g):
    return g.query().bgp(("?p", P + "p_name", "?name")).filter("name", "contains", "widget").project("name").unique().to_df().select(lex("name"))


@query("select c_mktsegment as seg, sum(c_acctbal) > 0 as positive, min(c_acctbal) as least, max(c_acctbal) as most from customer group by c_mktsegment")
def agg_numeric_by_var(g):
    q = g.query().bgp(("?c", P + "c_mktsegment", "?seg"), ("?c", P + "c_acctbal", "?bal"))
    total, least, most = (q.aggregate("seg", how, "bal").to_df().select(lex("seg"), how) for how in ("sum", "min", "max"))
    return total.join(least, "seg").join(most, "seg").select("seg", (F.col("sum") > 0).alias("positive"), F.col("min").alias("least"), F.col("max").alias("most"))


@query("""with e as (select 'urn:customer:' || c_custkey as s, 'urn:nation:' || c_nationkey as o from customer union all select 'urn:nation:' || n_nationkey, 'urn:region:' || n_regionkey from nation),
d as (select s as t, 0 as i, 1 as o from e union all select o, 1, 0 from e) select '<' || t || '>' as term, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree from d group by t""")
def nodes_degree(g):
    return _held(g, "c_nationkey", "n_regionkey").nodes().select("term", "in_degree", "out_degree")


_SHOWN = """select '"' || r_name || '"' as term from region union select '"' || n_name || '"' from nation union select '"' || c_name || '"' from customer union select '"' || c_mktsegment || '"' from customer
union select '<urn:region:' || r_regionkey || '>' from region union select '<urn:nation:' || n_nationkey || '>' from nation union select '<urn:customer:' || c_custkey || '>' from customer"""


@query(f"select term from ({_SHOWN}) where regexp_matches(term, '[A1].*\"$|:.*7>$')", "region", "nation", "customer")
def term_search(g):
    return g.search('[A1].*"$|:.*7>$').where("term not like '<urn:p:%'").select("term")


_LINES = """select '<urn:region:' || r_regionkey || '> <urn:p:r_name> "' || r_name || '" .' as value from region
union all select '<urn:customer:' || c_custkey || '> <urn:p:c_name> "' || c_name || '" .' from customer
union all select '<urn:customer:' || c_custkey || '> <urn:p:c_mktsegment> "' || c_mktsegment || '" .' from customer
union all select '<urn:customer:' || c_custkey || '> <urn:p:c_nationkey> <urn:nation:' || c_nationkey || '> .' from customer"""
_LINED = ("r_name", "c_name", "c_mktsegment", "c_nationkey")


def _held(g: TripleStore, *columns: str) -> TripleStore:
    """A store that holds the triples of these mapped columns."""
    return TripleStore(TripleTable.of(reduce(DataFrame.union, [g.match(None, P + c, None) for c in columns])))


@query(_LINES)
def ntriples_lines(g):
    return _held(g, *_LINED).ntriples()


@query("select 'urn:orders:' || a.o_orderkey as s, 'urn:orders:' || b.o_orderkey as o from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey")
def path_orders(g):
    """A closure as large as a table: all later orders of the same customer."""
    return g.query().path("?s", P + "follows", "?o").to_df().select(lex("s"), lex("o"))


@query("select 'urn:orders:' || o_orderkey as o from orders where o_custkey = (select o_custkey from orders where o_orderkey = 7) and o_orderkey > 7")
def path_orders_bound(g):
    return g.query().path("urn:orders:7", P + "follows", "?o").to_df().select(lex("o"))


@query(_LINES)
def import_ntriples(g):
    """Written as N-Triples in many files, loaded from them."""
    path = new_path(g.spark, "ntriples")
    ntriples.write(_held(g, *_LINED).triples(), path)
    return TripleStore.from_ntriples(g.spark, path).ntriples()


@query("select 'urn:nation:' || n_nationkey as s, n_name as name, 'urn:region:' || n_regionkey as r from nation")
def import_turtle(g):
    """Turtle with prefixes, predicate lists and a language; the tag is normalised."""
    path = new_path(g.spark, "turtle")
    rows = g.bgp(("?s", P + "n_name", "?name"), ("?s", P + "n_regionkey", "?r"))
    text = F.concat(F.lit("@prefix p: <urn:p:> . "), ntriples.token(F.col("s")), F.lit(" p:name "), ntriples.token(F.col("name")), F.lit("@EN-us ; p:in "), ntriples.token(F.col("r")), F.lit(" ."))
    rows.select(text.alias("value")).write.text(path)
    loaded = TripleStore.from_turtle(g.spark, path)
    return loaded.query().bgp(("?s", P + "name", "?name"), ("?s", P + "in", "?r")).filter("name", "contains", "", lang="en-US").to_df().select(lex("s"), lex("name"), lex("r"))


@query("""select 'name' as what, count(*) as n, count(*)::double as total from customer union all select 'key', count(*), sum(c_custkey)::double from customer union all select 'nodes', count(*), 0 from customer""")
def import_terms(g):
    """Language tags in any case, valid and invalid numbers, and one blank-node label in all lines of a file."""
    path = new_path(g.spark, "terms")
    rows = g.bgp(("?c", P + "c_name", "?name"))
    text, quoted = lambda c: F.concat(F.lit("_:x <urn:p:"), c, F.lit(" .")), ntriples.token(F.col("name"))
    number = F.concat(F.lit('"'), F.regexp_extract("c.lex", r"\d+$", 0))
    lines = F.array(
        text(F.concat(F.lit("name> "), quoted, F.lit("@DE-at"))), text(F.concat(F.lit("name> "), quoted, F.lit("@deutsch"))),
        text(F.concat(F.lit("key> "), number, F.lit(f'"^^<{XSD}integer>'))), text(F.concat(F.lit("key> "), number, F.lit(f'.5"^^<{XSD}integer>'))),
        text(F.concat(F.lit("is> "), ntriples.token(F.col("c")))),
    )
    rows.select(F.explode(lines).alias("value")).coalesce(1).write.text(path)
    loaded = TripleStore.from_ntriples(g.spark, path)
    names = loaded.query().bgp(("?s", P + "name", "?n")).filter("n", "langmatches", "de-AT").to_df()
    nodes = loaded.bgp((None, P + "is", "?c"), ("?c2", P + "is", "?c"))
    keys = loaded.bgp((None, P + "key", "?k"))
    counted = lambda df, what, total: df.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"), total.cast("double").alias("total"))
    return counted(names, "name", F.count(F.lit(1))).union(counted(keys, "key", F.sum("k.num"))).union(counted(nodes, "nodes", F.lit(0)))


@query("select 'urn:customer:' || c_custkey as s, c_name as name from customer where c_custkey = 9 union all select 'urn:customer:' || c_custkey, c_mktsegment from customer where c_nationkey = 7")
def snapshot_access(g):
    """Held triples, saved and read back: a constant subject, and a constant object."""
    path = new_path(g.spark, "snapshot")
    _held(g, "c_name", "c_mktsegment", "c_nationkey").save(path)
    again = TripleStore.from_snapshot(g.spark, path)
    by_subject = again.match("urn:customer:9", P + "c_name", None).select(lex("s"), lex("o", "name"))
    by_object = again.bgp(("?s", P + "c_nationkey", "urn:nation:7"), ("?s", P + "c_mktsegment", "?o"))
    return by_subject.union(by_object.select(lex("s"), lex("o")))


@query("select c_mktsegment as o, 2 * count(*) as n from customer group by c_mktsegment")
def add_triples(g):
    """The same triples added twice count twice; ``size`` sees them all."""
    one = _held(g, "c_mktsegment")
    return one.add(one.triples()).query().bgp((None, P + "c_mktsegment", "?o")).count_by("o").to_df().select(lex("o"), "n")


@query("select 2 * count(*) as n, (select count(*) from customer) as subjects, 2 as predicates from customer")
def edges_count(g):
    edges = _held(g, "c_name", "c_mktsegment").edges()
    return edges.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("subjects"), F.count_distinct("p").cast("int").alias("predicates"))


@query("select 'urn:customer:' || c_custkey as s from customer where c_mktsegment = 'BUILDING'")
def match_by_ids(g):
    """The key of a constant is computed, not looked up; the term that it names is."""
    held = _held(g, "c_mktsegment")
    k = g.spark.range(1).select(plain_const("BUILDING").key().alias("k")).first()["k"]
    return held.match_ids(o=held.term(tuple(k)).first()["t"]).select(lex("s"))


@query("select count(*) as n from customer where c_mktsegment = 'BUILDING'")
def query_count(g):
    n = g.query().bgp(("?c", P + "c_mktsegment", plain_const("BUILDING"))).count()
    return g.spark.range(1).select(F.lit(n).cast("long").alias("n"))


@query("""select '<urn:customer:' || c_custkey || '>' || chr(9) || '"' || c_name || '"' || chr(9) || '<urn:nation:' || c_nationkey || '>' as value from customer""")
def result_tsv(g):
    return results.tsv_lines(g.bgp(("?c", P + "c_name", "?name"), ("?c", P + "c_nationkey", "?n")))


@query("""select 'c=<urn:customer:' || c_custkey || '> name="' || c_name || '"' as value from customer""")
def result_lines(g):
    return results.bound_lines(g.bgp(("?c", P + "c_name", "?name")))


@query("with recursive t(s, o) as (select n_nationkey, (7 * n_nationkey + 3) % 25 from nation union select t.s, (7 * t.o + 3) % 25 from t) select 'urn:nation:' || s as s, 'urn:nation:' || o as o from t")
def plan_path(g):
    return plan(g.source, ("path", "?s", P + "links", "?o")).to_df().select(lex("s"), lex("o"))


@query("with recursive t(s, o) as (select n_nationkey, (7 * n_nationkey + 3) % 25 from nation union select t.s, (7 * t.o + 3) % 25 from t) select n_name as name, 'urn:nation:' || o as o from t join nation on n_nationkey = s where n_name like 'A%'")
def plan_join(g):
    tree = ("join", ("filter", ("bgp", ("?n", P + "n_name", "?name")), "name", "strstarts", "A"), ("path", "?n", P + "links", "?o"))
    return plan(g.source, tree).to_df().select(lex("name"), lex("o"))


@query("select c_name as name from customer join nation on c_nationkey = n_nationkey where regexp_matches(n_name, '^[A-F]')")
def plan_filter(g):
    tree = ("project", ("filter", ("bgp", ("?c", P + "c_nationkey", "?n"), ("?n", P + "n_name", "?nation"), ("?c", P + "c_name", "?name")), "nation", "regex", "^[A-F]"), ["name"])
    return plan(g.source, tree).to_df().select(lex("name"))


@query("select o from (select '\"' || n_name || '\"' as o, 0 as k, null as num from nation union all select '<urn:region:' || n_regionkey || '>', 0, null from nation union all select n_nationkey::varchar, 1, n_nationkey from nation) order by k, num, o limit 60")
def sort_mixed(g):
    """Texts by their display form, then numbers by value."""
    number = typed(F.regexp_extract("s.lex", r"\d+$", 0), F.lit(XSD + "integer"))
    rows = g.match(None, P + "n_name", None).select("o").union(g.match(None, P + "n_regionkey", None).select("o")).union(g.match(None, P + "n_name", None).select(number.alias("o")))
    return sort(rows, ["o"]).limit(60).select(display(F.col("o")).alias("o"))
