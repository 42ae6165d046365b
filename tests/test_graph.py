"""Pattern, filter, path and modifier semantics on small graphs with known answers."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.functions.terms import RDF_TYPE, XSD, blank, display, iri, lang_const, plain_const, typed_const
from graphloom.operators import paths
from graphloom.plans.algebra import Var
from graphloom.plans.order import is_connected, ordered, starts_unbound
from graphloom.query import Query, pattern, plan
from graphloom.sources import ntriples, results
from graphloom.store import TripleStore

EX, FOAF = "http://example.org/", "http://xmlns.com/foaf/0.1/"
KNOWS, NAME = FOAF + "knows", FOAF + "name"


def values(df, *names):
    """Sorted rows of lexical values."""
    return sorted(tuple(r) for r in df.select(*[F.col(n)["lex"].alias(n) for n in (names or df.columns)]).collect())


def store(spark, text, **options):
    text = text.replace("ex:", EX).replace("foaf:", FOAF)
    lines = spark.createDataFrame([(line,) for line in text.strip().split("\n")], "value string")
    return TripleStore.empty(spark).add(ntriples.parse(lines, **options))


@pytest.fixture(scope="module")
def small(spark):
    return store(spark, """
<ex:s> <ex:p> <ex:o> .
<ex:x> <ex:y> <ex:z> .
<ex:z> <ex:p> "1" .
<ex:z> <ex:p> "10" .
<ex:z> <ex:p> "20" .
<ex:z> <ex:p> "50" .""")


@pytest.fixture(scope="module")
def people(spark):
    t = f"<{RDF_TYPE}>"
    return store(spark, f"""
<ex:tim> {t} <foaf:Person> .
<ex:tim> <foaf:name> "Timothy" .
<ex:alice> {t} <foaf:Person> .
<ex:alice> <foaf:name> "Alice" .
<ex:alice> <foaf:knows> <ex:bob> .
<ex:alice> <foaf:knows> <ex:tim> .
<ex:bob> {t} <foaf:Person> .
<ex:bob> <foaf:name> "Robert" .
<ex:bob> <foaf:knows> <ex:alice> .
<ex:eve> {t} <foaf:Person> .
<ex:eve> <foaf:name> "Eve" .
<ex:eve> <foaf:knows> <ex:alice> .
<foaf:Person> {t} <http://www.w3.org/2000/01/rdf-schema#Class> .""")


def test_empty(spark):
    empty = TripleStore.empty(spark)
    assert empty.size() == 0
    assert empty.bgp(("?s", EX + "p", "?o")).collect() == []
    assert empty.query().path("?s", EX + "p", "?o").to_df().collect() == []
    assert empty.nodes().collect() == []


def test_single_pattern(small):
    rows = values(small.bgp(("?s", EX + "p", "?o1")), "s", "o1")
    assert len(rows) == 5 and {r[0] for r in rows} == {EX + "s", EX + "z"}
    assert small.count(None, EX + "p", None) == 5 and small.count(EX + "none") == 0 and small.size() == 6
    assert small.match([EX + "s", EX + "x"], None, None).count() == 2


def test_chains(small):
    rows = values(small.bgp((EX + "x", "?p1", "?o"), ("?o", "?p2", "?end")), "end")
    assert rows == [("1",), ("10",), ("20",), ("50",)]
    rows = values(small.bgp(("?start", "?p1", "?o"), ("?o", "?p2", "?end")), "start")
    assert rows == [(EX + "x",)] * 4


def test_filters_on_chain(small):
    q = small.query().bgp(("?s", EX + "p", "?o"))
    assert q.filter("o", "regex", "1").count() == 2
    assert q.filter("o", "isiri").filter("o", "regex", "1").count() == 0
    with pytest.raises(ValueError):
        q.filter("nobody", "isiri").to_df()
    with pytest.raises(ValueError):
        q.filter("o", "sounds-like", "1").to_df()


def test_plans(small, people):
    q = plan(people.source, ("filter", ("bgp", ("?s", NAME, "?name")), "name", "contains", "o"))
    assert values(q.to_df(), "name") == [("Robert",), ("Timothy",)]
    assert q.summary() == "Query { BGP -> Filter }"
    assert plan(people.source, ("union", ("bgp",), ("bgp",))) is None
    assert plan(people.source, ("filter", ("union",), "s", "isiri")) is None
    q = plan(small.source, ("project", ("bgp", ("?s", EX + "p", "?o")), ["o"]))
    assert q.to_df().columns == ["o"]
    q = plan(people.source, ("filter", ("bgp", ("?s", NAME, "?n")), "n", "STRSTARTS", "A"))
    assert values(q.to_df(), "n") == [("Alice",)]


def test_greedy_order():
    a, b, c = pattern("?s", "?p", "?o"), pattern("?s", EX + "p", "?x"), pattern(EX + "s", EX + "p", "?x")
    assert ordered((a, b, c)) == (c, b, a)
    assert is_connected((a, b, c)) and not is_connected((pattern("?a", EX + "p", "?b"), pattern("?c", EX + "p", "?d")))
    assert starts_unbound((a, b, c)) and not starts_unbound((a, b))


@pytest.mark.parametrize("start,expected", [("eve", {"alice", "bob", "tim"}), ("alice", {"alice", "bob", "tim"}), ("bob", {"alice", "bob", "tim"}), ("tim", set())])
def test_path_bound_start(people, start, expected):
    assert {r[0] for r in values(people.query().path(EX + start, KNOWS, "?o").to_df())} == {EX + x for x in expected}


def test_path_free(people):
    pairs = {(a, b) for a in ("eve", "alice", "bob") for b in ("alice", "bob", "tim")}
    assert set(values(people.query().path("?s", KNOWS, "?o").to_df(), "s", "o")) == {(EX + a, EX + b) for a, b in pairs}
    named = people.query().bgp(("?s", NAME, "?name")).path("?s", KNOWS, "?o").to_df()
    assert len(values(named, "name", "o")) == 9


def test_path_ends(people):
    q = people.query()
    assert q.path(EX + "eve", KNOWS, EX + "tim").count() == 1
    assert q.path(EX + "tim", KNOWS, EX + "eve").count() == 0
    assert {r[0] for r in values(q.path("?s", KNOWS, EX + "tim").to_df())} == {EX + x for x in ("eve", "alice", "bob")}
    assert {r[0] for r in values(q.path("?x", KNOWS, "?x").to_df())} == {EX + "alice", EX + "bob"}
    assert q.bgp(("?s", KNOWS, "?o")).path("?s", KNOWS, "?o").count() == 4
    assert q.bgp((EX + "eve", NAME, "?n")).path("?s", KNOWS, EX + "tim").count() == 3
    assert q.path("?a", EX + "none", "?b").count() == 0
    assert {r[0] for r in values(q.path(EX + "tim", KNOWS, "?o", kind="*").to_df())} == {EX + "tim"}
    with pytest.raises(ValueError):
        q.path("?s", KNOWS, "?o", kind="?")


def test_projection_keeps_multiplicity(people):
    q = people.query().bgp(("?s", RDF_TYPE, FOAF + "Person"), ("?s", KNOWS, "?f"), ("?s", NAME, "?n")).project("n")
    assert values(q.to_df()) == [("Alice",), ("Alice",), ("Eve",), ("Robert",)]
    assert values(q.unique().to_df()) == [("Alice",), ("Eve",), ("Robert",)]
    with pytest.raises(ValueError):
        q.project("gone").to_df()


def test_shapes(spark):
    g = store(spark, """
<ex:a> <ex:a> <ex:b> .
<ex:a> <ex:q> <ex:a> .
<ex:b> <ex:r> <ex:r> .
<ex:c> <ex:c> <ex:c> .
<ex:a> <ex:q> <ex:b> .
<ex:a> <ex:q> <ex:b> .""")
    n = lambda *p: g.bgp(p).count()
    assert n("?x", "?x", "?o") == 2 and n("?x", "?p", "?x") == 2 and n("?s", "?x", "?x") == 2 and n("?x", "?x", "?x") == 1
    assert g.match(EX + "a", EX + "q", EX + "b").count() == 2 and n("?s", "?p", "?o") == 6 and n(None, "?p", None) == 6
    assert g.dedup().size() == 5
    counts = {r["p"]: r["n"] for r in g.query().bgp((None, "?p", None)).count_by("p").to_df().select(F.col("p.lex").alias("p"), "n").collect()}
    assert counts == {EX + "a": 1, EX + "q": 3, EX + "r": 1, EX + "c": 1}
    degrees = {r["term"]: (r["in_degree"], r["out_degree"]) for r in g.nodes().collect()}
    assert degrees[f"<{EX}b>"] == (3, 1) and degrees[f"<{EX}r>"] == (1, 0)
    assert g.search("org/[ab]>$").count() == 2 and g.search("org/", 1).count() == 1 and g.edges().count() == 6


TERMS = r"""
<ex:s> <ex:p> "abc def" .
<ex:s> <ex:p> "abc" .
<ex:s> <ex:p> "abc"@EN .
<ex:s> <ex:p> "abc"@EN-us .
<ex:s> <ex:p> "abc"@zh-hant .
<ex:s> <ex:p> "abc"@eng .
<ex:s> <ex:p> "abc"@es-419 .
<ex:s> <ex:p> "7"^^<xsd:integer> .
<ex:s> <ex:p> "+07"^^<xsd:integer> .
<ex:s> <ex:p> "7.5"^^<xsd:integer> .
<ex:s> <ex:p> "7.0"^^<xsd:decimal> .
<ex:s> <ex:p> ".5"^^<xsd:decimal> .
<ex:s> <ex:p> "1.5E3"^^<xsd:double> .
<ex:s> <ex:p> "-INF"^^<xsd:float> .
<ex:s> <ex:p> "1"^^<xsd:double> .
<ex:s> <ex:p> "2015-01-02"^^<xsd:date> .
<ex:s> <ex:p> "2015-1-2"^^<xsd:date> .
<ex:s> <ex:p> "2015-01-02T03:04:05+01:00"^^<xsd:dateTime> .
<ex:s> <ex:p> "true"^^<xsd:boolean> .
<ex:s> <ex:p> "5"^^<xsd:int> .
<ex:s> <ex:p> "q\"\\\né\U0001F600"^^<xsd:string> .
<ex:s> <ex:p> "" .
<ex:s> <ex:p> _:a .
<ex:s> <ex:p> <ex:x> . # a comment

# only a comment
this is no triple
""".replace("xsd:", XSD)


def test_import_validation(spark):
    g = store(spark, TERMS)
    shown = {r["o"] for r in g.triples().select(display(F.col("o")).alias("o")).collect()}
    assert '"abc"@en-US' in shown and '"abc"@zh-Hant' in shown and '"q"\\\né😀"' in shown and '""' in shown and "_:b1ba" in shown
    assert not any("eng" in x or "419" in x for x in shown) and g.size() == 18
    lines = spark.createDataFrame([(x,) for x in TERMS.split("\n")], "value string")
    assert ntriples.rejected(lines).count() == 7
    assert ntriples.parse(lines, on_invalid="keep").count() == 24
    with pytest.raises(Exception, match="invalid triple"):
        ntriples.parse(lines, on_invalid="fail").collect()
    nums = {r["lex"]: r["num"] for r in g.triples().select("o.lex", "o.num").collect()}
    assert nums["+07"] == nums["7"] == nums["7.0"] == 7.0 and nums["5"] is None and nums["-INF"] == float("-inf") and nums["2015-01-02"] is None


def test_sort_order(spark):
    text = "\n".join(f"<ex:s> <ex:p> {o} ." for o in ('"1.5E3"^^<xsd:double>', '"7"^^<xsd:integer>', '"-1"^^<xsd:integer>', '"true"^^<xsd:boolean>', "_:a", "<ex:x>", '"abc"@en', '"abc"', '"abc def"')).replace("xsd:", XSD)
    df = store(spark, text).query().bgp((None, EX + "p", "?o")).sort("o").to_df()
    assert [r[0] for r in df.select(display(F.col("o"))).collect()] == ['"abc def"', '"abc"', '"abc"@en', f"<{EX}x>", "_:b1ba", "true", "-1", "7", "1.5E3"]
    unbound = df.select("o").union(spark.range(1).select(F.lit(None).cast(df.schema["o"].dataType)))
    from graphloom.operators.modifiers import sort

    assert sort(unbound, ["o"]).collect()[-1]["o"] is None


def test_string_filters(spark):
    q = store(spark, '<ex:s> <ex:p> "abc" .\n<ex:s> <ex:p> "abc"@en .\n<ex:s> <ex:p> "abc"@en-us .\n<ex:s> <ex:p> <ex:abc> .\n<ex:s> <ex:p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .').query().bgp((None, EX + "p", "?o"))
    n = lambda *a, **k: q.filter("o", *a, **k).count()
    assert n("contains", "b") == 1 and n("contains", "") == 1 and n("contains", lang_const("b", "en")) == 1 and n("contains", "b", lang="en-US") == 1
    assert n("starts", "a") == 3 and n("ends", "c") == 4 and n("regex", "B") == 0 and n("regex", "B", flags="i") == 4
    assert n("isiri") == 1 and n("isuri") == 1 and n("isliteral") == 4 and n("isblank") == 0 and n("isnumeric") == 1
    assert n("sameterm", plain_const("abc")) == 1 and n("sameterm", Var("o")) == 5 and n(">=", 5) == 1 and n("<", 5) == 0
    assert n("langmatches", "en") == 2 and n("langmatches", "*") == 2
    assert q.filter("o", "sameterm", typed_const("5", XSD + "integer")).count() == 1


def test_regex_dot(spark):
    q = store(spark, '<ex:s> <ex:p> "a\\rb" .\n<ex:s> <ex:p> "a\\nb" .').query().bgp((None, EX + "p", "?o"))
    assert q.filter("o", "regex", "a.b").count() == 1


def test_round_trips(spark, small, tmp_path):
    small.save(str(tmp_path / "snap"), check_ids=True)
    again = TripleStore.from_snapshot(spark, str(tmp_path / "snap"))
    assert again.size() == 6 and again.count(None, EX + "p", None) == 5
    plan_text = again.match(None, EX + "p", None)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(pkey" in plan_text
    g = store(spark, TERMS)
    ntriples.write(g.triples(), str(tmp_path / "out"))
    assert TripleStore.from_ntriples(spark, str(tmp_path / "out")).size() == g.size()
    with pytest.raises(PermissionError):
        again.as_read_only().add(small.triples())


def test_blank_scopes(spark, tmp_path):
    (tmp_path / "a.nt").write_text("_:a <http://e/p> _:a .\n")
    g = TripleStore.from_ntriples(spark, str(tmp_path / "a.nt")).load(str(tmp_path / "a.nt"))
    assert g.size() == 2 and g.bgp(("?x", "http://e/p", "?x")).select("x.id").distinct().count() == 2


def blank_subjects(g):
    return {r[0] for r in g.triples().select("s.lex").collect()}


def test_each_file_has_blank_nodes_of_its_own(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.nt").write_text("_:a <http://e/p> _:a .\n_:a <http://e/q> _:b .\n")
        (tmp_path / folder / "a.ttl").write_text("_:a <http://e/p> _:a . [] <http://e/q> _:a .")
        (tmp_path / folder / "a-.ttl").write_text("_:a <http://e/p> _:a . [] <http://e/q> _:a .")
    nt = TripleStore.from_ntriples(spark, str(tmp_path / "*" / "*.nt"))
    assert nt.size() == 4 and len(blank_subjects(nt)) == 2 and nt.bgp(("?x", "http://e/p", "?x"), ("?x", "http://e/q", "?y")).count() == 2
    ttl = TripleStore.from_turtle(spark, str(tmp_path / "*" / "*.ttl"))
    assert ttl.size() == 8 and len(blank_subjects(ttl)) == 8 and ttl.bgp(("?x", "http://e/p", "?x"), ("?y", "http://e/q", "?x")).count() == 4
    both = nt.load(str(tmp_path / "x" / "a.nt"))
    assert len(blank_subjects(both)) == 3


def test_scopes_go_on_after_a_snapshot(spark, tmp_path):
    (tmp_path / "a.nt").write_text("_:a <http://e/p> _:a .\n")
    g = TripleStore.from_ntriples(spark, str(tmp_path / "a.nt"))
    for k in range(2):
        g.save(str(tmp_path / f"snap{k}"))
        g = TripleStore.from_snapshot(spark, str(tmp_path / f"snap{k}")).load(str(tmp_path / "a.nt"))
    assert g.size() == 3 and len(blank_subjects(g)) == 3


def test_long_literals(spark, tmp_path):
    """Ten million characters, and as many escapes as a pattern that recurses could not take."""
    long, escapes = "x" * 10_000_000, "\\n" * 200_000
    (tmp_path / "a.nt").write_text(f'<http://e/s> <http://e/p> "{long}" .\n<http://e/s> <http://e/q> "{escapes}"@en .\n<http://e/s> <http://e/r> "open {long} .\n')
    g = TripleStore.from_ntriples(spark, str(tmp_path / "a.nt"))
    assert {(r[0], r[1]) for r in g.triples().select("p.lex", F.length("o.lex")).collect()} == {("http://e/p", 10_000_000), ("http://e/q", 200_000)}
    assert g.match(None, "http://e/q", None).where(F.col("o.lex") == "\n" * 200_000).count() == 1


def test_terms_with_one_hash_stay_apart(spark):
    """A forced collision of ``id``: joins, grouping, distinct, filters and paths go by the second hash, too."""
    t = iri(F.col("x"))
    forced = F.struct(F.lit(1).cast("long").alias("id"), *[t[f].alias(f) for f in ("id2", "kind", "lex", "lang", "dt", "num")])
    rows = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "x string, y string")
    s = rows.select(forced.alias("s"), iri(F.lit("http://e/p")).alias("p"), "y")
    triples = s.withColumn("x", F.col("y")).select("s", "p", forced.alias("o"))
    g = TripleStore.empty(spark).add(triples)
    assert g.bgp(("?a", "http://e/p", "?b"), ("?b", "http://e/p", "?c")).count() == 2
    assert g.bgp(("?a", "http://e/p", "?a")).count() == 0
    assert g.query().path("?a", "http://e/p", "?b").count() == 6
    q = g.query().bgp(("?a", "http://e/p", "?b"))
    assert q.project("a").unique().count() == 3 and q.count_by("a").to_df().count() == 3 and q.filter("a", "sameterm", Var("b")).count() == 0
    assert g.dedup().size() == 3 and g.terms().count() == 5 and g.nodes().count() == 4
    key = g.triples().where("s.lex = 'b'").first()["s"]
    assert g.match_ids(s=key).count() == 1 and g.match_ids(s=1).count() == 3 and g.term(key).count() == 1


def test_snapshot_access_paths(spark, small, tmp_path):
    """A constant subject or object reaches the scan; files are in the order of subjects and know their objects."""
    import pyarrow.parquet as pq

    many = spark.range(5000).select(iri(F.concat(F.lit("http://e/s"), "id")).alias("s"), iri(F.lit("http://e/p")).alias("p"), iri(F.concat(F.lit("http://e/o"), F.col("id") % 97)).alias("o"))
    TripleStore.empty(spark).add(many.repartition(8)).save(str(tmp_path / "snap"))
    files = list((tmp_path / "snap").glob("pkey=*/*.parquet"))
    assert len(files) <= 5  # not one of each input task
    ids = [[x["id"] for x in pq.read_table(f).column("s").to_pylist()] for f in files]
    assert all(x == sorted(x) for x in ids) and sum(map(len, ids)) == 5000
    spans = sorted((x[0], x[-1]) for x in ids)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    again = TripleStore.from_snapshot(spark, str(tmp_path / "snap"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    for pattern_ in (("http://e/s7", "http://e/p", None), (None, "http://e/p", "http://e/o7")):
        df = again.match(*pattern_)
        plan_text = df._jdf.queryExecution().executedPlan().toString()
        assert f"EqualTo({'s' if pattern_[0] else 'o'}.id," in plan_text and df.count() == (1 if pattern_[0] else 52)


def test_patterns_run_in_order_of_selectivity(people):
    """The constant one first, whatever the order given; columns stand as the patterns name them."""
    df = people.bgp(("?a", "?p", "?b"), ("?b", NAME, "?n"), (EX + "eve", KNOWS, "?b"))
    assert df.columns == ["a", "p", "b", "n"] and values(df, "a", "b", "n") == [(EX + "bob", EX + "alice", "Alice"), (EX + "eve", EX + "alice", "Alice")]


TURTLE = """
@prefix ex: <http://example.org/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
PREFIX f: <http://xmlns.com/foaf/0.1/>
ex:a a f:Person ; f:name "A"@EN , 'B' ; ex:age 5 , -2.5 , 1.0e3 , true ; ex:long \"\"\"two
"lines\" \"\"\" ;  .
ex:l ex:list ( 1 "x" ) . # comment
[ ex:in [ ex:deep <rel> ] ] ex:p ex:q.r .
[] ex:bad "x"^^xsd:integer .
"""


def test_turtle(spark, tmp_path):
    (tmp_path / "t.ttl").write_text(TURTLE)
    g = TripleStore.empty(spark).load(str(tmp_path / "t.ttl"))
    assert g.size() == 17 - 1
    assert values(g.match(EX + "a", EX + "age", None), "o") == [("-2.5",), ("1.0e3",), ("5",), ("true",)]
    assert values(g.match(EX + "a", EX + "long", None), "o") == [('two\n"lines" ',)]
    assert g.match(None, None, EX + "q.r").count() == 1
    from graphloom.sources import turtle

    with pytest.raises(Exception, match="use N-Triples"):
        turtle.read(spark, str(tmp_path / "t.ttl"), max_bytes=10).collect()
    (tmp_path / "bad.ttl").write_text("this is { no turtle")
    with pytest.raises(Exception, match="not Turtle"):
        TripleStore.from_turtle(spark, str(tmp_path / "bad.ttl")).size()


def test_result_text(spark, tmp_path):
    g = store(spark, '<ex:s> <ex:p> "a\\tb" .\n<ex:s> <ex:p> "7"^^<http://www.w3.org/2001/XMLSchema#integer> .')
    df = g.query().bgp(("?s", EX + "p", "?o")).sort("o").to_df()
    assert results.tsv_header(df) == "?s\t?o"
    assert [r[0] for r in results.tsv_lines(df).collect()] == [f'<{EX}s>\t"a\\tb"', f"<{EX}s>\t7"]
    assert [r[0] for r in results.bound_lines(df.withColumn("u", F.lit(None).cast(df.schema["o"].dataType))).collect()][1] == f"s=<{EX}s> o=7"
    results.write_tsv(df.coalesce(1), str(tmp_path / "tsv"))
    written = next((tmp_path / "tsv").glob("part-*")).read_text().split("\n")
    assert written[0] == "?s\t?o" and written[1].endswith('"a\\tb"')


def test_streaming_ingest(spark, tmp_path):
    from graphloom.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.nt").write_text(f'<http://e/s{k}> <http://e/p> "v" .\nbroken\n_:a <http://e/q> _:a .\n')
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "snap"), str(tmp_path / "cp")).awaitTermination()
    g = TripleStore.from_snapshot(spark, str(tmp_path / "snap"))
    assert g.count(None, "http://e/p", None) == 2 and g.bgp(("?x", "http://e/q", "?x")).select("x.lex").distinct().count() == 2


def test_trees_stand_in(spark):
    sm = "http://data.smgov.net/resource/zzzz-zzzz/"
    names = ["PEPPERMINT TREE"] + ["BRAZILIAN PEPPER"] * 4 + ["MEXICAN FAN PALM"] * 7 + ["Canary Island Palm"] * 5 + ["FICUS"] * 38
    rows, palms = [], 0
    for i, n in enumerate(names):
        street = "MONTANA AVE"
        if "palm" in n.lower():
            palms += 1
            street = "ALTA AVE" if palms <= 5 else "EUCLID ST"
        rows += [f'<ex:tree{i}> <{sm}commonname> "{n}" .', f'<ex:tree{i}> <{sm}fullname> "{street}" .']
    g = store(spark, "\n".join(rows))
    q = g.query().bgp(("?s", sm + "commonname", "?tree"))
    assert q.count() == 55
    pepper = q.filter("tree", "contains", "PEPPER")
    assert values(pepper.to_df(), "tree") == [("BRAZILIAN PEPPER",)] * 4 + [("PEPPERMINT TREE",)]
    assert values(pepper.project("tree").unique().to_df()) == [("BRAZILIAN PEPPER",), ("PEPPERMINT TREE",)]
    df = g.query().bgp(("?s", sm + "commonname", "?tree"), ("?s", sm + "fullname", "?street")).filter("tree", "regex", "palm", flags="i").project("street", "tree").sort("street", "tree").to_df()
    assert [r[0] for r in df.select("street.lex").collect()] == ["ALTA AVE"] * 5 + ["EUCLID ST"] * 7


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    """Two- and three-pattern joins and closures against a plain evaluator."""
    rng = random.Random(seed)
    triples = [(f"n{rng.randrange(7)}", f"p{rng.randrange(3)}", f"n{rng.randrange(7)}") for _ in range(25)]
    g = store(spark, "\n".join(f"<ex:{s}> <ex:{p}> <ex:{o}> ." for s, p, o in triples))
    got = values(g.bgp(("?a", EX + "p0", "?b"), ("?b", "?q", "?c"), ("?c", EX + "p1", "?d")), "a", "b", "q", "c", "d")
    want = sorted((EX + s, EX + o, EX + q, EX + o2, EX + o3) for s, p, o in triples if p == "p0" for s2, q, o2 in triples if s2 == o for s3, p3, o3 in triples if s3 == o2 and p3 == "p1")
    assert got == want
    reach = {(s, o) for s, p, o in triples if p == "p2"}
    while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
        reach |= more
    assert set(values(g.query().path("?s", EX + "p2", "?o").to_df(), "s", "o")) == {(EX + a, EX + b) for a, b in reach}


@pytest.mark.parametrize("most", [1, 8, 1000])
@pytest.mark.parametrize("terms", [False, True])
def test_closure_by_components(spark, most, terms):
    """chains, cycles, a hub and repeated edges, each edge in a partition of its own; large components go by rounds."""
    rng = random.Random(most)
    edges = [(100 + i, 101 + i) for i in range(12)] + [(200, 201), (201, 202), (202, 200), (202, 203), (300, 300), (400, 401), (400, 401)]
    edges += [(500 + i, 510) for i in range(5)] + [(510, 520 + i) for i in range(5)] + [(600 + rng.randrange(12), 600 + rng.randrange(12)) for _ in range(14)]
    rng.shuffle(edges)
    reach = set(edges)
    while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
        reach |= more
    df = spark.createDataFrame(edges, "s long, o long").repartition(len(edges))
    if terms:
        df = df.select(iri(F.col("s").cast("string")).alias("s"), iri(F.col("o").cast("string")).alias("o"))
    got = paths.closure(df, most)
    got = got.select(*[F.col(f"{c}.lex").cast("long") for c in "so"]) if terms else got
    assert sorted(map(tuple, got.collect())) == sorted(reach)


def test_chunks_hold_whole_components(monkeypatch):
    """Components cut by a batch, and more of them than are marked at a time."""
    monkeypatch.setattr(paths, "READ", 7)
    monkeypatch.setattr(paths, "MARKED", 20)
    rows = [(10 * c + i, 10 * c + i + 1, c) for c in range(20) for i in range(c % 5 + 1)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("s", "o", "label"), r)) for r in rows[i : i + 3]]) for i in range(0, len(rows), 3)]
    got = sorted((r["s"], r["o"]) for b in paths._solved(batches) for r in b.to_pylist())
    assert got == sorted((10 * c + i, 10 * c + k) for c in range(20) for i in range(c % 5 + 1) for k in range(i + 1, c % 5 + 2))


def test_query_is_immutable(small):
    q = Query(small.source)
    longer = q.bgp(("?s", "?p", "?o")).limit(2)
    assert q.ops == () and longer.count() == 2
    with pytest.raises(ValueError):
        q.to_df()
    with pytest.raises(ValueError):
        q.project("s").to_df()


def test_ids_and_strict(small):
    row = small.match(EX + "x", None, None).first()
    assert small.match_ids(o=row["o"]["id"]).count() == 1 and small.match_ids(s=row["o"]["id"]).count() == 4
    assert small.term(row["p"]["id"]).first()["t"]["lex"] == EX + "y" and small.term(5).count() == 0
    with pytest.raises(ValueError, match="cartesian"):
        small.query().bgp(("?a", EX + "p", "?b"), ("?c", EX + "p", "?d"), strict=True)
    with pytest.raises(ValueError, match="no constant"):
        small.query().bgp(("?a", "?p", "?b"), ("?b", EX + "p", "?c"), ("?c", EX + "p", "?d"), strict=True)
    assert small.query().bgp((EX + "x", "?p", "?o"), ("?o", EX + "p", "?e"), strict=True).count() == 4


def test_terms_are_told_apart(spark):
    row = spark.range(1).select(iri(F.lit("x")).alias("a"), blank(F.lit("x")).alias("b")).first()
    assert row["a"]["id"] != row["b"]["id"]
