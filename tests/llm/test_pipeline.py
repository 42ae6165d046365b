"""The pipeline and the corpus queries on the smallest tables."""

import hashlib
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from plain import plain_components, plain_hits, plain_redact

import __spark_entry__ as entry
import corpus_pipeline
from graphloom.llm import toxicity
from graphloom.llm.oracles import ORACLES
from graphloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and len(QUERIES) == 10
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "bpe"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    got, want = QUERIES[name](spark, SF).toPandas(), c.sql(ORACLES[name]).df()
    plain = lambda x: "-" if x is None or x != x else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    rows = lambda d: sorted(str([plain(x) for x in r]) for r in d[sorted(d.columns)].astype(object).fillna("-").itertuples(index=False, name=None))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_pipeline(spark):
    """Every stage but the first (a fitted model, taken as it is) by plain Python."""
    from tokenizers import Tokenizer

    table = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    machine = toxicity.train(table("documents"), table("labels"))
    docs = [(r["doc_id"], r["text"]) for r in table("documents").collect()]
    calm = {r["doc_id"] for r in toxicity.score(table("documents"), machine).where("predicted = 0").collect()}
    docs = [d for d in docs if d[0] in calm]
    docs = [d for d, c in zip(docs, plain_components(docs, 5, 80)) if c[2] == d[0]]
    items = [(r["item_id"], r["text"]) for r in table("benchmark").collect()]
    docs = [d for d in docs if not plain_hits(d[1], items, 10)[4]]
    assert 50 < len(docs) < 200
    t = Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == {d[0] for d in docs}
    masked = [(i, plain_redact(text)) for i, text in docs]
    assert sum(m[1] != d[1] for m, d in zip(masked, docs)) > 5
    for i, text in masked:
        ids = t.encode(text, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.simpleString() == docs.schema.simpleString()
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("others", F.lit(1))
    assert corpus_pipeline.mask_secrets(spark, odd, SF).columns == odd.columns
