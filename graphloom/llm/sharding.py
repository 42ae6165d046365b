"""Sharding by a two-pass external shuffle (native: DataFrame functions only).

Pass 1 scatters records into memory-sized buckets with seeded hashes: each shard has as many buckets as its measured size
needs, and each task gets one bucket. Pass 2 puts each bucket in random order with a Fisher-Yates shuffle and writes it as
Parquet, one folder a shard. The order of a shard is its buckets one after the other, so no step ever holds more than one
bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .common import new_path, packed, releasing


def rendezvous(key: Column, n_shards: int, seed: int) -> Column:
    """The shard whose seeded hash with ``key`` is highest. One more shard takes rows only into itself."""
    weights = [F.struct(F.xxhash64(F.lit(seed), key, F.lit(s)).alias("w"), F.lit(s).alias("s")) for s in range(n_shards)]
    return F.array_max(F.array(*weights))["s"].cast("int")


def text_size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def write_shards(docs: DataFrame, n_shards: int = 8, bucket_bytes: int = 16 << 20, seed: int = 42,
                 id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write ``docs`` to shuffled shards and return what was written, read from the files.

    Columns: doc_id, text, others (a struct of all other columns, whatever their names), shard, bucket, pos (place in the
    bucket), grown_shard (the shard if there were one more).

    The shard depends on the id and the number of shards alone (rendezvous hashing); null ids count as one key. The
    bucket depends on the id and the text, so that the rows of one id spread over all buckets of their shard, and the
    result does not depend on how the input is split. Rows alike in all columns share a bucket, which holds them once,
    with the places of all. Null texts stay null and have size 1. A very long text is one record. An empty table gives
    an empty result.
    """
    rows = packed(docs, id_col, text_col)
    shard = rendezvous(F.col("doc_id"), n_shards, seed)
    sizes = {r["shard"]: r["bytes"] for r in rows.groupBy(shard.alias("shard")).agg(F.sum(text_size(F.col("text"))).alias("bytes")).collect()}
    buckets = [max(1, -(-sizes.get(s, 0) // bucket_bytes)) for s in range(n_shards)]
    before = [sum(buckets[:s]) for s in range(n_shards)]
    of_shard = lambda values: F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col("shard"))
    scattered = (
        rows.withColumn("shard", shard)
        .withColumn("grown_shard", rendezvous(F.col("doc_id"), n_shards + 1, seed))
        .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text"), of_shard(buckets)))
        .withColumn("task", (of_shard(before) + F.col("bucket")).cast("int"))
        .repartitionById(sum(buckets), "task")
    )
    # each task has one bucket, so both groupings do without another exchange; columns that can't be compared are as JSON
    alike = scattered.groupBy("task", "shard", "bucket", "grown_shard", "doc_id", "text", F.to_json("others").alias("json")).agg(F.first("others").alias("others"), F.count(F.lit(1)).cast("int").alias("n"))
    bucketed = alike.groupBy("task", "shard", "bucket").agg(F.collect_list(F.struct("doc_id", "text", "json", "grown_shard", "others", "n")).alias("rows"))
    ordered = F.array_sort(F.transform("rows", lambda r, i: F.struct(r["doc_id"], r["text"], r["json"], r["n"].alias("n"), i.alias("i"))))
    places = F.flatten(F.transform(ordered, lambda x: F.array_repeat(x["i"], x["n"])))
    dealt = F.transform(F.shuffle(places, F.lit(seed)), lambda i: F.get(F.col("rows"), i))
    shuffled = bucketed.select("bucket", F.posexplode(dealt).alias("pos", "row"), "shard").select("bucket", "pos", "row.doc_id", "row.text", "row.grown_shard", "row.others", "shard")
    path = path or new_path(docs.sparkSession, "shards")
    with releasing(docs.sparkSession):
        shuffled.write.partitionBy("shard").parquet(path)
    kinds = {"bucket": LongType(), "pos": IntegerType(), "doc_id": LongType(), "text": StringType(), "grown_shard": IntegerType(), "others": rows.schema["others"].dataType, "shard": IntegerType()}
    return docs.sparkSession.read.schema(StructType([StructField(n, t) for n, t in kinds.items()])).parquet(path)


def with_slots(written: DataFrame) -> DataFrame:
    """Add ``slot``, the place in the shard: gapless from 0, bucket after bucket."""
    sizes = written.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return written.join(starts, ["shard", "bucket"]).withColumn("slot", F.col("first") + F.col("pos"))


def shard_report(docs: DataFrame, n_shards: int = 8, bucket_bytes: int = 16 << 20, seed: int = 42) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each written record."""
    written = write_shards(docs, n_shards, bucket_bytes, seed)
    placed = written.select(
        "doc_id", text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        "shard", "bucket", "pos", "grown_shard",
    )
    return with_slots(placed).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
