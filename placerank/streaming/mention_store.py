"""A keyed store that a stream upserts into: hash buckets, a delta per batch, a new base now and then.

    root/base/upto=N/bucket=B     everything up to batch N
    root/deltas/batch=N/bucket=B  rows that batch N made new or changed
    root/commits                  (batch, base): what is complete

A batch reads the buckets of its keys and writes its own rows only.  What it reads are the commits before it, so a batch that
runs again finds the same state and writes the same folder again.  Readers take the newest row of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructType

from placerank.operators.social import upsert_mentions
from placerank.session import materialise

#: Folders of a base or a delta; fixed for the life of a store.
BUCKETS = 64
#: Batches after which the deltas are merged into a new base.
COMPACT_EVERY = 20


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _commit(spark: SparkSession, root: str, batch: int, base: bool) -> None:
    spark.createDataFrame([(batch, base)], "batch long, base boolean").coalesce(1).write.mode("append").parquet(f"{root}/commits")


def _commits(spark: SparkSession, root: str, before: int | None) -> tuple[int | None, list[int]]:
    """The last base and the batches after it, among the commits before a batch: at most COMPACT_EVERY and a few numbers."""
    if not exists(spark, f"{root}/commits"):
        return None, []
    rows = spark.read.schema("batch long, base boolean").parquet(f"{root}/commits")
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    base = rows.where("base").agg(F.max("batch")).first()[0]
    after = rows.where(~F.col("base") & (F.col("batch") > (-1 if base is None else base))).select("batch").distinct()
    return base, sorted(r.batch for r in after.collect())


def _state(
    spark: SparkSession, root: str, schema: StructType, before: int | None, buckets: Sequence[int] | None = None, keys: DataFrame | None = None
) -> DataFrame:
    """Newest row of every key among the commits before a batch; of some buckets and keys only, if given."""
    base, batches = _commits(spark, root, before)
    folders = [(base, f"{root}/base/upto={base}")] if base is not None else []
    folders += [(b, f"{root}/deltas/batch={b}") for b in batches]
    stored = StructType([*schema.fields, *StructType().add("bucket", IntegerType()).fields])
    rows = spark.createDataFrame([], schema).withColumn("_at", F.lit(-1).cast("long"))
    for at, folder in folders:
        part = spark.read.schema(stored).parquet(folder)
        if buckets is not None:
            part = part.where(F.col("bucket").isin(*buckets))
        rows = rows.union(part.drop("bucket").withColumn("_at", F.lit(at).cast("long")))
    if keys is not None:
        rows = rows.join(keys, "key", "left_semi")
    rest = [c for c in schema.names if c != "key"]
    return rows.groupBy("key").agg(F.max_by(F.struct(*rest), "_at").alias("r")).select("key", "r.*").select(*schema.names)


def _write(rows: DataFrame, folder: str, buckets: int) -> None:
    # a bucket is one file where it is small; adaptive execution splits what is large
    rows = rows.withColumn("bucket", bucket_of(F.col("key"), buckets)).hint("rebalance", "bucket")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(folder)


def upsert_batch(batch: DataFrame, root: str, number: int, buckets: int = BUCKETS, compact_every: int = COMPACT_EVERY) -> None:
    """Merge one batch; its number orders it.  The same batch again, even after later ones, changes nothing.

    ``batch``: key, venue_id, matched_by, caption and payload, one row per key; rows without a key cannot be found again and
    are not stored."""
    spark = batch.sparkSession
    rows = materialise(batch.where("key is not null"))
    if not rows.isEmpty():
        touched = [r.b for r in rows.select(bucket_of(F.col("key"), buckets).alias("b")).distinct().collect()]  # at most `buckets`
        old = _state(spark, root, rows.schema, number, touched, rows.select("key"))
        _write(upsert_mentions(old, rows).where("change <> 'kept'").drop("change"), f"{root}/deltas/batch={number}", buckets)
        _commit(spark, root, number, False)
    if (number + 1) % compact_every == 0:
        _write(_state(spark, root, rows.schema, number + 1), f"{root}/base/upto={number}", buckets)
        _commit(spark, root, number, True)


def read_mentions(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The store as of its last commit."""
    return _state(spark, root, schema, None)


def stream_upsert(
    mentions: DataFrame, root: str, checkpoint: str, buckets: int = BUCKETS, compact_every: int = COMPACT_EVERY
) -> StreamingQuery:
    """Upsert a stream of mentions; drains what has arrived, then stops."""

    def each(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(batch, root, batch_id, buckets, compact_every)

    return mentions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
