"""Pseudonymization of a stream of documents, with aliases that stay the same from batch to batch.

The alias store is a folder of parquet, one subfolder a batch. A batch numbers its new originals after those of the store
and writes its own subfolder, replacing what an earlier try of the same batch left there: a repeated batch gives the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import rewrite
from ..plans.pipeline import Engine

STORE = "original string, alias string, prefix string, n bigint, batch bigint"


def store_before(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """The aliases that batches before this one gave."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    stored = spark.read.schema("original string, alias string, prefix string, n bigint").option("basePath", path).parquet(f"{path}/batch=*") if exists else spark.createDataFrame([], STORE)
    return stored.withColumn("batch", F.col("batch").cast("bigint")).where(F.col("batch") < batch)


def new_aliases(entities: DataFrame, store: DataFrame) -> DataFrame:
    """original, alias, prefix, n of the originals that the store lacks, numbered after its highest number by prefix."""
    missing = entities.join(store.select(F.col("original").alias("text")), "text", "left_anti")
    fresh = rewrite.corpus_aliases(missing)
    highest = store.groupBy("prefix").agg(F.max("n").alias("highest"))
    n = (F.col("n") + F.coalesce("highest", F.lit(0))).cast("bigint")
    moved = fresh.join(highest, "prefix", "left").withColumn("n", n)
    return moved.select("original", F.concat(F.lit("<"), "prefix", F.lit("_"), F.col("n").cast("string"), F.lit(">")).alias("alias"), "prefix", "n")


def detected(store_path: str, batch: int) -> str:
    """Where a batch's documents and entities are kept while it is rewritten."""
    return f"{store_path.rstrip('/')}-detected/batch={batch}"


def forget(spark: SparkSession, store_path: str, batch: int) -> None:
    """Deletes what was kept of a batch that is rewritten."""
    where = spark._jvm.org.apache.hadoop.fs.Path(detected(store_path, batch))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def rewrite_batch(engine: Engine, docs: DataFrame, store_path: str, batch: int) -> DataFrame:
    """doc_id and text of a batch, pseudonymized under the store's aliases and the batch's own, which are written.

    What is detected is written beside the store, so that it is detected once and each retry starts there; ``forget``
    deletes it.
    """
    spark = docs.sparkSession
    engine.applied(docs).write.mode("overwrite").parquet(detected(store_path, batch))
    done = spark.read.parquet(detected(store_path, batch))
    flat = done.select("doc_id", F.explode("entities").alias("e")).select("doc_id", F.col("e.start").alias("start"), F.col("e.end").alias("end"), F.col("e.text").alias("text"), F.coalesce("e.category", "e.label").alias("prefix"))
    before = store_before(spark, store_path, batch)
    new_aliases(flat, before).write.mode("overwrite").parquet(f"{store_path}/batch={batch}")
    table = store_before(spark, store_path, batch + 1).select(F.col("original").alias("text"), "alias")
    places = flat.join(table, "text").groupBy("doc_id").agg(F.collect_set(F.struct("start", "end", "alias")).alias("places"))
    none = F.array().cast("array<struct<start:int,end:int,alias:string>>")
    joined = done.select("doc_id", "text").join(places, "doc_id", "left")
    return joined.select("doc_id", rewrite.rewritten(F.col("text"), F.coalesce("places", none)).alias("text"))


def pseudonymize_stream(documents: DataFrame, engine: Engine, store_path: str, output: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream: each batch's documents go to ``output``/batch=N, its aliases to the store. doc_id must be unique in a batch."""

    def write(docs: DataFrame, batch: int) -> None:
        rewrite_batch(engine, docs, store_path, batch).write.mode("overwrite").parquet(f"{output}/batch={batch}")
        forget(docs.sparkSession, store_path, batch)

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


