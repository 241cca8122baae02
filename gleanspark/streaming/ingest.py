"""Streaming ingest: new pages are told from known ones by URL, parsed, and appended to the index chunk by chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from gleanspark.operators.index import CHUNK, documents, postings
from gleanspark.sources.html import frontier, parse_pages

RAW = "page_id long, url string, html string"
TOTALS = "parsed long, indexed long, saved long, chunks long"


def page_stream(spark: SparkSession, path: str, files_a_batch: int = 16) -> DataFrame:
    """Pages of files that appear in the folder ``path`` (or of the one file), each URL once for as long as the checkpoint lives."""
    reader = spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_a_batch)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isFile(at):  # a stream reads folders
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    raw = reader.parquet(path)
    return raw.filter("url is not null").dropDuplicates(["url"])


def write_batch(batch: DataFrame, batch_id: int, out: str, docs_per_chunk: int = CHUNK) -> None:
    """A micro-batch as chunks of at most ``docs_per_chunk`` pages, after those of the batches before it: documents, postings and links, and its
    totals. Writing it again replaces it, so a retried batch does no harm."""
    batch = batch.persist()
    try:
        first = _chunks_before(batch.sparkSession, out, batch_id) * docs_per_chunk
        # only URLs are numbered in one place; a batch has so many files
        number = batch.select("url").withColumn("seq", F.row_number().over(Window.orderBy("url")) - 1 + F.lit(first))
        parsed = parse_pages(batch.join(number, "url")).persist()
        tables = {"docs": documents(parsed, docs_per_chunk), "postings": postings(parsed, docs_per_chunk), "frontier": frontier(parsed)}
        for name, df in tables.items():
            df.write.mode("overwrite").partitionBy(*["chunk_id"] * (name != "frontier")).parquet(f"{out}/{name}/batch_id={batch_id}")
        n = parsed.count()
        saved = batch.sparkSession.read.parquet(f"{out}/docs/batch_id={batch_id}").count() if n else 0
        row = [(n, tables["docs"].count(), saved, -(-n // docs_per_chunk))]
        batch.sparkSession.createDataFrame(row, TOTALS).coalesce(1).write.mode("overwrite").parquet(f"{out}/totals/batch_id={batch_id}")
        parsed.unpersist()
    finally:
        batch.unpersist()


def _chunks_before(spark: SparkSession, out: str, batch_id: int) -> int:
    if not batch_id:
        return 0
    return spark.read.schema(f"{TOTALS}, batch_id long").parquet(f"{out}/totals").filter(F.col("batch_id") < batch_id).agg(F.coalesce(F.sum("chunks"), F.lit(0))).first()[0]


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, files_a_batch: int = 16, once: bool = False, docs_per_chunk: int = CHUNK) -> StreamingQuery:
    """Starts the ingest; with ``once`` it ends when all files that are there have been read."""
    writer = page_stream(spark, path, files_a_batch).writeStream.foreachBatch(lambda b, i: write_batch(b, i, out, docs_per_chunk)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def known_pages(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/docs")


def totals(spark: SparkSession, out: str) -> DataFrame:
    """Pages parsed, indexed and saved so far, and the chunks that hold them."""
    return spark.read.schema(TOTALS).parquet(f"{out}/totals").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("parsed", "indexed", "saved", "chunks")])
