"""The index on disk: Parquet by chunk, postings sorted by term, so that a term's filter skips most row groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.operators.index import CHUNK, dictionary, documents, postings, statistics


@dataclass
class Index:
    docs: DataFrame
    postings: DataFrame

    @property
    def dictionary(self) -> DataFrame:
        return dictionary(self.postings)

    @property
    def statistics(self) -> DataFrame:
        return statistics(self.postings, self.docs)

    def persist(self) -> Index:
        return Index(self.docs.persist(), self.postings.persist())


def build_index(pages: DataFrame, docs_per_chunk: int = CHUNK) -> Index:
    return Index(documents(pages, docs_per_chunk), postings(pages, docs_per_chunk))


def write_index(index: Index, path: str, mode: str = "overwrite", files_a_chunk: int = 4) -> None:
    """Chunks as partitions, a chunk's postings spread over ``files_a_chunk`` files by term, so that a chunk is sorted by several tasks and a term lies in one file."""
    index.docs.repartition("chunk_id").sortWithinPartitions("chunk_id", "seq").write.mode(mode).partitionBy("chunk_id").parquet(f"{path}/docs")
    part = F.pmod(F.xxhash64("term"), F.lit(files_a_chunk))
    spread = index.postings.repartition("chunk_id", part).sortWithinPartitions("chunk_id", "term", "seq", "pos")
    spread.write.mode(mode).partitionBy("chunk_id").option("parquet.block.size", 16 << 20).parquet(f"{path}/postings")


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings"))
