"""The corpus pipeline: raw documents in, packs of training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; what it returns is written
as Parquet and read again as the next one's documents, so that a lost executor costs no more than a stage's tasks.

For every stage: rows are judged one by one unless it says otherwise; other columns, of whatever names, are carried
along; texts are read whole, however long; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gleanspark.llm.common import shared_folder, table
from gleanspark.llm.decontam import drop_contaminated
from gleanspark.llm.line_dedup import line_dedup
from gleanspark.llm.ngram_join import drop_near_duplicates
from gleanspark.llm.packing import best_fit_packing
from gleanspark.llm.quality import quality_filter


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, trained on the labels, rejects (a calibrated probability below 0.5; at 0.5 they stay).

    Null and empty texts are judged like a document without words. Rows without an id are judged like others, repeated rows alike.
    Labels without an id, or other than 0 and 1, don't count; of several of an id the least does; without labels of both classes
    every document has the one class's rate.
    """
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of too many documents stay in the first of them alone; ``n_chars`` follows the text; documents left without a line go.

    Null and empty texts stay. Rows without an id are a document for each text, and come first; repeated rows are one document and
    are treated alike; a line that stands in just as many documents as allowed stays.
    """
    return line_dedup(docs, keep_first=True, drop_emptied=True, chars_col="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id.

    Rows without an id and texts without a word (null and empty ones too) stay. Of rows that repeat an id one stays, that of the smallest text.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item, as it stands or with other values.

    Rows without an id or a text stay; repeated rows go together; items without an id or text, or of fewer than four tokens, match nothing.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs of pieces of the documents that are left.

    Null and empty texts are in no pack; rows without an id are packed with a null id; repeated rows are packed each; ties of length are
    filled in order of id. No documents give no packs.
    """
    return best_fit_packing(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: The first stage trains a network and the last packs greedily: neither is SQL. Tests hold the stages against versions written apart: lines,
#: near duplicates, contamination and tokens by brute force, the classifier against labels that it wasn't trained on.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the packs. What goes from stage to stage is in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        at = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
