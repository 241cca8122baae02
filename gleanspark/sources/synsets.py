"""Synonym sets from text files: a line a set, each lemma followed by a semicolon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.functions import text


def read_synsets(spark: SparkSession, path: str) -> DataFrame:
    """(set_id, position, lemma, stem): a row for each lemma, lower case; the stem of several words is that of their whole string."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    each = lines.select(F.xxhash64("value").alias("set_id"), F.posexplode(F.split(text.ascii_lower(F.col("value")), ";")).alias("position", "lemma"))
    each = each.select("set_id", "position", F.trim("lemma").alias("lemma")).filter("lemma <> ''")
    return each.withColumn("stem", text.stem("lemma"))


def synonyms_of(synsets: DataFrame, stems: list[str]) -> dict[str, list[str]]:
    """For a query's few stems, the lemmas of all sets that hold them, less those of the same stem."""
    own = synsets.filter(F.col("stem").isin(stems)).select("set_id", F.col("stem").alias("query_stem")).distinct()
    rows = synsets.join(own, "set_id").filter("stem <> query_stem").select("query_stem", "lemma").distinct().orderBy("query_stem", "lemma").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["query_stem"], []).append(r["lemma"])
    return out
