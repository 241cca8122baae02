"""Queries of text analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.functions import text
from gleanspark.operators.analysis import counted_tokens
from gleanspark.plans.corpus import table
from gleanspark.registry import query

TOKENS = f"select doc_id, unnest({text.tokens_duck('text')}) t from documents"


def forms_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct token ``t`` with its ``stem`` and number ``n``: counted where texts are cut, so that tokens never become rows."""
    return counted_tokens(table(spark, sf_dir, "documents")).groupBy("t", "stem").agg(F.sum("n").alias("n"))


@query("ascii_lower", f"select conv_id, turn, {text.ascii_lower_sql('text')} as lowered from conversations")
def ascii_lower(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.ascii_lower(F.col("text")).alias("lowered"))


@query(
    "tokenize_documents",
    f"select doc_id, cast(len(w) as bigint) n_tokens, cast(len(list_distinct(w)) as bigint) n_distinct, w[1] first_token, w[-1] last_token from (select doc_id, {text.tokens_duck('text')} w from documents)",
)
def tokenize_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    return d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_tokens"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.try_element_at("w", F.lit(1)).alias("first_token"),
        F.try_element_at("w", F.lit(-1)).alias("last_token"),
    )


@query("stem_vocabulary", f"select t as token, stem from {text.stems_duck(f'(select distinct t from ({TOKENS}))')}")
def stem_vocabulary(spark, sf_dir):
    return forms_of(spark, sf_dir).select(F.col("t").alias("token"), "stem")


@query("stem_frequency", f"with v as (select t, count(*) n from ({TOKENS}) group by t) select stem, cast(sum(n) as bigint) n_tokens, count(*) n_forms from {text.stems_duck('v')} where stem <> '' group by stem")
def stem_frequency(spark, sf_dir):
    forms = forms_of(spark, sf_dir).filter("stem <> ''")
    return forms.groupBy("stem").agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_forms"))


STOPPED = ", ".join(text.quoted(w) for w in text.STOP)


@query("stopword_filter", f"select doc_id, count(*) filter (where t in ({STOPPED})) n_stop, count(*) filter (where t not in ({STOPPED})) n_other from ({TOKENS}) group by doc_id")
def stopword_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("w")).filter(F.size("w") > 0)
    stop = F.size(F.filter("w", lambda t: t.isin(text.STOP)))
    return d.select("doc_id", stop.cast("long").alias("n_stop"), (F.size("w") - stop).cast("long").alias("n_other"))


@query("punct_strip", f"select {text.Dialect(True).right_trimmed('t', text.CLOSERS)} as bare, count(*) n from ({TOKENS}) group by 1")
def punct_strip(spark, sf_dir):
    return forms_of(spark, sf_dir).select(F.expr(text.Dialect(False).right_trimmed("t", text.CLOSERS)).alias("bare"), "n").groupBy("bare").agg(F.sum("n").alias("n"))
