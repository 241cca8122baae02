"""Queries of the index: documents, postings, dictionary, statistics, seeks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanspark.operators import analysis, index
from gleanspark.plans.corpus import document_pages, document_pages_sql, table
from gleanspark.registry import query

WITH = f"with {document_pages_sql()}"
TERMS = ["en", "er", "from", "erin"]
IN_TERMS = ", ".join(f"'{t}'" for t in TERMS)


def pages(spark, sf_dir):
    return document_pages(table(spark, sf_dir, "documents"))


def posts(spark, sf_dir, only=None):
    return index.postings(pages(spark, sf_dir), only=only)


@query("postings_build", f"{WITH} select p.chunk_id, p.seq, p.field, p.term, d.start + p.pos - 1 as location, p.flags from posts p join docs d using (seq)")
def postings_build(spark, sf_dir):
    return index.located_postings(pages(spark, sf_dir))


@query(
    "doc_locations",
    f"""{WITH} select chunk_id, seq, row_number() over (partition by chunk_id order by seq) - 1 as doc_id, url, title, cast(word_count as bigint) word_count,
    cast(title_length as bigint) title_length, cast(strlen(url) as bigint) url_length, 'com' as tld, english, start, "end" from docs""",
)
def doc_locations(spark, sf_dir):
    return index.documents(pages(spark, sf_dir))


@query(
    "index_stats",
    f"""{WITH}, p as (select chunk_id, count(*) n, count(distinct field || ' ' || term) words from posts group by chunk_id)
    select chunk_id, coalesce(any_value(words), 0) words, count(*) documents, coalesce(any_value(n), 0) + count(*) locations, max("end") max_location from docs left join p using (chunk_id) group by chunk_id""",
)
def index_stats(spark, sf_dir):
    p = pages(spark, sf_dir)
    return index.statistics(index.postings(p), index.documents(p))


@query("dictionary", f"{WITH} select field, term, count(*) post_count, count(distinct seq) doc_freq, max(pos) last_pos from posts group by field, term")
def dictionary(spark, sf_dir):
    return index.dictionary_of_pages(pages(spark, sf_dir))


@query("marked_terms", f"{WITH} select case field when 'title' then '@' || term else term end marked, count(*) n from posts group by 1")
def marked_terms(spark, sf_dir):
    counted = analysis.counted_terms(pages(spark, sf_dir))
    return counted.groupBy(index.with_field_mark(F.col("field"), F.col("term")).alias("marked")).agg(F.sum("post_count").alias("n"))


@query("vocabulary_count", f"{WITH} select count(distinct term) n_terms, count(*) n_posts from posts")
def vocabulary_count(spark, sf_dir):
    terms = analysis.counted_terms(pages(spark, sf_dir)).groupBy("term").agg(F.sum("post_count").alias("n"))
    return terms.agg(F.count(F.lit(1)).alias("n_terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_posts"))


@query("doc_freq", f"{WITH} select term, count(distinct seq) doc_freq from posts where term in ({IN_TERMS}) group by term")
def doc_freq(spark, sf_dir):
    return posts(spark, sf_dir, TERMS).groupBy("term").agg(F.countDistinct("seq").alias("doc_freq"))


@query("term_freq", f"{WITH} select seq, term, count(*) tf from posts where term in ({IN_TERMS}) group by seq, term")
def term_freq(spark, sf_dir):
    return index.term_frequency(posts(spark, sf_dir, TERMS), TERMS)


@query("seek_word", f"{WITH} select p.chunk_id, min(d.start + p.pos - 1) as location from posts p join docs d using (seq) where p.term = 'erin' and d.start + p.pos - 1 >= 10000 group by p.chunk_id")
def seek_word(spark, sf_dir):
    p = pages(spark, sf_dir)
    return index.first_at_or_after(index.located(index.postings(p, only=["erin"]), index.documents(p)), "erin", 10_000)


@query("seek_document", f'{WITH} select chunk_id, arg_min(seq, "end") as seq from docs where "end" >= 10000 group by chunk_id')
def seek_document(spark, sf_dir):
    return index.document_at(index.documents(pages(spark, sf_dir)), 10_000)


@query("chunk_assign", 'select doc_id // 5000 as chunk_id, count(*) documents, min(doc_id) first_seq, max(doc_id) last_seq from documents group by 1')
def chunk_assign(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"))
    return d.groupBy(index.chunk_of(F.col("seq")).alias("chunk_id")).agg(F.count(F.lit(1)).alias("documents"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
