"""The positional index as tables: documents, postings, dictionary and statistics.

Pages come as rows of ``PAGE``: a sequence number, a URL, words of the title and of the text with their flags.
Terms are found in one pass over the pages (``analysis``); the only shuffles are the running sum of lengths within a
chunk (a narrow row a document) and, where absolute locations are asked for, the join that brings it to the pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.functions import urls
from gleanspark.operators import analysis
from gleanspark.operators.analysis import MOST_TITLE_WORDS

PAGE = "seq long, url string, title_words array<string>, words array<struct<word:string,flags:tinyint>>, english boolean"
#: Pages of consecutive numbers that make a chunk.
CHUNK = 5000
BOLD, HEADING, LARGE = 1, 2, 4


def chunk_of(seq: Column, docs_per_chunk: int = CHUNK) -> Column:
    return F.floor(seq / docs_per_chunk).cast("long")


def indexable(pages: DataFrame) -> DataFrame:
    form = analysis.form_of(pages)
    if form == "html":
        return analysis.attributes(pages)
    return pages if form == "text" else pages.filter(F.size("title_words") < MOST_TITLE_WORDS)


def _located_pages(attributes: DataFrame, docs_per_chunk: int) -> DataFrame:
    """Pages with their chunk, their number in it and their range of locations."""
    d = attributes.withColumn("chunk_id", chunk_of(F.col("seq"), docs_per_chunk))
    need = F.col("word_count") + 2
    before = Window.partitionBy("chunk_id").orderBy("seq")
    d = d.withColumn("end", F.sum(need).over(before)).withColumn("doc_id", (F.row_number().over(before) - 1).cast("long"))
    return d.withColumn("start", F.col("end") - need + 1)


def documents(pages: DataFrame, docs_per_chunk: int = CHUNK) -> DataFrame:
    """Attributes and the range of locations of each indexed page; ``doc_id`` is dense within its chunk."""
    url = {"url_length": F.octet_length("url").cast("long"), "tld": urls.tld(F.col("url"))}
    d = _located_pages(analysis.attributes(pages), docs_per_chunk).withColumns(url)
    return d.select("chunk_id", "seq", "url", "title", "word_count", "title_length", "url_length", "tld", "english", "end", "doc_id", "start")


def postings(pages: DataFrame, docs_per_chunk: int = CHUNK, only: list[str] | None = None) -> DataFrame:
    """A row for each term occurrence: chunk, page, field, term, ``pos`` in the page (from 1), flags, and whether it is the page's ``first`` of
    the term in the field. No shuffle. With ``only``, of these terms: what else a page has never becomes rows."""
    e = analysis.posts_of_pages(pages, only)
    return e.select(chunk_of(F.col("seq"), docs_per_chunk).alias("chunk_id"), "seq", "field", "term", "pos", "flags", "first")


def located_postings(pages: DataFrame, docs_per_chunk: int = CHUNK) -> DataFrame:
    """All postings with absolute locations in their chunk. Where a page begins is joined to it before it is analysed: texts move, not postings."""
    start = _located_pages(analysis.attributes(pages, ["seq", "word_count"]), docs_per_chunk).select("seq", "start")
    e = analysis.posts_of_pages(pages.join(start.hint("shuffle_hash"), "seq"), keep="start")
    return e.select(chunk_of(F.col("seq"), docs_per_chunk).alias("chunk_id"), "seq", "field", "term", (F.col("start") + F.col("pos") - 1).alias("location"), "flags")


def located(posts: DataFrame, docs: DataFrame) -> DataFrame:
    """Postings with absolute locations in their chunk."""
    return posts.join(docs.select("seq", "start"), "seq").select("chunk_id", "seq", "field", "term", (F.col("start") + F.col("pos") - 1).alias("location"), "flags")


def with_field_mark(field: Column, term: Column) -> Column:
    """A term as queries of the index spell it: with @ in front if it is of a title."""
    return F.when(field == "title", F.concat(F.lit("@"), term)).otherwise(term)


def dictionary(posts: DataFrame) -> DataFrame:
    """Each term of each field, with how often and in how many pages it stands, and its last place in a page."""
    pages = F.count_if("first") if "first" in posts.columns else F.countDistinct("seq")
    return posts.groupBy("field", "term").agg(F.count(F.lit(1)).alias("post_count"), pages.alias("doc_freq"), F.max("pos").alias("last_pos"))


def dictionary_of_pages(pages: DataFrame) -> DataFrame:
    """``dictionary`` straight from pages: terms are counted where they are found, and only sums move."""
    counted = analysis.counted_terms(pages).groupBy("field", "term")
    return counted.agg(*[f(c).alias(c) for f, c in ((F.sum, "post_count"), (F.sum, "doc_freq"), (F.max, "last_pos"))])


def statistics(posts: DataFrame, docs: DataFrame) -> DataFrame:
    """For each chunk: distinct terms, pages, locations (a page counts as one more) and the last location."""
    per_chunk = posts.groupBy("chunk_id").agg(F.countDistinct("field", "term").alias("words"), F.count(F.lit(1)).alias("posts"))
    d = docs.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("documents"), F.max("end").alias("max_location"))
    return d.join(per_chunk, "chunk_id", "left").select("chunk_id", F.coalesce("words", F.lit(0)).alias("words"), "documents", (F.coalesce("posts", F.lit(0)) + F.col("documents")).alias("locations"), "max_location")


def term_frequency(posts: DataFrame, terms: list[str]) -> DataFrame:
    """How often the terms stand in each page."""
    return posts.filter(F.col("term").isin(terms)).groupBy("seq", "term").agg(F.count(F.lit(1)).alias("tf"))


def first_at_or_after(posts: DataFrame, term: str, location: int) -> DataFrame:
    """Seek: the first occurrence of a term at a location or after it (of located postings), in each chunk."""
    hit = posts.filter((F.col("term") == term) & (F.col("location") >= location))
    return hit.groupBy("chunk_id").agg(F.min("location").alias("location"))


def document_at(docs: DataFrame, location: int) -> DataFrame:
    """The first page of each chunk that ends at a location or after it."""
    return docs.filter(F.col("end") >= location).groupBy("chunk_id").agg(F.min_by("seq", "end").alias("seq"))


def has_flag(flags: Column, flag: int) -> Column:
    return flags.bitwiseAND(F.lit(flag)) != 0
