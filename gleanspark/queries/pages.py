"""Queries of web pages: parsing, links, URLs, ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleanspark.functions import text, urls
from gleanspark.operators import index
from gleanspark.plans.corpus import table, unparsed_pages, web_pages, web_pages_sql
from gleanspark.registry import query
from gleanspark.sources.html import frontier
from gleanspark.streaming.ingest import ingest, known_pages, totals


@query("url_dedup", "select url, min(page_id) page_id, count(*) n from pages group by url")
def url_dedup(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


@query("url_decode", "select page_id, url_decode(url) as decoded from pages where not regexp_matches(url, '%([^0-9a-fA-F]|.[^0-9a-fA-F]|.?$)')")
def url_decode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.decoded(F.col("url")).alias("decoded")).filter("decoded is not null")


@query("page_title", f"select page_id, trim(regexp_replace({text.ascii_lower_sql(chr(114) + 'egexp_extract(html, ' + repr('<title>([^<]*)</title>') + ', 1)')}, '[ \\t\\n\\r]+', ' ', 'g'), ' ') as title from pages")
def page_title(spark, sf_dir):
    return web_pages(table(spark, sf_dir, "pages")).select(F.col("seq").alias("page_id"), F.array_join("title_words", " ").alias("title"))


@query("page_lang", f"select page_id, case when regexp_extract({text.ascii_lower_sql('html')}, '<html[^>]*?lang=\"(..)', 1) in ('', 'en') then true else false end as english from pages")
def page_lang(spark, sf_dir):
    return web_pages(table(spark, sf_dir, "pages")).select(F.col("seq").alias("page_id"), "english")


@query("page_links", f"""with c as (select page_id, regexp_replace(regexp_replace({text.ascii_lower_sql("html")}, '<(script|style|svg)[^>]*>.*?</(script|style|svg)>', ' ', 'gs'), '<!--[ \\t\\n\\r].*?-->', ' ', 'gs') h from pages),
    l as (select page_id, unnest(regexp_extract_all(h, '<a[ \\t\\n\\r][^>]*?href="([^"]+)"', 1)) url from c) select page_id, count(*) n_links, min(url) first_url, max(url) last_url from l group by page_id""")
def page_links(spark, sf_dir):
    links = web_pages(table(spark, sf_dir, "pages")).select(F.col("seq").alias("page_id"), F.explode("links.url").alias("url"))
    return links.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.min("url").alias("first_url"), F.max("url").alias("last_url"))


WEB = f"with {web_pages_sql()}"
LINKS = f"""select seq, unnest(regexp_extract_all(h, '<a[ \\t\\n\\r][^>]*?href="([^"]+)"', 1)) link from hp"""


@query("html_parse", f"{WEB}, n as (select seq, count(*) n from ({LINKS}) group by seq) select seq, url, title_length n_title, n_words, n_bold, n_heading, coalesce(n, 0) n_links, '' base, english from parsed left join n using (seq)")
def html_parse(spark, sf_dir):
    p = web_pages(table(spark, sf_dir, "pages"))
    strong = F.size(F.filter("words", lambda w: index.has_flag(w["flags"], index.BOLD))), F.size(F.filter("words", lambda w: index.has_flag(w["flags"], index.HEADING)))
    return p.select("seq", "url", F.size("title_words").alias("n_title"), F.size("words").alias("n_words"), strong[0].alias("n_bold"), strong[1].alias("n_heading"), F.size("links").alias("n_links"), "base", "english")


@query("page_postings", f"{WEB} select p.chunk_id, p.seq, p.field, p.term, d.start + p.pos - 1 as location, p.flags from posts p join docs d using (seq)")
def page_postings(spark, sf_dir):
    return index.located_postings(unparsed_pages(table(spark, sf_dir, "pages")))


@query("link_frontier", f"""{WEB}, l as (select l.link, regexp_extract(url, '^[a-z]+://[^/]*', 0) base, 1 + seq % 3 depth from ({LINKS}) l join hp using (seq)),
    u as (select case when starts_with(link, 'http') then link else lower(base) || link end url, depth from l) select url, cast(min(depth) as int) depth, cast({urls.url_hash_sql("any_value(url)")} % 64 as int) part from u group by url""")
def link_frontier(spark, sf_dir):
    """Links of pages that have a base (their own site's, put in front), and were found at depths of nought to two."""
    p = table(spark, sf_dir, "pages").withColumn("html", F.concat(F.lit('<base href="'), F.regexp_extract("url", "^[a-z]+://[^/]*", 0), F.lit('">'), "html"))
    return frontier(web_pages(p).withColumn("depth", F.col("seq") % 3))


@query("link_shards", f"select cast({urls.url_hash_sql('url')} % 6 as int) part, count(*) n from pages group by 1")
def link_shards(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(urls.shard(F.col("url"), 6).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("url_hashes", f"select page_id, {urls.fnv1a_sql('url')} fnv1a, {urls.url_hash_sql('url')} url_hash from pages")
def url_hashes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.fnv1a(F.col("url")).alias("fnv1a"), urls.url_hash(F.col("url")).alias("url_hash"))


ODD = "%4g+%zz%41%e%"


@query("url_decode_lenient", f"select page_id, {urls.leniently_decoded_sql(f'(url || {ODD!r} || page_id)')} as decoded from pages")
def url_decode_lenient(spark, sf_dir):
    """URLs with a malformed end, every one decoded."""
    return table(spark, sf_dir, "pages").select("page_id", urls.leniently_decoded(F.concat("url", F.lit(ODD), F.col("page_id").cast("string"))).alias("decoded"))


@query("stream_ingest", "select distinct url from pages")
def stream_ingest(spark, sf_dir):
    """Pages as a stream into chunks of an index; the documents that were indexed, each URL once."""
    from gleanspark.sources.shared import shared_folder

    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    ingest(spark, f"{sf_dir}/pages.parquet", f"{folder}/index", f"{folder}/checkpoint", once=True).awaitTermination()
    return known_pages(spark, f"{folder}/index").select("url")


@query("ingest_totals", """with u as (select url, any_value(html) html from pages where url is not null group by url)
    select count(*) parsed, cast(count(*) filter (where len(list_filter(string_split_regex(regexp_extract(html, '<title>([^<]*)</title>', 1), '[ \\t\\n\\r]+'), lambda x: x <> '')) < 40) as bigint) indexed,
    indexed as saved, cast(ceil(count(*) / 100.0) as bigint) chunks from u""")
def ingest_totals(spark, sf_dir):
    """Pages parsed, indexed and saved by the stream, and the chunks of at most 100 pages that they make."""
    from gleanspark.sources.shared import shared_folder

    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    ingest(spark, f"{sf_dir}/pages.parquet", f"{folder}/index", f"{folder}/checkpoint", once=True, docs_per_chunk=100).awaitTermination()
    return totals(spark, f"{folder}/index")
