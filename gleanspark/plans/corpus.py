"""The given tables as pages to index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.functions import text
from gleanspark.operators.analysis import TITLE_WORDS
from gleanspark.sources.html import parse_pages



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_pages(docs: DataFrame) -> DataFrame:
    """``documents`` as pages of plain text: the first words are title, all words text without flags; a URL of source, language and id."""
    return docs.select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        "text",
        (F.col("lang") == "en").alias("english"),
    )


def document_pages_sql() -> str:
    """CTEs for DuckDB: ``pg`` (pages), ``raw`` (tokens by place), ``voc`` (stems), ``posts`` (postings), ``docs`` (attributes)."""
    return f"""
    tk as materialized (select doc_id seq, lang, source, {text.tokens_duck("text")} w from documents),
    pg as (select seq, 'https://' || source || '.example.com/' || lang || '/' || seq url, array_to_string(w[1:{TITLE_WORDS}], ' ') title, least({TITLE_WORDS}, len(w)) title_length,
        len(w) + least({TITLE_WORDS}, len(w)) word_count, lang = 'en' english from tk),
    raw as (select seq, 0 f, unnest(w[1:{TITLE_WORDS}]) t, generate_subscripts(w[1:{TITLE_WORDS}], 1) i from tk union all select seq, 1 f, unnest(w) t, generate_subscripts(w, 1) i from tk),
    voc as materialized (select t, stem from {text.stems_duck("(select distinct t from raw)")}),
    posts as materialized (select seq // 5000 chunk_id, seq, case f when 0 then 'title' else 'body' end field, stem term, row_number() over (partition by seq order by f, i) pos, cast(0 as tinyint) flags
        from raw join voc using (t) where stem <> ''),
    docs as (select *, "end" - word_count - 1 as start from (select seq // 5000 chunk_id, *, cast(sum(word_count + 2) over (partition by seq // 5000 order by seq) as bigint) as "end" from pg))"""


BLANK = r"[ \t\n\r]"


def without_sections_sql(html: str) -> str:
    """A page in lower case, without scripts, styles, drawings, comments and a tag that isn't closed at its end."""
    low = text.ascii_lower_sql(html)
    bare = f"regexp_replace({low}, '<(script|style|svg)[^>]*>.*?</(script|style|svg)>', ' ', 'gs')"
    return f"regexp_replace(regexp_replace({bare}, '<!--{BLANK}.*?-->', ' ', 'gs'), '<[^<>]*$', '')"


def web_pages_sql() -> str:
    """The CTEs of ``document_pages_sql`` for parsed web pages, and ``parsed`` (all pages with counts). For well-formed pages: the state machine's odd cases have no SQL."""
    on = lambda name: f"case when regexp_matches(piece, '^<{name}({BLANK}|/|>)') then 1 when regexp_matches(piece, '^</{name}') then 0 end"
    state = lambda c: f"coalesce(last_value({c} ignore nulls) over (partition by seq order by i rows unbounded preceding), 0)"
    return f"""
    hp as materialized (select page_id seq, url, regexp_extract({text.ascii_lower_sql("html")}, '<html[^>]*?lang="(..)', 1) in ('', 'en') english, {without_sections_sql("html")} h from pages),
    pieces as (select seq, unnest(regexp_extract_all(h, '<[^>]*>|[^<]+')) piece, generate_subscripts(regexp_extract_all(h, '<[^>]*>|[^<]+'), 1) i from hp),
    events as (select *, {on("b")} b, {on("h[1-6]")} hd, {on("title")} ti from pieces),
    states as (select seq, i, piece, {state("b")} bold, {state("hd")} heading, {state("ti")} in_title from events),
    spoken as (select seq, i, case when in_title = 1 then 0 else 1 end f, cast(case when in_title = 1 then 0 else bold + 2 * heading end as tinyint) flags,
        unnest(string_split_regex(piece, '{BLANK}+')) t, generate_subscripts(string_split_regex(piece, '{BLANK}+'), 1) k from states where piece[1] <> '<'),
    all_words as materialized (select seq, f, t, flags, row_number() over (partition by seq, f order by i, k) i from spoken where t <> ''),
    parsed as (select seq, url, english, count(*) filter (where f = 0) title_length, count(*) filter (where f = 1) n_words, count(*) filter (where f = 1 and flags & 1 > 0) n_bold,
        count(*) filter (where f = 1 and flags & 2 > 0) n_heading, coalesce(string_agg(t, ' ' order by i) filter (where f = 0), '') title from hp left join all_words using (seq) group by all),
    pg as (select seq, url, case when title = '' then url else title end title, title_length, n_words + title_length word_count, english from parsed where title_length < 40),
    raw as (select w.* from all_words w join pg using (seq)),
    voc as materialized (select t, stem from {text.stems_duck("(select distinct t from raw)")}),
    posts as materialized (select seq // 5000 chunk_id, seq, case f when 0 then 'title' else 'body' end field, stem term, row_number() over (partition by seq order by f, i) pos, flags
        from raw join voc using (t) where stem <> ''),
    docs as (select *, "end" - word_count - 1 as start from (select seq // 5000 chunk_id, *, cast(sum(word_count + 2) over (partition by seq // 5000 order by seq) as bigint) as "end" from pg))"""


def unparsed_pages(pages: DataFrame) -> DataFrame:
    """``pages`` as they are indexed: parsed where their terms are found."""
    return pages.select(F.col("page_id").alias("seq"), "url", "html")


def web_pages(pages: DataFrame) -> DataFrame:
    """``pages`` parsed, with links and base besides what an index needs."""
    return parse_pages(unparsed_pages(pages))
