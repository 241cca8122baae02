"""Queries of ranking."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleanspark.functions import urls
from gleanspark.functions.scoring import soft_exp, soft_exp_sql, static_score, static_score_sql
from gleanspark.operators import boolean, index, ranking, results
from gleanspark.operators.analysis import attributes
from gleanspark.operators.index import chunk_of
from gleanspark.plans.corpus import document_pages_sql, table, unparsed_pages, web_pages_sql
from gleanspark.plans.query import compile_query
from gleanspark.queries.indexing import WITH, pages
from gleanspark.registry import query
from gleanspark.search import search
from gleanspark.sources.shared import shared_folder
from gleanspark.sources.store import build_index, read_index, write_index

TLD = urls.tld_sql("url")


@query("tld_parse", f"select page_id, url, {TLD} as tld from pages")
def tld_parse(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", urls.tld(F.col("url")).alias("tld"))


@query("tld_score", f"select tld, count(*) n, max({urls.tld_score_sql('tld')}) tld_score from (select {TLD} tld from pages) group by tld")
def tld_score(spark, sf_dir):
    p = table(spark, sf_dir, "pages").groupBy(urls.tld(F.col("url")).alias("tld")).agg(F.count(F.lit(1)).alias("n"))
    return p.withColumn("tld_score", urls.tld_score(F.col("tld")))


@query("utility_pages", f"select page_id, regexp_matches(lower(url), '{urls.UTILITY}') as is_utility from pages")
def utility_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.is_utility(F.col("url")).alias("is_utility"))


@query("url_length_score", f"select page_id, cast(strlen(url) as bigint) url_length, round({soft_exp_sql('(-0.02::double * strlen(url))')}, 9) url_score from pages")
def url_length_score(spark, sf_dir):
    n = F.octet_length("url")
    return table(spark, sf_dir, "pages").select("page_id", n.cast("long").alias("url_length"), F.round(soft_exp(-0.02 * n), 9).alias("url_score"))


@query("static_score", f"{WITH} select seq, round({static_score_sql('url', 'word_count', 'title_length', 'english')}, 6) static from pg")
def static(spark, sf_dir):
    p = attributes(pages(spark, sf_dir))
    return p.select("seq", F.round(static_score(F.col("url"), F.col("word_count"), F.col("title_length"), F.col("english")), 6).alias("static"))


# --- the ranker in SQL: joins where the engine folds over arrays ------------------------------------------


def ranked_sql(terms: list[str], matching: str, utility: bool = False) -> str:
    """CTEs ``side`` (counters a field) and ``scored`` of the pages that ``matching`` selects, for these terms in order."""
    n = len(terms)
    listed = ", ".join(f"('{t}', {i})" for i, t in enumerate(terms))
    ctes = [
        f"term_of(term, i) as (values {listed})",
        f"hit as ({matching})",
        "occ as materialized (select p.seq, p.field, t.i, p.pos, p.flags & 3 > 0 strong from posts p join term_of t using (term) where p.seq in (select seq from hit))",
        "tf as (select seq, field, i, count(*) n from occ group by all)",
        "rare as (select seq, field, arg_min(i, n * 1000 + i) r from tf group by all)",
        "s0 as (select o.seq, o.field, o.pos p, r.r, 1 n, true ex, true od, true cl, 0::bigint prev, o.strong st from occ o join rare r on o.seq = r.seq and o.field = r.field and o.i = r.r)",
    ]
    for i in range(n):
        before = f"case when {i} - s.r = 1 then s.p else s.prev end"
        ctes.append(
            f"""s{i + 1} as (select s.seq, s.field, s.p, s.r, any_value(s.n) + case when {i} <> s.r and count(q.pos) > 0 then 1 else 0 end n,
            case when {i} = s.r then any_value(s.ex) else coalesce(bool_or(q.pos = s.p + {i} - s.r), false) end ex,
            case when {i} = s.r then any_value(s.od) else coalesce(bool_or(q.pos > {before}), false) end od,
            case when {i} = s.r then any_value(s.cl) else count(q.pos) > 0 end cl,
            case when {i} = s.r then any_value(s.prev) else greatest(any_value({before}), coalesce(max(q.pos), 0)) end prev, any_value(s.st) or coalesce(bool_or(q.strong), false) st
            from s{i} s left join occ q on q.seq = s.seq and q.field = s.field and q.i = {i} and {i} <> s.r and q.pos between s.p + {i} - s.r - 10 and s.p + {i} - s.r + 10
            group by s.seq, s.field, s.p, s.r, s.prev)"""
        )
    ctes += [
        f"""side as (select seq, field, count(*) filter (where ex) exact, count(*) filter (where not ex and od) ordered, count(*) filter (where not ex and not od and cl) as "close",
        count(*) filter (where n = 2) pairs, count(*) filter (where {'true' if n == 1 else 'n >= 3'}) triples, count(*) filter (where p <= 100) top, count(*) filter (where st) strong, count(*) spans from s{n} group by all)""",
        f"""len_of as (select seq, 'title' field, title_length len from pg union all select seq, 'body', word_count - title_length from pg)""",
        f"""freq as (select l.seq, l.field, count(tf.n) filter (where l.len <= 0 or tf.n >= 0.01::double * l.len) k from len_of l left join tf using (seq, field) where l.seq in (select seq from hit) group by all)""",
        """summed as (select f.seq, f.field, f.k, coalesce(exact + ordered + "close" + pairs + triples, 0) total, exact, ordered, "close", pairs, triples, coalesce(top, 0) top, coalesce(strong, 0) strong from freq f left join side using (seq, field))""",
        f"""parts as (select *, case when total > 0 then (exact * 0.55::double + ordered * 0.10::double + "close" * 0.23::double + pairs * 0.08::double + triples * 0.04::double) / total
            * case when field = 'title' then 1.0::double else (0.3::double + 0.7::double / (1.0::double + ({soft_exp_sql("(-1.2::double * (total - 4))")}))) * (0.7::double + 0.3::double / (1.0::double + ({soft_exp_sql("(-4.0::double * (strong - 1))")}))) end
            else 0.0::double end span, case when k = {n} then 0.57::double when k >= 0.7::double * {n} then 0.29::double when k > 0 then 0.14::double else 0.0::double end fq from summed)""",
        f"""sides as (select seq, sum(case when field = 'title' then (span * 0.5::double + top * 0.3::double + fq * 0.2::double) * 0.7::double * case when regexp_matches(lower(url), '{"|".join(terms)}') then 1.2::double else 1.0::double end
            else (span * 0.5::double + top * 0.3::double + fq * 0.2::double) * 0.3::double end) dynamic from parts join pg using (seq) group by seq)""",
        f"""scored as (select seq, url, title, static, dynamic, 0.75::double * dynamic + 0.25::double * static score from sides join
            (select *, {static_score_sql("url", "word_count", "title_length", "english", utility)} static from pg) using (seq) where static >= 0.25 and dynamic >= 0.1)""",
    ]
    return ", ".join(ctes)


HAS_ANY = "select distinct seq from posts where term in ('{}', '{}')"
TWO = ["erin", "thanea"]
THREE = ["en", "er", "from"]
BOTH = "select seq from posts where term in ('erin', 'thanea') group by seq having count(distinct term) = 2"
ANY = "select distinct seq from posts where term in ('en', 'er', 'from')"
QUERY_TWO, QUERY_THREE = "erin thanea", "en | er | from"


def ranked(spark, sf_dir, text):
    return ranking.rank_pages(pages(spark, sf_dir), compile_query(text))


@query("rarest_term", f"{WITH}, {ranked_sql(THREE, ANY)} select seq, field, r rarest from rare")
def rarest_term(spark, sf_dir):
    places = boolean.matches(pages(spark, sf_dir), compile_query(QUERY_THREE))
    each = [F.struct(F.lit(f).alias("field"), F.array(*[F.col(boolean.column(f, i)) for i in range(3)]).alias("a")) for f in boolean.FIELDS]
    return places.select("seq", F.inline(F.array(*each))).withColumn("rarest", ranking.rarest("a")).filter("rarest is not null").drop("a")


def counted(spark, sf_dir, text, source=pages):
    r = ranked_features(spark, sf_dir, text, source)
    each = [F.struct(F.lit(f).alias("field"), *[F.col(f"dyn_{f}_{c}").alias(c) for c in ranking.COUNTERS]) for f in boolean.FIELDS]
    return r.select("seq", F.inline(F.array(*each))).filter("spans > 0")  # both fields from one pass


def ranked_features(spark, sf_dir, text, source=pages):
    node = compile_query(text)
    places = boolean.places_of_pages(source(spark, sf_dir), node, ["seq", "url", "title_length", "word_count"])
    return ranking.dynamic(places, ranking.ranking_terms(node)[0], ranking.leaf_terms(node), "dyn")


@query("span_counts", f"{WITH}, {ranked_sql(THREE, ANY)} select * from side")
def span_counts(spark, sf_dir):
    return counted(spark, sf_dir, QUERY_THREE)


@query("span_counts_pair", f"{WITH}, {ranked_sql(TWO, BOTH)} select * from side")
def span_counts_pair(spark, sf_dir):
    return counted(spark, sf_dir, QUERY_TWO)


@query("dynamic_score", f"{WITH}, {ranked_sql(THREE, ANY)} select seq, round(dynamic, 6) dynamic from sides")
def dynamic_score(spark, sf_dir):
    return ranked_features(spark, sf_dir, QUERY_THREE).select("seq", F.round("dyn", 6).alias("dynamic"))


SHOWN = "seq, url, title, round(score, 6) score"


def shown(df):
    return df.select("seq", "url", "title", F.round("score", 6).alias("score"))


@query("score_all", f"{WITH}, {ranked_sql(THREE, ANY)} select seq, round(static, 6) static, round(dynamic, 6) dynamic, round(score, 6) score from scored")
def score_all(spark, sf_dir):
    return ranked(spark, sf_dir, QUERY_THREE).select("seq", *[F.round(c, 6).alias(c) for c in ("static", "dynamic", "score")])


@query("ranked_topk", f"{WITH}, {ranked_sql(TWO, BOTH)} select {SHOWN} from scored order by scored.score desc, seq limit 10")
def ranked_topk(spark, sf_dir):
    """The flagship: a conjunction, scored and cut to the ten best."""
    return shown(results.top_k(ranked(spark, sf_dir, QUERY_TWO)))


@query("ranked_topk_index", f"{WITH}, {ranked_sql(THREE, ANY)} select {SHOWN} from scored order by scored.score desc, seq limit 10")
def ranked_topk_index(spark, sf_dir):
    i = build_index(pages(spark, sf_dir))
    return shown(results.top_k(ranking.rank_index(i.postings, i.docs, compile_query(QUERY_THREE))))


@query("ranked_phrase", f"""{WITH}, {ranked_sql(["anea", "erin", "thanea"], "select distinct a.seq from posts a join posts b on a.seq = b.seq and a.field = b.field and b.pos = a.pos + 1 and b.term = 'erin' join posts c on a.seq = c.seq and a.field = c.field and c.pos = a.pos + 2 and c.term = 'thanea' where a.term = 'anea'")} select {SHOWN} from scored order by scored.score desc, seq limit 10""")
def ranked_phrase(spark, sf_dir):
    return shown(results.top_k(ranked(spark, sf_dir, '"anea erin thanea"')))


@query("chunk_topk", f"{WITH}, {ranked_sql(THREE, ANY)}, r as (select seq // 1000 chunk_id, *, row_number() over (partition by seq // 1000 order by score desc, seq) as rank from scored) select chunk_id, rank, {SHOWN} from r where rank <= 10")
def chunk_topk(spark, sf_dir):
    best = results.chunk_top_k(ranked(spark, sf_dir, QUERY_THREE).withColumn("chunk_id", chunk_of(F.col("seq"), 1000)))
    return best.select("chunk_id", "rank", "seq", "url", "title", F.round("score", 6).alias("score"))


@query("merge_dedup", f"""{WITH}, {ranked_sql(THREE, ANY)}, u as (select * replace (regexp_extract(url, '^(.*)/[^/]*$', 1) as url) from scored),
    r as (select *, row_number() over (partition by url order by score desc, seq) nth from u) select {SHOWN} from r where nth = 1 order by r.score desc, seq limit 10""")
def merge_dedup(spark, sf_dir):
    """Ranked lists of several leaves as one, a URL (here without its last part) once."""
    r = ranked(spark, sf_dir, QUERY_THREE).withColumn("url", F.regexp_extract("url", "^(.*)/[^/]*$", 1))
    return shown(results.merged([r.filter(F.col("seq") % 3 == i) for i in range(3)]))


TOP_TWO = f"(with {document_pages_sql()}, {ranked_sql(TWO, BOTH)} select * from scored order by scored.score desc, seq limit 10)"
SAFE = lambda c: f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query("results_html", f"""select '<ul>' || coalesce(string_agg('<li><a href="' || {SAFE("url")} || '">' || {SAFE("title")} || '</a></li>', '' order by round(score, 6) desc, seq), '') || '</ul>' as html from {TOP_TWO}""")
def results_html(spark, sf_dir):
    return results.as_html(ranked_topk(spark, sf_dir))


# --- web pages: words that are bold or in a heading ------------------------------------------------------

WEB = f"with {web_pages_sql()}"
ON_WEB = ["erin", "from", "la"]
ANY_WEB = "select distinct seq from posts where term in ('erin', 'from', 'la')"
QUERY_WEB = "erin | from | la"


def parsed_pages(spark, sf_dir):
    return unparsed_pages(table(spark, sf_dir, "pages"))


@query("span_counts_web", f"{WEB}, {ranked_sql(ON_WEB, ANY_WEB)} select * from side")
def span_counts_web(spark, sf_dir):
    return counted(spark, sf_dir, QUERY_WEB, parsed_pages)


@query("page_search", f"{WEB}, {ranked_sql(ON_WEB, ANY_WEB)}, r as (select *, row_number() over (partition by url order by score desc, seq) nth from scored) select {SHOWN} from r where nth = 1 order by r.score desc, seq limit 10")
def page_search(spark, sf_dir):
    r = ranking.rank_pages(parsed_pages(spark, sf_dir), compile_query(QUERY_WEB))
    return shown(results.top_k(results.one_a_url(r.select("seq", "url", "title", "score"))))


# --- synonyms and intent ---------------------------------------------------------------------------------

SYNONYMS = {"erin": ["from", "attion thanedble"]}
WITH_SYNONYMS = """select seq from posts where term in ('erin', 'from') union select a.seq from posts a join posts b on a.seq = b.seq and a.field = b.field and b.pos = a.pos + 1 and b.term = 'thanedbl' where a.term = 'attion'"""
STATIC = static_score_sql("url", "word_count", "title_length", "english")


@query("ranked_synonyms", f"""{WITH}, own as (with {ranked_sql(["erin"], WITH_SYNONYMS)} select seq, dynamic from sides), syn as (with {ranked_sql(["from", "attion", "thanedbl"], WITH_SYNONYMS)} select seq, dynamic from sides),
    blended as (select seq, case when own.dynamic < 0.1 then 0.4::double * syn.dynamic + 0.6::double * own.dynamic else own.dynamic end dynamic from own join syn using (seq)),
    of as (select seq, url, title, static, dynamic from blended join (select *, {STATIC} static from pg) using (seq) where static >= 0.25 and dynamic >= 0.1)
    select seq, url, title, round(0.75::double * dynamic + 0.25::double * static, 6) score from of""")
def ranked_synonyms(spark, sf_dir):
    """All pages with a word or its synonyms: where the word itself scores little, the synonyms' score is blended in."""
    return shown(ranking.rank_pages(pages(spark, sf_dir), compile_query("erin", SYNONYMS)))


@query("ranked_utility_intent", f"{WITH}, {ranked_sql(['erin', 'term'], HAS_ANY.format('erin', 'term'), True)} select {SHOWN} from scored")
def ranked_utility_intent(spark, sf_dir):
    """A query that names terms of use asks for such pages: they lose nothing for being such."""
    return shown(ranked(spark, sf_dir, "erin | terms"))


# --- an index that was written ---------------------------------------------------------------------------

_written: dict[tuple[str, str], str] = {}


def written_index(spark, sf_dir):
    """The index of the table's documents, written to the shared folder once a session and read from there."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        write_index(build_index(pages(spark, sf_dir)), path)
        _written[key] = path
    return read_index(spark, _written[key])


@query("written_index_search", f"{WITH}, {ranked_sql(THREE, ANY)} select {SHOWN} from scored order by scored.score desc, seq limit 10")
def written_index_search(spark, sf_dir):
    return shown(search(written_index(spark, sf_dir), QUERY_THREE))


@query("written_index_phrase", f"""{WITH}, {ranked_sql(["attion", "thanedbl"], "select distinct a.seq from posts a join posts b on a.seq = b.seq and a.field = b.field and b.pos = a.pos + 1 and b.term = 'thanedbl' where a.term = 'attion'")} select {SHOWN} from scored order by scored.score desc, seq limit 10""")
def written_index_phrase(spark, sf_dir):
    return shown(search(written_index(spark, sf_dir), '"attion thanedble"'))


@query("written_index_without", f"{WITH}, {ranked_sql(['erin'], HAS_ANY.format('erin', 'erin') + ' except ' + HAS_ANY.format('en', 'er'))} select {SHOWN} from scored order by scored.score desc, seq limit 10")
def written_index_without(spark, sf_dir):
    return shown(search(written_index(spark, sf_dir), "erin -(en | er)"))


@query("written_index_words", f"{WITH} select field, term, count(*) post_count, count(distinct seq) doc_freq, max(pos) last_pos from posts group by field, term")
def written_index_words(spark, sf_dir):
    return written_index(spark, sf_dir).dictionary


@query("written_index_seek", f"{WITH} select p.chunk_id, min(d.start + p.pos - 1) as location from posts p join docs d using (seq) where term = 'erin' and d.start + p.pos - 1 >= 5000 group by p.chunk_id")
def written_index_seek(spark, sf_dir):
    """A term's first occurrence at a location or after it, in each chunk."""
    i = written_index(spark, sf_dir)
    return index.first_at_or_after(index.located(i.postings.filter("term = 'erin'"), i.docs), "erin", 5000)
