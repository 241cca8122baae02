"""Ranking: how closely, in what order and how prominently a page has the terms, blended with what the page is worth.

All is computed on arrays of places within a row, so that ranking adds no shuffle; only the final top k does.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.scoring import soft_exp, static_score
from gleanspark.operators.analysis import attributes
from gleanspark.operators.boolean import column, condition, needs_a_term, places_of_pages, places_of_postings
from gleanspark.operators.steps import computed
from gleanspark.plans.query import Node, leaf_terms, ranking_terms, wants_utility

REACH = 10
TOP = 100
LEAST_STATIC, LEAST_DYNAMIC = 0.25, 0.1
COUNTERS = ("exact", "ordered", "close", "pairs", "triples", "top", "strong", "spans")


def rarest(places: str) -> Column:
    """The number of the term with the fewest places, of those that have any; the first of equals; null if none has."""
    counts = F.transform(places, lambda a: F.size(a))
    least = F.array_min(F.filter(counts, lambda n: n > 0))
    return F.when(least.isNotNull(), (F.array_position(counts, least) - 1).cast("int"))


def span_counts(places: str) -> Column:
    """Counters over the places of the rarest term, from an array (a term each) of arrays of (pos, strong).

    Around each such place every other term is looked for where it would stand in the phrase, give or take
    ``REACH``. Whether a span is exact, ordered or close is decided by the last of the terms.
    """
    text = f"""
    transform(case when {places}_r is null then array() else {places}[{places}_r] end, p -> aggregate(
        transform(sequence(0, size({places}) - 1), i -> named_struct('i', i - {places}_r, 'w',
            filter({places}[i], q -> q.pos between p.pos + i - {places}_r - {REACH} and p.pos + i - {places}_r + {REACH}))),
        named_struct('n', 1, 'exact', true, 'ordered', true, 'close', true, 'prev', 0L, 'strong', p.strong),
        (s, x) -> case when x.i = 0 then s else named_struct(
            'n', s.n + case when size(x.w) > 0 then 1 else 0 end,
            'exact', exists(x.w, q -> q.pos = p.pos + x.i),
            'ordered', exists(x.w, q -> q.pos > case when x.i = 1 then p.pos else s.prev end),
            'close', size(x.w) > 0,
            'prev', greatest(case when x.i = 1 then p.pos else s.prev end, coalesce(array_max(transform(x.w, q -> q.pos)), 0L)),
            'strong', s.strong or exists(x.w, q -> q.strong)) end,
        s -> named_struct('n', s.n, 'exact', s.exact, 'ordered', s.ordered, 'close', s.close, 'strong', s.strong, 'top', p.pos <= {TOP})))"""
    return F.expr(text)


def counters(spans: str, n_terms: int) -> dict[str, Column]:
    """How many spans are exact, else ordered, else close; hold two terms, three or more; begin near the top; have a strong word."""
    conditions = {
        "exact": "s.exact",
        "ordered": "not s.exact and s.ordered",
        "close": "not s.exact and not s.ordered and s.close",
        "pairs": "s.n = 2",
        "triples": "true" if n_terms == 1 else "s.n >= 3",
        "top": "s.top",
        "strong": "s.strong",
        "spans": "true",
    }
    return {name: F.expr(f"cast(size(filter({spans}, s -> {c})) as long)") for name, c in conditions.items()}


def side_score(c: Mapping[str, Column], frequencies: Column, length: Column, n_terms: int, title: bool) -> Column:
    """The score of one field from its counters, its terms' frequencies and its length."""
    total = c["exact"] + c["ordered"] + c["close"] + c["pairs"] + c["triples"]
    span = (c["exact"] * 0.55 + c["ordered"] * 0.10 + c["close"] * 0.23 + c["pairs"] * 0.08 + c["triples"] * 0.04) / total
    if not title:
        span = span * (0.3 + 0.7 / (1.0 + soft_exp(-1.2 * (total - 4)))) * (0.7 + 0.3 / (1.0 + soft_exp(-4.0 * (c["strong"] - 1))))
    span = F.when(total > 0, span).otherwise(0.0)
    frequent = F.size(F.filter(frequencies, lambda n: (n > 0) & ((length <= 0) | (n >= 0.01 * length))))
    freq = F.when(frequent == n_terms, 0.57).when(frequent >= 0.7 * n_terms, 0.29).when(frequent > 0, 0.14).otherwise(0.0)
    return span * 0.5 + c["top"] * 0.3 + freq * 0.2


def dynamic(df: DataFrame, terms: list[str], all_terms: list[str], name: str) -> DataFrame:
    """``df`` (with arrays of places, ``url``, ``title_length``, ``word_count``) and ``name``, its score for the terms; with counters of each field."""
    if not terms:
        return df.withColumn(name, F.lit(0.0))
    # each step for both fields at once, for every step is a plan to be analysed
    name_of = {f: f"{name}_{f}" for f in ("title", "body")}
    df = computed(df, **{p: F.array(*[F.col(column(f, all_terms.index(t))) for t in terms]) for f, p in name_of.items()})
    df = computed(df, **{f"{p}_r": rarest(p) for p in name_of.values()})
    df = computed(df, **{f"{p}_s": span_counts(p) for p in name_of.values()})
    df = computed(df, **{f"{p}_{c}": x for p in name_of.values() for c, x in counters(f"{p}_s", len(terms)).items()})
    sizes = lambda f: F.transform(f"{name}_{f}", lambda a: F.size(a))
    counts = lambda f: {c: F.col(f"{name}_{f}_{c}") for c in COUNTERS}
    in_url = F.lower("url").rlike("|".join(_literal(t) for t in terms))
    title = side_score(counts("title"), sizes("title"), F.col("title_length"), len(terms), True) * F.when(in_url, 1.2).otherwise(1.0)
    body = side_score(counts("body"), sizes("body"), F.col("word_count") - F.col("title_length"), len(terms), False)
    return computed(df, **{name: 0.7 * title + 0.3 * body})


def _literal(term: str) -> str:
    return "".join(c if c.isalnum() else f"[{c}]" if c not in "[]^\\" else f"\\{c}" for c in term)


ATTRIBUTES = ["seq", "url", "title", "word_count", "title_length", "english"]


def scored(candidates: DataFrame, node: Node, terms: list[str]) -> DataFrame:
    """Candidates (attributes and places) with ``static``, ``dynamic`` and ``score``, less those below the least of either."""
    own, others = ranking_terms(node)
    worth = static_score(F.col("url"), F.col("word_count"), F.col("title_length"), F.col("english"), wants_utility(own))
    df = candidates.withColumn("static", worth).filter(F.col("static") >= LEAST_STATIC)
    df = dynamic(df, own, terms, "dyn")
    if others:
        df = dynamic(df, others, terms, "syn")
        df = df.withColumn("dynamic", F.when(F.col("dyn") < LEAST_DYNAMIC, 0.4 * F.col("syn") + 0.6 * F.col("dyn")).otherwise(F.col("dyn")))
    else:
        df = df.withColumn("dynamic", F.col("dyn"))
    df = df.filter(F.col("dynamic") >= LEAST_DYNAMIC)
    return df.withColumn("score", 0.75 * F.col("dynamic") + 0.25 * F.col("static"))


def rank_pages(pages: DataFrame, node: Node | None) -> DataFrame:
    """All pages that match, scored, straight from pages; ``title`` is the page's, or its URL where it has none."""
    if node is None:
        return attributes(pages, ATTRIBUTES).limit(0).withColumns({x: F.lit(0.0) for x in ("static", "dynamic", "score")})
    p = places_of_pages(pages, node, ATTRIBUTES)
    return scored(p.withColumn("title", F.when(F.col("title") == "", F.col("url")).otherwise(F.col("title"))), node, leaf_terms(node))


def rank_index(posts: DataFrame, docs: DataFrame, node: Node | None) -> DataFrame:
    """The same from an index: the terms' postings, then the attributes of the pages that match."""
    d = docs.select("seq", "url", F.when(F.col("title") == "", F.col("url")).otherwise(F.col("title")).alias("title"), "word_count", "title_length", "english")
    if node is None:
        return d.limit(0).withColumns({x: F.lit(0.0) for x in ("static", "dynamic", "score")})
    terms = leaf_terms(node)
    places = places_of_postings(posts, terms)
    names = [column(f, i) for f in ("title", "body") for i in range(len(terms))]
    joined = d.join(places, "seq", "inner" if needs_a_term(node) else "left")  # pages without any of the terms can match an exclusion
    kind = "array<struct<pos:long,strong:boolean>>"
    filled = joined.select(*d.columns, *[F.coalesce(F.col(n), F.array().cast(kind)).alias(n) for n in names])
    return scored(filled.filter(condition(node, terms)), node, terms)
