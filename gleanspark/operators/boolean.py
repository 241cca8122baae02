"""Boolean retrieval, in two ways.

The set operators work on postings: a word is a pushed-down filter, AND a semi join, OR a union, NOT an anti
join, a phrase an equi-join of places. ``matches`` evaluates a whole query in one pass instead: each page has an
array of places for each term, and the query is one Boolean expression over these arrays.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.operators.analysis import FIELDS, attributes, with_places
from gleanspark.operators.steps import computed
from gleanspark.plans.query import And, Node, Not, Or, Phrase, Synonyms, Word, leaf_terms


# --- sets of pages ---------------------------------------------------------------------------------------


def word(posts: DataFrame, term: str) -> DataFrame:
    return posts.filter(F.col("term") == term).select("seq").distinct()


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "seq", "left_semi")


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "seq", "left_anti")


def phrase(posts: DataFrame, terms: list[str]) -> DataFrame:
    """Pages in which the terms stand one after the other in a field."""
    first, *rest = [posts.filter(F.col("term") == t).select("seq", "field", (F.col("pos") - i).alias("at")) for i, t in enumerate(terms)]
    return reduce(lambda a, b: a.join(b, ["seq", "field", "at"], "left_semi"), rest, first).select("seq").distinct()


def evaluate(posts: DataFrame, docs: DataFrame, node: Node | None) -> DataFrame:
    """The pages (``seq``) that match, by set operators."""
    if node is None:
        return docs.select("seq").limit(0)
    if isinstance(node, Word):
        return word(posts, node.stem)
    if isinstance(node, Phrase):
        return phrase(posts, list(node.stems))
    if isinstance(node, Synonyms):
        return reduce(either, [evaluate(posts, docs, n) for n in node.others], word(posts, node.word.stem))
    if isinstance(node, Or):
        return either(evaluate(posts, docs, node.left), evaluate(posts, docs, node.right))
    if isinstance(node, Not):
        return without(docs.select("seq"), evaluate(posts, docs, node.node))
    if isinstance(node.right, Not):
        return without(evaluate(posts, docs, node.left), evaluate(posts, docs, node.right.node))
    return both(evaluate(posts, docs, node.left), evaluate(posts, docs, node.right))


def synonym_pages(posts: DataFrame, node: Synonyms) -> DataFrame:
    """Pages with a word or a synonym; ``is_synonym`` where only a synonym stands."""
    own = word(posts, node.word.stem).withColumn("is_synonym", F.lit(False))
    others = reduce(either, [evaluate(posts, posts, n) for n in node.others]).withColumn("is_synonym", F.lit(True))
    return own.union(others).groupBy("seq").agg(F.bool_and("is_synonym").alias("is_synonym"))


def term_counts(words: DataFrame, terms: list[str]) -> dict[str, int]:
    """The postings of a query's few terms, from the dictionary."""
    rows = words.filter(F.col("term").isin(terms)).groupBy("term").agg(F.sum("post_count").alias("n")).collect()
    return {r["term"]: r["n"] for r in rows}


def estimated_posts(node: Node | None, counts: Mapping[str, int], pages: int) -> int:
    """How many postings there are to be read: a word's own; the sum for either of two; of both, the left one's; a phrase's first term's; without, all pages."""
    if node is None:
        return 0
    if isinstance(node, Word):
        return counts.get(node.stem, 0)
    if isinstance(node, Phrase):
        return counts.get(node.stems[0], 0)
    if isinstance(node, Not):
        return pages
    if isinstance(node, Synonyms):
        return sum(estimated_posts(n, counts, pages) for n in (node.word, *node.others))
    left, right = (estimated_posts(n, counts, pages) for n in (node.left, node.right))
    return left + right if isinstance(node, Or) else left


def needs_a_term(node: Node) -> bool:
    """Whether a page without any of the query's terms can't match."""
    if isinstance(node, Not):
        return not needs_a_term(node.node)
    if isinstance(node, (And, Or)):
        return (any if isinstance(node, And) else all)(needs_a_term(n) for n in (node.left, node.right))
    return True


# --- one pass --------------------------------------------------------------------------------------------


def column(field: str, i: int) -> str:
    return f"{field}_{i}"


def places_of_pages(pages: DataFrame, node: Node, keep: list[str]) -> DataFrame:
    """Of the pages that match: ``keep`` and, for each field and term, an array of its (pos, strong) in order; straight from pages, without a shuffle."""
    terms = leaf_terms(node)
    return with_places(pages, terms, keep, needs_a_term(node)).filter(condition(node, terms))


def places_of_postings(posts: DataFrame, terms: list[str]) -> DataFrame:
    """``seq`` and the same arrays from an index: one scan of the terms' postings, and one shuffle by page."""
    hit = posts.filter(F.col("term").isin(terms)).select("seq", F.struct("pos", "field", "term", (F.col("flags").bitwiseAND(F.lit(3)) != 0).alias("strong")).alias("p"))
    gathered = hit.groupBy("seq").agg(F.array_sort(F.collect_list("p")).alias("_hits"))
    return computed(gathered, **_place_columns("_hits", terms)).drop("_hits")


def _less(k: int):
    return lambda p: p - k


def _place_columns(hits: str, terms: list[str]) -> dict[str, Column]:
    """Places of each field and term; ``strong`` ones are bold or in a heading."""
    def of(field: str, term: str) -> Column:
        own = F.filter(hits, lambda p: (p["term"] == term) & (p["field"] == field))
        return F.transform(own, lambda p: F.struct(p["pos"].alias("pos"), p["strong"].alias("strong")))

    return {column(field, i): of(field, t) for field in FIELDS for i, t in enumerate(terms)}


def condition(node: Node, terms: list[str]) -> Column:
    """The query over the arrays of places."""
    if isinstance(node, Word):
        i = terms.index(node.stem)
        return reduce(lambda a, b: a | b, [F.size(column(f, i)) > 0 for f in FIELDS])
    if isinstance(node, Phrase):
        at = [terms.index(s) for s in node.stems]

        def in_field(f: str) -> Column:
            # where the phrase would begin by each of its terms: what they have in common, found by hashing
            begins = [F.transform(F.col(column(f, x))["pos"], _less(k)) for k, x in enumerate(at)]
            return F.size(reduce(F.array_intersect, begins)) > 0

        return reduce(lambda a, b: a | b, [in_field(f) for f in FIELDS])
    if isinstance(node, Synonyms):
        return reduce(lambda a, b: a | b, [condition(n, terms) for n in (node.word, *node.others)])
    if isinstance(node, Not):
        return ~condition(node.node, terms)
    left, right = condition(node.left, terms), condition(node.right, terms)
    return left & right if isinstance(node, And) else left | right


def matches(pages: DataFrame, node: Node | None, keep: list[str] | None = None) -> DataFrame:
    """The pages that match, with ``keep`` and the arrays of places of the query's terms: one projection, no shuffle."""
    keep = keep or ["seq"]
    if node is None:
        return attributes(pages, keep).limit(0)
    return places_of_pages(pages, node, keep)
