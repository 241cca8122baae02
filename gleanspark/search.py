"""Search: a query's text in, the best pages out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from gleanspark.operators.ranking import rank_index, rank_pages
from gleanspark.operators.results import K, one_a_url, top_k
from gleanspark.plans.query import compile_query
from gleanspark.sources.store import Index

SHOWN = ["seq", "url", "title", "score"]


def search(index: Index, query: str, k: int = K, synonyms: Mapping[str, Sequence[str]] | None = None, url_encoded: bool = False) -> DataFrame:
    """The k best pages of an index, one a URL, best first: ``seq``, ``url``, ``title``, ``score``."""
    node = compile_query(query, synonyms, url_encoded)
    return top_k(one_a_url(rank_index(index.postings, index.docs, node).select(SHOWN)), k)


def search_pages(pages: DataFrame, query: str, k: int = K, synonyms: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The same without an index: one pass over the pages."""
    node = compile_query(query, synonyms)
    return top_k(one_a_url(rank_pages(pages, node).select(SHOWN)), k)
