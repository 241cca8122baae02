"""Scores: the polynomial that stands in for the exponential, and what a document is worth whatever the query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanspark.functions import urls


def soft_exp(x: Column | float) -> Column:
    """The series of the exponential to the sixth power for |x|, its reciprocal below nought; fixed values beyond 20."""
    x = F.lit(x) if isinstance(x, (int, float)) else x
    a = F.abs(x)
    series = F.lit(1.0 / 720.0)
    for c in (1.0 / 120.0, 1.0 / 24.0, 1.0 / 6.0, 0.5, 1.0, 1.0):
        series = F.lit(c) + a * series
    return F.when(x > 20, F.lit(4.85e8)).when(x < -20, F.lit(2.06e-9)).when(x < 0, 1.0 / series).otherwise(series)


def soft_exp_sql(x: str) -> str:
    a = f"abs({x})"
    series = "(1.0::double / 720)"
    for c in ("(1.0::double / 120)", "(1.0::double / 24)", "(1.0::double / 6)", "0.5::double", "1.0::double", "1.0::double"):
        series = f"({c} + {a} * {series})"
    return f"case when {x} > 20 then 4.85e8 when {x} < -20 then 2.06e-9 when {x} < 0 then 1.0 / {series} else {series} end"


def static_score(url: Column, word_count: Column, title_length: Column, english: Column, utility_query: bool = False) -> Column:
    """From the lengths of URL, title and text, the domain and the language; utility pages count little unless asked for."""
    score = (
        0.35 * soft_exp(-0.02 * F.octet_length(url))
        + 0.35 * urls.tld_score(urls.tld(url))
        + 0.15 / (1.0 + F.pow(word_count - 600, F.lit(2)) / 250000.0)
        + 0.15 * soft_exp(-0.08 * F.greatest(title_length - 10, F.lit(0)))
    )
    score = score * F.when(english, 1.0).otherwise(0.14)
    return score if utility_query else score * F.when(urls.is_utility(url), 0.15).otherwise(1.0)


def static_score_sql(url: str, word_count: str, title_length: str, english: str, utility_query: bool = False) -> str:
    utility = "" if utility_query else f" * case when regexp_matches(lower({url}), '{urls.UTILITY}') then 0.15::double else 1.0::double end"
    return (
        f"(0.35 * ({soft_exp_sql(f'(-0.02::double * strlen({url}))')}) + 0.35 * {urls.tld_score_sql(f'({urls.tld_sql(url)})')}"
        f" + 0.15 / (1.0::double + pow(({word_count}) - 600, 2) / 250000.0) + 0.15 * ({soft_exp_sql(f'(-0.08::double * greatest(({title_length}) - 10, 0))')}))"
        f" * case when {english} then 1.0::double else 0.14 end{utility}"
    )
