"""Results: top k, merging of ranked lists, one row a URL, the page of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 10


def top_k(scored: DataFrame, k: int = K, tie: str = "seq") -> DataFrame:
    """The best k, equal scores by the smaller number: each task keeps k rows, and no more are merged."""
    return scored.orderBy(F.desc("score"), tie).limit(k)


def chunk_top_k(scored: DataFrame, k: int = K, chunk: str = "chunk_id", tie: str = "seq") -> DataFrame:
    """The best k of each chunk."""
    best = Window.partitionBy(chunk).orderBy(F.desc("score"), tie)
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def one_a_url(scored: DataFrame, tie: str = "seq") -> DataFrame:
    """Of the rows of a URL the best; combined in each task before rows move."""
    order = F.struct(F.col("score").isNull().alias("n"), (-F.col("score")).alias("s"), F.col(tie).alias("t"))
    best = scored.groupBy("url").agg(F.min_by(F.struct(*scored.columns), order).alias("b"))
    return best.select("b.*")


def merged(lists: list[DataFrame], k: int = K, tie: str = "seq") -> DataFrame:
    """Ranked lists as one: a URL once, best first."""
    return top_k(one_a_url(reduce(DataFrame.unionByName, lists), tie), k, tie)


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def as_html(results: DataFrame, tie: str = "seq") -> DataFrame:
    """One row: a list of linked titles, best first."""
    item = F.concat(F.lit('<li><a href="'), escaped(F.col("url")), F.lit('">'), escaped(F.col("title")), F.lit("</a></li>"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(tie).alias("t"), item.alias("li"))))
    return results.agg(rows.alias("r")).select(F.concat(F.lit("<ul>"), F.array_join(F.transform("r", lambda x: x["li"]), ""), F.lit("</ul>")).alias("html"))
