"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over a threshold, reassemble.

For the counts three numbers of eight bytes a line are shuffled (its hash, the document's id, and a number that stands
for a missing id), combined beforehand. Lines over the threshold are broadcast if they are counted few; else the
join with them is by hash, where adaptive execution splits the hot lines. The lines to drop come back as a short array
per document, and each text is rebuilt from its own lines in order of position, so a text moves at most once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import by_position, maybe_broadcast, written

#: A line may stand in so many documents.
MAX_DOCS = 20


def normal_line(line: Column) -> Column:
    """Lower case, runs of blanks as one space, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(line, "[ \t\r]+", " ")))


def line_hash(line: Column) -> Column:
    return F.xxhash64(normal_line(line))


def line_dedup(
    docs: DataFrame, max_docs: int = MAX_DOCS, keep_first: bool = False, drop_emptied: bool = False, dropped_col: str | None = None, chars_col: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with its columns and rows, less the lines that stand in more than ``max_docs`` distinct documents.

    Lines are compared by ``normal_line``; blank lines are neither counted nor dropped. With ``keep_first``
    the document of the smallest id keeps a repeated line. With ``drop_emptied`` a document all of whose
    lines were dropped goes too. A null text stays null; an empty one stays empty. Repeated rows of one id
    count as one document and are treated alike; rows without an id count as one document per distinct text
    (and come first where ids are compared). ``dropped_col`` names a column to add: lines dropped. ``chars_col`` names a column that is to follow the text's length. Other columns are carried along, whatever their names. Texts
    are read whole, however long; an empty table gives no rows.
    """
    plain, at = by_position(docs)
    key, lines, gone = "key", "lines", "gone"
    text, doc = F.col(at[text_col]), F.col(at[id_col])
    # equal (id, text) rows have equal lines, so this key serves to bring results back
    keyed = plain.withColumn(key, F.xxhash64(doc, text))
    each = keyed.select(
        F.col(key).alias("k"),
        doc.alias("id"),
        F.when(doc.isNull(), F.col(key)).alias("anon"),
        F.explode(F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: normal_line(x) != ""), line_hash))).alias("h"),
    )
    each = written(each)  # read twice below; without this the texts would be split and hashed twice
    many = each.select("h", "id", "anon").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "anon")).alias("first"))
    hit = each.join(maybe_broadcast(written(many.filter(F.col("n") > max_docs).select("h", "first.*").toDF("h", "first_id", "first_anon"))), "h")
    if keep_first:
        hit = hit.filter(~(F.col("id").eqNullSafe(F.col("first_id")) & F.col("anon").eqNullSafe(F.col("first_anon"))))
    drops = hit.groupBy(F.col("k").alias(key)).agg(F.collect_set("h").alias(gone))
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.coalesce(F.array_contains(F.col(gone), line_hash(x)), F.lit(False)))
    touched = F.col(gone).isNotNull()
    out = keyed.join(drops, key, "left").withColumn(lines, F.when(touched, kept))
    if drop_emptied:
        out = out.filter(~touched | (F.trim(F.regexp_replace(F.array_join(lines, " "), "[ \t\r]+", " ")) != ""))
    left = F.when(touched, F.array_join(lines, "\n")).otherwise(text)
    new = {text_col: left, chars_col: F.when(touched, F.length(left).cast("long")).otherwise(F.col(at[chars_col])) if chars_col else None}
    columns = [new[c].alias(at[c]) if c in new else F.col(x) for c, x in zip(docs.columns, plain.columns, strict=True)]
    if dropped_col:
        columns.append(F.when(touched, F.size(F.split(text, "\n")) - F.size(lines)).otherwise(0).cast("long"))
    return out.select(*columns).toDF(*docs.columns, *([dropped_col] if dropped_col else []))


def sql(max_docs: int = MAX_DOCS) -> str:
    """The rows of ``op3`` in SQL: id, text that is left, lines dropped."""
    normal = "lower(trim(regexp_replace({}, '[ \\t\\r]+', ' ', 'g'), ' '))"
    return f"""
    with lines as (
        select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) pos from documents),
    normal as (select doc_id, pos, line, {normal.format("line")} norm from lines),
    many as (select norm from normal where norm <> '' group by norm having count(distinct doc_id) > {max_docs}),
    left_over as (
        select doc_id, string_agg(line, chr(10) order by pos) filter (where m.norm is null) txt, count(m.norm) dropped
        from normal n left join many m on n.norm = m.norm group by doc_id)
    select doc_id, coalesce(txt, '') as text, cast(dropped as bigint) as lines_dropped from left_over"""
