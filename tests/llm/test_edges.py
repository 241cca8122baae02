"""Nulls, empty and very long texts, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleanspark.llm.ann import ann_search
from gleanspark.llm.chat import chat_rows
from gleanspark.llm.decontam import decontaminate, drop_contaminated, unsearchable
from gleanspark.llm.langid import language_id
from gleanspark.llm.line_dedup import line_dedup
from gleanspark.llm.ngram_join import drop_near_duplicates, ngram_jaccard_join
from gleanspark.llm.packing import best_fit_packing, bpe_counter, word_counts
from gleanspark.llm.quality import quality_filter, quality_scores
from gleanspark.llm.secrets import secret_scan
from gleanspark.llm.substring import drop_passages, repeated_passages

ITEM = "If a train travels 60 miles in 2 hours how far does it go in 5 hours at the same speed today"
LONG = " ".join(f"w{i}" for i in range(60_000))
ROWS = [
    (1, "one two three four five six\nshared line", "en", "s", 10),
    (1, "one two three four five six\nshared line", "en", "s", 10),
    (2, None, "en", "s", None),
    (3, "", None, "s", 0),
    (4, LONG, "en", None, len(LONG)),
    (5, " \n\n ", "en", "s", 4),
    (None, "one two three four five six\nshared line", "en", "s", 10),
    (6, "before it " + ITEM + " after it", "en", "s", 10),
    (7, "!!! ???", "de", "s", 7),
    (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["key", "lines", "gone", "k", "h", "listed", "again", "nth", "p", "id", "TEXT_", "_c0", "c0"]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASH:
        d = d.withColumn(c, F.lit(c))
    return d.select("*", F.lit("x").alias("TEXT"), F.lit("y").alias("DOC_ID")).coalesce(2)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM, "x"), (2, None, "x"), (3, "", "x"), (None, ITEM, "x"), (4, "too short", "x")], "item_id long, text string, h string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (7, 0, 0), (2, None, 0), (None, 1, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")


def count(df):
    return len(df.collect())


def test_decontamination(docs, benchmark):
    r = decontaminate(docs, benchmark).collect()
    assert sorted((x["doc_id"], x["item_id"], x["same_values"]) for x in r) == [(6, 1, True)]
    assert sorted((x["item_id"] is None, x["item_id"] or 0) for x in unsearchable(benchmark).collect()) == [(False, 2), (False, 3), (False, 4), (True, 0)]
    left = drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns and count(left) == len(ROWS) - 1
    assert count(decontaminate(docs, benchmark.limit(0))) == 0 and count(decontaminate(docs.limit(0), benchmark)) == 0


def test_decontamination_of_ties_and_long_texts(spark, benchmark):
    """An item twice in a text, in repeated rows, in a row without an id and behind 60,000 words."""
    rows = [(1, f"{ITEM}. {ITEM.replace('60', '70')}"), (1, f"{ITEM}. {ITEM.replace('60', '70')}"), (None, ITEM), (2, LONG + " " + ITEM)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r)[:2] + (r["same_values"],) for r in decontaminate(d, benchmark.union(benchmark)).collect()) == [(1, 1, True), (2, 1, True)]
    assert [r[0] for r in drop_contaminated(d, benchmark).collect()] == [None]


def classes(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in df.collect()}


def test_ngram_join(docs):
    alone = {i: (i, 0) for i in range(1, 8)}
    assert classes(ngram_jaccard_join(docs)) == alone and count(ngram_jaccard_join(docs.limit(0))) == 0
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns and count(left) == len(ROWS) - 1  # of the repeated row one
    assert count(drop_near_duplicates(docs.limit(0))) == 0


def test_ngram_join_of_repeated_rows_ties_and_long_texts(spark):
    """Copies and near copies in repeated rows, without an id, of one id with other texts, and of 60,000 words."""
    near = "one two three four five six seven eight nine ten eleven"
    rows = [(5, near), (5, near), (None, near), (4, near.upper() + "!"), (3, near + " twelve"), (9, LONG), (8, LONG + " more"), (8, LONG + " more"), (7, None), (7, LONG + " and more"), (6, ""), (2, "one"), (1, " One. ")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = {5: (3, 2), 4: (3, 2), 3: (3, 2), 9: (7, 2), 8: (7, 2), 7: (7, 2), 6: (6, 0), 2: (1, 1), 1: (1, 1)}
    assert classes(ngram_jaccard_join(d)) == want
    left = drop_near_duplicates(d).collect()
    assert sorted((r[0] is not None, r[0] or 0) for r in left) == [(False, 0), (True, 1), (True, 3), (True, 6), (True, 7)]


def test_line_dedup(docs):
    out = line_dedup(docs, max_docs=1, chars_col="n_chars", dropped_col="dropped")
    assert out.columns == [*docs.columns, "dropped"]
    rows = out.toDF(*[f"{c}{i}" for i, c in enumerate(out.columns)]).collect()
    assert len(rows) == len(ROWS)
    assert [r[1] for r in rows if r[0] == 1] == ["", ""] and {r[4] for r in rows if r[0] == 1} == {0}
    assert [r[1] for r in rows if r[0] == 2] == [None] and [r[1] for r in rows if r[0] == 5] == [" \n\n "]
    first = line_dedup(docs, max_docs=1, keep_first=True, drop_emptied=True)
    assert count(first) == len(ROWS) - 2 and count(line_dedup(docs.limit(0))) == 0


def test_secret_scan(docs):
    assert count(secret_scan(docs)) == 0 and count(secret_scan(docs.limit(0))) == 0


def test_secret_scan_of_rows_with_hits(spark):
    """Rows without an id, repeated rows, ties of two rules at one place, and a secret behind 60,000 words."""
    key = "AKIA" + "Q" * 16
    rows = [(None, key), (1, key), (1, key), (2, LONG + " " + key), (3, f"{key} {key}"), (4, None), (5, "")]
    got = [(r["doc_id"], r["rule"], r["n_matches"]) for r in secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() if "aws" in r["rule"].lower()]
    assert sorted(got, key=repr) == sorted([(i, got[0][1], n) for i, n in ((None, 1), (1, 1), (1, 1), (2, 1), (3, 2))], key=repr)


def test_quality(docs, labels):
    r = quality_scores(docs, labels).collect()
    assert len(r) == len(ROWS) and all(0 <= x["p_good"] <= 1 for x in r)
    assert quality_filter(docs, labels).columns == docs.columns
    assert count(quality_scores(docs, labels.limit(0))) == len(ROWS) and count(quality_scores(docs.limit(0), labels)) == 0


def test_language_id(docs):
    r = language_id(docs).collect()
    assert len(r) == len(ROWS)
    assert {x["doc_id"]: x["n_words"] for x in r}[4] == 60_000
    assert all(x["lang"] is None and x["spans"] == [] for x in r if x["doc_id"] in (2, 3, 5))
    assert count(language_id(docs.limit(0))) == 0
    assert {x["lang"] for x in language_id(docs, docs.limit(0)).collect()} == {None}


def test_substring(docs):
    assert count(repeated_passages(docs)) == 0 and count(repeated_passages(docs.limit(0))) == 0
    twice = docs.union(docs.withColumn("source", F.lit("z")))
    assert count(repeated_passages(twice)) == 0  # the same ids again


def test_substring_of_rows_with_hits(spark):
    """A passage in repeated rows, without an id, twice in one text, in two texts of an id, and behind 60,000 words."""
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(2, passage), (2, passage), (None, passage), (3, f"x {passage} y {passage}"), (4, LONG + " " + passage), (5, passage[:-4]), (6, None), (7, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    spans = lambda v: [(s["start"], s["end"]) for s in v]
    got = {r["doc_id"]: (r["n_words"], spans(r["spans"]), spans(r["drop_spans"])) for r in repeated_passages(d).collect()}
    twice = [(1, 51), (52, 102)]
    assert got == {2: (50, [(0, 50)], []), 3: (100, twice, twice), 4: (50, [(60_000, 60_050)], [(60_000, 60_050)])}
    cut = sorted(((r[0] is None, r[0] or 0, r[1] if r[1] is None or len(r[1]) < 999 else len(r[1])) for r in drop_passages(d).collect()), key=repr)
    assert cut == sorted([(False, 2, passage), (False, 2, passage), (True, 0, passage), (False, 3, "x y "), (False, 4, len(LONG) + 1), (False, 5, passage[:-4]), (False, 6, None), (False, 7, "")], key=repr)
    mixed = spark.createDataFrame([(1, passage), (2, passage), (2, "other " + passage)], "doc_id long, text string")
    assert sorted(r[1] for r in drop_passages(mixed).collect()) == sorted([passage, passage, "other " + passage])


def test_drop_passages_keeps_columns(docs):
    out = drop_passages(docs)
    assert out.columns == docs.columns and count(out) == len(ROWS) and count(drop_passages(docs.limit(0))) == 0


def test_packing_with_the_tokenizer(spark, docs):
    """The default counter: nulls, empty texts, special words, 60,000 words and repeated rows, each packed."""
    r = best_fit_packing(docs).collect()
    counts = dict(zip([t for _, t, *_ in ROWS], bpe_counter()([t or "" for _, t, *_ in ROWS]), strict=True))
    want = Counter()
    for i, t, *_ in ROWS:
        want[i] += counts[t] + bool(counts[t])
    got = Counter()
    for p in r:
        assert p["used"] == sum(p["lengths"]) <= 4096
        for d, n in zip(p["doc_ids"], p["lengths"], strict=True):
            got[d] += n
    assert got == +want and count(best_fit_packing(docs.limit(0))) == 0


def test_packing(docs):
    r = best_fit_packing(docs, 1000, word_counts).collect()
    assert sum(x["used"] for x in r) == sum(len((t or "").split()) + bool((t or "").split()) for _, t, *_ in ROWS)
    assert all(sum(x["lengths"]) == x["used"] <= 1000 for x in r)
    assert count(best_fit_packing(docs.limit(0), 1000, word_counts)) == 0


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert count(chat_rows(spark.createDataFrame([], schema))) == 0
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "user", "x"), (2, 0, "user", LONG)]
    clash = spark.createDataFrame(rows, schema).withColumns({c: F.lit("q") for c in ("m", "parts", "ms", "TEXT_")}).select("*", F.lit(1).alias("TURN"))
    got = {r["conv_id"]: r for r in chat_rows(clash).collect()}
    assert set(got) == {1, 2} and got[1]["n_messages"] == 2 and got[2]["n_text_tokens"] == 60_000


def test_ann(spark):
    schema = "vec_id long, embedding array<float>, label int"
    nan = float("nan")
    rows = [(1, [1.0, 0.0, 0.0], 0), (1, [1.0, 0.0, 0.0], 0), (2, [2.0, 0.0, 0.0], 0), (3, [0.0, 1.0, 0.0], 0), (4, None, 0), (5, [], 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, 2.0], 0), (8, [nan, 1.0, 0.0], 0), (9, [1.0, None, 0.0], 0), (None, [1.0, 0.0, 0.0], 0)]
    d = spark.createDataFrame(rows, schema).withColumns({c: F.lit(c) for c in ("v", "id", "shard")}).select("*", F.lit(0).alias("VEC_ID"))
    r = [tuple(x) for x in ann_search(d, k=2, step=1).orderBy("vec_id", "rank").collect()]
    assert r == [(1, 1, 2, 1.0), (1, 2, 3, 0.0), (2, 1, 1, 1.0), (2, 2, 3, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0)]
    assert count(ann_search(d)) == 0  # no id is divisible by 20
    assert count(ann_search(d.limit(0))) == 0 and count(ann_search(spark.createDataFrame(rows[:1], schema))) == 0


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages(spark, docs, benchmark, labels, tmp_path, empty):
    benchmark.coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    labels.coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    d = docs.limit(0) if empty else docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == docs.columns, name
        assert empty == (count(out) == 0), name
    assert (count(corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path))) == 0) == empty


def test_pipeline_run_on_empty_tables(spark, benchmark, labels, tmp_path):
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    benchmark.limit(0).coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    labels.limit(0).coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    assert count(corpus_pipeline.run(spark, str(tmp_path))) == 0
