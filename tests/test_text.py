from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanspark.functions import text
from gleanspark.functions.stemming import stem_token, stems

GOLDENS = "running=run hoping=hop relational=relat cities=citi privacy=privaci terms=term policy=polici cookies=cooki legal=legal document=document test=test paste=paste children=child the=".split()


def test_goldens():
    for pair in GOLDENS:
        word, stem = pair.split("=")
        assert stem_token(word) == stem, word


def test_both_stemmers_agree(spark, sf_dir):
    vocabulary = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(text.tokens(F.col("text"))).alias("t")).distinct()
    odd = ["y's'", "'yes'", "yyy", "past", "pasting", "eed", "agreedly", "ties", "cries", "gas", "kiwis", "'", "''s", "é", "éa", "hopping", "egging", "size", "organize", "bli", "ogi", "logi"]
    both = vocabulary.union(spark.createDataFrame([(w,) for w in odd], "t string")).select("t", text.stem("t").alias("s"))
    assert [(t, s, stem_token(t)) for t, s in both.collect() if s != stem_token(t)] == []


def test_stems_keep_places(spark):
    df = spark.createDataFrame([(["the", "running", "!", "cats"],), ([],), (None,)], "w array<string>")
    assert [r["s"] for r in df.select(stems("w").alias("s")).collect()] == [["", "run", "", "cat"], [], []]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdeilnosuyé'!.", max_size=12))
def test_stem_is_total(word):
    s = stem_token(word)
    assert isinstance(s, str) and len(s) <= len(word) + 1


def test_tokens_of_null_and_blank(spark):
    df = spark.createDataFrame([(None,), ("",), (" \t\r\n",), ("A\tÉb\r\nC",)], "x string")
    assert [r["t"] for r in df.select(text.tokens(F.col("x")).alias("t")).collect()] == [[], [], [], ["a", "Éb", "c"]]
