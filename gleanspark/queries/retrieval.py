"""Queries of Boolean retrieval, by set operators and in one pass."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleanspark.functions import text
from gleanspark.operators import boolean
from gleanspark.operators.index import dictionary_of_pages, indexable
from gleanspark.plans.query import Phrase, Synonyms, Word, compile_query
from gleanspark.queries.indexing import WITH, pages, posts
from gleanspark.registry import query
from gleanspark.sources.shared import shared_folder
from gleanspark.sources.synsets import read_synsets

HAS = "select distinct seq from posts where term = '{}'"
SETS = {x: HAS.format(x) for x in ("en", "er", "from", "erin", "re")}


def phrase_sql(*terms: str) -> str:
    joins = " ".join(f"join posts p{i} on p{i}.seq = p0.seq and p{i}.field = p0.field and p{i}.pos = p0.pos + {i} and p{i}.term = '{t}'" for i, t in enumerate(terms) if i)
    return f"select distinct p0.seq from posts p0 {joins} where p0.term = '{terms[0]}'"


def by_sets(name: str, wanted: str, sql: str):
    """Registers a query by set operators over postings, and the same in one pass over pages."""

    @query(name, f"{WITH} {sql}")
    def sets(spark, sf_dir):
        node = compile_query(wanted)
        return boolean.evaluate(posts(spark, sf_dir, boolean.leaf_terms(node)), indexable(pages(spark, sf_dir)).select("seq"), node)

    @query(f"{name}_one_pass", f"{WITH} {sql}")
    def one_pass(spark, sf_dir):
        return boolean.matches(pages(spark, sf_dir), compile_query(wanted)).select("seq")


by_sets("word_scan", "from", SETS["from"])
by_sets("bool_and", "en & er", f"{SETS['en']} intersect {SETS['er']}")
by_sets("implicit_and", "en er from", f"{SETS['en']} intersect {SETS['er']} intersect {SETS['from']}")
by_sets("bool_or", "from | erin", f"{SETS['from']} union {SETS['erin']}")
by_sets("bool_not", "-en", f"select seq from pg except {SETS['en']}")
by_sets("and_not", "en -er", f"{SETS['en']} except {SETS['er']}")
by_sets("nested_bool", "(en | re) & -(erin & from)", f"(({SETS['en']}) union ({SETS['re']})) except (({SETS['erin']}) intersect ({SETS['from']}))")
by_sets("left_to_right", "en & er | erin & from", f"(({SETS['en']} intersect {SETS['er']}) union {SETS['erin']}) intersect {SETS['from']}")
by_sets("phrase2", '"attion thanedble"', phrase_sql("attion", "thanedbl"))
by_sets("phrase3", '"er the ntre onbleea"', phrase_sql("er", "ntre", "onbleea"))
by_sets("phrase_and_word", '"de la" & -des | "anea erin"', f"(({phrase_sql('de', 'la')}) except ({HAS.format('des')})) union ({phrase_sql('anea', 'erin')})")
by_sets("unknown_word", "zzzzqq | erin", SETS["erin"])


@query("stop_words_only", "select doc_id as seq from documents where false")
def stop_words_only(spark, sf_dir):
    return boolean.matches(pages(spark, sf_dir), compile_query("the & of")).select("seq")


SYNONYMS = {"erin": ["from", "attion thanedble"]}


@query("synonym_or", f"{WITH} select seq, not bool_or(own) is_synonym from (select seq, true own from ({SETS['erin']}) union all select seq, false from ({SETS['from']}) union all select seq, false from ({phrase_sql('attion', 'thanedbl')})) group by seq")
def synonym_or(spark, sf_dir):
    node = compile_query("erin", SYNONYMS)
    if node != Synonyms(Word("erin"), (Word("from"), Phrase(("attion", "thanedbl")))):
        raise AssertionError(node)
    return boolean.synonym_pages(posts(spark, sf_dir, boolean.leaf_terms(node)), node)


ESTIMATED = ("erin", "en | er", "en & er", '"attion thanedble"', "-en", "(en | re) & -(erin & from)")


def count_sql(term: str) -> str:
    return f"(select count(*) from posts where term = '{term}')"


@query("post_counts", f"""{WITH} select * from (values ('erin', {count_sql("erin")}), ('en | er', {count_sql("en")} + {count_sql("er")}), ('en & er', {count_sql("en")}),
    ('"attion thanedble"', {count_sql("attion")}), ('-en', (select count(*) from pg)), ('(en | re) & -(erin & from)', {count_sql("en")} + {count_sql("re")})) v(query, posts)""")
def post_counts(spark, sf_dir):
    """How many postings a query's parts have, by the rules of estimation."""
    nodes = {q: compile_query(q) for q in ESTIMATED}
    known = boolean.term_counts(dictionary_of_pages(pages(spark, sf_dir)), [t for n in nodes.values() for t in boolean.leaf_terms(n)])
    n_pages = indexable(pages(spark, sf_dir)).count()
    return spark.createDataFrame([(q, boolean.estimated_posts(n, known, n_pages)) for q, n in nodes.items()], "query string, posts long")


@query("first_match", f"{WITH} select seq, min(pos) pos from posts where term in ('en', 'er') group by seq having count(distinct term) = 2")
def first_match(spark, sf_dir):
    """A conjunction as postings: the earlier of the two terms' first places."""
    hit = posts(spark, sf_dir, ["en", "er"])
    return hit.groupBy("seq").agg(F.min("pos").alias("pos"), F.countDistinct("term").alias("n")).filter("n = 2").drop("n")


SYNSETS = ("car;automobile;auto;", "erin;from;attion thanedble;", "Running;run;")
LEMMAS = ", ".join(f"({line!r}, {i}, '{lemma.lower()}')" for line in SYNSETS for i, lemma in enumerate(line.split(";")) if lemma)


@query("synsets", f"with l(line, position, lemma) as (values {LEMMAS}), v as (select t, stem from {text.stems_duck('(select distinct lemma t from l)')}) select line as synset, position, lemma, stem from l join v on v.t = l.lemma")
def synsets(spark, sf_dir):
    """Synonym sets written as a text file and loaded: each lemma with its stem."""
    path = f"{shared_folder(spark)}/synsets-{uuid.uuid4().hex}"
    spark.createDataFrame([(x,) for x in SYNSETS], "value string").write.text(path)
    names = spark.createDataFrame([(x,) for x in SYNSETS], "synset string").withColumn("set_id", F.xxhash64("synset"))
    return read_synsets(spark, path).join(names, "set_id").select("synset", F.col("position").cast("int"), "lemma", "stem")
