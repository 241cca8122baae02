from pyspark.sql import functions as F

from gleanspark.operators import boolean, index, ranking, results
from gleanspark.plans.query import compile_query
from gleanspark.search import search, search_pages
from gleanspark.sources.store import build_index, read_index, write_index
from gleanspark.sources.synsets import read_synsets, synonyms_of

PAGES = [
    (0, "http://test1.com", ["alpha", "test"], [("this", 0), ("is", 1), ("a", 2), ("test", 3), ("alpha", 4), ("document", 7)], True),
    (1, "http://test2.com", ["another", "test"], [("alpha", 0), ("test", 1), ("again", 2), ("document", 5)], True),
]


def frame(spark, rows):
    return spark.createDataFrame([(s, u, t, [{"word": w, "flags": f} for w, f in ws], e) for s, u, t, ws, e in rows], index.PAGE)


def test_two_documents(spark):
    pages = frame(spark, PAGES)
    docs = {r["seq"]: r for r in index.documents(pages).collect()}
    assert [(docs[i]["start"], docs[i]["end"], docs[i]["word_count"], docs[i]["title_length"], docs[i]["url_length"]) for i in (0, 1)] == [(1, 10, 8, 2, 16), (11, 18, 6, 2, 16)]
    located = index.located(index.postings(pages), index.documents(pages))
    got = sorted((r["location"], ("@" if r["field"] == "title" else "") + r["term"], r["flags"]) for r in located.collect())
    assert got == [
        (1, "@alpha", 0), (2, "@test", 0), (3, "test", 3), (4, "alpha", 4), (5, "document", 7),
        (11, "@anoth", 0), (12, "@test", 0), (13, "alpha", 0), (14, "test", 1), (15, "again", 2), (16, "document", 5),
    ]
    stats = index.statistics(index.postings(pages), index.documents(pages)).first()
    assert (stats["documents"], stats["locations"], stats["max_location"]) == (2, 13, 18)
    assert index.first_at_or_after(located, "test", 3).first()["location"] == 3
    assert index.document_at(index.documents(pages), 10).first()["seq"] == 0


def test_long_titles_and_empty_pages(spark):
    pages = frame(spark, [(0, "u0", ["w"] * 40, [("x", 0)], True), (1, "u1", ["w"] * 39, [], True), (2, "u2", [], [], True)])
    assert {r["seq"] for r in index.documents(pages).collect()} == {1, 2}
    assert index.postings(pages).count() == 39
    assert index.documents(frame(spark, [])).count() == 0


def corpus(spark):
    rows = []
    words = "apple banana cherry date elder fig grape".split()
    for i in range(60):
        body = [words[(i * k + k * k + i // 7) % len(words)] for k in range(3 + i % 9)]
        rows.append((i, f"http://site{i % 20}.com/{i}", [words[i % 7]], [(w, i % 4) for w in body], True))
    return frame(spark, rows), rows


def brute(rows, query):
    from gleanspark.plans.query import And, Not, Or, Phrase, Word
    from gleanspark.functions.stemming import stem_token

    def holds(n, fields):
        if isinstance(n, Word):
            return any(n.stem in f for f in fields)
        if isinstance(n, Phrase):
            k = len(n.stems)
            return any(tuple(f[i : i + k]) == n.stems for f in fields for i in range(len(f)))
        if isinstance(n, Not):
            return not holds(n.node, fields)
        a, b = holds(n.left, fields), holds(n.right, fields)
        return a and b if isinstance(n, And) else a or b

    node = compile_query(query)
    return {r[0] for r in rows if holds(node, [[stem_token(w) for w in r[2]], [stem_token(w) for w, _ in r[3]]])}


def test_boolean_against_brute_force(spark):
    pages, rows = corpus(spark)
    posts = index.postings(pages).persist()
    for query in ("apple", "apple & cherry", "apple | date", "apple -cherry", "-apple", '"apple banana"', '"apple banana cherry" | fig', "-(apple | fig) & (date | elder)", "zzz", '-"apple fig" grape'):
        want = brute(rows, query)
        node = compile_query(query)
        assert {r["seq"] for r in boolean.evaluate(posts, pages.select("seq"), node).collect()} == want, query
        assert {r["seq"] for r in boolean.matches(pages, node).collect()} == want, query


def test_index_and_pages_rank_alike(spark, tmp_path):
    pages, rows = corpus(spark)
    write_index(build_index(pages, 25), str(tmp_path / "index"))
    i = read_index(spark, str(tmp_path / "index"))
    assert i.docs.select("chunk_id").distinct().count() == 3
    for query in ("apple cherry", "apple | fig", "-apple", '"apple banana"'):
        a = [tuple(r) for r in search(i, query).collect()]
        b = [tuple(r) for r in search_pages(pages, query).collect()]
        assert a == b, query
        assert len({u for _, u, _, _ in a}) == len(a) <= 10
        assert [s for *_, s in a] == sorted((s for *_, s in a), reverse=True)
    assert search(i, "the of").count() == 0


def test_synonym_fallback(spark, tmp_path):
    (tmp_path / "synsets.txt").write_text("car;automobile;auto;\nfig;common fig;figs;\n")
    synsets = read_synsets(spark, str(tmp_path / "synsets.txt"))
    table = synonyms_of(synsets, ["car", "fig"])
    assert table == {"car": ["auto", "automobile"], "fig": ["common fig"]}
    pages = frame(spark, [(0, "http://a.org/0", ["auto"], [("auto", 0), ("show", 0)], True), (1, "http://a.org/1", ["car"], [("car", 0)], True), (2, "http://a.org/2", ["tree"], [("tree", 0)], True)])
    r = {x["seq"]: x for x in ranking.rank_pages(pages, compile_query("car", table)).select("seq", "dynamic").collect()}
    assert set(r) == {0, 1} and r[1]["dynamic"] > r[0]["dynamic"]


def test_merge_and_html(spark):
    lists = [spark.createDataFrame(x, "seq long, url string, title string, score double") for x in ([(1, "a", "A<b>", 0.95), (2, "b", "B", 0.9)], [(3, "a", "A2", 0.97), (4, "c", "C", 0.89)])]
    m = results.merged(lists)
    assert [r["url"] for r in m.collect()] == ["a", "b", "c"]
    assert results.as_html(m).first()["html"] == '<ul><li><a href="a">A2</a></li><li><a href="b">B</a></li><li><a href="c">C</a></li></ul>'
    assert "&lt;b&gt;" in results.as_html(lists[0]).first()["html"]
    chunks = lists[0].withColumn("chunk_id", F.lit(0))
    assert [r["rank"] for r in results.chunk_top_k(chunks, 1).collect()] == [1]


def test_only_some_terms_and_located_postings(spark):
    pages, _ = corpus(spark)
    all_ = index.postings(pages)
    only = index.postings(pages, only=["appl", "fig"])
    assert sorted(map(repr, only.collect())) == sorted(map(repr, all_.filter("term in ('appl', 'fig')").collect())) and only.count()
    assert index.postings(pages, only=[]).count() == 0
    located = index.located(all_, index.documents(pages))
    assert sorted(map(repr, index.located_postings(pages).collect())) == sorted(map(repr, located.collect()))


def test_exclusion_leaves_out_unindexed_pages(spark):
    pages = frame(spark, [(0, "u0", ["w"] * 40, [("x", 0)], True), (1, "u1", ["w"], [("x", 0)], True), (2, "u2", ["w"], [("zebra", 0)], True)])
    node = compile_query("-zebra")
    sets = boolean.evaluate(index.postings(pages), index.indexable(pages).select("seq"), node)
    assert {r[0] for r in sets.collect()} == {r[0] for r in boolean.matches(pages, node).collect()} == {1}


def test_which_queries_need_a_term():
    needs = {"a1": True, "-a1": False, "a1 -b1": True, "-a1 -b1": False, "a1 | -b1": False, "-(a1 | -b1)": True, '"a1 b1"': True, "-(-a1)": True}
    assert {q: boolean.needs_a_term(compile_query(q)) for q in needs} == needs


def test_estimates():
    counts = {"a1": 5, "b1": 7}
    want = {"a1": 5, "zz": 0, "a1 | b1": 12, "b1 & a1": 7, '"a1 b1"': 5, "-a1": 100, "a1 -b1": 5}
    assert {q: boolean.estimated_posts(compile_query(q), counts, 100) for q in want} == want
    assert boolean.estimated_posts(None, counts, 100) == 0


def test_the_best_of_a_url(spark):
    rows = [(1, "a", 0.5), (2, "a", 0.9), (3, "a", 0.9), (4, "b", None), (5, "b", 0.1), (6, None, 0.3)]
    got = results.one_a_url(spark.createDataFrame(rows, "seq long, url string, score double")).collect()
    assert sorted((r["url"] or "", r["seq"]) for r in got) == [("", 6), ("a", 2), ("b", 5)]


def test_dictionary_of_pages(spark):
    pages, _ = corpus(spark)
    want = index.dictionary(index.postings(pages)).select("field", "term", "post_count", "doc_freq", "last_pos")
    assert sorted(map(tuple, index.dictionary_of_pages(pages).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert index.dictionary_of_pages(frame(spark, [])).count() == 0
