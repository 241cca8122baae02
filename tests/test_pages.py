from pyspark.sql import functions as F

from gleanspark.functions import urls
from gleanspark.functions.scoring import soft_exp
from gleanspark.operators.index import BOLD, HEADING
from gleanspark.sources.html import PageParser, frontier, parse_pages
from gleanspark.streaming.ingest import ingest, known_pages


def test_page():
    p = PageParser('<html><head><title>This is a Test Title</title></head><body><h2>This is a heading</h2><p>This is a <b>bold</b> word.</p><a href="http://example.com">Example Link</a></body></html>')
    assert p.title_words == "this is a test title".split()
    assert p.words == [(w, HEADING) for w in "this is a heading".split()] + [("this", 0), ("is", 0), ("a", 0), ("bold", BOLD), ("word.", 0), ("example", 0), ("link", 0)]
    assert p.links == [("http://example.com", ["example", "link"])]
    assert p.english


def test_odd_pages():
    assert PageParser('<html lang="de">x').english is False
    assert PageParser('<html lang="en-GB">x').english is True
    assert PageParser("a<script>if (a<b) x</script>b<style>p{}</style><svg><p>q</svg>c").words == [("a", 0), ("b", 0), ("c", 0)]
    assert PageParser("a <!-- b > c --> d").words == [("a", 0), ("d", 0)]
    assert PageParser("a<script>never closed").words == [("a", 0)]
    assert PageParser("</b>x</body>y").words == [("x", BOLD), ("y", 0)]  # a stray closing tag opens; one that begins alike closes
    assert PageParser("<abcdefghijklmnopqrstuvwxyz k>z").words == [("<abcdefghijklmnopqrstuvwxyz", 0), ("k>", 0), ("z", 0)]
    assert PageParser("foo<abcdefghijklmnopqrstuvwxyz bar").words == [("foo<abcdefghijklmnopqrstuvwxyz", 0), ("bar", 0)]
    assert PageParser('<base href="http://x.org/"><embed src="m.swf"><a href="p.html">t</a>').links == [("m.swf", []), ("p.html", ["t"])]
    assert PageParser('<a title=">" href="q">z').links == [("q", ["z"])]
    for broken in ("", "<", "</", "<a", "<a href=\"", "<title", "<embed", "<b", "<!--", "<html lang=\"", "<base", "< >"):
        PageParser(broken)


def test_frontier_and_null_page(spark):
    rows = [(1, "u", '<base href="http://x.org/"><a href="p">t</a><a href="http://y.org/">t</a>'), (2, "v", '<a href="/lost">t</a>'), (3, "w", None)]
    parsed = parse_pages(spark.createDataFrame(rows, "seq long, url string, html string"))
    assert {r["url"] for r in frontier(parsed).collect()} == {"http://x.org/p", "http://y.org/"}
    assert parsed.filter("seq = 3").first()["words"] == []


def test_urls(spark):
    cases = {"http://a.gov/x.com": "gov", "https://b.c.org": "org", "c.com": "unknown", "http://d.zz/": "unknown", "http://e.com:80/": "unknown", "http://f.dev": "dev"}
    got = dict(spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.tld(F.col("u"))).collect())
    assert got == cases


def test_soft_exp(spark):
    xs = [0.0, 1.0, -1.0, -4.0, 21.0, -21.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(soft_exp(F.col("x"))).collect()]
    series = lambda x: sum(x**k / f for k, f in enumerate((1, 1, 2, 6, 24, 120, 720)))
    for g, w in zip(got, [1.0, series(1), 1 / series(1), 1 / series(4), 4.85e8, 2.06e-9], strict=True):
        assert abs(g - w) < 1e-9 * max(1, abs(w))


def test_stream_twice(spark, tmp_path):
    """A restarted ingest keeps what it knows: a URL that comes again isn't indexed again."""
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "page_id long, url string, html string"
    spark.createDataFrame([(1, "a", "<b>x"), (2, "b", "y"), (3, "a", "z"), (4, None, "n")], schema).coalesce(1).write.parquet(source)
    ingest(spark, source, out, check, once=True).awaitTermination()
    spark.createDataFrame([(5, "b", "y"), (6, "c", "w")], schema).coalesce(1).write.mode("append").parquet(source)
    ingest(spark, source, out, check, once=True).awaitTermination()
    assert sorted(r["url"] for r in known_pages(spark, out).collect()) == ["a", "b", "c"]
    assert spark.read.parquet(f"{out}/postings").count() == 3


def hashed(url):
    h = 2166136261
    for b in url.encode():
        h = (h ^ (b if b < 128 else b | 0xFFFFFF00)) * 16777619 & 0xFFFFFFFF
    f = h
    for by, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> by) * factor & 0xFFFFFFFF
    return f, h ^ h >> 16


def test_url_hash_against_single_steps(spark):
    from gleanspark.functions import urls

    texts = ["", "a", "http://x.com/ä/日本", "https://www.example.org/en/14?page=2&ref=x"]
    df = spark.createDataFrame([(t,) for t in texts], "u string")
    got = df.select("u", urls.fnv1a(F.col("u")), urls.url_hash(F.col("u"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {t: hashed(t) for t in texts}


def test_lenient_decoding(spark):
    from gleanspark.functions import urls

    cases = {"a+b%20c": "a b c", "%4g": "\x04", "%zz": "\x00", "x%4": "x4", "x%": "x", "%C3%A4": "ä", "100%+": "100 ", "": "", "%%41": "\x001"}
    df = spark.createDataFrame([(t,) for t in cases], "u string")
    assert {r[0]: r[1] for r in df.select("u", urls.leniently_decoded(F.col("u"))).collect()} == cases


def test_frontier_has_the_least_depth(spark):
    pages = spark.createDataFrame([(0, "u0", '<base href="http://s/"><a href="x">x</a><a href="http://t/y">y</a>'), (1, "u1", '<a href="http://s/x">x</a><a href="lost">z</a>')], "seq long, url string, html string")
    parsed = parse_pages(pages).withColumn("depth", F.lit(5) - 2 * F.col("seq"))
    assert {(r["url"], r["depth"]) for r in frontier(parsed).collect()} == {("http://s/x", 4), ("http://t/y", 6)}
    assert {r["depth"] for r in frontier(parsed.drop("depth")).collect()} == {1}


def test_batches_begin_new_chunks(spark, tmp_path):
    """Batches of seven and three pages in chunks of at most four; a batch written again replaces itself."""
    from gleanspark.streaming.ingest import known_pages, totals, write_batch

    html = "<title>t</title>word word"
    batches = [spark.createDataFrame([(i, f"u{i}", html) for i in ids], "page_id long, url string, html string") for ids in (range(7), range(7, 10))]
    out = str(tmp_path)
    for _ in range(2):
        for n, b in enumerate(batches):
            write_batch(b, n, out, 4)
    assert tuple(totals(spark, out).first()) == (10, 10, 10, 3)
    docs = known_pages(spark, out)
    assert sorted((r["chunk_id"], r["n"], r["a"]) for r in docs.groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("start").alias("a")).collect()) == [(0, 4, 1), (1, 3, 1), (2, 3, 1)]
