import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanspark.functions import text
from gleanspark.functions.stemming import _FOURTH, _SECOND, _THIRD, stem_token
from gleanspark.operators import analysis, boolean, index
from gleanspark.plans.query import compile_query
from gleanspark.sources.html import parse_pages

ODD = [
    None, "", " \t\r\n", "one", "seam", "Xa\x0bb c\x0cd  e", "the The THE, running Runs' 'ran 's' '' ''' (of) été ÉTÉ 日本", "en er. \"from\" erin's 'er 'erin' er's' entry enables",
    "bilities bilities' ability potatoes mice, children) analysis", "a.b ...... en....", "x" * 5000 + " er " + "y" * 5000, "er " * 50, "thebeing theses these) those] information", "er",
]


def batch(texts):
    n = len(texts)
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts, pa.string()), pa.array([True] * n)], names=["seq", "text", "english"])


def by_hand(texts):
    """(page, field, stem, pos, first) by single steps."""
    out = []
    for page, t in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\r\n" else c for c in t or "")
        words = [w for w in low.split(" ") if w]
        stems = [("title", s) for w in words[:6] if (s := stem_token(w))] + [("body", s) for w in words if (s := stem_token(w))]
        out += [(page, f, s, i + 1, stems.index((f, s)) == i) for i, (f, s) in enumerate(stems)]
    return out


def rows(s, stems):
    return list(zip(s.page.tolist(), ["body" if b else "title" for b in s.body], [stems[i] for i in s.term], s.pos.tolist(), s.first().tolist(), strict=True))


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_texts_by_single_steps(monkeypatch, most):
    """Nulls, blanks and texts that lie side by side, in slices of any size; all terms, and wanted ones alone."""
    monkeypatch.setitem(analysis.SLICE_BYTES, "text", most)
    for wanted in (None, ["er", "en", "from", "erin", "mous", "ble", "a", "été", "abiliti"]):
        known = analysis.Vocabulary(wanted)
        got, at = [], 0
        for s in analysis.slices("text", iter([batch(ODD)]), known):
            here = s if wanted is None else s.only()
            got += [(at + p, *rest) for p, *rest in rows(here, known.stems)]
            at += s.batch.num_rows
        assert got == [r for r in by_hand(ODD) if wanted is None or r[2] in wanted]


def test_wanted_terms_lose_no_token():
    """What isn't stemmed can't have a wanted stem, and an empty one neither: over ends of all rules, quotes, capitals and letters of several bytes."""
    r = random.Random(3)
    ends = [x for t in (_SECOND, _THIRD, _FOURTH) for x, _ in t] + "ed edly ing ingly eed eedly s sses ies ied us y Y e l ll er est 's 's' ' at bl iz bb é . )".split()
    words = ["".join(r.choices("abcdeilnosuyé'tY", k=r.randint(0, 5))) + "".join(r.choices(ends, k=r.randint(0, 3))) for _ in range(60_000)]
    words = [w for w in words if w]
    stems = [stem_token(w) for w in words]
    wanted = r.sample(sorted({s for s in stems if s}), 300) + ["ble", "b", "by", "éi"]
    known = analysis.Vocabulary(wanted)
    number = {t: known.numbers[t] for t in wanted}
    assert [w for w, s in zip(words, stems, strict=True) if known[w.encode()] != (number.get(s, 1) if s else 0)] == []


def test_a_worker_forgets(monkeypatch):
    """Distinct words without end: what a worker remembers stays bounded, and the sums are whole."""
    monkeypatch.setattr(analysis, "MOST_KNOWN", 500)
    monkeypatch.setitem(analysis.SLICE_BYTES, "text", 4000)
    texts = [" ".join(f"w{(7 * i + k) % 5003}q" for k in range(40)) for i in range(900)]
    known, most, sums, total = analysis.Vocabulary(), 0, analysis._Sums(), {}

    def add():
        for b in sums.taken(known):
            for f, t, n, d, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                old = total.get((f, t), (0, 0, 0))
                total[f, t] = (old[0] + n, old[1] + d, max(old[2], p))

    for s in analysis.slices("text", iter([batch(texts)]), known):
        sums.add(s, len(known.stems))
        most = max(most, len(known), len(known.stems))
        if known.full:
            add()
            known.forget()
    add()
    assert most < 500 + 4000
    want = {}
    for _, f, t, p, first in by_hand(texts):
        n, d, last = want.get((f, t), (0, 0, 0))
        want[f, t] = (n + 1, d + first, max(last, p))
    assert total == want


def test_three_forms_of_pages_agree(spark):
    htmls = ["<title>Er one</title><h2>En</h2> er <b>from</b> the er", None, "<title>" + "t " * 40 + "</title>er", "<p>erin " * 90]
    raw = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(htmls)], "seq long, url string, html string")
    parsed = parse_pages(raw)
    for f in (index.postings, index.located_postings, index.dictionary_of_pages, index.documents, lambda p: boolean.matches(p, compile_query("er -erin")), lambda p: boolean.matches(p, compile_query("-en"))):
        got = sorted(map(repr, f(raw).collect()))
        assert got == sorted(map(repr, f(parsed).collect())) and got
    plain = spark.createDataFrame([(i, f"u{i}", t, True) for i, t in enumerate(ODD)], "seq long, url string, text string, english boolean")
    words = plain.withColumn("t", text.tokens(F.col("text"))).selectExpr("seq", "url", "slice(t, 1, 6) title_words", "transform(t, w -> struct(w as word, cast(0 as tinyint) as flags)) words", "english")
    for f in (index.postings, index.located_postings, index.dictionary_of_pages, index.documents, lambda p: boolean.matches(p, compile_query("-er"))):
        got = sorted(map(repr, f(plain).collect()))
        assert got == sorted(map(repr, f(words).collect())) and got


def test_terms_are_found_in_one_python_step(spark, sf_dir):
    """A page's text goes to Python once, and neither its words nor its stems come back."""
    from gleanspark.catalog import QUERIES

    for name in ("nested_bool_one_pass", "dictionary", "marked_terms", "stem_frequency", "chunk_topk", "span_counts_web", "rarest_term"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan and "lambdafunction(regexp" not in plan, name


def test_postings_come_in_sorted_runs():
    known = analysis.Vocabulary()
    (s,) = analysis.slices("text", iter([batch(ODD)]), known)
    order = known.order(s.term)
    assert [(known.stems[t], r, p) for t, r, p in zip(s.term[order], s.page[order], s.pos[order], strict=True)] == sorted((t, r, p) for r, _, t, p, _ in by_hand(ODD))


def test_counted_tokens(spark):
    got = {r["t"]: (r["stem"], r["n"]) for r in analysis.counted_tokens(spark.createDataFrame([(t,) for t in ODD], "text string")).groupBy("t", "stem").agg(F.sum("n").alias("n")).collect()}
    assert got["er"] == ("er", 52) and got["the"] == ("", 2) and sum(n for _, n in got.values()) == sum(len(analysis.cut_text(t.encode() if t else None)) for t in ODD)
    assert np.all([stem_token(t) == s for t, (s, _) in got.items()])
