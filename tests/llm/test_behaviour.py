"""Every operator against brute force, its SQL, an exact round trip or held-out accuracy."""

import json
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleanspark.llm import ann, chat, decontam, langid, line_dedup, ngram_join, packing, quality, secrets, substring
from gleanspark.llm.ann import Tables, ann_search, at_buckets, hadamard, reach
from gleanspark.llm.queries import ORACLES, QUERIES

WORDS = [f"{a}{b}{c}" for a in "bdfklmnprst" for b in "aeiou" for c in ("n", "r", "st", "l")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def words_of(text):
    out = [re.sub(r"^[\W_]+|[\W_]+$", "", w).lower() for w in (text or "").split()]
    return [w for w in out if w]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    cur = con.execute(ORACLES[name])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(at) == names
    want = Counter(tuple(repr(r[at[c]]) for c in names) for r in cur.fetchall())
    assert Counter(tuple(repr(r[c]) for c in names) for r in df.collect()) == want


def brute_classes(sets, t):
    """{document: (smallest of its class, links)} by comparing all."""
    n = len(sets)
    near = [[i != j and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9 for j in range(n)] for i in range(n)]
    least = list(range(n))
    while True:
        new = [min([least[i], *(least[j] for j in range(n) if near[i][j])]) for i in range(n)]
        if new == least:
            return {i: (least[i], sum(near[i])) for i in range(n)}
        least = new


def classes_of(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in df.collect()}


def test_decontamination_finds_other_values(spark):
    rng = random.Random(1)
    item = "A shop of {} sells {} boxes of apples for {} dollars each so what does it earn when all of them are sold by noon"
    items = [(0, item.format("Anna", 12, 7)), (1, sentence(rng, 30)), (2, sentence(rng, 25) + ".")]
    docs = [
        item.format("Anna", 12, 7),
        sentence(rng, 50) + ". " + item.format("Peter", 31, 9) + ". " + sentence(rng, 50),
        sentence(rng, 200),
        items[1][1].upper() + " " + sentence(rng, 5),
        sentence(rng, 20) + " " + items[2][1] + " " + sentence(rng, 20),
        " ".join(items[1][1].split()[:9]) + " " + sentence(rng, 60),
    ]
    got = {(r["doc_id"], r["item_id"]): r["same_values"] for r in decontam.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(0, 0): True, (1, 0): False, (3, 1): True, (4, 2): True}


def test_decontamination_checks_slots(spark):
    """One value of the item must have become one value: 5 became both 6 and 8."""
    item = "take exactly 5 small stones and put another 5 small stones beside the first heap near the old wall then count"
    bad = item.replace("5", "6", 1).replace("another 5", "another 8")
    good = item.replace("5", "6")
    r = decontam.decontaminate(frame(spark, [bad, good]), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(x["doc_id"], x["same_values"]) for x in r] == [(1, False)]


def test_decontamination_finds_verbatim_items_of_few_literals(spark):
    rng = random.Random(4)
    items = ["What is 12 plus 34", "Compute 12 + 34 * 5 - 7 / 2", "Berechne wie Anna Berta Carla und Doris Emil Franz 3 Kilo 4 Gramm 5 Liter teilen"]
    docs = [f"{sentence(rng, 20)}. {t}? {sentence(rng, 20)}" for t in items] + [f"{sentence(rng, 20)}. What is 13 plus 34? {sentence(rng, 20)}", items[2].upper()]
    r = decontam.decontaminate(frame(spark, docs), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(0, 0, True), (1, 1, True), (2, 2, True), (3, 0, False), (4, 2, True)} == {(x["doc_id"], x["item_id"], x["same_values"]) for x in r}


def test_decontamination_takes_names_that_begin_sentences(spark):
    rng = random.Random(6)
    item = "{0} has 5 apples. {0} buys 3 more. {0} gives 2 to Ann. How many does {0} have"
    lower = item.format("Tom").replace("5", "8").lower()
    docs = [f"{sentence(rng, 20)}. {t}? {sentence(rng, 20)}" for t in (item.format("Bob"), lower, item.format("Tom").upper())] + [sentence(rng, 60)]
    r = decontam.decontaminate(frame(spark, docs), spark.createDataFrame([(7, item.format("Tom"))], "item_id long, text string")).collect()
    assert {x["doc_id"]: x["same_values"] for x in r} == {0: False, 1: False, 2: True}


def test_decontamination_judges_each_alignment(spark):
    """A part with one set of values before a whole copy with another, and a template twice in an item, hide nothing."""
    rng = random.Random(3)
    item = "a farmer has {} brown cows in the barn near the river and buys {} young goats from the market on monday so how many animals live there"
    twice = "put {} red stones into the small box now then wait and put {} red stones into the small box now before you finally count what is in there"
    part = " ".join(item.format(31, 44).split()[:16])
    docs = [part + " " + sentence(rng, 30) + " " + item.format(5, 8) + " " + sentence(rng, 9), sentence(rng, 9) + " " + twice.format(6, 9), part + " " + sentence(rng, 30)]
    items = spark.createDataFrame([(0, item.format(12, 7)), (1, twice.format(3, 4))], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["same_values"]) for r in decontam.decontaminate(frame(spark, docs), items).collect()} == {(0, 0, False), (1, 1, False)}


def test_decontamination_of_short_items(spark):
    """Items of 4 to 12 tokens, as they stand and with other values; those of fewer are listed."""
    rng = random.Random(13)
    forms = ["add {} to {}", "what is {} plus {}", "compute first {} then {} and {}", "how many eggs are {} dozen eggs", "a pen costs {} coins what do {} pens cost"]
    forms += ["take {} from {} and then take {} from what is left over", "share {} sweets among {} friends so that each gets as many as possible"]
    items = [f.format(7, 12, 3) for f in forms] + ["add 3", "", None]
    docs = [f"{sentence(rng, 20)}. {f.format(*v)}. {sentence(rng, 20)}" for v in ((7, 12, 3), (21, 40, 9)) for f in forms] + [sentence(rng, 60)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    r = decontam.decontaminate(frame(spark, docs), bench).collect()
    want = {(i, i % len(forms), i < len(forms)) for i in range(2 * len(forms))}
    assert {(x["doc_id"], x["item_id"], x["same_values"]) for x in r} == want
    assert sorted(x["item_id"] for x in decontam.unsearchable(bench).collect()) == [7, 8, 9]


def test_decontamination_widens_windows_of_few_literals(spark):
    """No 8 tokens hold five literals; 16 do."""
    rng = random.Random(14)
    item = "sum {} and {} and {} now {} or {} times {} plus {} less {} is {} over {} times {} so"
    bench = spark.createDataFrame([(1, item.format(*range(10, 21)))], "item_id long, text string")
    docs = [sentence(rng, 9) + ". " + item.format(*range(40, 51)) + ". " + sentence(rng, 9), sentence(rng, 40)]
    assert [(x["doc_id"], x["same_values"]) for x in decontam.decontaminate(frame(spark, docs), bench).collect()] == [(0, False)]


def test_decontamination_tells_texts_of_one_item_apart(spark):
    rng = random.Random(15)
    one, two = sentence(rng, 30), sentence(rng, 60)
    bench = spark.createDataFrame([(1, one), (1, two), (1, two)], "item_id long, text string")
    r = decontam.decontaminate(frame(spark, [one, two, one, sentence(rng, 60)]), bench).collect()
    assert sorted((x["doc_id"], x["item_id"], x["matched"], x["coverage"]) for x in r) == [(0, 1, 23, 1.0), (1, 1, 53, 1.0), (2, 1, 23, 1.0)]


def plain_template(text):
    """Tokens of a text in lower case: (template, word, slot), by single steps; the texts of this test have no signs within sentences."""
    out, ended = [], True
    for line in re.split(r"(\n)", text):
        if line == "\n":
            ended = True
            continue
        for raw in line.split():
            core = re.sub(r"^[\W_]+|[\W_]+$", "", raw)
            number = re.fullmatch(decontam.NUMBER, core.lower())
            unit = core.lower() in decontam.UNITS and out and out[-1][0] == "N"
            name = not number and not unit and re.fullmatch(r"[A-Z][a-z]+", core) and not ended
            if name and out and out[-1][0] == "P":
                out[-1] = ("P", out[-1][1] + (core.lower(),), True)
            else:
                out.append(("N" if number else "U" if unit else "P" if name else core.lower(), (core.lower(),), bool(number or unit or name)))
            ended = bool(re.search(r"[.!?:]$", raw))
    return out


def test_decontamination_against_brute_force(spark):
    """Windows of kind TYPED in plain loops, where each document holds a part or the whole of an item, in one place."""
    rng = random.Random(16)
    names = ["Anna", "Bert", "Carla", "Dora"]
    items, docs = [], []
    for _ in range(8):
        w = sentence(rng, 24).split()
        for at in rng.sample(range(1, 23), 5):
            w[at] = "{}"
        kinds = [rng.choice(("n", "p")) for _ in range(5)]
        fill = lambda: [str(rng.randint(2, 99)) if k == "n" else rng.choice(names) for k in kinds]  # noqa: E731, B023
        items.append(" ".join(w).format(*fill()))
        docs += [sentence(rng, 7) + ". " + " ".join(" ".join(w).format(*fill()).split()[: rng.choice((12, 17, 20, 24))]) + ". " + sentence(rng, 7) for _ in range(6)]
    windows = lambda t: {i: t[i : i + 8] for i in range(len(t) - 7) if sum(not s for _, _, s in t[i : i + 8]) >= 5}
    want = set()
    for d, doc in enumerate(docs):
        theirs = windows(plain_template(doc))
        for i, item in enumerate(items):
            own = windows(plain_template(item))
            hits = [(a, b) for a, x in own.items() for b, y in theirs.items() if [t for t, *_ in x] == [t for t, *_ in y]]
            value = defaultdict(set)
            for a, b in hits:
                for x, y in zip(own[a], theirs[b], strict=True):
                    if x[2]:
                        value[x[1]].add(y[1])
            if own and len({a for a, _ in hits}) >= 0.6 * len(own) and all(len(v) == 1 for v in value.values()):
                want.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.decontaminate(frame(spark, docs), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert want and want <= got
    # what else is found has every word of an item but its slots, in a kind with fewer slots or as it stands
    assert all(i == d // 6 for d, i in got)


def test_ngram_join_against_brute_force(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(25):
        base = sentence(rng, rng.randint(20, 120)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    texts += ["tiny", "tiny", "two words", "Two  words!"]
    rng.shuffle(texts)
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)})
    assert classes_of(ngram_join.ngram_jaccard_join(frame(spark, texts))) == brute_classes(sets, ngram_join.THRESHOLD)


def test_ngram_join_finds_much_edited_copies(spark):
    """Six of 60 words changed, none near another: 40 of 76 grams are shared, 0.526."""
    rng = random.Random(12)
    texts = []
    for _ in range(40):
        base = rng.sample(WORDS, 66)
        texts += [" ".join(base[:60]), " ".join(base[60 + i // 10] if i % 10 == 5 else w for i, w in enumerate(base[:60]))]
    assert classes_of(ngram_join.ngram_jaccard_join(frame(spark, texts))) == {i: (i - i % 2, 1) for i in range(80)}


@pytest.mark.parametrize("case", ["large families", "large buckets", "trees"])
def test_ngram_join_of_many_near_copies(spark, monkeypatch, case):
    """Families of several leaves, buckets too large for a tree and buckets searched by one: links and classes are the same."""
    rng = random.Random(21)
    if case == "large families":
        monkeypatch.setattr(ngram_join, "LEAF_DOCS", 7)
    monkeypatch.setattr(ngram_join, "BUCKET_DOCS", 5 if case == "large buckets" else 2000)
    monkeypatch.setattr(ngram_join, "PLAIN_DOCS", 2 if case == "trees" else 24)
    texts = []
    for length in (30, 90, 200):
        base = sentence(rng, length).split()
        for i in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w[: length - i] if i % 3 else w))
    texts += texts[:9]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(words_of, texts)]
    assert classes_of(ngram_join.ngram_jaccard_join(frame(spark, texts))) == brute_classes(sets, ngram_join.THRESHOLD)


@pytest.mark.parametrize("threshold", [0.4, 0.5, 0.6, 0.8])
def test_routing_recall(threshold):
    """Of pairs at a threshold, so many share a band as the formula says: all but (1 - t^3)^64."""
    rng = np.random.default_rng(int(threshold * 10))
    n, missed, pairs = 120, 0, 3000
    shared = int(np.ceil(2 * n * threshold / (1 + threshold)))
    for _ in range(pairs // 100):
        sets = []
        for _ in range(100):
            common = rng.integers(0, 1 << 63, shared, dtype=np.uint64)
            sets += [np.concatenate([common, rng.integers(0, 1 << 63, n - shared, dtype=np.uint64)]) for _ in range(2)]
        b = ngram_join.bands(np.concatenate(sets), np.arange(200) * n)
        missed += int((b[::2] != b[1::2]).all(1).sum())
    expected = pairs * (1 - threshold**3) ** ngram_join.BANDS
    assert missed <= expected + 4 * np.sqrt(expected) + 1


def test_bound_and_forest_lose_none():
    """Any two sets within the threshold are connected by a bucket's forest, whatever the lengths of their points."""
    rng = np.random.default_rng(5)
    sets = []
    for size in (20, 70, 130, 500, 900, 5000):
        base = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for keep in (1.0, 0.9, 0.75, 0.62):
            sets.append(np.sort(np.concatenate([base[: int(len(base) * keep)], rng.integers(0, 1 << 63, int(size * 0.1), dtype=np.uint64)])))
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    n_grams, raw = np.diff(offsets), ngram_join.points(np.concatenate(sets), offsets)
    for plain in (100, 1):
        ngram_join.PLAIN_DOCS, before = plain, ngram_join.PLAIN_DOCS
        u, v = ngram_join.bucket_forest(np.array([0]), np.array([len(sets)]), n_grams, raw, 0.5)
        ngram_join.PLAIN_DOCS = before
        label = ngram_join._labels(len(sets), u, v)
        assert len(u) < len(sets)
        for i in range(len(sets)):
            for j in range(i):
                shared = len(np.intersect1d(sets[i], sets[j]))
                if shared >= 0.5 * (len(sets[i]) + len(sets[j]) - shared):
                    assert label[i] == label[j]
        assert len(set(label)) > 3


def test_tree_loses_none():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 6, (700, ngram_join.GROUPS)).astype(np.int32)
    points[350:] = np.maximum(0, points[:350] + rng.integers(-1, 2, (350, ngram_join.GROUPS)) * (rng.random((350, ngram_join.GROUPS)) < 0.1))
    tree = ngram_join.CountTree(points)
    for i in range(0, 700, 35):
        overlap = np.minimum(points, points[i]).sum(1)
        want = np.flatnonzero(overlap * 1.8 >= 0.8 * (points[i].sum() + points.sum(1)) - 1e-9)
        assert set(tree.search(points[i], 0.8)) == set(want)


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(4)
    lines = [sentence(rng, 3) for _ in range(30)] + ["", "  "]
    texts = ["\n".join(rng.choice(lines) if rng.random() < 0.7 else rng.choice(lines).upper() + "  " for _ in range(rng.randint(1, 8))) for _ in range(60)]
    norm = lambda x: re.sub("[ \t\r]+", " ", x).strip(" ").lower()
    holders = defaultdict(set)
    for i, t in enumerate(texts):
        for x in t.split("\n"):
            holders[norm(x)].add(i)
    for keep in (False, True):
        want = {i: "\n".join(x for x in t.split("\n") if not norm(x) or len(holders[norm(x)]) <= 5 or (keep and min(holders[norm(x)]) == i)) for i, t in enumerate(texts)}
        assert dict(line_dedup.line_dedup(frame(spark, texts), max_docs=5, keep_first=keep).collect()) == want


def test_secret_scan_against_full_search(spark):
    rng = random.Random(5)
    secret = ["AKIA" + "A" * 16, "ghp_" + "a1" * 18, "password = hunter22", "4111 1111 1111 1111", "-----BEGIN RSA PRIVATE KEY-----", "sk_live_" + "a" * 20, 'api_key="' + "z" * 20 + '"']
    texts = [sentence(rng, 30) + " " + (" ".join(rng.sample(secret, rng.randint(0, 3)))) + " " + sentence(rng, 3) for _ in range(60)] + ["AKI" + "A" * 17, "é" * 50]
    want = {(i, r.name): [m.span() for m in re.finditer(r.pattern.encode(), t.encode())] for i, t in enumerate(texts) for r in secrets.RULES}
    got = {(r["doc_id"], r["rule"]): list(zip(r["starts"], r["ends"], strict=True)) for r in secrets.secret_scan(frame(spark, texts)).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_trigram_queries():
    q = secrets.trigram_query(r"ab(?:cd|xy)e+[0-9]")
    assert secrets.trigrams_in(q) == {b"abc", b"bcd", b"abx", b"bxy"}
    assert secrets.trigram_query(r"[a-z]+\d") is True


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet").filter("quality is not null")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    r = quality.quality_scores(docs, labels.filter(~held)).join(labels.filter(held), "doc_id").toPandas()
    assert len(r) > 80 and (r.keep == (r.quality == 1)).mean() > 0.95
    p = np.clip(r.p_good, 1e-6, 1 - 1e-6)
    assert -(np.log(np.where(r.quality == 1, p, 1 - p))).mean() < 0.25


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars > 300")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = langid.train(*langid.training_sample(docs.filter(~held)))
    rows = docs.filter(held).select("doc_id", "lang", "text").toPandas()
    rng = random.Random(6)
    mixed, truth = [], []
    for i in range(80):
        parts = rows.sample(3, random_state=i)
        pieces = [(x.lang, words_of(x.text)[: rng.randint(5, 25)]) for x in parts.itertuples()]
        mixed.append(" ".join(" ".join(w) for _, w in pieces))
        truth.append([lang for lang, w in pieces for _ in w])
    got = {r["doc_id"]: r for r in langid.identify(frame(spark, mixed), model).collect()}
    right = total = 0
    for i, want in enumerate(truth):
        labels = [s["lang"] for s in got[i]["spans"] for _ in range(s["start"], s["end"])]
        assert len(labels) == len(want) == got[i]["n_words"]
        right, total = right + sum(a == b for a, b in zip(labels, want, strict=True)), total + len(want)
    assert right / total > 0.9
    whole = langid.identify(docs.filter(held), model).join(docs.select("doc_id", F.col("lang").alias("want")), "doc_id").toPandas()
    assert (whole.lang == whole.want).mean() > 0.97


def test_forward_backward_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(7)
    emit, start, trans = rng.normal(size=(4, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    want = np.zeros((4, 3))
    for path in product(range(3), repeat=4):
        w = np.exp(start[path[0]] + sum(emit[i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        for i, y in enumerate(path):
            want[i, y] += w
    order, active = langid.time_major(np.array([0, 4]))
    got = langid.forward_backward(emit[order], active, start, trans)
    assert np.allclose(got, want / want.sum(1, keepdims=True))


def plain_features(word):
    """Feature numbers of a word, one at a time."""
    b = b"^" + word.encode() + b"$"
    number = lambda bits, kind: int(langid.mix64(np.array([int.from_bytes(bits, "big") * 64 + kind], np.uint64))[0]) & ((1 << langid.FEATURE_BITS) - 1)
    out = [number(b[i : i + n], n) for n in (2, 3) for i in range(len(b) - n + 1)]
    return out + [number(x, k + n) for n in (1, 2, 3, 4) if len(b) >= n + 2 for x, k in ((b[1 : 1 + n], 8), (b[-1 - n : -1], 16))]


def test_language_features_against_single_steps():
    """Emissions of words of all lengths: long compounds and sentences without blanks are read to their ends."""
    import pyarrow as pa

    rng = np.random.default_rng(11)
    stem = "donaudampfschifffahrtsgesellschaft"
    vocab = ["a", "ab", "the", "für", stem + "heit", stem + "tion", "これは空白のない長い文で、終わりまで読まれる" * 5, "これは空白のない長い文で、終わりまで読まれない" * 5]
    model = langid.Field(["x", "y"], rng.normal(size=(1 << langid.FEATURE_BITS, 2)), np.empty(0, np.uint64), np.zeros((0, 2)), np.zeros(2), np.zeros((2, 2)))
    got = model.scores(pa.array(vocab), np.zeros(len(vocab), np.uint64))
    want = [model.weights[plain_features(w)].sum(0) / np.sqrt(len(w.encode()) + 2) for w in vocab]
    assert np.allclose(got, want)
    assert not np.allclose(got[4], got[5])
    langid.PART_BYTES, before = 10, langid.PART_BYTES
    assert np.allclose(model.scores(pa.array(vocab), np.zeros(len(vocab), np.uint64)), want)
    langid.PART_BYTES = before


def test_language_training_reads_whole_texts(spark):
    """What tells the languages apart stands behind 60,000 words that are alike."""
    head = " ".join(["same"] * 60_000)
    rows = [(i, head + " " + " ".join([("wort" if i % 2 else "mot") + "abcdefgh"[j % 8] for j in range(9000)]), "de" if i % 2 else "fr") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = langid.training_sample(docs)
    assert len(texts) == 10_000 and any("wort" in t for t in texts)
    got = {r["doc_id"]: r["lang"] for r in langid.identify(spark.createDataFrame([(0, "mota motb motc"), (1, "worta wortb wortc"), (2, "")], "doc_id long, text string"), langid.train(texts, langs)).collect()}
    assert got == {0: "fr", 1: "de", 2: None}


def test_language_ties_go_to_the_first_label():
    import pyarrow as pa

    model = langid.Field(["a", "b"], np.zeros((1 << langid.FEATURE_BITS, 2)), np.empty(0, np.uint64), np.zeros((0, 2)), np.zeros(2), np.zeros((2, 2)))
    marginal, best, _ = langid.label_slice(model, pa.array(["one two three"]))
    assert np.allclose(marginal, 0.5) and (best == 0).all()


def test_quality_tie_of_labels(spark):
    """Of several labels of an id the least counts."""
    rng = random.Random(19)
    rows = [(i, (sentence(rng, 40) if i % 2 else "$$ !! ## " * 20)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(i, 1) for i in range(0, 120, 2)], "doc_id long, quality int")
    r = {x["doc_id"]: x["keep"] for x in quality.quality_scores(docs, labels, buckets=1 << 10).collect()}
    assert r == {i: i % 2 == 1 for i in range(120)}


def test_word_vectors_against_single_steps(spark):
    texts = ["one two three two", "three ONE one", "", None]
    got = quality.word_vectors(frame(spark, texts), 64)
    rows = 64 + quality.N_SHAPES
    place, sign = quality.index_vectors(rows)
    total = np.zeros((rows, quality.DIM))
    import pyarrow as pa

    for t in texts:
        words, shapes, _ = quality.coded(pa.array([t], pa.string()), 64)
        for seq in (words, shapes):
            for i, x in enumerate(seq):
                for y in [*seq[max(0, i - 2) : i], *seq[i + 1 : i + 3]]:
                    for p, s in zip(place[y], sign[y], strict=True):
                        total[x, p] += s
    total -= total.sum(0) * (np.abs(total).sum(1) / np.abs(total).sum())[:, None]
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    assert np.allclose(got, np.divide(total, norm, out=np.zeros_like(total), where=norm > 0), atol=1e-5)


def task_of_word_vectors(monkeypatch, buckets):
    """What ``word_vectors`` runs in a task: from batches to the rows of its table."""
    caught = []

    class Docs:
        def mapInArrow(self, f, schema):
            caught.append(f)
            raise StopIteration

    with monkeypatch.context() as m:
        m.setattr(quality, "pick", lambda *a: Docs())
        with pytest.raises(StopIteration):
            quality.word_vectors(None, buckets)
    return caught[0]


def test_word_vectors_hold_little_beside_their_table(monkeypatch):
    """Texts of hardly any pair twice: the task's own memory must not follow the number of pairs."""
    import pyarrow as pa

    rng = np.random.default_rng(21)
    texts = [" ".join(map(str, rng.integers(10_000, 100_000, 600_000))) for _ in range(3)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    task = task_of_word_vectors(monkeypatch, quality.BUCKETS)
    tracemalloc.start()
    try:
        (table,) = task(iter([batch]))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert table.num_rows > quality.BUCKETS // 2 and most < 90e6


def test_word_vectors_add_up_over_stretches(monkeypatch):
    """Pairs that lie across the ends of stretches, inside a text and between texts, count as any other."""
    import pyarrow as pa

    rng = random.Random(22)
    texts = [sentence(rng, n) for n in (1, 0, 30, 2, 7, 8, 3, 14, 1)]
    monkeypatch.setattr(quality, "STRETCH", 7)
    (table,) = task_of_word_vectors(monkeypatch, 64)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])]))
    place, sign = quality.index_vectors(64 + quality.N_SHAPES)
    total = np.zeros((64 + quality.N_SHAPES, quality.DIM))
    for t in texts:
        for seq in quality.coded(pa.array([t]), 64)[:2]:
            for i, x in enumerate(seq):
                for y in [*seq[max(0, i - 2) : i], *seq[i + 1 : i + 3]]:
                    np.add.at(total[x], place[y], sign[y])
    got = np.zeros_like(total)
    got[table.column("row").to_numpy()] = np.stack([table.column(f"d{j}").to_numpy() for j in range(quality.DIM)], 1)
    assert (got == total).all()


def test_passages_are_cut_out(spark):
    rng = random.Random(18)
    shared, other = sentence(rng, 60), sentence(rng, 9)
    texts = [f"{other} -- {shared}! end", f"Begin  here: {shared.upper()}.\n -- then {other}", f"{shared}", "short", None]
    got = {r["doc_id"]: r["text"] for r in substring.drop_passages(frame(spark, texts)).collect()}
    assert got == {0: texts[0], 1: f"Begin  here: then {other}", 2: "", 3: "short", 4: None}


def test_substring_against_brute_force(spark):
    rng = random.Random(8)
    shared = [sentence(rng, 70) for _ in range(4)]
    texts = [" ".join([sentence(rng, rng.randint(0, 60))] + [x + " " + sentence(rng, rng.randint(0, 20)) for x in rng.sample(shared, rng.randint(0, 2))]) for _ in range(30)]
    texts += [texts[0], sentence(rng, 49), shared[0].rsplit(" ", 21)[0]]  # a copy, one too short, one a word too short
    where = defaultdict(set)
    w = [words_of(t) for t in texts]
    for i, x in enumerate(w):
        for s in range(len(x) - 49):
            where[tuple(x[s : s + 50])].add(i)
    want = {}
    for i, x in enumerate(w):
        starts = [s for s in range(len(x) - 49) if len(where[tuple(x[s : s + 50])]) > 1]
        later = [s for s in starts if min(where[tuple(x[s : s + 50])]) < i]
        cover = lambda a: {k for s in a for k in range(s, s + 50)}
        if starts:
            want[i] = (cover(starts), cover(later))
    spans = lambda v: {k for s in v for k in range(s["start"], s["end"])}
    got = {r["doc_id"]: (spans(r["spans"]), spans(r["drop_spans"]), r["n_words"]) for r in substring.repeated_passages(frame(spark, texts)).collect()}
    assert {k: v[:2] for k, v in got.items()} == want and all(len(a) == n for a, _, n in got.values())


def test_chat_parts(spark):
    j = json.dumps
    rows = [
        (1, 0, "user", j([{"type": "text", "text": "look at <|this|>"}, {"type": "image", "url": "a.png", "width": 1024, "height": 513}, {"type": "text", "text": " and"}, {"type": "document", "url": "d.pdf", "pages": 3}])),
        (1, 1, "assistant", "plain"),
        (1, 2, "user", j([{"type": "audio", "url": 'x"y.wav', "seconds": 2.5}, {"type": "video", "url": "q"}])),
        (2, 0, "user", '[{"type": broken'),
        (3, 0, "user", "[{}]"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.chat_format(df).collect()}
    assert got[1]["formatted"] == "<|begin|>user\nlook at < |this|><|image|> and<|document|><|end|>\n<|begin|>assistant\nplain<|end|>\n<|begin|>user\n<|audio|><|end|>\n"
    assert [tuple(a) for a in got[1]["attachments"]] == [(0, "image", "a.png", 85 + 170 * 4), (0, "document", "d.pdf", 1800), (2, "audio", 'x"y.wav', 63)]
    assert (got[1]["n_text_tokens"], got[1]["n_tokens"]) == (6, 3 * chat.MESSAGE_TOKENS + 6 + 765 + 1800 + 63)
    conversations = df.toPandas()  # noqa: F841  (read by name in the SQL)
    want = {r[0]: r for r in duckdb.sql(f"select conv_id, n_messages, formatted, n_text_tokens, n_tokens, attachments from ({chat.sql()})").fetchall()}
    assert {r["conv_id"]: (r["conv_id"], r["n_messages"], r["formatted"], r["n_text_tokens"], r["n_tokens"], r["attachments"]) for r in chat.chat_rows(df).collect()} == want


def test_chat_markers_cannot_be_forged_across_parts(spark):
    j = json.dumps
    parts = lambda *t: j([{"type": "text", "text": x} for x in t])
    rows = [(1, 0, "user", parts("a <", "|image|> b")), (2, 0, "user", parts("a <", "", "|image|> b")), (3, 0, "us<", "x <"), (4, 0, "user", parts("<", "<|image|>"))]
    got = chat.chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(len(re.findall(r"<\|", r["formatted"])) == 2 and r["attachments"] == [] for r in got)


def one_at_a_time(lengths, capacity):
    """The packing rule with one pack at a time and plain loops."""
    left = Counter(lengths)
    packs = Counter()

    def exact(gap, free):
        have = sorted((x for x in free if free[x] > 0), reverse=True)
        if free[gap] > 0:
            return (gap,)
        pairs = lambda total, f: [(a, total - a) for a in have if total / 2 <= a < total and f[a] > 0 and f[total - a] > (a == total - a)]
        if p := pairs(gap, free):
            return min(p)  # the most even
        for a in have:
            if gap / 3 <= a <= gap - 2:
                f = free.copy()
                f[a] -= 1
                if p := [x for x in pairs(gap - a, f)]:
                    return (a, *min(p))
        return None

    while any(left.values()):
        pack = [max(x for x in left if left[x] > 0)]
        while gap := capacity - sum(pack):
            free = left - Counter(pack)
            found = exact(gap, free) or next(((x,) for x in range(gap, 0, -1) if free[x] > 0), None)
            if not found:
                break
            pack += found
        left -= Counter(pack)
        packs[tuple(sorted(pack, reverse=True))] += 1
    return packs


def test_packing_plan_against_one_at_a_time():
    rng = random.Random(9)
    for _ in range(30):
        capacity = rng.choice((20, 33, 64))
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 120))]
        plan = packing.Plan(Counter(lengths), capacity)
        got = Counter()
        for pattern, n in plan.patterns:
            got[pattern] += n
        assert got == one_at_a_time(lengths, capacity)


def test_packing_round_trip(spark):
    rng = random.Random(10)
    texts = [sentence(rng, rng.choice((3, 10, 40, 130, 517))) for _ in range(150)]
    packs = packing.best_fit_packing(frame(spark, texts), 128, packing.word_counts).collect()
    pieces = sorted((d, s, n) for p in packs for d, s, n in zip(p["doc_ids"], p["starts"], p["lengths"], strict=True))
    assert pieces == [(i, s, min(128, n - s)) for i, t in enumerate(texts) for n in [len(t.split()) + 1] for s in range(0, n, 128)]
    assert sorted(p["pack_id"] for p in packs) == list(range(len(packs))) and all(p["used"] == sum(p["lengths"]) <= 128 for p in packs)
    assert len(packs) <= 1.1 * -(-sum(n for *_, n in pieces) // 128)


def test_bpe_counts():
    assert packing.bpe_counter()(["", "Hello world", "<|endoftext|>"])[:2] == [0, 2]


def test_ann_recall(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    p = d.toPandas()
    x = np.stack(p.embedding)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    truth = {int(i): set(p.vec_id.to_numpy()[np.argsort(-row)[:10]]) for i, row in zip(p.vec_id, s, strict=True)}
    asked = ann_search(d).toPandas()
    assert set(asked.vec_id) == {i for i in truth if i % 20 == 0}
    got = ann_search(d, step=1).toPandas()
    assert set(got.vec_id) == set(truth)
    near = got.groupby("vec_id").neighbor_id.apply(set)
    assert np.mean([len(near[i] & t) / 10 for i, t in truth.items()]) >= 0.9
    row = {v: i for i, v in enumerate(p.vec_id)}
    assert np.allclose(got.cosine, [s[row[a], row[b]] for a, b in zip(got.vec_id, got.neighbor_id, strict=True)], atol=1e-5)
    assert (got.groupby("vec_id")["rank"].apply(list).map(lambda r: r == list(range(1, 11)))).all()


@pytest.mark.parametrize("tables, rows", [((1,), 20_000), ((4,), 20_000), ((4,), 50), ((2, 8), 90)])
def test_ann_recall_of_clusters(spark, monkeypatch, tables, rows):
    """A neighbour found through several tables takes one of the k places; buckets larger than a shard are searched whole, in copies of the shard too."""
    monkeypatch.setattr(ann, "TABLES", tables)
    monkeypatch.setattr(ann, "SHARD_ROWS", rows)
    monkeypatch.setattr(ann, "SHARD_QUERIES", 10 * rows)
    monkeypatch.setattr(ann, "BUCKET_ROWS", 0 if rows == 90 else 64)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(15, 64)), 40, 0) + rng.normal(size=(600, 64)) * 0.15
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    got = ann_search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), step=1).toPandas()
    near = got.groupby("vec_id").neighbor_id.apply(list)
    assert len(near) == 600 and all(len(set(v)) == len(v) == 10 for v in near)
    assert np.mean([len(set(near[i]) & set(np.argsort(-row)[:10])) / 10 for i, row in enumerate(s)]) >= 0.9


def test_hashing():
    x = np.random.default_rng(1).normal(size=(5, 8)).astype(np.float32)
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1), rtol=1e-5)
    for parts in (1, 2):
        h = Tables.make(6, 2, parts)
        away = h.distances(x[:, :6], 1)
        cost = at_buckets(away, np.arange(h.buckets))
        assert (cost.argmin(1) == h.bucket(x[:, :6], 1)).all() and (cost >= 0).all()
        assert ((cost <= reach(away, 7)[:, None]).sum(1) >= 7).all()


def test_pipeline_against_brute_force(spark, sf_dir, tmp_path):
    """Each stage's effect on its own input, and run() as their composition."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("benchmark", "labels"))
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == docs.columns
            after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality":
            # against the labels; what stays is as it was
            told = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None and r["doc_id"] in before}
            assert after.items() <= before.items() and len(after) < len(before)
            assert np.mean([(i in after) == (q == 1) for i, q in told.items()]) > 0.95
            p = {r["doc_id"]: r["p_good"] for r in quality.quality_scores(docs, labels).collect()}
            assert set(after) == {i for i in before if p[i] >= 0.5}
        elif name == "line_dedup":
            norm = lambda x: re.sub("[ \t\r]+", " ", x).strip(" ").lower()
            holders = defaultdict(set)
            for i, t in before.items():
                for x in t.split("\n"):
                    holders[norm(x)].add(i)
            want = {i: "\n".join(x for x in t.split("\n") if not norm(x) or len(holders[norm(x)]) <= line_dedup.MAX_DOCS or min(holders[norm(x)]) == i) for i, t in before.items()}
            assert after == {i: t for i, t in want.items() if t == before[i] or t.strip(" \t\r\n")}
        elif name == "near_duplicates":
            sets = {i: frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)]) for i, t in before.items() if (w := words_of(t))}
            group = {i: i for i in before}
            root = lambda i: i if group[i] == i else root(group[i])
            ids = sorted(sets)
            for x, a in enumerate(ids):
                for b in ids[x + 1 :]:
                    if len(sets[a] & sets[b]) >= ngram_join.THRESHOLD * len(sets[a] | sets[b]) - 1e-9:
                        u, v = sorted((root(a), root(b)))
                        group[v] = u
            assert after == {i: t for i, t in before.items() if root(i) == i}
        elif name == "decontamination":
            # what holds an item's words as they stand goes, what shares no six words in a row with any (in any case) stays
            grams = lambda t, n: {tuple(w[k : k + n]) for w in [words_of(t)] for k in range(len(w) - n + 1)}
            items = [r["text"] for r in benchmark.collect()]
            eights, sixes = [grams(t, 8) for t in items], set().union(*(grams(t, 6) for t in items))
            verbatim = {i for i, t in before.items() if any(e and len(e & grams(t, 8)) >= 0.7 * len(e) for e in eights)}
            clean = {i for i, t in before.items() if not sixes & grams(t, 6)}
            assert after.items() <= before.items() and verbatim and not verbatim & set(after) and clean <= set(after)
        else:
            packs = out.collect()
            tokens = Counter()
            for p in packs:
                for d, n in zip(p["doc_ids"], p["lengths"], strict=True):
                    tokens[d] += n
            counts = packing.bpe_counter()(list(before.values()))
            assert tokens == Counter({i: n + 1 for i, n in zip(before, counts, strict=True) if n})
        docs = out
    assert sorted(map(repr, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(repr, docs.collect()))
