"""Substring dedup: a count-min prefilter, then exact grouping of the windows it lets through.

A window is ``WINDOW`` consecutive words. Its fingerprint is the least hash of the shorter grams inside it, so
equal windows have equal fingerprints, and neighbouring windows mostly share theirs: there is one fingerprint
for some thirteen words. Each task counts its documents' fingerprints in a count-min sketch; the sketches are
merged by addition. An estimate is never below the true count, so a window whose fingerprint is estimated once
can't be repeated. A second pass emits only the runs of windows whose fingerprint is estimated repeated, and
these are grouped exactly, by fingerprint and the windows' own hashes (128 bits together): none is lost, and
collisions of the sketch only cost time.

The sketch has a fixed size. On a corpus too large for it the filter lets more through, up to everything, and
the grouping, a shuffle of one row for thirteen windows with eight bytes each, still gives the same result.

Copies of a passage mostly give the same runs. Equal runs are therefore counted first, by a hash of their windows; only
fingerprints that have several different runs are looked at window by window, one run of each kind. All groups are
aggregates, combined before they are shuffled: no task holds all copies of a passage.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.llm.common import by_position, mix64, pick, text_slices, window_hashes, words, written

WINDOW = 50
GRAM = 25
#: Counters a row of the sketch, and rows.
WIDTH_BITS, DEPTH = 26, 2
#: The sketch travels in so many pieces, so that merging it is spread over tasks.
BLOCK_BITS = 16


def window_fingerprints(texts: pa.Array, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window hashes, their fingerprints, their flat starts and the documents' word offsets."""
    t, hashes = words(texts)
    value = hashes[t.codes]
    h, start = window_hashes(value, t.offsets, window)
    if not len(h):
        return h, h, start, t.offsets
    g, g_start = window_hashes(value, t.offsets, gram)
    # gram hashes by place; the window at s covers the grams at s ... s + window - gram, all inside its document
    place = np.zeros(len(value), np.uint64)
    place[g_start] = g
    span = window - gram + 1
    least, have = place, 1
    while have * 2 <= span:  # minima of doubled reach
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    rest = span - have
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    return h, mix64(least[start]), start, t.offsets  # mixed again, for minima are small numbers


def doc_fingerprints(fingerprint: np.ndarray, start: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each document's distinct fingerprints, all documents together."""
    doc = np.searchsorted(offsets, start, side="right") - 1
    run = np.ones(len(fingerprint), bool)
    run[1:] = (fingerprint[1:] != fingerprint[:-1]) | (doc[1:] != doc[:-1])
    f, d = fingerprint[run], doc[run]
    order = np.lexsort((f, d))
    f, d = f[order], d[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (d[1:] != d[:-1])
    return f[new]


def cells(fingerprint: np.ndarray, row: int) -> np.ndarray:
    """Counters of the fingerprints in a row of the sketch; rows use different bits of the (already mixed) hash."""
    return ((fingerprint >> np.uint64(row * (64 - WIDTH_BITS) // max(1, DEPTH - 1))) & np.uint64((1 << WIDTH_BITS) - 1)).astype(np.int64)


def hot_cells(docs: DataFrame, window: int, gram: int) -> np.ndarray:
    """Which counters of the merged sketch reach two, as bits (DEPTH x 2**WIDTH_BITS)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # counters saturate at two, since more isn't asked: a bit for one, a bit for two
        one = np.zeros((DEPTH, 1 << WIDTH_BITS - 3), np.uint8)
        two = np.zeros_like(one)
        for batch in batches:
            for piece in text_slices(batch):
                _, f, start, offsets = window_fingerprints(piece.column("text"), window, gram)
                f = doc_fingerprints(f, start, offsets)
                if not len(f):
                    continue
                for r in range(DEPTH):
                    c, n = np.unique(cells(f, r), return_counts=True)
                    byte, bit = c >> 3, (128 >> (c & 7)).astype(np.uint8)
                    heads = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
                    again = np.where((n > 1) | (one[r, byte] & bit > 0), bit, 0).astype(np.uint8)
                    two[r, byte[heads]] |= np.bitwise_or.reduceat(again, heads)
                    one[r, byte[heads]] |= np.bitwise_or.reduceat(bit, heads)
        size = 1 << BLOCK_BITS - 3
        for r in range(DEPTH):
            for b in range(1 << WIDTH_BITS - BLOCK_BITS):
                x, y = (m[r, b * size : (b + 1) * size] for m in (one, two))
                if x.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r << 32 | b], pa.int64()), pa.array([zlib.compress(x, 1)], pa.binary()), pa.array([zlib.compress(y, 1)], pa.binary())], names=["block", "one", "two"]
                    )

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.zeros(1 << BLOCK_BITS - 3, np.uint8)
        two = one.copy()
        for batch in batches:  # as they come: a task's memory doesn't grow with the number of sketches
            for a, b in zip(batch.column("one"), batch.column("two"), strict=True):
                x = np.frombuffer(zlib.decompress(a.as_py()), np.uint8)
                two |= np.frombuffer(zlib.decompress(b.as_py()), np.uint8) | (one & x)  # saturating addition, bit by bit
                one |= x
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([two.tobytes()])], names=["block", "two"])

    merged = docs.mapInArrow(sketch, "block long, one binary, two binary").groupBy("block").applyInArrow(merge, "block long, two binary")
    bits = np.zeros((DEPTH, 1 << WIDTH_BITS - BLOCK_BITS, 1 << BLOCK_BITS - 3), np.uint8)
    for r in merged.collect():  # a fixed number of bits, whatever the input
        bits[r["block"] >> 32, r["block"] & 0xFFFFFFFF] = np.frombuffer(r["two"], np.uint8)
    return bits.reshape(DEPTH, -1)


def candidate_runs(docs: DataFrame, bits: np.ndarray, window: int, gram: int) -> DataFrame:
    """(fp, run, doc_id, pos, n, hashes): runs of ``n`` windows of one fingerprint that is estimated repeated, from place ``pos`` on; ``run`` stands for the windows' hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch):
                h, f, start, offsets = window_fingerprints(piece.column("text"), window, gram)
                ok = np.ones(len(f), bool)
                for r in range(DEPTH):
                    c = cells(f, r)
                    ok &= (shared.value[r][c >> 3] & (128 >> (c & 7)).astype(np.uint8)) > 0
                h, f, start = h[ok], f[ok], start[ok]
                if not len(h):
                    continue
                head = np.ones(len(h), bool)
                doc = np.searchsorted(offsets, start, side="right") - 1
                head[1:] = (f[1:] != f[:-1]) | (start[1:] != start[:-1] + 1) | (doc[1:] != doc[:-1])
                heads = np.flatnonzero(head)
                ends = np.append(heads[1:], len(h))
                nth = np.arange(len(h)) - np.repeat(heads, ends - heads)
                with np.errstate(over="ignore"):
                    key = mix64(np.add.reduceat(mix64(h ^ mix64(nth.astype(np.uint64))), heads) + (ends - heads).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(f[heads].view(np.int64)),
                        pa.array(key.view(np.int64)),
                        piece.column("doc_id").take(pa.array(doc[heads])),
                        pa.array((start - offsets[doc])[heads].astype(np.int32)),
                        pa.array((ends - heads).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.append(heads, len(h)).astype(np.int32)), pa.array(h.view(np.int64))),
                    ],
                    names=["fp", "run", "doc_id", "pos", "n", "hashes"],
                )

    return docs.mapInArrow(run, "fp long, run long, doc_id long, pos int, n int, hashes array<long>")


def repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Documents that share a run of at least ``window`` words with another: ``doc_id``; ``spans``, the maximal runs of
    shared words as [start, end) word numbers; ``drop_spans``, the same for windows that a document with a smaller
    id has too (to drop, so that one copy stays); ``n_words``, the words in ``spans``.

    Words are lower case without outer signs, and those without a letter or digit aren't counted. A window must
    stand in two documents of different ids; repeats inside one document, and repeated rows of an id, don't count.
    Rows without an id or text, and texts of fewer words than a window, give nothing. Rows that share an id with
    different texts have their spans pooled. Other columns are ignored. Texts are read whole; an empty table gives no rows.
    """
    if not 0 < gram <= window:
        raise ValueError("a gram must be at most as long as a window")
    source = pick(docs, "doc_id", "text").filter("doc_id is not null")
    runs = written(candidate_runs(source, hot_cells(source, window, gram), window, gram))
    # exactly: the kinds of runs, and the documents of each; the fingerprints of two documents
    kinds = written(runs.groupBy("fp", "run").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.first("n").alias("n")))
    repeated = kinds.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds"), F.min("least").alias("a"), F.max("most").alias("b")).filter("a <> b").select("fp", "kinds")
    known = written(kinds.join(repeated, "fp"))
    # all windows of a fingerprint's only run are repeated, or none
    whole = known.filter("kinds = 1").select("fp", "run", F.lit(0).alias("from"), F.col("n").alias("to"), "least")
    # of several runs one of each kind is taken apart
    several = known.filter("kinds > 1").select("fp", "run", "least", "most")
    first = runs.join(several, ["fp", "run"]).filter("doc_id = least").select("fp", "run", "least", "most", "hashes")
    each = written(first).select("fp", "run", "least", "most", F.posexplode("hashes").alias("i", "h"))
    windows = each.groupBy("fp", "h").agg(F.min("least").alias("a"), F.max("most").alias("b")).filter("a <> b").select("fp", "h", F.col("a").alias("first"))
    hits = each.join(windows, ["fp", "h"]).groupBy("fp", "run", "i").agg(F.min("first").alias("least"))
    island = F.col("i") - F.row_number().over(Window.partitionBy("fp", "run", "least").orderBy("i"))  # of a run's windows, which are few
    parts = hits.withColumn("island", island).groupBy("fp", "run", "least", "island").agg(F.min("i").alias("from"), (F.max("i") + 1).alias("to"))
    stretches = written(whole.unionByName(parts.select("fp", "run", "from", "to", "least")))
    found = runs.select("fp", "run", "doc_id", "pos").join(stretches, ["fp", "run"])
    stretch = F.struct((F.col("pos") + F.col("from")).alias("a"), (F.col("pos") + F.col("to")).alias("b"), (F.col("doc_id") > F.col("least")).alias("later"))
    per_doc = found.select("doc_id", stretch.alias("s")).groupBy("doc_id").agg(F.collect_set("s").alias("s"))
    return per_doc.select("doc_id", F.col("s.a").alias("a"), F.col("s.b").alias("b"), F.col("s.later").alias("later")).mapInArrow(_spans(window), SPANS)


SPANS = "doc_id long, n_words long, spans array<struct<start:int,end:int>>, drop_spans array<struct<start:int,end:int>>"


def _spans(window: int):
    """A mapInArrow function: stretches of window starts become unions of the windows."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both: tuple[list, list] = ([], [])
            for a, b, later in zip(*(batch.column(c) for c in ("a", "b", "later")), strict=True):
                a, b, later = (x.values.to_numpy(zero_copy_only=False) for x in (a, b, later))
                both[0].append(union(a, b, window))
                both[1].append(union(a[later], b[later], window))
            n = [sum(x["end"] - x["start"] for x in s) for s in both[0]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(both[0], kind), pa.array(both[1], kind)], names=["doc_id", "n_words", "spans", "drop_spans"])

    return run


def union(a: np.ndarray, b: np.ndarray, window: int) -> list[dict]:
    """The words of the windows that start at a ... b - 1, as spans that don't touch."""
    order = np.argsort(a, kind="stable")
    a, end = a[order], np.maximum.accumulate(b[order] - 1 + window) if len(a) else a
    head = np.flatnonzero(np.append(True, a[1:] > end[:-1])) if len(a) else np.empty(0, np.int64)
    return [{"start": x, "end": y} for x, y in zip(a[head].tolist(), end[np.append(head[1:], len(a)) - 1].tolist() if len(a) else [], strict=True)]


def drop_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs``, with their columns and rows, less the passages in ``drop_spans``: from a span's first word up to the word after its last.

    What is left keeps its blanks and signs. Rows without an id or text stay as they are, and so do texts without such a
    passage; repeated rows of an id are cut alike. Rows that share an id with different texts stay whole, for their spans are pooled.
    """
    plain, at = by_position(docs)
    drops = repeated_passages(docs, window, gram).filter(F.size("drop_spans") > 0).select(F.col("doc_id").alias("dropped_id"), "drop_spans")
    mixed = pick(docs, "doc_id", "text").filter("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("a"), F.max("text").alias("b")).filter("a <> b").select(F.col("doc_id").alias("dropped_id"))
    drops = written(drops.join(mixed, "dropped_id", "left_anti"))
    names, text = plain.columns, at["text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for i, spans in enumerate(batch.column("drop_spans").to_pylist()):
                if spans and texts[i]:
                    texts[i] = cut(texts[i], spans)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names], names=names)

    joined = plain.join(drops, F.col(at["doc_id"]) == F.col("dropped_id"), "left").drop("dropped_id")
    return joined.mapInArrow(run, plain.schema).toDF(*docs.columns)


def cut(text: str, spans: list[dict]) -> str:
    """``text`` without the words of the spans; words without a letter or digit go with the span that they stand in."""
    at = [m.start() for m in re.finditer(r"[^ \t\n\r\f\v]+", text) if any(c.isalnum() for c in m.group())] + [len(text)]
    out, last = [], 0
    for s in spans:
        out.append(text[last : at[s["start"]]])
        last = at[s["end"]]
    return "".join([*out, text[last:]])


def span_texts(passages: DataFrame) -> DataFrame:
    """``repeated_passages`` with the spans written as ``start-end start-end``, which SQL engines compare alike."""
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), " ")
    return passages.select("doc_id", "n_words", written("spans").alias("spans"), written("drop_spans").alias("drop_spans"))


def sql(window: int = WINDOW) -> str:
    """The rows of ``span_texts``, from all windows as strings."""
    return rf"""
    with d as (
        select doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[ \t\n\r\f\v]+'),
            lambda x: lower(regexp_replace(x, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'))), lambda x: x <> '') w from documents),
    p as (select doc_id, w, unnest(range(len(w) - {window - 1})) pos from d where len(w) >= {window}),
    h as (select doc_id, pos, md5(array_to_string(w[pos + 1 : pos + {window}], ' ')) x from p),
    r as (select doc_id, pos, doc_id > a later from (select doc_id, pos, min(doc_id) over (partition by x) a, max(doc_id) over (partition by x) b from h) where a <> b),
    k as (select doc_id, pos, 's' kind from r union all select doc_id, pos, 'd' from r where later),
    m as (select *, case when pos - lag(pos) over (partition by doc_id, kind order by pos) <= {window} then 0 else 1 end fresh from k),
    g as (select *, sum(fresh) over (partition by doc_id, kind order by pos) nth from m),
    i as (select doc_id, kind, nth, min(pos) a, max(pos) + {window} b from g group by all)
    select doc_id, cast(sum(b - a) filter (where kind = 's') as bigint) n_words, string_agg(a || '-' || b, ' ' order by a) filter (where kind = 's') spans,
        coalesce(string_agg(a || '-' || b, ' ' order by a) filter (where kind = 'd'), '') drop_spans from i group by doc_id"""
