"""Language ID of code-switched text with a linear-chain conditional random field.

Every word is labelled with a language. A word's score for a label comes from its affixes, its byte n-grams and
a lexicon of frequent words; the chain adds learned scores of transitions between labels; forward-backward gives
each word's marginal probabilities. Scores are computed once for each distinct word of a slice, and the
recursions step through all its documents at once, longest first, so that no word is handled singly.

The model is trained here, on pieces from the whole texts of a bounded sample of documents with a known language
(``MAX_DOCS``, ``MAX_PIECES``), which are spliced into sequences that switch between languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import Tokens, hash_strings, lowest_hashes, mix64, offsets_of, pick, text_slices, words

FEATURE_BITS = 16
#: Documents whose texts are used for training at most, words a piece of them, and pieces; all are parameters of ``training_sample``.
MAX_DOCS, PIECE, MAX_PIECES = 2_000, 24, 10_000
#: Frequent words of the sample that are features of their own; a parameter of ``train``.
LEXICON = 400
EPOCHS, RATE = 6, 0.5
#: Bytes of words whose features are handled at a time.
PART_BYTES = 1 << 20
GRAMS, AFFIXES = (2, 3), (1, 2, 3, 4)


def framed(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words, each as ``^word$``, one after the other; and their offsets."""
    v = vocab.cast(pa.large_binary())
    off = np.frombuffer(v.buffers()[1], np.int64)[v.offset : v.offset + len(v) + 1]
    body = np.frombuffer(v.buffers()[2], np.uint8) if v.buffers()[2] is not None else np.empty(0, np.uint8)
    start = off[:-1] - off[0] + 2 * np.arange(len(v))
    out = np.full(int(off[-1] - off[0]) + 2 * len(v), ord("^"), np.uint8)
    ends = np.append(start[1:], len(out))
    inner = np.ones(len(out), bool)
    inner[start] = inner[ends - 1] = False
    out[inner] = body[off[0] : off[-1]]
    out[ends - 1] = ord("$")
    return out, np.append(start, len(out))


def word_features(vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature number) of all features: byte n-grams of the whole word, its ends included, and prefixes and suffixes."""
    b, off = framed(vocab)
    wide, n = b.astype(np.uint64), np.diff(off)
    word = np.repeat(np.arange(len(n)), n)
    mask = np.uint64((1 << FEATURE_BITS) - 1)
    rows, numbers = [], []

    def add(has: np.ndarray, at: np.ndarray, size: int, kind: int) -> None:
        code = np.zeros(len(at), np.uint64)
        for j in range(size):
            code = code * np.uint64(256) + wide[at + j]
        rows.append(has)
        numbers.append((mix64(code * np.uint64(64) + np.uint64(kind)) & mask).astype(np.int64))

    place = np.arange(len(b))
    for size in GRAMS:
        at = np.flatnonzero(place + size <= off[1:][word])
        add(word[at], at, size, size)
    for size in AFFIXES:
        has = np.flatnonzero(n >= size + 2)
        add(has, off[has] + 1, size, 8 + size)
        add(has, off[has + 1] - 1 - size, size, 16 + size)
    return (np.concatenate(rows), np.concatenate(numbers)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def in_parts(vocab: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The words in parts of bounded size (a longer word is a part of its own), with the number of each part's first."""
    size = offsets_of(pc.binary_length(vocab).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(vocab):
        end = max(at + 1, int(np.searchsorted(size, size[at] + PART_BYTES, side="right")) - 1)
        yield at, vocab.slice(at, end - at)
        at = end


@dataclass
class Field:
    labels: list[str]
    weights: np.ndarray  # features x labels
    lexicon: np.ndarray  # sorted hashes of the lexicon's words
    lexicon_weights: np.ndarray
    start: np.ndarray
    transitions: np.ndarray

    def scores(self, vocab: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Each word's score for each label."""
        out = np.zeros((len(vocab), len(self.labels)))
        if not len(vocab):
            return out
        for at, part in in_parts(vocab):
            rows, numbers = word_features(part)
            for j in range(len(self.labels)):
                out[at : at + len(part), j] = np.bincount(rows, self.weights[numbers, j], len(part))
        out /= np.sqrt(lengths(vocab))[:, None]  # long words have many features
        at, known = self.in_lexicon(hashes)
        out[known] += self.lexicon_weights[at[known]]
        return out

    def in_lexicon(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.lexicon, hashes), max(0, len(self.lexicon) - 1))
        return at, (self.lexicon[at] == hashes) if len(self.lexicon) else np.zeros(len(hashes), bool)


def lengths(vocab: pa.Array) -> np.ndarray:
    return pc.binary_length(vocab).to_numpy(zero_copy_only=False) + 2.0


def time_major(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of words that puts all documents' first words first, and so on; and the number of documents at each step."""
    n = np.diff(offsets)
    order = np.argsort(-n, kind="stable")
    steps = int(n.max(initial=0))
    active = len(n) - np.searchsorted(np.sort(n), np.arange(steps), side="right")
    base = offsets[:-1][order]
    step = np.repeat(np.arange(steps), active)
    place = np.arange(len(step)) - np.repeat(np.cumsum(active) - active, active)
    return base[place] + step, active


def forward_backward(emit: np.ndarray, active: np.ndarray, start: np.ndarray, transitions: np.ndarray, expected: bool = False):
    """Marginals of the words in time-major order (documents longest first), scaled at each step; with ``expected`` also
    the expected transitions and the log likelihood's partition term."""
    k = emit.shape[1]
    top = emit.max(1, keepdims=True) if len(emit) else emit[:, :1]
    e = np.exp(emit - top)
    trans = np.exp(transitions)
    alpha, scale = np.empty_like(e), np.ones(len(e))
    first = np.concatenate([[0], np.cumsum(active)]).astype(np.int64)
    for t in range(len(active)):
        a, b = first[t], first[t + 1]
        alpha[a:b] = e[a:b] * (np.exp(start) if t == 0 else alpha[first[t - 1] : first[t - 1] + b - a] @ trans)
        scale[a:b] = alpha[a:b].sum(1)
        alpha[a:b] /= scale[a:b, None]
    beta = np.ones_like(e)
    pairs = np.zeros((k, k))
    for t in range(len(active) - 1, 0, -1):
        a, b = first[t], first[t + 1]
        c = first[t - 1]
        right = e[a:b] * beta[a:b] / scale[a:b, None]
        beta[c : c + b - a] = right @ trans.T
        if expected:
            pairs += (alpha[c : c + b - a].T @ right) * trans
    marginal = alpha * beta
    marginal /= marginal.sum(1, keepdims=True) if len(marginal) else 1
    if expected:
        return marginal, pairs, float(np.log(scale).sum() + top.sum())
    return marginal


# --- training --------------------------------------------------------------------------------------------


def spliced(pieces: list[tuple[int, np.ndarray]], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences of word codes and labels, of one to four pieces each; pieces are (label, codes)."""
    codes, labels, lengths = [], [], []
    order, at = rng.permutation(len(pieces)), 0
    while at < len(order):
        parts = [pieces[i] for i in order[at : at + int(rng.integers(1, 5))]]
        at += len(parts)
        codes += [c for _, c in parts]
        labels += [np.full(len(c), y) for y, c in parts]
        lengths.append(sum(len(c) for _, c in parts))
    return np.concatenate(codes), np.concatenate(labels), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def train(texts: list[str], langs: list[str], lexicon: int = LEXICON, seed: int = 3) -> Field:
    """Stochastic gradient ascent (Adagrad) on the conditional likelihood of spliced sequences. The ``lexicon`` has the most frequent words, of equals those of the smallest hashes."""
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    y_of = {x: i for i, x in enumerate(labels)}
    t, hashes = words(pa.array(texts, pa.string()))
    # the dictionary may hold a word twice (before normalisation): codes become those of distinct hashes
    unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    vocab, codes = t.vocab.take(pa.array(first)), inverse[t.codes]
    pieces = []
    for i, lang in enumerate(langs):
        own = codes[t.offsets[i] : t.offsets[i + 1]]
        at = 0
        while at < len(own):
            step = int(rng.integers(3, 30))
            pieces.append((y_of[lang], own[at : at + step]))
            at += step
    k = len(labels)
    freq = np.bincount(np.concatenate([p for _, p in pieces]), minlength=len(unique)) if pieces else np.zeros(len(unique))
    common = np.sort(np.argsort(-freq, kind="stable")[:lexicon])
    model = Field(labels, np.zeros((1 << FEATURE_BITS, k)), unique[common], np.zeros((len(common), k)), np.zeros(k), np.zeros((k, k)))
    if k < 2 or not pieces:
        return model
    rows, numbers = word_features(vocab)
    inv = 1 / np.sqrt(lengths(vocab))
    lex_at, in_lex = model.in_lexicon(unique)
    params = [model.weights, model.lexicon_weights, model.start, model.transitions]
    seen = [np.full_like(p, 1e-2) for p in params]
    for _ in range(EPOCHS):
        seq, y, offsets = spliced(pieces, rng)
        for part in np.array_split(np.arange(len(offsets) - 1), max(1, (len(offsets) - 1) // 200)):
            a, b = offsets[part[0]], offsets[part[-1] + 1]
            off = offsets[part[0] : part[-1] + 2] - a
            order, active = time_major(off)
            w, gold = seq[a:b], y[a:b]
            used, local = np.unique(w, return_inverse=True)
            pick_ = np.zeros(len(unique), bool)
            pick_[used] = True
            mine = pick_[rows]
            place = np.zeros(len(unique), np.int64)
            place[used] = np.arange(len(used))
            r, f = place[rows[mine]], numbers[mine]
            emit = np.stack([np.bincount(r, model.weights[f, j], len(used)) for j in range(k)], 1) * inv[used][:, None]
            known = in_lex[used]
            emit[known] += model.lexicon_weights[lex_at[used[known]]]
            marginal, pairs, _ = forward_backward(emit[local][order], active, model.start, model.transitions, True)
            diff = np.empty_like(marginal)
            diff[order] = -marginal
            diff[np.arange(len(gold)), gold] += 1
            per_word = np.stack([np.bincount(local, diff[:, j], len(used)) for j in range(k)], 1)
            g_w = np.stack([np.bincount(f, (per_word * inv[used][:, None])[r, j], 1 << FEATURE_BITS) for j in range(k)], 1)
            g_l = np.zeros_like(model.lexicon_weights)
            np.add.at(g_l, lex_at[used[known]], per_word[known])
            heads = off[:-1]
            inner = np.ones(len(gold), bool)
            inner[heads] = False
            at = np.flatnonzero(inner)
            g_t = np.bincount(gold[at - 1] * k + gold[at], minlength=k * k).reshape(k, k) - pairs
            g_s = diff[heads].sum(0)
            for p, g, s in zip(params, (g_w, g_l, g_s, g_t), seen, strict=True):
                g = g / len(part)
                s += g * g
                p += RATE * g / np.sqrt(s) * 0.2
                p *= 1 - 1e-5
    return model


def training_sample(docs: DataFrame, most: int = MAX_DOCS, pieces: int = MAX_PIECES) -> tuple[list[str], list[str]]:
    """Pieces of ``PIECE`` words and their languages: at most ``pieces``, from anywhere in the whole texts of at most ``most`` documents with a
    language. Documents and pieces are those of the smallest hashes (of the id; of the id and the place); a model's sample, not a corpus statistic."""
    has = [c for c in ("doc_id",) if c in docs.columns]
    d = pick(docs, *has, "text", "lang").filter("lang is not null").withColumn("o", F.xxhash64(*(has or ["text", "lang"])))
    chosen = lowest_hashes(d.select("o"), "o", pick(docs, "lang").filter("lang is not null").count(), most).orderBy("o").limit(most).agg(F.max("o")).first()[0]
    if chosen is None:
        return [], []
    few = d.filter((F.col("o") <= chosen) & F.col("text").isNotNull())  # the documents themselves stay where they are
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    cut = few.withColumn("w", words).select("lang", "o", F.posexplode(F.expr(f"transform(sequence(0, size(w) - 1, {PIECE}), i -> array_join(slice(w, i + 1, {PIECE}), ' '))")).alias("i", "piece"))
    rows = cut.filter("piece <> ''").withColumn("p", F.xxhash64("o", "i", "piece")).orderBy("p", "lang", "piece").limit(pieces).collect()
    return [r["piece"] for r in rows], [r["lang"] for r in rows]


# --- the operator ----------------------------------------------------------------------------------------

OUT = "doc_id long, lang string, confidence double, n_words long, n_switches long, shares map<string,double>, spans array<struct<start:int,end:int,lang:string>>"


def label_slice(model: Field, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Tokens]:
    """Marginals and best labels of the words, in the order of the texts."""
    t, hashes = words(texts)
    emit = model.scores(t.vocab, hashes)
    order, active = time_major(t.offsets)
    marginal = np.empty((len(t.codes), len(model.labels)))
    marginal[order] = forward_backward(emit[t.codes[order]], active, model.start, model.transitions)
    return marginal, marginal.argmax(1), t


def identify(docs: DataFrame, model: Field) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``; ``lang``, the label with the largest sum of marginals, and
    ``confidence``, its part; ``n_words``; ``n_switches`` between neighbouring words; ``shares``, each label's part of
    the marginals; ``spans`` of equal labels, as word numbers.

    A text without words (null and empty ones too) has a null ``lang``, confidence 0 and no spans. Ties go to the
    label that comes first in the alphabet. Rows without an id and repeated rows are labelled like any other; other
    columns are ignored. All words of a text are labelled, however long it is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    labels = model.labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch):
                marginal, best, t = label_slice(shared.value, piece.column("text"))
                n = np.diff(t.offsets)
                some = np.flatnonzero(n)
                sums = np.zeros((len(n), len(labels)))
                if len(some):
                    sums[some] = np.add.reduceat(marginal, t.offsets[:-1][some]) / n[some][:, None]
                top = sums.argmax(1)
                head = np.ones(len(best), bool)
                head[1:] = best[1:] != best[:-1]
                head[t.offsets[:-1][some]] = True
                heads = np.flatnonzero(head)
                doc = np.searchsorted(t.offsets, heads, side="right") - 1
                ends = np.append(heads[1:], len(best))
                per_doc = np.bincount(doc, minlength=len(n))
                off = np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int32)
                names = pa.array(labels, pa.string())
                spans = pa.StructArray.from_arrays(
                    [pa.array((heads - t.offsets[doc]).astype(np.int32)), pa.array((ends - t.offsets[doc]).astype(np.int32)), names.take(pa.array(best[heads]))], names=["start", "end", "lang"]
                )
                lang = pc.if_else(pa.array(n > 0), names.take(pa.array(top)), pa.scalar(None, pa.string()))
                k = len(labels)
                shares = pa.MapArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * k), names.take(pa.array(np.tile(np.arange(k), len(n)))), pa.array(np.round(sums, 4).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        lang,
                        pa.array(np.round(sums.max(1), 6)),
                        pa.array(n),
                        pa.array(np.maximum(per_doc - 1, 0).astype(np.int64)),
                        shares,
                        pa.ListArray.from_arrays(pa.array(off), spans),
                    ],
                    names=["doc_id", "lang", "confidence", "n_words", "n_switches", "shares", "spans"],
                )

    source = pick(docs, "doc_id", "text")
    if not labels:
        return source.select(
            "doc_id",
            F.lit(None).cast("string").alias("lang"),
            F.lit(0.0).alias("confidence"),
            F.lit(0).cast("long").alias("n_words"),
            F.lit(0).cast("long").alias("n_switches"),
            F.expr("map()").cast("map<string,double>").alias("shares"),
            F.expr("array()").cast("array<struct<start:int,end:int,lang:string>>").alias("spans"),
        )
    return source.mapInArrow(run, OUT)


def language_id(docs: DataFrame, training: DataFrame | None = None, most: int = MAX_DOCS) -> DataFrame:
    """``identify`` with a model trained on ``training`` (``docs`` itself by default: its ``text`` and ``lang``). Without
    any labelled text no language is known: every ``lang`` is null and no word is counted. An empty table gives no rows."""
    return identify(docs, train(*training_sample(docs if training is None else training, most)))
