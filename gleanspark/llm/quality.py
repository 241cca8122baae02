"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

Random indexing: every word has a fixed sparse random index vector (from its hash); a word's vector is the sum
of the index vectors of its neighbours over the whole corpus. Words are hashed into buckets, so the table of
vectors has a fixed size; each task sums its part, and the parts are added row by row, as an aggregate whose keys
are the buckets. A document is the mean and the
spread of its words' vectors. Besides the words themselves, the neighbourhoods of word shapes (all capitals,
runs of signs, a repeated word ...) are indexed in the same way, in buckets of their own.

The network is trained on a bounded sample of labelled documents (``MAX_LABELLED``, chosen by a hash of the id),
part of which is held out to fit the temperature that calibrates its probabilities. All statistics of words
cover the whole corpus, and all documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import fresh, hash_strings, lowest_hashes, mix64, pick, raw_tokens, text_slices

#: Buckets that words are hashed into (a parameter of all functions below), and the length of their vectors.
BUCKETS, DIM = 1 << 15, 32
SIGNS, REACH = 4, 2
#: Words whose pairs of neighbours a task adds to its table at a time; bounds what the pairs take.
STRETCH = 1 << 17
#: Labelled documents used for training at most.
MAX_LABELLED = 20_000
HIDDEN = 32
#: A document goes if its probability of being good is below this.
KEEP_AT = 0.5

SHAPES = (
    ("capitals", r"^\P{L}*\p{Lu}{2,}\P{Ll}*$"),
    ("sign_run", r"[^\p{L}\p{N}\s]{2,}"),
    ("lone_sign", r"^[^\p{L}\p{N}]+$"),
    ("digits", r"[0-9]"),
    ("address", r"@|://|www\."),
    ("long", r"^.{20,}$"),
    ("title", r"^\p{Lu}\p{Ll}+"),
)
N_SHAPES = len(SHAPES) + 2  # and: the same as the word before; none of these


@lru_cache(maxsize=2)
def index_vectors(rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The fixed sparse vectors, a row for each bucket and shape: the places of their entries, and the signs."""
    r = np.arange(rows, dtype=np.uint64)[:, None] * np.uint64(SIGNS) + np.arange(SIGNS, dtype=np.uint64)[None, :]
    h = mix64(r + np.uint64(0x51ED270B))
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def coded(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word its bucket and its shape's row, flat, and the documents' offsets."""
    t = raw_tokens(texts)
    if not len(t.codes):
        return np.empty(0, np.int64), np.empty(0, np.int64), t.offsets
    bucket = (hash_strings(pc.utf8_lower(t.vocab)) % np.uint64(buckets)).astype(np.int64)
    shape = np.full(len(t.vocab), N_SHAPES - 1)
    for i in range(len(SHAPES) - 1, -1, -1):
        shape[pc.match_substring_regex(t.vocab, SHAPES[i][1]).to_numpy(zero_copy_only=False).astype(bool)] = i
    words, shapes = bucket[t.codes], shape[t.codes]
    same = np.zeros(len(words), bool)
    same[1:] = t.codes[1:] == t.codes[:-1]
    firsts = t.offsets[:-1][t.offsets[:-1] < len(words)]
    same[firsts] = False
    shapes[same] = N_SHAPES - 2
    return words, buckets + shapes, t.offsets


def word_vectors(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Context vectors (a row for each bucket and shape) over all documents: length one, or nought for a bucket without words."""
    rows = buckets + N_SHAPES

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors(rows)
        total = np.zeros(rows * DIM)

        def add(a: np.ndarray, b: np.ndarray) -> None:
            # each distinct pair is added once, as often as it was seen
            pair, n = np.unique(a * rows + b, return_counts=True)
            x, y = pair // rows, pair % rows
            for j in range(SIGNS):
                np.add.at(total, x * DIM + place[y, j], sign[y, j] * n)
                np.add.at(total, y * DIM + place[x, j], sign[x, j] * n)

        for batch in batches:
            for piece in text_slices(batch):
                words, shapes, offsets = coded(piece.column("text"), buckets)
                doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                for k in range(1, REACH + 1):
                    for i in range(0, len(words) - k, STRETCH):
                        to = min(i + STRETCH, len(words) - k)
                        near = i + np.flatnonzero(doc[i + k : to + k] == doc[i:to])
                        add(words[near], words[near + k])
                        add(shapes[near], shapes[near + k])
        total = total.reshape(rows, DIM)
        some = np.flatnonzero(total.any(1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(np.rint(total[some, j]).astype(np.int64)) for j in range(DIM)]], names=["row", *[f"d{j}" for j in range(DIM)]])

    parts = pick(docs, "text").mapInArrow(part, "row long, " + ", ".join(f"d{j} long" for j in range(DIM)))
    sums = parts.groupBy("row").agg(*[F.sum(f"d{j}").alias(f"d{j}") for j in range(DIM)]).toArrow()  # a fixed number of rows
    total = np.zeros((rows, DIM))
    if sums.num_rows:
        total[sums.column("row").to_numpy()] = np.stack([sums.column(f"d{j}").to_numpy() for j in range(DIM)], 1)
    # what all words have in common (the most frequent neighbours) is taken out, so that vectors differ
    total -= total.sum(0) * (np.abs(total).sum(1) / max(1.0, np.abs(total).sum()))[:, None]
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    return np.divide(total, norm, out=np.zeros_like(total), where=norm > 0).astype(np.float32)


N_FEATURES = 2 * DIM + DIM + N_SHAPES


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row for each document: mean and spread of its word vectors, mean of its shape vectors, shares of shapes."""
    buckets = len(vectors) - N_SHAPES
    words, shapes, offsets = coded(texts, buckets)
    n = np.diff(offsets)
    out = np.zeros((len(n), N_FEATURES), np.float32)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    starts, count = offsets[:-1][some], n[some].astype(np.float32)[:, None]
    share = np.zeros((len(some), N_SHAPES), np.float32)
    doc = np.repeat(np.arange(len(some)), n[some])
    share[:] = np.bincount(doc * N_SHAPES + shapes - buckets, minlength=len(some) * N_SHAPES).reshape(-1, N_SHAPES) / count
    for j in range(DIM):
        v = vectors[words, j]
        out[some, j] = np.add.reduceat(v, starts) / count[:, 0]
        out[some, DIM + j] = np.sqrt(np.maximum(0, np.add.reduceat(v * v, starts) / count[:, 0] - out[some, j] ** 2))
    out[some, 2 * DIM : 3 * DIM] = share @ vectors[buckets:]
    out[some, 3 * DIM :] = share
    return out


@dataclass
class Network:
    """Two layers; ``temperature`` scales the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, ((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, held_out: np.ndarray, epochs: int = 60, seed: int = 1) -> Network:
    """Adam on the cross entropy; then the temperature of least cross entropy on the held-out rows. With one class only, its rate is given."""
    rng = np.random.default_rng(seed)
    fit = np.flatnonzero(~held_out)
    if not len(fit) or len(np.unique(y[fit])) < 2:
        rate = float(y[fit].mean()) if len(fit) else 1.0
        rate = min(max(rate, 0.01), 0.99)
        k = x.shape[1] if x.ndim == 2 else N_FEATURES
        return Network(np.zeros(k), np.ones(k), np.zeros((k, 1)), np.zeros(1), np.zeros(1), float(np.log(rate / (1 - rate))))
    mean, scale = x[fit].mean(0), x[fit].std(0) + 1e-3
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    z = (x - mean) / scale
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
            a = z[part] @ p[0] + p[1]
            h = np.maximum(0, a)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -50, 50))) - y[part]) / len(part)
            back = np.outer(d, p[2]) * (a > 0)
            grads = [z[part].T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            step += 1
            for q, g, mm, vv in zip(p, grads, m, v, strict=True):
                mm *= 0.9
                mm += 0.1 * g
                vv *= 0.999
                vv += 0.001 * g * g
                q -= 0.003 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    check = np.flatnonzero(held_out)
    if len(check) and len(np.unique(y[check])) > 1:
        s, sign = net.logits(x[check]), np.where(y[check] > 0, 1, -1)
        tries = np.exp(np.linspace(np.log(0.25), np.log(16), 97))
        net.temperature = float(tries[np.argmin([np.logaddexp(0, -sign * s / t).mean() for t in tries])])
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled documents, those of the smallest hashes of their ids; one row an id."""
    y = pick(labels, "doc_id", "quality").filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"))
    chosen = lowest_hashes(y.withColumn("o", F.xxhash64("doc_id")), "o", y.count(), most).orderBy("o", "doc_id").limit(most)
    return pick(docs, "doc_id", "text").filter("doc_id is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


def sample_features(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, most: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, features and labels of the sample; the features are made where the texts are."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch):
                x = pooled(piece.column("text"), shared.value)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("y").cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    # a row goes to the task that reads it: only the sample's features travel
    rows = labelled_sample(docs, labels, most).mapInArrow(run, "doc_id long, y int, x binary").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy())
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, N_FEATURES)[order]
    return rows.column("doc_id").to_numpy()[order], x.astype(np.float64), rows.column("y").to_numpy()[order].astype(np.float64)


@dataclass
class Classifier:
    vectors: np.ndarray
    network: Network


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, buckets: int = BUCKETS) -> Classifier:
    vectors = word_vectors(docs, buckets)
    ids, x, y = sample_features(docs, labels, vectors, most)
    held_out = mix64(ids.astype(np.uint64) + np.uint64(77)) % np.uint64(5) == 0
    return Classifier(vectors, train(x, y, held_out))


def score(docs: DataFrame, model: Classifier, column: str, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns and a new one: the calibrated probability that the document is good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, names[at]):
                p = shared.value.network.probabilities(pooled(piece.column(names[at]), shared.value.vectors).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(np.round(p, 6))], names=[*names, "p"])

    plain = docs.toDF(*names)
    schema = plain.withColumn("p", F.lit(0.0)).schema
    return plain.mapInArrow(run, schema).toDF(*docs.columns, column)


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, keep_at: float = KEEP_AT, buckets: int = BUCKETS) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, ``p_good`` (six places) and ``keep`` (``p_good >= keep_at``).

    A null or empty text has the features of a document without words and is scored as such. Rows without an
    id are scored; repeated rows are scored alike. Labels other than 0 and 1 and labels without an id are left
    out; of several labels of an id the least counts; without labels of both classes every document gets the one
    class's rate. Other columns of either table are ignored. Texts are read whole, however long they are; an empty
    table gives no rows.
    """
    return score(pick(docs, "doc_id", "text"), fit(docs, labels, most, buckets), "p_good").select("doc_id", "p_good", (F.col("p_good") >= keep_at).alias("keep"))


def quality_filter(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, keep_at: float = KEEP_AT, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs``, with their columns, that ``quality_scores`` keeps."""
    p = fresh(docs, "p_good")
    scored = score(docs, fit(docs, labels, most, buckets), p)
    return scored.filter(F.col(p) >= keep_at).drop(p)
