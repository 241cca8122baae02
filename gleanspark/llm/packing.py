"""Best-fit packing by exact-complement hashing.

What has to be decided depends on the lengths alone, and there are at most ``capacity`` different ones: their
histogram is planned on the driver, whatever the size of the corpus. The plan takes the longest length left and
looks its gap up among single lengths, sums of pairs and sums of triples; a combination that fills the gap exactly
is used as often as the counts of its lengths allow. What has no exact complement is filled best-fit: the longest
length that fits, then again whatever fills the rest exactly.

The plan is a list of patterns with counts. Pieces are numbered within their length (in salted parts, so that no
task holds all pieces of a common length), and number and length give the pack by binary search in the plan.
Only ids and lengths are shuffled, never a text.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.llm.common import checkpointed, pick, text_slices

#: Tokens a pack holds.
CAPACITY = 4096
#: A public tokenizer's merge ranks; executors must find the file at this path.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Its rule for cutting text into pieces that are merged separately.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of one length that a task numbers, on average.
PART = 1_000_000

Counted = Callable[[list[str]], list[int]]


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("from-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _bpe_counts(path: str, texts: list[str]) -> list[int]:
    e = encoding(path)
    return [len(e.encode_ordinary(t)) for t in texts]


def bpe_counter(path: str = TOKENIZER) -> Counted:
    """Counts the tokens of texts with the byte-level BPE at ``path``."""
    return partial(_bpe_counts, path)


def word_counts(texts: list[str]) -> list[int]:
    """Counts whitespace-separated words."""
    return [len(t.split()) for t in texts]


# --- the plan --------------------------------------------------------------------------------------------


class Plan:
    """Patterns (lengths of a pack, longest first) and how many packs have each, from the number of pieces of each length."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        if any(not 0 < x <= capacity for x in histogram):
            raise ValueError("lengths must be between 1 and the capacity")
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in histogram.items():
            self.left[length] += n
        self._index()
        self.patterns: list[tuple[tuple[int, ...], int]] = []
        for longest in range(capacity, 0, -1):
            while self.left[longest]:
                self._emit(self._fill(longest))

    def _index(self) -> None:
        """Which sums two and three of the lengths can make. Counts only fall, so a sum that has failed once is struck out for good."""
        have = np.flatnonzero(self.left)
        self.pair_sums = np.zeros(self.capacity + 1, bool)
        for a in have:
            others = have[have <= self.capacity - a]
            self.pair_sums[a + others] = True
        self.triple_sums = np.zeros(self.capacity + 1, bool)
        for a in have:
            self.triple_sums[a:] |= self.pair_sums[: self.capacity + 1 - a]

    def _free(self, used: Counter) -> np.ndarray:
        free = self.left.copy()
        for length, n in used.items():
            free[length] -= n
        return free

    def _pair(self, total: int, free: np.ndarray) -> tuple[int, ...] | None:
        """Two lengths of this sum, the most even ones."""
        half = total // 2
        small = np.arange(1, half + 1)
        ok = (free[small] > 0) & (free[total - small] > 0)
        if total % 2 == 0 and half:
            ok[half - 1] &= free[half] > 1
        at = np.flatnonzero(ok)
        return (total - int(small[at[-1]]), int(small[at[-1]])) if len(at) else None

    def _exact(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap exactly, the fewest first."""
        free = self._free(used)
        if free[gap] > 0:
            return (gap,)
        if self.pair_sums[gap]:
            pair = self._pair(gap, free)
            if pair:
                return pair
            if self._pair(gap, self.left) is None:
                self.pair_sums[gap] = False
        if not self.triple_sums[gap]:
            return None
        largest = np.arange(gap - 2, (gap - 1) // 3, -1)  # of the three
        for a in largest[(free[largest] > 0) & self.pair_sums[gap - largest]]:
            free[a] -= 1
            pair = self._pair(gap - int(a), free)
            free[a] += 1
            if pair:
                return tuple(sorted((int(a), *pair), reverse=True))
            if self._pair(gap - int(a), self.left) is None:
                self.pair_sums[gap - a] = False
        return None

    def _fill(self, longest: int) -> Counter:
        used, gap = Counter([longest]), self.capacity - longest
        while gap:
            found = self._exact(gap, used)
            if found is None:
                fits = np.flatnonzero(self._free(used)[: gap + 1] > 0)
                if not len(fits):
                    break
                found = (int(fits[-1]),)
            used.update(found)
            gap -= sum(found)
        return used

    def _emit(self, used: Counter) -> None:
        n = min(int(self.left[x]) // k for x, k in used.items())
        for x, k in used.items():
            self.left[x] -= n * k
        self.patterns.append((tuple(sorted(used.elements(), reverse=True)), n))

    def slots(self) -> tuple[np.ndarray, ...]:
        """For each length, in order, ranges of its pieces: key (length, first piece), first pack, pieces a pack, place in the pack."""
        keys, packs, each, place = [], [], [], []
        start: Counter = Counter()
        pack = 0
        for lengths, n in self.patterns:
            for x, k in Counter(lengths).items():
                keys.append(x << 40 | start[x])
                packs.append(pack)
                each.append(k)
                place.append(lengths.index(x))
                start[x] += n * k
            pack += n
        order = np.argsort(np.array(keys, np.int64))
        return tuple(np.array(x, np.int64)[order] for x in (keys, packs, each, place))


# --- the operator ----------------------------------------------------------------------------------------


def token_lengths(docs: DataFrame, counter: Counted) -> DataFrame:
    """(doc_id, n) of the rows with a text that has a token; n counts the document's end as one more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch):
                n = np.array(counter([x or "" for x in piece.column("text").to_pylist()]), np.int64)
                some = np.flatnonzero(n)
                if len(some):
                    yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(some)), pa.array(n[some] + 1)], names=["doc_id", "n"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n long")


RESULT = "pack_id long, used int, doc_ids array<long>, starts array<long>, lengths array<int>"


def pack_lengths(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Packs of the rows (doc_id, n) as ``best_fit_packing`` gives them."""
    spark = lengths.sparkSession
    lengths = checkpointed(pick(lengths, "doc_id", "n").filter("n > 0"))
    pieces = lengths.select("doc_id", F.explode(F.expr(f"sequence(0L, n - 1, {capacity}L)")).alias("start"), "n")
    pieces = pieces.select("doc_id", "start", F.least(F.col("n") - F.col("start"), F.lit(capacity)).cast("int").alias("len"))
    histogram = {r["len"]: r["count"] for r in pieces.groupBy("len").count().collect()}  # at most ``capacity`` rows
    if not histogram:
        return spark.createDataFrame([], RESULT)
    parts = max(8, -(-max(histogram.values()) // PART))
    keys, packs, each, place = Plan(histogram, capacity).slots()
    shared = spark.sparkContext.broadcast((keys, packs, each, place))  # a few rows for each length
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)))
    sizes = salted.groupBy("len", "part").count()
    before = sizes.select("len", "part", (F.sum("count").over(Window.partitionBy("len").orderBy("part")) - F.col("count")).alias("before"))
    own = Window.partitionBy("len", "part").orderBy("doc_id", "start")
    numbered = salted.withColumn("i", F.row_number().over(own) - 1).join(before, ["len", "part"])
    numbered = numbered.select("doc_id", "start", "len", (F.col("before") + F.col("i")).alias("i"))

    def place_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, packs, each, place = shared.value
        for b in batches:
            i = b.column("i").to_numpy()
            length = b.column("len").to_numpy().astype(np.int64)
            at = np.searchsorted(keys, length << 40 | i, side="right") - 1
            nth = i - (keys[at] & ((1 << 40) - 1))
            pack, pos = packs[at] + nth // each[at], place[at] + nth % each[at]
            yield pa.RecordBatch.from_arrays([pa.array(pack), pa.array(pos.astype(np.int32)), b.column("doc_id"), b.column("start"), b.column("len")], names=["pack_id", "pos", "doc_id", "start", "len"])

    placed = numbered.mapInArrow(place_pieces, "pack_id long, pos int, doc_id long, start long, len int")
    packed = placed.groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct("pos", "doc_id", "start", "len"))).alias("p"), F.sum("len").cast("int").alias("used"))
    return packed.select("pack_id", "used", F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"), F.col("p.len").alias("lengths"))


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, counter: Counted | None = None) -> DataFrame:
    """Packs of at most ``capacity`` tokens: ``pack_id`` (from 0 on), ``used`` tokens, and in order of place the pieces'
    ``doc_ids``, ``starts`` (token of the document) and ``lengths``.

    A document's tokens, its end counted as one more, are in the packs exactly once; one longer than a pack is cut
    into pieces of ``capacity`` and a rest. ``counter`` counts the tokens of a list of texts (by default the BPE at
    ``TOKENIZER``). Null and empty texts have no tokens and are in no pack. Rows without an id are packed with a
    null id; repeated rows are packed each; other columns are ignored; no documents give no packs.
    """
    return pack_lengths(token_lengths(docs, counter or bpe_counter()), capacity)
