"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by a pseudo-random rotation (three rounds of random signs and a fast Hadamard transform) and
hashed to the nearest of the signed axes; a table combines one or two such hashes. A query looks into the buckets
of its own hash and of the next nearest axes (multiprobe), in each table, and all vectors found there are ranked
by their exact cosines.

How many buckets have to be probed for a recall depends on the data alone: near copies need one, vectors spread
evenly over the sphere need many. It is measured: the exact neighbours of a bounded sample of queries are found
over all vectors, and for several numbers of tables the least number of probes is taken that finds the wanted part
of them, both for the half of the sample whose neighbours are near and for the half whose neighbours are far. Of
these the cheapest is used: a table costs another copy of the index in the shuffle, and saves ranking.

The index lies in shards of about ``SHARD_ROWS`` vectors of neighbouring buckets; a bucket larger than a shard is
split by hashes of ids. A query goes once to each shard in which it probes a bucket, with the distance up to which
it probes, so that no list of buckets travels; a shard's task holds its vectors and streams the queries past
them. Nothing is left out for being in a large bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.llm.common import checkpointed, lowest_hashes, mix64, pick

K = 10
#: The rows whose id is divisible by this are the queries.
QUERY_STEP = 20
#: Numbers of tables that are tried.
TABLES = (1, 2, 4, 8)
#: The part of the sample's true neighbours that the probes must find; above 0.9 by a margin for the sample's error.
RECALL = 0.94
#: Queries and vectors of the samples by which tables and probes are chosen.
SAMPLE, SAMPLE_ROWS = 256, 20_000
SHARD_ROWS = 20_000
#: Queries that a task streams, about; a shard that more visit is copied.
SHARD_QUERIES = 1_000_000
#: Two hashes are combined where buckets then have so many vectors on average, and there are so many buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 64, 1 << 16
BLOCK = 256
#: For the choice: bytes shuffled and operations done in a second.
SENT, DONE = 50e6, 5e9


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (their length a power of two), scaled to keep lengths."""
    n = x.shape[1]
    step = 1
    while step < n:
        y = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        step *= 2
    return x / np.float32(np.sqrt(n))


@dataclass
class Tables:
    """The hash functions: signs of the rotations' rounds (tables x parts x rounds x dimension)."""

    signs: np.ndarray

    @classmethod
    def make(cls, dim: int, tables: int, parts: int, seed: int = 11) -> Tables:
        wide = 1 << max(1, int(dim - 1).bit_length())
        return cls(np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (tables, parts, 3, wide)))

    @property
    def buckets(self) -> int:
        return (2 * self.signs.shape[3]) ** self.signs.shape[1]

    def rotated(self, x: np.ndarray, table: int, part: int) -> np.ndarray:
        wide = self.signs.shape[3]
        y = np.zeros((len(x), wide), np.float32)
        y[:, : x.shape[1]] = x
        for s in self.signs[table, part]:
            y = hadamard(y * s)
        return y

    def bucket(self, x: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each row: its nearest signed axes."""
        out = np.zeros(len(x), np.int64)
        for part in range(self.signs.shape[1]):
            y = self.rotated(x, table, part)
            axis = np.abs(y).argmax(1)
            out = out * (2 * y.shape[1]) + axis + y.shape[1] * (y[np.arange(len(y)), axis] < 0)
        return out

    def distances(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """For each part, how far each row would have to move for another signed axis to be the nearest (squared)."""
        out = []
        for part in range(self.signs.shape[1]):
            y = self.rotated(x, table, part)
            both = np.concatenate([y, -y], 1)
            out.append((both.max(1, keepdims=True) - both) ** 2)
        return out


def at_buckets(away: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
    """Distances of the rows from these buckets: the sums of the parts'."""
    out = np.zeros((len(away[0]), len(codes)), np.float32)
    for k, d in enumerate(away):
        out += d[:, codes // d.shape[1] ** (len(away) - 1 - k) % d.shape[1]]
    return out


def reach(away: list[np.ndarray], n: int) -> np.ndarray:
    """The distance of each row's n-th nearest bucket."""
    return np.partition(at_buckets(away, np.arange(away[0].shape[1] ** len(away))), n - 1, axis=1)[:, n - 1]


def reach_of_rows(cost: np.ndarray, rows: np.ndarray, least: int) -> np.ndarray:
    """The distance within which each row's nearest buckets hold ``least`` vectors (all of them, where there are fewer)."""
    order = np.argsort(cost, axis=1, kind="stable")
    short = (np.cumsum(rows[order], 1) < least).sum(1)
    return np.take_along_axis(cost, order, 1)[np.arange(len(cost)), np.minimum(short, len(rows) - 1)]


# --- vectors in and out of Arrow -------------------------------------------------------------------------


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors packed as binary float32."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, int]:
    """(id, v): one unit vector an id, of the table's most frequent length, as bytes; that length, and how many there are."""
    named = pick(vectors, id_col, vector_col).toDF("id", "v").filter("id is not null and size(v) > 0")
    common = named.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = common["d"] if common else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("v").flatten().cast(pa.float64())
            x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
            size = np.sqrt((x * x).sum(1))
            ok = np.flatnonzero(np.isfinite(size) & (size > 0))
            x = (x[ok] / size[ok, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(ok)), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "v"])

    packed = named.filter(F.size("v") == dim).select(F.col("id").cast("long").alias("id"), "v").mapInArrow(run, "id long, v binary")
    out = checkpointed(packed.groupBy("id").agg(F.min("v").alias("v")))
    return out, dim, out.count()


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each row with their ids (unordered); ties at the border go to the smaller ids."""
    if scores.shape[1] <= k:
        return scores, np.broadcast_to(ids, scores.shape)
    at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    best = np.take_along_axis(scores, at, 1)
    border = best.min(1)
    # where more rows have the border's score than fit, the choice among them is made by id
    for i in np.flatnonzero((scores == border[:, None]).sum(1) > (best == border[:, None]).sum(1)):
        order = np.lexsort((ids, -scores[i]))[:k]
        at[i], best[i] = order, scores[i][order]
    return best, ids[at]


def exact_neighbours(vectors: DataFrame, dim: int, q_ids: np.ndarray, q: np.ndarray, k: int) -> list[list[tuple[int, float, bytes]]]:
    """Brute force for a bounded number of queries: each one's k nearest of all ``vectors`` (itself left out)."""
    shared = vectors.sparkSession.sparkContext.broadcast((q_ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        for b in batches:
            ids, x = b.column("id").to_numpy(), matrix(b.column("v"), dim)
            if not len(ids):
                continue
            s = q @ x.T
            s[q_ids[:, None] == ids[None]] = -np.inf
            top = np.argpartition(-s, k - 1, axis=1)[:, :k] if s.shape[1] > k else np.tile(np.arange(s.shape[1]), (len(q), 1))
            row = np.repeat(np.arange(len(q)), top.shape[1])
            flat = top.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(ids[flat]), pa.array(s[row, flat].astype(np.float64)), b.column("v").take(pa.array(flat))], names=["q", "id", "s", "v"])

    near = vectors.mapInArrow(run, "q long, id long, s double, v binary").filter("s > double('-inf')")
    best = near.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "id", "v")), asc=False), 1, k).alias("n")).collect()
    out: list = [[] for _ in q_ids]
    for r in best:
        out[r["q"]] = [(x["id"], x["s"], bytes(x["v"])) for x in r["n"]]
    return out


def choose(vectors: DataFrame, dim: int, n: int, n_asks: int, step: int, k: int, recall: float) -> tuple[Tables, int, float]:
    """The hash functions, the number of probes a table that reach the recall on the sample, and the part of all vectors ranked by a query."""
    hashed = vectors.withColumn("o", F.xxhash64("id"))
    asks = hashed.filter(F.pmod("id", F.lit(step)) == 0)
    sample = lowest_hashes(asks, "o", n_asks, SAMPLE).orderBy("o", "id").limit(SAMPLE).toArrow()
    q_ids, q = sample.column("id").to_numpy(), matrix(sample.column("v"), dim)
    rows = matrix(lowest_hashes(hashed, "o", n, SAMPLE_ROWS).orderBy("o", "id").limit(SAMPLE_ROWS).select("v").toArrow().column("v"), dim)
    truth = exact_neighbours(vectors, dim, q_ids, q, k)
    row = np.repeat(np.arange(len(q)), [len(t) for t in truth])
    found = np.frombuffer(b"".join(v for t in truth for _, _, v in t), np.float32).reshape(-1, dim)
    farthest = np.array([t[-1][1] if t else 1.0 for t in truth])
    far = (farthest <= np.median(farthest))[row] if len(row) else np.empty(0, bool)
    halves = [x for x in (far, ~far) if x.any()]
    full = Tables.make(dim, max(TABLES), 2)
    full = full if full.buckets <= MOST_BUCKETS and n / full.buckets >= BUCKET_ROWS else Tables(full.signs[:, :1])
    rank, ranked = np.full(len(row), full.buckets), np.zeros((len(q), full.buckets))
    best = None
    for t in range(max(TABLES)):
        cost = at_buckets(full.distances(q, t), np.arange(full.buckets))
        order = np.argsort(cost, axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(full.buckets)[None], 1)
        rank = np.minimum(rank, place[row, full.bucket(found, t)])
        share = np.bincount(full.bucket(rows, t), minlength=full.buckets) / max(1, len(rows))
        ranked += np.cumsum(share[order], 1)
        if t + 1 not in TABLES:
            continue
        probes = max([int(np.searchsorted(np.cumsum(np.bincount(rank[x], minlength=full.buckets + 1)) / x.sum(), recall)) + 1 for x in halves], default=1)
        probes = min(probes, full.buckets)
        part = float(ranked[:, probes - 1].mean()) if len(q) else 0.0
        seconds = (t + 1) * n * 4 * dim / SENT * (1 + n_asks / SHARD_ROWS) + n_asks * part * n * 2 * dim / DONE
        if best is None or seconds < best[0]:
            best = (seconds, Tables(full.signs[: t + 1]), probes, part)
    return best[1:]


# --- the search ------------------------------------------------------------------------------------------

RESULT = "vec_id long, rank int, neighbor_id long, cosine double"


def ann_search(vectors: DataFrame, k: int = K, recall: float = RECALL, step: int = QUERY_STEP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For every vector whose id is divisible by ``step`` its nearest others of all vectors: ``vec_id``, ``rank`` (from 1 to at most ``k``),
    ``neighbor_id``, ``cosine`` (six places).

    Cosines are exact; the search for candidates finds about ``recall`` of the true neighbours, and goes on until there are ``k``. Equal cosines are
    ranked by the smaller id. Rows without an id or a vector, vectors of nought or with a null or endless entry, and
    those whose length isn't the table's most frequent (the smaller of two as frequent) are left out. Of rows that
    share an id one vector counts. Copies of a vector under other ids are neighbours like any other. Other
    columns are ignored; a single vector has no neighbours, and an empty table gives no rows.
    """
    spark = vectors.sparkSession
    base, dim, n = unit_vectors(vectors, id_col, vector_col)
    n_asks = base.filter(F.pmod("id", F.lit(step)) == 0).count()
    if n < 2 or not n_asks:
        return spark.createDataFrame([], RESULT)
    h, n_probes, part = choose(base, dim, n, n_asks, step, k, recall)
    tables = len(h.signs)
    functions = spark.sparkContext.broadcast(h)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors of each bucket, as far as this task goes."""
        total = np.zeros(tables * functions.value.buckets, np.int64)
        for b in batches:
            x = matrix(b.column("v"), dim)
            for t in range(tables):
                total += np.bincount(t * functions.value.buckets + functions.value.bucket(x, t), minlength=len(total))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    # at most tables x MOST_BUCKETS rows
    counted = base.mapInArrow(sizes, "code long, n long").groupBy("code").agg(F.sum("n").alias("rows")).toPandas()
    layout = spark.sparkContext.broadcast(shards(counted, h.buckets, max(1, -(-int(n_asks * part) // SHARD_QUERIES))))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ids = matrix(b.column("v"), dim), b.column("id").to_numpy()
            own, their = mix64(ids.astype(np.uint64)), mix64(ids.astype(np.uint64) + np.uint64(1))
            asks = np.flatnonzero(ids % step == 0)
            for t in range(tables):
                codes, rows, shard, split, spread = layout.value[t]
                # as a vector that is searched: to one of its bucket's parts, in each copy of the shard
                code = functions.value.bucket(x, t)
                at = np.searchsorted(codes, code)
                where = shard[at] + (own % split[at].astype(np.uint64)).astype(np.int64) * spread
                for copy in range(spread):
                    yield _rows(where + copy, 0, ids, b.column("v"), code, np.zeros(len(ids), np.float32))
                # as a query: to one copy of each shard in which it probes
                heads = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
                for i in range(0, len(asks), BLOCK):
                    q = asks[i : i + BLOCK]
                    away = functions.value.distances(x[q], t)
                    cost = at_buckets(away, codes)
                    to = np.maximum(reach(away, n_probes), reach_of_rows(cost, rows, k + 1))
                    row, col = np.nonzero(np.logical_or.reduceat(cost <= to[:, None], heads, axis=1))
                    parts = split[heads[col]]
                    row, first = np.repeat(row, parts), np.repeat(shard[heads[col]], parts)
                    nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                    copy = (their[q[row]] % np.uint64(spread)).astype(np.int64)
                    yield _rows(first + nth * spread + copy, 1, ids[q[row]], b.column("v").take(pa.array(q[row])), np.full(len(row), t), to[row])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches sorted by shard and side: a shard's vectors, then its queries."""
        at, index, ready = None, [], None
        for b in batches:
            key = b.column("shard").to_numpy() * 2 + b.column("side").to_numpy()
            for piece in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key)) + 1):
                if not len(piece):
                    continue
                part_, side = b.slice(int(piece[0]), len(piece)), int(key[piece[0]] % 2)
                if key[piece[0]] // 2 != at:
                    at, index, ready = key[piece[0]] // 2, [], None
                if side == 0:
                    index.append(part_)
                elif index:
                    ready = ready or _shard(index, dim)
                    for i in range(0, part_.num_rows, BLOCK):
                        yield _answers(functions.value, ready, part_.slice(i, BLOCK), dim, k)

    sent = base.mapInArrow(send, "shard long, side int, id long, v binary, code long, reach float")
    found = sent.repartition("shard").sortWithinPartitions("shard", "side").mapInArrow(search, "id long, near long, cos double")
    once = found.groupBy("id", "near").agg(F.max("cos").alias("cos"))  # of the tables that found it
    order = Window.partitionBy("id").orderBy(F.desc("cos"), "near")
    ranked = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("vec_id"), "rank", F.col("near").alias("neighbor_id"), F.col("cos").alias("cosine"))


def _rows(shard: np.ndarray, side: int, ids: np.ndarray, v: pa.Array, code: np.ndarray, to: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.full(len(ids), side, np.int32)), pa.array(ids), v, pa.array(code), pa.array(to.astype(np.float32))], names=["shard", "side", "id", "v", "code", "reach"])


def _shard(index: list[pa.RecordBatch], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's ids and vectors in order of their buckets, the buckets, and where each begins."""
    table = pa.Table.from_batches(index).combine_chunks()
    code = table.column("code").to_numpy()
    order = np.argsort(code, kind="stable")
    codes, start = np.unique(code[order], return_index=True)
    return table.column("id").to_numpy()[order], matrix(table.column("v"), dim)[order], codes, np.append(start, len(order))


def _answers(h: Tables, shard: tuple, queries: pa.RecordBatch, dim: int, k: int) -> pa.RecordBatch:
    """The k nearest that the shard has for each query, of the buckets that it probes."""
    ids, x, codes, start = shard
    q_ids, q = queries.column("id").to_numpy(), matrix(queries.column("v"), dim)
    probed = at_buckets(h.distances(q, int(queries.column("code")[0].as_py())), codes) <= queries.column("reach").to_numpy()[:, None]
    s = np.full((len(q), len(ids)), -np.inf, np.float32)
    for i in np.flatnonzero(probed.any(0)):
        some = np.flatnonzero(probed[:, i])
        s[some, start[i] : start[i + 1]] = q[some] @ x[start[i] : start[i + 1]].T
    s[q_ids[:, None] == ids[None]] = -np.inf
    by_id = np.argsort(ids)
    best, near = top_rows(s[:, by_id], ids[by_id], k)
    row, col = np.nonzero(best > -np.inf)
    at = by_id[np.searchsorted(ids[by_id], near[row, col])]
    # products of blocks differ in the last bits from one shape to another; the cosine that is given depends on the two vectors alone
    cos = (q[row].astype(np.float64) * x[at]).sum(1)
    return pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(ids[at]), pa.array(np.round(cos, 6))], names=["id", "near", "cos"])


def shards(counts: pd.DataFrame, buckets: int, spread: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each table: its buckets and their vectors; the first shard of each, in no descending order; the parts that a bucket's vectors are split into; the copies of a shard."""
    counts = counts.sort_values("code")
    table, code, rows = (counts["code"] // buckets).to_numpy(np.int64), (counts["code"] % buckets).to_numpy(np.int64), counts["rows"].to_numpy(np.int64)
    out, base = {}, 0
    for t in np.unique(table):
        n, split = rows[table == t], -(-rows[table == t] // SHARD_ROWS)
        # a shard begins where the vectors so far fill another one, before and after a bucket that is split
        fresh = np.append(True, np.diff((np.cumsum(n) - n) // SHARD_ROWS) > 0) | (split > 1)
        fresh[1:] |= split[:-1] > 1
        width = np.where(fresh, split, 0)
        shard = base + np.where(fresh, np.cumsum(width) - width, np.cumsum(width) - 1) * spread
        out[int(t)] = (code[table == t], n, shard, split, spread)
        base += int(width.sum()) * spread
    return out
