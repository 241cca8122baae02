"""Shared by the operators of this subpackage: column picking, checkpoints, size-checked broadcasts, Arrow tokens.

Texts are tokenised in Arrow batches: whitespace splitting, dictionary encoding and the normalisation of
the dictionary all run in Arrow's C++ kernels, so that Python touches vectors and never single words.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at a time inside a batch; bounds a worker's memory whatever the batch holds.
SLICE_BYTES = 4 << 20
#: Tables up to this size may be broadcast.
MOST_BROADCAST = 16 << 20
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, matched by exact case, so that other columns can't clash with them."""
    by_position = [f"_c{i}" for i in range(len(df.columns))]
    return df.toDF(*by_position).select(*[F.col(by_position[df.columns.index(n)]).alias(n) for n in names])


def by_position(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named by place, so that none clash (in any case), and each old name's new one. ``toDF`` names them back."""
    names = [f"_c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), {old: new for old, new in reversed(list(zip(df.columns, names, strict=True)))}


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken, name = {c.lower() for c in df.columns}, f"_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The session's own folder (``spark.checkpoint.dir``); one is made only in local mode, where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="gleanspark-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, for tables that are written and read again."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder and read from there: it survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def lowest_hashes(df: DataFrame, column: str, rows: int, most: int) -> DataFrame:
    """A superset of the ``most`` rows of the smallest hashes in ``column``, of which ``df`` has ``rows``: about twice as many.

    An ordered limit alone would have each task send ``most`` rows to the driver.
    """
    if rows <= 4 * most:
        return df
    return df.filter(F.col(column) <= F.lit(-(1 << 63) + (1 << 64) * 2 * most // rows))


def written(df: DataFrame) -> DataFrame:
    """Written as Parquet to the shared checkpoint folder and read from there: like ``checkpointed``, for tables of which later steps need single columns."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less the rows whose ``doc_id`` is among ``ids`` (distinct); rows without an id stay. The ids are broadcast only if counted few."""
    plain, at = by_position(docs)
    listed = checkpointed(ids.toDF("listed"))
    return plain.join(maybe_broadcast(listed), F.col(at["doc_id"]) == F.col("listed"), "left_anti").toDF(*docs.columns)


def maybe_broadcast(df: DataFrame, extra_bytes: int = 0) -> DataFrame:
    """``df`` (written or checkpointed) as a broadcast side if it takes ``MOST_BROADCAST`` bytes at most by its counted rows; else
    as it is, for a shuffled join. A row takes 16 bytes and 8 a column; ``extra_bytes`` is what columns of no fixed size take in all."""
    return F.broadcast(df) if df.count() * (16 + 8 * len(df.columns)) + extra_bytes <= MOST_BROADCAST else df


# --- vectors ---------------------------------------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection that spreads all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_strings(words: pa.Array) -> np.ndarray:
    """64-bit hashes that depend on the strings alone."""
    if len(words) == 0:
        return np.empty(0, np.uint64)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


@dataclass
class Tokens:
    """Words of a slice of documents: ``codes[offsets[i]:offsets[i + 1]]`` are document i's, as indices of ``vocab``."""

    codes: np.ndarray
    offsets: np.ndarray
    vocab: pa.Array

    @property
    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def raw_tokens(texts: pa.Array, newline_token: bool = False) -> Tokens:
    """Whitespace-separated pieces as they stand. With ``newline_token`` each line end is a piece of its own."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if newline_token:
        texts = pc.replace_substring(texts, "\n", " \n ")
        pieces = pc.split_pattern_regex(texts, "[ \t\r\f\v]+")
    else:
        pieces = pc.ascii_split_whitespace(texts)
    lengths = pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(pieces).dictionary_encode()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    codes = flat.indices.to_numpy(zero_copy_only=False)
    vocab = flat.dictionary
    if len(vocab) and pc.any(pc.equal(vocab, "")).as_py():
        return keep_tokens(Tokens(codes, offsets_of(lengths), vocab), pc.not_equal(vocab, "").to_numpy(zero_copy_only=False))
    return Tokens(codes, offsets_of(lengths), vocab)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def keep_tokens(t: Tokens, keep: np.ndarray) -> Tokens:
    """Without the tokens whose vocabulary entry isn't kept."""
    if keep.all():
        return t
    mask = keep[t.codes]
    before = offsets_of(mask.astype(np.int64))
    return Tokens(t.codes[mask], before[t.offsets], t.vocab)


def normal_words(vocab: pa.Array) -> pa.Array:
    """Lower case, without signs at either end."""
    return pc.utf8_lower(pc.replace_substring_regex(vocab, EDGES, ""))


def words(texts: pa.Array) -> tuple[Tokens, np.ndarray]:
    """Normal words (empty ones dropped) and the hash of each vocabulary entry."""
    t = raw_tokens(texts)
    normal = normal_words(t.vocab)
    t = keep_tokens(t, pc.not_equal(normal, "").to_numpy(zero_copy_only=False) if len(normal) else np.empty(0, bool))
    return Tokens(t.codes, t.offsets, normal), hash_strings(normal)


def window_hashes(values: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` values that stay inside a document, and their start positions (flat)."""
    total = len(values)
    if total < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(total - n + 1, np.uint64)
    factor, base = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for j in range(n):
            h += values[j : total - n + 1 + j] * factor
            factor = factor * base
    inside = np.ones(total - n + 1, bool)
    for j in range(1, n):  # a window may not start in the last n-1 places of a document
        at = offsets[1:] - j
        at = at[(at >= offsets[:-1]) & (at <= total - n)]
        inside[at] = False
    starts = np.flatnonzero(inside)
    return mix64(h[starts]), starts


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by ``key``; no more is held than a batch and a group."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        keys = t.column(key).to_numpy()
        other = np.flatnonzero(keys != keys[-1]) if len(keys) else keys
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield t.slice(0, cut).combine_chunks()
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of bounded text size (a longer document is a piece of its own)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, s in enumerate(size):
        if total + s > most and i > start:
            yield batch.slice(start, i - start)
            pa.default_memory_pool().release_unused()  # else a worker keeps what its largest slice took, for all stages to come
            start, total = i, 0
        total += s
    if start < batch.num_rows:
        yield batch.slice(start)


def by_slices(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text"):
    """A ``mapInArrow`` function that applies ``f`` to slices of bounded text size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, column):
                out = f(piece)
                if out is not None and out.num_rows:
                    yield out

    return run
