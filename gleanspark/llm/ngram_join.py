"""N-gram Jaccard join with a count-vector R-tree.

A document is the set of its word n-grams. The grams are hashed into groups and the numbers per group make a
point; two sets can't share more grams than the sum of their points' coordinate minima, and a set can't share
more with any point of a box than with the box's upper corner. The R-tree over the points prunes with that bound,
and what survives is verified on the gram sets themselves. A point has about as many groups as its set has grams
(a power of two, so that points of different lengths are folded to one), for in a few wide groups the minima of
unlike texts are as large as those of copies.

One tree over a corpus is searched nearly in full by every row, for upper boxes are wider than the distance of
unlike texts. Minhash bands therefore bring together documents that may be similar, and each bucket of a band is
searched by its own tree. Of the pairs that the bound leaves a bucket gives a spanning forest alone, never all
pairs; the forests' connected families are then verified: small ones many to a task, large ones as pairs of leaves
(ranges of set size, salted). A bucket of more than ``BUCKET_DOCS`` documents links all to its smallest id, which
loses nothing: verification decides. A pair of similarity 0.5 shares no band with a probability of two in ten
thousand, one of 0.6 of two in ten million; every other pair is found.

Sets that are equal are one point: copies follow the smallest id of their set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gleanspark.llm.common import by_position, by_slices, checkpointed, maybe_broadcast, mix64, offsets_of, pick, whole_groups, window_hashes, without_ids, words, written

N = 3
#: Copies edited here and there come down to 0.5; unlike texts that share a passage stay below.
THRESHOLD = 0.5
#: Groups of a point, at least and at most.
GROUPS, MOST_GROUPS = 64, 4096
BANDS, BAND_ROWS = 64, 3
#: Documents of a bucket that is searched by a tree; larger buckets are linked whole.
BUCKET_DOCS = 2000
#: Buckets of up to so many documents compare their points without a tree.
PLAIN_DOCS = 24
#: Documents and grams of a leaf.
LEAF_DOCS, LEAF_GRAMS = 1000, 2_000_000
FANOUT = 16


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of each document, flat, and their offsets. A text of fewer than ``n`` words is one gram."""
    t, hashes = words(texts)
    value = hashes[t.codes]
    lengths = np.diff(t.offsets)
    grams, start = window_hashes(value, t.offsets, n)
    doc = np.searchsorted(t.offsets, start, side="right") - 1
    extra_doc, extra = [], []
    for d in np.flatnonzero((lengths > 0) & (lengths < n)):
        with np.errstate(over="ignore"):
            v = np.uint64(lengths[d])
            for x in value[t.offsets[d] : t.offsets[d + 1]]:
                v = v * np.uint64(0x100000001B3) + x
        extra_doc.append(d)
        extra.append(v)
    if extra:
        doc = np.concatenate([doc, np.array(extra_doc, doc.dtype)])
        grams = np.concatenate([grams, mix64(np.array(extra, np.uint64))])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(grams), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    doc, grams = doc[new], grams[new]
    return grams, offsets_of(np.bincount(doc, minlength=len(texts)))


_random = np.random.default_rng(20240607)
_ODD = _random.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_ADD = _random.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)


def bands(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minhash bands (documents x BANDS, int64) of the non-empty sets that begin at ``starts``."""
    out = np.empty((len(starts), BANDS), np.uint64)
    high = (grams >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            acc = np.full(len(starts), b + 1, np.uint64)
            for r in range(b * BAND_ROWS, (b + 1) * BAND_ROWS):
                a, c = np.uint32(int(_ODD[r]) & 0xFFFFFFFF), np.uint32(int(_ADD[r]) & 0xFFFFFFFF)
                least = np.minimum.reduceat(high * a ^ c, starts)
                acc = mix64(acc ^ least.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out[:, b] = acc
    return out.view(np.int64)


FEATURES = "doc_id long, set_key long, n_grams int, bands array<long>"


def _set_keys(grams: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(np.add.reduceat(mix64(grams), starts) + sizes.astype(np.uint64)).view(np.int64)


def features(docs: DataFrame, n: int) -> DataFrame:
    """A row for each row of ``docs``: the key of its gram set (null without a word), the set's size, its minhash bands."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams, offsets = gram_sets(batch.column("text"), n)
        size = np.diff(offsets)
        some = np.flatnonzero(size)
        keys, lists = np.zeros(len(size), np.int64), np.empty(0, np.int64)
        if len(some):
            starts = offsets[:-1][some]
            lists, keys[some] = bands(grams, starts).ravel(), _set_keys(grams, starts, size[some])
        ends = offsets_of(np.where(size > 0, BANDS, 0)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(keys, mask=size == 0), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(lists))],
            names=["doc_id", "set_key", "n_grams", "bands"],
        )

    return docs.mapInArrow(by_slices(run), FEATURES)


def families(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) as (node, root), root being the smallest id: alternating large and small stars."""
    e = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")).select("s.*")
        e = checkpointed(small.filter("u <> v").distinct())
        # every round shortens the paths to the roots, until a round changes nothing
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


# --- the tree --------------------------------------------------------------------------------------------


class CountTree:
    """R-tree over count vectors, packed by sorting on size and then on the widest coordinates; holds upper corners."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = self._pack(points)
        upper = points[self.order]
        total = points.sum(1)[self.order]
        self.levels = []  # from leaves to root: first child, last child, upper corner, least and most size
        lo, hi, least, most = np.arange(len(points)), np.arange(len(points)) + 1, total, total
        while len(lo) > 1:
            cut = np.arange(0, len(lo), FANOUT)
            upper, least, most = np.maximum.reduceat(upper, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut)
            lo, hi = cut, np.append(cut[1:], len(lo))
            self.levels.append((lo, hi, upper, least, most))

    @staticmethod
    def _pack(points: np.ndarray) -> np.ndarray:
        wide = np.argsort(-points.var(0), kind="stable")[:3]
        return np.lexsort((points[:, wide[2]], points[:, wide[1]], points[:, wide[0]], points.sum(1)))

    def search(self, point: np.ndarray, t: float) -> np.ndarray:
        """Points that may have a Jaccard similarity of at least ``t`` with a set of this point."""
        size = int(point.sum())
        if self.levels:
            nodes = np.arange(len(self.levels[-1][0]))
            for lo, hi, upper, least, most in reversed(self.levels):
                can = np.minimum(upper[nodes], point).sum(1)
                # J >= t needs overlap >= t / (1 + t) * (|a| + |b|), and sizes within a factor t
                ok = (can * (1 + t) >= t * (size + least[nodes]) - 1e-9) & (most[nodes] >= t * size - 1e-9) & (least[nodes] * t <= size + 1e-9)
                nodes = nodes[ok]
                if not len(nodes):
                    return nodes
                nodes = np.concatenate([np.arange(lo[i], hi[i]) for i in nodes])
        else:
            nodes = np.arange(len(self.points))
        found = self.order[nodes]
        overlap = np.minimum(self.points[found], point).sum(1)
        return found[overlap * (1 + t) >= t * (size + self.points[found].sum(1)) - 1e-9]


def groups_of(n_grams: np.ndarray) -> np.ndarray:
    """Groups of the points of sets of these sizes: the next power of two, within bounds."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(n_grams, 1))).astype(np.int64), GROUPS, MOST_GROUPS)


def points(grams: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Each set's point: grams per group, in one, two or four bytes each."""
    out = []
    for i, g in enumerate(groups_of(np.diff(offsets))):
        c = np.bincount((grams[offsets[i] : offsets[i + 1]] & np.uint64(g - 1)).astype(np.int64), minlength=g)
        out.append(c.astype(np.min_scalar_type(c.max(initial=0))).tobytes())
    return out


def folded(raw: list[bytes], own: np.ndarray, groups: int) -> np.ndarray:
    """Points as rows of ``groups`` coordinates; those of more are folded, which adds what falls together."""
    out = np.zeros((len(raw), groups), np.int32)
    for i, (x, g) in enumerate(zip(raw, own, strict=True)):
        c = np.frombuffer(x, f"u{len(x) // g}")
        out[i] = c if g == groups else c.reshape(-1, groups).sum(0, dtype=np.int32)
    return out


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest that the edges connect it with."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def bucket_forest(start: np.ndarray, size: np.ndarray, n_grams: np.ndarray, raw: list[bytes], t: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, row) that connect, within buckets (``start``, ``size``), what pairs within the bound connect."""
    own = groups_of(n_grams)
    left, right = [], []
    for c in np.unique(size[size <= PLAIN_DOCS]):
        i, j = np.triu_indices(c, 1)
        left.append((start[size == c][:, None] + i).ravel())
        right.append((start[size == c][:, None] + j).ravel())
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    near = np.minimum(n_grams[a], n_grams[b]) >= t * np.maximum(n_grams[a], n_grams[b]) - 1e-9
    a, b = a[near], b[near]
    level, ok = np.minimum(own[a], own[b]), np.zeros(len(a), bool)
    for g in np.unique(level):
        at = np.flatnonzero(level == g)
        rows, place = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        x = folded([raw[r] for r in rows], own[rows], g)
        for k in range(0, len(at), 4096):
            p, q = place[: len(at)][k : k + 4096], place[len(at) :][k : k + 4096]
            shared = np.minimum(x[p], x[q]).sum(1)
            one, other = n_grams[a[at[k : k + 4096]]], n_grams[b[at[k : k + 4096]]]
            ok[at[k : k + 4096]] = shared * (1 + t) >= t * (one + other) - 1e-9
    label = _labels(len(raw), a[ok], b[ok])
    u, v = [label[label != np.arange(len(label))]], [np.flatnonzero(label != np.arange(len(label)))]
    for s, c in zip(start[size > PLAIN_DOCS], size[size > PLAIN_DOCS], strict=True):
        for x, y in _tree_forest(n_grams[s : s + c], raw[s : s + c], own[s : s + c], t):
            u.append(s + x)
            v.append(s + y)
    return np.concatenate(u), np.concatenate(v)


def _tree_forest(n_grams: np.ndarray, raw: list[bytes], own: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for one bucket, by trees: breadth first from one point to another, until none is left to be reached.

    Points are of one length within a tree, so there is one for each length, of all sets that are as large and may be similar.
    """
    trees = {}
    for g in np.unique(own):
        # a point is compared at the smaller of two lengths, so each is searched for at its own and at smaller ones
        rows = np.flatnonzero((own >= g) & (own <= max(g, 2 * g / t)))
        trees[g] = (rows, CountTree(folded([raw[r] for r in rows], own[rows], g)))
    place = {g: {r: k for k, r in enumerate(rows)} for g, (rows, _) in trees.items()}
    open_, waiting = np.ones(len(raw), bool), []
    while open_.any():
        if not waiting:
            waiting = [int(np.flatnonzero(open_)[0])]
            open_[waiting[0]] = False
        x = waiting.pop()
        for g, (rows, tree) in trees.items():
            if x not in place[g]:
                continue
            found = rows[tree.search(tree.points[place[g][x]], t)]
            found = found[open_[found] & ((own[found] == g) | (own[x] == g))]
            if len(found):
                open_[found] = False
                waiting += found.tolist()
                yield np.full(len(found), x), found


def link_families(root: np.ndarray, side: np.ndarray, copies: np.ndarray, grams: np.ndarray, offsets: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """For each set the number of documents whose similarity with it is at least ``t``, and the smallest place that similar pairs connect it with.

    Sets are compared within a ``root``; where a root has sets of both sides (0 and 1), one side's with the other's. Grams of one set alone are
    shared with none: the others make a matrix, whose products are the overlaps.
    """
    links, label = np.zeros(len(root), np.int64), np.arange(len(root))
    order = np.argsort(root, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
        if len(rows) < 2:
            continue
        size = offsets[rows + 1] - offsets[rows]
        flat = np.concatenate([grams[offsets[r] : offsets[r + 1]] for r in rows])
        _, code, n = np.unique(flat, return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(len(rows)), size)
        common = n[code] > 1
        number = np.cumsum(n > 1) - 1
        doc, code = doc[common], number[code[common]]
        by_code = np.argsort(code, kind="stable")
        doc, code = doc[by_code], code[by_code]
        one = np.flatnonzero(side[rows] == 0)
        two = np.flatnonzero(side[rows] == 1) if side[rows].any() else one
        overlap = np.zeros((len(one), len(two)))
        wide = 2048
        for k in range(0, int(n.size and (n > 1).sum()), wide):
            a, z = np.searchsorted(code, [k, k + wide])
            m = np.zeros((len(rows), wide), np.float32)
            m[doc[a:z], code[a:z] - k] = 1
            overlap += m[one] @ m[two].T
        near = overlap * (1 + t) >= t * (size[one][:, None] + size[two][None]) - 1e-9
        near[one[:, None] == two[None]] = False
        links[rows[one]] += near @ copies[rows[two]]
        if two is not one:
            links[rows[two]] += near.T @ copies[rows[one]]
        p, q = np.nonzero(near)
        label[rows] = rows[_labels(len(rows), one[p], two[q])]
    return links, label


RESULT = "doc_id long, class_id long, n_links long"


def ngram_jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Near duplicates, a row for each ``doc_id``: ``n_links``, how many other documents' sets of word n-grams have a Jaccard similarity of
    at least ``threshold`` with its own, and ``class_id``, the smallest id that chains of such links connect it with (its own without any).

    Words are lower case without outer signs; a text of fewer than ``n`` words is one gram; one without a word
    (null and empty texts too) is near to none. Rows without an id are left out. Repeated rows count once; of
    rows that share an id with different texts the one of the smallest set key counts, one with a word first. Other
    columns are ignored; texts are taken whole; an empty table gives no rows. Links are found as the module's text says.
    """
    source = pick(docs, "doc_id", "text").filter("doc_id is not null")
    own = F.min(F.when(F.col("set_key").isNotNull(), F.struct("set_key", "n_grams", "bands"))).alias("f")
    f = written(features(source, n).groupBy("doc_id").agg(own, F.count(F.lit(1)).alias("rows")).select("doc_id", "rows", "f.*"))
    again = not f.filter("rows > 1").isEmpty()
    sets = f.filter("set_key is not null").groupBy("set_key")
    reps = written(sets.agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")))
    each, whole = bucket_members(reps)
    sized = reps.select("rep", "set_key", "n_grams").join(each.select("rep").union(whole.select(F.explode(F.array("a", "b")))).distinct(), "rep")
    sets = set_rows(source, again, sized, n)
    member = checkpointed(families(bucket_links(each.join(sets.select("rep", "n_grams", "point"), "rep"), threshold).unionByName(whole)))
    member = member.unionByName(member.select(F.col("root").alias("node"), "root").distinct())
    linked = verified(sets.select("rep", "grams"), member.join(reps.select("rep", "copies", "n_grams"), F.col("node") == F.col("rep")), threshold)
    per_set = reps.select("set_key", "rep", "copies").join(linked, "rep", "left")
    per_set = per_set.select("set_key", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = f.select("doc_id", "set_key").join(per_set, "set_key", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def bucket_members(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The buckets of bands with more than one member: (bucket, rep), and of those that are linked whole (a, b)."""
    banded = reps.select("rep", F.explode("bands").alias("h"))  # a band's number is in its hash
    buckets = banded.groupBy("h").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    inside = checkpointed(banded.join(buckets, "h"))
    whole = inside.filter(F.col("c") > BUCKET_DOCS).filter("rep <> a").select("a", F.col("rep").alias("b"))
    # the same documents meet in many bands: each set of them is searched once
    lists = inside.filter(F.col("c") <= BUCKET_DOCS).groupBy("h").agg(F.sort_array(F.collect_list("rep")).alias("reps")).select("reps").distinct()
    # a key that two lists may share by chance: then they are searched as one
    return checkpointed(lists.select(F.xxhash64("reps").alias("bucket"), F.explode("reps").alias("rep")).distinct()), whole


def bucket_links(members: DataFrame, t: float) -> DataFrame:
    """(a, b): forests over the buckets, of pairs that the points leave possible; members are (bucket, rep, n_grams, point)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bucket"):
            keys, ids = table.column("bucket").to_numpy(), table.column("rep").to_numpy()
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            u, v = bucket_forest(start, np.diff(np.append(start, len(keys))), table.column("n_grams").to_numpy().astype(np.int64), table.column("point").to_pylist(), t)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], names=["a", "b"])

    return members.repartition("bucket").sortWithinPartitions("bucket", "rep").mapInArrow(run, "a long, b long")


def set_rows(source: DataFrame, again: bool, reps: DataFrame, n: int) -> DataFrame:
    """(rep, n_grams) of ``reps`` (with set_key) with their sets' ``point`` and ``grams``; of rows that share an id (where ids come ``again``) one of the chosen set."""
    texts = source.join(maybe_broadcast(written(reps)), F.col("doc_id") == F.col("rep")).select("rep", "n_grams", "set_key", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        flat, offsets = gram_sets(batch.column("text"), n)
        size = np.diff(offsets)
        some = np.flatnonzero(size)
        if not len(some):
            return None
        keys = np.zeros(len(size), np.int64)
        keys[some] = _set_keys(flat, offsets[:-1][some], size[some])
        right = np.flatnonzero((size > 0) & (keys == batch.column("set_key").to_numpy()))
        rows = pa.array(right)
        grams = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int64))).take(rows)
        point = pa.array(points(flat, offsets), pa.binary()).take(rows)
        return pa.RecordBatch.from_arrays([batch.column("rep").take(rows), batch.column("n_grams").take(rows), point, grams], names=["rep", "n_grams", "point", "grams"])

    out = texts.mapInArrow(by_slices(run), "rep long, n_grams int, point binary, grams array<long>")
    return written(out.dropDuplicates(["rep"]) if again else out)


def leaf_pairs(large: DataFrame, t: float) -> DataFrame:
    """The tasks of large families: leaves of a size class (within a factor of two), salted, and each pair of leaves whose sizes allow the similarity."""
    large = large.withColumn("size", F.floor(F.log2("n_grams")).cast("int"))
    classes = large.groupBy("root", "size").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_grams").alias("grams"), F.max("n_grams").alias("most"), F.min("n_grams").alias("least"))
    classes = checkpointed(classes.withColumn("salts", F.greatest(F.ceil(F.col("docs") / LEAF_DOCS), F.ceil(F.col("grams") / LEAF_GRAMS)).cast("int")))
    leaves = classes.select("root", "size", "most", "least", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    a, b = leaves.alias("a"), leaves.alias("b")
    ordered = (F.col("a.size") < F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.salt") <= F.col("b.salt")))
    pairs = a.join(b, (F.col("a.root") == F.col("b.root")) & ordered & (F.col("b.least") * t <= F.col("a.most") + 1e-9))
    key = F.xxhash64("a.root", "a.size", "a.salt", "b.size", "b.salt")
    same = (F.col("a.size") == F.col("b.size")) & (F.col("a.salt") == F.col("b.salt"))
    end = lambda x, s: F.struct(F.col(f"{x}.size").alias("size"), F.col(f"{x}.salt").alias("salt"), F.lit(s).alias("side"))
    ends = pairs.select(F.col("a.root").alias("root"), key.alias("task"), F.explode(F.when(same, F.array(end("a", 0))).otherwise(F.array(end("a", 0), end("b", 1)))).alias("e"))
    ends = checkpointed(ends.select("root", "task", "e.*"))
    salted = large.join(maybe_broadcast(classes.select("root", "size", "salts")), ["root", "size"]).withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int"))
    return salted.join(maybe_broadcast(ends), ["root", "size", "salt"]).select("rep", "root", "copies", "task", "side", F.lit(True).alias("leaf"))


def verified(sets: DataFrame, member: DataFrame, t: float) -> DataFrame:
    """(rep, class_id, links) of the ``sets`` (rep, grams) of families: members are (node, root, rep, copies, n_grams)."""
    member = checkpointed(member.select("rep", "root", "copies", "n_grams"))
    per_family = member.groupBy("root").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_grams").alias("grams"))
    per_family = checkpointed(per_family.withColumn("large", (F.col("docs") > LEAF_DOCS) | (F.col("grams") > LEAF_GRAMS)))
    total = per_family.filter("not large").agg(F.sum("docs"), F.sum("grams")).first()
    bins = 1 + max((total[0] or 0) // LEAF_DOCS, (total[1] or 0) // LEAF_GRAMS)
    kinds = checkpointed(member.join(maybe_broadcast(per_family.select("root", "large")), "root"))
    # small families: many to a task
    small = kinds.filter("not large").select("rep", "root", "copies", F.pmod(F.xxhash64("root"), F.lit(bins)).alias("task"), F.lit(0).alias("side"), F.lit(False).alias("leaf"))
    any_large = not per_family.filter("large").isEmpty()
    tasks = (small.unionByName(leaf_pairs(kinds.filter("large"), t)) if any_large else small).join(sets, "rep")

    def run(table: pa.Table) -> pa.Table:
        ids, side = table.column("rep").to_numpy(), table.column("side").to_numpy()
        rows = np.argsort(ids)  # so that the smallest place of a class is its smallest id
        column = table.column("grams").combine_chunks().take(pa.array(rows))
        off, flat = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
        links, label = link_families(table.column("root").to_numpy()[rows], side[rows], table.column("copies").to_numpy()[rows], flat, off, t)
        return pa.table({"rep": ids[rows], "first": ids[rows][label], "links": links, "leaf": table.column("leaf").to_numpy(zero_copy_only=False)[rows]})

    found = checkpointed(tasks.groupBy("leaf", "task").applyInArrow(run, "rep long, first long, links long, leaf boolean"))
    known = found.filter("not leaf").select("rep", F.col("first").alias("class_id"), "links")
    if not any_large:
        return known
    # the classes of large families go through several tasks
    across = families(found.filter("leaf and first <> rep").select(F.col("first").alias("a"), F.col("rep").alias("b")))
    of_leaves = found.filter("leaf").groupBy("rep").agg(F.sum("links").alias("links")).join(across.withColumnRenamed("node", "rep"), "rep", "left")
    return known.unionByName(of_leaves.select("rep", F.coalesce("root", "rep").alias("class_id"), "links"))


def drop_near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, with their columns, less all of a group of near duplicates but that of the smallest id.

    Rows without an id stay, and so do texts without a word. Of rows that repeat an id the one of the smallest text stays.
    """
    left = without_ids(docs, ngram_jaccard_join(docs, n, threshold).filter("doc_id <> class_id").select("doc_id"))
    again = checkpointed(pick(docs, "doc_id").filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if again.isEmpty():
        return left
    plain, at = by_position(left)
    doc, marked = F.col(at["doc_id"]), again.toDF("again")
    order = Window.partitionBy(doc).orderBy(at["text"], *[F.xxhash64(c) for c in plain.columns])
    one = plain.join(marked, doc == F.col("again"), "left_semi").withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")
    return plain.join(marked, doc == F.col("again"), "left_anti").unionByName(one).toDF(*docs.columns)


def sql(n: int = N, threshold: float = THRESHOLD) -> str:
    """The rows of ``ngram_jaccard_join`` by an inverted index over all grams."""
    gram = "||' '||".join(f"w[i + {k}]" if k else "w[i]" for k in range(n))
    return rf"""
    with recursive d as (
        select doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[ \t\n\r\f\v]+'),
            lambda x: lower(regexp_replace(x, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'))), lambda x: x <> '') w from documents),
    g as (
        select doc_id, case when len(w) < {n} then [list_aggregate(w, 'string_agg', ' ')]
            else list_sort(list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: {gram}))) end g from d where len(w) > 0),
    sets as materialized (select g, min(doc_id) rep, list(doc_id) ids, count(*) copies from g group by g),
    flat as (select rep, len(g) n, copies, unnest(g) x from sets),
    half as materialized (
        select a.rep a, b.rep b, any_value(a.copies) ca, any_value(b.copies) cb from flat a join flat b on a.x = b.x and a.rep < b.rep
        group by 1, 2 having count(*) >= {threshold} * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
    links as materialized (select a, b, cb c from half union all select b, a, ca from half),
    reach as (select rep, rep to_ from sets union select r.rep, l.b from reach r join links l on l.a = r.to_),
    class as (select rep, min(to_) class_id from reach group by rep),
    n as (select a rep, sum(c) n from links group by a),
    per as (select unnest(ids) doc_id, class_id, cast(copies - 1 + coalesce(n.n, 0) as bigint) n_links from sets join class using (rep) left join n using (rep))
    select doc_id, coalesce(class_id, doc_id) class_id, coalesce(n_links, 0) n_links from d left join per using (doc_id)"""
