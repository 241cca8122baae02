"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders, so that a question asked again with other values has the
template of the original. Windows of template tokens are hashed and joined with the benchmark's; for each
document, item and alignment of the two the slot values of the matching windows are then compared: one value
of the item must always have become the same value there. Documents whose matches cover enough of an item, with
consistent slots, are reported, with whether the values are the item's own.

A window must hold enough literal tokens to say anything: five of eight. Where no window of an item does, windows
of twice as many tokens are tried, and so on; an item shorter than a window is one window. What is left (items that
are nearly all slots) is found by the words as they stand. ``unsearchable`` lists the items that no window covers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanspark.llm.common import EDGES, Tokens, by_slices, checkpointed, hash_strings, keep_tokens, maybe_broadcast, offsets_of, pick, raw_tokens, window_hashes, without_ids

#: Tokens a window.
WINDOW = 8
#: A window must hold so many literal tokens, or placeholders alone would match anything; one of fewer than ``WINDOW`` tokens, in proportion.
MIN_LITERALS = 5
#: Shorter items stand in any text.
MIN_TOKENS = 4
#: The part of an item's windows that a document must hold.
MIN_COVERAGE = 0.6
#: Alignments are taken together while each is so many tokens from the next at most.
MOST_SHIFT = 4
#: The prefilter has 32 bits a window of the benchmark, within these bounds (the upper one is 32 MB): two of a hash's ends are looked up.
FILTER_BITS = (22, 28)
#: Kinds of windows, first the ones that decide first: with slots for numbers, units and names; with words that
#: begin a sentence as names too, where capitalised; with slots for numbers and units only, for texts of one case; of the
#: words as they stand in lower case.
TYPED, INITIALS, CASELESS, WORDS = 0, 1, 2, 3
KINDS = (TYPED, INITIALS, CASELESS, WORDS)
#: Tokens that a window of kind ``INITIALS`` is longer: it has more slots, and needs as many literals.
LONGER = 4
#: A size of windows is this times the kind, and the tokens.
KIND = 1 << 20

NUMBER = r"^[+-]?[$€£]?[0-9]+(?:[.,:/][0-9]+)*(?:%|st|nd|rd|th)?$"
NUMBER_UNIT = r"^[+-]?[0-9]+(?:[.,][0-9]+)*(?:mm|cm|m|km|mg|g|kg|ml|l|s|ms|min|h|w|kw|v|hz|khz|mhz|ghz|kb|mb|gb|tb|usd|eur|gbp)$"
UNITS = "mm cm m km km/h mph mg g kg ml l s ms min h w kw v hz khz mhz ghz kb mb gb tb usd eur gbp meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches gram grams kilogram kilograms pound pounds liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees".split()
NUMBER_SLOT, UNIT_SLOT, NAME_SLOT, NUMBER_UNIT_SLOT = (np.uint64(x) for x in (0xA1, 0xA2, 0xA3, 0xA4))


def template(texts: pa.Array, kinds: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the kinds: per token, flat over the documents: template value, hash of the word itself, whether it is a slot; and the documents' offsets.

    A number is <NUM>; a word of measure right after a number is <UNIT>; the two in one word are <NUM-UNIT>; a
    capitalised word that doesn't begin a sentence or line, and isn't all capitals, is <NAME>. Runs of names
    count as one. Of kind ``WORDS`` no token is a slot.
    """
    t = raw_tokens(texts, newline_token=True)
    v = t.vocab
    as_bool = lambda x: x.to_numpy(zero_copy_only=False).astype(bool) if len(x) else np.empty(0, bool)
    core = pc.replace_substring_regex(v, EDGES, "")
    low = pc.utf8_lower(core)
    number = as_bool(pc.match_substring_regex(low, NUMBER))
    number_unit = as_bool(pc.match_substring_regex(low, NUMBER_UNIT))
    unit = as_bool(pc.is_in(low, value_set=pa.array(UNITS, low.type)))
    capital = as_bool(pc.match_substring_regex(core, r"^\p{Lu}\p{L}*\p{Ll}\p{L}*$"))
    ends = as_bool(pc.match_substring_regex(v, r"[.!?:][\"')\]]*$|^\n$"))
    empty = as_bool(pc.equal(low, ""))
    own = hash_strings(low)
    # a sentence begins after a piece that ends one, and with each document
    ended = np.empty(len(t.codes), bool)
    ended[:1] = True
    ended[1:] = ends[t.codes[:-1]]
    firsts = t.offsets[:-1][t.offsets[:-1] < len(t.codes)]
    ended[firsts] = True
    # signs and line ends alone are no tokens; what they say about the next token is carried over them
    blank = empty[t.codes]
    if blank.any():
        run = np.cumsum(~blank) - ~blank  # signs and the token after them share a number
        ended = np.bincount(run, ended, len(blank) + 1)[run[~blank]] > 0
        t = keep_tokens(t, ~empty)
    c = t.codes
    is_number, is_joint = number[c], number_unit[c]
    after_number = np.zeros(len(c), bool)
    after_number[1:] = is_number[:-1]
    firsts = t.offsets[:-1][t.offsets[:-1] < len(c)]
    after_number[firsts] = False
    is_unit = unit[c] & after_number
    names = {TYPED: capital[c] & ~ended, INITIALS: capital[c], CASELESS: np.zeros(len(c), bool)}
    # a run of names ends with its sentence
    heads = {TYPED: firsts, INITIALS: np.flatnonzero(ended), CASELESS: firsts}
    return [(own[c], own[c], np.zeros(len(c), bool), t.offsets) if k == WORDS else _typed(own[c], is_number, is_joint, is_unit, names[k], heads[k], t.offsets) for k in kinds]


def _typed(word, is_number, is_joint, is_unit, is_name, firsts, offsets) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    c, value, word = word, word, word.copy()
    is_name = is_name & ~is_number & ~is_unit & ~is_joint
    value = np.where(is_number, NUMBER_SLOT, np.where(is_joint, NUMBER_UNIT_SLOT, np.where(is_unit, UNIT_SLOT, np.where(is_name, NAME_SLOT, value))))
    slot = is_number | is_joint | is_unit | is_name
    # a run of names is one slot, whose word is the hash of the run
    again = np.zeros(len(c), bool)
    again[1:] = is_name[1:] & is_name[:-1]
    again[firsts] = False
    if again.any():
        heads = np.flatnonzero(~again)
        nth = np.arange(len(c)) - np.repeat(heads, np.diff(np.append(heads, len(c))))
        with np.errstate(over="ignore"):
            factor = np.multiply.accumulate(np.append(np.uint64(1), np.full(int(nth.max()), 31, np.uint64)))
            word = np.add.reduceat(word * factor[nth], heads)
        before = offsets_of((~again).astype(np.int64))
        return value[heads], word, slot[heads], before[offsets]
    return value, word, slot, offsets


def least_literals(n: int) -> int:
    return min(MIN_LITERALS, n * MIN_LITERALS // WINDOW)


def template_windows(texts: pa.Array, sizes: list[int]):
    """(size, hash, flat start, then what ``template`` gives) of the windows; those with slots need enough literals. A size is ``KIND`` x kind + tokens."""
    kinds = tuple(sorted({n // KIND for n in sizes}))
    made = dict(zip(kinds, template(texts, kinds), strict=True))
    out = []
    for size in sizes:
        kind, n = divmod(size, KIND)
        value, word, slot, offsets = made[kind]
        h, start = window_hashes(value, offsets, n)
        if kind != WORDS:
            literal = np.concatenate([[0], np.cumsum(~slot)])
            enough = literal[start + n] - literal[start] >= least_literals(n)
            h, start = h[enough], start[enough]
        out.append((size, h, start, word, slot, offsets))
    return out


def _values(word: np.ndarray, slot: np.ndarray, start: int, n: int) -> list[int]:
    w = word[start : start + n]
    return w[slot[start : start + n]].view(np.int64).tolist()


ITEM_SCHEMA = "item_id long, variant long, n int, h long, at int, slots array<long>, n_windows int"
DOC_SCHEMA = "doc_id long, n int, h long, at long, slots array<long>"


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All windows of each item; an item shorter than a window is one window of its own length. ``variant`` tells texts of one id apart."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for i, text in enumerate(batch.column("text")):
            if batch.column("item_id")[i].as_py() is None or text.as_py() is None:
                continue
            one = pa.array([text.as_py()])
            variant = int(hash_strings(one).view(np.int64)[0])
            for kind in KINDS:
                tokens = int(template(one, (kind,))[0][3][-1])
                n = min(window + LONGER * (kind == INITIALS), tokens)
                while n >= MIN_TOKENS:
                    ((size, h, start, word, slot, _),) = template_windows(one, [kind * KIND + n])
                    for x, s in zip(h, start, strict=True):
                        rows.append((batch.column("item_id")[i].as_py(), variant, size, int(x.view(np.int64)), int(s), _values(word, slot, s, n), len(h)))
                    if len(h) or n * 2 > tokens:
                        break
                    n *= 2
        if not rows:
            return None
        c = list(zip(*rows, strict=True))
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, types, strict=True)], names=["item_id", "variant", "n", "h", "at", "slots", "n_windows"])

    return pick(benchmark, "item_id", "text").mapInArrow(by_slices(run), ITEM_SCHEMA)


def matching_windows(docs: DataFrame, sizes: list[int], bits: np.ndarray) -> DataFrame:
    """The windows of ``docs`` that pass the prefilter ``bits``; it loses none of the benchmark's."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))
    mask, high = np.uint64(len(bits) - 1), np.uint64(65 - len(bits).bit_length())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        packed = shared.value
        parts = []
        ids = batch.column("doc_id").cast(pa.int64())
        for size, h, start, word, slot, offsets in template_windows(batch.column("text"), sizes):
            some = np.arange(len(h))
            for shift in (np.uint64(0), high):
                at = ((h[some] >> shift) & mask).astype(np.int64)
                some = some[(packed[at >> 3] & (128 >> (at & 7)).astype(np.uint8)) > 0]
            if not len(some):
                continue
            first = start[some]
            doc = np.searchsorted(offsets, first, side="right") - 1
            before, words = offsets_of(slot.astype(np.int64)), word[slot].view(np.int64)
            low, count = before[first], before[first + size % KIND] - before[first]
            ends = offsets_of(count)
            flat = np.arange(ends[-1]) - np.repeat(ends[:-1] - low, count)
            slots = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(words[flat], pa.int64()))
            columns = [ids.take(pa.array(doc)), pa.array(np.full(len(some), size, np.int32)), pa.array(h[some].view(np.int64)), pa.array(first - offsets[doc]), slots]
            parts.append(pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "h", "at", "slots"]))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None

    return docs.mapInArrow(by_slices(run), DOC_SCHEMA)


def prefilter(items: DataFrame, rows: int) -> np.ndarray:
    """Bits set for the benchmark's hashes, their number in proportion to its windows; what is collected can't exceed their number."""
    width = min(max((32 * rows).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    places = F.explode(F.array(*[F.expr(f"cast(shiftrightunsigned(h, {low}) & {(1 << width) - 1} as int)") for low in (0, 64 - width)]))
    slots = items.select(places.alias("b")).distinct().toPandas()["b"]
    bits = np.zeros(1 << width, bool)
    bits[slots.to_numpy(dtype=np.int64)] = True
    return bits


RESULT = "doc_id long, item_id long, matched long, coverage double, same_values boolean, consistent boolean"


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Documents that hold a benchmark item, as it stands or with other values: ``doc_id``, ``item_id``, ``matched``
    (distinct item windows found), ``coverage`` (of the item's windows), ``same_values`` (all slots have the item's
    values) and ``consistent`` (no value of the item became two different ones); only consistent rows are returned.

    An item counts as found by the windows of any one kind. Those of words as they stand (in any case)
    have no least number of literals: so items dense in numbers, units or names are found in verbatim copies.

    Documents or items without an id or a text, and items of fewer than ``MIN_TOKENS`` tokens (``unsearchable``), give no
    rows. Repeated rows of a document count once. Repeated items each give rows of their own id; of different texts of one
    item id each is judged alone, and the best counts: by kind of windows first, then by windows found, own values and coverage.
    Other columns are ignored. Texts are searched whole; an empty table of either kind gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    items = checkpointed(item_windows(benchmark, window))
    stats = items.groupBy("n").count().collect()  # one row for each window size, so at most ``window``
    sizes, n_rows = sorted(r["n"] for r in stats), sum(r["count"] for r in stats)
    if not sizes:
        return spark.createDataFrame([], RESULT)
    hits = matching_windows(pick(docs, "doc_id", "text").filter("doc_id is not null"), sizes, prefilter(items, n_rows)).distinct()
    theirs = items.select("item_id", "variant", "n", "h", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), "n_windows").distinct()
    pairs = hits.join(maybe_broadcast(theirs, 8 * window * n_rows), ["n", "h"])
    # an item's windows are judged together by alignment (document place less item place), by alignments close to
    # each other (words put in or left out), and over the whole document
    shift = F.col("at") - F.col("item_at")
    kind = F.floor(F.col("n") / KIND).cast("int")
    pairs = pairs.withColumn("kind", kind)
    in_order = Window.partitionBy("doc_id", "item_id", "variant", "kind").orderBy("shift", "at", "item_at", "slots")
    pairs = pairs.withColumn("shift", shift).withColumn("far", (F.col("shift") - F.lag("shift").over(in_order) > MOST_SHIFT).cast("int"))
    pairs = pairs.withColumn("near", F.sum(F.coalesce("far", F.lit(0))).over(in_order))
    way = lambda k, c: F.struct(F.lit(k).alias("k"), c.cast("long").alias("c"))
    pairs = pairs.withColumn("way", F.explode(F.array(way(0, F.lit(0)), way(1, F.col("near")), way(2, F.col("shift")))))
    key = ["doc_id", "item_id", "variant", "kind", "way"]
    # the same window of an item may match at several places: the best is one with its own values, then the first
    best = pairs.groupBy(*key, "item_at").agg(
        F.min(F.struct((F.col("slots") != F.col("item_slots")).alias("other"), F.col("at"), F.col("slots"), F.col("item_slots"))).alias("m"), F.max("n_windows").alias("n_windows")
    )
    mapping = F.explode_outer(F.arrays_zip(F.col("m.item_slots").alias("a"), F.col("m.slots").alias("b")))
    flat = best.select(*key, "item_at", "n_windows", F.col("m.other").alias("other"), mapping.alias("z"))
    per_value = flat.groupBy(*key, F.col("z.a").alias("a")).agg(
        F.min("z.b").alias("least"), F.max("z.b").alias("most"), F.max("other").alias("other"), F.max("n_windows").alias("n_windows"), F.collect_set("item_at").alias("ats")
    )
    out = per_value.groupBy(*key).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).cast("long").alias("matched"),
        F.max("n_windows").alias("n_windows"),
        (~F.max("other")).alias("same_values"),
        F.min(F.col("least").isNull() | (F.col("least") == F.col("most"))).alias("consistent"),
    )
    # of the ways that pass, the one of the most windows; typed windows come first
    passed = out.withColumn("coverage", F.round(F.col("matched") / F.col("n_windows"), 6)).filter(F.col("consistent") & (F.col("coverage") >= min_coverage))
    one = passed.groupBy("doc_id", "item_id").agg(F.max(F.struct((-F.col("kind")).alias("kind"), "matched", "same_values", "coverage", "consistent")).alias("o"))
    return one.select("doc_id", "item_id", "o.matched", "o.coverage", "o.same_values", "o.consistent")


def unsearchable(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows (item_id, text) of the benchmark that no window covers: without a text, too short, or without an id."""
    known = item_windows(benchmark, window).select("item_id", "variant").distinct()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(batch.column("text"), "")
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(hash_strings(texts).view(np.int64))], names=["item_id", "text", "variant"])

    return pick(benchmark, "item_id", "text").mapInArrow(by_slices(run), "item_id long, text string, variant long").join(known, ["item_id", "variant"], "left_anti").drop("variant")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """``docs``, with their columns, less those that ``decontaminate`` reports. Rows without an id or text stay."""
    return without_ids(docs, decontaminate(docs, benchmark, window, min_coverage).select("doc_id").distinct())
