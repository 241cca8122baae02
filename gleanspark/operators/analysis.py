"""Terms of pages, found over Arrow batches in one pass from a page's text to what is asked for.

Pages come in three forms: parsed (``index.PAGE``), as web pages (``html``) and as plain documents (``text``, whose first
words serve as title). Tokens become numbers, and the rest is done on arrays of numbers, so that neither words nor stems
move between Spark and Python. Plain texts are cut as arrays of bytes; only distinct tokens of a slice, or where terms are
asked for those that could have them as stems, are looked at one by one. Texts are taken a slice of bounded size at a
time, and the vocabulary that a worker remembers is bounded: its memory doesn't grow with the input.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.stemming import stem_token
from gleanspark.functions.text import CLOSERS, IRREGULAR, STOP

#: Pages of so many title words or more aren't indexed.
MOST_TITLE_WORDS = 40
#: A plain document has no title: so many of its first words serve as one.
TITLE_WORDS = 6
#: Bytes that are analysed at a time (a longer page is a slice of its own), by form; Python's words take many times as much.
SLICE_BYTES = {"text": 1 << 21, "html": 1 << 18, "words": 1 << 18}
#: Tokens that a worker remembers; with more it begins anew.
MOST_KNOWN = 1 << 18
FIELDS = ("title", "body")
ATTRIBUTES = {"seq": "long", "url": "string", "title": "string", "word_count": "long", "title_length": "long", "english": "boolean"}
COUNTED = "field string, term string, post_count long, doc_freq long, last_pos long"
POSTED = "seq long, field string, term string, pos long, flags tinyint, first boolean"

_CLOSERS = CLOSERS.encode()
_PLAIN = bytes.maketrans(string.ascii_uppercase.encode() + b"\t\n\r", string.ascii_lowercase.encode() + b"   ")


def cut_text(text: bytes | None) -> list[bytes]:
    """The tokens of ``text.tokens``."""
    return list(filter(None, text.translate(_PLAIN).split(b" "))) if text else []


#: Words whose stem doesn't begin as they do, or is empty.
_APART = frozenset(x.encode() for x in ("", *STOP, *IRREGULAR))
_STOP_WORDS = frozenset(x.encode() for x in STOP)


def beginnings(wanted: list[str]) -> np.ndarray:
    """Which first two bytes (the second may be missing) a token can have whose stem is wanted, unless it has a quote or is irregular.

    Rules change the ends of words. Of the first two letters they keep both, but for -biliti, which becomes -ble, a y
    that becomes i, and where a stem has but one. (Tests hold this against the stems of words and of all kinds of ends.)
    """
    out = np.zeros((256, 256), bool)  # by the second byte and the first
    for t in wanted:
        first, second = (t.encode() + b"\0")[:2]
        firsts = [first, *b"Y" * (first == ord("y"))]  # the stemmer gives a capital Y back small
        if not second:
            out[:, firsts] = True
        seconds = {ord("y"): b"yY", ord("i"): b"iyY", ord("l"): b"li" if first == ord("b") else b"l"}.get(second, [second])
        out[np.ix_([*seconds], firsts)] = True
    return out.ravel()


class Vocabulary(dict):
    """Tokens (as text or as bytes of UTF-8) and the numbers of their stems; 0 is that of stop words and lone signs.

    Where only some terms are ``wanted``, all others have the number 1, and what can't have a wanted or an empty stem isn't stemmed.
    """

    def __init__(self, wanted: list[str] | None = None):
        super().__init__()
        self.wanted = wanted
        self.begins = beginnings(wanted or [])
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.stems = ["", "", *(self.wanted or ())]
        self.numbers = {"": 0} | {t: 2 + i for i, t in enumerate(self.wanted or ())}

    @property
    def full(self) -> bool:
        return len(self) > MOST_KNOWN

    def __missing__(self, token: str | bytes) -> int:
        if self.wanted is None:
            n = self.number(stem_token(token if isinstance(token, str) else token.decode()))
        else:
            raw = token.encode() if isinstance(token, str) else token
            bare = raw.rstrip(_CLOSERS)
            first, second = (bare + b"\0\0")[:2]
            n = self.numbers.get(stem_token(raw.decode()), 1) if b"'" in raw or self.begins[first | second << 8] or bare in _APART else 1
        self[token] = n
        return n

    def number(self, stem: str) -> int:
        n = self.numbers.get(stem)
        if n is None:
            n = self.numbers[stem] = len(self.stems)
            self.stems.append(stem)
        return n

    def _local(self, numbers: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The strings that there are, and which of them each is."""
        there = np.flatnonzero(np.bincount(numbers, minlength=len(self.stems)))
        at = np.zeros(len(self.stems), np.int32)
        at[there] = np.arange(len(there), dtype=np.int32)
        return pa.array([self.stems[i] for i in there.tolist()], pa.string()), at[numbers]

    def strings(self, numbers: np.ndarray) -> pa.Array:
        strings, at = self._local(numbers)
        return strings.take(pa.array(at))

    def order(self, numbers: np.ndarray) -> np.ndarray:
        """Places by the alphabet, equals as they are."""
        strings, at = self._local(numbers)
        rank = np.empty(len(strings), np.int32)
        rank[pc.array_sort_indices(strings).to_numpy()] = np.arange(len(strings), dtype=np.int32)
        return np.argsort(rank[at], kind="stable")


@dataclass
class Slice:
    """Some pages' terms in order, the title's first: the page (row of ``batch``), whether it is of the body, place in the page (from 1), number, flags."""

    batch: pa.RecordBatch
    indexed: np.ndarray
    title_length: np.ndarray
    n_words: np.ndarray
    titles: Callable[[np.ndarray], list[str]]
    english: pa.Array
    page: np.ndarray
    body: np.ndarray
    pos: np.ndarray
    term: np.ndarray
    flags: np.ndarray

    def only(self) -> Slice:
        """Those of the wanted terms."""
        return self.at(self.term > 1)

    def at(self, keep: np.ndarray) -> Slice:
        return Slice(self.batch, self.indexed, self.title_length, self.n_words, self.titles, self.english, self.page[keep], self.body[keep], self.pos[keep], self.term[keep], self.flags[keep])

    def keys(self) -> np.ndarray:
        """A number for each field and term."""
        return self.term.astype(np.int64) * 2 + self.body

    def first(self) -> np.ndarray:
        """Which of the terms is its page's first of its field."""
        out = np.zeros(len(self.term), bool)
        out[np.unique(self.page.astype(np.int64) << 32 | self.keys(), return_index=True)[1]] = True
        return out

    def attribute(self, name: str, rows: np.ndarray) -> pa.Array:
        """An attribute of all pages; titles only of these ``rows``."""
        if name == "title":
            return pa.array(self.titles(rows), pa.string())
        if name == "english":
            return self.english
        if name in ("word_count", "title_length"):
            return pa.array(self.title_length + (self.n_words if name == "word_count" else 0), pa.int64())
        return self.batch.column(name)


def form_of(pages: DataFrame) -> str:
    return next(f for f in ("words", "html", "text") if f in pages.columns)


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _key(word: bytes) -> int:
    return int.from_bytes(word[:8], "little")


class _Words:
    """Membership of words, by their first eight bytes, in a small table without collisions."""

    def __init__(self, words: frozenset[bytes]):
        keys = np.array(sorted({_key(w) for w in words if w}), np.uint64)
        for factor in range(0x9E3779B97F4A7C15, 1 << 64, 2):
            self.factor = np.uint64(factor)
            at = self._at(keys)
            if len(np.unique(at)) == len(keys):
                break
        self.table = np.zeros(1 << 14, np.uint64)
        self.table[at] = keys

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys * self.factor >> np.uint64(50)).astype(np.int64)

    def have(self, keys: np.ndarray) -> np.ndarray:
        return (self.table[self._at(keys)] == keys) & (keys != 0)


_STOPS, _ODD = _Words(_STOP_WORDS), _Words(frozenset(x.encode() for x in IRREGULAR))
_LOWER = np.frombuffer(_PLAIN, np.uint8)
_CLOSES = np.isin(np.arange(256), [*_CLOSERS])


def _text_terms(b: pa.RecordBatch, known: Vocabulary) -> tuple[np.ndarray, np.ndarray, Callable]:
    """The numbers of all tokens of plain texts, how many each text has, and titles of rows."""
    texts = pc.fill_null(b.column("text"), "")
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    size = int(at[-1] - at[0])
    low = np.zeros(size + 8, np.uint8)
    if size:
        low[:size] = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8, size, int(at[0]))]
    at -= at[0]
    solid = low[:size] != 32
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    seams = at[(at > 0) & (at < size)]  # where a text begins right after another
    begin[seams] = solid[seams]
    end[seams - 1] = solid[seams - 1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    token = lambda i: low[begin[i] : end[i]].tobytes()
    starts = np.searchsorted(begin, at)
    n_words = np.diff(starts)

    def titles(rows: np.ndarray) -> list[str]:
        out = [""] * len(n_words)
        for r in np.flatnonzero(rows).tolist():
            out[r] = b" ".join(token(i) for i in range(starts[r], starts[r] + min(TITLE_WORDS, n_words[r]))).decode()
        return out

    if known.wanted is None:
        lengths = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
        every = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(lengths), pa.py_buffer(np.ascontiguousarray(low[:size][solid]))]).dictionary_encode()
        distinct = np.fromiter(map(known.__getitem__, every.dictionary.to_pylist()), np.int32, len(every.dictionary))
        return distinct[every.indices.to_numpy()] if len(begin) else distinct, n_words, titles
    bare = end.copy()
    closed = np.flatnonzero(_CLOSES[low[bare - 1]])
    while len(closed):
        bare[closed] -= 1
        closed = closed[bare[closed] > begin[closed]]
        closed = closed[_CLOSES[low[bare[closed] - 1]]]
    eight = np.ndarray((size + 1,), np.uint64, low, strides=(1,))[begin]
    keys = eight & _MASKS[np.minimum(bare - begin, 8)]
    term = np.where((bare == begin) | _STOPS.have(keys), 0, 1).astype(np.int32)
    likely = known.begins[(keys & np.uint64(0xFFFF)).astype(np.int64)] | _ODD.have(keys)
    likely[np.searchsorted(begin, np.flatnonzero(low[:size] == 39), "right") - 1] = True
    likely = np.flatnonzero(likely & (term == 1))
    short = end[likely] - begin[likely] <= 8  # these are alike if their bytes are
    long, likely = likely[~short], likely[short]
    term[long] = np.fromiter((known[token(i)] for i in long.tolist()), np.int32, len(long))
    _, one, which = np.unique(eight[likely] & _MASKS[end[likely] - begin[likely]], return_index=True, return_inverse=True)
    term[likely] = np.fromiter((known[token(i)] for i in likely[one].tolist()), np.int32, len(one))[which]
    return term, n_words, titles


def _text(b: pa.RecordBatch, known: Vocabulary) -> tuple:
    term, n_words, titles = _text_terms(b, known)
    head = np.minimum(n_words, TITLE_WORDS)
    total = head + n_words
    page = np.repeat(np.arange(b.num_rows), total)
    place = np.arange(len(page)) - np.repeat(np.cumsum(total) - total, total)  # in the page, of title and text
    body = place >= head[page]
    term = term[(np.cumsum(n_words) - n_words)[page] + np.where(body, place - head[page], place)]
    return page, body, term, None, head, n_words, titles, b.column("english")


def _parsed(form: str, b: pa.RecordBatch, known: Vocabulary) -> tuple:
    tokens: list[str] = []
    n_title, n_words, titles = [], [], []
    flags: list[int] = []
    english: list[bool] = []
    if form == "words":
        pages = ((t or [], [(w["word"], w["flags"]) for w in x or []]) for t, x in zip(b.column("title_words").to_pylist(), b.column("words").to_pylist(), strict=True))
    else:
        from gleanspark.sources.html import PageParser

        parsed = map(PageParser, (x or "" for x in b.column("html").to_pylist()))
        pages = ((english.append(p.english), (p.title_words, p.words))[1] for p in parsed)
    for title, words in pages:
        tokens += title
        tokens += [w for w, _ in words]
        flags += [0] * len(title)
        flags += [f or 0 for _, f in words]
        n_title.append(len(title))
        n_words.append(len(words))
        titles.append(" ".join(title))
    term = np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens))
    title_length, words = np.array(n_title, np.int64), np.array(n_words, np.int64)
    page = np.repeat(np.arange(b.num_rows), title_length + words)
    body = np.repeat(np.tile(np.array([False, True]), b.num_rows), np.stack([title_length, words], 1).ravel())
    return page, body, term, np.array(flags, np.int8), title_length, words, lambda rows: titles, b.column("english") if form == "words" else pa.array(english, pa.bool_())


def _bytes(form: str, b: pa.RecordBatch) -> np.ndarray:
    if form != "words":
        return pc.fill_null(pc.binary_length(b.column(form)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sum(pc.fill_null(pc.list_value_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("title_words", "words")) * 8


def pieces(b: pa.RecordBatch, size: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of bounded size; a longer row is a piece of its own."""
    total = np.concatenate([[0], np.cumsum(size)])
    start = 0
    while start < b.num_rows:
        end = max(start + 1, int(np.searchsorted(total, total[start] + most, "right")) - 1)
        yield b.slice(start, end - start)
        pa.default_memory_pool().release_unused()  # else a worker keeps what its largest slice took
        start = end


def _analysed(form: str, b: pa.RecordBatch, known: Vocabulary) -> Slice:
    page, body, term, flags, title_length, n_words, titles, english = _text(b, known) if form == "text" else _parsed(form, b, known)
    indexed = title_length < MOST_TITLE_WORDS
    keep = (term != 0) & indexed[page]
    page, body, term = page[keep], body[keep], term[keep]
    count = np.bincount(page, minlength=b.num_rows)
    pos = np.arange(1, len(term) + 1) - np.repeat(np.cumsum(count) - count, count)
    return Slice(b, indexed, title_length, n_words, titles, english, page, body, pos, term, np.zeros(len(term), np.int8) if flags is None else flags[keep])


def slices(form: str, batches: Iterator[pa.RecordBatch], known: Vocabulary) -> Iterator[Slice]:
    for batch in batches:
        for b in pieces(batch, _bytes(form, batch), SLICE_BYTES[form]):
            yield _analysed(form, b, known)


def _input(pages: DataFrame, *more: str) -> tuple[str, DataFrame]:
    form = form_of(pages)
    need = {"text": ["text"], "html": ["html"], "words": ["title_words", "words"]}[form]
    columns = [*need, *(c for c in more if c not in need and (c in pages.columns))]
    if form != "html" and "english" not in columns:
        columns.append("english")
    return form, pages.select(*[F.col(c).cast("long").alias(c) if c == "seq" else c for c in columns])


def attributes(pages: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Of each indexed page, the named ones of ``ATTRIBUTES``."""
    return with_places(pages, [], names or [*ATTRIBUTES])


def with_places(pages: DataFrame, terms: list[str], names: list[str], hits_alone: bool = False) -> DataFrame:
    """Attributes and, for each field and term, an array of its (pos, strong) in order, named by field and the term's number; strong ones are bold or in a heading.
    With ``hits_alone``, of the pages that have any of the terms."""
    form, given = _input(pages, *names)
    columns = [f"{f}_{i}" for f in FIELDS for i in range(len(terms))]
    schema = ", ".join([*(f"{n} {ATTRIBUTES[n]}" for n in names), *(f"{c} array<struct<pos:long,strong:boolean>>" for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(terms)
        wanted = [known.numbers[t] for t in terms]
        for s in slices(form, batches, known):
            hits = s.only()
            keep = s.indexed & (np.bincount(hits.page, minlength=s.batch.num_rows) > 0) if hits_alone else s.indexed
            out = [s.attribute(n, keep) for n in names]
            for body in range(2):
                for n in wanted:
                    own = (hits.term == n) & (hits.body == bool(body))
                    offsets = np.concatenate([[0], np.cumsum(np.bincount(hits.page[own], minlength=s.batch.num_rows))]).astype(np.int32)
                    places = pa.StructArray.from_arrays([pa.array(hits.pos[own], pa.int64()), pa.array(hits.flags[own] & 3 != 0)], names=["pos", "strong"])
                    out.append(pa.ListArray.from_arrays(pa.array(offsets), places))
            yield pa.RecordBatch.from_arrays(out, names=[*names, *columns]).filter(pa.array(keep))
            if known.full:
                known.forget()

    return given.mapInArrow(run, schema)


_FIELD = pa.array(FIELDS)


def posts_of_pages(pages: DataFrame, only: list[str] | None = None, keep: str | None = None) -> DataFrame:
    """A row for each term occurrence (of the terms ``only``, if given): ``POSTED``, and the long column ``keep`` of its page. ``first``: whether it is its page's first of the term in the field.
    All terms come by the alphabet within a slice: sorted runs, which a sort by term has but to merge."""
    form, given = _input(pages, "seq", *([keep] if keep else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(only)
        for s in slices(form, batches, known):
            if only is not None:
                s = s.only()
                first = s.first()
            else:
                order = known.order(s.term)
                s, first = s.at(order), s.first()[order]
            page = pa.array(s.page)
            columns = [s.batch.column("seq").take(page), _FIELD.take(pa.array(s.body.astype(np.int8))), known.strings(s.term), pa.array(s.pos, pa.int64()), pa.array(s.flags), pa.array(first)]
            names = ["seq", "field", "term", "pos", "flags", "first"]
            if keep:
                columns.append(s.batch.column(keep).take(page))
                names.append(keep)
            yield pa.RecordBatch.from_arrays(columns, names=names)
            if known.full:
                known.forget()

    return given.mapInArrow(run, f"{POSTED}, {keep} long" if keep else POSTED)


class _Sums:
    """Occurrences, pages and last places of a vocabulary's fields and terms."""

    def __init__(self):
        self.counts = np.zeros((3, 0), np.int64)

    def add(self, s: Slice, size: int) -> None:
        if self.counts.shape[1] < 2 * size:
            self.counts = np.concatenate([self.counts, np.zeros((3, 3 * size - self.counts.shape[1]), np.int64)], 1)
        keys, width = s.keys(), self.counts.shape[1]
        self.counts[0] += np.bincount(keys, minlength=width)
        self.counts[1] += np.bincount(keys[s.first()], minlength=width)
        np.maximum.at(self.counts[2], keys, s.pos)

    def taken(self, known: Vocabulary) -> Iterator[pa.RecordBatch]:
        there = np.flatnonzero(self.counts[0])
        for at in range(0, len(there), 1 << 16):
            keys = there[at : at + (1 << 16)]
            columns = [_FIELD.take(pa.array(keys & 1)), known.strings(keys >> 1), *(pa.array(c[keys]) for c in self.counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["field", "term", "post_count", "doc_freq", "last_pos"])
        self.counts = np.zeros((3, 0), np.int64)


def counted_terms(pages: DataFrame) -> DataFrame:
    """``COUNTED``: each field's terms with their occurrences, pages and last place, summed in each task as far as its vocabulary goes; rows of a term are still to be added up."""
    form, given = _input(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = Vocabulary(), _Sums()
        for s in slices(form, batches, known):
            sums.add(s, len(known.stems))
            if known.full:
                yield from sums.taken(known)
                known.forget()
        yield from sums.taken(known)

    return given.mapInArrow(run, COUNTED)


def counted_tokens(texts: DataFrame) -> DataFrame:
    """Of a column ``text``: each token's ``t``, ``stem`` and number ``n``, summed in each task as far as its vocabulary goes; rows of a token are still to be added up."""

    def taken(counts: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        tokens = [t.decode() for t in counts]
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(map(stem_token, tokens), pa.string()), pa.array(counts.values(), pa.int64())], names=["t", "stem", "n"])
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for b in pieces(batch, _bytes("text", batch), SLICE_BYTES["text"]):
                for t in b.column("text").cast(pa.binary()).to_pylist():
                    counts.update(cut_text(t))
                if len(counts) > MOST_KNOWN:
                    yield from taken(counts)
        yield from taken(counts)

    return texts.select("text").mapInArrow(run, "t string, stem string, n long")
