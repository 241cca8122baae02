"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over byte trigrams is derived: every match must contain
them. Each slice of the corpus gets an inverted index of the trigrams that any rule asks for; a rule's posting
lists are intersected and united as its query says, and only the documents left are searched with the
expression. A rule whose expression has no mandatory trigram is searched in full. Index segments are local
to the task that holds the texts, so the scan has no shuffle and its cost is linear in the corpus.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleanspark.llm.common import by_slices, pick

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str  # in the syntax that re and RE2 share; classes and boundaries are ASCII


RULES = (
    Rule("aws_access_key", r"\bAKIA[0-9A-Z]{16}\b"),
    Rule("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36}\b"),
    Rule("slack_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,48}"),
    Rule("google_api_key", r"\bAIza[0-9A-Za-z_-]{35}"),
    Rule("stripe_key", r"\b(?:sk|rk)_(?:live|test)_[0-9A-Za-z]{16,64}"),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("json_web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("password_assignment", r"(?i:password|passwd|pwd)[ ]?[=:][ ]?[\"']?[^ \t\r\n\"']{6,64}"),
    Rule("token_assignment", r"(?i:token|secret|api_?key)[ ]?[=:][ ]?[\"'][0-9A-Za-z_-]{16,80}[\"']"),
    Rule("payment_card", r"\b[3-6][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b"),
)

#: A query is True (no constraint), a trigram (3 bytes), or ("and" | "or", frozenset of queries).
Query = bool | bytes | tuple
MOST_STRINGS = 64
CLASS_MOST = 16


def both(a: Query, b: Query) -> Query:
    return _join("and", a, b)


def either(a: Query, b: Query) -> Query:
    return _join("or", a, b)


def _join(kind: str, *parts: Query) -> Query:
    absorbing = kind == "or"
    flat: set = set()
    for p in parts:
        if p is True:
            if absorbing:
                return True
            continue
        flat |= p[1] if isinstance(p, tuple) and p[0] == kind else {p}
    if not flat:
        return True
    return next(iter(flat)) if len(flat) == 1 else (kind, frozenset(flat))


@dataclass(frozen=True)
class _Part:
    """What is known of a piece of an expression: all its strings if there are few, and a query that holds in any case."""

    strings: frozenset[bytes] | None
    query: Query = True


def _trigrams(s: bytes) -> Query:
    return _join("and", *[s[i : i + 3] for i in range(len(s) - 2)])


def _of_strings(strings: frozenset[bytes]) -> Query:
    out: Query | None = None
    for s in sorted(strings):
        q = _trigrams(s)
        out = q if out is None else either(out, q)
    return True if out is None else out


def _cased(c: int, ignore: bool) -> frozenset[bytes]:
    ch = chr(c)
    return frozenset(x.encode() for x in ({ch.lower(), ch.upper()} if ignore and c < 128 else {ch}))


def _known(p: _Part) -> Query:
    return both(p.query, _of_strings(p.strings)) if p.strings is not None else p.query


def _sequence(items, ignore: bool) -> _Part:
    """Concatenation: runs of pieces with known strings are multiplied out, and closed where they grow too many."""
    query: Query = True
    run: frozenset[bytes] = frozenset([b""])
    exact = True
    for op, arg in items:
        part = _piece(op, arg, ignore)
        if part.strings is not None and len(run) * len(part.strings) <= MOST_STRINGS:
            run = frozenset(a + b for a in run for b in part.strings)
            query = both(query, part.query)
            continue
        query = both(query, _of_strings(run))
        exact = False
        if part.strings is not None:
            # keep what a trigram across the border needs: the last two bytes of what came before
            tails = frozenset(x[-2:] for x in run)
            if len(tails) * len(part.strings) <= MOST_STRINGS:
                run = frozenset(a + b for a in tails for b in part.strings)
            else:
                run = part.strings
            query = both(query, part.query)
        else:
            query = both(query, part.query)
            run = frozenset([b""])
    if exact:
        return _Part(run, query)
    return _Part(None, both(query, _of_strings(run)))


def _piece(op, arg, ignore: bool) -> _Part:
    if op is sre.LITERAL:
        return _Part(_cased(arg, ignore))
    if op is sre.AT:
        return _Part(frozenset([b""]))
    if op is sre.IN:
        chars: set[bytes] = set()
        for o, a in arg:
            if o is sre.LITERAL:
                chars |= _cased(a, ignore)
            elif o is sre.RANGE and a[1] - a[0] < CLASS_MOST:
                for c in range(a[0], a[1] + 1):
                    chars |= _cased(c, ignore)
            else:
                return _Part(None)
        return _Part(frozenset(chars)) if len(chars) <= CLASS_MOST else _Part(None)
    if op is sre.SUBPATTERN:
        _, add, off, inner = arg
        return _sequence(inner, (ignore or bool(add & re.IGNORECASE)) and not off & re.IGNORECASE)
    if op is sre.BRANCH:
        parts = [_sequence(x, ignore) for x in arg[1]]
        if all(p.strings is not None for p in parts):
            strings = frozenset().union(*[p.strings for p in parts])
            if len(strings) <= MOST_STRINGS:
                return _Part(strings)
        return _Part(None, _join("or", *[_known(p) for p in parts]))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = arg
        if least == 0:
            p = _sequence(inner, ignore)
            return _Part(p.strings | {b""}) if most == 1 and p.strings is not None else _Part(None)
        p = _sequence(inner, ignore)
        if p.strings is not None:
            run = frozenset([b""])
            for _ in range(least):
                if len(run) * len(p.strings) > MOST_STRINGS:
                    return _Part(None, _of_strings(run))
                run = frozenset(a + b for a in run for b in p.strings)
            return _Part(run) if least == most else _Part(None, _of_strings(run))
        return _Part(None, p.query)
    return _Part(None)  # ., negated literals, anything else: no constraint


def trigram_query(pattern: str) -> Query:
    """The trigrams that any match of ``pattern`` must contain, as a Boolean query; True: no trigram is mandatory."""
    tree = sre_parse.parse(pattern)
    return _known(_sequence(tree, bool(tree.state.flags & re.IGNORECASE)))


def trigrams_in(q: Query) -> set[bytes]:
    if isinstance(q, bytes):
        return {q}
    return set().union(*[trigrams_in(x) for x in q[1]]) if isinstance(q, tuple) else set()


def code(t: bytes) -> int:
    return t[0] << 16 | t[1] << 8 | t[2]


@lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...]):
    """Per rule the bytes expression and its query; the trigrams asked for; a table from trigram code to its number."""
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(set().union(*[trigrams_in(q) for q in queries])) if queries else []
    number = np.zeros(1 << 24, np.uint16 if len(wanted) < 1 << 16 else np.uint32)  # 0: not asked for
    for i, t in enumerate(wanted):
        number[code(t)] = i + 1
    return [re.compile(r.pattern.encode()) for r in rules], queries, wanted, number


def build_index(data: np.ndarray, offsets: np.ndarray, number: np.ndarray, n_terms: int) -> list[np.ndarray]:
    """Posting lists (sorted local document numbers) of the trigrams asked for; list 0 is unused."""
    if len(data) < 3:
        return [np.empty(0, np.int64)] * (n_terms + 1)
    codes = data[:-2].astype(np.uint32)
    codes <<= np.uint32(8)
    codes |= data[1:-1]
    codes <<= np.uint32(8)
    codes |= data[2:]
    term = number[codes]
    at = np.flatnonzero(term)
    doc = np.searchsorted(offsets, at, side="right") - 1
    fits = at + 3 <= offsets[doc + 1]  # a trigram may not run into the next document
    pairs = np.unique(term[at[fits]].astype(np.int64) << 40 | doc[fits])
    terms, docs = pairs >> 40, pairs & ((1 << 40) - 1)
    edges = np.searchsorted(terms, np.arange(n_terms + 2))
    return [docs[edges[i] : edges[i + 1]] for i in range(n_terms + 1)]


def evaluate(q: Query, postings: list[np.ndarray], index: dict[bytes, int], n_docs: int) -> np.ndarray:
    """The documents that satisfy the query."""
    if q is True:
        return np.arange(n_docs)
    if isinstance(q, bytes):
        return postings[index[q]]
    lists = [evaluate(x, postings, index, n_docs) for x in q[1]]
    if q[0] == "and":
        lists.sort(key=len)
        out = lists[0]
        for x in lists[1:]:
            if not len(out):
                break
            out = np.intersect1d(out, x, assume_unique=True)
        return out
    return np.unique(np.concatenate(lists))


SCHEMA = "doc_id long, rule string, n_matches long, starts array<long>, ends array<long>"


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each document and rule with a match: ``doc_id``, ``rule``, ``n_matches``, ``starts`` and ``ends``.

    Offsets are in bytes of the UTF-8 text; matches don't overlap and are taken from left to right. Null and
    empty texts have no match. Rows without an id are scanned too and give a null ``doc_id``; repeated rows
    give repeated results; other columns of ``docs`` are ignored. Texts are searched whole, however long; an empty table
    gives no rows; rules that match at the same place each have their row.
    """
    rules = tuple(rules)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        expressions, queries, wanted, number = compiled(rules)
        index = {t: i + 1 for i, t in enumerate(wanted)}
        texts = batch.column("text").cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        base = offsets[0]
        view = memoryview(body)[base : offsets[-1]] if body is not None else memoryview(b"")
        offsets = offsets - base
        postings = build_index(np.frombuffer(view, np.uint8), offsets, number, len(wanted))
        ids = batch.column("doc_id")
        rows: list[tuple] = []
        for rule, expression, q in zip(rules, expressions, queries, strict=True):
            for d in evaluate(q, postings, index, len(texts)):
                found = [m.span() for m in expression.finditer(view[offsets[d] : offsets[d + 1]])]
                if found:
                    rows.append((ids[int(d)].as_py(), rule.name, len(found), [a for a, _ in found], [b for _, b in found]))
        if not rows:
            return None
        doc, name, n, starts, ends = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(name, pa.string()), pa.array(n, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))],
            names=["doc_id", "rule", "n_matches", "starts", "ends"],
        )

    return pick(docs, "doc_id", "text").mapInArrow(by_slices(scan), SCHEMA)


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The rows of ``secret_scan`` without offsets: every rule is searched in every document."""
    parts = []
    for r in rules:
        pattern = r.pattern.replace("'", "''")
        parts.append(f"select doc_id, '{r.name}' as rule, cast(len(regexp_extract_all(text, '{pattern}')) as bigint) as n_matches from documents where regexp_matches(text, '{pattern}')")
    return "\nunion all\n".join(parts)
