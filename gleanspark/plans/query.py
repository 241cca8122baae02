"""The query language: words, "phrases", & and | (of one precedence, from the left), - before what isn't wanted, ( ).

``compile_query`` gives a tree whose words are stemmed (as the corpus is), with stop words and what they
leave empty taken out, and synonyms put in where a table of them is given. What is malformed raises
``QueryParseError``; a query of stop words alone compiles to None and matches nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import unquote_plus

from gleanspark.functions.stemming import stem_token


class QueryParseError(ValueError):
    """The query isn't well formed."""


@dataclass(frozen=True)
class Word:
    stem: str


@dataclass(frozen=True)
class Phrase:
    stems: tuple[str, ...]


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


@dataclass(frozen=True)
class Not:
    node: Node


@dataclass(frozen=True)
class Synonyms:
    """A word, or one of its synonyms (which rank apart)."""

    word: Word
    others: tuple[Word | Phrase, ...]


Node = Word | Phrase | And | Or | Not | Synonyms
OPERATORS = "()&|-"


def lex(query: str) -> list[tuple[str, str]]:
    """(kind, text) pieces: ``op``, ``word`` or ``phrase``. A quote amid a word goes on with the word."""
    out: list[tuple[str, str]] = []
    current, quoted, escaped, kind = "", False, False, "word"

    def flush() -> None:
        nonlocal current, kind
        if current or kind == "phrase":
            out.append((kind, current))
        current, kind = "", "word"

    for c in query:
        if quoted:
            if c == '"':
                quoted = False
                flush()
            else:
                current += c
        elif escaped:
            current, escaped = current + c, False
        elif c == "\\":
            escaped = True
        elif c == '"':
            quoted = True
            kind, current = ("word", current + "$") if current else ("phrase", "")
        elif c in OPERATORS:
            flush()
            out.append(("op", c))
        elif c == " ":
            flush()
        else:
            current += c
    flush()
    return out


class _Parser:
    def __init__(self, pieces: list[tuple[str, str]]):
        self.pieces, self.at = pieces, 0

    def peek(self) -> tuple[str, str] | None:
        return self.pieces[self.at] if self.at < len(self.pieces) else None

    def expression(self):
        left = self.term()
        while (piece := self.peek()) and piece != ("op", ")"):
            if piece in (("op", "&"), ("op", "|")):
                self.at += 1
            left = ("|" if piece == ("op", "|") else "&", left, self.term())
        return left

    def term(self):
        piece = self.peek()
        if piece is None:
            raise QueryParseError("the query ends where a word is due")
        self.at += 1
        if piece == ("op", "-"):
            return ("-", self.term())
        if piece == ("op", "("):
            inner = self.expression()
            if self.peek() != ("op", ")"):
                raise QueryParseError("a parenthesis isn't closed")
            self.at += 1
            return inner
        if piece[0] == "op":
            raise QueryParseError(f"{piece[1]!r} stands where a word is due")
        return piece


def parse(query: str):
    """The tree of the raw words: ("&" or "|", left, right), ("-", tree), ("word", text), ("phrase", text)."""
    p = _Parser(lex(text_lower(query)))
    tree = p.expression()
    if p.peek() is not None:
        raise QueryParseError("a parenthesis is closed that wasn't opened")
    return tree


def text_lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def _raw_words(tree) -> set[str]:
    if tree[0] == "word":
        return {tree[1]}
    if tree[0] == "phrase":
        return set(tree[1].split())
    return set().union(*[_raw_words(x) for x in tree[1:]])


def stem_words(words: Iterable[str]) -> dict[str, str]:
    """Stems of a query's few words, by the function that stems the corpus."""
    return {w: stem_token(w) for w in words}


def _built(tree, stems: Mapping[str, str], synonyms: Mapping[str, Sequence[str]]) -> Node | None:
    kind = tree[0]
    if kind == "word":
        s = stems[tree[1]]
        if not s:
            return None
        others: list[Word | Phrase] = []
        for lemma in synonyms.get(s, ()):
            parts = tuple(x for x in (stems[w] for w in lemma.split()) if x)
            node = Word(parts[0]) if len(parts) == 1 else Phrase(parts) if parts else None
            if node and node != Word(s) and node not in others:
                others.append(node)
        return Synonyms(Word(s), tuple(others)) if others else Word(s)
    if kind == "phrase":
        parts = tuple(x for x in (stems[w] for w in tree[1].split()) if x)
        return Word(parts[0]) if len(parts) == 1 else Phrase(parts) if parts else None
    if kind == "-":
        inner = _built(tree[1], stems, synonyms)
        return Not(inner) if inner else None
    left, right = (_built(x, stems, synonyms) for x in tree[1:])
    if left and right:
        return (And if kind == "&" else Or)(left, right)
    return left or right


def compile_query(query: str, synonyms: Mapping[str, Sequence[str]] | None = None, url_encoded: bool = False) -> Node | None:
    """``synonyms``: lemmas by the stem of a word, lower case; a lemma of several words becomes a phrase."""
    tree = parse(unquote_plus(text_lower(query)) if url_encoded else query)
    table = synonyms or {}
    words = _raw_words(tree)
    stems = stem_words(words)
    extra = {w for s in {stems[w] for w in words} for lemma in table.get(s, ()) for w in lemma.split()}
    return _built(tree, stems | stem_words(extra - set(stems)), table)


def ranking_terms(node: Node | None) -> tuple[list[str], list[str]]:
    """Distinct stems in the tree's order, and those of synonyms; what is excluded gives none."""
    own: list[str] = []
    others: list[str] = []

    def walk(n: Node | None, into: list[str]) -> None:
        if isinstance(n, Word):
            if n.stem not in into:
                into.append(n.stem)
        elif isinstance(n, Phrase):
            for s in n.stems:
                walk(Word(s), into)
        elif isinstance(n, (And, Or)):
            walk(n.left, into)
            walk(n.right, into)
        elif isinstance(n, Synonyms):
            walk(n.word, into)
            for x in n.others:
                walk(x, others)

    walk(node, own)
    return own, others


def leaf_terms(node: Node | None) -> list[str]:
    """All stems of the tree, those of excluded parts too."""
    if node is None:
        return []
    if isinstance(node, Word):
        return [node.stem]
    if isinstance(node, Phrase):
        return list(dict.fromkeys(node.stems))
    parts = [node.node] if isinstance(node, Not) else [node.word, *node.others] if isinstance(node, Synonyms) else [node.left, node.right]
    return list(dict.fromkeys(t for p in parts for t in leaf_terms(p)))


def to_prefix(node: Node | None) -> str:
    """The tree in prefix notation, for tests and plans."""
    if node is None:
        return ""
    if isinstance(node, Word):
        return node.stem
    if isinstance(node, Phrase):
        return f'"{" ".join(node.stems)}"'
    if isinstance(node, Not):
        return f"-{to_prefix(node.node)}"
    if isinstance(node, Synonyms):
        return f"~({to_prefix(node.word)} {' '.join(map(to_prefix, node.others))})"
    return f"{'&' if isinstance(node, And) else '|'}({to_prefix(node.left)} {to_prefix(node.right)})"


UTILITY_STEMS = ("about", "contact", "cooki", "legal", "polici", "privaci", "term")


def wants_utility(terms: Sequence[str]) -> bool:
    """Whether a term other than the first asks for pages of terms, contact and the like."""
    return any(t in UTILITY_STEMS for t in terms[1:])
