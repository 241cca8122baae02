"""Web pages: a tag-level state machine that gives title words, words with flags, links, base and language.

The machine can't be written with Spark's functions, so pages go through Arrow batches; within a page it jumps
from tag to tag with string searches, and words are cut by one split for each stretch of text.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.functions import urls
from gleanspark.operators.index import BOLD, HEADING

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SECTIONS = ("script", "style", "svg")
HEADINGS = {f"h{i}" for i in range(1, 7)}
#: A longer name isn't taken for a tag but for text.
LONGEST_TAG = 20
SPACE = " \t\n\r"


def cut(s: str) -> list[str]:
    for c in "\t\n\r":
        s = s.replace(c, " ")
    return [w for w in s.split(" ") if w]


class PageParser:
    """Parses one page at once. Tag names that no browser knows are dropped like any other."""

    def __init__(self, html: str):
        self.s = html.translate(LOWER)
        self.title_words: list[str] = []
        self.words: list[tuple[str, int]] = []
        self.links: list[tuple[str, list[str]]] = []
        self.base, self.english = "", True
        self.in_title = self.in_anchor = self.in_heading = self.in_bold = False
        self.section = ""
        self._run()

    def _after(self, what: str, at: int) -> int:
        """The place after the next ``what``; the end if there is none."""
        i = self.s.find(what, at)
        return len(self.s) if i < 0 else i + len(what)

    def _add(self, word: str) -> None:
        if self.in_title:
            self.title_words.append(word)
        else:
            self.words.append((word, BOLD * self.in_bold | HEADING * self.in_heading))

    def _run(self) -> None:
        s, at = self.s, 0
        while at < len(s):
            if s[at] != "<":
                end = s.find("<", at)
                end = len(s) if end < 0 else end
                if not self.section:
                    self._text(s[at:end])
                at = end
                continue
            closing = s.startswith("/", at + 1)
            if closing and self.in_title and s.startswith("title", at + 2):
                self.in_title, at = False, self._after(">", at)
            elif closing and self.in_anchor and s.startswith("a", at + 2):
                self.in_anchor, at = False, self._after(">", at)
            elif closing and self.in_heading and s[at + 2 : at + 4] in HEADINGS:
                self.in_heading, at = False, self._after(">", at)
            elif closing and self.in_bold and s.startswith("b", at + 2):
                self.in_bold, at = False, self._after(">", at)
            elif self.section:
                at, self.section = self._after(f"</{self.section}>", at), ""
            else:
                at = self._tag(at)

    def _text(self, text: str) -> None:
        words = cut(text)
        if self.in_anchor and self.links:
            self.links[-1][1].extend(words)
        for w in words:
            self._add(w)

    def _tag(self, lt: int) -> int:
        s, start = self.s, lt + 1
        while start < len(s) and s[start] in SPACE:
            start += 1
        at = start
        while at < len(s) and s[at] not in " \t\n\r>":
            at += 1
        closing = s.startswith("/", start)
        name = s[start + closing : at]
        name = name[:-1] if name.endswith("/") else name
        if name == "b":
            self.in_bold = True
        elif name in HEADINGS:
            self.in_heading = True
        if len(name) > LONGEST_TAG:
            return self._not_a_tag(start - 1, at)
        if closing:
            return self._after(">", at)
        if name in SECTIONS:
            self.section = name
        elif name == "!--":
            return self._after("-->", at)
        elif name == "title":
            self.in_title = True
        elif name == "a":
            at = self._anchor(at)
        elif name == "base" and not self.base:
            self.base = self._attribute(at, "href")
        elif name == "embed":
            if s.find(">", at) < 0:
                return len(s)
            if src := self._attribute(at, "src"):
                self.links.append((src, []))
        elif name == "html":
            end = s.find(">", at)
            lang = s.find('lang="', at, len(s) if end < 0 else end)
            if lang >= 0:
                self.english = s.startswith("en", lang + 6)
                at = lang + 8
        return self._after(">", at)

    def _attribute(self, at: int, name: str) -> str:
        end = self.s.find(">", at)
        tag = self.s[at : len(self.s) if end < 0 else end]
        _, found, rest = tag.partition(f'{name}="')
        value, closed, _ = rest.partition('"')
        return value if found and closed else ""

    def _anchor(self, at: int) -> int:
        """A link to the first href; the tag ends at the first > outside quotes."""
        end, quoted = at, False
        while end < len(self.s) and (quoted or self.s[end] != ">"):
            quoted ^= self.s[end] == '"'
            end += 1
        if end < len(self.s):
            _, found, rest = self.s[at:end].partition('href="')
            href, closed, _ = rest.partition('"')
            if found and closed and href:
                self.links.append((href, []))
                self.in_anchor = True
        return end

    def _not_a_tag(self, lt: int, at: int) -> int:
        """Text that looks like a tag: words of it if it is closed, else one word with what stands right before it."""
        gt, next_lt = self.s.find(">", at), self.s.find("<", at)
        if gt >= 0 and not 0 <= next_lt < gt:
            for w in cut(self.s[lt : gt + 1]):
                self._add(w)
            return gt + 1
        head = lt
        while head > 0 and self.s[head - 1] not in SPACE and self.s[head - 1] != "<":
            head -= 1
        glued = bool(self.words) and head < lt
        word = self.s[head if glued else lt : at]
        if glued:
            self.words.pop()
        if self.in_anchor and self.links:
            if self.links[-1][1]:
                self.links[-1][1].pop()
            self.links[-1][1].append(word)
        self._add(word)
        return at


WORDS = pa.list_(pa.struct([("word", pa.string()), ("flags", pa.int8())]))
LINKS = pa.list_(pa.struct([("url", pa.string()), ("anchor", pa.list_(pa.string()))]))
PARSED = "title_words array<string>, words array<struct<word:string,flags:tinyint>>, links array<struct<url:string,anchor:array<string>>>, base string, english boolean"


def parse_pages(pages: DataFrame) -> DataFrame:
    """(seq, url, html) parsed: ``seq``, ``url``, ``title_words``, ``words``, ``links``, ``base``, ``english``. A null page is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):  # few pages at a time, for each becomes many words
                piece = b.slice(at, 64)
                parsed = [PageParser(x or "") for x in piece.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("seq"),
                        piece.column("url"),
                        pa.array([p.title_words for p in parsed], pa.list_(pa.string())),
                        pa.array([[{"word": w, "flags": f} for w, f in p.words] for p in parsed], WORDS),
                        pa.array([[{"url": u, "anchor": a} for u, a in p.links] for p in parsed], LINKS),
                        pa.array([p.base for p in parsed], pa.string()),
                        pa.array([p.english for p in parsed], pa.bool_()),
                    ],
                    names=["seq", "url", "title_words", "words", "links", "base", "english"],
                )

    return pages.select(F.col("seq").cast("long").alias("seq"), "url", "html").mapInArrow(run, f"seq long, url string, {PARSED}")


def frontier(parsed: DataFrame, parts: int = 64) -> DataFrame:
    """The pages that are linked to: each resolved ``url`` once, its least ``depth`` (one more than its page's; pages without a ``depth`` have nought), and the ``part`` that is to fetch it."""
    depth = F.col("depth") if "depth" in parsed.columns else F.lit(0)
    links = parsed.select("base", (depth + 1).cast("int").alias("depth"), F.explode("links").alias("l"))
    links = links.select(urls.resolved(F.col("l.url"), F.col("base")).alias("url"), "depth").filter("url is not null").groupBy("url").agg(F.min("depth").alias("depth"))
    return links.withColumn("part", urls.shard(F.col("url"), parts))
