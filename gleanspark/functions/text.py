"""Analysis of text: ASCII lower case, tokens, punctuation, stop words and the English suffix stemmer.

Every rule is SQL text, in the dialect of Spark or of DuckDB: the first makes columns, the second the SQL that they
are held against. On arrays the stemmer is a chain of higher-order functions, so that a document is analysed in one
projection: no Python, no exploding and no shuffle.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = "[ \\t\\n\\r]+"
CLOSERS = ".,;:!?\")]}'"
STOP = "a an and are as at be been being but by for he her his i if in is it its me my of on or our she that the their them these they this those to was we were with you your".split()
IRREGULAR = dict(
    x.split("=")
    for x in (
        "analysis=analysis buses=bus children=child data=data dice=die echoes=echo feet=foot geese=goose heroes=hero indices=index information=information knives=knife "
        "leaves=leaf lives=life matrices=matrix media=media men=man mice=mouse money=money news=news oxen=ox people=people person=person polite=polite potatoes=potato "
        "series=series species=species teeth=tooth thieves=thief tomatoes=tomato wives=wife wolves=wolf women=woman"
    ).split()
)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


class Dialect:
    """What the two engines write differently. Literals are free of backslashes, so that both read them alike."""

    def __init__(self, duck: bool):
        self.duck = duck

    def octets(self, x: str) -> str:
        return f"strlen({x})" if self.duck else f"octet_length({x})"

    def ends(self, x: str, suffix: str) -> str:
        return f"{'ends_with' if self.duck else 'endswith'}({x}, {quoted(suffix)})"

    def has(self, x: str, pattern: str) -> str:
        return f"{'regexp_matches' if self.duck else 'regexp_like'}({x}, '{pattern}')"

    def right_trimmed(self, x: str, chars: str) -> str:
        # in Spark's literals a double quote needs no escape within single ones
        return f"rtrim({x}, {quoted(chars)})" if self.duck else f"rtrim({quoted(chars)}, {x})"

    def replaced(self, x: str, pattern: str, by: str) -> str:
        """All matches; ``by`` may refer to the first group as {1}."""
        by = by.replace("{1}", "\\1" if self.duck else "$1")
        return f"regexp_replace({x}, '{pattern}', '{by}'" + (", 'g')" if self.duck else ")")


def ascii_lower_sql(x: str) -> str:
    return f"translate({x}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def ascii_lower(c: Column) -> Column:
    """Lower case of A to Z alone."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def tokens(c: Column) -> Column:
    """Pieces between blanks, tabs and line ends, in lower case; a null text has none."""
    return F.filter(F.split(F.coalesce(ascii_lower(c), F.lit("")), BLANKS), lambda x: x != "")


def tokens_duck(x: str) -> str:
    return f"list_filter(string_split_regex({ascii_lower_sql(f'coalesce({x}, {chr(39) * 2})')}, '[ \\t\\n\\r]+'), lambda x: x <> '')"


# --- the stemmer -----------------------------------------------------------------------------------------

FIRST_REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
Rule = tuple[str, Callable[[str], str]]  # a suffix; the word's new form from its part before the suffix


def _case(d: Dialect, rules: list[Rule], word: str) -> str:
    """The first rule whose suffix the word has decides, even where it changes nothing."""
    arms = [f"when {d.ends(word, s)} then {new(f'left({word}, length({word}) - {len(s)})')}" for s, new in rules]
    if len(rules) < 5:
        return f"case {' '.join(arms)} else {word} end"
    last = ", ".join(sorted({quoted(s[-1]) for s, _ in rules}))
    return f"case when right({word}, 1) not in ({last}) then {word} {' '.join(arms)} else {word} end"


def stem_steps(d: Dialect) -> list[dict[str, Callable[[Callable[[str], str]], str]]]:
    """Steps from ``t`` (a token) to ``stem``: fields to compute, each from fields of the steps before (by way of the getter)."""

    def to(suffix: str) -> Callable[[str], str]:
        return lambda stem: f"concat({stem}, '{suffix}')"

    def either(condition: Callable[[str], str], then: str, otherwise: str):
        return lambda stem: f"case when {condition(stem)} then concat({stem}, '{then}') else concat({stem}, '{otherwise}') end"

    def kept(suffix: str):
        return to(suffix)

    def bounded(region: str, suffix: str, by: str = "", also: Callable[[str], str] = lambda stem: "true"):
        return either(lambda stem: f"{region} <= length({stem}) and {also(stem)}", by, suffix)

    def vowel_in(x: str) -> str:
        return d.has(x, "[aeiouy]")

    def ends_in(chars: str):
        return lambda stem: d.has(stem, f"[{chars}]$")

    def phase_0(w):
        return _case(d, [(s, to("")) for s in ("'s'", "'s", "'")], w)

    def plural(w):
        short = either(lambda s: f"{d.octets(s)} > 1", "i", "ie")
        lone = either(lambda s: f"{d.octets(s)} > 2 and {vowel_in(f'left({s}, length({s}) - 1)')}", "", "s")
        return _case(d, [("sses", to("ss")), ("ied", short), ("ies", short), *[(x, kept(x)) for x in ("ws", "us", "ss")], ("s", lone)], w)

    PAST = ("ed", "edly", "ing", "ingly")

    def past(w, r1):
        cut = [(x, either(vowel_in, "", x)) for x in PAST]
        return _case(d, [("eed", bounded(r1, "eed", "ee")), ("eedly", bounded(r1, "eedly", "ee")), *cut], w)

    def was_cut(w):
        arms = " ".join(f"when {d.ends(w, x)} then {vowel_in(f'left({w}, length({w}) - {len(x)})')}" for x in PAST)
        return f"case when {d.ends(w, 'eed')} or {d.ends(w, 'eedly')} then false {arms} else false end"

    def repaired(w, cut):
        double = [(x + x, either(lambda s: f"{s} in ('a', 'e', 'o')", x + x, x)) for x in "bdfgmnprt"]
        return f"case when {cut} then {_case(d, [*[(x, to(x + 'e')) for x in ('at', 'bl', 'iz')], *double], w)} else {w} end"

    def final_y(w):
        return _case(d, [(y, either(lambda s: f"{d.octets(s)} > 1 and not {ends_in('aeiouy')(s)}", "i", y)) for y in "yY"], w)

    def second(w):
        table = "tional=tion enci=ence anci=ance abli=able entli=ent izer=ize ization=ize ational=ate ation=ate ator=ate alism=al aliti=al alli=al fulness=ful ousli=ous ousness=ous iveness=ive iviti=ive biliti=ble bli=ble"
        first = [(a, to(b)) for a, b in (x.split("=") for x in table.split())]
        return _case(d, [*first, ("ogi", either(ends_in("l"), "og", "ogi")), ("fulli", to("ful")), ("lessli", to("less")), ("li", either(ends_in("cdeghkmnrt"), "", "li"))], w)

    def third(w, r1, r2):
        table = "tional=tion ational=ate alize=al icate=ic iciti=ic ical=ic ful= ness="
        return _case(d, [*[(a, bounded(r1, a, b)) for a, b in (x.split("=") for x in table.split())], ("ative", bounded(r2, "ative"))], w)

    def fourth(w, r2):
        plain = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive".split()
        return _case(d, [*[(x, bounded(r2, x)) for x in plain], ("ize", bounded(r2, "ize", also=lambda s: f"{d.octets(s)} >= 5")), ("ion", bounded(r2, "ion", also=ends_in("st")))], w)

    def fifth(w, r1, r2):
        e = either(lambda s: f"{r2} <= length({s}) or ({r1} <= length({s}) and {s} <> 'past')", "", "e")
        return _case(d, [("e", e), ("l", bounded(r2, "l", also=ends_in("l")))], w)

    def sixth(w, r1):
        return _case(d, [("er", bounded(r1, "er")), ("est", bounded(r1, "est"))], w)

    def ready(x):
        arms = " ".join(f"when '{a}' then '{b}'" for a, b in IRREGULAR.items())
        stop = ", ".join(quoted(w) for w in ["", *STOP])
        irregular = ", ".join(quoted(w) for w in IRREGULAR)
        return f"case when {x} in ({stop}) then '' when {d.octets(x)} < 3 then {x} when {x} in ({irregular}) then case {x} {arms} end end"

    def marked(x, done):
        # null for what is done, which makes all later steps cheap
        bare = f"case when left({x}, 1) = '''' then substr({x}, 2) else {x} end"
        with_y = d.replaced(d.replaced(bare, "^y", "Y"), "([aeiouy])y", "{1}Y")
        return f"case when {done} is not null then null when instr({x}, 'y') > 0 then {with_y} else {bare} end"

    def region(x):
        return f"nullif(length(regexp_extract({x}, '{FIRST_REGION}', 0)), 0)"

    return [
        {"s": lambda g: d.right_trimmed(g("t"), CLOSERS)},
        {"done": lambda g: ready(g("s")), "s": lambda g: g("s")},
        {"done": lambda g: g("done"), "w": lambda g: marked(g("s"), g("done"))},
        {"done": lambda g: g("done"), "w": lambda g: g("w"), "r1": lambda g: f"coalesce({region(g('w'))}, length({g('w')}))"},
        {"done": lambda g: g("done"), "w": lambda g: phase_0(g("w")), "r1": lambda g: g("r1"), "r2": lambda g: f"{g('r1')} + coalesce({region(f'substr({g("w")}, {g("r1")} + 1)')}, length({g('w')}) - {g('r1')})"},
        *[
            {"done": lambda g: g("done"), "w": f, "r1": lambda g: g("r1"), "r2": lambda g: g("r2"), "cut": lambda g, n=n: was_cut(g("w")) if n == 1 else "false"}
            for n, f in enumerate(
                (
                    lambda g: plural(g("w")),
                    lambda g: past(g("w"), g("r1")),
                    lambda g: repaired(g("w"), g("cut")),
                    lambda g: final_y(g("w")),
                    lambda g: second(g("w")),
                    lambda g: third(g("w"), g("r1"), g("r2")),
                    lambda g: fourth(g("w"), g("r2")),
                    lambda g: fifth(g("w"), g("r1"), g("r2")),
                    lambda g: sixth(g("w"), g("r1")),
                )
            )
        ],
        {"stem": lambda g: f"coalesce({g('done')}, replace({g('w')}, 'Y', 'y'))"},
    ]


def stems(words: Column | str) -> Column:
    """The stems of an array of lower-case tokens, in their places; a stop word's or a lone sign's is empty.

    ``words`` is a column's name or an SQL expression.
    """
    text = f"transform({words}, t -> named_struct('t', t))"
    for step in stem_steps(Dialect(duck=False)):
        fields = ", ".join(f"'{name}', {make(lambda f: f'x.{f}')}" for name, make in step.items())
        text = f"transform({text}, x -> named_struct({fields}))"
    return F.expr(f"transform({text}, x -> x.stem)")


def stem(token: str) -> Column:
    """The stem of a lower-case token in a column or SQL expression."""
    return stems(f"array({token})")[0]


def stems_duck(relation: str) -> str:
    """DuckDB SQL: the rows of ``relation``, whose column ``t`` is a token, with ``stem``."""
    text = f"(select *, t as _t from {relation})"
    steps = stem_steps(Dialect(duck=True))
    for i, step in enumerate(steps):
        get = lambda f, i=i: "_t" if f == "t" else f"_{i}_{f}"
        fields = ", ".join(f"{make(get)} as {name if name == 'stem' else f'_{i + 1}_{name}'}" for name, make in step.items())
        text = f"(select *, {fields} from {text})"
    return f"(select * exclude (_t, {', '.join(f'_{i + 1}_{name}' for i, step in enumerate(steps) for name in step if name != 'stem')}) from {text})"
