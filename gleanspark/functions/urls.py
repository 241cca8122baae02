"""URLs: top-level domain and its score, utility pages, decoding, relative links, partition numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TLD_SCORES = {"gov": 1.0, "edu": 0.95, "org": 0.9, "com": 0.75, "net": 0.7, "us": 0.7, "io": 0.6, "dev": 0.6, "info": 0.4, "biz": 0.3, "xyz": 0.2, "top": 0.1}
OTHER_TLD_SCORE = 0.05
UTILITY = "privacy|terms|404|error|policy|legal"


def host(url: Column) -> Column:
    """What stands between ``://`` and the next slash; empty without a scheme."""
    return F.regexp_extract(url, "://([^/]*)", 1)


def tld(url: Column) -> Column:
    """One of the known domains, else ``unknown``; ports and user names aren't taken off."""
    last = F.regexp_extract(host(url), "[.]([^.]*)$", 1)
    return F.when(last.isin(*TLD_SCORES), last).otherwise("unknown")


def tld_score(domain: Column) -> Column:
    out = F.lit(OTHER_TLD_SCORE)
    for name, score in TLD_SCORES.items():
        out = F.when(domain == name, F.lit(score)).otherwise(out)
    return out


def tld_sql(url: str) -> str:
    last = f"regexp_extract(regexp_extract({url}, '://([^/]*)', 1), '[.]([^.]*)$', 1)"
    return f"case when {last} in ({', '.join(repr(x) for x in TLD_SCORES)}) then {last} else 'unknown' end"


def tld_score_sql(domain: str) -> str:
    arms = " ".join(f"when '{k}' then {v}" for k, v in TLD_SCORES.items())
    return f"cast(case {domain} {arms} else {OTHER_TLD_SCORE} end as double)"


def is_utility(url: Column) -> Column:
    """Whether it names a page of terms, errors and the like."""
    return F.lower(url).rlike(UTILITY)


def decoded(text: Column) -> Column:
    """``%xx`` and ``+`` replaced; null where the text is malformed."""
    return F.try_url_decode(text)


def leniently_decoded(text: Column) -> Column:
    """The same for any text: of the two signs after a ``%`` the leading hex digits count (none is nought), and a ``%`` with fewer than two behind it is dropped."""
    pieces = F.regexp_extract_all(text, F.lit("(?s)%..|[^%]+|%"), F.lit(0))
    digits = lambda p: F.lpad(F.regexp_extract(p, "^%([0-9a-fA-F]{0,2})", 1), 2, "0")
    code = lambda p: F.when(p == "%", "").when(p.startswith("%"), digits(p)).otherwise(F.hex(F.encode(F.replace(p, F.lit("+"), F.lit(" ")), "utf-8")))
    return F.make_valid_utf8(F.unhex(F.array_join(F.transform(pieces, code), "")).cast("string"))


def leniently_decoded_sql(text: str) -> str:
    """The same in DuckDB, of texts whose bytes are valid UTF-8 when decoded."""
    piece = "case when p = '%' then '' when p[1] = '%' then lpad(regexp_extract(p, '^%([0-9a-fA-F]{0,2})', 1), 2, '0') else hex(encode(replace(p, '+', ' '))) end"
    return f"decode(unhex(array_to_string(list_transform(regexp_extract_all({text}, '(?s)%..|[^%]+|%'), lambda p: {piece}), '')))"


def resolved(link: Column, base: Column) -> Column:
    """A link as it is if it begins with http, else put behind the page's base; null without either."""
    return F.when(link.startswith("http"), link).when(base != "", F.concat(base, link))


LOW = (1 << 32) - 1


def _bytes(text: Column) -> Column:
    """The bytes as an array of numbers."""
    digits = F.hex(F.encode(text, "utf-8"))
    pairs = F.filter(F.regexp_extract_all(digits, F.lit(".."), F.lit(0)), lambda x: x != "")
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("long"))


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of the bytes, which count as signed ones: from 128 on all higher bits are set."""
    signed = lambda b: F.when(b < 128, b).otherwise(b + (LOW - 255))
    return F.aggregate(_bytes(text), F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(signed(b)) * 16777619).bitwiseAND(F.lit(LOW)))


def _times(h: Column, factor: int) -> Column:
    """The low 32 bits of a product, in steps that don't overflow."""
    low, high = h.bitwiseAND(F.lit(0xFFFF)) * F.lit(factor), (F.shiftrightunsigned(h, 16) * F.lit(factor)).bitwiseAND(F.lit(0xFFFF)) * F.lit(1 << 16)
    return (low + high).bitwiseAND(F.lit(LOW))


def url_hash(url: Column) -> Column:
    """``fnv1a`` with its bits mixed once more (murmur's finalizer)."""

    def mixed(steps: Column, by: int) -> Column:
        return F.transform(steps, lambda h: h.bitwiseXOR(F.shiftrightunsigned(h, by)))

    def times(steps: Column, factor: int) -> Column:
        return F.transform(steps, lambda h: _times(h, factor))

    steps = mixed(F.array(fnv1a(url)), 16)  # each step in an array of one, so that its expression is computed once
    for factor, by in ((0x85EBCA6B, 13), (0xC2B2AE35, 16)):
        steps = mixed(times(steps, factor), by)
    return steps[0]


def fnv1a_sql(text: str) -> str:
    each = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: cast('0x' || b as bigint))"
    return f"list_reduce(list_prepend(2166136261::bigint, {each}), lambda h, b: cast((xor(h, case when b < 128 then b else b + {LOW - 255} end)::hugeint * 16777619) % {LOW + 1} as bigint))"


def url_hash_sql(url: str) -> str:
    out = "xor(h, h >> 16)"
    for factor, by in ((0x85EBCA6B, 13), (0xC2B2AE35, 16)):
        out = f"list_transform([cast((({out})::hugeint * {factor}) % {LOW + 1} as bigint)], lambda x: xor(x, x >> {by}))[1]"
    return f"list_transform([{fnv1a_sql(url)}], lambda h: {out})[1]"


def shard(url: Column, n: int) -> Column:
    """The same one of ``n`` parts for equal URLs."""
    return (url_hash(url) % n).cast("int")
