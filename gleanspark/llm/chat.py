"""Chat formatting with typed content parts.

A message's content is plain text, or a JSON list of parts of the types text, image, audio and document. A visitor
has a method for each type; here its methods build column expressions, so that flattening, reference recording
and token counting stay in the JVM. Parts become text and placeholders in their order; each placeholder stands
for a number of tokens that the attachment is expanded to, and refers to an entry of the attachment list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import pick

PART = "struct<type:string,text:string,url:string,width:long,height:long,seconds:double,pages:long>"
TYPES = ("text", "image", "audio", "document")
BEGIN, END = "<|begin|>", "<|end|>"
#: Signs that keep texts from forging a marker: "<|" becomes "< |", and a text that ends with "<" has a blank put
#: behind it, so that no marker forms with what follows.
MARK, BROKEN = "<|", "< |"
TILE, TILE_TOKENS, IMAGE_TOKENS = 512, 170, 85
AUDIO_TOKENS_A_SECOND = 25
PAGE_TOKENS = 600
#: Markers around each message, and its role.
MESSAGE_TOKENS = 3
BLANK = "[ \\t\\n\\r\\f\\u000B]+"


def words(text: Column) -> Column:
    """Whitespace-separated pieces; the measure of text where no tokenizer is given."""
    clean = F.trim(F.regexp_replace(text, BLANK, " "))
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, " "))).cast("long")


class PartVisitor:
    """One method a part type, each giving a struct of ``kind``, ``flat`` (text or placeholder), ``tokens`` and ``ref``."""

    def visit(self, part: Column) -> Column:
        kinds = F.coalesce(part["type"], F.lit("text"))
        out = self.other(part)
        for t in TYPES:
            out = F.when(kinds == t, getattr(self, t)(part)).otherwise(out)
        return out

    @staticmethod
    def _struct(kind: Column | str, flat: Column, tokens: Column, ref: Column) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("kind"), flat.alias("flat"), tokens.cast("long").alias("tokens"), ref.cast("string").alias("ref"))

    def text(self, part: Column) -> Column:
        text = F.replace(F.coalesce(part["text"], F.lit("")), F.lit(MARK), F.lit(BROKEN))
        text = F.when(text.endswith("<"), F.concat(text, F.lit(" "))).otherwise(text)
        return self._struct("text", text, words(text), F.lit(None))

    def _attached(self, kind: str, part: Column, tokens: Column) -> Column:
        return self._struct(kind, F.lit(f"<|{kind}|>"), tokens, F.coalesce(part["url"], F.lit("")))

    def image(self, part: Column) -> Column:
        """A base cost and one for each tile; of unknown size: one tile."""
        tiles = [F.greatest(F.lit(1), F.ceil(F.coalesce(part[side], F.lit(0)) / TILE)) for side in ("width", "height")]
        return self._attached("image", part, IMAGE_TOKENS + TILE_TOKENS * tiles[0] * tiles[1])

    def audio(self, part: Column) -> Column:
        return self._attached("audio", part, F.greatest(F.lit(1), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS_A_SECOND)))

    def document(self, part: Column) -> Column:
        return self._attached("document", part, PAGE_TOKENS * F.greatest(F.lit(1), F.coalesce(part["pages"], F.lit(1))))

    def other(self, part: Column) -> Column:
        """An unknown type: an empty text, so that it is neither lost in the count of parts nor shown."""
        return self._struct(F.lit("unknown"), F.lit(""), F.lit(0), F.lit(None))


def content_parts(content: Column) -> Column:
    """The parts of a content: those of a JSON list of objects, else one part with the content as text."""
    listed = F.when(content.rlike(r"^\s*\[\s*\{"), F.from_json(content, f"array<{PART}>"))
    plain = F.array(F.from_json(F.lit("{}"), PART).withField("type", F.lit("text")).withField("text", content))
    # a list that isn't valid JSON, or whose objects have no type, is text
    typed = F.coalesce(F.forall(listed, lambda p: F.coalesce(p["type"].isNotNull(), F.lit(False))), F.lit(False))
    return F.when(typed & (F.size(listed) > 0), listed).otherwise(plain)


def flattened(conversations: DataFrame, visitor: PartVisitor | None = None) -> DataFrame:
    """A row for each distinct message: ``conv_id``, ``turn``, ``role`` and ``parts``, the visited parts in their order."""
    v = visitor or PartVisitor()
    c = pick(conversations, "conv_id", "turn", "role", "text").filter("conv_id is not null")
    c = c.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return c.select("conv_id", "turn", "role", "text", F.transform(content_parts(F.col("text")), v.visit).alias("parts"))


def chat_format(conversations: DataFrame, visitor: PartVisitor | None = None) -> DataFrame:
    """A row for each conversation: ``conv_id``, ``n_messages``, ``formatted``, ``n_text_tokens``, ``n_tokens`` (attachments
    expanded, markers included) and ``attachments``, in order of their placeholders: ``message`` (from 0), ``kind``, ``ref``, ``tokens``.

    Messages stand in order of turn (null first), then role and text; equal rows count once. A null role is
    ``user``; a null text is empty. Texts can't forge markers. Rows without a conversation are left out; an empty table
    gives no rows; other columns are ignored; texts are taken whole. A content that looks like a list of
    parts but can't be read as one is text. An unknown part type adds nothing. A missing reference is empty.
    """
    messages = flattened(conversations, visitor)
    flat = messages.select(
        "conv_id",
        F.struct(
            F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"),
            "role",
            "text",
            F.concat(F.lit(BEGIN), F.replace("role", F.lit(MARK), F.lit(BROKEN)), F.lit("\n"), F.array_join(F.transform("parts", lambda p: p["flat"]), ""), F.lit(END + "\n")).alias("out"),
            F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.when(p["kind"] == "text", p["tokens"]).otherwise(0)).alias("text_tokens"),
            F.aggregate("parts", F.lit(MESSAGE_TOKENS).cast("long"), lambda a, p: a + p["tokens"]).alias("tokens"),
            F.transform(F.filter("parts", lambda p: p["ref"].isNotNull()), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))).alias("refs"),
        ).alias("m"),
    )
    # what a conversation holds is needed in one place; nothing else is gathered
    gathered = flat.groupBy("conv_id").agg(F.array_sort(F.array_distinct(F.collect_list("m"))).alias("ms"))
    attachments = F.flatten(F.transform("ms", lambda m, i: F.transform(m["refs"], lambda r: F.struct(i.alias("message"), r["kind"].alias("kind"), r["ref"].alias("ref"), r["tokens"].alias("tokens")))))
    total = lambda field: F.aggregate("ms", F.lit(0).cast("long"), lambda a, m: a + m[field])
    return gathered.select(
        "conv_id",
        F.size("ms").cast("long").alias("n_messages"),
        F.array_join(F.transform("ms", lambda m: m["out"]), "").alias("formatted"),
        total("text_tokens").alias("n_text_tokens"),
        total("tokens").alias("n_tokens"),
        attachments.alias("attachments"),
    )


def chat_rows(conversations: DataFrame) -> DataFrame:
    """``chat_format`` with the attachments as one JSON text, which SQL engines compare alike."""
    return chat_format(conversations).withColumn("attachments", F.to_json("attachments"))


def mixed_parts(conversations: DataFrame) -> DataFrame:
    """``conversations`` with typed parts as content, of the kind that turns take by turns, so that every type is met; one turn in five stays plain."""
    text, turn = F.to_json(F.struct(F.lit("text").alias("type"), "text")), F.coalesce("turn", F.lit(0))
    listed = lambda *parts: F.concat(F.lit("["), F.array_join(F.array(*parts), ","), F.lit("]"))
    n = F.pmod(F.col("conv_id") + turn, F.lit(5))
    image = F.concat(F.lit('{"type":"image","url":"i'), "conv_id", F.lit('.png","width":'), turn * 300, F.lit(',"height":'), turn * 200 + 100, F.lit("}"))
    audio = F.concat(F.lit('{"type":"audio","url":"a'), "conv_id", F.lit('.wav","seconds":'), turn * 2, F.lit(".5}"))
    pages = F.concat(F.lit('{"type":"document","url":"d'), "conv_id", F.lit('.pdf","pages":'), turn, F.lit("}"))
    forged = F.lit('{"type":"text","text":"a <"}'), F.lit('{"type":"text","text":"|image|> b"}')
    content = F.when(n == 0, listed(text, image)).when(n == 1, listed(audio, text, audio)).when(n == 2, listed(*forged, pages, text)).when(n == 3, listed(text, pages, audio, image))
    return pick(conversations, "conv_id", "turn", "role", "text").withColumn("text", F.coalesce(content, "text"))


def mixed_sql() -> str:
    """The rows of ``chat_rows`` of ``mixed_parts``."""
    turn, text = "coalesce(turn, 0)", """'{"type":"text","text":' || to_json(text) || '}'"""
    image = f"""'{{"type":"image","url":"i' || conv_id || '.png","width":' || {turn} * 300 || ',"height":' || ({turn} * 200 + 100) || '}}'"""
    audio = f"""'{{"type":"audio","url":"a' || conv_id || '.wav","seconds":' || {turn} * 2 || '.5}}'"""
    pages = f"""'{{"type":"document","url":"d' || conv_id || '.pdf","pages":' || {turn} || '}}'"""
    forged = """'{"type":"text","text":"a <"},{"type":"text","text":"|image|> b"}'"""
    listed = lambda *parts: "'[' || " + " || ',' || ".join(parts) + " || ']'"
    content = f"case (conv_id + {turn}) % 5 when 0 then {listed(text, image)} when 1 then {listed(audio, text, audio)} when 2 then {listed(forged, pages, text)} when 3 then {listed(text, pages, audio, image)} else text end"
    return sql(f"(select conv_id, turn, role, {content} as text from conversations)")


def sql(source: str = "conversations") -> str:
    """The rows of ``chat_rows``, from DuckDB's JSON functions."""
    number = "coalesce(try_cast(p->>'{}' as {}), 0)"
    w, h, sec, pages = (number.format(*x) for x in (("width", "bigint"), ("height", "bigint"), ("seconds", "double"), ("pages", "bigint")))
    clean = r"trim(regexp_replace(body, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')"
    return rf"""
    with c as (
        select distinct conv_id, coalesce(turn, -{1 << 62}) turn, coalesce(role, 'user') role, coalesce(text, '') txt from {source} where conv_id is not null),
    m as (select *, row_number() over (partition by conv_id order by turn, role, txt) - 1 msg from c),
    looks as (select *, case when regexp_matches(txt, '^\s*\[\s*\{{') and json_valid(txt) then cast(txt as json) end j from m),
    typed as (select *, j is not null and len(list_filter(json_extract(j, '$[*]'), lambda x: json_extract_string(x, '$.type') is null)) = 0 ok from looks),
    parts as (
        select conv_id, msg, role, 0 pos, cast(null as json) p, 'text' kind, txt raw from typed where not ok
        union all
        select conv_id, msg, role, unnest(range(cast(json_array_length(j) as bigint))) pos, unnest(json_extract(j, '$[*]')) p, p->>'type' kind, coalesce(p->>'text', '') raw from typed where ok),
    seen as (select *, case when kind = 'text' then replace(raw, '{MARK}', '{BROKEN}') || case when ends_with(raw, '<') then ' ' else '' end when kind in ('image', 'audio', 'document') then '<|' || kind || '|>' else '' end body from parts),
    counted as (
        select *, case kind when 'text' then case when {clean} = '' then 0 else len(string_split({clean}, ' ')) end
            when 'image' then {IMAGE_TOKENS} + {TILE_TOKENS} * cast(greatest(1, ceil({w} / {TILE})) * greatest(1, ceil({h} / {TILE})) as bigint)
            when 'audio' then cast(greatest(1, ceil({sec} * {AUDIO_TOKENS_A_SECOND})) as bigint)
            when 'document' then {PAGE_TOKENS} * greatest(1, coalesce(try_cast(p->>'pages' as bigint), 1)) else 0 end tokens from seen),
    per as (
        select conv_id, msg, '{BEGIN}' || replace(any_value(role), '{MARK}', '{BROKEN}') || chr(10) || string_agg(body, '' order by pos) || '{END}' || chr(10) line,
            sum(case when kind = 'text' then tokens else 0 end) text_tokens, sum(tokens) + {MESSAGE_TOKENS} tokens,
            string_agg('{{"message":' || msg || ',"kind":"' || kind || '","ref":' || to_json(coalesce(p->>'url', '')) || ',"tokens":' || tokens || '}}', ',' order by pos)
                filter (where kind in ('image', 'audio', 'document')) refs
        from counted group by conv_id, msg)
    select conv_id, count(*) n_messages, string_agg(line, '' order by msg) formatted, cast(sum(text_tokens) as bigint) n_text_tokens,
        cast(sum(tokens) as bigint) n_tokens, '[' || coalesce(string_agg(refs, ',' order by msg), '') || ']' attachments
    from per group by conv_id"""
