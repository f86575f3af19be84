"""Chat texts from the request payloads of traced model calls, whatever layout they came in.

The paths of the fields that can bear content are hashed into a fingerprint of each payload, and the fingerprint picks a
declared mapping from layout to turns: a prompt with its completion, instructions with input and output, the two texts of
one call, or messages as an array, whose contents are texts or lists of parts. One template then marks the turns; control strings
inside roles and texts are escaped so that they can be read back. All of it is column expressions; no rows leave the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.llm.common import let, packed, unpacked

#: Control strings of the template: a text, then turns of ``[INST]role[/INST]text</s>``.
BEGIN, ROLE, SAYS, END = "<s>", "[INST]", "[/INST]", "</s>"
#: A control string, or one that backslashes inside keep from being one.
_CONTROL = r"(<|\[)(\\*/?(?:s>|INST\]))"
_ESCAPED = r"(<|\[)\\(\\*/?(?:s>|INST\]))"
#: Who speaks what the loss counts.
LEARNED = "assistant"
#: Names of speakers in arrays of ``from`` and ``value``, and what they are called here.
SPEAKERS = {"human": "user", "gpt": "assistant", "model": "assistant"}
#: What stands between the text parts of one message.
BETWEEN_PARTS = "\n"


class Single(NamedTuple):
    """A turn of a fixed role: the text of one field."""

    role: str
    field: str


class Messages(NamedTuple):
    """The turns of an array of objects: their role and text fields, and further fields they may have."""

    field: str
    role: str = "role"
    text: str = "content"
    may_have: tuple[str, ...] = ()


#: Layouts by name (fixed values of the request formats).
MAPPINGS: dict[str, tuple[Single | Messages, ...]] = {
    "prompt": (Single("user", "prompt"),),
    "prompt_completion": (Single("user", "prompt"), Single("assistant", "completion")),
    "instructions_input": (Single("system", "instructions"), Single("user", "input")),
    "instructions_input_output": (Single("system", "instructions"), Single("user", "input"), Single("assistant", "output")),
    "input_output": (Single("user", "input"), Single("assistant", "output")),
    "call_texts": (Single("system", "system_text"), Single("user", "user_text")),
    "input_messages": (Messages("input", may_have=("id", "status", "type")),),
    "instructions_messages": (Single("system", "instructions"), Messages("input", may_have=("id", "status", "type"))),
    "messages": (Messages("messages", may_have=("id", "name")),),
    "speakers": (Messages("conversations", "from", "value"),),
}
#: Paths below a message's text field: a text, parts of text, parts of text and images, both in one payload.
_CONTENTS = ("_", "ARRAY<OBJECT<text: _, type: _>>", "ARRAY<OBJECT<detail: _, image_url: _, text: _, type: _>>",
             "ARRAY<OBJECT<image_url: _, text: _, type: _>>", "ARRAY<OBJECT<annotations: ARRAY<_>, text: _, type: _>>")
FIELDS = sorted({rule.field for rules in MAPPINGS.values() for rule in rules})


def _shapes(rule: Single | Messages) -> list[str]:
    """The nested paths that a rule's field may have."""
    if isinstance(rule, Single):
        return ["_"]
    found = ["ARRAY<_>"]
    for n in range(len(rule.may_have) + 1):
        for more in combinations(rule.may_have, n):
            for content in _CONTENTS:
                own = {rule.role: "_", rule.text: content} | dict.fromkeys(more, "_")
                found.append("ARRAY<OBJECT<" + ", ".join(f"{k}: {own[k]}" for k in sorted(own)) + ">>")
    return found


def layouts(mappings: dict[str, tuple[Single | Messages, ...]] = MAPPINGS) -> dict[str, str]:
    """Every declared set of paths and the mapping it selects."""
    found = {}
    for name, rules in mappings.items():
        texts = [""]
        for rule in sorted(rules, key=lambda r: r.field):
            texts = [f"{t}{rule.field}: {s};" for t in texts for s in _shapes(rule)]
        found |= dict.fromkeys(texts, name)
    return found


def field_paths(payload: Column) -> Column:
    """The nested paths of the fields of a variant that can bear content, in a fixed order; types of values are left out.

    A message field that holds a text here and parts there counts as one with a text.
    """
    def shape(field: str) -> Column:
        schema = F.schema_of_variant(F.try_variant_get(payload, f"$.{field}", "variant"))
        nested = F.regexp_replace(schema, r"(?<![A-Za-z0-9_`])(?:STRING|VOID|VARIANT|BIGINT|DOUBLE|BOOLEAN|FLOAT|BINARY|DATE|"
                                          r"TIMESTAMP(?:_NTZ)?|DECIMAL\(\d+,\s*\d+\))(?![A-Za-z0-9_`:(])", "_")
        return F.coalesce(F.concat(F.lit(f"{field}: "), nested, F.lit(";")), F.lit(""))

    return F.concat(*[shape(f) for f in FIELDS])


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _content(value: Column) -> Column:
    """The text of a message's content: itself, or that of its parts."""
    parts = F.try_variant_get(value, "$", "array<struct<text:string>>")
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), F.array_join(
        F.transform(parts, lambda p: p["text"]), BETWEEN_PARTS)).otherwise(F.try_variant_get(value, "$", "string"))


def _turns(payload: Column, rules: tuple[Single | Messages, ...]) -> Column:
    """The turns of a payload, as its layout's mapping says."""
    found = []
    for rule in rules:
        if isinstance(rule, Single):
            found.append(F.array(_turn(F.lit(rule.role), F.try_variant_get(payload, f"$.{rule.field}", "string"))))
            continue
        messages = F.try_variant_get(payload, f"$.{rule.field}", f"array<struct<`{rule.role}`:string,`{rule.text}`:variant>>")
        found.append(F.transform(messages, _message_turn(rule)))
    return F.concat(*found) if len(found) > 1 else found[0]


def _message_turn(rule: Messages) -> Callable[[Column], Column]:
    def turn(message: Column) -> Column:
        role = message[rule.role]
        if rule.role == "from":
            for name, called in SPEAKERS.items():
                role = F.when(message[rule.role] == name, called).otherwise(role)
        return _turn(role, _content(message[rule.text]))

    return turn


def escape(text: Column) -> Column:
    """One backslash more behind the first sign of every control string and of every escaped one."""
    return F.regexp_replace(text, _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def before_each(lengths: Column) -> Column:
    """For each of many lengths the sum of those before it, by blocks of about as many lengths as there are blocks."""
    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda t, x: t + x)

    def sums(values: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1))
        starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / width).cast("int"), F.lit(0)))
        return let(F.transform(starts, lambda b: total(F.slice(values, b * width + 1, width))), lambda blocks: let(
            F.transform(starts, lambda b: total(F.slice(blocks, 1, b))), lambda earlier: F.transform(values, lambda _, i: (
                F.element_at(earlier, F.floor(i / width).cast("int") + 1)
                + total(F.slice(values, (i - i % width) + 1, i % width))))))

    return F.when(F.size(lengths) == 0, F.array().cast("array<bigint>")).otherwise(let(lengths, sums))


def chat_text(turns: Column) -> Column:
    """``formatted, loss_mask`` of turns (an array of ``role, text``); the mask holds spans of code points, ``start`` up to ``end``."""
    marked = F.transform(turns, lambda t: F.struct(
        F.concat(F.lit(ROLE), escape(t["role"]), F.lit(SAYS)).alias("head"), escape(t["text"]).alias("text"),
        (t["role"] == LEARNED).alias("learned")))

    def made(held: Column) -> Column:
        lengths = F.transform(held, lambda m: (F.length(m["head"]) + F.length(m["text"]) + len(END)).cast("bigint"))
        spans = F.zip_with(held, before_each(lengths), lambda m, at: F.when(m["learned"], F.struct(
            (at + len(BEGIN) + F.length(m["head"])).alias("start"), (at + len(BEGIN) + F.length(m["head"]) + F.length(m["text"])).alias("end"))))
        body = F.array_join(F.transform(held, lambda m: F.concat(m["head"], m["text"], F.lit(END))), "")
        return F.struct(F.concat(F.lit(BEGIN), body).alias("formatted"), F.array_compact(spans).alias("loss_mask"))

    return let(marked, made)


def format_chats(requests: DataFrame, mappings: dict[str, tuple[Single | Messages, ...]] = MAPPINGS) -> DataFrame:
    """``requests`` with all their columns and, in the struct ``chat``, their payload as one chat text.

    ``requests``: ``payload_json``, the body of a model call as JSON text. ``chat`` holds the ``fingerprint`` of the payload's paths, the ``layout``
    that it selects, ``formatted``, ``loss_mask`` (spans of code points that the assistant says, ends excluded) and ``reason``: null, ``not_json`` or
    ``unknown_layout``, both without text and mask. Fields that no layout names do not matter, nor do the types of values. Null or absent roles and
    texts are empty; an array without messages gives no turns; parts without text give none. Repeated rows are formatted alike, an empty table stays
    empty, a column ``chat`` that was there before is replaced. A payload is formatted whole, as one row; one beyond the size that a variant may
    have (128 MB) counts as not JSON.
    """
    declared = layouts(mappings)
    by_print = F.create_map(*[c for paths, name in declared.items() for c in (F.xxhash64(F.lit(paths)), F.lit(name))])
    rows = packed(requests, "payload_json").withColumn("_payload", F.try_parse_json("payload_json"))
    rows = rows.withColumn("_print", F.when(F.col("_payload").isNotNull(), fingerprint(field_paths(F.col("_payload")))))
    rows = rows.withColumn("_layout", F.try_element_at(by_print, F.coalesce("_print", F.lit(0))))
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for name, rules in mappings.items():
        turns = F.when(F.col("_layout") == name, F.coalesce(
            _turns(F.col("_payload"), rules), F.array().cast("array<struct<role:string,text:string>>"))).otherwise(turns)
    rows = rows.withColumn("_chat", let(turns, lambda t: F.when(t.isNotNull(), chat_text(t))))
    reason = F.when(F.col("_payload").isNull(), "not_json").when(F.col("_layout").isNull(), "unknown_layout")
    chat = F.struct(F.col("_print").alias("fingerprint"), F.col("_layout").alias("layout"), F.col("_chat.formatted").alias("formatted"),
                    F.col("_chat.loss_mask").alias("loss_mask"), reason.alias("reason"))
    return unpacked(rows.withColumn("chat", chat), requests.columns, "chat")


def read_turns(formatted: Column) -> Column:
    """The turns of a chat text, as an array of ``role, text``."""
    pieces = F.split(F.substring(formatted, len(BEGIN) + 1, 1 << 30), END)

    def turn(piece: Column) -> Column:
        return let(F.split(piece, r"\[/INST\]"), lambda x: F.struct(
            unescape(F.substring(x[0], len(ROLE) + 1, 1 << 30)).alias("role"), unescape(x[1]).alias("text")))

    return let(pieces, lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), turn))


def learned_text(formatted: Column, loss_mask: Column) -> Column:
    """What lies under the loss mask, unescaped, nothing between its spans.

    Spans are cut from the text's form of four bytes a code point, so that each costs its own length only.
    """
    return let(F.encode(formatted, "UTF-32"), lambda wide: F.array_join(F.transform(loss_mask, lambda s: unescape(F.decode(
        F.substring(wide, (4 * s["start"] + 1).cast("int"), (4 * (s["end"] - s["start"])).cast("int")), "UTF-32"))), ""))
