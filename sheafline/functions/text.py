"""Text expressions: marked spans, cleaning, reply parsing, prompt rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and marker texts that results are compared on.
SPAN_PATTERN = r"(?d)<(.+?)>"
GROUP_PATTERN = r"<([^<>]+)>"
FAILED_REPLY = "0 Error"
DRY_RUN_REPLY = "0 Test mode"
NULL_TEXT = "nan"
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_span(text: Column | str) -> Column:
    """Content of the first ``<...>``; null without one. ``(?d)``: only LF ends a line for ``.``."""
    return F.nullif(F.regexp_extract(_col(text), SPAN_PATTERN, 1), F.lit(""))


def strip_marks(text: Column | str) -> Column:
    """Remove every angle bracket, keep what is inside."""
    return F.translate(_col(text), "<>", "")


def strip_newlines(text: Column | str) -> Column:
    """Trim LF from both ends; a null text is scored as the literal ``nan``."""
    return F.btrim(F.coalesce(_col(text).cast("string"), F.lit(NULL_TEXT)), F.lit("\n"))


def strip_space(text: Column | str) -> Column:
    """Trim all Unicode white space (plain ``trim`` takes blanks only); looks at the ends only."""
    return F.btrim(_col(text), F.lit(WHITE_SPACE))


def words(text: Column | str) -> Column:
    """Tokens between runs of white space."""
    return F.filter(F.split(_col(text), f"[{WHITE_SPACE}]+"), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    return F.size(words(text))


def marked_groups(text: Column | str) -> Column:
    """All ``<...>`` groups without a bracket inside; unlike ``first_span`` they may cross lines."""
    return F.regexp_extract_all(_col(text), F.lit(GROUP_PATTERN), F.lit(1))


def preview(text: Column | str, limit: int, ellipsis: bool = True) -> Column:
    """The first ``limit`` characters, marked with ``...`` where something was cut."""
    text = _col(text)
    head = F.substring(text, 1, limit)
    return F.when(F.length(text) > limit, F.concat(head, F.lit("..."))).otherwise(head) if ellipsis else head


def parse_label(reply: Column | str) -> Column:
    """First ``0`` or ``1`` of a reply as INT; 0 where there is none."""
    return F.coalesce(parse_label_or_null(reply), F.lit(0))


def parse_label_or_null(reply: Column | str) -> Column:
    """First ``0`` or ``1`` of a reply as INT; null where there is none."""
    return F.nullif(F.regexp_extract(_col(reply), "[01]", 0), F.lit("")).cast("int")


def render_prompt(
    text: Column | str,
    system: Column | str | None = None,
    label: Column | None = None,
    style: str = "chat",
) -> Column:
    """Prompt text for one row.

    ``chat``: ``<system>\\n\\nUser: Text: <text>\\nAssistant:`` with `` <label>`` appended for
    training rows; without ``system`` the leading blank lines stay. ``plain``: ``<system>\\n\\nUser:
    <text>``. ``raw``: the text itself.
    """
    text = _col(text)
    prefix = F.lit("") if system is None else F.lit(system) if isinstance(system, str) else system
    if style == "raw":
        return text
    if style == "plain":
        return F.concat(prefix, F.lit("\n\nUser: "), text)
    if style != "chat":
        raise ValueError(f"unknown prompt style {style!r}")
    body = F.concat(prefix, F.lit("\n\nUser: Text: "), text, F.lit("\nAssistant:"))
    if label is None:
        return body
    return F.concat(body, F.when(label.isNull(), F.lit("")).otherwise(F.concat(F.lit(" "), label.cast("string"))))


def chat_messages(text: Column | str, system: Column | str, nested: bool = False) -> Column:
    """System and user message as an array; ``nested`` wraps the content in typed parts."""
    system = F.lit(system) if isinstance(system, str) else system

    def message(role: str, content: Column) -> Column:
        if nested:
            content = F.array(F.struct(F.lit("text").alias("type"), content.alias("text")))
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", system), message("user", _col(text)))


REPLY_SCHEMA = (
    "struct<output:array<struct<type:string,content:array<struct<type:string,text:string>>>>>"
)


def reply_from_json(payload: Column | str) -> Column:
    """First ``output_text`` of the first ``message`` that has one, stripped; else ``0 Error``."""
    output = F.from_json(_col(payload), REPLY_SCHEMA)["output"]
    messages = F.filter(output, lambda item: item["type"] == "message")
    parts = F.filter(
        F.flatten(F.transform(messages, lambda item: F.coalesce(item["content"], F.array()))),
        lambda part: part["type"] == "output_text",
    )
    return F.coalesce(strip_space(F.get(parts, F.lit(0))["text"]), F.lit(FAILED_REPLY))


def unwrap_reply(messages: Column | str) -> Column:
    """Content of the last message of a generated conversation, stripped; empty gives ``''``."""
    messages = _col(messages)
    last = F.get(messages, F.size(messages) - 1)["content"]
    return strip_space(F.coalesce(last, F.lit("")))


def unwrap_generated(outputs: Column | str, generated: str = "generated_text") -> Column:
    """``unwrap_reply`` of the first generated item; ``''`` for an empty output list."""
    return unwrap_reply(F.get(_col(outputs), F.lit(0))[generated])


def completion_suffix(result: Column | str, prompt: Column | str) -> Column:
    """What a model appended after its prompt, stripped."""
    result, prompt = _col(result), _col(prompt)
    return strip_space(F.substring(result, F.length(prompt) + 1, F.length(result)))


def class_name(label: Column | str, positive: str = "Euphemism", negative: str = "Not euphemism") -> Column:
    return F.when(_col(label) == 1, F.lit(positive)).otherwise(F.lit(negative))
