"""String functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The C locale's white space.
WHITESPACE = " \t\n\r\x0b\x0c"


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def split(text: Column, token: str) -> Column:
    """Split at a literal token; an empty token gives single characters, '' gives ['']."""
    return F.split(text, re.escape(token), -1)


def join(parts: Column, separator: str) -> Column:
    return F.array_join(parts, separator)


def starts_with(text: Column, prefix: str) -> Column:
    return F.startswith(text, F.lit(prefix))


def ends_with(text: Column, suffix: str) -> Column:
    return F.endswith(text, F.lit(suffix))


def child_id(composite: Column) -> Column:
    """'parent:child' to child; a single id is its own child."""
    return F.element_at(F.split(composite, ":", -1), -1)


def parent_id(composite: Column) -> Column:
    """'parent:child' to parent; null for a single id."""
    parts = F.split(composite, ":", -1)
    return F.when(F.size(parts) > 1, F.element_at(parts, 1))


def clean_author(raw: Column) -> Column:
    """Drop everything from the last '<' on and trim."""
    return trim(F.regexp_replace(raw, r"<[^<]*$", ""))


def message_summary(message: Column) -> Column:
    """Text up to the first blank line, else the first line, on one line."""
    head = F.when(F.contains(message, F.lit("\n\n")), F.substring_index(message, "\n\n", 1)).otherwise(
        F.substring_index(message, "\n", 1)
    )
    return trim(F.replace(head, F.lit("\n"), F.lit("    ")))


def _replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape_legacy_csv(message: Column) -> Column:
    """Backslash before comma and quote, line breaks spelled out, all in quotes."""
    body = _replace_all(message, [(",", "\\,"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")])
    return F.concat(F.lit('"'), body, F.lit('"'))


def escape_string(text: Column) -> Column:
    """Backslash before backslash and quote, control characters spelled out."""
    return _replace_all(text, [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")])


def quote_json(text: Column) -> Column:
    return F.concat(F.lit('"'), escape_string(text), F.lit('"'))


def quote_csv(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(escape_string(text), F.lit(","), F.lit("\\,")), F.lit('"'))


def bar_length(count: Column, width: Column, largest: Column) -> Column:
    """Number of marks that show ``count`` when the largest change gets ``width`` marks."""
    scaled = F.floor(((count - 1) * (width - 1) + largest - 1) / F.when(largest >= 2, largest - 1))
    return F.when(largest >= 2, scaled).otherwise(count)


def change_bar(mark: str, count: Column, width: Column, largest: Column) -> Column:
    return F.repeat(F.lit(mark), F.greatest(bar_length(count, width, largest), F.lit(0)).cast("int"))


def summary_line(files: Column, added: Column, removed: Column) -> Column:
    """' 2 files changed, 1 insertion(+)': counted nouns, zero parts left out."""
    # The words of the line.

    def part(n: Column, noun: str, sign: str) -> Column:
        plural = F.when(n > 1, F.lit("s")).otherwise(F.lit(""))
        text = F.concat(F.lit(", "), n.cast("string"), F.lit(f" {noun}"), plural, F.lit(f"({sign})"))
        return F.when(n > 0, text).otherwise(F.lit(""))

    plural = F.when(files != 1, F.lit("s")).otherwise(F.lit(""))
    head = F.concat(F.lit(" "), files.cast("string"), F.lit(" file"), plural, F.lit(" changed"))
    return F.concat(head, part(added, "insertion", "+"), part(removed, "deletion", "-"))


def crc32(payload: Column) -> Column:
    return F.crc32(payload)
