"""HTML column functions: block and paragraph selection, text of an element.

Pages are cut with regular expressions and array functions inside the JVM, one
row at a time and without a shuffle. The patterns need no look-around.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

_MAX_CODE = 0x10FFFF
_ALL = 2**30  # longer than any array, short enough not to overflow in slice


def clean_markup(page: Column) -> Column:
    """Page without comments, scripts and style sheets, whose content is not text."""
    bare = F.regexp_replace(page, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(bare, r"(?is)<(script|style)(\s[^>]*)?>.*?</(script|style)\s*>", "")


def _named_codes() -> Column:
    names = {**html.entities.name2codepoint, "apos": ord("'")}
    return F.create_map(*[F.lit(part) for pair in sorted(names.items()) for part in pair])


def decode_entities(text: Column) -> Column:
    """Named and numeric character references replaced in one pass."""
    named = _named_codes()
    # every piece after the first one starts right behind an ampersand
    pieces = F.transform(
        F.split(text, "&"),
        lambda p, i: F.struct(
            p.alias("piece"),
            F.when(i > 0, F.regexp_extract(p, "^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", 1))
            .otherwise(F.lit(""))
            .alias("name"),
            i.alias("i"),
        ),
    )
    coded = F.transform(
        pieces,
        lambda s: F.struct(
            s["piece"].alias("piece"),
            s["name"].alias("name"),
            s["i"].alias("i"),
            F.when(s["name"] == "", F.lit(None).cast("long"))
            .when(s["name"].rlike("^#[0-9]"), F.substr(s["name"], F.lit(2)).try_cast("long"))
            .when(
                s["name"].rlike("^#[xX]0*[0-9a-fA-F]{1,8}$"), F.conv(F.substr(s["name"], F.lit(3)), 16, 10).try_cast("long")
            )
            .when(s["name"].startswith("#"), F.lit(None).cast("long"))
            .otherwise(F.try_element_at(named, s["name"]).cast("long"))
            .alias("code"),
        ),
    )

    def restore(s: Column) -> Column:
        valid = s["code"].between(1, _MAX_CODE) & ~s["code"].between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(s["code"]), 8, "0")), "UTF-32")
        rest = F.substr(s["piece"], F.length(s["name"]) + 2)
        return (
            F.when(s["i"] == 0, s["piece"])
            .when(F.coalesce(valid, F.lit(False)), F.concat(char, rest))
            .otherwise(F.concat(F.lit("&"), s["piece"]))
        )

    return F.when(text.contains("&"), F.array_join(F.transform(coded, restore), "")).otherwise(text)


def element_text(markup: Column) -> Column:
    """Text of a piece of markup: tags dropped, then character references decoded."""
    return decode_entities(F.regexp_replace(markup, "<[^>]*>", ""))


def first_element_text(page: Column, tag: str) -> Column:
    """Text of the first element with this tag, empty when there is none."""
    return element_text(F.regexp_extract(page, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1))


def blocks(page: Column, tag: str, css_class: str | None = None) -> Column:
    """Inner markup of every element with this tag and exactly this class attribute.

    The page is cut at the opening tags. A piece ends where its own element
    closes, found by counting nested elements of the same tag.
    """
    if css_class is None:
        opening = rf"(?i)<{tag}(?:\s[^>]*)?>"
    else:
        opening = rf"""(?i)<{tag}\s(?:[^>]*\s)?class\s*=\s*["']{css_class}["'][^>]*>"""
    chunks = F.slice(F.split(page, opening), 2, _ALL)

    def close(chunk: Column) -> Column:
        parts = F.split(chunk, rf"(?i)</{tag}\s*>")
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("taken"))

        def step(acc: Column, part: Column) -> Column:
            opened = F.size(F.regexp_extract_all(part, F.lit(rf"(?i)<{tag}[\s>]"), F.lit(0)))
            return F.when(acc["depth"] <= 0, acc).otherwise(
                F.struct((acc["depth"] + opened - 1).alias("depth"), (acc["taken"] + 1).alias("taken"))
            )

        return F.aggregate(
            parts, start, step, lambda acc: F.array_join(F.slice(parts, F.lit(1), acc["taken"]), f"</{tag}>")
        )

    return F.transform(chunks, close)


def nth_paragraph(block: Column, index: Column | int) -> Column:
    """Text of paragraph ``index`` (from 0), NULL past the last one.

    A paragraph ends at its closing tag or where the next one opens.
    """
    index = F.lit(index) if isinstance(index, int) else index
    opened = F.get(F.split(block, r"(?i)<p(?:\s[^>]*)?>"), index + 1)
    return element_text(F.get(F.split(opened, r"(?i)</p\s*>"), F.lit(0)))
