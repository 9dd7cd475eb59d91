"""HTML pieces with regular expressions: tags, attributes, text, character references."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .text import strip

_FREQUENT = frozenset(("amp;", "quot;", "lt;", "gt;", "nbsp;", "apos;"))
_REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
#: The rest of a tag up to its end: a value in quotes may hold ``>``.
ATTRS = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+"""
#: A comment, or a script or style element; whichever starts first takes what the other's marks stand in.
_HIDDEN = rf"(?is)<(?:!--.*?-->|(script|style)\b{ATTRS}>.*?</\1\s*>)"


def _code_point(reference: Column) -> Column:
    """The character of a numeric reference such as ``#233`` or ``#xe9``."""
    number = F.when(
        F.substring(reference, 2, 1).isin("x", "X"), F.conv(F.substring(reference, 3, 8), 16, 10)
    ).otherwise(F.substring(reference, 2, 8)).try_cast("bigint")
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("�")


def unescape(c: Column) -> Column:
    """Character references replaced in one pass, so ``&amp;lt;`` becomes ``&lt;`` and no further."""
    # A map is searched from its start: the names that pages are full of come first.
    order = sorted((n for n in html5 if n.endswith(";")), key=lambda n: n not in _FREQUENT)
    names = "\x02".join(f"{name[:-1]}\x01{html5[name]}" for name in order)
    table = F.str_to_map(F.lit(names), F.lit("\x02"), F.lit("\x01"))

    def piece(reference: Column, follow: Column) -> Column:
        named = F.coalesce(F.try_element_at(table, reference), F.concat(F.lit("&"), reference, F.lit(";")))
        char = F.when(F.startswith(reference, F.lit("#")), _code_point(reference)).otherwise(named)
        return F.concat(char, follow)

    def decoded(v: Column) -> Column:
        found = F.regexp_extract_all(v, F.lit(_REFERENCE))
        return let(
            F.split(v, _REFERENCE, -1),
            lambda plain: F.concat(
                F.get(plain, F.lit(0)), F.array_join(F.transform(found, lambda r, i: piece(r, F.get(plain, i + 1))), "")
            ),
        )

    return let(c, lambda v: F.when(F.contains(v, F.lit("&")), decoded(v)).otherwise(v))


def scripts(html: Column) -> Column:
    """Every script element that is not inside a comment, whole and in document order."""
    return F.filter(F.regexp_extract_all(html, F.lit(_HIDDEN), F.lit(0)), lambda e: e.rlike("(?i)^<script"))


def visible(html: Column) -> Column:
    """Markup without comments, scripts and style sheets."""
    return F.regexp_replace(html, _HIDDEN, "")


def tags(html: Column, names: str) -> Column:
    """Every opening tag with one of the names (regular-expression alternatives), in document order."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{names})(?=[\s/>]){ATTRS}>"), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """Trimmed, decoded attribute value; empty when the attribute is missing."""
    # Attributes are passed one at a time, so that text inside another value is never taken for one.
    value = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>]++)"""
    passed = rf"""(?:[\s/"']*+(?!{name}\s*=)[^\s=>/"']++(?:\s*+=\s*+{value})?+)*+"""
    # An opening quote is passed only if it is closed, so the group is the value without quotes.
    inside = r"""(?:"(?=[^"]*+")|'(?=[^']*+'))?+((?<=")[^"]*+|(?<=')[^']*+|[^\s"'>]++)"""
    return strip(unescape(F.regexp_extract(tag, rf"""(?is)^<[^\s/>]++{passed}[\s/"']*+{name}\s*=\s*{inside}""", 1)))


def inner_text(markup: Column, separator: str = " ") -> Column:
    """Text between the tags: every run trimmed, empty runs dropped, the rest joined."""
    def read(v: Column) -> Column:
        runs = F.transform(F.split(v, rf"(?s)<[/!?A-Za-z]{ATTRS}>"), lambda t: strip(unescape(t)))
        joined = F.array_join(F.filter(runs, lambda t: t != ""), separator)
        # Most texts hold no tag: they are one run.
        return F.when(F.contains(v, F.lit("<")), joined).otherwise(strip(unescape(v)))

    return let(markup, read)


def after_first(parts: Column) -> Column:
    """A split without what stood before its first mark."""
    return F.slice(parts, F.lit(2), F.lit(1 << 30))


def blocks(html: Column, name: str, ends: str) -> Column:
    """Content of each element called ``name``, cut at its end tag, at another end in ``ends``, or at the next start."""
    inside = after_first(F.split(html, rf"(?i)<(?:{name})(?=[\s>/])", -1))
    return F.transform(inside, lambda b: F.regexp_extract(b, rf"(?is)^{ATTRS}>(.*?)(?:</(?:{ends})\b|\z)", 1))


def first_text(html: Column, name: str) -> Column:
    """Text of the first element called ``name``, null when there is none or it is empty."""
    inner = F.regexp_extract(html, rf"(?is)<{name}(?=[\s/>]){ATTRS}>(.*?)</{name}\s*>", 1)
    return F.nullif(inner_text(inner, ""), F.lit(""))
