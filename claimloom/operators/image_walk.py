"""The one step that needs a walk over the tags of a page: which elements enclose each image."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle

# Shipped to the executors by value, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SPACE = r"[ \t\n\r\f]"
_NAME = r"[A-Za-z_][-A-Za-z0-9_:.]*"
_ATTRIBUTES = rf"""(?:{_SPACE}+{_NAME}(?:=(?:"[^"]*"|'[^']*'|[^\s"'<>=`/]+(?!/)))?)*"""
# Elements whose content is no markup for some parsers.
_SCRIPT, _PLAIN = "script|style", "title|textarea|xmp|iframe|noembed|noframes|noscript|plaintext"
# A piece of regular markup, of which every parser reads the same, and the text behind it: start tag, end tag, or what holds no image.
_PIECE = re.compile(
    rf"""<(?:(?!(?i:{_SCRIPT}|{_PLAIN})[\s/>])([A-Za-z][-A-Za-z0-9]*)({_ATTRIBUTES}){_SPACE}*(/?)>|/([A-Za-z][-A-Za-z0-9]*){_SPACE}*>"""
    rf"""|((?i:{_SCRIPT})){_ATTRIBUTES}{_SPACE}*>[^<]*(?:<(?!!--|/\s*(?i:{_SCRIPT}))[^<]*)*</(?i:\5)>"""
    rf"""|((?i:{_PLAIN})){_ATTRIBUTES}{_SPACE}*>[^<]*</(?i:\6)>"""
    r"""|!--(?!-?>)[^-]*(?:-[^-]+)*-->|!(?i:doctype)[^<>]*>)[^<]*""")
_ATTRIBUTE = re.compile(rf"""({_NAME})(?:=(?:"([^"]*)"|'([^']*)'|([^\s"'<>=`/]+)))?""")
_LABELLED = re.compile("class|id", re.I)
_READ = ("class", "id", "src", "data-src", "width", "height")


class _ImageWalk(HTMLParser):
    """Notes every image with the class and id texts of its ancestors."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple[str, str]] = []
        self.images: list[tuple[str, str, str, str]] = []

    def handle_starttag(self, tag, attrs):
        named = {k: v or "" for k, v in reversed(attrs)}
        if tag == "img":
            around = "\n".join(label for _, label in self.open)
            source = named.get("src") or named.get("data-src") or ""
            self.images.append((source, named.get("width", ""), named.get("height", ""), around))
        if tag not in _VOID:
            self.open.append((tag, f"{named.get('class', '')} {named.get('id', '')}"))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return


def _images(html: str) -> list[tuple[str, str, str, str]]:
    """Source, width, height and ancestors' labels of every image.

    A page of regular markup is read piece by piece; anything else (bad tags, references in addresses, markup inside
    scripts' comments) is left to the parser, which takes ten times as long.
    """
    found = _regular_images(html)
    if found is None:
        walk = _ImageWalk()
        walk.feed(html)
        found = walk.images
    return found


def _regular_images(html: str) -> list[tuple[str, str, str, str]] | None:
    """The images of a page of regular markup, None if any of its markup is not regular."""
    images: list[tuple[str, str, str, str]] = []
    tags: list[str] = []
    labels: list[str] = []
    at = html.find("<")
    if at < 0:
        return images
    for piece in _PIECE.finditer(html, at):
        if piece.start() != at:
            return None
        at = piece.end()
        start, stated, closed, end, _, _ = piece.groups()
        if start is not None:
            tag = start.lower()
            label = " "
            if stated and (tag == "img" or _LABELLED.search(stated)):
                named = {name.lower(): double or single or bare for name, double, single, bare in reversed(_ATTRIBUTE.findall(stated))}
                if "&" in stated and any("&" in named.get(name, "") for name in _READ):
                    return None
                label = f"{named.get('class', '')} {named.get('id', '')}"
            else:
                named = {}
            if tag == "img":
                images.append((named.get("src") or named.get("data-src") or "", named.get("width", ""), named.get("height", ""), "\n".join(labels)))
            elif not closed and tag not in _VOID:
                tags.append(tag)
                labels.append(label)
        elif end is not None:
            tag = end.lower()
            if tags and tags[-1] == tag:
                tags.pop()
                labels.pop()
            elif tag in tags:
                i = len(tags) - 1 - tags[::-1].index(tag)
                del tags[i:], labels[i:]
    return images if at == len(html) else None


def walk_images(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
            rows += [(page_id, url, seq, *image) for seq, image in enumerate(_images(html))]
        yield pd.DataFrame(rows, columns=["page_id", "url", "seq", "src", "width", "height", "around"])
