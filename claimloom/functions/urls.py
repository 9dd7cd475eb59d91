"""URL pieces, joining and record ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .text import strip

# One pattern for all parts of a URL: scheme, host part, path, query, fragment.
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def host(url: Column) -> Column:
    """Host part as written, with user and port if given."""
    return F.regexp_extract(url, _PARTS, 2)


def path(url: Column) -> Column:
    """Path without parameters, query and fragment."""
    return F.regexp_replace(F.regexp_extract(url, _PARTS, 3), ";[^/]*$", "")


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def record_id(sku: Column, url: Column) -> Column:
    """SKU if there is one, else the last path segment, else the host."""
    segment = F.substring_index(F.rtrim(path(url), F.lit("/")), "/", -1)
    return F.coalesce(F.nullif(sku, F.lit("")), F.nullif(segment, F.lit("")), host(url))


def _fold_dots(p: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""

    def fold(segments: Column) -> Column:
        kept = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.array_append(acc, s)),
        )
        folder = F.element_at(segments, -1).isin(".", "..")
        return let(
            F.array_join(kept, "/"),
            lambda joined: F.concat(F.lit("/"), joined, F.when(folder & (joined != ""), "/").otherwise("")),
        )

    return let(F.split(F.substring(p, 2, 1 << 30), "/", -1), fold)


def url_base(url: Column) -> Column:
    """The parts of a page's URL that links are resolved against; compute it once per page."""
    return let(
        F.regexp_extract(url, _PARTS, 3),
        lambda p: F.struct(
            url.alias("url"), scheme(url).alias("scheme"), host(url).alias("host"), p.alias("path"),
            F.regexp_replace(F.when(p == "", "/").otherwise(p), "[^/]*$", "").alias("folder"),
            without_fragment(url).alias("page"),
        ),
    )


def resolve(base: Column, href: Column) -> Column:
    """``href`` seen from a page described by :func:`url_base`."""
    root = F.concat(base["scheme"], F.lit("://"), base["host"])

    def relative(h: Column) -> Column:
        rest = F.concat(F.regexp_extract(h, _PARTS, 4), F.regexp_extract(h, _PARTS, 5))
        own = F.regexp_extract(h, _PARTS, 3)
        merged = F.when(F.startswith(h, F.lit("/")), own).otherwise(F.concat(base["folder"], own))
        return let(
            merged,
            lambda m: F.concat(root, F.when(F.contains(m, F.lit("/.")), _fold_dots(m)).otherwise(m), rest),
        )

    return let(
        strip(href),
        lambda h: F.when(h == "", base["url"])
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(F.startswith(h, F.lit("//")), F.concat(base["scheme"], F.lit(":"), h))
        .when(F.startswith(h, F.lit("#")), F.concat(base["page"], h))
        .when(F.startswith(h, F.lit("?")), F.concat(root, base["path"], h))
        .otherwise(relative(h)),
    )


def absolute_url(base: Column, href: Column) -> Column:
    """``href`` seen from the page at ``base``."""
    return let(url_base(base), lambda b: resolve(b, href))


def percent_decoded(c: Column) -> Column:
    """Percent escapes decoded, ``+`` left alone; text with broken escapes is returned as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def robots_target(url: Column) -> Column:
    """The part of a URL that robots rules are compared with."""
    target = F.regexp_replace(percent_decoded(url), r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    target = F.regexp_replace(target, r"^//[^/?#]*", "")
    return F.when(target == "", "/").otherwise(target)


def is_web_url(c: Column) -> Column:
    return c.rlike("(?i)^https?://")


def skipped_link(href: Column) -> Column:
    """Links that never lead to another page."""
    return (href == "") | href.rlike("(?i)^(?:mailto:|tel:|javascript:|#)")


__all__ = [
    "scheme", "host", "path", "without_fragment", "record_id", "url_base", "resolve", "absolute_url", "percent_decoded",
    "robots_target", "is_web_url", "skipped_link",
]
