"""Text helpers shared by every operator: trimming, field names, word sets, slugs and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# The characters counted as white space when text is trimmed or split.
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the inside of a Java character class.
WS = r"\s\x1c-\x1f\x85\p{Z}"
# Letters, digits and underscore of any script: the inside of a Java class for "part of a word".
WORD = r"\p{L}\p{N}_"

# Field-name synonyms, whole name to canonical name.
SYNONYMS = {"title": "name", "cost": "price"}
# A trailing parenthesis holding only one of these is dropped from a field name.
UNIT_SUFFIXES = "mm|cm|m|meter|meters|metre|metres|in|inch|inches|ft|kg|g|mpa|%"
# Canonical names never scored and never filled.
NEVER_POPULATE = ("floor price",)
# Canonical names of our own annotations, never product attributes.
ANNOTATION_FIELDS = ("suggested category",)
# Template section whose fields no supplier page states.
COMMERCIAL_SECTION = "Pricing & Inventory"
# Words ignored when text is classified.
STOP_WORDS = (
    "the a an and or for with of in to by on is are be this that as at from it its you your can may will "
    "not no if then than which when where each per into these some any"
).split()
# Spellings that count as the same vocabulary word.
SPELLINGS = {"aluminum": "aluminium", "colour": "color", "grey": "gray"}

PATH_SEPARATOR = " > "


def strip(c: Column) -> Column:
    """Trim every kind of white space at both ends, not only the space character."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def is_blank(c: Column) -> Column:
    """True for null and for text of white space only."""
    return F.coalesce(strip(c), F.lit("")) == ""


def collapse_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"[{WS}]+", " "))


def clean_key(c: Column) -> Column:
    """A spec-table key: one space between words, no trailing colons."""
    return strip(F.rtrim(collapse_spaces(c), F.lit(":")))


def canonical(c: Column) -> Column:
    """Field name for comparison: lower case, no wrappers, no unit suffix, one separator, synonyms applied."""
    n = strip(F.btrim(F.lower(strip(c)), F.lit("<>")))
    n = let(n, lambda x: F.when(F.endswith(x, F.lit(")")), strip(F.regexp_replace(x, rf"[{WS}]*\((?:{UNIT_SUFFIXES})\)$", ""))).otherwise(x))
    n = strip(F.regexp_replace(n, rf"[{WS}_\-]+", " "))

    def synonym(x: Column) -> Column:
        for name, target in SYNONYMS.items():
            found = F.when(x == name, target) if name == next(iter(SYNONYMS)) else found.when(x == name, target)
        return found.otherwise(x)

    return let(n, synonym)


def alias_key(c: Column) -> Column:
    """Name as looked up in the alias table."""
    return F.regexp_replace(F.lower(strip(c)), rf"[{WS}_\-]+", " ")


def candidate_attribute(canon: Column, value: Column) -> Column:
    """Could a field of this canonical name be a product attribute?  Not our annotations, not a bare URL or e-mail."""
    text = F.coalesce(value, F.lit(""))
    url = text.rlike(rf"(?i)^[{WS}]*(?:https?://|www\.)")
    mail = F.contains(text, F.lit("@")) & text.rlike(rf"^[{WS}]*[^@{WS}]+@[^@{WS}]+\.[^@{WS}]+[{WS}]*$")
    return ~canon.isin(*ANNOTATION_FIELDS) & ~url & ~mail


def never_populate(name: Column) -> Column:
    return canonical(name).isin(*NEVER_POPULATE)


def is_commercial(section: Column) -> Column:
    return F.coalesce(strip(section) == COMMERCIAL_SECTION, F.lit(False))


def word_set(c: Column) -> Column:
    """Distinct lower-case words longer than one character, stop words removed."""
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+")
    long_words = F.filter(words, lambda w: F.length(w) > 1)
    return F.array_except(long_words, F.split(F.lit(" ".join(STOP_WORDS)), " "))


def ascii_words(c: Column) -> Column:
    """Distinct lower-case runs of ASCII letters and digits."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z0-9]+)")), F.lower))


def whole_words(c: Column) -> Column:
    """Distinct lower-case whole words of any script, as a word-boundary search would see them."""
    return F.array_distinct(F.split(F.lower(c), f"[^{WORD}]+"))


def naming_literals(c: Column) -> Column:
    """A naming convention without its [placeholders] and its leading label."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\[[^\]]*\]", " "), "(?i)pattern:", " ")


def vocabulary_text(c: Column) -> Column:
    """Text as compared with vocabulary terms: lower case, punctuation to single spaces, spellings unified."""
    t = F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    for word, unified in SPELLINGS.items():
        t = F.regexp_replace(t, rf"\b{word}\b", unified)
    return t


def vocabulary_tokens(c: Column) -> Column:
    return F.filter(F.split(vocabulary_text(c), " "), lambda w: w != "")


def slug(c: Column, fallback: str = "category") -> Column:
    """Letters and digits, everything else one underscore; ``fallback`` when nothing is left."""
    safe = F.btrim(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit(fallback))


def file_slug(c: Column, fallback: str = "unknown") -> Column:
    """File-safe name that stays readable: keeps letters, digits and `` _-&()``."""
    safe = strip(F.regexp_replace(c, r"[^\p{L}\p{N} _\-&()]", "_"))
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit(fallback))


def path_array(c: Column) -> Column:
    """``a > b > c`` text to an array of its non-empty parts."""
    return F.filter(F.transform(F.split(c, ">"), strip), lambda p: p != "")


def path_text(c: Column) -> Column:
    return F.array_join(c, PATH_SEPARATOR)


def python_round(c: Column, digits: int) -> Column:
    """Round half to even."""
    return F.bround(c, digits)
