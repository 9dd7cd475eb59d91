"""Measurements in text: numbers with either separator style, length units, dimensions and option lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .text import WHITE_SPACE, WS, strip

CANONICAL_UNIT = "mm"
HIGH = 0.9
LOW = 0.3

# Length unit to millimetres.
TO_MM = {
    "mm": 1.0, "millimeter": 1.0, "millimetre": 1.0, "millimeters": 1.0, "millimetres": 1.0,
    "cm": 10.0, "centimeter": 10.0, "centimetre": 10.0, "centimeters": 10.0, "centimetres": 10.0,
    "m": 1000.0, "meter": 1000.0, "metre": 1000.0, "meters": 1000.0, "metres": 1000.0,
    "in": 25.4, "inch": 25.4, "inches": 25.4, '"': 25.4, "″": 25.4,
}
# Fixed patterns: a length unit, and a number with any separators.
UNIT = r"(?:millimet(?:er|re)s?|centimet(?:er|re)s?|met(?:er|re)s?|inches|inch|mm|cm|in|m|\"|″)"
NUMBER = r"[0-9][0-9.,]*"

# One pattern for a number, optionally more numbers along other axes, optionally a unit.  Matching rewrites the text
# to its four groups between marks, so every later step is plain splitting instead of another match.
_MARK = "\x01"
# Fixed patterns: a measurement along up to three axes, and a list of options.
_MEASURE = (
    rf"(?i)^([+-]?{NUMBER})(?:[{WS}]*[x×][{WS}]*({NUMBER})(?:[{WS}]*[x×][{WS}]*({NUMBER}))?)?[{WS}]*({UNIT})?$"
)
_OPTIONS = (
    rf"(?i)^((?:{NUMBER}[{WS}]*/[{WS}]*)+{NUMBER})[{WS}]*({UNIT})[{WS}]*(?:/[{WS}]*custom[\p{{L}}\p{{N}}_]*\.?)?$"
)
# Fixed pattern: the units that mark a length along one axis (metres are not among them).
_AXIS_UNIT = r"(?i)(?:mm|cm|millimet(?:er|re)s?|centimet(?:er|re)s?|in|inch(?:es)?|[\"″])"


def mm_factor(unit: Column) -> Column:
    """Millimetres per unit, null for a unit that is not a length."""
    pairs = "|".join(f"{name}={factor}" for name, factor in TO_MM.items())
    table = F.str_to_map(F.lit(pairs), F.lit(r"\|"), F.lit("="))
    return F.try_element_at(table, F.lower(strip(unit))).cast("double")


def parse_number(c: Column) -> Column:
    """Struct (v, ambiguous) of a number written with European or US separators."""
    s = F.translate(c, WHITE_SPACE, "")
    no_comma, no_dot = F.translate(s, ",", ""), F.translate(s, ".", "")
    commas, dots = F.length(s) - F.length(no_comma), F.length(s) - F.length(no_dot)
    tail = F.length(F.substring_index(s, ",", -1))
    dot_last = F.length(F.substring_index(s, ".", -1)) < tail
    text = (
        F.when((commas > 0) & (dots > 0), F.when(dot_last, no_comma).otherwise(F.translate(no_dot, ",", ".")))
        .when((commas == 1) & tail.isin(1, 2), F.translate(s, ",", "."))
        .when(commas > 0, no_comma)
        .when(dots > 1, no_dot)
        .otherwise(s)
    )
    ambiguous = (commas == 1) & (dots == 0) & (tail == 3)
    return F.struct(text.try_cast("double").alias("v"), ambiguous.alias("ambiguous"))


def _round4(c: Column) -> Column:
    return F.round(c, 4)


def _spec(kind: str, text: Column, nums: Column | None, confidence: float) -> Column:
    empty = F.lit(None).cast("array<double>")
    return F.struct(
        F.lit(kind).alias("kind"),
        text.alias("text"),
        (empty if nums is None else nums).alias("nums"),
        F.lit(None if nums is None else CANONICAL_UNIT).cast("string").alias("unit"),
        F.lit(confidence).alias("confidence"),
    )


def normalize_value(c: Column) -> Column:
    """One spec value as struct (kind, text, nums, unit, confidence).

    ``kind`` is ``scalar`` or ``dims`` (numbers in mm) when the value is a length beyond doubt, else ``text``:
    at high confidence for plain words, at low confidence for a number that cannot be read without guessing.
    """
    raw = strip(c.cast("string"))
    groups = F.split(F.regexp_replace(raw, _MEASURE, f"{_MARK}$1{_MARK}$2{_MARK}$3{_MARK}$4"), _MARK)
    return F.when(raw == "", _spec("text", raw, None, LOW)).when(
        raw.rlike("^[+-]?[0-9]"),
        let(groups, lambda g: _read_measure(raw, g)),
    ).when(raw.isNotNull(), _spec("text", raw, None, HIGH))


def _read_measure(raw: Column, g: Column) -> Column:
    matched = F.size(g) == 5
    many = F.get(g, F.lit(2)) != ""
    signed = F.substring(F.get(g, F.lit(1)), 1, 1).isin("+", "-")
    numbers = F.transform(F.filter(F.slice(g, 2, 3), lambda p: p != ""), parse_number)

    def measured(m: Column) -> Column:
        clear = m["factor"].isNotNull() & F.forall(m["numbers"], lambda n: n["v"].isNotNull() & ~n["ambiguous"])
        mm = F.transform(m["numbers"], lambda n: _round4(n["v"] * m["factor"]))
        return (
            F.when(~clear, _spec("text", raw, None, LOW))
            .when(many, _spec("dims", raw, mm, HIGH))
            .otherwise(_spec("scalar", raw, mm, HIGH))
        )

    parsed = F.struct(numbers.alias("numbers"), mm_factor(F.get(g, F.lit(4))).alias("factor"))
    return F.when(~matched | (many & signed), _spec("text", raw, None, HIGH)).otherwise(let(parsed, measured))


def decimal_text(c: Column, keep_point: bool = False) -> Column:
    """A number with at most four decimals as plain text: ``2.5``, and ``3`` or ``3.0`` for a whole one.

    Null for a number of more digits than a decimal holds; callers then keep the text they have.
    """
    whole = F.regexp_replace(c.try_cast("decimal(34,0)").cast("string"), "^-0$", "0")
    tail = F.lit(".0" if keep_point else "")
    fraction = F.regexp_replace(c.try_cast("decimal(34,4)").cast("string"), "0+$", "")
    return F.when(c == F.floor(c), F.concat(whole, tail)).otherwise(fraction)


def format_value(spec: Column) -> Column:
    """A normalised value back as text: whole numbers without ``.0``, dimensions joined by `` x ``."""
    def joined(texts: Column) -> Column:
        plain = F.forall(texts, lambda x: x.isNotNull())
        return F.when(plain, F.concat_ws(" ", F.array_join(texts, " x "), spec["unit"])).otherwise(spec["text"])

    return F.when(spec["nums"].isNull(), spec["text"]).otherwise(let(F.transform(spec["nums"], lambda n: decimal_text(n)), joined))


def option_list(c: Column) -> Column:
    """``2.4/2.5/3 Meters`` as one measurement per option; null unless every option is a clear number."""
    raw = strip(c.cast("string"))
    groups = F.split(F.regexp_replace(raw, _OPTIONS, f"{_MARK}$1{_MARK}$2"), _MARK)

    def read(g: Column) -> Column:
        parts = F.filter(F.transform(F.split(F.get(g, F.lit(1)), "/"), strip), lambda o: o != "")
        numbers = F.transform(parts, parse_number)
        clear = F.forall(numbers, lambda n: n["v"].isNotNull() & ~n["ambiguous"]) & (F.size(numbers) >= 2)
        texts = F.transform(
            numbers, lambda n: F.concat(decimal_text(_round4(n["v"]), keep_point=True), F.lit(" "), F.get(g, F.lit(2)))
        )
        return let(texts, lambda found: F.when((F.size(g) == 3) & clear & F.forall(found, lambda x: x.isNotNull()), found))

    candidate = F.contains(raw, F.lit("/")) & raw.rlike("^[0-9]")
    return F.when(candidate, let(groups, read))


def from_mm(mm: Column, unit: Column) -> Column:
    """Millimetres in another unit, null for a unit that is not a length."""
    return _round4(mm / mm_factor(unit))


def first_number(c: Column) -> Column:
    """The first number in a text, thousands commas removed."""
    found = F.regexp_extract(c.cast("string"), r"([-+]?[0-9][0-9,]*\.?[0-9]*)", 1)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def single_axis_length(c: Column) -> Column:
    """True for a length along one axis: a number and an mm/cm/inch unit, no ``x`` between axes."""
    text = c.cast("string")
    axes = F.contains(F.lower(text), F.lit("x")) | F.contains(text, F.lit("×"))
    return F.coalesce(~axes & text.rlike(_AXIS_UNIT) & text.rlike("[0-9]"), F.lit(False))


def size_mm(c: Column) -> Column:
    """The size in mm when the text is one number with a unit, else null."""
    return let(normalize_value(c), lambda spec: F.when(spec["kind"] == "scalar", spec["nums"][0]))


def confirmed_numeric(c: Column) -> Column:
    """True when the text is exactly one measurement with a unit."""
    return F.coalesce(normalize_value(c)["kind"] == "scalar", F.lit(False))
