"""Field-name aliases: an observed name that stands for a template field, sometimes only for certain values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SINGLE_AXIS = "single_axis_length"

# Target field, observed name, condition on the value (empty for none), in order of preference.
ALIASES = (
    ("Diameter", "Size", ""),
    ("Diameter", "Dimensions", SINGLE_AXIS),
    ("Diameter", "Dia", ""),
    ("Grade", "Steel Grade", ""),
    ("Grade", "Fe Grade", ""),
    ("Length", "Cut Length", ""),
    ("Length", "Bar Length", ""),
    ("Length", "Overall Length", ""),
    ("Length", "Roll Length", ""),
    ("Brand", "Manufacturer", ""),
    ("Color", "Colour", ""),
    ("Size", "Height", SINGLE_AXIS),
    ("Size", "Profile Height", SINGLE_AXIS),
    ("Size", "Tile Thickness", SINGLE_AXIS),
)


def alias_table(spark: SparkSession, aliases=ALIASES) -> DataFrame:
    """Aliases as (alias_ord, target, alias, needs_length); replaceable by any table of that shape."""
    rows = ", ".join(
        f"({i}, '{target}', '{alias}', {str(guard == SINGLE_AXIS).lower()})"
        for i, (target, alias, guard) in enumerate(aliases)
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(alias_ord, target, alias, needs_length)")
