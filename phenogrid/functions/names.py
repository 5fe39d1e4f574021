"""Species names, identifiers and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Land-cover classes 1 to 17 of the IGBP legend, and codes that stand for water.
LANDCOVER_NAMES = {
    1: "Evergreen Needleleaf Forest",
    2: "Evergreen Broadleaf Forest",
    3: "Deciduous Needleleaf Forest",
    4: "Deciduous Broadleaf Forest",
    5: "Mixed Forest",
    6: "Closed Shrublands",
    7: "Open Shrublands",
    8: "Woody Savannas",
    9: "Savannas",
    10: "Grasslands",
    11: "Permanent Wetlands",
    12: "Croplands",
    13: "Urban and Built-up",
    14: "Cropland/Natural Vegetation Mosaic",
    15: "Snow and Ice",
    16: "Barren or Sparsely Vegetated",
    17: "Water",
}
WATER_CODES = (0, 17, 254, 255)
BUILT_CODES = (13, 14)


def key(name: Column) -> Column:
    return F.lower(F.trim(name))


def primary_id(code: Column, taxon_key: Column, name: Column) -> Column:
    """Taxonomy code, else the numeric key, else the lower-cased name."""
    return F.coalesce(F.nullif(F.trim(code), F.lit("")), taxon_key.cast("string"), key(name))


def or_self(common: Column, scientific: Column) -> Column:
    return F.coalesce(F.nullif(common, F.lit("")), scientific)


def label_line(code: Column, scientific: Column, common: Column) -> Column:
    return F.concat_ws("\t", code, F.coalesce(scientific, code), or_self(common, F.coalesce(scientific, code)))


def display_name(common: Column, scientific: Column, code: Column) -> Column:
    """``common (scientific)``, one name where both agree, the code where there is none."""
    both = F.concat(common, F.lit(" ("), scientific, F.lit(")"))
    return F.coalesce(F.when(common != scientific, both).otherwise(F.coalesce(scientific, common)), code)


def prettify(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def is_binomial(name: Column) -> Column:
    """Exactly one blank."""
    return F.length(name) - F.length(F.replace(name, F.lit(" "), F.lit(""))) == 1


def landcover_name(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in LANDCOVER_NAMES.items() for x in (k, v)])
    return F.when(code.isin(*WATER_CODES), F.lit("Water")).otherwise(F.try_element_at(table, code))


#: Order of variables in reports: prefixes of each group in turn.
VARIABLE_GROUPS = (("latitude", "longitude"), ("temperature", "precipitation"), ("elevation", "canopy"), ("water_fraction", "urban_fraction"), ("LC:",))


def group_order(name: Column) -> Column:
    """Number of the group that a variable's name begins with; one past the last if none."""
    out = F.lit(len(VARIABLE_GROUPS))
    for i, prefixes in reversed(list(enumerate(VARIABLE_GROUPS))):
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | name.startswith(p)
        out = F.when(hit, i).otherwise(out)
    return out.cast("int")
