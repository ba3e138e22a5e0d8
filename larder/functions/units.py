"""Unit algebra as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: unit, dimension, factor to the dimension's base
UNITS = (
    ("g", "mass", 1.0), ("kg", "mass", 1000.0), ("pincee", "mass", 0.5),
    ("ml", "volume", 1.0), ("cl", "volume", 10.0), ("dl", "volume", 100.0), ("l", "volume", 1000.0), ("cac", "volume", 5.0), ("cas", "volume", 15.0), ("verre", "volume", 200.0),
    ("piece", "piece", 1.0),
)
DIMENSION_OF_BASE = {"g": "mass", "ml": "volume", "piece": "piece"}


def to_base(qty: Column, dimension: Column, factor: Column, base: Column, density: Column, piece_g: Column) -> Column:
    """A quantity in an ingredient's base unit, over grams where dimensions differ; null where a density or weight that is needed is missing or zero."""
    value, density, piece_g = qty * factor, F.nullif(density, F.lit(0.0)), F.nullif(piece_g, F.lit(0.0))
    target = F.when(base == "g", "mass").when(base == "ml", "volume").otherwise("piece")
    grams = F.when(dimension == "mass", value).when(dimension == "volume", value * density).otherwise(value * piece_g)
    return F.when(dimension == target, value).when(target == "mass", grams).when(target == "volume", grams / density).otherwise(grams / piece_g)


def practical(qty: Column, unit: Column) -> Column:
    """What one measures in a kitchen: a quantity rounded to the step of its unit and size, never to nothing."""
    weight = F.when(qty < 20, 1.0).when(qty < 500, 5.0).when(qty < 1000, 10.0).otherwise(50.0)
    step = (
        F.when(unit == "piece", F.when(qty < 1, 0.5).otherwise(1.0))
        .when(unit.isin("g", "ml"), weight)
        .when(unit.isin("kg", "l"), F.when(qty < 1, 0.05).otherwise(0.1))
        .when(unit == "cl", F.when(qty < 10, 0.5).otherwise(1.0))
        .when(unit.isin("dl", "cac", "cas", "verre"), 0.5)
        .when(unit == "pincee", 1.0)
        .when(unit.startswith("u:"), F.when(qty < 2, 0.25).otherwise(0.5))
        .otherwise(0.01)
    )
    return F.when(qty <= 0, 0.0).otherwise(F.greatest(F.round(F.round(qty / step) * step, 2), step))


def reference_factor(base: Column) -> Column:
    """Prices compare by kilogram, litre or piece."""
    return F.when(base == "piece", 1).otherwise(1000)


def age(birth: Column, day: Column) -> Column:
    """Whole years on a day, exact on birthdays."""
    before = (F.month(day) < F.month(birth)) | ((F.month(day) == F.month(birth)) & (F.dayofmonth(day) < F.dayofmonth(birth)))
    return F.year(day) - F.year(birth) - before.cast("int")


def coefficient(years: Column) -> Column:
    """Share of a grown-up's portion by age."""
    return F.when(years < 1, 0.0).when(years < 3, 0.3).when(years < 5, 0.5).when(years < 12, 0.7).when(years < 15, 0.8).otherwise(1.0)
