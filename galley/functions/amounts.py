"""Amounts, units and rounding, Column to Column.

One decimal and whole numbers are rounded half to even on the exact binary value, which
format_number and rint do and round doesn't.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley import rules

from .text import bind, lookup, strip, unit_grams

#: A decimal number; nan and inf aren't amounts.
NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"


def number(x: Column) -> Column:
    """A text as a double, or null."""
    return bind(strip(x), lambda s: F.when(s.rlike(NUMBER), F.replace(s, F.lit("_"), F.lit("")).try_cast("double")))


def _ratio(x: Column) -> Column:
    """a/b, or null unless there are two numbers and the second isn't 0."""
    return bind(F.split(x, "/"), lambda p: F.when(F.size(p) == 2, F.try_divide(number(F.get(p, 0)), number(F.get(p, 1)))))


def parse_amount(amount: Column) -> Column:
    """An amount on a shopping list: a number, a/b, or a whole and a/b; words after a/b are ignored. Anything else is null."""

    def of(text: Column) -> Column:
        def fraction(words: Column) -> Column:
            first, second = F.get(words, 0), F.get(words, 1)
            mixed = (F.size(words) == 2) & F.contains(second, F.lit("/"))
            return F.when(mixed, number(first) + _ratio(second)).when(F.contains(first, F.lit("/")), _ratio(first))

        return F.when(F.contains(text, F.lit("/")), bind(F.split(text, r"(?U)\s+"), fraction)).otherwise(number(text))

    return bind(strip(amount), of)


def amount_grams(amount: Column, unit: Column) -> Column:
    """Grams of an amount in nutrition; what can't be read counts as 1."""
    parts = F.split(amount, "/")
    ratio = F.try_divide(number(F.get(parts, 0)), number(F.get(parts, 1)))
    value = F.when(F.contains(amount, F.lit("/")), ratio).otherwise(number(amount))
    return F.coalesce(value, F.lit(1.0)) * unit_grams(unit)


def to_base(amount: Column, unit: Column) -> Column:
    """struct(value, unit): tablespoons of a volume, ounces of a weight; null for other units."""
    volume, weight = lookup(rules.TBSP_PER_UNIT, unit), lookup(rules.OZ_PER_UNIT, unit)
    made = lambda factor, base: F.struct((amount * factor).alias("value"), F.lit(base).alias("unit"))
    return F.when(volume.isNotNull(), made(volume, "tbsp")).when(weight.isNotNull(), made(weight, "oz"))


def one_decimal(x: Column) -> Column:
    return F.call_function("format_number", x, F.lit("0.0"))


def rounded(x: Column) -> Column:
    """To one decimal, as a double."""
    return one_decimal(x).cast("double")


def whole(x: Column) -> Column:
    return x == F.floor(x)


def _int_text(x: Column) -> Column:
    return x.cast("bigint").cast("string")


def plain_text(x: Column) -> Column:
    """A double as text: no point for a whole number, no exponent."""
    return F.when(whole(x), _int_text(x)).otherwise(F.call_function("format_number", x, F.lit("0." + "#" * 25)))


def _either(x: Column, one: str, many: str) -> Column:
    return F.when(whole(x), F.struct(_int_text(x).alias("amount"), F.lit(one).alias("unit"))).otherwise(F.struct(one_decimal(x).alias("amount"), F.lit(many).alias("unit")))


def display(value: Column, base: Column, digits: int | None = None) -> Column:
    """struct(amount, unit) that shows a number of tablespoons or ounces; digits: of rounding before, so that thirds added in any order show the same."""
    near = (lambda x: x) if digits is None else (lambda x: F.round(x, digits))
    spoons, value = near(value * 3), near(value)
    volume = F.when(value >= 16, _either(value / 16, "cup", "cups")).when(value >= 1, _either(value, "tbsp", "tbsp")).otherwise(_either(spoons, "tsp", "tsp"))
    weight = F.when(value >= 16, _either(value / 16, "lb", "lbs")).otherwise(_either(value, "oz", "oz"))
    return F.when(base == "tbsp", volume).otherwise(weight)


def half_up(x: Column) -> Column:
    """To a whole number, halves up."""
    return F.floor(x + 0.5)
