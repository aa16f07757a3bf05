"""Prices and quantities in texts. Null in, null out; so does a text without a usable value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.dialect import quoted

# Units and what they are written as.
UNITS = {"kg": "KG", "kgs": "KG", "g": "G", "gm": "G", "gms": "G", "mg": "MG", "ml": "ML", "l": "L", "ltr": "L", "litre": "L", "liter": "L"}
_UNIT = "kg|kgs|g|gm|gms|mg|ml|l|ltr|litre|liter"
AMOUNT = r"(?<!\d)(\d{1,7}(?:\.\d{1,2})?)(?!\d)"
AMOUNT_OR_COMMA = r"(?<!\d)(\d{1,7}(?:[.,]\d{1,2})?)(?!\d)"
QUANTITY = rf"(?i)(?<!\d)(\d+(?:\.\d+)?)\s*({_UNIT})\b"
ORACLE_AMOUNT = r"(?:^|[^0-9])([0-9]{1,7}(?:\.[0-9]{1,2})?)(?:$|[^0-9])"
ORACLE_AMOUNT_OR_COMMA = r"(?:^|[^0-9])([0-9]{1,7}(?:[.,][0-9]{1,2})?)(?:$|[^0-9])"
ORACLE_QUANTITY = rf"(?:^|[^0-9])([0-9]+(?:\.[0-9]+)?)\s*({_UNIT})\b"


def _usable(amount: Column) -> Column:
    """Prices are positive, and a number that can be a year is taken for one."""
    return (amount > 0) & ~amount.between(1900, 2100)


def price(text: Column) -> Column:
    """The first amount as written, with the currency sign; the first number decides, a later one isn't tried."""
    found = F.regexp_extract(text, AMOUNT, 1)
    return F.when(_usable(found.try_cast("double")), F.concat(F.lit("₹"), found))


def plain_price(normal_text: Column) -> Column:
    """The first amount of a text in normal form as a plain number with the currency sign; commas are dropped and zeros at the end too."""
    amount = F.regexp_replace(F.regexp_extract(normal_text, AMOUNT_OR_COMMA, 1), ",", "").try_cast("double")
    digits = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", amount), "0+$", ""), r"\.$", "")
    return F.when(_usable(amount), F.concat(F.lit("₹"), digits))


def quantity(text: Column) -> Column:
    """The first number with a unit, as number, blank and unit."""
    unit = F.lower(F.regexp_extract(text, QUANTITY, 2))
    names = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return F.when(unit != "", F.concat_ws(" ", F.regexp_extract(text, QUANTITY, 1), names[unit]))


def named_unit(number: Column, unit: Column) -> Column:
    """A quantity from its parts; an unknown unit is only put in capitals."""
    names = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return F.concat_ws(" ", number, F.coalesce(F.try_element_at(names, F.lower(unit)), F.upper(unit)))


def _unit_sql(unit: str) -> str:
    return f"CASE lower({unit}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in UNITS.items()) + " END"


def price_sql(text: str) -> str:
    found = f"regexp_extract({text}, {quoted(ORACLE_AMOUNT)}, 1)"
    number = f"TRY_CAST({found} AS DOUBLE)"
    return f"CASE WHEN {number} > 0 AND NOT {number} BETWEEN 1900 AND 2100 THEN concat('₹', {found}) END"


def plain_price_sql(text: str) -> str:
    number = f"TRY_CAST(replace(regexp_extract({text}, {quoted(ORACLE_AMOUNT_OR_COMMA)}, 1), ',', '') AS DOUBLE)"
    digits = f"rtrim(rtrim(printf('%.2f', {number}), '0'), '.')"
    return f"CASE WHEN {number} > 0 AND NOT {number} BETWEEN 1900 AND 2100 THEN concat('₹', {digits}) END"


def quantity_sql(text: str) -> str:
    unit = f"regexp_extract({text}, {quoted(ORACLE_QUANTITY)}, 2, 'i')"
    return f"CASE WHEN {unit} <> '' THEN concat(regexp_extract({text}, {quoted(ORACLE_QUANTITY)}, 1, 'i'), ' ', {_unit_sql(unit)}) END"
