"""Assignment of cell text to a typed table column.

The checks and messages are those a PostgreSQL insert gives, so a rejected
load reads the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import KINDS, NUMBER_SHAPE, Kind, date_or_null, number_or_null

# Column types a new table may have and the Spark type of each.
SPARK_TYPES = {
    "TEXT": "string",
    "NUMERIC": "decimal(38,9)",
    "INTEGER": "int",
    "BOOLEAN": "boolean",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
    "JSONB": "variant",
}
# Accepted boolean input, any case.
TRUE_INPUT = ("t", "tr", "tru", "true", "y", "ye", "yes", "on", "1")
FALSE_INPUT = ("f", "fa", "fal", "fals", "false", "n", "no", "of", "off", "0")
INTEGER_SHAPE = r"^[+-]?[0-9]+$"


def _syntax(type_name: str):
    return lambda text: F.concat(F.lit(f'invalid input syntax for type {type_name}: "'), text, F.lit('"'))


def _whole(integer_type: str):
    return lambda text, _: F.when(text.rlike(INTEGER_SHAPE), text.try_cast(integer_type))


def _whole_message(text: Column) -> Column:
    too_big = F.concat(F.lit('value "'), text, F.lit('" is out of range for type integer'))
    return F.when(text.rlike(INTEGER_SHAPE), too_big).otherwise(_syntax("integer")(text))


def _numeric(text: Column, _) -> Column:
    return F.when(text.rlike(NUMBER_SHAPE), text.try_cast("decimal(38,9)"))


def _numeric_message(text: Column) -> Column:
    return F.when(text.rlike(NUMBER_SHAPE), F.lit("numeric field overflow")).otherwise(_syntax("numeric")(text))


def _boolean(_, word: Column) -> Column:
    return F.when(word.isin(*TRUE_INPUT), True).when(word.isin(*FALSE_INPUT), False)


def _as_element(text: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))


def json_or_null(text: Column, element: Column) -> Column:
    """Variant for text that is exactly one JSON value.

    The parser stops after the first value and ignores what follows. Text that
    is valid both inside ``[...]`` and as a member of ``{...}`` cannot hold a
    second value nor close the bracket early.
    """
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(element.isNotNull() & member.isNotNull(), F.variant_get(element, "$[0]", "variant"))


ASSIGN = {
    "TEXT": KINDS["text"],
    "SERIAL": Kind(_whole("bigint"), _whole_message),
    "INTEGER": Kind(_whole("int"), _whole_message),
    "NUMERIC": Kind(_numeric, _numeric_message),
    "BOOLEAN": Kind(_boolean, _syntax("boolean"), F.lower),
    "DATE": Kind(lambda text, number: date_or_null(text, number).cast("date"), _syntax("date"), number_or_null),
    "TIMESTAMP": Kind(date_or_null, _syntax("timestamp"), number_or_null),
    "JSONB": Kind(json_or_null, lambda _: F.lit("invalid input syntax for type json"), _as_element),
}


def kind_for(type_name: str) -> Kind:
    """How a column type takes text: a type a new table may have, or any Spark scalar type."""
    if type_name in ASSIGN:
        return ASSIGN[type_name]
    base = type_name.split("(")[0]
    if base in ("tinyint", "smallint", "int", "bigint"):
        return Kind(_whole(type_name), _whole_message)
    if base in ("float", "double", "decimal"):
        return Kind(lambda text, _: F.when(text.rlike(NUMBER_SHAPE), text.try_cast(type_name)), _numeric_message)
    if base in ("timestamp", "timestamp_ntz", "date"):
        return Kind(lambda text, number: date_or_null(text, number).cast(type_name), _syntax(base), number_or_null)
    if base in ("boolean", "variant"):
        return ASSIGN["BOOLEAN" if base == "boolean" else "JSONB"]
    if base in ("string", "char", "varchar"):
        return ASSIGN["TEXT"]
    raise ValueError(f"Cannot load text into a column of type {type_name}")


def spark_type(type_name: str) -> str:
    return "bigint" if type_name == "SERIAL" else SPARK_TYPES.get(type_name, type_name)
