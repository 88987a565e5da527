"""Business keys, row hashes and the JSON text the hashes are taken over."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cells import blank_to_null, iso_text

NEEDS_ESCAPE = r'[\x00-\x1f"\\]'
_COMPLEX = (T.ArrayType, T.MapType, T.StructType)


def number_text(c: Column) -> Column:
    """A double in its shortest decimal form: ``100``, ``0.5``, ``1e+21``.

    Whole values print without a fraction, and exponents are used only from
    1e21 up and below 1e-6.
    """
    c = c.cast("double")
    size = F.abs(c)
    plain = F.regexp_replace(
        F.regexp_replace(c.cast("string").try_cast("decimal(38,22)").cast("string"), "0+$", ""),
        r"\.$", "")
    java = F.lower(c.cast("string"))
    scientific = F.regexp_replace(F.regexp_replace(java, r"\.0e", "e"), r"e([0-9])", "e+$1")
    return (
        F.when(F.isnan(c) | (size == float("inf")), F.lit(None).cast("string"))
        .when((c == F.floor(c).cast("double")) & (size < 1e15), c.cast("bigint").cast("string"))
        .when((size >= 1e-3) & (size < 1e7), c.cast("string"))
        .when((size >= 1e-6) & (size < 1e15), plain)
        .when((size >= 1e15) & (size < 1e21), c.cast("decimal(38,0)").cast("string"))
        .otherwise(scientific)
    )


def text_of(c: Column, dtype: T.DataType) -> Column:
    """The text a value has when it is put into a key or a text cell."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return number_text(c)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return iso_text(c)
    if isinstance(dtype, (*_COMPLEX, T.VariantType)):
        return F.to_json(c)
    return c.cast("string")


def json_value(c: Column, dtype: T.DataType) -> Column:
    """One value as JSON text, ``null`` included."""
    if isinstance(dtype, T.StringType):
        # Building JSON costs far more than the check whether the text needs it.
        wrapped = F.to_json(F.array(c))
        escaped = F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)
        text = F.when(c.rlike(NEEDS_ESCAPE), escaped).otherwise(F.concat(F.lit('"'), c, F.lit('"')))
    elif isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        text = F.concat(F.lit('"'), iso_text(c), F.lit('"'))
    else:
        text = text_of(c, dtype)
    return F.when(c.isNull(), F.lit("null")).otherwise(F.coalesce(text, F.lit("null")))


def row_json(df: DataFrame, columns=None) -> Column:
    """The row as one JSON object with its names in sorted order."""
    names = sorted(columns or df.columns)
    members = [
        F.concat(F.lit(json.dumps(n, ensure_ascii=False) + ":"),
                 json_value(df[n], df.schema[n].dataType))
        for n in names
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def row_hash(df: DataFrame, columns=None) -> Column:
    """SHA-256 over :func:`row_json`; no shuffle, one pass."""
    return F.sha2(row_json(df, columns), 256)


def business_key(df: DataFrame, columns) -> Column:
    """Trimmed key parts joined by ``|``; null as soon as one part is blank."""
    kinds = [df.schema[n].dataType for n in columns]
    # Only text can be blank or have space around it; the Unicode trim is dear.
    parts = [blank_to_null(df[n]) if isinstance(k, T.StringType) else text_of(df[n], k) for n, k in zip(columns, kinds)]
    return F.concat(*[p if i == 0 else F.concat(F.lit("|"), p) for i, p in enumerate(parts)])
