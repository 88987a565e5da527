"""Rename and type mapped columns of raw rows in one select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import Kind, kind_of, outcome, strip


def error_map(errors: dict[str, Column]) -> Column:
    """Map of field name to error text, holding only the fields that failed."""
    if not errors:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    names = F.array(*[F.lit(n) for n in errors])
    return F.map_filter(F.map_from_arrays(names, F.array(*errors.values())),
                        lambda _, message: message.isNotNull())


def text_of(name: str) -> Column:
    return F.col(f"`text:{name}`")


def value_of(name: str) -> Column:
    return F.col(f"`value:{name}`")


def texts(df: DataFrame, sources: dict[str, Column], keep) -> DataFrame:
    """Trimmed, blank-free text of each source column, as ``text:<name>``.

    Typing is done in steps, one select each: text, prepared text, value,
    error. What a later step uses is then computed once per row and stays in
    generated code; nested in one expression it would be repeated at every use.
    """
    trimmed = df.select(*keep, *[strip(c).alias(f"text:{n}") for n, c in sources.items()])
    return trimmed.select(*keep, *[F.nullif(text_of(n), F.lit("")).alias(f"text:{n}") for n in sources])


def convert(df: DataFrame, kinds: dict[str, Kind], keep) -> DataFrame:
    """``value:<name>`` next to the text of every column."""
    found = [text_of(n) for n in kinds]
    prepared = df.select(*keep, *found, *[k.prepare(text_of(n)).alias(f"prepared:{n}") for n, k in kinds.items()])
    return prepared.select(*keep, *found, *[
        k.convert(text_of(n), F.col(f"`prepared:{n}`")).alias(f"value:{n}") for n, k in kinds.items()])


def computed_once(df: DataFrame, keep, columns: dict[str, Column]) -> DataFrame:
    """``keep`` plus ``columns``, with filters on ``columns`` held above their computation.

    The optimizer moves a filter below a select by copying the whole computation
    into the filter, so bad-row filters would type every row twice. It does not
    move one below a generator; the one-row ``inline`` stays in generated code.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def normalize_rows(raw: DataFrame, mapping: dict, keep=("row_number",)) -> DataFrame:
    """Typed fields of ``mapping`` plus an ``errors`` map; unmapped columns are dropped.

    ``mapping`` is ``{source: "field"}`` or ``{source: {"field": ..., "type": ...}}``.
    """
    sources: dict[str, Column] = {}
    kinds: dict[str, Kind] = {}
    for source, target in mapping.items():
        spec = {"field": target} if isinstance(target, str) else (target or {})
        field = spec.get("field") or source
        sources[field] = raw[source] if source in raw.columns else F.lit(None).cast("string")
        kinds[field] = kind_of(spec.get("type"))
    typed = convert(texts(raw, sources, keep), kinds, keep)
    errors = {n: outcome(text_of(n), value_of(n), k.message(text_of(n))) for n, k in kinds.items()}
    return computed_once(typed, keep, {**{n: value_of(n) for n in kinds}, "errors": error_map(errors)})


def valid_rows(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.size("errors") == 0).drop("errors")


def row_errors(checked: DataFrame, keep=("row_number",)) -> DataFrame:
    """One row per failed field: the kept columns, ``field`` and ``error``."""
    return checked.where(F.size("errors") > 0).select(
        *keep, F.explode("errors").alias("field", "error"))
