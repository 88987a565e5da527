"""Typed loads: coercion, row errors, batches, ids, all-or-nothing publishing."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.assign import kind_for, spark_type
from ..functions.cells import outcome
from ..functions.keys import number_text
from ..session import checkpointed, drop_scratch, remove_others, remove_path
from ..sources.tables import qualified, quote_name
from .catalog import RUN_COLUMN, TargetTable, describe, reserve_ids, sketch_path, table_place, target_table
from .mapping import computed_once, convert, error_map, text_of, texts, value_of
from .runs import check_run_id, record_run

BATCH_ROWS = 1000  # fixed value: rows per import batch
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row position in its low 33 bits


def coerce_rows(raw: DataFrame, target: TargetTable, keep=("row_number",), cells: str | None = None,
                into: str | None = None) -> DataFrame:
    """Typed target columns and an ``errors`` map for every raw row, without a shuffle.

    A raw column is text, or a cell ``(kind, text)``. Columns may sit inside the
    struct column ``cells``. A column the source does not name takes its default;
    a named but blank cell stays null, and is an error where a value is required.
    ``into`` names a struct column for the typed values, where names of the
    table could clash with the kept ones.
    """
    fields = raw.schema[cells].dataType if cells else raw.schema
    columns = [c for c in target.columns if c.data_type != "SERIAL" or c.name in fields.fieldNames()]
    named = [c.name for c in columns if c.name in fields.fieldNames()]
    place = {n: raw[cells][n] if cells else F.col(quote_name(n)) for n in named}
    in_cells = [n for n in named if isinstance(fields[n].dataType, T.StructType)]

    flags = [f"absent:{n}" for n in in_cells]
    keep_flags = [*keep, *[quote_name(f) for f in flags]]
    placed = raw.select(*keep, *[place[n].isNull().alias(f) for n, f in zip(in_cells, flags)],
                        *[place[n].alias(f"cell:{n}") for n in named])
    sources = {n: F.col(f"`cell:{n}`") for n in named}
    kinds = {c.name: kind_for(c.data_type) for c in columns if c.name in place}
    typed = convert(texts(_cell_texts(placed, in_cells), sources, keep_flags), kinds, keep_flags)

    values: dict[str, Column] = {}
    errors: dict[str, Column] = {}
    for c in columns:
        serial = c.data_type == "SERIAL"
        default = (F.lit(None) if serial or c.default is None else F.expr(c.default)).cast(spark_type(c.data_type))
        missing = F.col(f"`absent:{c.name}`") if c.name in in_cells else F.lit(c.name not in place)
        value, error = default, F.lit(None).cast("string")
        if c.name in place:
            value = F.when(missing, default).otherwise(value_of(c.name)) if c.name in in_cells else value_of(c.name)
            error = outcome(text_of(c.name), value_of(c.name), kinds[c.name].message(text_of(c.name)))
        if c.required:
            message = (f'null value in column "{c.name}" of relation "{target.name}" '
                       "violates not-null constraint")
            unset = value.isNull() & ~missing if serial else value.isNull()
            error = F.coalesce(error, F.when(unset, F.lit(message)))
        values[c.name], errors[c.name] = value, error
    if into:
        values = {into: F.struct(*[v.alias(n) for n, v in values.items()])}
    return computed_once(typed, keep, {**values, "errors": error_map(errors)})


# Number text that is its own shortest form: up to 15 digits, no exponent, no closing zero.
_SHORTEST = r"^(0|-?[1-9][0-9]{0,14}|-?(?!0\.000000)(?=.{3,16}$)(0|[1-9][0-9]*)\.[0-9]*[1-9])$"


def _cell_texts(df: DataFrame, names: list[str]) -> DataFrame:
    """Cells as text; numeric cells take their shortest form (``100.0`` is ``100``)."""
    if not names:
        return df
    cells = {n: F.col(f"`cell:{n}`") for n in names}
    others = [quote_name(c) for c in df.columns if c not in {f"cell:{n}" for n in names}]
    numbers = df.select(*others, *cells.values(), *[
        F.when((c["kind"] == "n") & ~c["text"].rlike(_SHORTEST), c["text"].try_cast("double")).alias(f"number:{n}")
        for n, c in cells.items()])
    number = {n: F.col(f"`number:{n}`") for n in names}
    return numbers.select(*others, *[
        F.when(number[n].isNotNull(), number_text(number[n])).otherwise(c["text"]).alias(f"cell:{n}")
        for n, c in cells.items()])


def table_rows(spark: SparkSession, target: TargetTable, checked: DataFrame, raw: DataFrame, into: str = "row",
               total: int | None = None) -> DataFrame:
    """The columns of the table out of ``checked``, ids included.

    A row keeps the id its sheet gives, else it takes the next of the sequence.
    ``raw`` is the written source that ``checked`` was computed from, and ``total`` its
    number of rows, where that is known.
    """
    given = checked.schema[into].dataType.fieldNames()
    if any(c.data_type == "SERIAL" for c in target.columns):
        serial = [c.name for c in target.columns if c.data_type == "SERIAL" and c.name in given]
        # The sequence goes on past the highest id that a sheet gives, so the two never meet.
        highest = checked.agg(F.max(F.col(into)[serial[0]])).first()[0] if serial else None
        base = reserve_ids(spark, target.name, raw.count() if total is None else total, highest or 0)
        checked = dense_ids(checked, base, column="next_id", source=raw)

    def column(c):
        found = F.col(into)[c.name] if c.name in given else F.lit(None).cast("bigint")
        return (F.coalesce(found, "next_id") if c.data_type == "SERIAL" else found).alias(c.name)

    return checked.select(*[column(c) for c in target.columns])


def import_summary(checked: DataFrame, by=()) -> DataFrame:
    """Total, good and bad rows, and whether the load may be published."""
    bad = F.count_if(F.size("errors") > 0)
    return checked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_rows"),
        (F.count(F.lit(1)) - bad).alias("ok_rows"),
        bad.alias("error_rows"),
        F.when(bad == 0, "success").otherwise("rejected").alias("outcome"),
    )


def first_bad_batch(checked: DataFrame, ordinal: Column, by=(), batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Rows with errors in the first batch (per ``by``) that has any.

    The failing rows are written once, so that finding the batch and fetching its
    rows do not type the whole source twice. The minimum is one row per group,
    combined before the shuffle.
    """
    failing = checkpointed(checked.where(F.size("errors") > 0).withColumn(
        "batch", F.floor((ordinal - 1) / batch_rows).cast("bigint")))
    first = failing.groupBy(*by).agg(F.min("batch").alias("batch"))
    return failing.join(first, [*by, "batch"], "left_semi")


def with_sequence(rows: DataFrame, column: str = "seq") -> DataFrame:
    """Tag rows with partition and position. Write or checkpoint before using it."""
    return rows.withColumn(column, F.monotonically_increasing_id())


def dense_ids(rows: DataFrame, base: int = 0, seq: str = "seq", column: str = "id",
              source: DataFrame | None = None) -> DataFrame:
    """Gap-free ids ``base + 1 ...`` in sequence order, without shuffling the rows.

    ``rows`` must be written or checkpointed with its sequence column; rows left
    out since then leave a gap. ``source`` is the written table when ``rows`` was
    computed from it, so that counting reads its sequence column and nothing else.
    The only thing broadcast is one offset per partition, and the partitions are
    the tasks of one job.
    """
    part = F.shiftright(F.col(seq), _LOCAL_BITS)
    local = F.col(seq).bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    ordered = Window.orderBy("part")
    offsets = (
        (source or rows).groupBy(part.alias("part")).agg((F.max(local) + 1).alias("n"))
        .select("part", (F.sum("n").over(ordered) - F.col("n")).alias("before"))
    )
    return (
        rows.withColumn("part", part).join(F.broadcast(offsets), "part")
        .withColumn(column, F.lit(base) + F.col("before") + local + 1)
        .drop("part", "before", seq)
    )


def assign_ids(rows: DataFrame, order_by, base: int = 0, column: str = "id") -> DataFrame:
    """Gap-free ids in the order of ``order_by`` (a unique key).

    Range partitioning on a unique key stays balanced whatever the data, and the
    checkpoint pins the partitions, so recomputed tasks give the same ids.
    """
    ordered = rows.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    return dense_ids(checkpointed(with_sequence(ordered)), base, column=column)


class LoadResult(NamedTuple):
    published: bool
    total_rows: int
    error_rows: int


DUPLICATE = 'duplicate key value violates unique constraint "{}_pkey"'  # fixed value: the message of a primary key


def with_key_errors(spark: SparkSession, target: TargetTable, checked: DataFrame, run_id: str, into: str = "row") -> DataFrame:
    """``checked`` with an error for ids that its sheet repeats, or that other runs of the table hold.

    ``checked`` must be written. The first row of an id, by ``seq``, keeps it. Ids are
    counted by an aggregate and looked up in the table by a semi join; only the part of
    the table between the least and the greatest of them is read.
    """
    serial = [c.name for c in target.columns if c.data_type == "SERIAL" and c.name in checked.schema[into].dataType.fieldNames()]
    if not serial:
        return checked
    name = serial[0]
    given = checked.select("seq", F.col(into)[name].alias("given")).where("given IS NOT NULL")
    first = checkpointed(given.groupBy("given").agg(F.min("seq").alias("first")))
    low, high = first.agg(F.min("given"), F.max("given")).first()
    if low is None:  # no sheet gives an id
        drop_scratch(first)
        return checked
    held = spark.table(qualified(target.name)).where(F.col(name).between(low, high))
    if target.by_run:
        held = held.where(F.col(RUN_COLUMN) != run_id)
    # A merge: broadcast, all ids of the table would pass through the driver again for every run.
    used = (first.join(held.select(F.col(name).alias("given")).hint("merge"), "given", "left_semi")
            .withColumn("used", F.lit(True)))
    known = checkpointed(first.join(used.select("given", "used"), "given", "left"))
    bad = (given.withColumnRenamed("given", "__given").join(known, F.col("__given") == F.col("given"))
           .where(F.col("used") | (F.col("seq") > F.col("first"))).select(F.col("seq").alias("__seq")))
    message = F.map_from_arrays(F.array(F.lit(name)), F.array(F.lit(DUPLICATE.format(target.name))))
    flagged = checked.join(checkpointed(bad), F.col("seq") == F.col("__seq"), "left")
    errors = F.when(F.col("__seq").isNotNull() & ~F.map_contains_key("errors", name), F.map_concat("errors", message))
    return flagged.withColumn("errors", F.coalesce(errors, F.col("errors"))).drop("__seq")


def publish_rows(spark: SparkSession, table: str, rows: DataFrame, run_id: str) -> None:
    """Make ``rows`` the partition ``run_id`` of ``table``.

    They are written to a folder of their own; when the last file is committed, the
    catalog is pointed at it, and only then does what an earlier attempt wrote go. So
    readers see all of an attempt or none of it, and one that fails changes nothing.
    A table made elsewhere, without load runs, takes the rows by plain append.
    """
    check_run_id(run_id)
    target = target_table(spark, table)
    schema = spark.table(qualified(table)).schema
    rows = rows.select(*[F.col(quote_name(c.name)).cast(schema[c.name].dataType).alias(c.name) for c in target.columns])
    if target.indexed:
        # Sorted within each file, without a shuffle: page statistics and the bloom
        # filters then skip most of a file, and a hot value stays spread over files.
        rows = rows.sortWithinPartitions(*[quote_name(n) for n in target.indexed])
    if not target.by_run:
        view = f"publish_{uuid.uuid4().hex}"
        rows.createOrReplaceTempView(view)
        try:
            listed = ", ".join(quote_name(c.name) for c in target.columns)
            spark.sql(f"INSERT INTO {qualified(table)} ({listed}) SELECT {listed} FROM {view}")
        finally:
            spark.catalog.dropTempView(view)
        return
    run = run_folder(spark, table, run_id)
    attempt = f"{run}/{uuid.uuid4().hex}"
    rows.write.options(**bloom_filters(target)).parquet(attempt)
    point_run(spark, table, run_id, attempt)
    _forget_sketches(spark, table, run_id)
    remove_others(spark, run, attempt)


def bloom_filters(target: TargetTable) -> dict[str, str]:
    return {f"parquet.bloom.filter.enabled#{n}": "true" for n in target.indexed}


def point_run(spark: SparkSession, table: str, run_id: str, attempt: str) -> None:
    """Make a folder that is complete the rows of a run: metadata alone."""
    partition = f"PARTITION ({RUN_COLUMN} = '{run_id}')"
    spark.sql(f"ALTER TABLE {qualified(table)} ADD IF NOT EXISTS {partition} LOCATION '{attempt}'")
    spark.sql(f"ALTER TABLE {qualified(table)} {partition} SET LOCATION '{attempt}'")
    spark.catalog.refreshTable(qualified(table))


def drop_run(spark: SparkSession, table: str, run_id: str) -> None:
    """Take a load run out of its table, if it is there."""
    check_run_id(run_id)
    if target_table(spark, table).by_run:
        spark.sql(f"ALTER TABLE {qualified(table)} DROP IF EXISTS PARTITION ({RUN_COLUMN} = '{run_id}')")
        spark.catalog.refreshTable(qualified(table))
        _forget_sketches(spark, table, run_id)
        remove_path(spark, run_folder(spark, table, run_id))


def _forget_sketches(spark: SparkSession, table: str, run_id: str) -> None:
    remove_path(spark, f"{sketch_path(spark, table)}/{RUN_COLUMN}={run_id}")


def run_folder(spark: SparkSession, table: str, run_id: str) -> str:
    return f"{describe(spark, table)['location']}/{RUN_COLUMN}={run_id}"


def load_rows(spark: SparkSession, table: str, raw: DataFrame, run_id: str,
              keep=("row_number",), cells: str | None = None) -> LoadResult:
    """All-or-nothing load of one source: publish only if no row has an error.

    ``raw`` must be repeatable (a table, or written rows) and carry ``seq``. Its rows
    are typed once, and counted as they are written. A run that publishes nothing takes
    what an earlier attempt of the same run published out of the table.
    """
    started, place = datetime.now(timezone.utc), table_place(spark, table)
    record_run(spark, run_id, table, place, started)
    target = target_table(spark, table)
    seen = Observation()
    typed = checkpointed(coerce_rows(raw, target, keep=(*keep, "seq"), cells=cells, into="row").observe(
        seen, F.count(F.lit(1)).alias("total_rows"), F.count_if(F.size("errors") > 0).alias("error_rows")))
    checked = with_key_errors(spark, target, typed, run_id)
    summary = seen.get if checked is typed else import_summary(checked).first()
    total, bad = summary["total_rows"], summary["error_rows"]
    if bad == 0 and total:
        publish_rows(spark, table, table_rows(spark, target, checked, raw, total=total), run_id)
    else:
        drop_run(spark, table, run_id)
    drop_scratch(typed)
    record_run(spark, run_id, table, place, started, "rejected" if bad else "success", total, total - bad, bad, 0 if bad else total)
    return LoadResult(bad == 0, total, bad)
