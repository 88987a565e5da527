"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled and its words cut into equal blocks, at most
two epochs of them. The schedule is a van der Corput sequence: the points of a
grid of 2^k cells, in bit-reversed order, are mapped through the sources'
cumulative block counts, so every source comes up evenly all along the schedule
and exactly as often as it has blocks to give. The n-th slot of a source takes
its n-th block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetlake.llm.common import keyed, place_of, running_before, text_of, unkeyed, words_count
from sheetlake.session import checkpointed

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # the mix takes three halves of all words
EPOCHS = 2
BLOCK_WORDS = 1024
BUCKET_BITS = 12  # buckets of the running sums; a window holds at most this many per source
CHUNK = 4096


@dataclass
class Mix:
    """``documents``: one row per document; ``sources``: the targets; ``schedule``: one row per slot;
    ``pieces``: the words ``[first_word, last_word)`` of a document's epoch that a slot takes."""

    documents: DataFrame
    sources: DataFrame
    schedule: DataFrame
    pieces: DataFrame


def source_targets(sizes: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Targets from ``__source, source_size``: the weighted share of the mix, capped at two epochs.

    Sources in code point order, null last, have the weights 3, 1, 2 in turn. A
    source reaches its cap when its cap per weight is at most the common level;
    taken in that order the capped ones come first, so one running sum finds the
    level that repeated resharing ends at. All in whole numbers (twice the words),
    with one division at the end. One row per source, sorted in one task: a
    million sources are some 50 MB.
    """
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]),
                          (F.col("__rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = (sizes.withColumn("__rank", F.row_number().over(by_name) - 1).withColumn("__weight", weight)
              .withColumn("__cap2", F.col("source_size") * (EPOCHS * 2)))
    fill = Window.orderBy(F.expr("__cap2 * 6 div __weight"), "__rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    pool2 = F.sum("source_size").over(whole) * (SHARE[0] * 2 // SHARE[1])
    level = (ranked.withColumn("__pool2", pool2)
             .withColumn("__left2", F.col("__pool2") - F.coalesce(F.sum("__cap2").over(before), F.lit(0)))
             .withColumn("__rest", F.sum("__weight").over(onward))
             .withColumn("__full", F.col("__cap2") * F.col("__rest") <= F.col("__weight") * F.col("__left2")))
    open_weight = F.sum(F.when(F.col("__full"), 0).otherwise(F.col("__weight"))).over(whole)
    open_pool = F.col("__pool2") - F.sum(F.when(F.col("__full"), F.col("__cap2")).otherwise(0)).over(whole)
    shared = (level.withColumn("__open_weight", open_weight).withColumn("__open_pool", open_pool)
              .withColumn("target", F.when(F.col("__full"), F.col("__cap2").cast("double") / 2).otherwise(
                  (F.col("__weight") * F.col("__open_pool")).cast("double") / (F.col("__open_weight") * 2)))
              .withColumn("__quota", F.when(F.col("__full"), F.expr("__cap2 div 2")).otherwise(
                  F.expr("(__weight * __open_pool + __open_weight) div (2 * __open_weight)"))))
    blocks = F.expr(f"(__quota + {block_words - 1}) div {block_words}")
    ahead = Window.orderBy("__rank").rowsBetween(Window.unboundedPreceding, -1)
    return (shared.withColumn("__blocks", blocks)
            .withColumn("__first", F.coalesce(F.sum("__blocks").over(ahead), F.lit(0)))
            .withColumn("__all", F.sum("__blocks").over(whole))
            .select("__source", "source_size", "__rank", "target", "__quota", "__blocks", "__first", "__all"))


def bit_reversed(value: Column, bits: Column) -> Column:
    """The lowest ``bits`` bits of ``value`` (1 to 62), reversed."""
    swaps = ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F),
             (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF))
    for shift, mask in swaps:
        keep = F.lit(mask).cast("long")
        value = F.shiftrightunsigned(value, shift).bitwiseAND(keep).bitwiseOR(
            F.shiftleft(value.bitwiseAND(keep), shift))
    value = F.shiftrightunsigned(value, 32).bitwiseOR(F.shiftleft(value, 32))
    return F.call_function("shiftrightunsigned", value, F.lit(64) - bits)


def slot_schedule(sources: DataFrame) -> DataFrame:
    """One row per slot: ``slot`` (its place in the sequence), ``__rank`` (the source), ``block``.

    The cells that a source's stretch of the cumulative counts covers are listed
    in chunks, so a source with most of the blocks is spread over tasks.
    """
    chunks = (sources.where("__blocks > 0")
              .withColumn("__bits", F.greatest(F.length(F.bin(F.col("__all") - 1)), F.lit(1)).cast("int"))
              .withColumn("__chunk", F.explode(F.expr(f"sequence(0L, (__blocks - 1) div {CHUNK})"))))
    cells = (chunks.repartition(F.col("__rank"), F.col("__chunk"))
             .withColumn("__cell", F.explode(F.expr(
                 f"sequence(__first + __chunk * {CHUNK}, __first + least(__blocks, (__chunk + 1) * {CHUNK}) - 1)"))))
    slots = (cells.withColumn("slot", bit_reversed(F.col("__cell"), F.col("__bits")))
             .withColumn("__bucket", F.expr(f"shiftrightunsigned(slot, greatest(__bits - {BUCKET_BITS}, 0))"))
             .select("slot", "__rank", "__bucket"))
    return running_before(slots, ["__rank"], "__bucket", [F.col("slot")], F.lit(1).cast("long"),
                          "block").select("slot", "__rank", "block")


def mix_sources(docs: DataFrame, row: str | None = None, block_words: int = BLOCK_WORDS,
                seed: str = "mix", id_column: str = "doc_id", text_column: str = "text",
                source_column: str = "source") -> Mix:
    """The mix of ``docs``.

    Null texts have no words and are never taken; an empty table, or one without
    words, gives an empty schedule. A null source is a source of its own. The
    shuffle orders a source's documents by a hash of ``seed`` and the id, then by
    size, so reruns agree; rows equal in id, source and size may stand for each
    other. Other columns of ``docs`` are not read.
    """
    key = F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))))
    sized = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("__row"), F.col(id_column).alias("__id"),
        F.col(source_column).cast("string").alias("__source"), words_count(text_of(text_column)).alias("size"),
        key.alias("__key"))
    sized = checkpointed(sized)
    sources = checkpointed(source_targets(
        sized.groupBy("__source").agg(F.sum("size").alias("source_size")), block_words))
    facts = sources.withColumnRenamed("__source", "__s").select(
        "__s", "source_size", "target", "__rank", "__quota")
    documents = (sized.join(facts, F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
                 .withColumn("__bucket", F.expr(f"conv(substr(__key, 1, {BUCKET_BITS // 4}), 16, 10)").cast("int")))
    placed = running_before(documents, ["__rank"], "__bucket", [F.col("__key"), F.col("size"), F.col("__row")],
                            F.col("size"), "__start")
    epochs = (placed.where("size > 0")
              .withColumn("epoch", F.explode(F.expr(f"sequence(0L, {EPOCHS - 1}L)")))
              .withColumn("__begin", F.col("epoch") * F.col("source_size") + F.col("__start"))
              .withColumn("__end", F.least(F.col("__begin") + F.col("size"), F.col("__quota")))
              .where("__begin < __end")
              .withColumn("block", F.explode(F.expr(
                  f"sequence(__begin div {block_words}, (__end - 1) div {block_words})"))))
    schedule = slot_schedule(sources)
    pieces = (epochs.join(schedule.hint("merge"), ["__rank", "block"], "inner")
              .select("slot", "__row", "epoch", "block",
                      (F.greatest(F.col("__begin"), F.col("block") * block_words) - F.col("__begin")).alias("first_word"),
                      (F.least(F.col("__end"), (F.col("block") + 1) * block_words) - F.col("__begin")).alias("last_word")))
    return Mix(documents, sources, schedule, pieces)


def mixed_words(mix: Mix) -> DataFrame:
    """One row per document: how many of its words the mix takes, repeats counted."""
    taken = mix.pieces.groupBy("__row").agg(F.sum(F.col("last_word") - F.col("first_word")).alias("__taken"))
    return (mix.documents.join(taken, "__row", "left")
            .select(F.col("__id").alias("doc_id"), "size", "source_size", "target",
                    F.coalesce(F.col("__taken"), F.lit(0).cast("long")).alias("taken")))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as rows of ``docs``: a document once per epoch that takes words of it.

    A document whose words are all taken comes whole. Where a source's quota ends
    inside a document (at most one of each source), the text ends after the last
    word taken. All columns stay.
    """
    rows, text = keyed(docs), place_of(docs, "text")
    mix = mix_sources(rows, "__row", block_words, id_column=place_of(docs, "doc_id"), text_column=text,
                      source_column=place_of(docs, "source"))
    taken = mix.pieces.groupBy("__row", "epoch").agg(F.max("last_word").alias("__words"))
    sized = mix.documents.select("__row", F.col("size").alias("__size"))
    lead = F.array_join(F.slice(F.regexp_extract_all(
        text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0), F.lit(1), F.col("__words").cast("int")), "")
    cut = F.when(F.col("__words") < F.col("__size"), lead).otherwise(F.col(text))
    return unkeyed(rows.join(taken.join(sized, "__row"), "__row").withColumn(text, cut), docs)
