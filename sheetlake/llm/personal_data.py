"""Personal data by bootstrapped contextual extraction.

Patterns for e-mail addresses, IP addresses, card and phone numbers give the seeds.
What stands before a seed (its last two words) is a lexical pattern of its kind.
Patterns and the identifiers found after them form a graph, which is scored in
rounds: a pattern is trusted by the share of its identifiers that are known for the
kind, an identifier by all trusted patterns it follows (noisy or), and identifiers
above the threshold become known for the next round. In the end, identifiers that
follow a trusted pattern are spans of its kind, next to the seeds, which all stay.

Only column expressions are used. A match's place is found by splitting the text at
the matches: the pieces and matches before it add up to its start, in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetlake.llm.common import text_of
from sheetlake.session import checkpointed, drop_scratch

KINDS = ("email", "ip", "card", "phone")
CANDIDATE = len(KINDS)
LEAST_SUPPORT = 3  # known identifiers that a pattern needs
LEAST_TRUST = 0.7  # for patterns and identifiers
LEAST_LENGTH = 5
# The last two words of a reversed text, whatever their length, with the space behind them.
_LAST_WORDS = r"^\s*+\S*+(?:\s++\S++)?"

# The same matches as the plain patterns of the README, in linear time: runs are taken whole (++)
# and tried only where they begin or where the last match ended.
_LOCAL = r"[A-Za-z0-9._%+-]"
_PATTERNS = (
    rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+",
)
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _luhn(digits: Column) -> Column:
    def step(total: Column, place: Column) -> Column:
        digit = F.substring(digits, -place, F.lit(1)).cast("int")
        doubled = digit * 2
        return total + F.when(place % 2 == 1, digit).when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    bare = F.regexp_replace(value, "[^0-9]", "")
    size = F.length(bare)
    return (F.when(kind == 1, value.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"))
            .when(kind == 2, F.when(size.between(14, 19), _luhn(bare)).otherwise(False))
            .when(kind == 3, size.between(10, 15)).otherwise(True))


def raw_matches(docs: DataFrame, row: str | None = None, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """One stored record per row: number, id and all matches with the code points before each and its context."""
    text = text_of(text_column)
    rows = docs.select(F.col(row).alias("__row") if row else F.monotonically_increasing_id().alias("__row"),
                       F.col(id_column).alias("__id"), text.alias("__text"))
    digits = F.col("__text").rlike("[0-9]")
    asked = [F.col("__text").contains("@"), digits, digits, F.col("__text").contains("+"),
             digits | F.col("__text").contains("@")]
    found = rows.select("*", *[F.when(cond, F.regexp_extract_all("__text", F.lit(p), 0)).alias(f"__m{k}")
                               for k, (cond, p) in enumerate(zip(asked, _PATTERNS))])
    hits = []
    for kind, pattern in enumerate(_PATTERNS):
        # Pieces outnumber matches by one; the last has no match and goes.
        pieces = F.split("__text", pattern, -1)
        zipped = F.zip_with(pieces, f"__m{kind}", lambda piece, match: F.struct(
            F.lit(kind).alias("kind"), match.alias("value"), F.length(piece).alias("gap"),
            F.reverse(F.regexp_extract(F.reverse(piece), _LAST_WORDS, 0)).alias("before")))
        numbered = F.transform(F.filter(zipped, lambda x: x["value"].isNotNull()),
                               lambda x, n: x.withField("nth", n))
        hits.append(F.when(F.size(f"__m{kind}") > 0, numbered))
    empty = F.array().cast("array<struct<kind:int,value:string,gap:int,before:string,nth:int>>")
    return checkpointed(found.select("__row", "__id", F.concat(*[F.coalesce(h, empty) for h in hits]).alias("__hits")))


def placed_matches(matches: DataFrame) -> DataFrame:
    """``__row, kind, start, end, value, context`` of every match, with invalid ones dropped.

    For candidates, ``value`` is the token without outer punctuation.
    """
    rows = matches.where("size(__hits) > 0").select("__row", F.explode("__hits").alias("h")).select("__row", "h.*")
    order = Window.partitionBy("__row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(order))
    core = F.regexp_extract("value", r"^[^A-Za-z0-9+(]*+(.*?)[^A-Za-z0-9)]*$", 1)
    lead = F.length(F.regexp_extract("value", r"^[^A-Za-z0-9+(]*+", 0))
    free = F.col("kind") == CANDIDATE
    spans = (ends.withColumn("start", F.col("end") - F.length("value"))
             .withColumn("start", F.when(free, F.col("start") + lead).otherwise(F.col("start")))
             .withColumn("value", F.when(free, core).otherwise(F.col("value")))
             .withColumn("end", F.col("start") + F.length("value")))
    words = F.regexp_extract("before", r"(\S+\s+)?\S+\s*$", 0)
    context = F.regexp_replace(F.regexp_replace(F.lower(F.trim(words)), "[0-9]", "0"), r"\s+", " ")
    kept = spans.where(_valid(F.col("kind"), F.col("value")) & (~free | (F.length("value") >= LEAST_LENGTH)))
    return kept.select("__row", "kind", "start", "end", "value", context.alias("context"))


def _free_candidates(spans: DataFrame) -> DataFrame:
    """Candidates that no seed of their row overlaps, by running the seeds' ends and starts along the row."""
    seed = F.col("kind") < CANDIDATE
    along = Window.partitionBy("__row").orderBy("start", "kind", "end")
    ahead = along.rowsBetween(Window.unboundedPreceding, -1)
    after = along.rowsBetween(1, Window.unboundedFollowing)
    return (spans.withColumn("__last", F.max(F.when(seed, F.col("end"))).over(ahead))
            .withColumn("__next", F.min(F.when(seed, F.col("start"))).over(after))
            .where(~seed & (F.coalesce(F.col("__last"), F.lit(0)) <= F.col("start"))
                   & (F.col("__next").isNull() | (F.col("__next") >= F.col("end")))).drop("__last", "__next"))


@dataclass
class Extraction:
    """``matches``: one record per row; ``seeds`` and ``discovered``: spans; ``patterns``: trusted contexts by kind."""

    matches: DataFrame
    seeds: DataFrame
    patterns: DataFrame
    discovered: DataFrame


def trusted_patterns(edges: DataFrame, known: DataFrame) -> DataFrame:
    """``context, kind, trust`` of contexts whose identifiers are mostly known for the kind."""
    sizes = edges.groupBy("context").agg(F.count("*").alias("all"))
    backed = (edges.join(known, "value").groupBy("context", "kind").agg(F.count("*").alias("hits"))
              .where(F.col("hits") >= LEAST_SUPPORT))
    return (backed.join(sizes, "context").withColumn("trust", F.col("hits") / F.col("all"))
            .where(F.col("trust") >= LEAST_TRUST).select("context", "kind", "trust"))


def extract(docs: DataFrame, row: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> Extraction:
    """Seeds, trusted patterns and discovered spans of all texts.

    Rounds go on until one finds nothing new, which comes, as what is known only grows.
    Null texts count as empty. Every row is on its own, also with a null or repeated
    id. An empty table gives empty results. Other columns are not read.
    """
    matches = raw_matches(docs, row, id_column, text_column)
    spans = checkpointed(placed_matches(matches))
    seeds = spans.where(F.col("kind") < CANDIDATE)
    free = checkpointed(_free_candidates(spans))
    edges = checkpointed(seeds.select("context", "value").union(free.select("context", "value"))
                         .where("context <> ''").distinct())
    known = checkpointed(seeds.select("value", "kind").distinct())
    grown = True
    while grown:
        patterns = trusted_patterns(edges, known)
        doubt = F.exp(F.sum(F.log(1 - F.col("trust") * F.lit(0.999))))
        scored = (edges.join(patterns, "context").groupBy("value", "kind").agg((1 - doubt).alias("score"))
                  .where(F.col("score") >= LEAST_TRUST).select("value", "kind"))
        following = checkpointed(known.union(scored).distinct())
        grown = following.count() > known.count()
        drop_scratch(known)
        known = following
    patterns = checkpointed(trusted_patterns(edges, known))
    best = Window.partitionBy("__row", "start").orderBy(F.desc("trust"), "kind")
    discovered = (free.drop("kind").join(patterns, "context").withColumn("__n", F.row_number().over(best))
                  .where("__n = 1").select("__row", "kind", "start", "end"))
    return Extraction(matches, seeds.select("__row", "kind", "start", "end"), patterns, discovered)


def personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts of the seeds by kind, their digest, and all spans.

    Spans are ``kind:start:end`` by start, then kind in the order of ``KINDS``,
    joined by commas; a row without spans has the empty text and its digest. For null
    texts, ids and empty tables see :func:`extract`.
    """
    found = extract(docs, None, id_column, text_column)
    both = (found.seeds.withColumn("base", F.lit(True))
            .union(found.discovered.select("__row", "kind", "start", "end", F.lit(False))))
    grouped = both.groupBy("__row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "base"))).alias("spans"),
        *[F.count(F.when(F.col("base") & (F.col("kind") == n), 1)).alias(f"n_{k}") for n, k in enumerate(KINDS)])
    names = F.array(*map(F.lit, KINDS))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

    empty = F.lit("")
    return (found.matches.select("__row", "__id").join(grouped, "__row", "left").select(
        F.col("__id").alias("doc_id"), *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce(joined(F.filter("spans", lambda s: s["base"])), empty), 256).alias("base_sha256"),
        F.coalesce(joined(F.col("spans")), empty).alias("spans")))
