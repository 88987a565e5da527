"""Toxicity by a string-kernel support vector machine.

The kernel compares two strings by the subsequences of three characters they share,
gaps allowed: an occurrence that spans s characters weighs ``DECAY ** s``, spans past
``SPAN`` count as nothing, and each string is scaled by the weight of its length. So
an insult with characters put in between still shares most of its subsequences.

The examples are the units of labelled sentences: words without outer punctuation,
and runs of single characters taken as one word. Labels belong to whole documents, so
every unit of a clean document is clean; of a toxic one's units, those are toxic that
hold a group of characters found in toxic documents almost only, tested by the
likelihood ratio. The machine is linear in the Nyström features of a few landmark
units. It is fitted twice, the second time with the clean units that the first takes
for the most toxic ones.

A sentence is as toxic as its worst unit and a text as its worst sentence. As the
decision is a weighted sum of kernels with the landmarks, it is one weight per
subsequence, so a unit is scored with a table of all of them, exactly. The last step
sets the score so that 0.7 lies at the best F1 on labelled documents kept from the fit.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetlake.session import checkpointed

DECAY, SPAN = 0.6, 10
LETTERS = 45  # 0 for what only widens gaps, a-z, the unit's start and end, 16 classes of other letters
START, END, OTHERS = 27, 28, 29
LONGEST = 24  # longer units are scored in overlapping windows of this many characters
GRAMS, LEADS = (4, 5), (3, 4, 5, 6, 7)  # lengths of groups of characters, anywhere and at the start of a unit
DOCUMENTS_PER_CLASS = 6000  # bounds of the fit
TOXIC_UNITS, CLEAN_UNITS, HARD_UNITS = 2000, 4000, 2000
LANDMARKS = (160, 160)  # toxic, clean
RATIO, PURITY, SUPPORT = 15.0, 0.95, 0.5
LONG_UNIT = 8
RIDGE = 1e-3
CUT, NEARER_CLEAN = 0.7, 0.4
CACHED = 200_000
TEXTS_AT_ONCE, ROWS_AT_ONCE, COLUMNS_AT_ONCE = 500, 2048, 64

_SPELLED = re.compile(r"(?<!\S)\S(?:\s+\S[^\w\s]?(?!\S)){2,}")
_OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_DECAYS = (DECAY ** np.arange(16)).astype(np.float32)
_CODES = np.zeros(128, np.int32)
_CODES[97:123] = np.arange(1, 27)


def text_units(text: str) -> set[str]:
    """The different units of a text: its words, and runs of single characters joined."""
    text = text.lower()
    words = set(text.split())
    units = {w.strip(_OUTER) for w in words}
    if any(len(w) == 1 for w in words):  # a run begins with one
        units.update("".join(run.group().split()).strip(_OUTER) for run in _SPELLED.finditer(text))
    return units


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))


def _windows(units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(owner, codes)``: matrices of equally long units, or windows of long ones, with who they belong to."""
    lengths = np.fromiter(map(len, units), np.int64, len(units)) + 2
    text = "\x01" + "\x02\x01".join(units) + "\x02"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    codes = np.where(points < 128, _CODES[np.minimum(points, 127)], OTHERS + points % (LETTERS - OTHERS)).astype(np.int32)
    begins = np.cumsum(lengths) - lengths
    codes[begins], codes[begins + lengths - 1] = START, END
    for length in np.unique(lengths[(lengths > 2) & (lengths <= LONGEST)]).tolist():
        owner = np.flatnonzero(lengths == length)
        yield owner, codes[begins[owner][:, None] + np.arange(length)]
    for unit in np.flatnonzero(lengths > LONGEST).tolist():
        starts = np.append(np.arange(0, lengths[unit] - LONGEST, LONGEST // 2), lengths[unit] - LONGEST)
        for some in np.array_split(starts, len(starts) // 4096 + 1):
            yield np.full(len(some), unit), codes[begins[unit] + some[:, None] + np.arange(LONGEST)]


@lru_cache(maxsize=None)
def _places(length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all subsequences of a string of this length, and their spans."""
    places = np.array([p for p in itertools.combinations(range(length), 3) if p[2] - p[0] < SPAN], np.int32)
    return places.T, (places[:, 2] - places[:, 0] + 1).astype(np.int32)


def _subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(number, weight)`` of each subsequence of each row; those that hold a 0 have number and weight 0."""
    (i, j, k), spans = _places(codes.shape[1])
    numbers = (codes[:, i] * LETTERS + codes[:, j]) * LETTERS + codes[:, k]
    numbers[(codes[:, i] == 0) | (codes[:, j] == 0) | (codes[:, k] == 0)] = 0
    return numbers, np.where(numbers == 0, np.float32(0), _DECAYS[spans])


def _lengths(numbers: np.ndarray) -> np.ndarray:
    """The length of each row's vector: equal subsequences are one component, the sum of their weights."""
    spans = _places_by_count(numbers.shape[1])
    ordered = np.sort(numbers << 4 | spans, axis=1)
    found, weights = ordered >> 4, _DECAYS[ordered & 15]
    weights[found == 0] = 0
    fresh = np.ones(found.shape, bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    starts = np.flatnonzero(fresh.ravel())
    sums = np.add.reduceat(weights.ravel(), starts)
    return np.sqrt(np.bincount(starts // found.shape[1], sums * sums, len(found)))


@lru_cache(maxsize=None)
def _places_by_count(count: int) -> np.ndarray:
    return next(spans for spans in (_places(n)[1] for n in range(3, LONGEST + 1)) if len(spans) == count)


def _vector(unit: str) -> tuple[np.ndarray, np.ndarray]:
    """The subsequences of a unit (of a long one its first window) and their weights, of length one in all."""
    for _, codes in itertools.islice(_windows([unit]), 1):
        numbers, weights = _subsequences(codes[:1])
        found, at = np.unique(numbers[0], return_inverse=True)
        sums = np.bincount(at, weights[0])[found > 0]
        if len(sums):
            return found[found > 0], (sums / np.sqrt((sums * sums).sum())).astype(np.float32)
    return np.zeros(0, np.int64), np.zeros(0, np.float32)


def unit_decisions(units: list[str], weights: np.ndarray, bias: float = 0.0) -> np.ndarray:
    """The decision value of each unit, of a long one the highest of its windows."""
    out = np.full(len(units), -np.inf)
    if units:
        for owner, codes in _windows(units):
            for first in range(0, len(owner), ROWS_AT_ONCE):
                numbers, each = _subsequences(codes[first:first + ROWS_AT_ONCE])
                value = (weights[numbers] * each).sum(axis=1) / np.maximum(_lengths(numbers), 1e-9)
                np.maximum.at(out, owner[first:first + ROWS_AT_ONCE], value)
    out[np.isneginf(out)] = 0.0
    return out + bias


@dataclass
class Model:
    """A weight per subsequence, the bias, and where the score reaches ``CUT`` and how steeply."""

    weights: np.ndarray
    bias: float
    middle: float
    slope: float
    landmarks: list[str]

    def score(self, decisions: np.ndarray) -> np.ndarray:
        steep = np.clip(self.slope * (decisions - self.middle), -60, 60)
        return 1 / (1 + (1 - CUT) / CUT * np.exp(-steep.astype(np.float64)))


class _Worst(dict):
    """Decision values of texts, with those of units remembered."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def of(self, texts: Iterable[str]) -> np.ndarray:
        each = [text_units(t) for t in texts]
        fresh = list(set().union(*each) - self.keys())
        if len(self) + len(fresh) > CACHED:
            self.clear()
            fresh = list(set().union(*each))
        self.update(zip(fresh, unit_decisions(fresh, self.model.weights, self.model.bias).tolist()))
        return np.array([max(map(self.__getitem__, units), default=-np.inf) for units in each], np.float64)


def decisions(docs: DataFrame, model: Model, columns: list[str], text_column: str = "text") -> DataFrame:
    """``columns`` of each row and the decision value of its whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worst = _Worst(model)
        for batch in batches:
            texts = batch.column("__text")
            values = [worst.of(t.as_py() for t in texts[a:a + TEXTS_AT_ONCE])
                      for a in range(0, len(texts), TEXTS_AT_ONCE)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(np.concatenate(values or [np.zeros(0)]))],
                [*columns, "decision"])

    rows = docs.select(*columns, F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, decision double")


def training_labels(labels: DataFrame) -> DataFrame:
    """``id, toxic`` of the labels to learn from: one row per id that is not held out, toxic if any label is."""
    return (labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
            .where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("id"))
            .groupBy("id").agg(F.max("toxic").alias("toxic")))


def training_documents(docs: DataFrame, labels: DataFrame, per_class: int = DOCUMENTS_PER_CLASS) -> DataFrame:
    """``doc, toxic, fit, text`` of at most ``per_class`` toxic and clean labelled documents, taken by hash of the id."""
    known = training_labels(labels)
    order = F.md5(F.concat(F.lit("fit-"), F.col("id").cast("string")))
    some = [known.where(F.col("toxic") == c).orderBy(order).limit(per_class) for c in (0, 1)]
    chosen = some[0].union(some[1]).withColumn("fit", F.crc32(F.concat(F.lit("fit-"), F.col("id").cast("string"))) % 4 != 0)
    return checkpointed(docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
                        .where("text IS NOT NULL").join(chosen, "id")
                        .select(F.monotonically_increasing_id().alias("doc"), "toxic", "fit", "text"))


def document_units(sample: DataFrame) -> DataFrame:
    """``doc, toxic, unit`` for the different units of each document of the fit, stored."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            units = [[u for u in text_units(t) if u] for t in frame.text]
            sizes = list(map(len, units))
            yield pd.DataFrame({"doc": np.repeat(frame.doc, sizes), "toxic": np.repeat(frame.toxic, sizes),
                                "unit": list(itertools.chain.from_iterable(units))})

    return checkpointed(sample.where("fit").select("doc", "toxic", "text")
                        .mapInPandas(run, "doc long, toxic int, unit string"))


def without_copies(units: DataFrame) -> DataFrame:
    """One document of each group of near copies: of those that agree in one of two min-hashes of their long units.

    Words that only one page and its copies hold would else look as if many
    documents bore them out. Documents without long units all stay.
    """
    hashes = [F.xxhash64("unit"), F.xxhash64("unit", F.lit(1))]
    marks = units.where(F.length("unit") >= LONG_UNIT).groupBy("doc").agg(
        *[F.min(h).alias(f"m{i}") for i, h in enumerate(hashes)])
    marks = checkpointed(marks)
    later = [marks.join(marks.groupBy(m).agg(F.min("doc").alias("first")), m).where(F.col("doc") > F.col("first"))
             .select("doc") for m in ("m0", "m1")]
    return checkpointed(units.join(later[0].union(later[1]), "doc", "left_anti"))


def unit_counts(units: DataFrame) -> DataFrame:
    """``unit, toxic, clean``: in how many toxic and clean documents a unit stands, stored."""
    return checkpointed(units.groupBy("unit").agg(
        F.sum("toxic").cast("long").alias("toxic"), F.sum(1 - F.col("toxic")).cast("long").alias("clean")))


def _toxic_units(units: DataFrame, counts: DataFrame) -> DataFrame:
    """Units that hold a group of characters bound to toxic documents, by the strength of the best one.

    A toxic document stands for its strongest groups only, those of at least
    ``SUPPORT`` times the ratio of the best. So words that fill a rare page and its
    many copies are not taken for insults when an insult explains the page.
    """
    inside = [F.expr(f"transform(sequence(1, greatest(length(unit) - {n - 1}, 1)), i -> substring(unit, i, {n}))")
              for n in GRAMS]
    leads = F.array(*[F.concat(F.lit(" "), F.substring("unit", 1, n)) for n in LEADS])
    grams = counts.where(F.length("unit") >= min(LEADS)).select(
        "unit", "toxic", "clean", F.explode(F.array_distinct(F.concat(*inside, leads))).alias("gram"))
    tally = grams.groupBy("gram").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    totals = counts.agg(F.sum("toxic").alias("ta"), F.sum("clean").alias("tb"))
    share = F.col("ta") / (F.col("ta") + F.col("tb"))
    n = F.col("a") + F.col("b")

    def part(seen: str, expected: Column) -> Column:
        return F.when(F.col(seen) > 0, F.col(seen) * F.log(F.col(seen) / expected)).otherwise(0.0)

    strong = (tally.join(totals.hint("broadcast")).withColumn("ratio", 2 * (part("a", n * share) + part("b", n * (1 - share))))
              .where((F.col("a") >= PURITY * n) & (F.col("ratio") >= RATIO)).select("gram", "ratio"))
    held = checkpointed(grams.join(strong, "gram"))
    seen = (units.where("toxic = 1").select("doc", "unit").join(held.select("unit", "gram", "ratio"), "unit")
            .select("doc", "gram", "ratio").distinct())
    best = seen.groupBy(F.col("doc").alias("d")).agg(F.max("ratio").alias("best"))
    backed = seen.join(best, F.col("doc") == F.col("d")).where(F.col("ratio") >= SUPPORT * F.col("best"))
    return (held.where(F.col("toxic") > F.col("clean") * PURITY / (1 - PURITY))
            .join(backed.select("gram").distinct(), "gram")
            .groupBy("unit").agg(F.max("ratio").alias("ratio"), F.max("toxic").alias("toxic")))


def _table(units: list[str]) -> np.ndarray:
    """One column per unit: its vector over all subsequences."""
    table = np.zeros((LETTERS ** 3, len(units)), np.float32)
    for column, unit in enumerate(units):
        numbers, weights = _vector(unit)
        table[numbers, column] = weights
    return table


def _kernels(units: list[str], others: list[str]) -> np.ndarray:
    """The kernel of each unit with each of the others, some of these at a time."""
    out = np.zeros((len(units), len(others)), np.float32)
    vectors = [_vector(u) for u in units]
    for first in range(0, len(others), COLUMNS_AT_ONCE):
        table = _table(others[first:first + COLUMNS_AT_ONCE])
        for row, (numbers, weights) in enumerate(vectors):
            out[row, first:first + COLUMNS_AT_ONCE] = weights @ table[numbers]
    return out


def _landmarks(units: list[str], count: int) -> list[str]:
    """Units far from each other: each next one is the least like those chosen so far."""
    likeness = _kernels(units, units)
    chosen, nearest = [0], likeness[0]
    while len(chosen) < min(count, len(units)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, likeness[chosen[-1]])
    return [units[i] for i in chosen]


def _squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The linear support vector machine with squared hinge loss, by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * RIDGE
    for _ in range(50):
        inside = y * (x @ w) < 1
        a = x[inside] * cost[inside, None]
        following = np.linalg.solve(a.T @ x[inside] + ridge, a.T @ y[inside])
        if np.allclose(following, w, atol=1e-9):
            break
        w = following
    return w


def fit_units(toxic: list[str], clean: list[str]) -> tuple[np.ndarray, float, list[str]]:
    """Weights per subsequence, bias and landmarks of the machine that parts the two lists."""
    marks = [m for units, count in zip((toxic, clean), LANDMARKS) for m in _landmarks(units[:count * 3], count)]
    values, axes = np.linalg.eigh(_kernels(marks, marks).astype(np.float64))
    keep = values > 1e-4 * values.max()
    root = axes[:, keep] / np.sqrt(values[keep])  # K^(-1/2) on the space the landmarks span
    x = np.hstack([_kernels(toxic + clean, marks) @ root, np.ones((len(toxic) + len(clean), 1))])
    y = np.concatenate([np.ones(len(toxic)), -np.ones(len(clean))])
    cost = np.where(y > 0, 1 / len(toxic), 1 / len(clean)) * len(y) / 2
    w = _squared_hinge(x, y, cost)
    combined = np.zeros(LETTERS ** 3, np.float32)
    for mark, share in zip(marks, root @ w[:-1]):
        numbers, weights = _vector(mark)
        combined[numbers] += np.float32(share) * weights
    return combined, float(w[-1]), marks


def _calibrated(decision: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Where F1 is best, and the slope that takes the mean distance from there to 3."""
    order = np.argsort(-decision, kind="stable")
    value, hit, cost = decision[order], toxic[order] == 1, weight[order]
    found, taken = np.cumsum(cost * hit), np.cumsum(cost)
    f1 = 2 * found / (taken + (cost * hit).sum())
    f1[:-1][value[:-1] == value[1:]] = -1
    best = int(f1.argmax())
    below = value[best + 1] if best + 1 < len(value) else value[best] - 1
    middle = below + (value[best] - below) * NEARER_CLEAN  # insults with characters put in lie below plain ones
    return float(middle), float(3 / max(np.abs(value - middle).mean(), 1e-3))


def fit_model(docs: DataFrame, labels: DataFrame, per_class: int = DOCUMENTS_PER_CLASS) -> Model | None:
    """The model, or None where there are no toxic or no clean labelled rows to learn from.

    What reaches the driver is bounded by the parameters above: units of the two
    classes, and one decision per document of the sample.
    """
    labels = labels.select("doc_id", "toxic")
    sample = training_documents(docs, labels, per_class)
    units = without_copies(document_units(sample))
    counts = unit_counts(units)
    toxic = [r.unit for r in _toxic_units(units, counts).orderBy(F.desc("ratio"), F.desc("toxic"), "unit")
             .limit(TOXIC_UNITS).collect()]
    spread = F.xxhash64("unit")
    is_clean = counts.where("clean > 0 AND length(unit) >= 3").where(
        F.col("clean") * PURITY / (1 - PURITY) >= F.col("toxic"))
    clean = [r.unit for r in is_clean.orderBy(spread, "unit").limit(CLEAN_UNITS).collect()]
    if not toxic or not clean:
        return None
    weights, bias, marks = fit_units(toxic, clean)

    def harder(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"unit": frame.unit, "value": unit_decisions(frame.unit.tolist(), weights, bias)})

    hard = [r.unit for r in is_clean.select("unit").mapInPandas(harder, "unit string, value float")
            .orderBy(F.desc("value"), "unit").limit(HARD_UNITS).collect()]
    weights, bias, marks = fit_units(toxic, hard + [u for u in clean if u not in set(hard)])
    model = Model(weights, bias, 0.0, 1.0, marks)
    kept = decisions(sample.where("NOT fit"), model, ["toxic"]).toPandas()
    if kept.toxic.nunique() < 2:
        kept = decisions(sample, model, ["toxic"]).toPandas()
    decision = np.maximum(kept.decision.to_numpy(), -1e6)
    shares = {r.toxic: r.n for r in training_labels(labels).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sizes = kept.toxic.value_counts().to_dict()
    weight = np.array([shares.get(t, 1) / sizes[t] for t in kept.toxic.tolist()])
    model.middle, model.slope = _calibrated(decision, kept.toxic.to_numpy(), weight)
    return model


def score_of(decision: Column, model: Model) -> Column:
    steep = F.greatest(F.least((decision - model.middle) * model.slope, F.lit(60.0)), F.lit(-60.0))
    return F.when(decision == float("-inf"), F.lit(0.0)).otherwise(1 / (1 + F.exp(-steep) * ((1 - CUT) / CUT)))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    A null text counts as empty, and texts without units score 0. A null id gives a
    row that is not held out. Repeated rows stay repeated; labels that disagree
    about an id count as toxic, null labels do not count. Without labels of both
    kinds every score is 0. An empty table gives no rows. Scores depend on the
    text alone; other columns are not read.
    """
    model = fit_model(docs, labels)
    ids = docs.select("doc_id", held_out().alias("held_out"), "text")
    if model is None:
        return ids.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    rows = decisions(ids, model, ["doc_id", "held_out"])
    return rows.select("doc_id", "held_out", score_of(F.col("decision"), model).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`toxicity_scores` predicts as toxic; all columns stay."""
    model = fit_model(docs, labels)
    if model is None:
        return docs
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    rows = decisions(named, model, named.columns, f"c{docs.columns.index('text')}")
    return rows.where(score_of(F.col("decision"), model) < CUT).drop("decision").toDF(*docs.columns)
