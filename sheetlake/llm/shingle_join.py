"""Jaccard join of word shingles, by a tree over count vectors.

A text is the set of its different shingles (runs of words), each a 64-bit hash; equal
sets are one node. Shingles are hashed into ``GROUPS`` groups, and a node's counts per
group are a point. Two sets have at most the sum of the smaller count of each group in
common, and two boxes of points at most the sum of the smaller of their upper corners,
so a box or a point that cannot reach the similarity is left without opening it.

Alone, such a tree prunes nothing near its root: counts of unrelated texts differ by
less, in each coordinate, than a similarity of 0.8 allows in all of them together. So
the tree's top level is a split by single rare shingles. All shingles are ordered by
how frequent their hash slot is in the whole table. Sets of similarity 0.8 must share
one of the first fifth of each, so a point is entered under each of those, and entries
with the same points are one. Below an entry come bands of sizes, pages of about
``PAGE`` points, and leaves of ``LEAF`` points with their boxes.

The search goes in two ways. Upwards, every entry compares its points with one of them,
its pivot (the point of most neighbours first), and what is joined up so needs no pairs.
That is repeated while it joins a tenth of what is still apart. Downwards, the points
that are still apart go through the boxes of their entries, against all points of other
components. What survives either bound is verified on the sets themselves.

Hashes stand for words, shingles and sets: unequal ones agree with a chance of 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlake.llm.common import hash_bitmap, keyed, mixed, place_of, text_groups, text_of, words_of
from sheetlake.llm.graph import component_roots
from sheetlake.session import checkpointed, drop_scratch

SHINGLE_WORDS = 5
GROUPS = 256
SLOT_BITS = 16
FILTER_BITS, KEY_BITS = 1 << 23, 1 << 26
PAGE, LEAF = 512, 32
ROWS_AT_ONCE, HASHES_AT_ONCE = 512, 1 << 17  # of a batch in a task's Python, and of sets in a batch that it gives
BAND = 1.3  # more than 5 / 4, so similar sets lie in one band or in two neighbouring ones
_FACTOR = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(texts: Iterable[bytes], size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The different hashes of each text's shingles, sorted; of all its words if there are fewer than ``size``."""
    for group in text_groups(texts):
        words = words_of(group)
        runs = _runs(words.hashes, size)
        begin = 0
        for until in words.until.tolist():
            count = until - begin
            found = runs[begin:until - size + 1] if count >= size else _runs(words.hashes[begin:until], count) if count else runs[:0]
            found = np.sort(found)
            yield found[np.concatenate(([True], found[1:] != found[:-1]))] if count else found
            begin = until


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    total = np.full(max(len(words) - size + 1, 0), size, np.uint64)
    for i in range(size):
        total = total * _FACTOR + words[i:i + len(total)]
    return mixed(total)


def set_node(hashes: np.ndarray) -> int:
    """The node of a set, as a signed 64-bit number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def group_counts(hashes: np.ndarray) -> bytes:
    """The point of a set: counts of its hashes per group, of one byte each if they fit, else of four."""
    counts = np.bincount((hashes & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def _points(values: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.uint8 if len(v) == GROUPS else np.uint32) for v in values]).astype(np.int64)


def first_shingles(hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first fifth of a set, and one more, in the order of all shingles, as places in that order."""
    low = np.uint64((1 << (64 - SLOT_BITS)) - 1)
    order = ranks[hashes >> np.uint64(64 - SLOT_BITS)] << np.uint64(64 - SLOT_BITS) | hashes & low
    count = len(order) - (4 * len(order) + 4) // 5 + 1
    return np.partition(order, count - 1)[:count]


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (t.as_py() for t in batch.column("__text").cast(pa.binary()))


def set_nodes(rows: DataFrame, size: int) -> DataFrame:
    """``__id, __at, n_shingles, node`` of each row of ``__id, __at, __text``, and rows with ``slots`` alone: each
    task's counts per slot. Stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = np.zeros(1 << SLOT_BITS, np.int64), None
        for batch in batches:
            sizes, nodes, kind = [], [], batch.column("__id").type
            for hashes in shingle_sets(_texts(batch), size):
                sizes.append(len(hashes))
                nodes.append(set_node(hashes) if len(hashes) else None)
                np.add.at(total, (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("__at"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                 pa.nulls(len(sizes), pa.binary())], names)
        if kind is not None:
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), none, none, none, pa.array([total.tobytes()], pa.binary())], names)

    names = ["__id", "__at", "n_shingles", "node", "slots"]
    kind = dict(rows.dtypes)["__id"]
    return checkpointed(rows.select("__id", "__at", "__text").mapInArrow(
        run, f"__id {kind}, __at long, n_shingles long, node long, slots binary"))


def slot_ranks(nodes: DataFrame) -> np.ndarray:
    """The rank of each slot by the number of shingles in it, over all rows; one number for each slot comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for slots in batch.column("slots"):
                total += np.frombuffer(slots.as_py(), np.int64)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["slot", "n"])

    total = np.zeros(1 << SLOT_BITS, np.int64)
    parts = nodes.where("slots IS NOT NULL").select("slots").mapInArrow(run, "slot long, n long")
    for row in parts.groupBy("slot").agg(F.sum("n").alias("n")).collect():
        total[row.slot] = row.n
    ranks = np.empty(len(total), np.uint64)
    ranks[np.argsort(total, kind="stable")] = np.arange(len(total), dtype=np.uint64)
    return ranks


def _once(batch: pa.RecordBatch, seen: set[int], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(node, set)`` of each text that is not empty and whose set this task has not met."""
    for hashes in shingle_sets(_texts(batch), size):
        if len(hashes):
            node = set_node(hashes)
            if node not in seen:
                seen.add(node)
                yield node, hashes


def indexed(texts: DataFrame, ranks: np.ndarray, size: int) -> DataFrame:
    """``node, size, point, keys``: the point of each set, and the first shingles under which it is entered. Stored.

    A task gives a set once, however many of its texts have it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _parts(batches):
            found = list(_once(batch, seen, size))
            keys = [first_shingles(hashes, ranks) for _, hashes in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in found], pa.int64()), pa.array([len(h) for _, h in found], pa.int64()),
                 pa.array([group_counts(h) for _, h in found], pa.binary()), _lists(keys)], ["node", "size", "point", "keys"])

    return checkpointed(texts.mapInArrow(run, "node long, size long, point binary, keys array<long>"))


def entries(index: DataFrame) -> DataFrame:
    """``key, node, n``: the points of each entry that has several, stored; of entries with the same points one is kept.

    Keys are counted first; those counted more than once go to the tasks as one bitmap
    of ``KEY_BITS`` hash places, and only entries that it lets through are joined.
    """
    several = checkpointed(index.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
                           .where("n > 1").select("key"))
    bitmap = hash_bitmap(several, "key", KEY_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("keys")
            keys = lists.flatten().to_numpy(zero_copy_only=False)
            place = keys & (KEY_BITS - 1)
            held = np.flatnonzero(bitmap[place >> 3] >> (place & 7) & 1)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(keys[held]), batch.column("node").take(pa.array(owner[held]))], ["key", "node"])

    some = index.select("node", "keys").mapInArrow(run, "key long, node long")
    shared = checkpointed(some.join(several, "key", "left_semi").distinct())  # copies in two tasks come twice
    drop_scratch(several)
    alike = (shared.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                       F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
             .where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")))
    kept = checkpointed(shared.join(checkpointed(alike.select("key", "n")), "key").select("key", "node", "n"))
    drop_scratch(shared)
    return kept


@dataclass
class Points:
    """The sets of the entries: ``points`` are ``node, size, point``, ``places`` the row of ``rows`` that has a node."""

    rows: DataFrame
    points: DataFrame
    places: DataFrame
    size: int

    def sets(self, wanted: DataFrame) -> DataFrame:
        """``node, hashes`` of the wanted nodes at least, stored.

        Their rows go to the tasks as one bitmap of ``FILTER_BITS`` hash places, whatever
        their number; only the texts that it lets through are read, some of them by chance.
        """
        bitmap = hash_bitmap(self.places.join(wanted, "node", "left_semi"), "__at", FILTER_BITS)
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _parts(batches):
                place = batch.column("__at").to_numpy() & (FILTER_BITS - 1)
                chosen = batch.filter(pa.array((bitmap[place >> 3] >> (place & 7) & 1).astype(bool)))
                some: list[np.ndarray] = []
                held = 0
                for hashes in shingle_sets(_texts(chosen), size):
                    if len(hashes):
                        some.append(hashes)
                        held += len(hashes)
                    if held > HASHES_AT_ONCE:
                        yield _set_rows(some)
                        some, held = [], 0
                yield _set_rows(some)

        return checkpointed(self.rows.select("__at", "__text").mapInArrow(run, "node long, hashes array<long>"))


def entered_points(rows: DataFrame, nodes: DataFrame, index: DataFrame, members: DataFrame, size: int) -> Points:
    """The points of all nodes of the entries, and where their texts are; stored."""
    wanted = checkpointed(members.select("node").distinct())
    points = index.select("node", "size", "point").join(wanted, "node", "left_semi").dropDuplicates(["node"])
    places = (nodes.where("node IS NOT NULL").select("node", "__at").join(wanted, "node", "left_semi")
              .groupBy("node").agg(F.min("__at").alias("__at")))
    return Points(rows, checkpointed(points), checkpointed(places), size)


def _lists(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.uint64), *values])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat.view(np.int64)))


def _set_rows(some: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([set_node(h) for h in some], pa.int64()), _lists(some)], ["node", "hashes"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``ROWS_AT_ONCE`` rows at most: what is made of a row may take far more than the row."""
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(first, ROWS_AT_ONCE)


def _near_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those pairs whose points allow the similarity."""
    for batch in _parts(batches):
        if batch.num_rows:
            one, other = (_points(batch.column(c).to_pylist()) for c in ("p", "q"))
            sizes = batch.column("s").to_numpy() + batch.column("t").to_numpy()
            near = 9 * np.minimum(one, other).sum(axis=1) >= 4 * sizes
            yield batch.select(["a", "b"]).filter(pa.array(near))


def verified(pairs: DataFrame, points: Points, bounded: bool = False) -> DataFrame:
    """Those of the pairs ``a, b`` with 100 * intersection >= 80 * union, stored.

    Only pairs whose points allow it have their sets read and compared (``bounded``:
    known to). Partners differ in size by a quarter at most, so what a long text sends
    along with its pairs is at most that much more than what its partners send.
    """
    pairs = checkpointed(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    near = pairs
    if not bounded:
        both = (pairs.join(points.points.toDF("a", "s", "p"), "a").join(points.points.toDF("b", "t", "q"), "b")
                .where("5 * s >= 4 * t AND 5 * t >= 4 * s"))
        near = checkpointed(both.select("a", "b", "s", "t", "p", "q").mapInArrow(_near_points, "a long, b long"))
        drop_scratch(pairs)
    sets = points.sets(near.select(F.col("a").alias("node")).union(near.select("b")).distinct())
    both = (near.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b"))
    # With n in common of x and y: n / (x + y - n) >= 4 / 5.
    found = checkpointed(both.where("9L * size(array_intersect(x, y)) >= 4L * (size(x) + size(y))").select("a", "b"))
    drop_scratch(near)
    drop_scratch(sets)
    return found


def _leaves(points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points by size, then the upper corner and the least size of each run of ``LEAF``."""
    order = np.lexsort((points[:, 1], points[:, 0], sizes))
    begins = np.arange(0, len(order), LEAF)
    return order, np.maximum.reduceat(points[order], begins), np.minimum.reduceat(sizes[order], begins)


def page_pairs(left: dict, right: dict) -> list[tuple[int, int]]:
    """Pairs of a point of each page, of different components, whose boxes and points allow the similarity."""
    pairs = []
    order, tops, least = _leaves(left["points"], left["sizes"])
    order2, tops2, least2 = _leaves(right["points"], right["sizes"])
    for i in range(len(tops)):
        open_ = 9 * np.minimum(tops[i], tops2).sum(axis=1) >= 4 * (least[i] + least2)
        mine = order[i * LEAF:(i + 1) * LEAF]
        for j in np.flatnonzero(open_):
            other = order2[j * LEAF:(j + 1) * LEAF]
            sizes, sizes2 = left["sizes"][mine][:, None], right["sizes"][other][None, :]
            common = np.minimum(left["points"][mine][:, None, :], right["points"][other][None, :, :]).sum(axis=2)
            near = (9 * common >= 4 * (sizes + sizes2)) & (left["roots"][mine][:, None] != right["roots"][other][None, :])
            for x, y in np.argwhere(near).tolist():
                pairs.append((left["nodes"][mine[x]], right["nodes"][other[y]]))
    return pairs


def _page(column: pa.Array, i: int) -> dict:
    rows = column[i].values
    return {"points": _points(rows.field("point").to_pylist()),
            **{f"{c}s": rows.field(c).to_numpy(zero_copy_only=False) for c in ("size", "node", "root")}}


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            pairs = page_pairs(_page(batch.column("mine"), i), _page(batch.column("others"), i))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([int(p[k]) for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def _pages(members: DataFrame, page: int, out: str) -> DataFrame:
    """``key, band, out``: the members of each entry in pages of one band of sizes."""
    counts = checkpointed(members.groupBy("key", "band").agg(F.ceil(F.count("*") / page).alias("pages")))
    return (members.join(counts, ["key", "band"]).withColumn("salt", F.expr("pmod(xxhash64(node), pages)"))
            .groupBy("key", "band", "salt").agg(F.collect_list(F.struct("node", "root", "size", "point")).alias(out)).drop("salt"))


def searched_links(members: DataFrame, points: Points, page: int = PAGE) -> DataFrame:
    """Links of the members that are apart from their entry's largest component; ``members``: ``key, node, root, major``."""
    placed = checkpointed(members.join(points.points, "node").withColumn("band", F.floor(F.log("size") / F.log(F.lit(BAND)))))
    apart = _pages(placed.where("root <> major"), page, "mine").withColumn("band", F.explode(F.expr("sequence(band - 1, band + 1)")))
    pairs = checkpointed(apart.join(_pages(placed, page, "others"), ["key", "band"]).select("mine", "others")
                         .mapInArrow(_searched, "a long, b long"))
    found = verified(pairs, points, bounded=True)
    drop_scratch(placed)
    drop_scratch(pairs)
    return found


def similar_links(shared: DataFrame, points: Points, page: int = PAGE) -> DataFrame:
    """``a, b``: links of similar nodes that join up all similar ones; ``shared`` is ``key, node, n``."""
    links = shared.sparkSession.createDataFrame([], "a long, b long")
    weights = checkpointed(shared.groupBy("node").agg(F.sum("n").alias("weight")))
    state = checkpointed(shared.join(weights, "node").select("key", "node", "weight", F.col("node").alias("root")))
    turn = 0
    while True:
        groups = (state.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key")
                  .agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.count("*").alias("parts")).where("parts > 1"))
        members = checkpointed(state.join(checkpointed(groups.select("key", "major")), "key"))
        drop_scratch(state)
        apart = members.where("root <> major").select("node").distinct().count()
        if not apart:
            return links
        if turn and joined * 10 < apart_before:
            return links.union(searched_links(members, points, page))
        order = F.struct("weight", F.xxhash64("node")) if not turn else F.struct(F.xxhash64("node", F.lit(turn)), "node")
        # In the first turn every node is its own component, so any member may be the pivot.
        pool = members.where("root = major") if turn else members
        pivots = checkpointed(pool.groupBy("key").agg(F.max_by(F.struct("node", "root"), order).alias("pivot")))
        met = (members.join(pivots, "key").where("root <> pivot.root")
               .select(F.col("node").alias("a"), F.col("pivot.node").alias("b")))
        found = verified(met, points)
        joined, apart_before = found.count(), apart
        links = links.union(found)
        roots = component_roots(links)
        state = checkpointed(members.join(roots.withColumnRenamed("root", "now"), "node", "left")
                             .select("key", "node", "weight", F.coalesce("now", "node").alias("root")))
        drop_scratch(members)
        turn += 1


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE_WORDS,
                      page: int = PAGE) -> DataFrame:
    """One row per row of ``docs``: the size of its set and the smallest id reachable by links.

    Two rows are linked if 100 * intersection >= 80 * union of their sets. Null and empty
    texts, and those of white space, have the empty set and are linked with nothing: their
    component is their own id. A text of fewer than ``size`` words is one shingle. Very
    long texts are read in full. Repeated rows are linked as any equal texts. Ids keep
    their type; null ids give rows too, and their component has the smallest id that is
    not null, or null if none is. An empty table gives no rows; other columns are not
    read, whatever their names.
    """
    placed = keyed(docs)
    rows = placed.select(F.col(place_of(docs, id_column)).alias("__id"), F.xxhash64("__row").alias("__at"),
                         text_of(place_of(docs, text_column)).alias("__text"))
    nodes = set_nodes(rows, size)
    index = indexed(rows.select("__text"), slot_ranks(nodes), size)
    shared = entries(index)
    points = entered_points(rows, nodes, index, shared, size)
    drop_scratch(index)
    roots = component_roots(similar_links(shared, points, page))
    prints = nodes.where("slots IS NULL").select("__id", "n_shingles", "node")
    classes = prints.where("node IS NOT NULL").groupBy("node").agg(F.min("__id").alias("first"))
    rooted = checkpointed(classes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    firsts = checkpointed(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    components = checkpointed(rooted.join(firsts, "root").select("node", "component_id"))
    return prints.join(components, "node", "left").select(
        F.col("__id").alias("doc_id"), "n_shingles",
        F.when(F.col("node").isNull(), F.col("__id")).otherwise(F.col("component_id")).alias("component_id"))
