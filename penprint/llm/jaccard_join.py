"""N-gram Jaccard join with several global token orders, every link confirmed on full shingle sets.

Two sets of similarity ``percent`` or more share at least that part of the larger one. So under any order of all
shingles they share one among the first ``n - ceil(percent * n / 100) + 1`` of each (the *prefix*). Here there are
several ``ORDERS``, and a pair is a candidate only if its prefixes meet under every one of them:

1. Equal shingle sets form one class. Every order deals all shingles of all texts to cells of its own and counts
   them there; shingles of the least crowded cells come first, so those that many texts hold come last. Any order
   gives all links, so a cell shared by accident costs time only.
2. Classes are entered under each shingle of their first prefix, by bands of size, for linked sets differ little in
   size. In every such bucket all members meet one center, the one that shares the most buckets, so a group of
   copies costs as many pairs as it has members. The first prefix is longer by ``MEETINGS - 1``, so linked sets share
   ``MEETINGS`` of its shingles, and pairs that chance brings together under fewer go no further.
3. Of these pairs those of fitting sizes whose prefixes also meet under the other orders are verified.
4. Members of a bucket that are still in different components meet in blocks of bounded size, first by their prefixes
   under all orders; only members of pairs that pass them all bring their sets. A pair of blocks returns a spanning
   forest of its links, never all of them, so no link between different components is lost.

Prefixes hold 32 bits of a shingle's hash, which lets more pairs through and loses none; sets hold 64 bits. Words are
runs of characters other than ASCII white space, A-Z in lower case.

Defined results: texts that are null, empty or white space have no shingles and link with nothing; texts with fewer
words than a shingle have one, the whole sequence; long texts are read whole; repeated rows are one class; a null
``doc_id`` never becomes a component's id while another is there; ties between centers go to the larger class
number and change no result; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.llm.bpe import bounded_batches
from penprint.llm.common import saved, table
from penprint.llm.components import components
from penprint.llm.near_dedup import _blocks as deal_blocks
from penprint.llm.near_dedup import _class_of as class_of
from penprint.llm.near_dedup import shingle_set

# An order has cells of its own, this many bits wide; a mixer deals shingles to them and breaks ties.
ORDERS = ((20, 0x9E3779B97F4A7C15), (16, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9))
PREFIXES = [f"prefix{j}" for j in range(len(ORDERS))]
CELLS = sum(1 << bits for bits, _ in ORDERS)
SIEVE_BITS = 1 << 25
# So many shingles of the first prefix are shared by linked sets, as far as they share so many at all.
MEETINGS = 2


def _mixed(shingles: np.ndarray, mixer: int) -> np.ndarray:
    mixed = shingles * np.uint64(mixer)
    return (mixed ^ (mixed >> np.uint64(32))) * np.uint64(mixer)


def _cells(mixed: np.ndarray, bits: int) -> np.ndarray:
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def crowds(docs: DataFrame, size: int) -> list[np.ndarray]:
    """For every order the places of its cells, from the least to the most crowded.

    Tasks count on their own and send a row per cell; the driver gets ``CELLS`` rows at most.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(1 << bits, np.int64) for bits, _ in ORDERS]
        for batch in batches:
            sets = [shingle_set(text.as_py(), size) for text in batch.column(0)]
            shingles = np.concatenate([np.empty(0, np.uint64), *sets])
            for total, (bits, mixer) in zip(totals, ORDERS, strict=True):
                total += np.bincount(_cells(_mixed(shingles, mixer), bits), minlength=1 << bits)
        total = np.concatenate(totals)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["cell", "n"])

    counted = docs.select("text").mapInArrow(work, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    places, at = [], 0
    for bits, _ in ORDERS:
        place = np.empty(1 << bits, np.uint32)
        place[np.argsort(counts[at : at + len(place)], kind="stable")] = np.arange(len(place), dtype=np.uint32)
        places.append(place)
        at += len(place)
    return places


def size_edges(percent: int) -> np.ndarray:
    """First sizes of bands so wide that sets of similarity ``percent`` lie in the same or in neighbouring bands."""
    edges = [1]
    while edges[-1] < 2**40:
        edges.append(edges[-1] * 100 // min(percent, 99) + 1)  # wider bands do as well
    return np.array(edges)


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def prefixes(shingles: np.ndarray, places: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """The first shingles under each order, cut to 32 bits, sorted; equal ones stay in the first, which is counted."""
    found = []
    for place, (bits, mixer) in zip(places, ORDERS, strict=True):
        length = prefix_length(len(shingles), percent)
        length = length if found else min(len(shingles), length + MEETINGS - 1)
        mixed = _mixed(shingles, mixer)
        order = (place[_cells(mixed, bits)].astype(np.uint64) << np.uint64(64 - bits)) | (mixed & np.uint64((1 << 64 - bits) - 1))
        first = shingles[np.argpartition(order, length - 1)[:length]].astype(np.uint32)
        found.append((np.unique(first) if found else np.sort(first)).view(np.int32))
    return found


def _sketches(docs: DataFrame, places: list[np.ndarray], size: int, percent: int) -> DataFrame:
    """``id, text_hash, n, class, band`` and the prefixes per row; class and prefixes are null without shingles."""
    shared, edges = docs.sparkSession.sparkContext.broadcast(places), size_edges(percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, known, firsts = [], [], [[] for _ in PREFIXES]
            for text in batch.column("text"):
                shingles = shingle_set(text.as_py(), size)
                n.append(len(shingles))
                known.append(class_of(shingles) if len(shingles) else None)
                found = prefixes(shingles, shared.value, percent) if len(shingles) else [None] * len(PREFIXES)
                for column, prefix in zip(firsts, found, strict=True):
                    column.append(prefix)
            band = np.searchsorted(edges, n, "right")
            columns = [batch.column("id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(band, pa.int32())]
            columns += [pa.array(column, pa.list_(pa.int32())) for column in firsts]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "n", "class", "band", *PREFIXES])

    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    lists = ", ".join(f"{p} array<int>" for p in PREFIXES)
    return rows.mapInArrow(work, f"id {kind}, text_hash bigint, n bigint, class bigint, band int, {lists}")


def _spot(*row: str | Column) -> Column:
    return F.pmod(F.xxhash64(*row), F.lit(SIEVE_BITS))


def _sieve(spots: DataFrame) -> Broadcast:
    """A table of ``SIEVE_BITS`` bits, the same size for any input, that tells tasks which rows to take."""
    parts = spots.groupBy(F.shiftright("spot", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("spot").bitwiseAND(32767)).alias("bits"))
    sieve = np.zeros((SIEVE_BITS >> 15, 4096), np.uint8)
    for part, bits in parts.collect():
        sieve[part] = np.frombuffer(bits, np.uint8)
    return spots.sparkSession.sparkContext.broadcast(sieve.ravel())


def _hits(sieve: np.ndarray, spots: np.ndarray) -> np.ndarray:
    return ((sieve[spots >> 3] >> (spots & 7)) & 1).astype(bool)


def sifted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose ``class`` is wanted, and a few more that hit a bit by accident. No row moves."""
    shared = _sieve(wanted.select(_spot("class").alias("spot")))

    @F.arrow_udf("boolean")
    def hit(spots: pa.Array) -> pa.Array:
        return pa.array(_hits(shared.value, spots.to_numpy()))

    return rows.where(hit(_spot("class")))


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``class, shingles`` for the wanted classes, from the text of one document of each, and a few more.

    No text moves: a sieve tells tasks which rows to read. Rows that hit a bit by accident add sets that nothing joins.
    """
    shared = _sieve(wanted.select(_spot("at.id", "at.text_hash").alias("spot")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = np.flatnonzero(_hits(shared.value, batch.column("spot").to_numpy()))
            sets = [shingle_set(batch.column("text")[i].as_py(), size) for i in hits.tolist()]
            sets = [s for s in sets if len(s)]
            columns = [pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["class", "shingles"])

    rows = docs.select(_spot("doc_id", F.xxhash64("text")).alias("spot"), "text")
    return rows.mapInArrow(work, "class bigint, shingles array<bigint>").dropDuplicates(["class"])


def tested_pairs(placed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``center, class`` of fitting sizes that share enough shingles of their first prefixes to be linked.

    A shingle is one bucket for sets of neighbouring bands and two for sets of one band. Buckets that a pair shares
    under another center are not counted here; there both are members, and meet in blocks if still apart.
    """
    sizes = classes.select("class", "n", "band")
    of_center = sizes.select(F.col("class").alias("center"), F.col("n").alias("c_n"), F.col("band").alias("c_band"))
    met = placed.groupBy("center", "class").agg(F.count(F.lit(1)).alias("met")).join(of_center, "center").join(sizes, "class")
    larger = F.greatest("n", "c_n")
    needed = F.least(F.lit(MEETINGS), F.ceil(larger * percent / 100)) * F.when(F.col("band") == F.col("c_band"), 2).otherwise(1)
    fits = F.least("n", "c_n") * 100 >= larger * percent
    return met.where(fits & (F.col("met") >= needed)).select("center", "class")


def candidates(tested: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``center, class`` of fitting sizes whose prefixes meet under every order but the first, which dealt them."""
    others = PREFIXES[1:]
    of_center = classes.select(F.col("class").alias("center"), F.col("n").alias("c_n"), *[F.col(p).alias(f"c_{p}") for p in others])
    met = tested.join(of_center, "center").join(classes.select("class", "n", *others), "class")
    met = met.where(F.least("n", "c_n") * 100 >= F.greatest("n", "c_n") * percent)
    for prefix in others:
        met = met.where(F.arrays_overlap(prefix, f"c_{prefix}"))
    return met.select("center", "class")


def open_members(placed: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """``center, class, n, comp``: members that share a bucket with a member of another component.

    ``placed`` has the members of buckets of more than two, without their centers, which have met all of them.
    """
    rows = placed.join(roots, F.col("class") == F.col("node"), "left")
    rows = rows.select("token", "center", "class", F.coalesce("root", "class").alias("comp"))
    split = rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    members = rows.join(split.select("token"), "token", "left_semi").select("center", "class", "comp").distinct()
    return members.join(classes.select("class", "n"), "class").select("center", "class", "n", "comp")


def _bits(lists: pa.ListArray, rows: int) -> np.ndarray:
    """A bit set per row over the entries that several rows hold."""
    size = np.diff(lists.offsets.to_numpy())
    _, place, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    shared = times[place] > 1
    slot = (np.cumsum(times > 1) - 1)[place[shared]]
    bits = np.zeros((rows, int((times > 1).sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (np.repeat(np.arange(rows), size)[shared], slot >> 6), np.uint64(1) << (slot & 63).astype(np.uint64))
    return bits


class _Block:
    """Members of a block, or of two, and the pairs among them that the filters of all orders let through."""

    def __init__(self, part: pa.Table, percent: int):
        self.comp, self.side, self.size = (part.column(c).to_numpy() for c in ("comp", "side", "n"))
        self.firsts = [_bits(part.column(p).combine_chunks(), len(part)) for p in PREFIXES]
        self.percent = percent

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """A member, and the others of fitting size and another component whose prefixes meet its own under every order."""
        both = self.side.max() > 0
        for i in np.flatnonzero(self.side == 0).tolist():
            others = (self.side == 1) if both else (np.arange(len(self.side)) > i)
            fits = np.minimum(self.size, self.size[i]) * 100 >= np.maximum(self.size, self.size[i]) * self.percent
            j = np.flatnonzero(others & fits & (self.comp != self.comp[i]))
            for bits in self.firsts:
                j = j[(bits[j] & bits[i]).any(axis=1)]
            if len(j):
                yield i, j


def _block_members(percent: int):
    """The rows of a block that are in a pair at all."""

    def work(part: pa.Table) -> pa.Table:
        kept = np.zeros(len(part), bool)
        for i, j in _Block(part, percent).pairs():
            kept[i] = True
            kept[j] = True
        return part.select(["center", "first", "second", "class", "comp", "side"]).filter(pa.array(kept))

    return work


def _block_links(percent: int):
    """Links between different components within a block, or between two, as a spanning forest."""

    def work(part: pa.Table) -> pa.Table:
        block, node = _Block(part, percent), part.column("class").to_numpy()
        members = None
        root = {int(c): int(c) for c in block.comp}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        found = []
        for i, j in block.pairs():
            members = _bits(part.column("shingles").combine_chunks(), len(node)) if members is None else members
            common = np.bitwise_count(members[j] & members[i]).sum(axis=1, dtype=np.int64)
            for k in j[common * 100 >= (block.size[j] + block.size[i] - common) * percent]:
                a, b = find(int(block.comp[i])), find(int(block.comp[k]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    found.append((int(node[i]), int(node[k])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return work


def jaccard_classes(docs: DataFrame, size: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links that span every component, components, and membership.

    ``a, b``: pairs of classes (equal shingle sets) whose sets share at least ``percent`` of their union;
    ``node, root`` for every linked class; ``id, text_hash, n, class`` for every row of ``doc_id, text``.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = saved(_sketches(docs, crowds(docs, size), size, percent), "jaccard-sketches")
    classes = saved(
        rows.where("n > 0")
        .groupBy("class")
        .agg(F.min(F.struct("id", "text_hash")).alias("at"), F.first("n").alias("n"), F.first("band").alias("band"), *[F.first(p).alias(p) for p in PREFIXES]),
        "jaccard-classes",
    )
    tokens = classes.select("class", "band", F.explode_outer(PREFIXES[0]).alias("token"))
    tokens = tokens.select("class", F.explode_outer(F.array(F.xxhash64("token", "band"), F.xxhash64("token", F.col("band") + 1))).alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = saved(tokens.join(shared, "token"), "jaccard-buckets")
    rank = buckets.groupBy("class").agg(F.sum("members").alias("rank"))
    centers = buckets.join(rank, "class").groupBy("token").agg(F.max_by("class", F.struct("rank", "class")).alias("center"))
    placed = buckets.join(centers, "token").where("class <> center").select("token", "center", "class", "members")
    placed = saved(placed, "jaccard-placed")
    tested = saved(tested_pairs(placed, classes, percent), "jaccard-tested")
    # The rest of the classes is alone; only these move on, with their prefixes.
    met = tested.select("class").union(tested.select("center")).union(placed.where("members > 2").select("class"))
    active = saved(sifted(classes, met.distinct()), "jaccard-active")
    pairs = saved(candidates(tested, active, percent), "jaccard-candidates")

    places = active.select("class", "at")
    wanted = pairs.select("class").union(pairs.select("center")).distinct()
    sets = sets_of(docs, places.join(wanted, "class"), size)  # dealt by class once, for members and for centers
    center_sets = sets.select(F.col("class").alias("center"), F.col("shingles").alias("center_shingles"))
    common = F.size(F.array_intersect("shingles", "center_shingles"))
    linked = common * 100 >= (F.size("shingles") + F.size("center_shingles") - common) * percent
    links = pairs.join(sets, "class").join(center_sets, "center").where(linked)
    links = saved(links.select(F.col("class").alias("a"), F.col("center").alias("b")), "jaccard-links")

    # All members of a bucket have met its center; what is not connected by that meets in blocks.
    roots = components(links)
    dealt = deal_blocks(open_members(placed.where("members > 2"), active, roots))
    filters = active.select("class", "n", *PREFIXES)
    block = ["center", "first", "second"]
    rows_of_block = "center bigint, first int, second int, class bigint, comp bigint, side int"
    dealt = dealt.join(filters, "class").groupBy(*block).applyInArrow(_block_members(percent), rows_of_block)
    dealt = saved(dealt, "jaccard-blocks")
    sets = sets_of(docs, places.join(dealt, "class", "left_semi"), size)
    full = dealt.join(sifted(filters, dealt.select("class").distinct()), "class").join(sets, "class")
    more = full.groupBy(*block).applyInArrow(_block_links(percent), "a bigint, b bigint")
    more = saved(more, "jaccard-more")
    links = links.union(more)
    return links, roots if more.isEmpty() else components(links), rows.drop("band", *PREFIXES)


def jaccard_join(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``doc_id, text``: the lowest id reachable by links."""
    _, found, rows = jaccard_classes(docs, size, percent)
    lowest = rows.where("n > 0").groupBy("class").agg(F.min("id").alias("low"))
    grouped = lowest.join(found, F.col("class") == F.col("node"), "left").select("class", "low", F.coalesce("root", "class").alias("root"))
    named = grouped.join(grouped.groupBy("root").agg(F.min("low").alias("component")), "root").select("class", "component")
    out = rows.join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
