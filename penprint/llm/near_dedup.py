"""MinHash near-duplicates by a multi-index Hamming join, every link confirmed on full shingle sets.

1. Equal shingle sets form one class; each class gets a signature of ``SLOTS`` MinHash slots of eight bits.
2. The signature is cut into ``c = chunks(percent)`` chunks. Two signatures that differ in at most ``2 * c - 1`` slots
   differ in at most one slot of some chunk (pigeonhole). Each class is entered under every chunk with
   each single slot left out, which enumerates those errors, so an equality join meets every such pair.
   There are as many chunks as keep the chance that a pair at the threshold differs in more slots below
   ``MISS``: at 0.85 it differs in 9.6 of 64 slots on average (deviation 2.9), and 12 chunks cover 23 slots
   (chance of more 8.2e-6); at 0.80 in 12.7 (3.2), and 14 chunks cover 27 (1.3e-5).
3. In every bucket all members are compared with the one that shares the most buckets with others. So a
   group of copies of one text costs as many comparisons as it has members.
4. Members of a bucket that are still in different components are compared in blocks of bounded
   size; a block pair returns a spanning forest of its links, never all of them. Members that are
   already connected are not compared again, so no link between different components is lost.
5. Components come from star contractions.

Words are runs of characters other than ASCII white space, A-Z in lower case. Sets hold 64-bit hashes.

Defined results: texts that are null, empty or white space have no shingles and link with nothing;
texts with fewer words than a shingle have one, the whole sequence; a null ``doc_id`` never becomes a
component's id while another is there; rows that repeat the lowest id of a component are all kept; an
empty table gives an empty table; other columns are ignored, and ``keep_one`` passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.llm.common import same, saved, table
from penprint.llm.components import components

SLOTS, MISS = 64, 2e-5
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1_000_000
SEED = 20240229
_SIDES = np.random.default_rng(SEED).integers(1, 2**63, (2, SLOTS), dtype=np.uint64)
_MUL, _ADD = _SIDES[0] | np.uint64(1), _SIDES[1]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``size`` words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    joined = np.zeros(n, np.uint64)
    for k in range(size):
        joined = (joined ^ hashes[k : k + n]) * _MIX
        joined ^= joined >> np.uint64(29)
    return np.unique(joined)


def signature(shingles: np.ndarray) -> bytes:
    lowest = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):  # a step of the table stays in the cache
        np.minimum(lowest, (shingles[at : at + 1024, None] * _MUL + _ADD).min(axis=0), out=lowest)
    return ((lowest * _MIX) >> np.uint64(56)).astype(np.uint8).tobytes()


def _class_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - 2**63


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """``id, text_hash, n, class, sig`` per row; class and sig are null without shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, known, sigs = [], [], []
            for text in batch.column("text"):
                shingles = shingle_set(text.as_py(), size)
                n.append(len(shingles))
                known.append(_class_of(shingles) if len(shingles) else None)
                sigs.append(signature(shingles) if len(shingles) else None)
            columns = [batch.column("id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "n", "class", "sig"])

    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, text_hash bigint, n bigint, class bigint, sig binary")


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``class, shingles`` for the wanted classes, from the text of one document of each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), size).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("class"), pa.array(sets, pa.list_(pa.int64()))], ["class", "shingles"]
            )

    chosen = classes.join(wanted, "class").select("class", "at.id", "at.text_hash")
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    texts = rows.join(chosen, same(rows, chosen, ["id", "text_hash"])).select("class", "text")
    # Rows that repeat id and text name one class, so their sets are equal.
    return texts.mapInArrow(work, "class bigint, shingles array<bigint>").dropDuplicates(["class"])


def chunks(percent: int) -> int:
    """Chunks that meet a pair of similarity ``percent`` but for a chance of ``MISS``; two slots each at least."""
    p = (1 - percent / 100) * 255 / 256  # slots of eight bits also agree by accident

    def miss(count: int) -> float:
        return sum(comb(SLOTS, k) * p**k * (1 - p) ** (SLOTS - k) for k in range(2 * count, SLOTS + 1))

    return next((c for c in range(1, SLOTS // 2) if miss(c) <= MISS), SLOTS // 2)


def _keys(percent: int) -> Column:
    """Bucket keys of ``sig``: every chunk with each of its slots left out in turn."""
    count = chunks(percent)
    edges = np.linspace(0, SLOTS, count + 1).round().astype(int)
    keys = []
    for chunk in range(count):
        first, last = int(edges[chunk]), int(edges[chunk + 1])
        for skip in range(first, last):
            kept = F.concat(F.substring("sig", first + 1, skip - first), F.substring("sig", skip + 2, last - skip - 1))
            keys.append(F.xxhash64(F.lit(skip), kept))
    return F.array(*keys)


def _linked(a: str, b: str, percent: int) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared * 100 >= (F.size(a) + F.size(b) - shared) * percent


def _block_links(percent: int):
    """Links between different components within a block, or between two, as a spanning forest."""

    def work(part: pa.Table) -> pa.Table:
        node, comp = part.column("class").to_numpy(), part.column("comp").to_numpy()
        side = part.column("side").to_numpy()
        lists = part.column("shingles").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(node)), size)
        values, place, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = times[place] > 1  # the rest meets nothing
        number = np.cumsum(times > 1) - 1
        width = int((times > 1).sum())
        bits = np.zeros((len(node), width // 64 + 1), np.uint64)
        slot = number[place[shared]]
        np.bitwise_or.at(bits, (owner[shared], slot >> 6), np.uint64(1) << (slot & 63).astype(np.uint64))
        root = {int(c): int(c) for c in comp}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        found = []
        both = side.max() > 0
        for i in np.flatnonzero(side == 0):
            others = (side == 1) if both else (np.arange(len(node)) > i)
            # The larger of two sets bounds what they can share.
            fits = np.minimum(size, size[i]) * 100 >= np.maximum(size, size[i]) * percent
            j = np.flatnonzero(others & fits & (comp != comp[i]))
            common = np.bitwise_count(bits[j] & bits[i]).sum(axis=1, dtype=np.int64)
            for k in j[common * 100 >= (size[j] + size[i] - common) * percent]:
                a, b = find(int(comp[i])), find(int(comp[k]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    found.append((int(node[i]), int(node[k])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return work


def _blocks(members: DataFrame) -> DataFrame:
    """Deals the members of unresolved clusters to block pairs: ``center, first, second, side``.

    ``members``: center, class, comp, n. Within a cluster the largest component is the main one; pairs
    inside it need no comparison, so only blocks of others meet each other and the main blocks.
    """
    parts = members.groupBy("center", "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("sum"))
    whole = (
        parts.groupBy("center")
        .agg(
            F.count(F.lit(1)).alias("parts"),
            F.max_by("comp", F.struct("rows", "comp")).alias("main"),
            F.sum("rows").alias("all_rows"),
            F.sum("sum").alias("all_sum"),
            F.max(F.struct("rows", "comp", "sum")).alias("top"),
        )
        .where("parts > 1")
    )

    def blocks(rows: Column, total: Column) -> Column:
        return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(total / BLOCK_SHINGLES), F.lit(1)).cast("int")

    whole = whole.select(
        "center",
        "main",
        blocks(F.col("top.rows"), F.col("top.sum")).alias("mains"),
        blocks(F.col("all_rows") - F.col("top.rows"), F.col("all_sum") - F.col("top.sum")).alias("others"),
    )
    placed = members.join(whole, "center").withColumn("is_main", F.col("comp") == F.col("main"))
    block = F.pmod(F.xxhash64("class"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    placed = placed.withColumn("block", block)
    pair = lambda first, second, side: F.struct(  # noqa: E731  main blocks are numbered below zero
        first.cast("int").alias("first"), second.cast("int").alias("second"), side.cast("int").alias("side")
    )
    against_others = F.transform(
        F.sequence(F.lit(0), F.col("others") - 1),
        lambda o: F.when(F.col("is_main"), pair(o, -F.col("block") - 1, F.lit(1))).otherwise(
            pair(F.least(o, F.col("block")), F.greatest(o, F.col("block")), F.col("block") > o)
        ),
    )
    against_main = F.when(
        ~F.col("is_main"),
        F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda m: pair(F.col("block"), -m - 1, F.lit(0))),
    ).otherwise(F.array().cast("array<struct<first:int,second:int,side:int>>"))
    return placed.select("center", "class", "comp", F.explode(F.concat(against_others, against_main)).alias("p")).select(
        "center", "class", "comp", "p.*"
    )


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept`` per row of ``doc_id`` and ``text``.

    Rows whose shingle sets share at least ``percent`` of their union are linked.
    """
    docs = docs.select("doc_id", "text")
    rows = saved(_sketches(docs, size), "near-sketches")
    classes = saved(
        rows.where("n > 0")
        .groupBy("class")
        .agg(
            F.min("id").alias("low"),
            F.first("sig").alias("sig"),
            F.first("n").alias("n"),
            F.min(F.struct("id", "text_hash")).alias("at"),
        ),
        "near-classes",
    )
    keys = classes.select("class", F.explode_outer(_keys(percent)).alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = saved(keys.join(shared, "key"), "near-buckets")
    rank = buckets.groupBy("class").agg(F.sum("members").alias("rank"))
    ranked = buckets.join(rank, "class")
    centers = ranked.groupBy("key").agg(F.max_by("class", F.struct("rank", "class")).alias("center"))
    tested = saved(
        buckets.join(centers, "key").where("class <> center").select("center", "class").distinct(), "near-tested"
    )
    wanted = tested.select("class").union(tested.select("center")).distinct()
    sets = saved(_sets(docs, classes.select("class", "at"), wanted, size), "near-sets")
    center_sets = sets.select(F.col("class").alias("center"), F.col("shingles").alias("center_shingles"))
    links = saved(
        tested.join(center_sets, "center")
        .join(sets, "class")
        .where(_linked("shingles", "center_shingles", percent))
        .select(F.col("class").alias("a"), F.col("center").alias("b")),
        "near-links",
    )
    roots = components(links)

    # What the first comparison leaves in different components: the center has met all of its cluster.
    sized = tested.join(classes.select("class", "n"), "class").join(roots, F.col("class") == F.col("node"), "left")
    members = sized.select("center", "class", "n", F.coalesce("root", "class").alias("comp"))
    blocks = _blocks(members).join(sets, "class")
    more = blocks.groupBy("center", "first", "second").applyInArrow(_block_links(percent), "a bigint, b bigint")
    more = saved(more, "near-more")
    if more.isEmpty():
        final = roots
    else:
        final = components(links.union(more))

    grouped = classes.select("class", "low").join(final, F.col("class") == F.col("node"), "left")
    grouped = grouped.select("class", "low", F.coalesce("root", "class").alias("root"))
    lowest = grouped.groupBy("root").agg(F.min("low").alias("component"))
    named = grouped.join(lowest, "root").select("class", "component")
    out = rows.drop("sig").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(
        F.col("id").alias("doc_id"),
        "text_hash",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without the near-duplicates of a document with a lower id."""
    gone = near_duplicates(docs, size, percent).where(~F.col("kept"))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text")).distinct()
    keyed = docs.withColumns({"__id": F.col("doc_id"), "__text": F.xxhash64("text")})
    return keyed.join(gone, same(keyed, gone, ["__id", "__text"]), "left_anti").select(*docs.columns)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85).drop("text_hash")
