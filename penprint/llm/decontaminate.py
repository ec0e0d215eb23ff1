"""Benchmark decontamination: windows of an item's size where rare shingles occur, exact check.

1. Words are runs of letters, marks and digits in lower case; a shingle is five words, or the whole
   text if it is shorter. A shingle weighs its number of characters.
2. A window that is ``MIN_SIMILARITY`` alike to an item misses at most the rest of the item's weight, so
   it holds one of the item's *seeds*: its rarest shingles, as many as weigh more than that rest.
   Documents without a seed of an item are never compared with it.
3. Around the seeds every shingle shared by document and item fixes a window of the item's length.
4. Weighted Jaccard similarity of the shingles themselves decides for every such window.

No fingerprint stands before the check: one changed word in an item of 15 to 60 words moves a SimHash
of single words by more than a small radius, and no radius is sure. The 64-bit SimHash of the words,
weighted by their length, is only reported: ``distance`` is that of the window from the item.

An item of fewer than five words is one shingle, its whole text: it is found only in a document that
consists of it alone, not inside a longer one, where so few words say nothing.

Defined results: null and empty texts and items match nothing; null ``doc_id`` or ``item_id`` are values
like any others; rows that repeat id and text give one result row; of equally similar windows the
first is reported; an empty table on either side gives no matches; other columns are ignored, and
``decontaminate`` passes them through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penprint.llm.common import same, saved, table

SHINGLE = 5
MIN_SIMILARITY = 0.8
# Of the fingerprint index (``_blocks``), which ``find_leaks`` does not search.
RADIUS, BLOCKS = 7, 4
BLOCK_BITS = 64 // BLOCKS
# Seeds up to this many rows (20 bytes each) are sent to all executors; more are joined by shuffle.
BROADCAST_SEEDS = 200_000
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), NOT_WORD, -1), "")


def _shingle_hashes(words: str, hashes: str) -> Column:
    """Hash of each shingle in order. ``hashes`` names the array of word hashes."""
    size = F.size(words)
    five = F.transform(
        F.sequence(F.lit(0), size - F.lit(SHINGLE)),
        lambda i: F.xxhash64(*[F.get(hashes, i + F.lit(k)) for k in range(SHINGLE)]),
    )
    return (
        F.when(size >= SHINGLE, five)
        .when(size > 0, F.array(F.xxhash64(F.lit(-1), hashes)))
        .otherwise(F.array().cast("array<bigint>"))
    )


def _shingles(words: str) -> Column:
    """Distinct shingles as text."""
    size = F.size(words)
    starts = F.sequence(F.lit(1), F.greatest(size - F.lit(SHINGLE - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, SHINGLE), " ")))


def _hashed(df: DataFrame, text: str, *keep: Column) -> DataFrame:
    out = df.select(*keep, _words(text).alias("__words"))
    out = out.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))
    return out.withColumn("__shingles", _shingle_hashes("__words", "__hashes"))


def fingerprint(words: Column) -> Column:
    """64-bit SimHash of words weighted by their length."""
    pairs = F.transform(words, lambda w: F.struct(F.xxhash64(w).alias("h"), F.length(w).alias("l")))

    def bit(b: Column) -> Column:
        votes = F.aggregate(
            "__pairs",
            F.lit(0),
            lambda a, x: a
            + F.when(F.call_function("shiftright", x["h"], b).bitwiseAND(F.lit(1).cast("bigint")) == 1, x["l"]).otherwise(
                -x["l"]
            ),
        )
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), b)
        return F.when(votes > 0, one).otherwise(F.lit(0).cast("bigint"))

    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), bit)
    return pairs, F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def _with_fingerprint(df: DataFrame, words: str) -> DataFrame:
    pairs, value = fingerprint(F.col(words))
    return df.withColumn("__pairs", pairs).withColumn("__print", value).drop("__pairs")


def _blocks(variants: bool) -> Column:
    """Block number and block value pairs of ``__print``; with all values that differ in few bits."""
    mask = (1 << BLOCK_BITS) - 1
    errors = RADIUS // BLOCKS
    flips = [0]
    for _ in range(errors if variants else 0):
        flips = sorted({f ^ (1 << j) for f in flips for j in range(BLOCK_BITS)} | set(flips))
    entries = []
    for block in range(BLOCKS):
        value = F.shiftright("__print", block * BLOCK_BITS).bitwiseAND(F.lit(mask))
        entries += [F.struct(F.lit(block).alias("block"), value.bitwiseXOR(F.lit(f)).alias("value")) for f in flips]
    return F.array(*entries)


def _items(benchmark: DataFrame) -> DataFrame:
    items = _hashed(benchmark, "text", F.col("item_id")).where(F.size("__words") > 0)
    key = F.xxhash64(F.col("item_id").isNull(), "item_id", "__words")
    return items.select(key.alias("__item"), "item_id", "__words", "__shingles", F.size("__words").alias("n_words")).distinct()


def _seeds(items: DataFrame) -> DataFrame:
    """``__seed, __item, n_words``: rarest shingles of each item that outweigh what may be missing."""
    each = items.select("__item", "n_words", "__words", F.posexplode("__shingles").alias("offset", "__seed")).withColumn(
        "weight", F.length(F.array_join(F.slice("__words", F.col("offset") + 1, SHINGLE), " "))
    )
    by_item = each.groupBy("__item", "n_words", "__seed").agg(F.max("weight").alias("weight"))
    rare = by_item.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("__seed")))
    rest = Window.partitionBy("__item").orderBy("df", "__seed").rowsBetween(Window.unboundedPreceding, -1)
    chosen = rare.withColumn("before", F.coalesce(F.sum("weight").over(rest), F.lit(0))).withColumn(
        "total", F.sum("weight").over(Window.partitionBy("__item"))
    )
    # Without the shingles before it an item can still be just alike enough, so this one is needed too.
    return chosen.where(F.col("total") - F.col("before") >= MIN_SIMILARITY * F.col("total")).select(
        "__seed", "__item", "n_words"
    )


def _starts() -> Column:
    """First words of the windows of ``__near``, the words from ``low`` on, that a shared shingle fixes."""
    shared = F.filter(
        F.transform("__near_shingles", lambda g, i: F.struct(g.alias("g"), (F.col("low") + i).alias("at"))),
        lambda x: F.array_contains("__item_shingles", x["g"]),
    )
    places = F.transform("__item_shingles", lambda g, i: F.struct(g.alias("g"), i.alias("offset")))
    fixed = F.transform(
        shared,
        lambda x: F.transform(
            F.filter(places, lambda y: y["g"] == x["g"]), lambda y: F.greatest(x["at"] - y["offset"], F.lit(0))
        ),
    )
    inside = F.filter(F.flatten(fixed), lambda p: (p >= F.col("low")) & (p <= F.col("last")))
    return F.array_distinct(inside)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, __text, item_id, first_word, n_words, similarity, distance``: best window of each pair."""
    items = saved(_items(benchmark), "benchmark-items")
    seeds = saved(_seeds(items), "benchmark-seeds")
    if seeds.count() <= BROADCAST_SEEDS:
        seeds = F.broadcast(seeds)
    # The outer form: for the plain one the optimizer adds a filter that builds the array once more.
    places = (
        _hashed(docs, "text", F.col("doc_id"), F.xxhash64("text").alias("__text"))
        .select("doc_id", "__text", F.posexplode_outer("__shingles").alias("place", "__seed"))
        .where(F.col("__seed").isNotNull())
    )
    # A window with a seed starts at most its own length before the first one and at the last one.
    before = F.greatest(F.col("n_words") - F.lit(SHINGLE), F.lit(0))
    pairs = (
        places.join(seeds, "__seed")
        .groupBy("doc_id", "__text", "__item", "n_words")
        .agg(F.min("place").alias("first"), F.max("place").alias("last"))
        .select("doc_id", "__text", "__item", "last", F.greatest(F.col("first") - before, F.lit(0)).alias("low"))
        .groupBy("doc_id", "__text")
        .agg(F.collect_list(F.struct("__item", "low", "last")).alias("pairs"))
    )
    keyed = docs.select(F.col("doc_id"), F.xxhash64("text").alias("__text"), "text")
    wanted = items.select("__item", "item_id", F.col("__words").alias("__item_words"), F.col("__shingles").alias("__item_shingles"))
    near = (
        keyed.join(pairs, same(keyed, pairs, ["doc_id", "__text"]))
        .select(keyed["doc_id"], keyed["__text"], _words("text").alias("__words"), "pairs")
        .select("doc_id", "__text", "__words", F.explode("pairs").alias("p"))
        .select("doc_id", "__text", "__words", "p.*")
        .join(wanted, "__item")
        .withColumn("size", F.size("__item_words"))
        .withColumn("__near", F.slice("__words", F.col("low") + 1, F.col("last") - F.col("low") + F.col("size")))
        .drop("__words")
        .withColumn("__hashes", F.transform("__near", lambda w: F.xxhash64(w)))
        .withColumn("__near_shingles", _shingle_hashes("__near", "__hashes"))
    )
    windows = (
        near.withColumn("first_word", F.explode(_starts()))
        .withColumn("__words", F.slice("__near", F.col("first_word") - F.col("low") + 1, F.col("size")))
        .select("doc_id", "__text", "item_id", "first_word", "__words", "__item_words")
        .withColumn("__a", _shingles("__words"))
        .withColumn("__b", _shingles("__item_words"))
    )
    weight = lambda shingles: F.aggregate(shingles, F.lit(0), lambda a, s: a + F.length(s))
    best = F.max_by(
        F.struct("first_word", F.size("__words").alias("n_words"), "similarity", "__words", "__item_words"),
        F.struct("similarity", -F.col("first_word")),
    )
    leaks = (
        windows.withColumn("similarity", weight(F.array_intersect("__a", "__b")) / weight(F.array_union("__a", "__b")))
        .where(F.col("similarity") >= MIN_SIMILARITY)
        .groupBy("doc_id", "__text", "item_id")
        .agg(best.alias("best"))
        .select("doc_id", "__text", "item_id", "best.*")
    )
    leaks = _with_fingerprint(leaks, "__words").withColumnRenamed("__print", "__window_print")
    leaks = _with_fingerprint(leaks, "__item_words")
    distance = F.bit_count(F.col("__window_print").bitwiseXOR(F.col("__print"))).alias("distance")
    return leaks.select("doc_id", "__text", "item_id", "first_word", "n_words", "similarity", distance)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    leaks = find_leaks(docs, benchmark).select("doc_id", "__text").distinct()
    keyed = docs.withColumns({"__id": F.col("doc_id"), "__text": F.xxhash64("text")})
    leaks = leaks.withColumnRenamed("doc_id", "__id")
    return keyed.join(leaks, same(keyed, leaks, ["__id", "__text"]), "left_anti").select(*docs.columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return leaks.select("doc_id", "item_id", "first_word", "n_words", "similarity")


def _sql() -> str:
    words = f"list_filter(string_split_regex(lower(coalesce(text, '')), '{NOT_WORD}'), lambda x: x <> '')"
    shingles = f"list_distinct(list_transform(range(1, greatest(len(ws) - {SHINGLE - 2}, 2)), lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' ')))"
    weight = "list_sum(list_transform({}, lambda s: length(s)))"
    return f"""WITH d AS (SELECT doc_id, {words} AS ws FROM documents),
b AS (SELECT item_id, {words} AS ws FROM benchmark),
dg AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {SHINGLE - 2})) AS i FROM d)),
bg AS (
  SELECT item_id, i, n, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS g
  FROM (SELECT item_id, ws, len(ws) AS n, unnest(range(1, len(ws) - {SHINGLE - 2})) AS i FROM b)),
starts AS (SELECT DISTINCT doc_id, item_id, greatest(dg.i - bg.i, 0) AS p, n FROM dg JOIN bg USING (g)),
win AS (
  SELECT s.doc_id, s.item_id, p, d.ws[p + 1:p + n] AS ws, b.ws AS bws
  FROM starts s JOIN d USING (doc_id) JOIN b USING (item_id)),
sets AS (
  SELECT doc_id, item_id, p, len(ws) AS n, {shingles} AS a, {shingles.replace("ws", "bws")} AS c FROM win),
scored AS (
  SELECT doc_id, item_id, p, n,
         {weight.format("list_intersect(a, c)")} / {weight.format("list_distinct(list_concat(a, c))")} AS similarity
  FROM sets)
SELECT doc_id, item_id, p::INTEGER AS first_word, n::INTEGER AS n_words, similarity
FROM scored WHERE similarity >= {MIN_SIMILARITY}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, p) = 1"""


SQL = _sql()
