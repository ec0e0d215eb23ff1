"""Target-distribution importance resampling by hashed word n-grams.

Features of a text are its runs of 1 to ``SIZE`` words, repeats counted; a feature's bucket is the CRC-32 of its
bytes modulo ``BUCKETS``. A bucket's gain is the logarithm of how much more often it comes up in the target than in
the corpus, a document's weight the mean gain of its features, and the draw without replacement adds Gumbel noise
made from the document's id, so that it is the same wherever and whenever it runs.

Texts are read twice, for the counts of all buckets and for the weights. Either time a task handles windows of
bytes: words are found by a table of bytes, each distinct word or pair is hashed once, and its CRC comes from
*length-bucketed matrices* (``crc32_of``): distinct features of equal length form a two-dimensional array of bytes,
all CRCs of it are updated column by column, and the results are scattered back. Only the bucket counts (at most
``BUCKETS`` rows) reach the driver.

Ranks need no global sort: scores are whole numbers in a range that does not grow with the corpus (the noise lies in
-3136 to 22874, a gain within 1000 times the logarithm of a count), so the rows of every score are counted, the
counts added up, and rows are numbered within blocks of ids of one score.

Defined results: words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` with A-Z in lower case; null and empty texts
have no features and weight 0; an empty corpus or target counts nothing and is smoothed like any other; texts of
any length are read whole, in windows; ties go to the smaller id, null ids last and hashed as the empty string;
rows of equal id and score follow each other by weight, size and text; an empty table gives an empty table; other
columns are ignored, and ``draw`` passes them through.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penprint.llm.bpe import bounded_batches
from penprint.llm.common import same, saved, table
from penprint.plans.keys import running_totals

SIZE, BUCKETS = 2, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
WINDOW_BYTES = 4_000_000
# Longer features are rare; a column step for one row would cost more than its CRC.
MATRIX_LENGTH, MATRIX_BYTES = 512, 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, bool)
for _first, _last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _IN_WORD[_first : _last + 1] = True


def _crc_table() -> np.ndarray:
    """The CRC-32 of every byte, by eight steps of its reflected polynomial."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1)
    return crc


_TABLE = _crc_table()


# ------------------------------------------------------------------------------------------- features of a window


def crc32_of(features: pa.LargeBinaryArray) -> np.ndarray:
    """Unsigned CRC-32 of every entry, by matrices of entries of equal length."""
    data, offsets = _buffers(features)
    lengths = np.diff(offsets)
    order = np.argsort(lengths, kind="stable")
    sizes, firsts = np.unique(lengths[order], return_index=True)
    out = np.empty(len(features), np.uint32)
    ends = [*firsts[1:].tolist(), len(order)]
    for size, first, end in zip(sizes.tolist(), firsts.tolist(), ends[: len(sizes)], strict=True):
        rows = order[first:end]
        if size > MATRIX_LENGTH:
            for row in rows.tolist():
                out[row] = zlib.crc32(data[offsets[row] : offsets[row + 1]])
            continue
        step = max(1, MATRIX_BYTES // max(1, size))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            matrix = data[offsets[some] + np.arange(size)[:, None]]  # a row per place, so that places are contiguous
            crc = np.full(len(some), 0xFFFFFFFF, np.uint32)
            for place in matrix:
                crc = _TABLE[(crc ^ place) & 0xFF] ^ (crc >> 8)
            out[some] = ~crc
    return out


def _buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array without nulls."""
    array = array.cast(pa.large_binary())
    _, offsets, data = array.buffers()
    places = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), places


class Portion:
    """Words and pairs of words in a window of bytes.

    ``doc`` and ``pair_doc`` give the text of every word and pair, ``word`` and ``pair`` their number among the
    distinct ones, whose buckets are ``word_bucket`` and ``pair_bucket``.
    """

    def __init__(self, packed: np.ndarray, lengths: np.ndarray, doc: np.ndarray, carried: bool):
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
        words = words.dictionary_encode()
        code, distinct = words.indices.to_numpy().astype(np.int64), words.dictionary
        self.word_bucket = crc32_of(distinct) % BUCKETS
        together = doc[1:] == doc[:-1]
        pairs = pa.array((code[:-1] * len(distinct) + code[1:])[together]).dictionary_encode()
        first, second = np.divmod(pairs.dictionary.to_numpy(), len(distinct))
        joined = pc.binary_join_element_wise(distinct.take(pa.array(first)), distinct.take(pa.array(second)), pa.scalar(b" ", pa.large_binary()))
        self.pair_bucket = crc32_of(joined) % BUCKETS
        self.pair, self.pair_doc = pairs.indices.to_numpy(), doc[1:][together]
        self.word, self.doc = code[carried:], doc[carried:]  # the window before has counted the word carried over

    def counts(self) -> np.ndarray:
        found = np.zeros(BUCKETS, np.int64)
        for number, bucket in ((self.word, self.word_bucket), (self.pair, self.pair_bucket)):
            times = np.bincount(number, minlength=len(bucket))
            found += np.bincount(bucket, times, BUCKETS).astype(np.int64)
        return found


def portions(texts: pa.Array) -> Iterator[Portion]:
    """The words of all texts, in windows that end between words and begin with the last word of the one before."""
    data, offsets = _buffers(pc.fill_null(texts, ""))
    at = behind = int(offsets[0])
    end, carried = int(offsets[-1]), False
    while behind < end:
        behind = _word_end(data, min(behind + WINDOW_BYTES, end), end)
        part = _LOWER[data[at:behind]]
        inside = np.zeros(len(part) + 2, bool)
        here, before, after = inside[1:-1], inside[:-2], inside[2:]
        here[:] = _IN_WORD[part]
        begins, ends = here & ~before, here & ~after
        borders = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, behind, "left")] - at
        begins[borders] = here[borders]
        ends[borders - 1] = here[borders - 1]
        starts = np.flatnonzero(begins)
        if len(starts) > carried:
            doc = np.searchsorted(offsets, starts + at, "right") - 1
            yield Portion(part[here], np.flatnonzero(ends) + 1 - starts, doc, carried)
        carried = len(starts) > 0
        at = at + int(starts[-1]) if carried else behind


def _word_end(data: np.ndarray, at: int, end: int) -> int:
    """The first place from ``at`` on that is not inside a word, or ``end``."""
    while at < end:
        gap = np.flatnonzero(~_IN_WORD[_LOWER[data[at : min(at + 4096, end)]]])
        if len(gap):
            return at + int(gap[0])
        at = min(at + 4096, end)
    return end


# --------------------------------------------------------------------------------------------------------- Spark


def bucket_counts(texts: DataFrame) -> DataFrame:
    """``bucket, n``: how often the features of all texts fall in each bucket; a task sends one row per bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for portion in portions(batch.column(0)):
                total += portion.counts()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    bounded_batches(texts.sparkSession)
    return texts.select("text").mapInArrow(work, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of every bucket, from the counts of all texts of both tables."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for row, texts in enumerate((corpus, target)):
        for bucket, n in bucket_counts(texts).collect():
            counts[row, bucket] = n
    all_s, all_t = map(float, counts.sum(axis=1))
    gain = [
        math.floor(1000 * math.log((t + 1.0) * (all_s + BUCKETS) / ((s + 1.0) * (all_t + BUCKETS))))
        for s, t in zip(*counts.astype(float).tolist(), strict=True)
    ]
    return np.array(gain, np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, tie, n_words, n_features, weight`` per row of ``doc_id, text``; ``tie`` is a hash of the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = len(batch)
            words, features, total = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
            for p in portions(batch.column("text")):
                words += np.bincount(p.doc, minlength=size)
                for number, bucket, doc in ((p.word, p.word_bucket, p.doc), (p.pair, p.pair_bucket, p.pair_doc)):
                    features += np.bincount(doc, minlength=size)
                    # Sums of whole numbers far below 2**53 are exact in doubles.
                    total += np.bincount(doc, gain[bucket][number], size).astype(np.int64)
            mean = np.where(features > 0, total // np.maximum(features, 1), 0)
            columns = [batch.column("doc_id"), batch.column("tie"), pa.array(words), pa.array(features), pa.array(mean)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "n_words", "n_features", "weight"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(work, "doc_id bigint, tie bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, made from a hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, tie, n_words, n_features, weight, score, rank`` per row of ``doc_id, text``.

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred are drawn, those with the highest
    scores; they are ranked from 1, the rank of others is null. ``target`` has a column ``text``.
    """
    scored = weights(docs, gains(docs, target))
    scored = saved(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "importance-scores")
    higher = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row per score: a window in one task that does not grow with the corpus.
    per_score = scored.where(F.col("n_words") >= least_words).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    quota = F.floor(F.sum("n").over(whole) * percent / 100)
    above = per_score.select("score", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("above"), quota.alias("quota"))
    above = above.where("above < quota")
    marked = scored.withColumn("draws", F.when(F.col("n_words") >= least_words, F.col("score")))
    above = above.withColumnRenamed("score", "draws")
    marked = marked.join(above, "draws", "left").drop("draws").withColumn("one", F.lit(1))
    drawn = running_totals(marked.where("above is not null"), "score", "doc_id", {"before": "one"}, ties=["weight", "n_features", "tie"])
    place = F.col("above") + F.col("before") + 1
    names = ["doc_id", "tie", "n_words", "n_features", "weight", "score"]
    ranked = drawn.select(*names, F.when(place <= F.col("quota"), place).alias("rank"))
    return ranked.union(marked.where("above is null").select(*names, F.lit(None).cast("bigint").alias("rank")))


def draw(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The drawn rows of ``docs``, with all their columns; rows of equal id and text are drawn or left together."""
    chosen = resample(docs, target, **options).where("rank is not null").select("doc_id", "tie").distinct()
    chosen = chosen.select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"))
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("bigint"), "__tie": F.xxhash64("text")})
    return keyed.join(chosen, same(keyed, chosen, ["__id", "__tie"]), "left_semi").select(*docs.columns)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark")).drop("tie", "n_words")


_SPLIT = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS w FROM documents),
runs AS (
  SELECT r, doc_id, len(w) AS n_words, w || list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2]) AS f FROM texts),
own AS (
  SELECT r, feature, count(*) AS n FROM (SELECT r, unnest(f) AS feature FROM runs) GROUP BY ALL),
other AS (
  SELECT feature, count(*) AS n FROM (
    SELECT unnest(w || list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) AS feature FROM (SELECT {_SPLIT} AS w FROM benchmark))
  GROUP BY ALL),
crcs AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM range(256) AS b(i)),
buckets AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(
      string_split(regexp_replace(hex(feature), '(..)', '\1 ', 'g'), ' ')[:-2], lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT feature FROM own UNION SELECT feature FROM other), crcs),
gains AS (
  SELECT i AS bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sum(coalesce(s, 0)) OVER () + {BUCKETS})::DOUBLE
      / ((coalesce(s, 0) + 1)::DOUBLE * (sum(coalesce(t, 0)) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM range({BUCKETS}) AS b(i)
  LEFT JOIN (SELECT bucket, sum(n) AS s FROM own JOIN buckets USING (feature) GROUP BY bucket) AS own_sums ON own_sums.bucket = i
  LEFT JOIN (SELECT bucket, sum(n) AS t FROM other JOIN buckets USING (feature) GROUP BY bucket) AS other_sums ON other_sums.bucket = i),
weights AS (
  SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
  FROM own JOIN buckets USING (feature) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM runs LEFT JOIN weights USING (r)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place,
    {PERCENT} * count(*) FILTER (n_words >= {LEAST_WORDS}) OVER () // 100 AS quota
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= quota THEN place END AS rank FROM ranked
"""
