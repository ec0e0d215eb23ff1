"""Running profiles and requests as streams."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from penprint.functions import text as tx
from penprint.operators import counters as ct
from penprint.operators.registry import request_defaults, style_upsert, with_status

RUNNING = ["n_words", "word_chars", "n_sentences", "sent_words_sq", "n_comma", "n_exclamation", "n_passive", "n_punct"]


def running_counters(texts: DataFrame, style: str = "style_name", text: str = "text") -> DataFrame:
    """Additive counters per style. The same plan serves a batch and a stream in update mode.

    The state holds one row of sums per style, whatever the length of the stream.
    """
    t = F.col(text)
    marks, patterns = ct.mark_counts(t), ct.pattern_counts(t, F.lower(t))
    lengths = F.transform(F.filter(tx.fragments(t), lambda s: s.rlike(tx.NON_SPACE)), tx.word_count)
    squares = F.aggregate("__l", F.lit(0).cast("bigint"), lambda acc, n: acc + n.cast("bigint") * n)
    rows = texts.select(style, text, lengths.alias("__l")).select(
        style,
        tx.word_count(t).cast("bigint").alias("n_words"),
        F.length(F.regexp_replace(F.lower(t), f"[^{tx.WORD_CLASS}]+", "")).cast("bigint").alias("word_chars"),
        F.size("__l").cast("bigint").alias("n_sentences"),
        squares.alias("sent_words_sq"),
        *[c.cast("bigint").alias(n) for n, c in {**marks, **patterns}.items() if n in RUNNING],
    )
    return rows.groupBy(style).agg(*[F.sum(n).alias(n) for n in RUNNING])


def stream_profile_counters(texts: DataFrame, table: str, checkpoint: str, key: str = "style_name") -> StreamingQuery:
    """Keep the running counters of all styles in a stored table.

    Each micro-batch hands over the totals of the styles it touched; later totals replace earlier.
    """
    return _logged(running_counters(texts, key).writeStream.outputMode("update"), table, checkpoint)


def stream_transfer_requests(requests: DataFrame, cards: DataFrame) -> DataFrame:
    """Requests joined with the stored styles: a stream-static left join, without state.

    Every column of ``cards`` comes along, and the full status of ``request_status`` with its code.

    Spark sends the style table to every task if it is small enough, and shuffles it otherwise.
    """
    filled = request_defaults(requests)
    joined = filled.join(cards.withColumn("__known", F.lit(True)), "style_name", "left")
    return with_status(joined, F.col("__known").isNotNull()).drop("__known")


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet folder until its input is used up."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_registry_upsert(changes: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Log each micro-batch of changed styles; ``read_registry`` gives the newest row per style."""
    return _logged(changes.writeStream, table, checkpoint)


def _logged(writer: DataStreamWriter, table: str, checkpoint: str) -> StreamingQuery:
    """Write every micro-batch to its own folder below ``table``.

    The work per batch grows with the batch, not with the table. Folders are named by the stream's
    checkpoint and the batch, so a repeated batch overwrites only itself, and streams with
    checkpoints of their own never overwrite each other.
    """
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def store(batch: DataFrame, batch_id: int) -> None:
        timed = batch.withColumn("log_time", F.lit(time.time_ns()))
        timed.write.mode("overwrite").parquet(f"{table}/log_stream=s{name}/log_batch={batch_id}")

    return writer.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_registry(spark: SparkSession, table: str, key: str = "style_name", order: str | None = "ts") -> DataFrame:
    """The newest row per key: by ``order``, then by the time and number of its batch."""
    log = spark.read.parquet(table)
    written = ["log_time", "log_batch"]
    age = F.struct(order, *written) if order else F.struct(*written)
    newest = style_upsert(log.withColumn("__age", age), log.limit(0).withColumn("__age", age), key, "__age")
    return newest.drop("__age", "log_stream", *written)


def compact_registry(
    spark: SparkSession, table: str, into: str, key: str = "style_name", order: str | None = "ts"
) -> None:
    """Write the newest rows of a log as the start of a new one."""
    read_registry(spark, table, key, order).withColumn("log_time", F.lit(0).cast("bigint")).write.parquet(
        f"{into}/log_stream=compacted/log_batch=-1"
    )
