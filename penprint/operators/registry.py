"""Stored styles, and requests against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penprint.operators.prompts import overlong_check, style_prompt
from penprint.operators.segment import strip_prompt_echo
from penprint.plans.keys import join_on

DEFAULT_STYLE, DEFAULT_AUTHOR = "custom_style", "the target style"


def style_upsert(registry: DataFrame, changes: DataFrame, key: str = "style_name", order: str = "ts") -> DataFrame:
    """The newest row per style out of the stored and the new ones.

    At equal times a change replaces what is stored; among equals of one table the largest row, in
    the order of its columns, wins, so that the outcome does not depend on the order of rows. A row
    without a time is older than any other.
    """
    both = registry.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    whole = F.struct(*registry.columns)
    comparable = F.to_json(whole) if any(f.dataType.typeName() in ("map", "variant") for f in registry.schema) else whole
    newest = F.max_by(whole, F.struct(F.col(order), F.col("__new"), comparable)).alias("s")
    return both.groupBy(key).agg(newest).select("s.*")


def style_lookup(requests: DataFrame, registry: DataFrame, row_id: str = "request_id") -> DataFrame:
    """Requests with the columns of their style; those of an unknown style are left out."""
    return join_on(requests, registry, ["style_name"])


def unknown_styles(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests whose style is not stored."""
    names = registry.select("style_name").distinct()
    return requests.join(names, "style_name", "left_anti")


def list_styles(registry: DataFrame) -> DataFrame:
    return registry.select("style_name").distinct()


def request_defaults(requests: DataFrame) -> DataFrame:
    """Fill in the style, the author and the text of requests that leave them out."""
    fill = {"style_name": DEFAULT_STYLE, "author_name": DEFAULT_AUTHOR, "original_text": "", "stylized_text": ""}
    return requests.withColumns(
        {c: F.coalesce(c, F.lit(v)) for c, v in fill.items() if c in requests.columns}
    )


def request_status(requests: DataFrame, registry: DataFrame, row_id: str = "request_id") -> DataFrame:
    """Every request with ``status`` and ``http_code``; nothing is dropped.

    A ``failure`` column, where present, holds the error text of a failed run.
    """
    known = registry.select("style_name", F.lit(True).alias("__known")).distinct()
    both = join_on(requests, known, ["style_name"], "left")
    return with_status(both, F.col("__known").isNotNull()).drop("__known")


def with_status(rows: DataFrame, known: Column) -> DataFrame:
    """Add ``status`` and ``http_code``; ``known`` tells whether a request's style is stored."""
    failed = F.col("failure") if "failure" in rows.columns else F.lit(None).cast("string")
    status = (
        F.when(F.length("original_text") == 0, "missing_text")
        .when(~known, "unknown_style")
        .when(failed.contains("Connection"), "no_connection")
        .when(failed.isNotNull(), "failed")
        .otherwise("ok")
    )
    codes = {"missing_text": 400, "unknown_style": 400, "no_connection": 503, "failed": 500, "ok": 200}
    code = F.lit(None)
    for name, number in codes.items():
        code = F.when(F.col("status") == name, number).otherwise(code)
    return rows.withColumn("status", status).withColumn("http_code", code.cast("bigint"))


def transfer_batch(
    requests: DataFrame,
    registry: DataFrame,
    cards: DataFrame,
    answers: DataFrame | None = None,
    row_id: str = "request_id",
) -> DataFrame:
    """Defaults, status and prompt per request, and the checked answer where one is supplied.

    ``answers(request_id, output)`` comes from whatever model the prompts were sent to.
    """
    rows = style_prompt(request_status(request_defaults(requests), registry, row_id), cards, row_id)
    rows = rows.withColumn("prompt", F.when(F.col("status") == "ok", F.col("prompt")))
    if answers is None:
        return rows
    both = rows.join(answers, row_id, "left")
    clean = strip_prompt_echo(both.withColumn("__p", F.coalesce("prompt", F.lit(""))), "output", "__p").drop("__p")
    return overlong_check(clean)
